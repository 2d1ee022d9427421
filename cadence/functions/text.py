"""Column functions over words, urls, labels and captions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which urls are taken, what section markers mean, and which words in a query name a genre, first hit first.
URL_PREFIXES = ("https://www.youtube.com/", "https://youtube.com/", "https://youtu.be/")
LABELS = {"YOUTUBE_KIDS": "kids", "KIDS": "kids", "NORMAL_YOUTUBE": "normal", "YOUTUBE_NORMAL": "normal", "NORMAL": "normal"}
KIDS_GENRES = (
    ("music", ("song", "rhymes", "music", "bum", "goose")),
    ("stories/shows", ("story", "read aloud", "peppa")),
    ("science/learning", ("science", "experiment", "scishow", "nat geo", "national geographic", "brainpop", "minuteearth")),
    ("art/crafts", ("draw", "craft")),
    ("movement/yoga", ("yoga",)),
    ("math", ("numberblocks", "math")),
)
OTHER_GENRE = "educational/entertainment"
UNAVAILABLE = ("private", "premium_only", "subscriber_only")
#: Stands in the place of a missing number.
DASH = "—"
#: Bytes of a word whose cuts are found by looking back over all its letters.
FEW_LETTERS = 1_000
VOWELS, CONSONANTS = "AEIOUYaeiouy", "B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz"
#: Letters but for e, what isn't a letter in ASCII, and all of ASCII with the kinds of its letters.
LETTERS = [c for c in string.ascii_letters if c not in "eE"]
NO_LETTERS = "".join(chr(k) for k in range(128) if chr(k) not in string.ascii_letters)
ASCII = string.ascii_letters + NO_LETTERS
KINDS = "".join("a" if c in VOWELS else "b" for c in string.ascii_letters)


def is_supported_url(url: Column, prefixes: tuple[str, ...] = URL_PREFIXES) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | url.startswith(p)
    return F.coalesce(found, F.lit(False))


def video_key(url: Column) -> Column:
    """A short id: the first path segment of a short link, else the query's v; 'video' if nothing is left."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    short = F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))
    long = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    key = F.when(host.endswith("youtu.be"), short).otherwise(long)
    key = F.substring(F.regexp_replace(F.coalesce(key, F.lit("")), "[^A-Za-z0-9_-]", ""), 1, 32)
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("video"))


def clean(text: Column) -> Column:
    """One space for each run of white space, none at the ends; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def first_given(*texts: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def duration_between(duration: Column, low: float, high: float) -> Column:
    """Both ends included; what is no number doesn't hold."""
    return F.coalesce(duration.try_cast("double").between(low, high), F.lit(False))


def classify(source: Column) -> Column:
    return F.when(source == "youtube_kids", "kids_candidate").otherwise("normal_youtube")


def age_group(source: Column, group: Column) -> Column:
    return F.when(source == "youtube_kids", group).otherwise("adult/general")


def kids_genre(query: Column, genres=KIDS_GENRES) -> Column:
    low, out = F.lower(query), None
    for label, terms in genres:
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(OTHER_GENRE)


def watch_url(url: Column, video_id: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id))


def kids_url(source: Column, video_id: Column) -> Column:
    return F.when(source == "youtube_kids", F.concat(F.lit("https://www.youtubekids.com/watch/"), video_id)).otherwise("")


def has_audio_format(formats: Column) -> Column:
    """formats: array of structs with url and acodec."""
    sound = F.exists(formats, lambda f: (F.coalesce(f["url"], F.lit("")) != "") & (F.coalesce(f["acodec"], F.lit("none")) != "none"))
    return F.coalesce(sound, F.lit(False))


def language_ok(language: Column) -> Column:
    low = F.lower(clean(language))
    return (low == "") | low.startswith("en")


def language_label(language: Column) -> Column:
    return first_given(F.lower(clean(language)), F.lit("english_search_candidate"))


def available(availability: Column) -> Column:
    return availability.isNull() | ~availability.isin(*UNAVAILABLE)


def normalize_label(raw: Column) -> Column:
    """kids or normal; null if unknown."""
    out = None
    for name, label in LABELS.items():
        hit = F.upper(raw) == name
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def output_name(index: Column, label: Column, key: Column) -> Column:
    return F.concat(label, F.lit("/"), F.format_string("video_%04d_%s.json", index, key))


def job_output_name(job_id: Column, label: Column, key: Column) -> Column:
    return F.format_string("%s/api_%s_%s.json", label, job_id, key)


def pitch_range_ok(floor: Column, ceiling: Column) -> Column:
    return F.coalesce(ceiling.between(40, 1200) & (floor >= 20) & (floor < ceiling), F.lit(False))


def clamp_duration(start: Column, end: Column) -> Column:
    """Never below a millionth of a second, as rates are divided by it."""
    return F.greatest(end - start, F.lit(1e-6))


def duration_min(seconds: Column) -> Column:
    return F.round(seconds / 60, 2)


def speech_rate(units: Column, duration: Column) -> Column:
    return F.round(units / duration, 3)


def utc_now() -> Column:
    """The session's time zone must be UTC."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def syllabify(word: Column) -> Column:
    """Parts of a word, by its letters: a cut lies before the last consonant in front of each further run of vowels.

    A single e at the end, after a consonant, counts as silent if there is another vowel, unless the word ends in le.
    A word without Latin letters is one part, as written.
    """
    ascii = F.octet_length(word) == F.char_length(word)
    letters = F.when(ascii, F.translate(word, NO_LETTERS, "")).otherwise(F.regexp_replace(word, "[^A-Za-z]", ""))
    # places of cuts: a consonant and a vowel follow, no silent e, and a vowel stands before, with any consonants in between;
    # a pattern is compiled once in a replacement, but once a row in a split by more than a character
    near = F.regexp_replace(letters, f"(?=[{CONSONANTS}][{VOWELS}])(?<=[{VOWELS}][{CONSONANTS}]{{0,{FEW_LETTERS}}})(?![{CONSONANTS}&&[^lL]][eE]$)", "|")
    marked = F.when(F.octet_length(word) > FEW_LETTERS, _marked(letters)).otherwise(near)
    return F.when(~word.rlike("[A-Za-z]"), F.array(word)).otherwise(F.split(marked, "\\|"))


def _marked(letters: Column) -> Column:
    """Letters of a word of any length, with | at its cuts."""
    guarded = F.regexp_replace(letters, "(?i)([aeiouy].*[^aeiouyl])(e)$", "$1#$2")
    cut = F.regexp_replace(guarded, "(?i)([^aeiouy#])([aeiouy]+)", "|$1$2")
    return F.regexp_replace(F.regexp_replace(cut, "(?i)^([^aeiouy|]*)[|]", "$1"), "#", "")


def count_syllables(word: Column) -> Column:
    """As many as syllabify's parts, without them: runs of vowels among the letters, less a silent e at the end; 1 at least."""
    # of ASCII words the kinds of letters are kept, a for vowels and b for others, and steps from b to a counted
    steps = F.replace(F.concat(F.lit("b"), F.translate(word, ASCII, KINDS)), F.lit("ba"), F.lit("c"))
    any_word = F.regexp_count(word, F.lit("[AEIOUYaeiouy](?:[^A-Za-z]*+[AEIOUYaeiouy])*+"))
    runs = F.when(F.octet_length(word) == F.char_length(word), F.char_length(F.translate(steps, "ab", ""))).otherwise(any_word)
    # the first condition is quick and spares most words the second
    silent = ~F.substring(word, -1, 1).isin(*LETTERS) & word.rlike(f"[{CONSONANTS}&&[^lL]][^A-Za-z]*+[Ee][^A-Za-z]*+\\z")
    return F.greatest(F.lit(1), runs - silent.cast("int"))


def centiseconds(t: Column) -> Column:
    return F.rint(F.greatest(t, F.lit(0.0)) * 100).cast("long")


def caption_time(t: Column) -> Column:
    """h:mm:ss.cc; negative times are 0."""
    c = centiseconds(t)
    pair = lambda x: F.lpad(x.cast("string"), 2, "0")
    whole = lambda unit: F.floor(c / unit)
    return F.concat(
        whole(360000).cast("string"), F.lit(":"), pair(F.pmod(whole(6000), F.lit(60))), F.lit(":"),
        pair(F.pmod(whole(100), F.lit(60))), F.lit("."), pair(F.pmod(c, F.lit(100))),
    )


def caption_escape(text: Column) -> Column:
    """Braces and backslashes would begin commands in captions."""
    return F.translate(text, "\\{}", "/()")


def number_or_dash(value: Column, decimals: int, unit: str) -> Column:
    """Exact halves go to the even digit."""
    scale = 10**decimals
    n, exact = F.rint(value * scale).cast("long"), F.format_string(f"%.{decimals}f {unit}", F.bround(value, decimals))
    digits = (F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), decimals, "0")) if decimals else (n.cast("string"),)
    # a number near the middle of two is rounded by its decimal digits, all others by what is nearer, which is far quicker
    near = (value > 0) & (value < 1e6) & (F.abs(value * scale - F.floor(value * scale) - 0.5) > 1e-6)
    return F.when(value.isNull(), DASH).when(near, F.concat(*digits, F.lit(f" {unit}"))).otherwise(exact)


def word_info_text(word: Column, pitch: Column, pause: Column, rate: Column) -> Column:
    return F.concat(
        F.lit("“"), caption_escape(word), F.lit("”    pitch "), number_or_dash(pitch, 0, "Hz"),
        F.lit("    pause after "), number_or_dash(pause, 2, "s"), F.lit("    rate "), number_or_dash(rate, 1, "syl/s"),
    )


def ends_sentence(word: Column) -> Column:
    return F.coalesce(word.rlike("[.?!][\"']*$"), F.lit(False))


def syllable_text(syllable: Column, index: Column, count: Column) -> Column:
    """Two spaces after the last syllable of a word, a dot in between."""
    return F.concat(syllable, F.when(index == count, "  ").otherwise("·"))
