import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.functions import text as T
from cadence.operators.align import syllable_units


def one(spark, value, column):
    kind = "double" if isinstance(value, float) else "string"
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word, parts", [
    ("cat", ["cat"]), ("hello", ["hel", "lo"]), ("spectacular", ["spec", "ta", "cu", "lar"]), ("beautiful", ["beau", "ti", "ful"]),
    ("make", ["make"]), ("e", ["e"]), ("", [""]), ("table", ["tab", "le"]), ("42", ["42"]), ("it's", ["its"]),
])
def test_syllabify(spark, word, parts):
    assert one(spark, word, T.syllabify) == parts


def nuclei_rule(word):
    """The rule told step by step, as a check of the regular expressions."""
    letters = "".join(c for c in word if c.isascii() and c.isalpha())
    if not letters:
        return [word]
    spans, i = [], 0
    while i < len(letters):
        j = i
        while j < len(letters) and letters[j].lower() in "aeiouy":
            j += 1
        if j > i:
            spans.append((i, j))
        i = max(j, i + 1)
    silent = len(spans) > 1 and spans[-1] == (len(letters) - 1, len(letters)) and letters[-1].lower() == "e" and letters[-2].lower() != "l"
    spans = spans[:-1] if silent else spans
    cuts = [b[0] - 1 for b in spans[1:]]
    return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)], strict=True)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abceilnostyAEL'-é.", max_size=12), min_size=60, max_size=60))
def test_syllabify_is_the_rule(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "x string").select("x", T.syllabify(F.col("x")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(w, nuclei_rule(w)) for w in words]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abeiou", min_size=1, max_size=9), st.integers(0, 50), st.integers(1, 20)), min_size=5, max_size=20))
def test_units_tile_their_word(spark, words):
    rows = [(1, i, w, s / 8, (s + n) / 8) for i, (w, s, n) in enumerate(words)]
    units = syllable_units(spark.createDataFrame(rows, "recording_id long, pos long, word string, start_sec double, end_sec double")).collect()
    for _, pos, _, start, end in rows:
        own = sorted((u for u in units if u.pos == pos), key=lambda u: u.syllable_index)
        assert own[0].start_sec == start and own[-1].end_sec == end and [u.syllable_index for u in own] == list(range(1, own[0].syllable_count + 1))
        assert all(a.end_sec == b.start_sec for a, b in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("url, key", [
    ("https://youtu.be/abc_-1/x?y=1", "abc_-1"), ("https://www.youtube.com/watch?v=Q%2Dq&t=3", "Q-q"), ("https://www.youtube.com/playlist", "video"),
    ("https://youtu.be/", "video"), ("no url at all", "video"), ("https://youtube.com/watch?v=" + "a" * 50, "a" * 32),
])
def test_video_key(spark, url, key):
    assert one(spark, url, T.video_key) == key


def test_null_safe_texts(spark):
    r = spark.createDataFrame([(None,)], "x string").select(T.clean(F.col("x")).alias("c"), T.is_supported_url(F.col("x")).alias("s"), T.available(F.col("x")).alias("a"), T.language_ok(F.col("x")).alias("l"), T.language_label(F.col("x")).alias("n"), T.video_key(F.col("x")).alias("k")).first()
    assert (r.c, r.s, r.a, r.l, r.n, r.k) == ("", False, True, True, "english_search_candidate", "video")
    assert one(spark, " a  b\tc\n", T.clean) == "a b c"


def test_availability_language_duration(spark):
    rows = spark.createDataFrame([("private", "de", "299"), ("public", "en-GB", "300"), (None, " EN ", "600"), ("premium_only", "", "x")], "a string, l string, d string")
    got = rows.select(T.available(F.col("a")), T.language_ok(F.col("l")), T.duration_between(F.col("d"), 300, 600)).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, True, True), (True, True, True), (False, True, False)]


def test_audio_formats(spark):
    rows = spark.sql("SELECT * FROM VALUES (array(named_struct('url','u','acodec','none'))), (array(named_struct('url','','acodec','mp4a'), named_struct('url','u','acodec','mp4a'))), (array(named_struct('url','u','acodec',cast(null as string)))), (null) AS t(f)")
    assert [r[0] for r in rows.select(T.has_audio_format(F.col("f"))).collect()] == [False, True, False, False]


@pytest.mark.parametrize("query, genre", [("Nursery SONG time", "music"), ("story of science", "stories/shows"), ("draw math", "art/crafts"), ("maths", "math"), ("trains", T.OTHER_GENRE)])
def test_kids_genre(spark, query, genre):
    assert one(spark, query, T.kids_genre) == genre


@pytest.mark.parametrize("raw, label", [("kids", "kids"), ("YOUTUBE_KIDS", "kids"), ("Normal_YouTube", "normal"), ("adults", None)])
def test_labels(spark, raw, label):
    assert one(spark, raw, T.normalize_label) == label


@pytest.mark.parametrize("t, text", [(0.0, "0:00:00.00"), (-3.0, "0:00:00.00"), (61.25, "0:01:01.25"), (3723.5, "1:02:03.50"), (59.996, "0:01:00.00")])
def test_caption_time(spark, t, text):
    assert one(spark, t, T.caption_time) == text


def test_caption_texts(spark):
    assert one(spark, "a\\{b}", T.caption_escape) == "a/(b)"
    r = spark.sql("SELECT 'w' w, 219.6D p, CAST(null AS double) q, 6.667D r").select(T.word_info_text(F.col("w"), F.col("p"), F.col("q"), F.col("r"))).first()[0]
    assert r == "“w”    pitch 220 Hz    pause after —    rate 6.7 syl/s"
    assert [one(spark, w, T.ends_sentence) for w in ("so.", 'so?"', "so!'\"", "so", ".so")] == [True, True, True, False, False]


@pytest.mark.parametrize("floor, ceiling, ok", [(75, 600, True), (20, 40, True), (19, 600, False), (75, 1201, False), (600, 600, False)])
def test_pitch_range(spark, floor, ceiling, ok):
    assert spark.range(1).select(T.pitch_range_ok(F.lit(floor), F.lit(ceiling))).first()[0] is ok


def test_rates_and_names(spark):
    r = spark.range(1).select(T.speech_rate(F.lit(2), T.clamp_duration(F.lit(0.6), F.lit(0.9))), T.clamp_duration(F.lit(1.0), F.lit(1.0)), T.duration_min(F.lit(450.0)), T.output_name(F.lit(7), F.lit("kids"), F.lit("k")), T.job_output_name(F.lit("a"), F.lit("normal"), F.lit("k")), T.utc_now()).first()
    assert math.isclose(r[0], 6.667) and r[1] == 1e-6 and r[2] == 7.5 and r[3] == "kids/video_0007_k.json" and r[4] == "normal/api_a_k.json" and r[5].endswith("+00:00")


def test_syllables_are_counted_without_their_texts(spark):
    """As many as syllabify's parts, whatever stands among the letters; and no text is made where none is asked for."""
    r = random.Random(3)
    made = ["".join(r.choice(a) for _ in range(r.randint(0, 9))) for a in ("aeiouyAEYbclstBLxz'\u00e9-9|#.\u017fK", "eElLstya'") for _ in range(5_000)]
    words = spark.createDataFrame([(w,) for w in [*made, None, "", "le", "make\n", "ma\nke", "x-e"]], "word string")
    assert words.filter(~T.count_syllables(F.col("word")).eqNullSafe(F.greatest(F.lit(1), F.size(T.syllabify(F.col("word")))))).count() == 0
    units = syllable_units(words.withColumns({"start_sec": F.lit(0.0), "end_sec": F.lit(1.0)}))
    times = units.select("syllable_index", "start_sec")
    assert "regexp_replace" not in times._jdf.queryExecution().optimizedPlan().toString() and times.count() == units.filter("syllable IS NOT NULL").count()


def test_numbers_shown_are_those_of_their_decimal_digits(spark):
    """The quick way gives what rounding by decimal digits gives, at halves and near them, at the ends and where nothing is a number."""
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -1.25, 0.05, 0.25, 0.35, 2.675, 1.005, 0.5, 1.5, 2.5, 999999.95, 1e6, 1e12, 1e-9, *(k / 1000 for k in range(0, 3000, 7)), *(k / 8 for k in range(400))]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for decimals in (0, 1, 2, 3):
        exact = F.when(F.col("x").isNull(), T.DASH).otherwise(F.format_string(f"%.{decimals}f u", F.bround("x", decimals)))
        assert rows.filter(~T.number_or_dash(F.col("x"), decimals, "u").eqNullSafe(exact)).count() == 0


def test_cuts_of_long_and_odd_words(spark):
    """Cuts found by looking back are those of the marks set one after the other, whatever the word's length and characters."""
    words = ["", "cake", "be", "TABLE", "b'e", "l'e", "re-e", "naïve", "aſe", "añe", "ab\x00e", "|a|be|", "a#e", "a\nbe\n", "strengths" * 200 + "e", "b" * 3000 + "abe", None, "Queue.", "12", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    word = F.col("word")
    letters = F.regexp_replace(word, "[^A-Za-z]", "")
    want = F.when(letters == "", F.array(word)).otherwise(F.split(T._marked(letters), "[|]"))
    assert rows.filter(~T.syllabify(word).eqNullSafe(want) | ~T.count_syllables(word).eqNullSafe(F.greatest(F.lit(1), F.size(want)))).count() == 0
