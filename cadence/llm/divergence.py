"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has a histogram of character classes and one of common words. A language's reference is the mean
histogram of its documents that pass the base rules, in shares of SHARES, so that a long document counts as much as a short one.
A document goes if the Jensen-Shannon distance of a histogram to its language's reference is above the bound: a distance of its own, and
what chance adds, which falls with the root of the histogram's size. Histograms of too few characters or words say nothing and aren't judged.

Base rules: a document fails with fewer than LEAST_WORDS words, or if more than REPEAT_PERCENT of its words stand
in three-word windows that the text holds twice or more.

Cases: null or empty text has no words and fails; a null language is a language of its own; a language without a
document that passes has no reference, and none of its documents needs one; rows that repeat are judged each for itself and
count each for itself in the reference; words of a language that isn't listed in COMMON_WORDS all count as other words; a table without
rows gives no rows; further columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hot

LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Characters and words from which on a histogram is judged, and the greatest distance that passes: MOST + CHANCE / sqrt(size).
LEAST_CHARS, MOST_CLASS_DISTANCE, CLASS_CHANCE = 200, 0.14, 1.5
LEAST_JUDGED_WORDS, MOST_WORD_DISTANCE, WORD_CHANCE = 100, 0.06, 2.5
SHARES = 10_000
#: References of so many languages are broadcast, with some 70 numbers each; more are joined by exchange.
MOST_BROADCAST = 2_000

#: Character classes, each taken from what the ones before leave; what is left at the end is the last class.
CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'()\x22-]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
SYMBOLS = 5
#: Function words of English, German, French and Spanish: fixed values, counted as they stand and with a capital first letter.
COMMON_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "at", "this", "from",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "ist", "im", "nicht", "dem", "ein", "eine",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "est", "pour", "par", "dans", "avec",
    "el", "y", "los", "las", "se", "del", "por", "con", "no", "una", "su", "para", "es", "al",
)
WORDS = r"[^\x20\x09-\x0D]+"


def _codes() -> dict[str, str]:
    """A character for each common word."""
    return {w: chr(48 + i) for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}


def repeated_words(words: Column) -> tuple[Column, ...]:
    """Steps by which n_repeat_words comes from the column ``words``: each is a column that the next one reads by its name."""
    w, n = F.col("words"), F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("p")))
    none = F.expr("cast(array() as array<struct<w:string,p:int>>)")
    same = lambda x, i: F.coalesce(x["w"] == F.get(F.col("windows"), i)["w"], F.lit(False))
    twice = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["p"]))
    new = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(3))))
    return F.sort_array(F.when(n >= 3, windows).otherwise(none)), places, F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)


def histograms(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, classes, commons."""
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("language"), F.coalesce("text", F.lit("")).alias("left0"))
    d = d.withColumn("words", F.regexp_extract_all("left0", F.lit(WORDS), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("left0", "\n"), lambda x: x.rlike(WORDS)))
    for i, kind in enumerate(CLASSES):
        d = d.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", kind, "")).withColumn(f"size{i}", F.char_length(f"left{i}"))
    last = len(CLASSES)
    d = d.withColumn(f"size{last}", F.char_length(f"left{last}"))
    windows, places, n_repeat = repeated_words(F.col("words"))
    codes = _codes()
    table = F.create_map(*(F.lit(x) for w, c in codes.items() for form in dict.fromkeys((w, w.capitalize())) for x in (form, c)))
    d = (
        d.withColumn("windows", windows).withColumn("places", places).withColumn("n_repeat_words", n_repeat)
        .withColumn("code", F.array_join(F.filter(F.transform("words", lambda w: F.element_at(table, w)), lambda c: c.isNotNull()), ""))
    )
    counts = F.transform(F.array(*map(F.lit, codes.values())), lambda c: F.char_length("code") - F.char_length(F.replace(F.col("code"), c, F.lit(""))))
    n_words = F.size("words").cast("long")
    d = d.select(
        "doc_id", "language", n_words.alias("n_words"), (F.col("size0") - (F.col("size1") - F.col("size2"))).cast("long").alias("word_chars"),
        (F.col(f"size{SYMBOLS}") - F.col(f"size{SYMBOLS + 1}")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.array(*(F.col(f"size{i}") - F.col(f"size{i + 1}") for i in range(last)), F.col(f"size{last}")).alias("classes"),
        F.concat(counts, F.array(F.size("words") - F.char_length("code"))).alias("commons"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def references(made: DataFrame) -> DataFrame:
    """language -> class_reference, common_reference: sums of the documents' shares, in whole numbers and so the same in any order."""

    def sums(name: str, size: int, total: Column) -> Column:
        share = lambda i: F.floor(SHARES * F.col(name)[i].cast("long") / total).cast("long")
        return F.array(*(F.sum(share(i)) for i in range(size)))

    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    passed = made.filter(~F.col("base_failed")).withColumn("chars", chars)
    return passed.groupBy("language").agg(
        sums("classes", len(CLASSES) + 1, F.col("chars")).alias("class_reference"), sums("commons", len(_codes()) + 1, F.col("n_words")).alias("common_reference")
    )


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts, 0 to 1 in base 2; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, c: a + c)

    def term(p: Column, q: Column) -> Column:
        middle = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
        return half(p) + half(q)

    n, m = total(own), total(reference)
    shares = F.zip_with(F.transform(own, lambda c: c / n), F.transform(reference, lambda c: c / m), term)
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.lit(0.0), total(shares) / 2)))


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, the base statistics, base_failed, class_distance, word_distance (null where not judged), kept."""
    made = histograms(docs).checkpoint()
    known = references(made).checkpoint()
    their = known.withColumnRenamed("language", "its_language")
    if known.count() <= MOST_BROADCAST:
        both = made.join(F.broadcast(their), F.col("language") == F.col("its_language"), "left")
    else:
        both = hot.join_dealt(made, known, "language", hot.counted(made, "language"), made.count(), F.struct("doc_id", "n_words", "word_chars"), "left")
    both = both.withColumn("chars", F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x))
    for name in ("classes", "commons", "class_reference", "common_reference"):
        both = both.withColumn(name, F.col(name).cast("array<double>"))
    both = both.withColumn("class_distance", F.when(~F.col("base_failed") & (F.col("chars") >= LEAST_CHARS), distance(F.col("classes"), F.col("class_reference"))))
    both = both.withColumn("word_distance", F.when(~F.col("base_failed") & (F.col("n_words") >= LEAST_JUDGED_WORDS), distance(F.col("commons"), F.col("common_reference"))))
    bound = lambda most, chance, size: F.lit(most) + F.lit(chance) / F.sqrt(F.col(size))
    far = F.coalesce(F.col("class_distance") > bound(MOST_CLASS_DISTANCE, CLASS_CHANCE, "chars"), F.lit(False))
    far |= F.coalesce(F.col("word_distance") > bound(MOST_WORD_DISTANCE, WORD_CHANCE, "n_words"), F.lit(False))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"), (~F.col("base_failed") & ~far).alias("kept"),
    )


def _sql() -> str:
    last = len(CLASSES)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lefts = "".join(f", l{i + 1} AS (SELECT *, regexp_replace(left{i}, {quoted(kind)}, '', 'g') AS left{i + 1} FROM l{i})" for i, kind in enumerate(CLASSES))
    classes = ", ".join([f"length(left{i}) - length(left{i + 1})" for i in range(last)] + [f"length(left{last})"])
    codes = _codes()
    forms = ", ".join(f"({quoted(form)}, {i})" for i, x in enumerate(codes) for form in dict.fromkeys((x, x.capitalize())))
    share = lambda name, size, total: ", ".join(f"CAST(sum({SHARES} * {name}[{i}] // {total}) AS BIGINT)" for i in range(1, size + 1))

    def distance_sql(own: str, reference: str) -> str:
        pairs = f"list_zip(list_transform({own}, lambda c: c::DOUBLE / list_sum({own})), list_transform({reference}, lambda c: c::DOUBLE / list_sum({reference})))"
        half = lambda x: f"CASE WHEN z[{x}] > 0 THEN z[{x}] * log2(z[{x}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
        return f"sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: {half(1)} + {half(2)})) / 2))"

    return rf"""
WITH l0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS language, coalesce(text, '') AS left0,
  regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM documents)
{lefts}
, w AS (SELECT r, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM l0),
w2 AS (SELECT r, p, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY r ORDER BY p)),
w3 AS (SELECT r, p, count(*) OVER (PARTITION BY r, word, second, third) AS times FROM w2 WHERE third IS NOT NULL),
listed AS (SELECT r, histogram(i) AS times FROM (SELECT r, unnest(words) AS word FROM l0) t JOIN (VALUES {forms}) v(word, i) USING (word) GROUP BY r),
covered AS (SELECT r, CAST(sum(least(3, coalesce(later - p, 3))) AS BIGINT) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS later FROM w3 WHERE times > 1) x GROUP BY r),
m0 AS (SELECT doc_id, language, CAST(len(words) AS BIGINT) AS n_words, length(left0) - (length(left1) - length(left2)) AS word_chars,
  length(left{SYMBOLS}) - length(left{SYMBOLS + 1}) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  [{classes}] AS classes, [CAST(coalesce(times[x], 0) AS BIGINT) FOR x IN range({len(codes)})] AS own FROM l{last} LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)),
m1 AS (SELECT *, list_append(own, n_words - CAST(list_sum(own) AS BIGINT)) AS commons, CAST(list_sum(classes) AS BIGINT) AS chars,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m0),
known AS (SELECT language, [{share('classes', last + 1, 'chars')}] AS class_reference, [{share('commons', len(codes) + 1, 'n_words')}] AS common_reference
  FROM m1 WHERE NOT base_failed GROUP BY language),
far AS (SELECT m1.*, CASE WHEN NOT base_failed AND chars >= {LEAST_CHARS} THEN {distance_sql('classes', 'class_reference')} END AS class_distance,
  CASE WHEN NOT base_failed AND n_words >= {LEAST_JUDGED_WORDS} THEN {distance_sql('commons', 'common_reference')} END AS word_distance FROM m1 LEFT JOIN known USING (language))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND NOT coalesce(class_distance > {MOST_CLASS_DISTANCE!r}::DOUBLE + {CLASS_CHANCE!r}::DOUBLE / sqrt(chars), false)
  AND NOT coalesce(word_distance > {MOST_WORD_DISTANCE!r}::DOUBLE + {WORD_CHANCE!r}::DOUBLE / sqrt(n_words), false) AS kept FROM far
"""


ORACLE_SQL = _sql()
