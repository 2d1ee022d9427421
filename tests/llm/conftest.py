"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text) or (doc_id, text, source). extra: names of further columns."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        d = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            d = d.selectExpr("*", f"'x' AS `{name}`")
        return d

    return make


CLASHES = ("chunk", "score", "size", "target", "copies", "part", "n", "band", "node", "row", "gone", "media", "id", "statistic_n_words", "length", "shard", "kept", "removed", "statistic", "block", "v", "rank")
ODD = [None, "", " \t\n\x0b\f\r ", "one", "a b", "á b c d", "😀 " * 30, "x" * 5000, "\n\n\n", "w " * 3000]


@pytest.fixture(scope="session")
def odd(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (3, "one"), (None, "no id here"), (None, None)]
    return docs_of([(*r, None if i % 3 == 0 else f"s{i % 3}") for i, r in enumerate(rows)], CLASHES)
