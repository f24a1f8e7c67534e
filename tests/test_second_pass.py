"""Venues, gazetteer names and the second pass on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskveil.functions import spans
from duskveil.operators import names as nm
from duskveil.operators import review as rv
from duskveil.operators import substitute as su


def test_venues(spark):
    """Names lose their dropped tail, public bodies and bare heads are none, spans give the name back."""
    rows = [(1, "at Hotel Carmel Today, near School Tavor"), (2, "Bank Israel and Bank Today"), (3, ""), (4, None), (5, "xHotel Carmel Hotel")]
    df = spark.createDataFrame(rows, "id int, text string")
    found = nm.venues(F.col("text"), {"stay": "Hotel", "other": "School|Bank"}, r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?", ["Today"], "^Bank Israel")
    got = df.select("id", "text", F.inline(found)).collect()
    assert sorted((r.id, r.t, r.kind) for r in got) == [(1, "Carmel", "stay"), (1, "Tavor", "other")]
    assert all(r.text[r.s : r.e] == r.t for r in got)


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "in Old Town and Ministry of Old Town"), (2, "Town Old Town"), (3, None)], "doc_id int, text string")
    names = spark.createDataFrame([("Old Town", False), ("Town", False)], "name string, ambiguous boolean")
    found = nm.gazetteer(spans.token_rows(docs, "text", "[A-Za-z]+", ["doc_id"]), names, ["doc_id"], "^Ministry of")
    assert sorted((r.doc_id, r.s, r.e, r.name, r.review) for r in found.collect()) == [(1, 3, 11, "Old Town", False), (2, 5, 13, "Old Town", False)]


def test_swept_values(spark):
    """Short values, values inside their own substitute and rows without one are left out; of two substitutes one stays."""
    rows = [(1, "Dana Levi", "Noa Bar"), (1, " Dana Levi ", "Adi Bar"), (1, "Ron", "Tal"), (1, "Mira", "Mira B"), (2, "Dana Levi", None), (2, None, "X")]
    got = rv.swept_values(spark.createDataFrame(rows, "doc int, value string, rep string"), ["doc"]).collect()
    assert [tuple(r) for r in got] == [(1, "Dana Levi", "Adi Bar")]


def test_protected(spark):
    df = spark.createDataFrame([("AB [NAME 1] CD",), ("",), (None,)], "t string")
    kept = rv.protected(spans.matches(F.col("t"), "[A-Z]+"), spans.matches(F.col("t"), r"\[[A-Z]+ \d+\]"))
    assert [[h.t for h in r[0]] for r in df.select(kept).collect()] == [["AB", "CD"], [], []]


def test_ambiguity(spark):
    """Two values behind one substitute, or a substitute that the source holds; the same value twice is no ambiguity."""
    pairs = "array(named_struct('value', 'Dana', 'rep', 'Noa'), named_struct('value', 'Dana', 'rep', 'Noa'), named_struct('value', 'Ron', 'rep', 'Tal'), named_struct('value', 'Gil', 'rep', 'Tal'), named_struct('value', 'Lea', 'rep', 'Adi'))"
    df = spark.range(1).selectExpr("'Dana, Ron, Gil, Lea and Adi' AS text", f"{pairs} AS pairs")
    got = df.select(F.inline(su.ambiguity(F.col("text"), F.col("pairs")))).collect()
    assert [tuple(r) for r in got] == [("Noa", 1, False, False), ("Tal", 2, False, True), ("Adi", 1, True, True)]
