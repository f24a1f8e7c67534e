"""Invariants of spans, redaction, restoration, streams and packages."""

from __future__ import annotations

import random
import re

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from duskveil.functions import spans, text as tx
from duskveil.operators import detect, measure, names, nearmiss, substitute as su
from duskveil.sources import docx
from duskveil.streaming import sessions

WRAPPERS = ["{}", '"{}"', "'{}'", "“{}”", "«{}»", "({})", "[{}]", "{},", ": {}", "- {}", "/{}/", " {} ", "\t{}", "\n{}\n", "  {}  ", "{}…", "• {}", "1. {}", "*{}*", "😀 {}"]


def hits_of(spark, rows, detectors=detect.NEUTRAL):
    df = spark.createDataFrame(rows, "id int, text string")
    return df.select("id", "text", detect.hits(F.col("text"), detectors).alias("h")).collect()


def test_shapes(spark):
    """A value is found in every typographic surrounding, at its place in code points."""
    found = hits_of(spark, [(i, w.format("dana@example.com")) for i, w in enumerate(WRAPPERS)])
    for r in found:
        assert [(h.s, h.e) for h in r.h if h.type == "EMAIL"] == [(r.text.index("dana@"), r.text.index("dana@") + 16)], r.text


def test_empty_cases(spark):
    rows = [(1, None), (2, ""), (3, "a@b.cc"), (4, "a@b.cc a@b.cc"), (5, "\U0001f600 a@b.cc"), (6, " a@b.cc")]
    got = {r.id: [(h.s, h.e) for h in r.h] for r in hits_of(spark, rows)}
    assert got == {1: [], 2: [], 3: [(0, 6)], 4: [(0, 6), (7, 13)], 5: [(2, 8)], 6: [(2, 8)]}


def test_failed_checksum_is_kept_for_review(spark):
    (r,) = hits_of(spark, [(1, "card 4111-1111-1111-1112 end")])
    assert [(h.type, h.ok) for h in r.h] == [("CREDIT_CARD", False)]


def test_matches_equal_finditer(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1 .\n😀") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for rx in (r"[0-9]+", r"a+b?", r"(?<=a)b", r"\."):
        got = {r.id: [(x.s, x.e, x.t) for x in r.m] for r in df.select("id", spans.matches(F.col("text"), rx).alias("m")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(rx, t)] for i, t in enumerate(texts)}


def test_resolved_hits_are_apart(spark):
    rng = random.Random(2)
    rows = [(d, s, s + rng.randrange(1, 12), rng.randrange(2), rng.randrange(4)) for d in range(40) for s in [rng.randrange(60) for _ in range(15)]]
    df = spark.createDataFrame(rows, "d int, s int, e int, rk int, prio int")
    hit = F.struct("s", "rk", "prio", (F.col("s") - F.col("e")).alias("neg"), "e")
    for r in df.groupBy("d").agg(F.collect_list(hit).alias("h")).select("d", spans.resolve(F.col("h")).alias("k")).collect():
        want, last = [], -1
        for x in sorted((s, rk, p, s - e, e) for d, s, e, rk, p in rows if d == r.d):
            if x[0] >= last:
                want.append(x)
                last = x[4]
        assert [tuple(k) for k in r.k] == want


def test_norm_keeps_length(spark):
    rows = [("רוֹנית־א׳ “x”‏",), ("plain",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    assert all(len(r.t) == len(r.n) for r in df.select("t", tx.norm(F.col("t")).alias("n")).collect())


def test_same_value_same_substitute(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "a"])], "id int, v array<string>")
    pairs = df.select(su.fake_names(F.col("v"), ["P", "Q", "R", "S"], F.array(F.lit("Q"))).alias("p")).first().p
    assert [p.real for p in pairs] == ["b", "a", "c"] and len({p.fake for p in pairs}) == 3 and "Q" not in {p.fake for p in pairs}


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    forms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(150)})
    targets = forms[::5]
    one = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    got = {(r.form, r.target) for r in nearmiss.near_pairs(one(forms, "form"), one(targets, "target")).collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == {(f, t) for f in forms for t in targets if len(t) >= 4 and f != t and near(f, t)}


def test_generator_and_interval(spark):
    assert [round(x, 9) for x in measure.mulberry(1, 3)] == [round(x, 9) for x in measure.mulberry(1, 3)]
    units = spark.createDataFrame([(str(i), float(i % 3), 0.0) for i in range(60)], "unit string, a double, b double")
    r = measure.bootstrap(units, 800).first()
    assert r.low < r.mean < r.high and abs(r.mean - 1.0) < 1e-9


def test_packages_survive_damage(spark):
    rows = [(1, bytearray(docx.text_to_docx("a\n\tb & <c>\n"))), (2, bytearray(b"zip?")), (3, None)]
    got = docx.read_blocks(spark.createDataFrame(rows, "id int, content binary")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.block_ix) if r.id == 1] == ["a", "b & <c>", ""]
    assert [r.error is not None for r in got if r.id == 2] == [True] and not [r for r in got if r.id == 3]


def test_bookmarks_and_comments():
    w = f'xmlns:w="{docx.W}"'
    root = docx.ET.fromstring(f'<w:d {w}><w:bookmarkStart w:name="פרק"/><w:hyperlink w:anchor="פרק"/><w:commentRangeStart/><w:r><w:commentReference/></w:r><w:r><w:t>x</w:t></w:r></w:d>')
    assert docx.rename_bookmarks(root) == {"פרק": "_pib1"}
    docx.strip_comments(root)
    assert "פרק" not in docx.ET.tostring(root, "unicode") and [docx._tag(e) for e in root] == ["bookmarkStart", "hyperlink", "r"]


@pytest.mark.parametrize("text", ["", "One. Two. Three.", "x" * 2000, "A sentence. " * 200, "word " * 400])
def test_chunks_cover(text):
    out = names.chunk_spans(text)
    assert all(0 < e - s <= 800 for s, e in out) and (not text or (out[0][0] == 0 and out[-1][1] == len(text)))
    assert all(b[0] <= a[1] for a, b in zip(out, out[1:]))


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = sessions.redact_stream(stream).writeStream.format("memory").queryName("redacted").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.table("redacted")) == rows(sessions.redact_stream(docs))


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = sessions.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 200 and df.where("leaks > 0").count() == 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
