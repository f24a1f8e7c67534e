"""The near-duplicates of the pipeline: what a reviewer found in round 2, in a few rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from duskveil.llm import common, langid, linkage, simhash


@pytest.fixture
def shuffled(spark):
    """No join by broadcast unless the code asks for one, as on large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_of_exchanges(df, *columns):
    """After df has run: the rows that each of its exchanges of these columns has written."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
        if kind == "ShuffleExchangeExec":
            names = {node.output().apply(i).name() for i in range(node.output().size())}
            if set(columns) <= names:
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return found


def test_fingerprints_find_pairs(spark, monkeypatch):
    """near copies are found by their fingerprints' sign bits alone where there are no min-wise segments; pairs of near
    fingerprints and other shingle sets are not linked, nor are texts without words."""
    monkeypatch.setattr(simhash, "SEGMENTS", 0)
    words = [f"w{j}" for j in range(900)]
    loop = [f"v{j}" for j in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join(words + [f"e{j}" for j in range(12)])), (2, " ".join([f"h{j}" for j in range(5)] + words)), (3, " ".join(f"u{j}" for j in range(900))), (4, None), (5, " \n")]
    rows += [(6, " ".join(loop * 40)), (7, " ".join(loop * 40 + [f"x{j}" for j in range(20)]))]  # alike but for their sets
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.signatures(df).collect()}
    assert fps == {i: simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 5)) for i, t in rows}
    assert all(1 <= (fps[a] ^ fps[b]).bit_count() <= 4 for a, b in ((0, 1), (0, 2), (6, 7)))
    got = {r.doc_id: r.component_id for r in simhash.near_classes(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_sign_links_connect_what_brute_force_does(spark, monkeypatch):
    """classes of equal fingerprints and of fingerprints at 4 bits or fewer are connected, with hot keys or without."""
    rng = random.Random(5)
    fps = [rng.getrandbits(63) for _ in range(5)]
    fps += [fps[i % 5] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(8))) for i in range(120)]
    classes = [(100 + i, x) for i, x in enumerate(fps)] + [(1000 + i, fps[0]) for i in range(30)] + [(2000 + i, fps[i]) for i in range(20)]
    roots = {i: i for i, _ in classes}
    for _ in range(len(classes)):
        before = dict(roots)
        for i, x in classes:
            roots[i] = min(roots[j] for j, y in classes if (x ^ y).bit_count() <= 4)
        if roots == before:
            break
    table = common.stored(spark.createDataFrame(classes, "id long, fp long"), "classes")
    for hot in (1 << 16, 10):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = {r.id: r.root for r in linkage.components(simhash.sign_links(table)).collect()}
        assert {i: got.get(i, i) for i in roots} == roots
    assert simhash.sign_links(table.limit(0)).count() == 0


def test_only_rows_that_may_go_are_shuffled(shuffled):
    """Of 400 texts of which four go, the join that drops them shuffles some rows and not all texts."""
    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400 + i, texts[i]) for i in range(3)] + [(7, texts[7]), (None, texts[9]), (None, None)]
    kept = simhash.deduplicated(shuffled.createDataFrame(rows, "doc_id long, text string").repartition(3))
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [*range(400), None, None]
    whole = rows_of_exchanges(kept, "row")
    assert whole and sum(whole) < 40


def test_only_texts_in_question_are_shuffled(shuffled, monkeypatch):
    """The texts whose whole shingle sets are compared are fetched without a shuffle of all texts."""
    words = [f"w{j}" for j in range(300)]
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(30))) for i in range(400)] + [(400, " ".join(words)), (401, " ".join([*words[:150], "x", *words[151:]])), (None, " ".join([*words, "end"])), (None, None)]
    seen, sets = [], simhash._sets
    monkeypatch.setattr(simhash, "_sets", lambda texts, k: seen.append(texts) or sets(texts, k))
    got = {r.doc_id: r.component_id for r in simhash.near_classes(shuffled.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect()}
    assert got == {i: min(i, 400) for i in range(402)}
    assert sorted(len(r.text.split()) for r in seen[0].collect()) == [300, 300, 301]
    assert sum(rows_of_exchanges(seen[0], "text")) < 40


def test_sieve_loses_no_key(spark, monkeypatch):
    """Rows whose key is held are all met, whatever the number of bits, nulls among them; the rest holds none of the keys."""
    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) as a", "id % 7 as b", "id as bits", "id as word")
    keys = rows.where("bits % 100 < 3").select("a", "b")
    for bits in (1 << 25, 64, 1):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        met, rest = common.sieved(rows, keys, ["a", "b"])
        assert met.columns == rows.columns and met.count() + rest.count() == 3000
        assert met.where("bits % 100 < 3").count() == 90 and rest.where("bits % 100 < 3").count() == 0
    met, rest = common.sieved(rows, keys.limit(0), ["a", "b"])
    assert met.isEmpty() and rest.count() == 3000


def test_training_sample_travels_small():
    """The counts of the driver's sample are compressed on their way and the model learns from the same numbers."""
    for text in (b"", b"a", b"the quick brown fox " * 4000, "日本語 naïve".encode()):
        counts = langid.counts_of(text)
        at, n = langid._unpacked(langid._packed(counts))
        assert (np.frombuffer(at, "<u2") == np.flatnonzero(counts)).all() and (np.frombuffer(n, "<f4") == counts[counts > 0]).all()
    prose = " ".join(f"word{i % 997} and thing{i % 13}" for i in range(400)).encode()
    assert 2 * len(langid._packed(langid.counts_of(prose))) < 6 * np.count_nonzero(langid.counts_of(prose))
