"""Probes of the vector index: recall on vectors that the fitting never saw, and lists of few entries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from duskveil.llm import ann


def table(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "v": pa.array(x.astype(np.float64).tolist())}))


def test_recall_on_unseen_vectors(spark, monkeypatch):
    """Two fitted vectors to a list, as where the number of lists is at its most."""
    monkeypatch.setattr(ann, "FIT", 1024)
    monkeypatch.setattr(ann, "PER_LIST", 40)
    x = np.random.default_rng(3).normal(size=(20_480, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(table(spark, x), len(x), 1024)
    q = x[:300]
    inner = q @ x.T
    inner[np.arange(300), np.arange(300)] = -np.inf
    true = np.argsort(-inner, axis=1)[:, :20]
    place = np.argsort(np.argsort(-(q @ index.coarse.T), axis=1), axis=1)
    assert len(index.coarse) == 512
    assert (place[np.arange(300)[:, None], index.lists(x)[true]] < index.probes).mean() > 0.94


def test_few_entries_widen(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_LIST", 20)
    x = np.random.default_rng(4).normal(size=(1000, 8))
    df = table(spark, x)
    got = ann.neighbours(df, df.selectExpr("vec_id AS query_id", "v"), 20, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 1000 and all(r["count"] == 20 for r in got)


def test_small_groups_get_all_they_can(spark):
    """Three tight groups of 600, 590 and 10 vectors: the lists of the smallest hold fewer than are asked for."""
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.01 * rng.normal(size=(n, 16)) for c, n in ((rng.normal(size=16), 600), (rng.normal(size=16), 590), (rng.normal(size=16), 10))])
    df = table(spark, x)
    got = ann.neighbours(df, df.where("vec_id % 20 = 0 OR vec_id >= 1190").selectExpr("vec_id AS query_id", "v"), 20).toPandas()
    assert set(got.groupby("query_id").size()) == {20} and got.query_id.nunique() == 70
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += (g.score >= np.sort(s)[::-1][19] - 1e-9).sum()
    assert hit / len(got) >= 0.9
    assert ann.neighbours(df.limit(12), df.limit(12).selectExpr("vec_id AS query_id", "v"), 20).count() == 12 * 11


def test_cells_hold_lists_whole_or_cut():
    held = np.array([3000, 2000, 9000, 0, 100, 4096, 50])
    cell, cells = ann.layout(np.random.default_rng(1).normal(size=(7, 4)), held)
    load = np.zeros(cell.max() + cells.max() + 1, np.int64)
    for c, m, n in zip(cell, cells, held):
        load[c : c + m] += -(-n // m)
    assert cells.tolist() == [1, 1, 3, 1, 1, 1, 1] and load.max() <= ann.BLOCK
