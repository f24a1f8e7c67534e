from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from duskveil.llm import ann, langid, maxent, mixing, registry

SF = "/root/testdata/sf0.01"


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:160] = x[7]  # copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] + [1.0] * 31), (9003, [None] + [1.0] * 31), (9004, [1.0]), (9005, [])]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).cache()
    assert v.count() == 3000
    got = ann.neighbours(v, v.where("vec_id % 20 = 0"), 20).toPandas()
    y, hit, n = x.astype(float), 0, 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        s = y @ y[q]
        s[q] = -np.inf
        best = np.sort(s)[::-1][19]
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [y[i] @ y[q] for i in g.vec_id], rtol=0, atol=1e-12)
        hit += (g.score >= best - 1e-9).sum()
        n += 20
        if q in range(100, 160):
            assert list(g.vec_id) == [i for i in [7, *range(100, 160)] if i != q][:20]
    assert hit / n >= 0.9
    few = ann.neighbours(v.where("vec_id < 5"), v.where("vec_id < 5"), 20)
    assert few.count() == 20
    assert ann.neighbours(v.where("vec_id < 0"), v.where("vec_id < 0")).count() == 0


def test_ann_query_recall(spark):
    got = registry.ann_search(spark, SF).toPandas()
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding).astype(float)
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += (g.score >= np.sort(s)[::-1][19] - 1e-9).sum()
    assert hit / len(got) >= 0.9


def test_language_model(spark, docs, none):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in maxent.language_model_scores(df).collect()}
    words = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in df.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)  # both negative: at least three hundredths better
    some = maxent.language_model_scores(docs.select("doc_id", "text"))
    assert some.count() == docs.count() and all(math.isfinite(r.score) and r.score <= 0 for r in some.collect())
    assert maxent.language_model_scores(none).count() == 0


def test_model_is_normalised(spark):
    df = spark.createDataFrame([(i, "a b c d e f g a a b x%d y%d" % (i, i % 3)) for i in range(40)], "doc_id long, text string")
    counts = maxent.word_counts(df).cache()
    m = maxent.train(df, counts)
    assert m.n == counts.agg({"n": "sum"}).first()[0] and m.leaf_n.sum() == m.n and m.leaf_v.sum() == m.v
    word, leaf = maxent.tokens_of(b"a b c")
    rows, slots = maxent.features_of(m.leaves(word, leaf), np.array([0]))
    p = maxent._softmax(maxent.logits(m.weights, rows) + m.bias)
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    for c in range(maxent.CLASSES):
        q = maxent._softmax(maxent.logits(m.slot_weights, slots) + m.slot_bias[c])
        assert np.allclose(q.sum(1), 1, atol=1e-5)
    known = {r.word: r.n for r in counts.collect()}
    own = m.leaves(np.array(list(known), np.int64).view(np.uint64), np.array([r.leaf for r in counts.collect()]))
    for k in range(maxent.LEAVES):
        total = sum((n + 1) / (m.leaf_n[k] + m.leaf_v[k] + 1) for n, c in zip(known.values(), own) if c == k) + 1 / (m.leaf_n[k] + m.leaf_v[k] + 1)
        assert abs(total - 1) < 1e-9


def test_score_against_brute_force(spark, docs):
    """The score from the model's own weights, token by token, in plain Python."""
    df = docs.select("doc_id", "text")
    learn = df.where(~maxent.held_out(df["doc_id"]))
    counts = maxent.word_counts(learn).cache()
    m = maxent.train(learn, counts)
    n = {r.word & (1 << 64) - 1: r.n for r in counts.collect()}
    top = dict(zip(m.own.tolist(), m.own_leaf.tolist()))
    got = Counter((r.doc_id, round(r.score, 3)) for r in maxent.scored(df, m, counts).collect())

    def log_softmax(z, k):
        z = [float(x) for x in z]
        return z[k] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))

    want = Counter()
    for r in docs.collect():
        score, one, two = 0.0, 0, 0
        word, leaf = maxent.tokens_of((r.text or "").encode())
        for w, by_ending in zip(word.tolist(), leaf.tolist()):
            k = top.get(w, by_ending)
            c, s = k % maxent.CLASSES, k // maxent.CLASSES
            both = 2 * maxent.LEAVES + ((one * 0x9E3779B1 + two * 0x85EBCA6B) >> 7) % maxent.BUCKETS
            z = m.weights[one] + m.weights[maxent.LEAVES + two] + m.weights[both] + m.bias
            y = m.slot_weights[one * maxent.CLASSES + c] + m.slot_weights[maxent.SLOT_BUCKETS + two * maxent.CLASSES + c] + m.slot_bias[c]
            score += (log_softmax(z, c) + log_softmax(y, s)) / math.log(10) + math.log10((n.get(w, 0) + 1) / (m.leaf_n[k] + m.leaf_v[k] + 1))
            one, two = k, one
        want[(r.doc_id, round(score, 3))] += 1
    near = lambda a, b: all(any(i == j and abs(x - y) < 1e-3 * max(1, abs(y)) for j, y in b) for i, x in a)
    assert sum(got.values()) == sum(want.values()) and near(got, want) and near(want, got)


def test_language_id(spark, docs, none):
    got = registry.language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in got if r.held_out]
    assert len(got) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in out) > 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs)
    pred = {r.doc_id: r.lang_pred for r in langid.predicted(docs, model).collect()}
    assert pred[2] == pred[3] == pred[4] == pred[11] == "und" and pred[8] in model.langs
    assert langid.accepted(docs, model).columns == docs.columns
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predicted(docs, empty).collect()} == {"und"} and langid.accepted(none, empty).count() == 0


def test_stretches_add_up():
    text = bytes(np.random.default_rng(0).integers(97, 123, 3 * langid.STRETCH // 2, dtype=np.uint8))
    whole, langid.STRETCH = langid.counts_of(text), 1 << 30
    try:
        assert np.array_equal(whole, langid.counts_of(text))
    finally:
        langid.STRETCH = 1 << 18


def test_samples_are_bounded(spark):
    """One id on most rows, and null ids; the sample stays near its bound, and a label of few rows is learned."""
    rows = [(1, "the same row again", "en")] * 3000 + [(1, f"text {i} of one id", "en") for i in range(3000)] + [(None, f"nameless {i}", "de") for i in range(3000)] + [(9, "ein paar", "nl")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = Counter(r.lang for r in langid._sample(df, df["lang"], 600).collect())
    assert got["nl"] == 1 and 20 < got["en"] < 300 and 100 < got["de"] < 300
    many = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert langid.train(many, most=300, epochs=1).langs == sorted(f"l{i}" for i in range(300))
    with pytest.raises(ValueError):
        langid.train(many, most=299)
    labels = spark.createDataFrame([(1, None, 1), (9, 1, None), (5, None, None)], "doc_id long, quality int, toxic int")
    model = mixing.train(df, labels)  # of id 1 one row; toxic without a quality counts
    assert model.posterior(b"ein paar")[0].argmax() == 1 and 2 in (model.posterior(t)[0].argmax() for t in (b"the same row again", b"text 5 of one id"))


def test_rates_against_brute_force(spark, docs):
    """The fitted rates minimise the stated sum: its gradient, from all rows in numpy, vanishes or pushes against zero."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    members = mixing.memberships(d, mixing.train(d, spark.read.parquet(f"{SF}/labels.parquet"))).cache()
    rows = mixing.with_rates(members, mixing.fit(members)).toPandas()
    rows = rows[rows.n_tokens > 0]
    p, n, r = rows[[f"p_{x}" for x in mixing.DOMAINS]].to_numpy(), rows.n_tokens.to_numpy(float), rows.rate.to_numpy()
    want = np.array([mixing.TARGETS[x] for x in mixing.DOMAINS])
    y, last = np.ones(len(n)), np.ones(len(n))
    for t in range(20_000):  # plain projected gradient to the end
        new = np.maximum(0, y - 0.9 / (1 + mixing.PULL) * (p @ ((y * n) @ p / n.sum() - want) + mixing.PULL * (y - 1)))
        y, last = new + t / (t + 3) * (new - last), new
        if t > 50 and np.abs(p @ ((last * n) @ p / n.sum() - want) + mixing.PULL * (last - 1))[last > 1e-9].max() < 1e-6:
            break
    cost = lambda r: 0.5 * ((((r * n) @ p / n.sum()) - want) ** 2).sum() + mixing.PULL / 2 * (n / n.sum() * (r - 1) ** 2).sum()
    assert cost(r) < cost(last) + 1e-4 and abs((r * n).sum() - (last * n).sum()) < 0.02 * n.sum()
    null = [x.copies for x in mixing.with_rates(mixing.memberships(spark.createDataFrame([(None, f"t {i}") for i in range(400)], "doc_id long, text string"), mixing.Classifier(np.zeros((mixing.BUCKETS, 3), np.float32), np.zeros(3, np.float32))), mixing.Rates(np.full((1, 3), 0.5), 1.0, 0.0)).collect()]
    assert 100 < sum(null) < 300  # a rate of one half; each text draws for itself


def test_mixing_meets_targets(spark, docs, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = mixing.train(d.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    members = mixing.memberships(d, model).cache()
    for targets in (mixing.TARGETS, {"low": 0.3, "good": 0.6, "toxic": 0.1}):
        rates = mixing.fit(members, targets)
        rows = mixing.with_rates(members, rates).toPandas()
        for name in mixing.DOMAINS:
            share = (rows.rate * rows.n_tokens * rows[f"p_{name}"]).sum() / rows.n_tokens.sum()
            assert abs(share - targets[name]) < 0.03
        assert (rows.rate >= 0).all()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    rates = mixing.fit(members)
    out = mixing.mixed(d, model, rates)
    assert out.columns == d.columns
    left = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(toxic & set(left)) < 0.2 * len(toxic)
    rows = mixing.with_rates(members, rates).collect()
    assert Counter(left) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    flat = mixing.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert mixing.mixed(docs, flat, mixing.fit(mixing.memberships(docs, flat), {"good": 1.0})).count() >= docs.where("doc_id is not null").count() - 3
    assert mixing.mixed(none, flat, mixing.fit(mixing.memberships(none, flat))).count() == 0
