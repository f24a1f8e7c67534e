"""Mixing sources to target weights with soft memberships.

A classifier learned from the labelled table tells for every document the posterior probability of each domain. Domains
are the labels' classes: ``low`` (quality 0), ``good`` (quality 1), ``toxic`` (toxic 1). With n_i tokens, posteriors
p_id and a rate r_i >= 0, the expected tokens of domain d are sum_i r_i n_i p_id. Projected gradient descent with momentum fits the
rates by least squares to the target totals, with a pull towards rate 1 that makes the answer unique:

    minimise  1/2 sum_d (sum_i r_i n_i p_id / N - T_d)^2 + pull/2 sum_i n_i / N (r_i - 1)^2,   r_i >= 0

In the metric of the n_i a step needs only the document's own posteriors and the D residuals, so a step is one sum over
the documents and the history of residuals (steps x D numbers) is all that the driver holds; any task computes a
document's rate from its posteriors and that history. While fitting, each document's rate is written down every ``KEPT`` steps,
so a step replays no more than those. Steps end when the residuals stand still (``STILL``); a fit that has not got there
after ``STEPS`` raises. A document's copies are floor(rate), and one more with the probability of the rest, drawn by a hash of
doc_id (of the text where that is null); over all documents the token totals are those expected.

Null or empty text has no tokens and the classifier's bias as posterior; its rate is fitted like any other. A table
without labels has the single domain ``good``. Repeated rows get equal rates; empty tables give empty results. Very long texts
are read whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DOMAINS = ("low", "good", "toxic")
#: Shares of the target total. Good text keeps its tokens at the natural mix or gains.
TARGETS = {"low": 0.08, "good": 0.92, "toxic": 0.0}
#: Hash buckets of the classifier's word features; most labelled rows that training reads; most gradient steps; the pull; steps
#: between two tables of rates; the change of residuals, as a share of all tokens, under which they stand still.
BUCKETS, SAMPLE, STEPS, PULL, KEPT, STILL = 1 << 15, 6000, 400, 0.002, 20, 1e-5


def features(text: bytes) -> tuple[np.ndarray, int]:
    """The distinct buckets of a whole text's words, and the number of words."""
    words = common.words_of(text.translate(None, b".,;:!?"))
    n = len(words)
    seen = set(words)
    h = common.hashes(seen, len(seen))
    marks = [b"\0lines"] if n and text.count(b"\n") * 12 > n else []
    raw = np.frombuffer(text, np.uint8)
    marks += [b"\0caps"] if 3 * np.count_nonzero((raw >= 65) & (raw <= 90)) > len(raw) else []
    if marks:
        h = np.concatenate([h, common.hashes(marks, len(marks))])
    return np.unique((h >> np.uint64(64 - 15)).astype(np.int64)), n


@dataclass
class Classifier:
    weights: np.ndarray  # buckets x domains
    bias: np.ndarray

    def posterior(self, text: bytes) -> tuple[np.ndarray, int]:
        at, n = features(text)
        z = self.bias + (self.weights[at].sum(0) if len(at) else 0)
        e = np.exp(z - z.max())
        return e / e.sum(), n


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, epochs: int = 10, seed: int = 1) -> Classifier:
    """Logistic regression by stochastic gradient descent on a bounded sample of the labelled documents, taken evenly
    from the classes by a hash of doc_id, of documents that share an id one; the bias is then set back to the classes' shares
    among all labels. A label counts if it has a quality or is toxic; of several for one document toxic goes before good, good before low."""
    common.prepare(docs.sparkSession)
    cls = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    known = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy("doc_id").agg(F.max(cls).alias("c"))
    sizes = {r[0]: r[1] for r in known.groupBy("c").count().collect()}
    if not sizes:
        return Classifier(np.zeros((BUCKETS, 3), np.float32), np.array([-50, 0, -50], np.float32))
    each = most / len(sizes)
    share = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, int(1e9 * min(1.0, each / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(10**9)) < F.element_at(share, F.col("c")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # about ``most`` ids
    chosen = chosen.groupBy("doc_id").agg(F.first("c").alias("c"), F.min_by("text", F.xxhash64("text")).alias("text")).select("c", "text")  # of a repeated id one row
    schema = pa.schema([("c", pa.int32()), ("at", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(schema, b.column(0), [features(t)[0].astype("<i4").tobytes() for t in common.text_bytes(b.column(1))])

    rows = sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(common.tidy(work), "c int, at binary").collect())
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([r[0] for r in rows], np.int64)
    at = [np.frombuffer(r[1], "<i4").astype(np.int64) for r in rows]
    w, acc = np.zeros((BUCKETS, 3), np.float32), np.full((BUCKETS, 3), 1e-4, np.float32)
    bias = np.zeros(3, np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), 32):
            part = order[s : s + 32]
            z = np.stack([w[at[k]].sum(0) for k in part]) + bias
            e = np.exp(z - z.max(1, keepdims=True))
            g = e / e.sum(1, keepdims=True)
            g[np.arange(len(part)), y[part]] -= 1
            i = np.concatenate([at[k] for k in part])
            if not len(i):
                continue
            back = np.repeat(g, [len(at[k]) for k in part], axis=0)
            i, inv = np.unique(i, return_inverse=True)
            grad = np.stack([np.bincount(inv, back[:, c], len(i)) for c in range(3)], 1) / len(part) + 1e-5 * w[i]
            acc[i] += grad * grad
            w[i] -= 0.05 * grad / np.sqrt(acc[i])
            bias -= 0.05 * g.mean(0)
    total, taken = sum(sizes.values()), np.bincount(y, minlength=3) + 1e-9
    prior = np.array([sizes.get(c, 0) / total + 1e-9 for c in range(3)])
    return Classifier(w, (bias + np.log(prior) - np.log(taken / taken.sum())).astype(np.float32))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p_low, p_good, p_toxic, draw): posteriors of every whole text, and where its copies' draw falls."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(f"p_{d}", pa.float64()) for d in DOMAINS], ("draw", pa.float64())])
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast(model)  # buckets x domains: a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            texts = list(common.text_bytes(b.column(1)))
            made = [own.posterior(t) for t in texts]
            p = np.array([m[0] for m in made], float).reshape(len(made), 3)
            yield common.batch(schema, b.column(0), [m[1] for m in made], p[:, 0], p[:, 1], p[:, 2], draws(b.column(0), texts))

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return made.mapInArrow(common.tidy(work), "doc_id long, n_tokens long, p_low double, p_good double, p_toxic double, draw double")


@dataclass
class Rates:
    """The fitted rates as the history of residuals; ``of`` replays it for posteriors p (rows x domains)."""

    history: np.ndarray  # steps x domains
    step: float
    pull: float

    def replay(self, p: np.ndarray, first: int = 0, at: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rates, the point at which the next residual is taken): projected gradient steps with momentum, from step
        ``first`` and its state on."""
        r, y = at if at is not None else (np.ones(len(p)), np.ones(len(p)))
        for t, residual in enumerate(self.history[first:], first):
            new = np.maximum(0.0, y - self.step * (p @ residual + self.pull * (y - 1)))
            y = new + t / (t + 3) * (new - r)
            r = new
        return r, y

    def of(self, p: np.ndarray) -> np.ndarray:
        return self.replay(p)[0]


_P = [f"p_{d}" for d in DOMAINS]


def fit(members: DataFrame, targets: dict[str, float] | None = None, total: float = 1.0, steps: int = STEPS, pull: float = PULL) -> Rates:
    """Projected gradient descent; targets are shares of ``total`` times the table's tokens."""
    want = np.array([(targets or TARGETS).get(d, 0.0) for d in DOMAINS]) * total
    state = members.where("n_tokens > 0").select("n_tokens", *_P, F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    n_all = state.agg(F.sum("n_tokens")).first()[0]
    if not n_all:
        return Rates(np.zeros((0, 3)), 0.0, pull)
    rates = Rates(np.zeros((0, 3)), 0.9 / (1 + pull), pull)  # the curvature is at most 1 + pull, as posteriors sum to 1
    sums_schema, state_schema = pa.schema([(c, pa.float64()) for c in _P]), pa.schema([("n_tokens", pa.int64()), *[(c, pa.float64()) for c in (*_P, "r", "y")]])
    kept = 0
    while len(rates.history) < steps:
        own = Rates(rates.history, rates.step, pull)

        def replayed(b: pa.RecordBatch, own: Rates = own, kept: int = kept) -> tuple:
            n, *p, r, y = (common.numbers(b.column(i)) for i in range(6))
            p = np.stack(p, 1)
            return n, p, own.replay(p, kept, (r, y))

        def work(batches: Iterator[pa.RecordBatch], replayed=replayed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, p, (_, y) = replayed(b)
                yield common.batch(sums_schema, *[[x] for x in (y * n) @ p / n_all])

        def keep(batches: Iterator[pa.RecordBatch], replayed=replayed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield common.batch(state_schema, *b.columns[:4], *replayed(b)[2])

        if len(rates.history) - kept == KEPT:
            state = common.stored(state.mapInArrow(common.tidy(keep), "n_tokens long, p_low double, p_good double, p_toxic double, r double, y double"), "rates")
            kept = len(rates.history)
            continue
        got = state.mapInArrow(common.tidy(work), "p_low double, p_good double, p_toxic double").agg(*[F.sum(c) for c in _P]).first()
        rates.history = np.vstack([rates.history, np.array(got, float) - want])
        if len(rates.history) > 1 and np.abs(rates.history[-1] - rates.history[-2]).max() < STILL:
            return rates
    raise RuntimeError(f"rates still change after {steps} steps; residuals {rates.history[-1]}")


def draws(doc_id: pa.Array, texts: list[bytes]) -> np.ndarray:
    """A number in [0, 1) from doc_id, or from the text where that is null."""
    ids = doc_id.cast(pa.int64()).to_pylist()
    of_text = np.fromiter((xxhash.xxh64_intdigest(t) if i is None else 0 for i, t in zip(ids, texts)), np.uint64, len(texts))
    seed = np.fromiter((i or 0 for i in ids), np.int64, len(ids)).view(np.uint64) ^ of_text
    return common.mix(seed + np.uint64(0x9E3779B97F4A7C15)) / 2.0**64


def copies_of(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """floor(rate), and one more where the draw falls below the rest."""
    return (np.floor(rate) + (draw < rate - np.floor(rate))).astype(np.int64)


def with_rates(members: DataFrame, rates: Rates) -> DataFrame:
    """members with rate and copies in place of their draw."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in _P], ("rate", pa.float64()), ("copies", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.stack([common.numbers(b.column(i)) for i in (2, 3, 4)], 1).reshape(-1, 3)
            r = rates.of(p)
            yield common.batch(schema, *b.columns[:5], r, copies_of(r, common.numbers(b.column(5))))

    return members.mapInArrow(common.tidy(work), "doc_id long, n_tokens long, p_low double, p_good double, p_toxic double, rate double, copies long")


def mixed(docs: DataFrame, model: Classifier, rates: Rates) -> DataFrame:
    """docs with every row as often as its copies say; posteriors are computed again where the text is read, so no text
    is shuffled."""
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast((model, rates))
    text, ident = docs.columns.index("text"), docs.columns.index("doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fitted = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            texts = list(common.text_bytes(b.column(text)))
            k = copies_of(fitted.of(np.array([own.posterior(t)[0] for t in texts], float)), draws(b.column(ident), texts))
            for s in range(0, len(k), 64):
                yield b.take(common.column(np.repeat(np.arange(s, min(s + 64, len(k))), k[s : s + 64]), pa.int64()))

    return docs.mapInArrow(common.tidy(work), docs.schema)
