"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are its byte n-grams (1 to 4 bytes, lower-cased A-Z) over the whole text, hashed into buckets. Every
bucket has an embedding; a text is the average of its n-grams' embeddings; a linear softmax reads the average. Training
is mini-batch stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE`` rows, spread evenly
over all labels that occur, by a hash of doc_id and text; a row that is repeated counts once; a label of few rows gives them
all). More labels than ``SAMPLE`` are refused. A temperature is then fitted on a part of the sample that training has not
seen, so that scores are calibrated probabilities, and ``floor`` is the score that all but ``REJECT`` of that part reach.

Null text and text without letters have language ``und`` and score 0. Of languages with equal probability the one first in
alphabetical order is told. An empty table, or one without labels, gives ``und`` everywhere. Repeated rows get equal
results. Very long texts are read whole, a stretch at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash buckets, embedding width, most labelled rows that training reads, share of unseen rows below the floor.
BUCKETS, WIDTH, SAMPLE, REJECT = 1 << 14, 16, 4000, 0.002
#: Bytes of one stretch of text that is hashed at a time.
STRETCH = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


def counts_of(text: bytes) -> np.ndarray:
    """How many n-grams of 1 to 4 bytes fall in each bucket, over the whole text."""
    out = np.zeros(BUCKETS, np.float32)
    raw = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    for s in range(0, len(raw), STRETCH):
        x = raw[s : s + STRETCH + 3]
        code = np.zeros(len(x), np.uint32)
        for n in range(1, 5):
            code = code[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
            own = code[: min(len(code), STRETCH)]  # n-grams that start in this stretch
            if len(own):
                out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14), minlength=BUCKETS)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """The buckets that have counts, and these, compressed: some 4,000 of them meet in the driver."""
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype("<u2").tobytes() + counts[at].astype("<f4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(packed: bytes) -> tuple[bytes, bytes]:
    """(buckets as "<u2", counts as "<f4")"""
    raw = zlib.decompress(packed)
    cut = len(raw) // 3
    return raw[:cut], np.frombuffer(raw, np.uint8, offset=cut).reshape(4, -1).T.tobytes()


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    floor: float

    def predict(self, text: bytes) -> tuple[str, float]:
        if not self.langs or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        c = counts_of(text)
        z = (c @ self.weights / c.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, max(0.0, p[k])))


def _sample(docs: DataFrame, lang: Column, most: int) -> DataFrame:
    """(lang, text): about ``most`` distinct labelled rows at most, chosen by a hash; the shares are set from exact counts."""
    made = docs.select(lang.cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = made.groupBy("lang").count().limit(most + 1).collect()  # a row per label, at most ``most``
    if len(sizes) > most:
        raise ValueError(f"more than {most} labels: a larger sample is needed")
    each = most / max(1, len(sizes))
    share = docs.sparkSession.createDataFrame([(r[0], int(1e9 * min(1.0, each / r[1]))) for r in sizes], "lang string, share long")
    made = made.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(10**9)) < F.col("share"))
    return made.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(docs: DataFrame, lang_col: str = "lang", most: int = SAMPLE, epochs: int = 12, seed: int = 1) -> Model:
    """Learns from text and non-null languages of docs (doc_id only chooses the sample)."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(schema, b.column(0), [_packed(counts_of(t)) for t in common.text_bytes(b.column(1))])

    chosen = _sample(docs, F.col(lang_col), most).mapInArrow(common.tidy(work), "lang string, counts binary").toArrow()
    rows = sorted((lang, *_unpacked(c)) for lang, c in zip(*(column.to_pylist() for column in chosen.columns)))
    del chosen
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    y = np.array([langs.index(r[0]) for r in rows])
    at = [np.frombuffer(r[1], "<u2") for r in rows]
    val = []
    for n, r in enumerate(rows):
        val.append(np.frombuffer(r[2], "<f4") / np.frombuffer(r[2], "<f4").sum())
        rows[n] = r[:1]  # the counts are no longer needed
    unseen = max(1, len(rows) // 5) if len(rows) > 4 else 0
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    sums = [np.full_like(x, 1e-6) for x in (emb, out, bias)]
    for epoch in range(epochs):
        order = unseen + rng.permutation(len(rows) - unseen)
        for s in range(0, len(order), 64):
            part = order[s : s + 64]
            cut = np.cumsum([0, *[len(at[i]) for i in part]])
            i, v = np.concatenate([at[k] for k in part]).astype(np.int64), np.concatenate([val[k] for k in part])[:, None]
            back = emb[i]  # one buffer of this size at a time: the driver has little memory
            back *= v
            mean = np.add.reduceat(back, cut[:-1], axis=0)
            del back
            g = softmax(mean @ out + bias)
            g[np.arange(len(part)), y[part]] -= 1
            back = np.repeat(g @ out.T, np.diff(cut), axis=0)
            back *= v
            grad_emb = np.zeros_like(emb)
            for w in range(WIDTH):
                grad_emb[:, w] = np.bincount(i, back[:, w], BUCKETS)
            del back
            for x, acc, gr in zip((emb, out, bias), sums, (grad_emb, mean.T @ g, g.sum(0))):
                acc += gr * gr
                x -= 0.3 * gr / np.sqrt(acc)
    weights = emb @ out
    held = range(unseen) if unseen else range(len(rows))
    z = np.stack([val[k] @ weights[at[k]] + bias for k in held])
    truth = y[list(held)]
    scale = min(np.geomspace(0.2, 5, 40), key=lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    floor = float(np.quantile(softmax(z / scale).max(1), REJECT))
    del rows, at, val
    common.give_back()
    return Model(langs, weights.astype(np.float32), bias, float(scale), min(floor, 0.5))


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast(model)  # buckets x languages: a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            made = [own.predict(t) for t in common.text_bytes(b.column(1))]
            yield common.batch(schema, b.column(0), [m[0] for m in made], [m[1] for m in made])

    return docs.select(F.col(id_col).cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(work), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language the model tells with its calibrated floor or more; all columns stay."""
    sent = common.prepare(docs.sparkSession).sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            made = [own.predict(t) for t in common.text_bytes(b.column(place))]
            yield b.filter(common.column([m[0] != "und" and m[1] >= own.floor for m in made], pa.bool_()))

    return docs.mapInArrow(common.tidy(work), docs.schema)
