"""A hashed maximum-entropy language model with a class-factored softmax, and a unigram base.

    P(w | h) = P(class | h) * P(slot | class, h) * P(w | class, slot)

A class has ``SLOTS`` slots. The end of a text and each of the ``OWN`` most frequent words has a slot of its own, so for
them the last factor is 1; all other words share the rest by a hash of their last three bytes. Both softmaxes are
maximum-entropy models over hashed features of the history, in which a word is known by its class and slot: the word before
(n-gram), the one before that (skip) and both together for the class; the first two, each with the class, for the slot.
They are trained by distributed gradient updates: in each round every task runs stochastic gradient descent (Adagrad, sparse
mini-batches in numpy) over its share of that round's training documents, starting from the common weights, and the updates
of the rows it touched are averaged by tokens, first over groups of tasks, then over all. All training documents take part,
each in one round. P(w | class, slot) comes from the counts of all training tokens, with one more for every word of the
slot and for what it has not seen: an open vocabulary has no weights of its own.

Counts of the ``HEAD`` most frequent words are broadcast (a fixed size); all other words of a text are joined to the
table of counts by hash, which is free of hot keys, as the hot words are in the head.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, known by 64-bit hashes; every text ends with one end token. Null
text is the empty text: its end token only. A very long text is scored in stretches of ``MINI`` tokens, its history going on
from one to the next. Documents without doc_id learn along and are not held out. Repeated rows each get their row. Without
training documents both scores use empty counts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose counts are broadcast; classes, slots of a class, words with a slot of their own; hash buckets of a feature of the
#: class and of a feature of the slot.
HEAD, CLASSES, SLOTS, OWN, BUCKETS, SLOT_BUCKETS = 1 << 18, 16, 32, 127, 1 << 13, 1 << 13
LEAVES = CLASSES * SLOTS
#: Rounds, tokens of a mini-batch, learning rate; distinct words that a task counts before it sends them on; groups of tasks
#: whose updates are summed first; words that a worker keeps the hashes of.
ROUNDS, MINI, RATE, HELD_WORDS, GROUPS, MEMO = 2, 8192, 0.1, 1 << 20, 16, 1 << 18
_END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word has a space
_BLOCK = 512  # feature rows of a block of weights

_SCATTERED = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)


class _Words(dict):
    """Numbers of words in the order first seen, with hash and leaf by ending of each; forgets all beyond ``MEMO``."""

    def __init__(self) -> None:
        super().__init__()
        self.hash, self.leaf = np.empty(MEMO, np.uint64), np.empty(MEMO, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == MEMO:
            raise MemoryError
        one, two, three = word[-1], word[-2] if len(word) > 1 else 32, word[-3] if len(word) > 2 else 32
        self[word] = k
        self.hash[k] = xxhash.xxh64_intdigest(word)
        self.leaf[k] = 1 + OWN + int(_SCATTERED[int(_SCATTERED[two << 8 | one]) & 0xFFFF ^ three]) % (LEAVES - 1 - OWN)
        return k


_words = None


def _numbered(words: list[bytes]) -> np.ndarray:
    """The number of each word; a task's words repeat, and a look-up is cheaper than a hash."""
    global _words
    if _words is None or len(_words) + len(words) > MEMO:
        _words = _Words()
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words))


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, leaves by ending) of a text's words and its end. Leaf k is slot k // CLASSES of class k % CLASSES."""
    words = common.words_of(text)
    n = len(words)
    out, leaf = np.empty(n + 1, np.uint64), np.empty(n + 1, np.int64)
    out[n], leaf[n] = _END, 0
    for a in range(0, n, MEMO):
        at = _numbered(words[a : a + MEMO])
        out[a : a + len(at)], leaf[a : a + len(at)] = _words.hash[at], _words.leaf[at]
    return out, leaf


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, leaf, n): tokens of all training documents by hash, with their leaf by ending."""
    schema = pa.schema([("word", pa.int64()), ("leaf", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, leaf, n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            made = [tokens_of(t) for t in common.text_bytes(b.column(0))]
            if not made:
                continue
            w, first, c = np.unique(np.concatenate([m[0] for m in made]), return_index=True, return_counts=True)
            both = np.concatenate([word, w])
            k = np.concatenate([leaf, np.concatenate([m[1] for m in made])[first]])
            word, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            leaf, n = k[first], np.bincount(inverse, np.concatenate([n, c]), len(word)).astype(np.int64)
            if len(word) > HELD_WORDS:
                yield common.batch(schema, common.signed(word), leaf.astype(np.int32), n)
                word, leaf, n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(word):
            yield common.batch(schema, common.signed(word), leaf.astype(np.int32), n)

    common.prepare(docs.sparkSession)
    made = docs.select(F.col("text").cast("string")).mapInArrow(work, "word long, leaf int, n long")
    return made.groupBy("word").agg(F.first("leaf").alias("leaf"), F.sum("n").alias("n"))


@dataclass
class Model:
    words: np.ndarray  # hashes of the head, ascending
    counts: np.ndarray
    own: np.ndarray  # hashes of the words with their own leaf, ascending
    own_leaf: np.ndarray
    n: int
    v: int
    leaf_n: np.ndarray
    leaf_v: np.ndarray
    bias: np.ndarray  # of classes
    slot_bias: np.ndarray  # classes x slots
    weights: np.ndarray = field(repr=False)  # rows of the class's features x classes
    slot_weights: np.ndarray = field(repr=False)  # rows of the slot's features x slots

    def leaves(self, word: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return leaf
        at = np.minimum(np.searchsorted(self.own, word), len(self.own) - 1)
        return np.where(self.own[at] == word, self.own_leaf[at], leaf)

    def log_share(self) -> np.ndarray:
        """log10 of what a leaf's counts are divided by; a word alone in its leaf has all of it but what is unseen."""
        return np.log10(self.leaf_n + self.leaf_v + 1.0)


def features_of(leaf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the class's weights, rows of the slot's weights), features x tokens, that each token's history names;
    start: where texts begin."""
    one = np.concatenate([[0], leaf[:-1]])
    two = np.concatenate([[0, 0], leaf[:-2]])[: len(leaf)]
    one[start] = 0
    two[start] = 0
    two[start[start + 1 < len(leaf)] + 1] = 0  # a second token's skip feature is the end of the text before
    both = (one * 0x9E3779B1 + two * 0x85EBCA6B) >> 7 & (BUCKETS - 1)
    rows = np.stack([one, LEAVES + two, 2 * LEAVES + both]).astype(np.uint16)
    cls = leaf % CLASSES
    slot = np.stack([one * CLASSES + cls, two * CLASSES + cls])
    if LEAVES * CLASSES > SLOT_BUCKETS:
        slot = slot * 0x9E3779B1 >> 9 & (SLOT_BUCKETS - 1)
    slot[1] += SLOT_BUCKETS
    return rows, slot.astype(np.uint16)


ROWS, SLOT_ROWS = 2 * LEAVES + BUCKETS, 2 * SLOT_BUCKETS


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the weights that each token's features name; rows: features x tokens."""
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    return z


def _lowered(z: np.ndarray) -> np.ndarray:
    """z less its maximum, so that exp() of it neither overflows nor loses a whole row."""
    top = z.max()
    return z - top if top - z.min() < 60 else z - z.max(1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(_lowered(z))
    z /= z.sum(1, keepdims=True)
    return z


def descend(weights: np.ndarray, bias: np.ndarray, acc: np.ndarray, rows: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """One Adagrad step on a mini-batch, in place; gives the rows that occur, the only ones touched."""
    g = _softmax(logits(weights, rows) + bias)
    n = len(g)
    g[np.arange(n), truth] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # 16-bit integers: a radix sort
    found = flat[order]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    size = np.diff(np.append(first, len(found)))
    step = g.take(order[first] % n, axis=0)  # many rows occur once
    many = np.repeat(size > 1, size)
    if many.any():
        step[size > 1] = np.add.reduceat(g.take(order[many] % n, axis=0), np.cumsum(np.append(0, size[size > 1][:-1])), axis=0)
    at = found[first]
    acc[at] += step * step
    weights[at] -= RATE * step / np.sqrt(acc[at])
    return at


def log_probability(z: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """log10 of the softmax of z at truth."""
    z = _lowered(z)
    return (z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))) / np.log(10)


def _head(counts: DataFrame) -> Model:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    top = common.greatest(counts, "n", "word", HEAD).toArrow()  # about HEAD rows of 20 bytes
    top = top.sort_by([("n", "descending"), ("word", "ascending")])
    word = top.column("word").to_numpy().view(np.uint64)
    n, leaf = top.column("n").to_numpy(), top.column("leaf").to_numpy().astype(np.int64)
    single = np.flatnonzero(leaf != 0)[:OWN]
    by = counts.groupBy("leaf").agg(F.sum("n"), F.count("*")).collect()  # a row per leaf
    leaf_n, leaf_v = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
    for k, tokens, words in by:
        leaf_n[k], leaf_v[k] = tokens, words
    for k, i in enumerate(single):
        leaf_n[leaf[i]] -= n[i]
        leaf_v[leaf[i]] -= 1
        leaf_n[1 + k], leaf_v[1 + k] = n[i], 1
    order, own = np.argsort(word), np.argsort(word[single])
    table = (leaf_n + 1.0).reshape(SLOTS, CLASSES).T
    bias, slot_bias = np.log(table.sum(1) / table.sum()), np.log(table / table.sum(1, keepdims=True))
    weights, slot_weights = np.zeros((ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32)
    return Model(word[order], n[order], word[single][own], 1 + own.astype(np.int64), total[0] or 0, total[1], leaf_n, leaf_v, bias.astype(np.float32), slot_bias.astype(np.float32), weights, slot_weights)


def _joined(made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, leaves by ending, where each text starts) of texts in a row."""
    return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.cumsum([0, *[len(m[0]) for m in made[:-1]]])


_DELTA = "block int, tokens long, rows binary, delta binary"
_DELTA_ARROW = pa.schema([("block", pa.int32()), ("tokens", pa.int64()), ("rows", pa.binary()), ("delta", pa.binary())])
_TABLE = ROWS // _BLOCK + 1  # blocks of the slots' table follow those of the classes'


def _packed(table: int, touched: np.ndarray, delta: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(block, 0, rows, values in 16 bits) of a table's touched rows."""
    at = np.flatnonzero(touched)
    for k in np.unique(at // _BLOCK).tolist():
        rows = at[at // _BLOCK == k]
        yield k + table * _TABLE, 0, (rows % _BLOCK).astype("<u2").tobytes(), delta[rows].astype("<f2").tobytes()


def _values(block: int, rows: bytes, delta: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values) of an update: 16 bits a value from a task, 32 from a sum."""
    at = np.frombuffer(rows, "<u2").astype(np.int64)
    wide = len(delta) == 4 * len(at) * (CLASSES if block < _TABLE else SLOTS)
    return at, np.frombuffer(delta, "<f4" if wide else "<f2").astype(np.float32).reshape(len(at), -1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the updates of each block."""
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        for k, rows, delta in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
            at, x = _values(k, rows, delta)
            sums.setdefault(k, np.zeros((_BLOCK, x.shape[1]), np.float32))[at] += x
            seen.setdefault(k, np.zeros(_BLOCK, bool))[at] = True
    for k, x in sums.items():
        at = np.flatnonzero(seen[k])
        yield common.batch(_DELTA_ARROW, [k], [0], [at.astype("<u2").tobytes()], [x[at].astype("<f4").tobytes()])


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learns from all of docs; counts are their word_counts."""
    spark = common.prepare(docs.sparkSession)
    model = _head(counts)
    texts = docs.select(F.col("text").cast("string"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds)).alias("round"))
    for r in range(rounds):
        part = texts.where(F.col("round") == r)
        sent = spark.sparkContext.broadcast(model)  # a fixed size

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            weights, slot_weights = own.weights.copy(), own.slot_weights.copy()
            acc, slot_acc = np.full(weights.shape, 1.0, np.float32), np.full(slot_weights.shape, 1.0, np.float32)
            touched, slot_touched = np.zeros(len(weights), bool), np.zeros(len(slot_weights), bool)
            tokens = 0
            for b in batches:
                made = [tokens_of(t) for t in common.text_bytes(b.column(0))]
                if not made:
                    continue
                word, leaf, start = _joined(made)
                leaf = own.leaves(word, leaf)
                rows, slot_rows = features_of(leaf, start)
                cls, slot = leaf % CLASSES, leaf // CLASSES
                tokens += len(word)
                for s in range(0, len(word), MINI):
                    some = slice(s, s + MINI)
                    touched[descend(weights, own.bias, acc, rows[:, some], cls[some])] = True
                    slot_touched[descend(slot_weights, own.slot_bias[cls[some]], slot_acc, slot_rows[:, some], slot[some])] = True
            if tokens:  # each update weighs as many tokens as made it
                scale = np.float32(tokens / 2**16)
                done = [(-1, tokens, b"", b""), *_packed(0, touched, (weights - own.weights) * scale), *_packed(1, slot_touched, (slot_weights - own.slot_weights) * scale)]
                yield common.batch(_DELTA_ARROW, *([d[c] for d in done] for c in range(4)))

        made = common.stored(part.select("text").mapInArrow(work, _DELTA), "updates")
        tokens = made.agg(F.sum("tokens")).first()[0]
        group = F.pmod(F.xxhash64("rows", "delta"), F.lit(GROUPS))
        summed = made.where("block >= 0").repartition("block", group).mapInArrow(_summed, _DELTA)
        for k, _, rows, delta in summed.repartition("block").mapInArrow(_summed, _DELTA).collect():  # a fixed size
            at, x = _values(k, bytes(rows), bytes(delta))
            (model.weights if k < _TABLE else model.slot_weights)[k % _TABLE * _BLOCK + at] += x * np.float32(2.0**16 / tokens)
    return model


_SCORED = "doc_id long, mark long, held_out boolean, n_tokens long, known long, counted double, model double, tail array<long>, times array<int>"
_SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("counted", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = common.prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        log_counts, share = np.log10(own.counts + 1.0), own.log_share()
        for b in batches:
            texts = list(common.text_bytes(b.column(2)))
            if not texts:
                continue
            word, leaf, start = _joined([tokens_of(t) for t in texts])
            leaf = own.leaves(word, leaf)
            rows, slot_rows = features_of(leaf, start)
            cls, slot = leaf % CLASSES, leaf // CLASSES
            value = -share[leaf]
            for s in range(0, len(word), MINI):
                some = slice(s, s + MINI)
                value[some] += log_probability(logits(own.weights, rows[:, some]) + own.bias, cls[some])
                value[some] += log_probability(logits(own.slot_weights, slot_rows[:, some]) + own.slot_bias[cls[some]], slot[some])
            at = np.minimum(np.searchsorted(own.words, word), max(0, len(own.words) - 1))
            known = own.words[at] == word if len(own.words) else np.zeros(len(word), bool)
            counted = np.where(known, log_counts[at], 0.0) if len(own.words) else np.zeros(len(word))
            size = np.diff(np.append(start, len(word)))
            doc = np.repeat(np.arange(len(texts)), size)[~known]
            rest = word[~known]
            order = np.lexsort((rest, doc))
            doc, rest = doc[order], rest[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])])) if len(doc) else np.empty(0, np.int64)
            offsets = pa.array(np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int32))
            tail = pa.ListArray.from_arrays(offsets, common.signed(rest[first]))
            times = pa.ListArray.from_arrays(offsets, pa.array(np.diff(np.append(first, len(doc))).astype(np.int32)))
            marks = common.signed(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64))
            add = lambda x: np.add.reduceat(x, start)
            yield common.batch(_SCORED_ARROW, b.column(0), marks, b.column(1), size, add(known.astype(np.int64)), add(counted), add(value), tail, times)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    made = common.stored(made.mapInArrow(work, _SCORED), "scored")
    rare = made.dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.explode(F.arrays_zip("tail", "times")).alias("x"))
    rare = rare.select("doc_id", "mark", F.col("x.tail").alias("word"), F.col("x.times").alias("times")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("found"))
    both = made.drop("tail", "times").join(rare, made["doc_id"].eqNullSafe(rare["d"]) & (made["mark"] == rare["m"]), "left")
    total = F.col("counted") + F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * float(np.log10(model.n + model.v + 1.0))).alias("base_score"), (total + F.col("model")).alias("score"),
    )


def language_model_scores(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    learn = docs.where(~held_out(F.col("doc_id")))
    counts = common.stored(word_counts(learn), "word_counts")
    return scored(docs, train(learn, counts), counts)
