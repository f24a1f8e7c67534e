"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A rolling hash over 32 bytes cuts every text where its content says so, so a passage that documents share falls into the
same chunks in all of them. Chunks are counted by 128-bit hash over the whole corpus; those that occur again (the ``TABLE``
most frequent: a fixed bound on what is broadcast; less frequent ones are encoded where they stand, with the same ids) are
encoded once each, and meet their documents by a join whose hot chunks are broadcast. A document that holds such chunks is assembled from
the table's ids and its own other chunks' ids. At every join of two chunks the stretch between the nearest safe places
on both sides is encoded again; a place is safe where a letter is followed by a space and a letter, as no token crosses
it whatever surrounds it. If the ids on either side have no token boundary at that place, or a chunk has no safe place,
the stretch grows to the next one, at last to the whole text, so the ids agree with those of the whole text exactly.
Documents without shared chunks are encoded in one piece. Which chunks are in the table changes the work, not the ids.

The tokenizer is a byte-level BPE file (``tokenizers`` JSON) at a path given as a parameter; ids are those of that
library with add_special_tokens=False, so special tokens' strings in a text become their ids.

Null text is the empty text: no ids. Repeated rows each get their row, and each is assembled by itself. A very long text is
one row and is assembled by one task. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The pre-tokenizer's pattern of byte-level BPE with 50,257 ids (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Mean, least and largest bytes of a chunk; the most chunks in the table.
MEAN, LEAST, LARGEST, TABLE = 2048, 256, 1 << 14, 200_000

_SAFE = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
_GEAR = np.random.default_rng(32).integers(0, 2**32, 256, dtype=np.uint32)


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE file; ids of merged tokens rise in the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letter = {chr(b): b for b in shown}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(enc: tiktoken.Encoding, text: bytes) -> np.ndarray:
    """Ids of a whole text."""
    return np.asarray(enc.encode_to_numpy(text.decode("utf-8", "replace"), allowed_special="all"), np.uint32)


def chunks_of(text: bytes) -> list[int]:
    """Where the chunks of a text end."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    x = np.frombuffer(text, np.uint8)
    h = _GEAR[x]
    for k in (1, 2, 4, 8, 16):  # after these steps h[i] is the sum of the gears of the last 32 bytes, each shifted by its age
        h[k:] += h[:-k] << np.uint32(k)
    cuts = np.flatnonzero((h >> np.uint32(32 - MEAN.bit_length() + 1)) == 0) + 1
    ends, last = [], 0
    for c in [*cuts.tolist(), n]:
        while c - last > LARGEST:
            last = _whole(text, last + LARGEST)
            ends.append(last)
        if c - last >= LEAST or c == n:
            c = _whole(text, c)
            if c > last:
                ends.append(c)
                last = c
    return ends


def _whole(text: bytes, at: int) -> int:
    """The next place at or after this one that does not split a character."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def joined(enc: tiktoken.Encoding, parts: list[np.ndarray]) -> np.ndarray:
    """Ids of the text whose chunks have these ids, exact whatever the chunks are."""
    if len(parts) < 2:
        return parts[0] if parts else np.empty(0, np.uint32)
    raw = [enc.decode_bytes(p.tolist()) for p in parts]
    out: list[np.ndarray] = []
    done, k = 0, 0  # of chunk k, the ids up to ``done`` are in out
    while k < len(parts):
        if k + 1 == len(parts):
            out.append(parts[k][done:])
            break
        left = _last_safe(enc, raw[k], parts[k], done)
        stretch = [raw[k][left[0] :]]
        out.append(parts[k][done : left[1]])
        to = k + 1
        while True:  # until the ids on the right agree
            right = _first_safe(enc, raw[to], parts[to]) if to < len(parts) else None
            if right is not None:
                stretch.append(raw[to][: right[0]])
                done, k = right[1], to
                break
            if to + 1 >= len(parts):
                stretch.append(raw[to] if to < len(parts) else b"")
                done, k = 0, len(parts)
                break
            stretch.append(raw[to])
            to += 1
        out.append(encode(enc, b"".join(stretch)))
    return np.concatenate(out)


def _bounds(enc: tiktoken.Encoding, ids: np.ndarray) -> np.ndarray:
    return np.cumsum([0, *map(len, enc.decode_tokens_bytes(ids.tolist()))])


def _first_safe(enc: tiktoken.Encoding, raw: bytes, ids: np.ndarray) -> tuple[int, int] | None:
    """(byte, id index) of the first safe place of a chunk at which one of its ids begins."""
    ends = None
    for m in _SAFE.finditer(raw):
        ends = _bounds(enc, ids) if ends is None else ends
        i = int(np.searchsorted(ends, m.start()))
        if ends[i] == m.start():
            return m.start(), i
    return None


def _last_safe(enc: tiktoken.Encoding, raw: bytes, ids: np.ndarray, done: int) -> tuple[int, int]:
    """The last such place at or after id ``done``; that id's own place where there is none."""
    ends = _bounds(enc, ids)
    window = 256
    while True:
        start = max(int(ends[done]), len(raw) - window)
        found = [start + m.start() for m in _SAFE.finditer(raw[start:])]
        for at in reversed(found):
            i = int(np.searchsorted(ends, at))
            if ends[i] == at and i >= done:
                return at, i
        if start == int(ends[done]):
            return start, done
        window *= 4


_DOC = "key long, doc_id long, n_chunks int, seq int, chunk long, text binary, ids binary"
_DOC_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_chunks", pa.int32()), ("seq", pa.int32()), ("chunk", pa.int64()), ("text", pa.binary()), ("ids", pa.binary())])


def _hashes(text: bytes, ends: list[int]) -> np.ndarray:
    """128-bit hashes of a text's chunks: rows of two 64-bit integers."""
    made = b"".join(xxhash.xxh3_128_digest(text[a:e]) for a, e in zip([0, *ends], ends))
    return np.frombuffer(made, ">i8").astype(np.int64).reshape(-1, 2)


def shared_chunks(docs: DataFrame, most: int = TABLE) -> DataFrame:
    """(chunk, more, times): both halves of the hashes of chunks that occur more than once in the corpus, about the ``most``
    most frequent."""
    schema = pa.schema([("chunk", pa.int64()), ("more", pa.int64()), ("times", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [np.empty((0, 2), np.int64), *(_hashes(t, chunks_of(t)) for t in common.text_bytes(b.column(0)))]
            found, n = np.unique(np.concatenate(seen), axis=0, return_counts=True)
            yield common.batch(schema, found[:, 0], found[:, 1], n)

    common.prepare(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(common.tidy(work), "chunk long, more long, times long")
    counted = counted.groupBy("chunk", "more").agg(F.sum("times").alias("times")).where("times > 1")
    return common.greatest(common.stored(counted, "chunks"), "times", "chunk", most) if most else counted.limit(0)


_IDS, _DIGESTS = "doc_id long, ids binary", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, path: str, most: int = TABLE) -> DataFrame:
    """(doc_id, ids binary): the ids of every whole text as little-endian unsigned 32-bit integers."""
    return _encoded(docs, path, most, lambda batches: batches, _IDS)


def encoded_digests(docs: DataFrame, path: str, most: int = TABLE) -> DataFrame:
    """``digests`` of ``encoded``, made in the Python worker that made the ids: a task then holds one worker, not two."""
    return _encoded(docs, path, most, _digested(path), _DIGESTS)


def _encoded(docs: DataFrame, path: str, most: int, then: Callable, kind: str) -> DataFrame:
    """What ``then`` makes of the batches (doc_id, ids); kind is its schema."""
    spark = common.prepare(docs.sparkSession)
    found = shared_chunks(docs, most).select("chunk", "more").toArrow()  # at most ``most`` hashes
    found = np.stack([found.column(c).to_numpy() for c in ("chunk", "more")], 1)
    found = found[np.argsort(found[:, 0], kind="stable")]
    twice = np.isin(found[:, 0], found[1:, 0][found[1:, 0] == found[:-1, 0]])  # other bytes, same half: left where they stand
    table = spark.sparkContext.broadcast(found[~twice])
    small = "<u2" if encoding(path).n_vocab <= 1 << 16 else "<u4"  # of ids on their way

    def marked(t: bytes, known: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ends of the chunks, their hashes' first halves, whether they are in the table)"""
        ends = chunks_of(t)
        marks = _hashes(t, ends)
        again = (known[np.minimum(np.searchsorted(known[:, 0], marks[:, 0]), len(known) - 1)] == marks).all(1) if len(known) else np.zeros(len(marks), bool)
        return ends, marks[:, 0], again

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoding(path), table.value
        for b in batches:
            rows = [(i, t) for i, t in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1))) if not marked(t, known)[2].any()]
            yield common.batch(out, [i for i, _ in rows], [encode(enc, t).astype("<u4").tobytes() for _, t in rows])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known, sent = encoding(path), table.value, set()

        for b in batches:
            rows: list[tuple] = []
            for doc_id, t in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1))):
                ends, marks, again = marked(t, known)
                if not again.any():
                    continue
                key = int.from_bytes(os.urandom(8)) >> 1  # of this row alone; the pieces are stored before they are read
                s = 0
                while s < len(ends):  # chunks that are not shared, as one piece
                    e = s + 1
                    if not again[s]:
                        while e < len(ends) and not again[e]:
                            e += 1
                    piece = t[ends[s - 1] if s else 0 : ends[e - 1]]
                    if again[s]:
                        first = int(marks[s]) not in sent and not sent.add(int(marks[s]))
                        rows.append((key, doc_id, len(ends), s, int(marks[s]), piece if first else None, None))
                    else:
                        rows.append((key, doc_id, len(ends), s, None, None, encode(enc, piece).astype(small).tobytes()))
                    s = e
            yield common.batch(_DOC_ARROW, *([r[i] for r in rows] for i in range(len(_DOC_ARROW))))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        schema = pa.schema([("chunk", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            yield common.batch(schema, b.column(0), [encode(enc, t).astype(small).tobytes() for t in common.text_bytes(b.column(1))])

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        now, parts = None, []

        def ended() -> tuple:
            return now[1], joined(enc, [p for _, p in sorted(parts, key=lambda x: x[0])]).astype("<u4").tobytes()

        for b in batches:
            rows = []
            for key, doc_id, seq, ids in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "seq", "ids"))):
                if now is not None and now != (key, doc_id):
                    rows.append(ended())
                    parts = []
                now = (key, doc_id)
                parts.append((seq, np.frombuffer(ids, small)))
            yield common.batch(out, [r[0] for r in rows], [r[1] for r in rows])
        if now is not None:
            yield common.batch(out, *([x] for x in ended()))

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = common.stored(texts.mapInArrow(common.tidy(split), _DOC), "pieces")  # only of documents that hold chunks of the table
    direct = texts.mapInArrow(common.tidy(lambda batches: then(alone(batches))), kind)
    texts = pieces.where("text is not null").select("chunk", "text").dropDuplicates(["chunk"])
    ids = common.stored(texts.mapInArrow(common.tidy(once), "chunk long, ids binary"), "chunk_ids")
    shared = common.hot_join(pieces.where("chunk is not null").select("key", "doc_id", "seq", "chunk"), ids, "chunk").select("key", "doc_id", "seq", "ids")
    own = pieces.where("chunk is null").select("key", "doc_id", "seq", "ids")
    made = shared.unionByName(own).repartition("key").sortWithinPartitions("key", "doc_id", "seq").mapInArrow(common.tidy(lambda batches: then(assemble(batches))), kind)
    return direct.unionByName(made)


def _digested(path: str) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            raw = b.column(1).to_pylist()
            text = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in raw]
            yield common.batch(schema, b.column(0), [len(x) // 4 for x in raw], [hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha256(t).hexdigest() for t in text])

    return work


def digests(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded texts; decoding is part of it."""
    return ids.mapInArrow(common.tidy(_digested(path)), _DIGESTS)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text of encoded ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            yield common.batch(schema, b.column(0), [enc.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()])

    return ids.mapInArrow(common.tidy(work), "doc_id long, text string")
