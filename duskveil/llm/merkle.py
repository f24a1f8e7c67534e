"""Merkle fixity audit of WARC replicas.

``archived`` writes records as WARC bytes: a segment (one file) per range of ids, its bytes in blocks that end with a record.
``manifest`` reads a replica's bytes back, whatever they hold, and gives every record found with its own offset and digest.
Over the digests stands a tree: a leaf covers an ordered range of ``RANGE`` bytes of a segment's offsets and hashes the
digests of the records that start in it, in order; above, ``FAN`` neighbouring ranges make a node, up to one root per
segment, and segments make nodes in the same way up to one root of the archive. There are as many levels as the greatest
offset and segment ask for, so no node has more than FAN children. Two replicas are compared from the root: a level is read
only below nodes that differ, so an intact branch costs one comparison, and the records of differing leaves tell what is
altered, missing or extra.

Null records are empty and leave no bytes. A null id counts as -1. Null segments or offsets of a manifest count as 0. Of
records that share segment and offset as many as agree are paired by digest, the rest in the order of their digests, and
what is left over is missing or extra: a record that is there twice on one side and once on the other is one missing. Lost
bytes are zero bytes; bytes that are no record count as one up to the next. Two empty replicas give no rows; against an empty
one every record is missing. Other columns of the caller are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a leaf's range, children of a node, bytes of a block, ids of a segment.
RANGE, FAN, BLOCK, PER_SEGMENT = 1 << 17, 16, 1 << 20, 4096
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*\r\n", re.IGNORECASE)
_BLOCKS, _BLOCKS_ARROW = "segment long, start long, block binary", pa.schema([("segment", pa.int64()), ("start", pa.int64()), ("block", pa.binary())])


def warc_record(url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as bytes."""
    url, payload = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(payload.cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n")).cast("binary")


def archived(records: DataFrame, id_col: str = "id", record: str = "record", per_segment: int = PER_SEGMENT) -> DataFrame:
    """(segment, start, block): the archive's bytes. Within a segment records follow each other by id, then digest; a task
    streams through its segments and holds one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, parts, size = None, 0, [], 0
        for b in batches:
            done = []
            for segment, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if segment != now or size >= BLOCK:
                    if parts:
                        done.append((now, at, b"".join(parts)))
                    at = at + size if segment == now else 0
                    now, parts, size = segment, [], 0
                parts.append(raw.as_py())
                size += len(parts[-1])
            yield common.batch(_BLOCKS_ARROW, *([d[c] for d in done] for c in range(3)))
        if parts:
            yield common.batch(_BLOCKS_ARROW, [now], [at], [b"".join(parts)])

    common.prepare(records.sparkSession)
    ident, raw = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.col(record).cast("binary"), F.lit(b""))
    made = records.select(F.floor(ident / per_segment).cast("long").alias("segment"), raw.alias("record"), ident.alias("id"), F.sha2(raw, 256).alias("digest"))
    made = made.repartition("segment").sortWithinPartitions("segment", "id", "digest").select("segment", "record")
    return made.mapInArrow(work, _BLOCKS)


def spans(block: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of every record of a block, of what is unreadable too; lost bytes are left out."""
    at = 0
    while at < len(block):
        if not block[at]:
            lost = re.compile(rb"\x00+").match(block, at)
            at = lost.end()
            continue
        end = -1
        if block.startswith(b"WARC/", at):
            body = block.find(b"\r\n\r\n", at)
            length = _LENGTH.search(block, at, body + 2) if body >= 0 else None
            end = body + 4 + int(length[1]) + 4 if length else -1
        if not at < end <= len(block):
            end = block.find(b"WARC/", at + 1)
            end = len(block) if end < 0 else end
        yield at, end
        at = end


def manifest(blocks: DataFrame) -> DataFrame:
    """(segment, start, bytes, digest): the records that a replica's blocks(segment, start, block) hold."""
    schema = pa.schema([("segment", pa.int64()), ("start", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for segment, start, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = block.as_py() or b""
                rows += [(segment or 0, (start or 0) + s, e - s, hashlib.sha256(raw[s:e]).hexdigest()) for s, e in spans(raw)]
            yield common.batch(schema, *([r[c] for r in rows] for c in range(4)))

    common.prepare(blocks.sparkSession)
    return blocks.select("segment", "start", "block").mapInArrow(work, "segment long, start long, bytes long, digest string")


def with_faults(blocks: DataFrame, altered: str, lost: str) -> DataFrame:
    """A replica for drills: records whose digest begins with ``altered`` end in another byte, those with ``lost`` are zeros."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for block in b.column(2):
                raw = bytearray(block.as_py())
                for s, e in spans(bytes(raw)):
                    digest = hashlib.sha256(raw[s:e]).hexdigest()
                    if digest.startswith(lost):
                        raw[s:e] = bytes(e - s)
                    elif digest.startswith(altered):
                        raw[e - 1 : e] = b"X"
                made.append(bytes(raw))
            yield common.batch(_BLOCKS_ARROW, b.column(0), b.column(1), made)

    return blocks.select("segment", "start", "block").mapInArrow(work, _BLOCKS)


def _depth(greatest: int) -> int:
    """Levels above nodes numbered 0 to ``greatest`` until one is left."""
    n = 0
    while greatest:
        greatest, n = greatest // FAN, n + 1
    return n


def tree(digests: DataFrame) -> list[tuple[DataFrame, tuple[Column, Column]]]:
    """Of digests(side, segment, start, digest) the nodes (side, a, b, hash) of every level, leaves first, each with the node
    (a, b) above; the last level is one root a side."""
    zero, a, b = F.lit(0).cast("long"), F.col("a"), F.col("b")
    most = digests.agg(F.max(F.floor(F.col("start") / RANGE)), F.min(F.floor(F.col("start") / RANGE)), F.max("segment"), F.min("segment")).first()
    inner, outer = (_depth(max(abs(most[i] or 0), abs(most[i + 1] or 0))) for i in (0, 2))
    above = [(a, F.floor(b / FAN).cast("long"))] * inner + [(a, zero)] + [(F.floor(a / FAN).cast("long"), zero)] * outer + [(zero, zero)]
    ordered = lambda *by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in by])), "|"), 256)
    leaf = digests.groupBy("side", F.col("segment").alias("a"), F.floor(F.col("start") / RANGE).cast("long").alias("b")).agg(ordered("start", "digest").alias("hash"))
    levels = [common.stored(leaf, "level0")]
    for k, up in enumerate(above):
        made = levels[-1].groupBy("side", up[0].alias("up_a"), up[1].alias("up_b")).agg(ordered("a", "b", "hash").alias("hash"))
        levels.append(common.stored(made.select("side", F.col("up_a").alias("a"), F.col("up_b").alias("b"), "hash"), f"level{k + 1}"))
    return list(zip(levels, [*above, (zero, zero)]))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(segment, start, bytes, kind, digest, found): what differs in right from left, both (segment, start, bytes, digest);
    kind is altered, missing or extra."""
    common.prepare(left.sparkSession)
    columns = [F.coalesce("segment", F.lit(0)).cast("long").alias("segment"), F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("bytes").cast("long").alias("bytes"), "digest"]
    both = common.stored(left.select(F.lit(0).alias("side"), *columns).unionByName(right.select(F.lit(1).alias("side"), *columns)), "manifests")
    differ = None
    for k, (level, up) in reversed(list(enumerate(tree(both)))):
        if differ is not None:
            inside = differ.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            level = level.join(inside, (up[0] == F.col("up_a")) & (up[1] == F.col("up_b")), "left_semi")
        hash_of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
        differ = level.groupBy("a", "b").agg(hash_of(0).alias("l"), hash_of(1).alias("r")).where("NOT l <=> r").select("a", "b")
        differ = common.stored(differ, f"differ{k}")
    rows = both.withColumn("b", F.floor(F.col("start") / RANGE).cast("long")).join(differ.select(F.col("a").alias("segment"), "b"), ["segment", "b"], "left_semi")
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    rows = rows.groupBy("segment", "start", "digest").agg(F.max("bytes").alias("bytes"), (count(0) - count(1)).alias("more")).where("more <> 0")
    rows = rows.select("segment", "start", "digest", "bytes", (F.col("more") < 0).cast("int").alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("more"))).alias("k"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("segment", "start", "side").orderBy("digest", "k")))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pair = rows.groupBy("segment", "start", "rank").agg(count(0).alias("l"), count(1).alias("r"), of(0, "digest").alias("digest"), of(1, "digest").alias("found"), F.coalesce(of(0, "bytes"), of(1, "bytes")).alias("bytes"))
    kind = F.when(F.col("r") == 0, "missing").when(F.col("l") == 0, "extra").otherwise("altered")
    return pair.select("segment", "start", "bytes", kind.alias("kind"), "digest", "found")
