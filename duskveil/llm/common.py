"""What the operators of this subpackage share: shipping code, bounded Arrow batches, scratch tables, word hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import BATCH_BYTES, prepare  # noqa: F401

#: A key is hot if it has more rows than this, and more than one in HOT_KEYS of all: so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1 << 16, 4096
#: Bits of a sieve, sent to all tasks as 64 to a row: half a million rows at most.
SIEVE_BITS = 1 << 25


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where none is set and all tasks run on it, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/duskveil-{sc.applicationId}"
    return folder.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duskveil/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(many: DataFrame, one: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined to the row that one has for each value of ``on``, with no task that holds all rows of a hot key.

    Keys of over ``HOT_ROWS`` rows that are over 1/``HOT_KEYS`` of the table, ``HOT_KEYS`` of them at most, meet their rows
    of ``one`` by broadcast where many is read; the others are shuffled. ``counts`` (on, count) may be given; many should
    be a stored table, as it is read again, and hold no null keys.
    """
    total = many.count()
    if total <= HOT_ROWS:
        return many.join(one, on, how)
    counts = counts if counts is not None else many.groupBy(on).count()
    hot = [r[0] for r in counts.where(F.col("count") > max(HOT_ROWS, total // HOT_KEYS)).select(on).collect()]
    if not hot:
        return many.join(one, on, how)
    keys = F.broadcast(many.sparkSession.createDataFrame([(k,) for k in hot], many.select(on).schema))
    theirs = F.broadcast(one.join(keys, on, "left_semi"))
    return many.join(keys, on, "left_semi").join(theirs, on, how).unionByName(many.join(keys, on, "left_anti").join(one, on, how))


def sieved(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(met, rest): the rows whose values of ``on`` the table keys(on) may hold, and those whose values it surely does not.

    Every key sets one bit of ``SIEVE_BITS``, so what is sent to all tasks is bounded whatever the number of keys; with more
    keys more rows are met in vain. A join of met with keys then shuffles few rows and tells exactly. Nulls are values.
    """
    place = lambda df: F.pmod(F.xxhash64(*[df[c] for c in on]), F.lit(SIEVE_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    words = keys.select(place(keys).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    bit = place(rows)
    tested = rows.join(F.broadcast(words), F.shiftright(bit, 6) == words["word"], "left")
    held = F.coalesce(F.getbit(words["bits"], F.pmod(bit, F.lit(64)).cast("int")), F.lit(0)) == 1
    mine = [rows[c] for c in rows.columns]
    return tested.where(held).select(*mine), tested.where(~held).select(*mine)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each string of an Arrow column; null gives b''."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; bytes.lower and bytes.split do exactly this."""
    return text.lower().split()


def give_back() -> None:
    """Returns to the system what this Python process has freed; glibc and Arrow's allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def tidy(work: Callable) -> Callable:
    """work over Arrow batches, after which its worker, which lives on for other tasks, keeps no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def hashes(items: Iterable[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 0) of byte strings."""
    return np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, n)


def signed(x: np.ndarray) -> pa.Array:
    """An unsigned 64-bit array as Spark's bigint."""
    return column(np.ascontiguousarray(x).view(np.int64), pa.int64())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of this schema from arrays or lists."""
    return pa.RecordBatch.from_arrays([column(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_PLAIN = {pa.int32(): np.int32, pa.int64(): np.int64, pa.float32(): np.float32, pa.float64(): np.float64}


def column(values, kind: pa.DataType) -> pa.Array:
    """What pa.array(values, kind) makes, from buffers where these are plain: pa.array loads pandas, some 25 MB in every
    Python worker."""
    if isinstance(values, pa.Array):
        return values
    made = None
    if kind in _PLAIN or pa.types.is_boolean(kind):
        made = _numbers(values, kind)
    elif pa.types.is_list(kind) and not any(v is None for v in values):
        ends = np.cumsum([0, *map(len, values)])
        made = pa.ListArray.from_arrays(column(ends, pa.int32()), column([x for v in values for x in v], kind.value_type))
    elif pa.types.is_binary(kind) or pa.types.is_string(kind):
        made = _strings(values, kind)
    return pa.array(values, kind) if made is None else made


def numbers(column: pa.Array) -> np.ndarray:
    """column.to_numpy, which loads pandas too; numbers without nulls are read from their buffer."""
    kind = _PLAIN.get(column.type)
    if kind is None or column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return np.frombuffer(column.buffers()[1], kind, len(column), column.offset * np.dtype(kind).itemsize) if len(column) else np.empty(0, kind)


def _bits(x: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(x, bitorder="little"))


def _filled(values, blank) -> tuple[list, pa.Buffer | None]:
    """values with blank in place of None, and the bitmap of the others where there is a None."""
    known = [v is not None for v in values]
    return (values, None) if all(known) else ([v if v is not None else blank for v in values], _bits(np.array(known)))


def _numbers(values, kind: pa.DataType) -> pa.Array | None:
    valid = None
    if not isinstance(values, np.ndarray):
        values, valid = _filled(values, 0)
        values = np.array(values, None if len(values) else bool if pa.types.is_boolean(kind) else np.int64)
    if pa.types.is_boolean(kind):
        return pa.Array.from_buffers(kind, len(values), [valid, _bits(values)]) if values.dtype == bool else None
    fit = np.ascontiguousarray(values, _PLAIN[kind]) if values.ndim == 1 and values.dtype.kind in "if" else None
    if fit is None or fit.dtype != values.dtype and len(fit) and not np.array_equal(fit, values):  # pa.array tells what is wrong
        return None
    return pa.Array.from_buffers(kind, len(fit), [valid, pa.py_buffer(fit)])


def _strings(values, kind: pa.DataType) -> pa.Array | None:
    of = bytes if pa.types.is_binary(kind) else str
    raw, valid = _filled(values, of())
    if not all(type(v) is of for v in raw):
        return None
    raw = raw if of is bytes else [v.encode() for v in raw]
    ends = np.cumsum([0, *map(len, raw)])
    if ends[-1] > np.iinfo(np.int32).max:
        return None
    return pa.Array.from_buffers(kind, len(raw), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(raw))])


def greatest(df: DataFrame, value: str, key: str, most: int) -> DataFrame:
    """The rows of df with the greatest positive values, about ``most`` at most, without a sort or a single task.

    Values fall into some thousand buckets of equal ratio; whole buckets are taken from the top, and of the one that no
    longer fits a share by a hash of the key.
    """
    bucket = F.floor(F.log2(F.col(value)) * 16).cast("int")
    sizes = sorted(((r[0], r[1]) for r in df.groupBy(bucket.alias("b")).count().collect()), reverse=True)  # a row per bucket
    left, last, share = most, None, 0.0
    for b, n in sizes:
        last, share = b, min(1.0, 0.97 * left / n) if n > left else 1.0
        if share < 1:
            break
        left -= n
    if last is None:
        return df.limit(0)
    in_part = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(10**9)) < int(share * 10**9)
    return df.where((bucket > last) | ((bucket == last) & in_part))
