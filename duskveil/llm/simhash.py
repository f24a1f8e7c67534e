"""SimHash fingerprints and near-duplicate classes by multi-index hashing.

Two 64-bit fingerprints that differ in at most 4 bits differ in at most 2 bits in one of their 32-bit halves. Each half
is a table; both sides enter it under every value of their Hamming ball of radius 1 (33 keys), so values at distance 2 or
less meet. Whole distances are then verified. A pair of random fingerprints meets by chance with probability 2 x 529 / 2^32,
so n fingerprints have about n^2 / 8 million such pairs: 25 to a fingerprint at a hundred million, 250 at a billion.

``near_classes`` takes the pairs that these tables find, and goes on to similarities that sign bits cannot separate: at a
Jaccard similarity of 0.8 fingerprints differ in 9 bits at the median and up to 18. Such pairs meet in further tables whose
segments are tuples of min-wise hashes of the shingle set (equal with the similarity's power), sifted on 128 min-wise
values. All pairs of both are decided on their whole shingle sets.

Null text is the empty text. A text of fewer words than a shingle is one shingle; one of no words has fingerprint zero.
Repeated rows each get their row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, linkage

SEED = 42
#: Values of a min-wise signature, values of a segment, segments. At similarity 0.8: found with probability 0.998.
VALUES, ROWS, SEGMENTS = 128, 5, 16
#: Standard errors under the limit at which 128 values still leave a pair to its whole sets; bytes of sets of one block.
MARGIN, BLOCK_BYTES = 4.5, 16 << 20


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of k words, repeats included; of all words where there are fewer."""
    words = common.words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(start[: 1 - k].tolist(), end[k - 1 :].tolist())], np.uint64, len(words) - k + 1)


def fingerprint(hashed: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    n = len(hashed)
    if not n:
        return 0
    octets = hashed.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 512:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ of for i in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint): the fingerprint of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(shingle_hashes(t, k)) for t in common.text_bytes(b.column(1))], np.uint64)
            yield common.batch(schema, b.column(0), common.signed(made))

    common.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(common.tidy(work), "doc_id long, fp long")


def ball_keys(fp: Column) -> Column:
    """The 66 table keys of a fingerprint: each half's Hamming ball of radius 1, the half's number in bit 32."""
    half = lambda shift, tag: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(tag << 32))
    masks = F.array(*[F.lit(m).cast("long") for m in (0, *(1 << i for i in range(32)))])
    ball = lambda x: F.transform(masks, lambda m: x.bitwiseXOR(m))
    return F.concat(ball(half(0, 0)), ball(half(32, 1)))


def _within(most: int):
    def near_of(ids: np.ndarray, _):
        own = ids.view(np.uint64)
        return lambda i, others: np.bitwise_count(own[others] ^ own[i]) <= most

    return near_of


def hamming_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Links between distinct fingerprints of fps(fp) at ``most`` or fewer bits; at most 4, as the tables are built."""
    if not 0 <= most <= 4:
        raise ValueError("the tables find distances up to 4")
    table = fps.select(F.explode(ball_keys(F.col("fp"))).alias("key"), F.col("fp").alias("id"))
    return linkage.bucket_links(table, _within(most))


def simhash_classes(docs: DataFrame, k: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies long): each row's fingerprint as 16 hex digits, the smallest doc_id
    reachable over links of fingerprints, and the rows that share the fingerprint."""
    made = common.stored(fingerprints(docs, k), "fingerprints")
    classes = common.stored(made.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "classes")
    roots = linkage.components(hamming_links(classes.select("fp"), most)).select(F.col("id").alias("fp"), "root")
    named = common.stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.hot_join(named, lowest, "root").select("fp", "component_id", "copies")
    made = common.hot_join(made, named, "fp", counts=classes.select("fp", F.col("copies").alias("count")))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


# --- similarity classes -----------------------------------------------------------------------------------------------


def _probes() -> np.ndarray:
    """For every bin a fixed order of the bins to borrow from where it is empty."""
    return np.stack([np.random.default_rng(7 + j).permutation(VALUES) for j in range(VALUES)])


def minwise(hashed: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """128 min-wise values of a set of hashes: the smallest in each bin of one permutation; an empty bin borrows from the
    first full one in its own fixed order."""
    v = np.unique(common.mix(hashed))
    shift = np.uint64(64 - VALUES.bit_length() + 1)
    bins = (v >> shift).astype(np.int64)
    at = np.searchsorted(bins, np.arange(VALUES))
    full = np.zeros(VALUES, bool)
    full[bins] = True
    out = v[np.minimum(at, len(v) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        out[empty] = out[probes[empty, full[probes[empty]].argmax(1)]]
    return out


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, mark, fp bigint, id, keys array<bigint>, payload binary): fp is the text's fingerprint; id is a hash of the
    shingle set, so equal sets are one class; mark is a hash of the text; payload holds the set's size and its min-wise
    values."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64()), ("id", pa.int64()), ("keys", pa.list_(pa.int64())), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes()
        for b in batches:
            fps, ids, keys, loads = [], [], [], []
            for t in common.text_bytes(b.column(1)):
                hashed = shingle_hashes(t, k)
                fps.append(fingerprint(hashed))
                got = np.unique(hashed)
                ids.append(xxhash.xxh64_intdigest(got.tobytes()))
                if not len(got):
                    keys.append([])
                    loads.append(b"")
                    continue
                sig = minwise(got, probes)
                bands = sig[: ROWS * SEGMENTS].reshape(SEGMENTS, ROWS)
                keys.append(np.array([xxhash.xxh64_intdigest(bytes([s]) + bands[s].tobytes()) for s in range(SEGMENTS)], np.uint64).view(np.int64).tolist())
                loads.append(_packed(len(got), sig))
            yield common.batch(schema, b.column(0), b.column(2), common.signed(np.array(fps, np.uint64)), common.signed(np.array(ids, np.uint64)), keys, loads)

    common.prepare(docs.sparkSession)
    return _marked(docs).mapInArrow(common.tidy(work), "doc_id long, mark long, fp long, id long, keys array<long>, payload binary")


def _marked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))


def _packed(size: int, sig: np.ndarray) -> bytes:
    """The set's size and the low 16 bits of its min-wise values."""
    return size.to_bytes(4, "big") + (sig & np.uint64(0xFFFF)).astype("<u2").tobytes()


_SKETCH = np.dtype([("size", ">u4"), ("sig", "<u2", VALUES)])


def _doubtful(least: float):
    """The pairs that may have a similarity of ``least``: sizes allow it (exactly), and the share of equal min-wise values
    is no more than ``MARGIN`` standard errors under it. Sets of few shingles repeat values, which widens the error."""

    def near_of(ids: np.ndarray, payload: list):
        held = np.frombuffer(b"".join(payload), _SKETCH)
        size, sig = held["size"].astype(np.float64), held["sig"]
        full = VALUES * -np.expm1(size * np.log1p(-1 / VALUES))  # bins with a value of their own
        more = VALUES / full - 1  # bins that borrow from each
        error = np.sqrt(least * (1 - least) * full * (1 + 3 * more + more * more)) / VALUES

        def near(i: int, others: np.ndarray) -> np.ndarray:
            fits = np.minimum(size[others], size[i]) / np.maximum(size[others], size[i]) >= least
            fits[fits] = (sig[others[fits]] == sig[i]).mean(1) >= least - MARGIN * np.maximum(error[others[fits]], error[i])
            return fits

        return near

    return near_of


def _similar(least: float):
    """The pairs whose shingle sets have a similarity of ``least`` or more, counted on the whole sets."""

    def near_of(ids: np.ndarray, payload: list):
        head = _SKETCH.itemsize
        doubtful = _doubtful(least)(ids, [p[:head] for p in payload])
        sets = [np.frombuffer(p, "<u8", offset=head) for p in payload]
        size = np.fromiter(map(len, sets), np.int64, len(sets))

        def near(i: int, others: np.ndarray) -> np.ndarray:
            out = doubtful(i, others)
            left = others[out]
            exact = np.zeros(len(left), bool)
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                flat = np.concatenate([sets[j] for j in part])
                hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
                both = np.add.reduceat(hit, np.cumsum(size[part]) - size[part], dtype=np.int64)
                exact[at : at + 256] = both / (size[part] + size[i] - both) >= least
            out[out] = exact
            return out

        return near

    return near_of


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, payload binary): of docs(id, text) the size, min-wise values and sorted hashes of the shingle set."""
    schema = pa.schema([("id", pa.int64()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes()
        for b in batches:
            got = [np.unique(shingle_hashes(t, k)) for t in common.text_bytes(b.column(1))]
            yield common.batch(schema, b.column(0), [_packed(len(g), minwise(g, probes)) + g.astype("<u8").tobytes() for g in got])

    return docs.select("id", "text").mapInArrow(common.tidy(work), "id long, payload binary")


def exact_links(docs: DataFrame, classes: DataFrame, doubts: DataFrame, k: int, least: float) -> DataFrame:
    """Links (a, b) between classes(id, low, mark, size) of a similarity of ``least`` or more, on whole shingle sets.

    doubts are links that hold every pair in question together; each of their components is cut into blocks of about
    ``BLOCK_BYTES`` of sets, which meet as in ``linkage.block_links``, so a set travels once unless its component is large.
    """
    groups = linkage.components(doubts).withColumnRenamed("root", "key")
    groups = groups.unionByName(groups.select("key", F.col("key").alias("id"))).distinct()
    asked = common.stored(groups.join(classes.select("id", "low", "mark", "size"), "id"), "asked")
    sizes = asked.groupBy("key").agg(F.ceil(F.sum(F.col("size") * 8 + _SKETCH.itemsize) / BLOCK_BYTES).cast("long").alias("blocks"))
    rows = asked.select("id", F.col("low").alias("doc_id"), "mark")
    texts = common.sieved(_marked(docs), rows, ["doc_id", "mark"])[0]  # of the others no text is shuffled
    row = ["mark", "number", "unnumbered"]
    texts, rows = (x.select("*", F.coalesce("doc_id", F.lit(0)).alias("number"), F.col("doc_id").isNull().alias("unnumbered")).drop("doc_id") for x in (texts, rows))
    texts = texts.join(rows, row).dropDuplicates([*row, "id"]).select("id", "text")
    items = common.stored(_sets(texts, k), "sets")
    units = common.hot_join(asked, sizes, "key").select("key", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), (F.col("blocks") - 1).alias("last"))
    return linkage.block_links(common.stored(units, "units"), _similar(least), items)


def sign_links(classes: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) between classes(id, fp), a stored table, that connect all whose fingerprints differ in ``most`` bits or
    fewer; classes of one fingerprint are linked to the smallest of them."""
    led = common.stored(classes.groupBy("fp").agg(F.min("id").alias("lead"), F.count("*").alias("count")), "led")
    same = common.hot_join(classes.select("id", "fp"), led.select("fp", "lead"), "fp", counts=led.select("fp", "count"))
    same = same.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    links = common.stored(hamming_links(led.select("fp"), most), "links")
    for end in ("a", "b"):
        links = common.hot_join(links, led.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_id")), end)
        links = common.stored(links, "links") if end == "a" else links
    return links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(same)


def near_classes(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, mark, component_id): classes of texts whose sets of k-word shingles have a similarity of ``least`` or more.

    The similarity is that of the whole sets; fingerprints at 4 bits or fewer and, for pairs further apart, min-wise values
    only find the pairs to compare. Texts without words are one class with equal sets, linked to nothing else. mark is
    xxhash64 of the text, null as empty.
    """
    made = common.stored(signatures(docs, k), "signatures")
    one = F.min(F.struct("doc_id", "mark", "fp"))  # a row of the class, whose text gives the set and the fingerprint
    classes = made.groupBy("id").agg(F.min("doc_id").alias("low"), one.alias("one"), F.first("keys").alias("keys"), F.first("payload").alias("payload"))
    size = F.conv(F.hex(F.substring("payload", 1, 4)), 16, 10).cast("long")
    classes = common.stored(classes.withColumn("size", size), "classes")
    signs = sign_links(common.stored(classes.where("size > 0").select("id", F.col("one.fp").alias("fp")), "signs"))
    table = classes.select(F.explode("keys").alias("key"), "id")
    far = linkage.bucket_links(table, _doubtful(least), items=classes.select("id", "payload"))
    doubts = common.stored(signs.unionByName(far), "doubts")
    rows = classes.select("id", F.col("one.doc_id").alias("low"), F.col("one.mark").alias("mark"), "size")
    roots = linkage.components(exact_links(docs, rows, doubts, k, least))
    named = common.stored(classes.select("id", "low").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = common.hot_join(named, lowest, "root").select("id", "component_id")
    return common.hot_join(made.select("doc_id", "mark", "id"), named, "id").select("doc_id", "mark", "component_id")


def deduplicated(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their class; of repeated rows one.

    Rows without doc_id stay: nothing tells which of them should.
    """
    found = common.stored(near_classes(docs, k, least).where("doc_id is not null"), "near")
    row = [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row[0].alias("k1"), row[1].alias("k2"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("k1"), F.col("mark").alias("k2")).distinct()
    twice = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("k1"), F.col("mark").alias("k2")).count().where("count > 1").drop("count")
    again = not twice.isEmpty()
    met, rest = common.sieved(keyed, gone.unionByName(twice) if again else gone, ["k1", "k2"])  # most rows stay and are not shuffled
    kept = met.join(gone, ["k1", "k2"], "left_anti")
    if again:
        one = met.join(twice, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        kept = kept.join(twice, ["k1", "k2"], "left_anti").unionByName(one)
    return rest.unionByName(kept).select("row.*")
