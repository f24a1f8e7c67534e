"""Links inside buckets of a multi-index table, and connected components, without all pairs and without the driver.

A bucket table has rows (key, id): two ids that share a key are candidates. ``bucket_links`` returns verified links that
connect, within every bucket, exactly what all verified pairs of that bucket would connect (a spanning forest), so a
bucket of K close items gives at most K - 1 links. Rows are dealt by ranges of (key, id), so a hot key lies in many tasks;
its members are cut into blocks of ``block``, and no unit of work holds more than two blocks.

A bucket of many blocks is not compared whole. First each block is linked within itself; then one member of each component
found so far; and then only members outside the bucket's largest component meet the bucket's other blocks, as all links
that are left must have such a member at an end. A group of K close items costs K comparisons and K / ``block`` leaders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links that are followed in the driver: two numbers each, a quarter of a MB. Larger graphs are shrunk to so many first.
FEW = 1 << 14

_MEMBER = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("run", pa.int64()), ("part", pa.int32())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key occurs again, with their place in the key's run and the run's length; of the
    partition's first and last run, which may go on elsewhere, all rows, with length -1."""
    part = TaskContext.get().partitionId()
    now, held, first = None, [], True

    def made(key: np.ndarray, item: np.ndarray, place: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
        return common.batch(_MEMBER, key, item, place, run, np.full(len(key), part, np.int32))

    def closed(edge: bool) -> Iterator[pa.RecordBatch]:
        item = np.concatenate(held)
        if edge or len(item) > 1:
            yield made(np.full(len(item), now), item, np.arange(len(item)), np.full(len(item), -1 if edge else len(item)))

    for b in batches:
        if not b.num_rows:
            continue
        key, item = (common.numbers(b.column(i)) for i in (0, 1))
        if now is not None and key[0] != now:
            yield from closed(first)
            held, first = [], False
        now = key[0]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        held.append(item[: cuts[0]] if len(cuts) else item)
        if len(cuts):
            yield from closed(first)
            first = False
            size = np.diff(cuts)
            run = np.repeat(size, size)
            inner = slice(cuts[0], cuts[-1])
            place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            again = run > 1
            yield made(key[inner][again], item[inner][again], place[again], run[again])
            now, held = key[-1], [item[cuts[-1] :]]
    if held:
        yield from closed(True)


def blocks_of(table: DataFrame, block: int) -> DataFrame:
    """(key, id, block, last): the rows of table(key, id) whose key occurs again, each key's cut into blocks 0 to last."""
    spark = common.prepare(table.sparkSession)
    made = table.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(common.tidy(_runs), "key long, id long, place long, run long, part int")
    made = common.stored(made, "runs")
    edges = sorted((r["key"], r["part"], r["count"]) for r in made.where("run < 0").groupBy("key", "part").count().collect())  # two rows a partition
    total: dict[int, int] = {}
    rows = []
    for key, part, n in edges:
        rows.append((key, part, total.get(key, 0)))
        total[key] = total.get(key, 0) + n
    outer = spark.createDataFrame([(k, p, s, total[k]) for k, p, s in rows], "key long, part int, before long, whole long")
    split = made.where("run < 0").join(F.broadcast(outer), ["key", "part"])  # only these need to know of other partitions
    split = split.where("whole > 1").select("key", "id", (F.col("place") + F.col("before")).alias("place"), F.col("whole").alias("run"))
    made = made.where("run > 1").select("key", "id", "place", "run").unionByName(split)
    return made.select("key", "id", F.floor(F.col("place") / block).cast("long").alias("block"), F.floor((F.col("run") - 1) / block).cast("long").alias("last"))


def forest(ids: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that near(i, others) tells (a boolean for each of others).

    Leaders first: an item is compared with all others only while it is not yet connected to a leader; what then is
    still apart is compared item by item, leaving out what has come together meanwhile.
    """
    n = len(ids)
    comp = np.arange(n)
    out: list[tuple[int, int]] = []

    def join(i: int, found: np.ndarray) -> None:
        for c in np.unique(comp[found]):
            if c != comp[i]:
                out.append((int(ids[i]), int(ids[found[comp[found] == c][0]])))
        merged = np.isin(comp, np.append(comp[found], comp[i]))
        comp[merged] = comp[merged].min()

    led = np.zeros(n, bool)
    every = np.arange(n)
    for i in range(n):
        if led[i]:
            continue
        found = every[near(i, every)]
        found = found[found != i]
        led[i] = True
        led[found] = True
        if len(found):
            join(i, found)
    if len(np.unique(comp)) > 1:
        for i in range(n):
            others = every[i + 1 :]
            others = others[comp[others] != comp[i]]
            if len(others):
                found = others[near(i, others)]
                if len(found):
                    join(i, found)
    return out


def bucket_links(table: DataFrame, near_of: Callable, block: int = 512, items: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among ids that share a key of table(key, id) and are near.

    near_of(ids, payload) gives the near function of ``forest`` for one unit; payload holds what items(id, payload
    binary) has of the ids, or None. Empty tables give no links; a repeated row is the same as one.
    """
    return block_links(blocks_of(table, block), near_of, items)


def block_links(members: DataFrame, near_of: Callable, items: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the ids of each key of members(key, id, block, last), a stored table whose keys are cut into
    blocks 0 to last. near_of and items as in ``bucket_links``."""
    own = members.select("key", "id", F.col("block").alias("i"), F.col("block").alias("j"))
    links = common.stored(unit_links(own, near_of, items), "links")
    wide = members.where("last > 0")
    if wide.isEmpty():
        return links

    def rooted(links: DataFrame) -> DataFrame:
        roots = wide.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))
        return common.stored(roots.select("key", "id", "block", "last", "root"), "rooted")

    def apart(rows: DataFrame) -> DataFrame:
        """(key, main, others): of the keys that hold several components the largest one, and the members outside it."""
        sizes = rows.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"))
        return sizes.select("key", F.col("top.root").alias("main"), (F.col("n") - F.col("top.count")).alias("others")).where("others > 0")

    size = wide.groupBy("key", "block").count().agg(F.max("count")).first()[0]  # members of a block
    rows = rooted(links)
    led = common.hot_join(rows, apart(rows), "key").groupBy("key", "root").agg(F.min("id").alias("id"))
    led = common.stored(blocks_of(led.select("key", "id"), size), "leaders")
    pairs = led.select("key", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
    more = common.stored(unit_links(pairs.select("key", "id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), near_of, items), "links")
    links = common.stored(links.unionByName(more).distinct(), "links")
    rows = rooted(links)
    left = common.stored(apart(rows), "apart")
    if left.isEmpty():
        return links
    rows = common.hot_join(rows, left, "key").withColumn("groups", F.ceil(F.col("others") / size).cast("long"))
    group = F.pmod(F.xxhash64("id"), F.col("groups"))
    outside = rows.where("root <> main").select("key", "id", "last", group.alias("i"))
    met = outside.select("key", "id", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("j"))
    every = rows.select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("i"), F.col("block").alias("j"))
    return links.unionByName(unit_links(met.unionByName(every), near_of, items)).distinct()


def unit_links(units: DataFrame, near_of: Callable, items: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the ids of each unit (key, i, j) of units(key, id, i, j); near_of and items as above."""
    loaded = items is not None
    common.prepare(units.sparkSession)
    if loaded:
        units = units.join(items, "id").select("key", "id", "i", "j", "payload")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list | None]] = []
        now = None

        def flush() -> list[tuple[int, int]]:
            ids = np.concatenate([x[0] for x in held])
            ids, first = np.unique(ids, return_index=True)
            payload = None
            if held[0][1] is not None:
                flat = [p for x in held for p in x[1]]
                payload = [flat[k] for k in first]
            return forest(ids, near_of(ids, payload)) if len(ids) > 1 else []

        for b in batches:
            if not b.num_rows:
                continue
            k, i, j = (common.numbers(b.column(n)) for n in ("key", "i", "j"))
            ids = common.numbers(b.column("id"))
            load = b.column("payload") if loaded else None
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            links: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
                unit = (k[s], i[s], j[s])
                if now is not None and unit != now:
                    links += flush()
                    held.clear()
                now = unit
                held.append((ids[s:e], load.slice(s, e - s).to_pylist() if load is not None else None))
            yield common.batch(_LINK, [x[0] for x in links], [x[1] for x in links])
        if held:
            links = flush()
            yield common.batch(_LINK, [x[0] for x in links], [x[1] for x in links])

    links = units.mapInArrow(common.tidy(work), "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _followed(links: pa.Table) -> pa.Table:
    """(id, root) of links(u, v), by union to the smaller root; roots themselves have no row."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    for a, b in zip(*(column.to_pylist() for column in links.columns)):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pa.table({"id": pa.array(list(up), pa.int64()), "root": pa.array([root(x) for x in list(up)], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id that has a link, by alternating large-star and small-star.

    A node's links are never gathered: each step is a minimum per node (combined before the shuffle) joined back, the
    centres of large stars by broadcast (``common.hot_join``). Steps shrink the graph; once ``FEW`` links are left these
    few are followed in the driver, whatever the graph's size was.
    """
    edges = common.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state, n = None, edges.count()
    while True:
        if n <= FEW:
            return common.stored(edges.sparkSession.createDataFrame(_followed(edges.select("u", "v").toArrow())), "roots")
        join = lambda many, one, counts: common.hot_join(many, one, "u", counts=counts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        large = join(both, low.select("u", F.least("u", "m").alias("m")), low.select("u", "count"))
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = common.stored(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
        small = join(large, low.select("u", "m"), low.select("u", "count"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = common.stored(small.where("u > v").distinct(), "edges")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).cast("string")).first()
        if (row[0], row[1]) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state, n = (row[0], row[1]), row[0]
