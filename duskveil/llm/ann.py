"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and the codebooks are fitted by k-means on a bounded sample (``FIT`` vectors, or four to a list where
that is more, chosen by a hash of vec_id); every vector is then indexed: its list is that of the nearest centroid, its code
the nearest codeword of each part of the residual. There is a list for every ``PER_LIST`` vectors, and from ``LISTS`` lists
on as many as the root of the vectors' number. A query probes the lists whose centroids have the largest inner products
with it: as many as give ``RECALL`` of the true neighbours among vectors that took no part in the fitting (``TUNE`` at
most), so clustered vectors are found in few lists and isotropic ones in more; and further ones until they hold a vector
more than the neighbours asked for, or none is left. An asymmetric table of inner products with the codewords ranks the
entries, and the best ``RERANK``, and all that two standard errors of the approximation cannot tell from them, are scored
exactly, in double precision, on the original vectors.

Equal vectors are one entry of the index that keeps its smallest ids (one more than the neighbours asked for), which is
exact, as ties go to the smaller id. Entries are laid out in cells of about ``BLOCK``: small lists that lie close together
share one, large lists are cut into several. A query's vector travels once to each cell that holds a list it probes, and a
task holds one cell, never a list. Vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part. Empty tables give empty results. A repeated vec_id counts as another vector of that id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that fitting reads, vectors kept out of it that set the number of probes, entries per list aimed at, lists from which
#: on their number is the root of the vectors', parts of a residual, words of a codebook.
FIT, TUNE, PER_LIST, LISTS, PARTS, WORDS = 16384, 8192, 256, 4096, 16, 64
#: Recall on the vectors kept out that sets how many lists a query probes; least entries that a query reranks in each cell;
#: entries of a cell; queries scored at a time; results that a task holds before it drops all but each query's best.
RECALL, RERANK, BLOCK, QUERIES, HELD = 0.96, 20, 4096, 32, 1 << 20
#: Numbers in a matrix of distances or inner products that is computed at a time; parts of the copies of one vector.
CELLS, COPIES = 1 << 23, 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    made = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    size = made.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return made.where(F.size("v") == (size[0] if size else 0))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid of each vector, its squared distance less the vector's own square), a stretch at a time."""
    own = (c * c).sum(1)
    at, d = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    step = max(1, CELLS // max(1, len(c)))
    for s in range(0, len(x), step):
        part = own - 2 * (x[s : s + step] @ c.T)
        at[s : s + step] = part.argmin(1)
        d[s : s + step] = part[np.arange(len(part)), at[s : s + step]]
    return at, d


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centroids (fewer where there are fewer vectors); an empty one moves to a vector far from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        a, d = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        if (n == 0).any():
            far = np.argsort(-d)[: (n == 0).sum()]
            c[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return c


@dataclass
class Index:
    coarse: np.ndarray  # lists x d
    books: list[np.ndarray]  # of each part of the residual: words x width
    cuts: np.ndarray
    probes: int
    sigma: float  # of the error of an approximate inner product with a unit vector

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.coarse)[0]

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        r = x - self.coarse[own]
        out = np.empty((len(x), len(self.books)), np.uint8)
        for p, book in enumerate(self.books):
            out[:, p] = nearest(r[:, self.cuts[p] : self.cuts[p + 1]], book)[0]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x words: inner products of the query's parts with the codewords."""
        out = np.zeros((len(q), len(self.books), max(len(b) for b in self.books)), np.float32)
        for p, book in enumerate(self.books):
            out[:, p, : len(book)] = q[:, self.cuts[p] : self.cuts[p + 1]] @ book.T
        return out


def layout(coarse: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell of each list, its cells): lists in the order of their main direction, small ones packed together."""
    middle = coarse - coarse.mean(0)
    order = np.argsort(middle @ np.linalg.eigh(middle.T @ middle)[1][:, -1], kind="stable")
    cell, cells, at, room = np.zeros(len(held), np.int64), np.maximum(1, -(-held // BLOCK)), 0, 0
    for k in order.tolist():
        if held[k] > room:
            at, room = at + 1, BLOCK
        cell[k] = at
        if cells[k] > 1:
            at, room = at + int(cells[k]) - 1, 0
        else:
            room -= int(held[k])
    return cell, cells


def fit(vectors: DataFrame, n: int, most: int | None = None, seed: int = 5) -> Index | None:
    """Fits on about ``most`` (``FIT``, or four to a list) of n vectors(vec_id, v); sets the probes on ``TUNE`` others at most."""
    lists = max(1, min(n // PER_LIST, max(LISTS, isqrt(n))))
    most = (most or max(FIT, 4 * lists)) + TUNE
    share = min(1.0, most / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(10**9)) < int(1e9 * share)).orderBy("vec_id").limit(2 * most)
    got = rows.select(F.col("v").cast("array<float>")).toArrow().column(0).combine_chunks()
    if not len(got):
        return None
    x = got.flatten().to_numpy().reshape(len(got), -1).astype(np.float32)
    x = x[np.random.default_rng(seed).permutation(len(x))]
    kept = min(TUNE, len(x) // 3)
    out, x = x[:kept], x[kept:]
    coarse = kmeans(x, lists, seed)
    d = x.shape[1]
    cuts = np.linspace(0, d, min(PARTS, d) + 1).astype(int)
    index = Index(coarse, [], cuts, len(coarse), 0.0)
    if kept > 1 and len(coarse) > 1:  # otherwise all lists
        q = out[:256]
        inner = q @ out.T
        inner[np.arange(len(q)), np.arange(len(q))] = -np.inf
        true = np.argsort(-inner, axis=1)[:, : min(20, kept - 1)]
        place = np.argsort(np.argsort(-(q @ coarse.T), axis=1), axis=1)
        index.probes = int(np.quantile(place[np.arange(len(q))[:, None], index.lists(out)[true]], RECALL)) + 1
    own = index.lists(x)
    r = x - coarse[own]
    index.books = [kmeans(r[:, a:b], WORDS, seed + a + 1, 6) for a, b in zip(cuts[:-1], cuts[1:])]
    codes = index.codes(x, own)
    error = sum(((r[:, a:b] - book[codes[:, p]]) ** 2).sum(1) for p, (a, b, book) in enumerate(zip(cuts[:-1], cuts[1:], index.books)))
    index.sigma = float(np.sqrt(error.mean() / d))
    return index


_FOUND = "query_id long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query(vec_id, v) the k nearest found among vectors(vec_id, v), not itself.

    A query whose lists hold fewer than k + 1 vectors probes the next ones too, so every query gets k or all there are.
    """
    spark = common.prepare(vectors.sparkSession)
    # the smallest ids of each vector: of COPIES parts of its rows first, so that no group is gathered whole
    few = vectors.withColumn("h", F.xxhash64("v")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(COPIES)))
    few = few.withColumn("o", F.row_number().over(Window.partitionBy("h", "v", "part").orderBy("vec_id"))).where(F.col("o") <= k + 1)
    entries = few.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = common.stored(entries.select("v", "ids"), "entries")
    n = entries.count()
    index = fit(entries.select(F.element_at("ids", 1).alias("vec_id"), "v"), n)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sent = spark.sparkContext.broadcast(index)  # centroids (LISTS, or the root of n) and fixed codebooks
    probes = min(probes or index.probes, len(index.coarse))
    rerank = max(RERANK, k + 1)  # the query may be among them

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        schema = pa.schema([("list", pa.int32()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("code", pa.binary())])
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0)).astype(np.float32)
                at = own.lists(x)
                yield common.batch(schema, at.astype(np.int32), b.column(0), b.column(1), [c.tobytes() for c in own.codes(x, at)])

    indexed = common.stored(entries.mapInArrow(enter, "list int, v array<double>, ids array<long>, code binary"), "index")
    held, full = (np.zeros(len(index.coarse), np.int64) for _ in range(2))
    for at, rows, ids in indexed.groupBy("list").agg(F.count("*"), F.sum(F.size("ids"))).collect():  # a row per list
        held[at], full[at] = rows, ids
    cell, cells = layout(index.coarse, held)
    places = spark.sparkContext.broadcast((full, cell, cells))  # three numbers per list

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (full, cell, cells) = sent.value, places.value
        schema = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int64()), ("lists", pa.list_(pa.int32()))])
        for b in batches:
            q = _matrix(b.column(1)).astype(np.float32)
            step = max(1, CELLS // len(own.coarse))
            for s in range(0, len(q), step):
                best = np.argsort(-(q[s : s + step] @ own.coarse.T), axis=1, kind="stable")
                before = np.cumsum(full[best], axis=1) - full[best]
                need = np.maximum(probes, (before < k + 1).sum(1))
                row = np.repeat(np.arange(len(best)), need)
                lists = best[np.arange(best.shape[1]) < need[:, None]]
                many = cells[lists]  # a large list is asked for in all its cells
                row, lists = np.repeat(row, many), np.repeat(lists, many)
                at = cell[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(many) - many, many)
                order = np.lexsort((lists, at, row))
                row, lists, at = row[order], lists[order], at[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])]))
                grouped = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))
                take = pa.array(s + row[first])
                yield common.batch(schema, b.column(0).take(take), b.column(1).take(take), at[first], grouped)

    layer = spark.createDataFrame(pa.table({"list": pa.array(range(len(cell)), pa.int32()), "first": cell, "cells": cells}))
    place = F.pmod(F.xxhash64("v", F.lit(3)), F.col("cells"))
    both = indexed.join(F.broadcast(layer), "list").select((F.col("first") + place).alias("cell"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("query_id"), "v", "ids", "code", F.array("list").alias("lists"))
    asked = queries.mapInArrow(probe, "query_id long, v array<double>, cell long, lists array<int>")
    both = both.unionByName(asked.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("cell").sortWithinPartitions("cell", "asks", "query_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        now, parts = None, []
        x = ids = code = where = single = None

        def ready() -> None:
            nonlocal x, ids, code, where, single
            if x is None:
                x, ids = np.concatenate([_matrix(p.column("v")) for p in parts]), [np.array(i, np.int64) for p in parts for i in p.column("ids").to_pylist()]
                single = all(len(i) == 1 for i in ids)
                ids = np.concatenate(ids) if single else ids
                code = np.frombuffer(b"".join(c for p in parts for c in p.column("code").to_pylist()), np.uint8).reshape(len(x), -1).astype(np.int64)
                where = np.concatenate([p.column("lists").flatten().to_numpy() for p in parts])

        def answer(qid: np.ndarray, q: np.ndarray, lists: pa.ListArray) -> None:
            ready()
            inside, at = np.unique(where, return_inverse=True)
            asks = np.zeros((len(q), len(inside)), bool)  # queries x lists of the cell
            asks[np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), np.searchsorted(inside, lists.flatten().to_numpy())] = True
            for s in range(0, len(q), QUERIES):
                part, own_ids, open_ = q[s : s + QUERIES], qid[s : s + QUERIES], asks[s : s + QUERIES]
                some = np.flatnonzero(open_.any(0)[at])
                fine = part.astype(np.float32)
                table, mine = own.tables(fine), code[some]
                near = (fine @ own.coarse[inside].T)[:, at[some]]
                for p in range(table.shape[1]):
                    near += table[:, p, mine[:, p]]
                near[~open_[:, at[some]]] = -np.inf
                if near.shape[1] > rerank:
                    least = -np.partition(-near, rerank - 1, axis=1)[:, rerank - 1] - 2 * own.sigma * np.sqrt((part * part).sum(1))
                    which, best = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                else:
                    which, best = np.nonzero(near > -np.inf)
                best = some[best]
                score = (x[best] * part[which]).sum(-1)
                ask, vec = own_ids[which], ids[best] if single else None
                if not single:
                    many = [ids[e] for e in best]
                    size = np.fromiter(map(len, many), np.int64, len(many))
                    vec, ask, score = np.concatenate(many or [np.empty(0, np.int64)]), np.repeat(ask, size), np.repeat(score, size)
                keep = vec != ask
                found.append((ask[keep], vec[keep], score[keep]))

        def best_of(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ask, vec, score = (np.concatenate([r[c] for r in rows]) for c in range(3))
            order = np.lexsort((vec, -score, ask))
            ask, vec, score = ask[order], vec[order], score[order]
            first = np.concatenate([[True], ask[1:] != ask[:-1]]) if len(ask) else np.empty(0, bool)
            rank = np.arange(len(ask)) - np.maximum.accumulate(np.where(first, np.arange(len(ask)), 0))
            return ask[rank < k], vec[rank < k], score[rank < k]

        found: list = []
        for b in batches:
            if not b.num_rows:
                continue
            at, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "asks"))
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if at[s] != now:
                    now, parts, x = at[s], [], None
                part = b.slice(s, e - s)
                if not asks[s]:
                    parts.append(part)
                elif parts:
                    answer(part.column("query_id").to_numpy(zero_copy_only=False), _matrix(part.column("v")), part.column("lists"))
                    if sum(len(h[0]) for h in found) > HELD:
                        found[:] = [best_of(found)]
                        if len(found[0][0]) > HELD // 2:
                            yield common.batch(_FOUND_ARROW, *found.pop())
        if found:
            yield common.batch(_FOUND_ARROW, *best_of(found))

    got = both.mapInArrow(search, _FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
