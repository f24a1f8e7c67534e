"""Measurement: span matching, precision and recall, sweeps, intervals, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and F2, rounded to six places."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f = lambda b2: ratio((1 + b2) * p * r, b2 * p + r)
    return {"p": F.round(p, 6), "r": F.round(r, 6), "f1": F.round(f(1.0), 6), "f2": F.round(f(4.0), 6)}


def gate(base: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """keys and verdict of a regression gate over rows(found, leaked, fp): full outer join, first reason that holds."""
    b, n = base.alias("b"), now.alias("n")
    df = b.join(n, keys, "full_outer")
    worse = (F.col("n.leaked") & ~F.col("b.leaked")) | (F.col("b.found") & ~F.col("n.found")) | (F.col("n.fp") > F.col("b.fp"))
    better = (~F.col("n.leaked") & F.col("b.leaked")) | (~F.col("b.found") & F.col("n.found")) | (F.col("n.fp") < F.col("b.fp"))
    new = F.when(F.col("n.leaked"), "added-leaking").otherwise("added")
    return df.select(*keys, F.when(F.col("b.fp").isNull(), new).when(F.col("n.fp").isNull(), "gone").when(worse, "worse").when(better, "better").otherwise("same").alias("verdict"))


def snap(spans: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """spans(by, id, s, e) grown to the words(by, ws, we) they touch."""
    on = [spans[c] == words[c] for c in by]
    both = spans.join(words, [*on, (words["ws"] < spans["e"]) & (spans["s"] < words["we"])], "left")
    return both.groupBy(*[spans[c] for c in by], "id").agg(F.least(F.min("ws"), F.min("s")).alias("s"), F.greatest(F.max("we"), F.max("e")).alias("e"))


def pair_up(gold: DataFrame, pred: DataFrame, by: list[str], typed: bool = True) -> DataFrame:
    """(by, g, p): greedy one-to-one matches of overlapping spans: greatest overlap, then score, then positions.

    Candidates of one document are an array in order of precedence, and the assignment a fold over it.
    """
    on = [gold[c] == pred[c] for c in by] + [(gold["s"] < pred["e"]) & (pred["s"] < gold["e"])] + ([gold["type"] == pred["type"]] if typed else [])
    overlap = F.least(gold["e"], pred["e"]) - F.greatest(gold["s"], pred["s"])
    pairs = gold.join(pred, on).select(*[gold[c] for c in by], F.struct((-overlap).alias("o"), (-pred["score"]).alias("sc"), gold["s"].alias("gs"), pred["s"].alias("ps"), gold["id"].alias("g"), pred["id"].alias("p")).alias("c"))
    lists = pairs.groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("c"))
    none = F.array().cast("array<struct<g:int,p:int>>")
    free = lambda acc, x: ~F.exists(acc, lambda m: (m["g"] == x["g"]) | (m["p"] == x["p"]))
    kept = F.aggregate("c", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(F.struct(x["g"].cast("int").alias("g"), x["p"].cast("int").alias("p"))))).otherwise(acc))
    return lists.select(*by, F.inline(kept))


def doc_counts(gold: DataFrame, pred: DataFrame, by: str = "doc") -> DataFrame:
    """(by, tp, fp, fn, traps) of gold(by, id, s, e, type, must) and pred(by, id, s, e, type, score): documents without gold or without
    predictions count too; a trap (not must) is hit by any prediction that overlaps it."""
    tp = pair_up(gold.where("must"), pred, [by]).groupBy(by).agg(F.count("*").alias("tp"))
    hit = (F.col(f"g.{by}") == F.col(f"p.{by}")) & (F.col("g.s") < F.col("p.e")) & (F.col("p.s") < F.col("g.e"))
    traps = gold.where("not must").alias("g").join(pred.alias("p"), hit, "left_semi").groupBy(by).agg(F.count("*").alias("traps"))
    made = pred.groupBy(by).agg(F.count("*").alias("np")).join(gold.groupBy(by).agg(F.count_if("must").alias("ng")), by, "full_outer")
    made = made.join(tp, by, "left").join(traps, by, "left").na.fill(0, ["np", "ng", "tp", "traps"])
    return made.select(by, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"), "traps")


def sweep(pred: DataFrame, positives: int, grid: list[float]) -> DataFrame:
    """(t, tp, fp, p, r, f2) of pred(score, hit) at each threshold; pred is aggregated by score first, so the grid meets a
    few rows only."""
    by = pred.groupBy(F.round("score", 2).alias("score")).agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("n"))
    t = F.explode(F.array(*[F.lit(x) for x in grid]))
    at = by.select(t.alias("t"), "score", "hits", "n").groupBy("t").agg(F.coalesce(F.sum(F.when(F.col("score") >= F.col("t"), F.col("hits"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("score") >= F.col("t"), F.col("n"))), F.lit(0)).alias("all"))
    s = scores(F.col("tp"), F.col("all") - F.col("tp"), F.lit(positives) - F.col("tp"))
    return at.select("t", "tp", (F.col("all") - F.col("tp")).alias("fp"), s["p"].alias("p"), s["r"].alias("r"), s["f2"].alias("f2"))


def average_precision(curve: DataFrame) -> DataFrame:
    """(ap) of curve(t, p, r): the sum of precision times the rise of recall, recall clamped to its running maximum."""
    w = Window.orderBy(F.desc("t"))  # a row per threshold
    top = curve.withColumn("rm", F.max("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.col("rm") - F.coalesce(F.lag("rm").over(w), F.lit(0.0))
    return top.withColumn("d", step).agg(F.round(F.sum(F.col("p") * F.col("d")), 6).alias("ap"))


def mulberry(seed: int, n: int) -> np.ndarray:
    """n numbers below 1 of the 32-bit generator mulberry32."""
    out, a, m = np.empty(n), seed & 0xFFFFFFFF, 0xFFFFFFFF
    for i in range(n):
        a = (a + 0x6D2B79F5) & m
        t = ((a ^ a >> 15) * (a | 1)) & m
        t = (t + (((t ^ t >> 7) * (t | 61)) & m) & m) ^ t
        out[i] = ((t ^ t >> 14) & m) / 4294967296
    return out


def bootstrap(units: DataFrame, resamples: int = 2000, seed: int = 1, level: float = 0.95, tests: int = 1) -> DataFrame:
    """(mean, low, high) of the paired difference units(a, b), resampled by unit: percentiles by linear interpolation, the
    level corrected for the number of tests. Each task draws some of the resamples from its own seed; only sums move."""
    rows = units.groupBy().agg(F.collect_list(F.struct("unit", "a", "b")).alias("u"))  # one measurement's units, not a corpus
    n_tasks = 8

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, u in zip(pdf.k, pdf.u):
                d = np.array([x["a"] - x["b"] for x in sorted(u, key=lambda x: x["unit"])], float)
                size = resamples // n_tasks
                at = (mulberry(seed * 1000 + int(k), size * len(d)) * len(d)).astype(int).reshape(size, -1) if len(d) else np.zeros((0, 0), int)
                yield pd.DataFrame({"diff": d[at].mean(1) if len(d) else np.zeros(0)})

    tail = (1 - level) / 2 / tests
    made = rows.crossJoin(units.sparkSession.range(n_tasks).withColumnRenamed("id", "k")).repartition(n_tasks, "k").mapInPandas(draw, "diff double")
    mean = units.agg(F.avg(F.col("a") - F.col("b")).alias("mean"))
    return made.agg(F.percentile("diff", tail).alias("low"), F.percentile("diff", 1 - tail).alias("high")).crossJoin(mean).select("mean", "low", "high")


def boundary_class(gs: Column, ge: Column, ps: Column, pe: Column) -> Column:
    """How a predicted span sits on a gold one."""
    return (
        F.when(ps.isNull(), "none").when((gs == ps) & (ge == pe), "exact").when((ps < gs) & (pe == ge), "glued-left").when((ps == gs) & (pe > ge), "glued-right")
        .when((ps > gs) & (pe == ge), "cut-left").when((ps == gs) & (pe < ge), "cut-right").otherwise("other")
    )


def agreement(a: Column, b: Column) -> Column:
    """both, onlyA, onlyB or neither."""
    return F.when(a & b, "both").when(a, "onlyA").when(b, "onlyB").otherwise("neither")
