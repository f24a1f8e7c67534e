"""Spans with offsets inside the JVM: matches, overlap resolution, zones, splicing.

Spans are half-open and count code points. A detector gives array<struct<s, e, t>>; hits are structs with at least s, e.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def matches(text: Column, rx: str, group: int = 0) -> Column:
    """array<struct<s, e, t>> of the matches of a pattern that matches no empty text: their starts follow from the pieces
    between them. With a group the span is that of the group's text, first found in the match."""
    m, g = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    pieces = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda x, t: F.struct(F.length(x).alias("skip"), t.alias("t")))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["skip"]
        e = s + F.length(x["t"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t")))).alias("out"))

    whole = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    if group:
        k = F.regexp_extract_all(text, F.lit(rx), F.lit(group))
        whole = F.zip_with(whole, k, lambda x, t: F.struct((x["s"] + F.instr(x["t"], t) - 1).alias("s"), (x["s"] + F.instr(x["t"], t) - 1 + F.length(t)).alias("e"), t.alias("t")))
    return F.when(text.rlike(rx), F.transform(whole, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"), x["t"].alias("t")))).otherwise(none)


def token_rows(df: DataFrame, text: str, rx: str, by: list[str]) -> DataFrame:
    """A row (by, tok_ix, w, s, e) per match, in linear work for texts with many: pieces are rows and their starts a
    running sum per text. ``by`` must tell texts apart."""
    c = F.col(text)
    parts = F.arrays_zip(F.split(c, rx, -1).alias("g"), F.regexp_extract_all(c, F.lit(rx), F.lit(0)).alias("w"))
    rows = df.where(c.isNotNull()).select(*by, F.posexplode(parts).alias("tok_ix", "x")).where("x.w is not null")
    run = Window.partitionBy(*by).orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.g") + F.length("x.w")).over(run)
    return rows.select(*by, "tok_ix", F.col("x.w").alias("w"), (end - F.length("x.w")).cast("int").alias("s"), end.cast("int").alias("e"))


def resolve(hits: Column) -> Column:
    """Greedy by start, then rank, priority and greater length: a hit stays if it starts at or after the last one's end.

    hits: array<struct<s, rk, prio, neg, e, ...>> with neg = s - e; the struct's order is the order of precedence.
    """
    kept = F.aggregate(
        F.array_sort(hits),
        F.struct(F.lit(-1).alias("last"), F.slice(hits, 1, 0).alias("out")),
        lambda a, h: F.when(h["s"] >= a["last"], F.struct(h["e"].alias("last"), F.concat(a["out"], F.array(h)).alias("out"))).otherwise(a),
    )
    return kept["out"]


def splice(text: Column, edits: Column) -> Column:
    """text with each edit (struct<s, e, r>, sorted, apart) put in place of its span, in one pass."""
    a = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), x["r"]).alias("out")),
    )
    return F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))


def outside(hits: DataFrame, zones: DataFrame, by: list[str], mode: str = "overlap") -> DataFrame:
    """hits that no zone of the same text overlaps, contains or equals."""
    z = zones.select(*by, F.col("s").alias("_zs"), F.col("e").alias("_ze"))
    test = {"overlap": (F.col("s") < F.col("_ze")) & (F.col("_zs") < F.col("e")), "contain": (F.col("_zs") <= F.col("s")) & (F.col("e") <= F.col("_ze")), "equal": (F.col("_zs") == F.col("s")) & (F.col("_ze") == F.col("e"))}[mode]
    on = [hits[c] == z[c] for c in by]
    return hits.join(z, [*on, test], "left_anti")
