"""Other readers: items of PDF pages, annotated corpora, locality lists, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pdf_lines(items: DataFrame, near: float = 2.0) -> DataFrame:
    """(page, line, text) of items(page, x, y, text): items whose heights differ by at most ``near`` from the one before
    are one line, read in the direction of its script."""
    w = Window.partitionBy("page").orderBy(F.desc("y"), "x")
    new = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) > near, F.lit(True)).cast("int")
    rows = items.withColumn("new", new).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    heb = F.sum(F.length(F.regexp_replace("text", "[^֐-׿]", "")))
    lat = F.sum(F.length(F.regexp_replace("text", "[^A-Za-z]", "")))
    order = F.array_sort(F.collect_list(F.struct("x", "text")))
    words = lambda a: F.array_join(F.transform(a, lambda i: i["text"]), " ")
    return rows.groupBy("page", "line").agg(F.when(heb > lat, words(F.reverse(order))).otherwise(words(order)).alias("text"))


def boilerplate(lines: DataFrame, by: str, page: str, line: str) -> DataFrame:
    """(by, key, pages): line keys (digits as #) on at least max(2, half) of a document's pages."""
    key = F.regexp_replace(F.trim(line), "[0-9]+", "#")
    rows = lines.select(by, page, key.alias("key")).where("key <> ''").distinct()
    pages = lines.groupBy(by).agg(F.countDistinct(page).alias("of"))
    n = rows.groupBy(by, "key").agg(F.count("*").alias("pages"))
    return n.join(pages, by).where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("of") / 2))).select(by, "key", "pages")


def scanned_pages(lines: DataFrame, by: str, page: str, line: str, least: int = 40) -> DataFrame:
    """(by, page, chars, image): a page is an image if fewer than ``least`` characters remain without boilerplate."""
    key = F.regexp_replace(F.trim(line), "[0-9]+", "#")
    bad = boilerplate(lines, by, page, line).select(F.col(by).alias("_b"), F.col("key").alias("_k"))
    kept = lines.withColumn("key", key).join(bad, (F.col(by) == F.col("_b")) & (F.col("key") == F.col("_k")), "left")
    size = F.sum(F.when(F.col("_k").isNull(), F.length(F.regexp_replace(line, r"\s", ""))).otherwise(0))
    return kept.groupBy(by, page).agg(F.coalesce(size, F.lit(0)).alias("chars")).withColumn("image", F.col("chars") < least)


def heading(first_line: Column) -> Column:
    """Whether a text's first line that is not blank reads as a heading."""
    t = F.trim(first_line)
    return (F.length(t) > 0) & (F.length(t) <= 70) & ~t.rlike(r"[.!?:;,]$")


def bmes_rows(lines: DataFrame) -> DataFrame:
    """(sent, ix, token, tag) of lines(n, line): two columns, a blank line between sentences."""
    w = Window.orderBy("n")  # one annotated file
    blank = (F.trim("line") == "").cast("int")
    rows = lines.withColumn("sent", F.sum(blank).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where(F.trim("line") != "")
    parts = F.split(F.trim("line"), r"\s+")
    return rows.select("sent", (F.row_number().over(Window.partitionBy("sent").orderBy("n")) - 1).alias("ix"), F.get(parts, 0).alias("token"), F.get(parts, 1).alias("tag"))


def conllu_entities(lines: DataFrame) -> DataFrame:
    """(sent, open, close, unmatched) of lines(n, line): brackets of Entity= in the last column, per sentence."""
    w = Window.orderBy("n")  # one annotated file
    blank = (F.trim("line") == "").cast("int")
    rows = lines.withColumn("sent", F.sum(blank).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where(F.col("line").rlike(r"^\d+\t"))
    ent = F.regexp_extract("line", r"Entity=([^|\t]*)", 1)
    opens, closes = F.length(F.regexp_replace(ent, r"[^(]", "")), F.length(F.regexp_replace(ent, r"[^)]", ""))
    return rows.groupBy("sent").agg(F.sum(opens).alias("open"), F.sum(closes).alias("close"), F.abs(F.sum(opens) - F.sum(closes)).alias("unmatched"))


def localities(names: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(name): names(name) without bracketed qualifiers, one space between words, not known(name) already."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"\s*\([^)]*\)", ""), r"\s+", " "))
    return names.select(clean.alias("name")).where(F.length("name") >= least).distinct().join(known.select("name"), "name", "left_anti")
