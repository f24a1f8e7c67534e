"""Names from lexicons, context and a model's predictions.

Lexicons and anchors are tables that the user brings; the small samples of the queries are only examples. A lexicon is a
table of known size and is joined by hash on n-grams of tokens, not scanned as one long pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text as tx


def ngrams(tokens: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, s, e, gram, n) of tokens(by, tok_ix, w, s, e): runs of one to ``most`` tokens."""
    w = Window.partitionBy(*by).orderBy("tok_ix")
    rows = tokens.select(*by, "tok_ix", "s", F.array(*[F.struct(F.lead("w", k).over(w).alias("w"), F.lead("e", k).over(w).alias("e")) for k in range(most)]).alias("x"))
    grams = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.struct(n.alias("n"), F.element_at(F.col("x"), n)["e"].alias("e"), F.array_join(F.transform(F.slice("x", F.lit(1), n), lambda y: y["w"]), " ").alias("gram")))
    return rows.select(*by, "s", F.explode(grams).alias("g")).where("g.e is not null").select(*by, "s", "g.e", "g.gram", "g.n")


def find_places(tokens: DataFrame, places: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """(by, s, e, name, review) of places(name, ambiguous): the longest at each start; short or ambiguous ones are for
    review."""
    hit = ngrams(tokens, by, most).join(places.select(F.col("name").alias("gram"), "ambiguous"), "gram")
    first = Window.partitionBy(*by, "s").orderBy(F.desc("n"))
    kept = hit.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return kept.select(*by, "s", "e", F.col("gram").alias("name"), ((F.length("gram") <= 3) | F.col("ambiguous")).alias("review"))


def gazetteer(tokens: DataFrame, names: DataFrame, by: list[str], public: str, prefixes: str = "", most: int = 3) -> DataFrame:
    """(by, s, e, name, review) of names(name, ambiguous) of two words and more, unless the name with the word or the two
    words before it matches ``public``: then it is part of a public body. Names of one word are ordinary words too often."""
    w = Window.partitionBy(*by).orderBy("tok_ix")
    before = tokens.select(*by, F.col("s").alias("at"), F.lag("w", 1).over(w).alias("w1"), F.lag("w", 2).over(w).alias("w2"))
    known = names.where(F.instr("name", " ") > 0)
    hit = find_places(tokens, known, by, most).join(before.withColumnRenamed("at", "s"), [*by, "s"])
    bare = lambda c: F.regexp_replace(c, f"^[{prefixes}]", "") if prefixes else c
    seen = [F.concat_ws(" ", *[F.col(c) for c in cols], F.col("name")) for cols in (["w2", "w1"], ["w1"])]
    body = [x.rlike(public) | bare(x).rlike(public) for x in seen]
    return hit.where(~(body[0] | body[1])).select(*by, "s", "e", "name", "review")


def venues(text: Column, families: dict[str, str], name: str, drop: list[str], public: str | None = None, gap: str = r"\s+") -> Column:
    """array<struct<s, e, t, kind>>: the names after the head words of each family (kind: pattern of its heads) and ``gap``, without
    the words of ``drop`` at their end. What is nothing then, or makes a public body with its head, is none. All are for review."""
    one = [F.transform(spans.matches(text, rf"(?<!\p{{L}})(?:{heads}){gap}(?:{name})"), _venue(kind, heads, drop, gap)) for kind, heads in families.items()]
    found = F.array_sort(F.flatten(F.array(*one)))
    good = F.filter(found, lambda m: (F.length(m["t"]) > 0) & ~m["whole"].rlike(public or "^$"))
    return F.transform(good, lambda m: F.struct(m["s"], m["e"], m["t"], m["kind"]))


def _venue(kind: str, heads: str, drop: list[str], gap: str):
    def cut(m: Column) -> Column:
        raw = F.regexp_replace(m["t"], rf"^(?:{heads}){gap}", "")
        kept = tx.trim_tail_words(raw, drop)
        at = m["e"] - F.length(raw)
        return F.struct(at.alias("s"), (at + F.length(kept)).alias("e"), kept.alias("t"), F.lit(kind).alias("kind"), m["t"].alias("whole"))

    return cut


@dataclass(frozen=True)
class Anchor:
    """A context in which group 1 is a candidate name."""

    key: str
    rx: str
    high: bool = False


def anchored(texts: DataFrame, by: list[str], anchors: list[Anchor], reject: list[str]) -> DataFrame:
    """(by, anchor, s, e, name, high): candidates of each anchor that no word of the rejecting lexicon begins or ends."""
    found = F.concat(*[F.transform(spans.matches(F.col("text"), a.rx, 1), _anchor(a)) for a in anchors])
    rows = texts.select(*by, F.inline(found))
    words = F.split("name", r"\s+")
    bad = F.get(words, 0).isin(reject) | F.element_at(words, -1).isin(reject) | (F.length("name") < 2)
    return rows.where(~bad)


def _anchor(a: Anchor):
    return lambda m: F.struct(F.lit(a.key).alias("anchor"), m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("name"), F.lit(a.high).alias("high"))


def discover(hits: DataFrame) -> DataFrame:
    """(name, n, reasons, conf) of hits(name, anchor, high): high where an anchor is, or a speaker is seen twice."""
    g = hits.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("anchor")), ",").alias("reasons"), F.bool_or("high").alias("h"), F.count_if(F.col("anchor") == "speaker").alias("sp"))
    return g.select("name", "n", "reasons", F.when(F.col("h") | (F.col("sp") >= 2), "high").otherwise("medium").alias("conf"))


def nameish(tokens: DataFrame, lexicon: DataFrame, by: list[str], definite: str = "ה") -> DataFrame:
    """Distinct (by, w) that may be names: 3 to 14 letters, in no lexicon(w), never used with the definite letter."""
    own = tokens.select(*by, "w").distinct()
    used = own.where(F.col("w").startswith(definite)).select(*[F.col(c).alias(f"_{c}") for c in by], F.substring("w", len(definite) + 1, 99).alias("_w"))
    kept = own.where(F.length("w").between(3, 14)).join(lexicon.select("w"), "w", "left_anti")
    return kept.join(used, [kept[c] == used[f"_{c}"] for c in by] + [kept["w"] == used["_w"]], "left_anti").select(*by, "w")


def likely_org(name: Column, heads: list[str]) -> Column:
    """Whether a body's head word begins a name or a plural ends its first word."""
    first = F.element_at(F.split(name, r"\s+"), 1)
    return first.isin(heads) | first.rlike("(?:ים|ות|ers|ions)$")


# --- predictions of a model -------------------------------------------------------------------------------------------


def chunk_spans(text: str, most: int = 800, overlap: int = 60) -> list[tuple[int, int]]:
    """Spans of sentences packed greedily up to ``most`` characters; longer sentences are cut, at a space if one lies in
    the second half, and the pieces overlap."""
    out: list[tuple[int, int]] = []
    start = last = 0
    for end in [*(m.end() for m in re.finditer(r"[.!?\n]+", text)), len(text)]:
        if end - start > most and last > start:
            out.append((start, last))
            start = last
        while end - start > most:
            cut = text.rfind(" ", start + most // 2, start + most)
            cut = cut if cut > start else start + most
            out.append((start, cut))
            start = max(start + 1, cut - overlap)
            last = start
        last = end
    if last > start:
        out.append((start, last))
    return out


def chunks(texts: DataFrame, by: str = "doc_id", most: int = 800, overlap: int = 60) -> DataFrame:
    """(doc_id, ix, s, e): the chunks of every text; packing is sequential, so it runs per text in Arrow batches."""
    import pyarrow as pa

    schema = pa.schema([(by, pa.int64()), ("ix", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def work(batches):
        for b in batches:
            rows = [(i, k, s, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, (s, e) in enumerate(chunk_spans(t, most, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return texts.select(F.col(by).cast("long"), F.col("text").cast("string")).mapInArrow(work, f"{by} long, ix int, s int, e int")


def group_entities(tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, type, s, e, score) of tokens(by, ix, word, entity, score, s, e): islands of B/I of one type; pieces with ##
    and hyphens join the entity they touch; the score is the least of its parts."""
    w = Window.partitionBy(*by).orderBy("ix")
    piece = (F.col("word").startswith("##") | (F.col("word") == "-")) & (F.col("s") == F.lag("e").over(w))
    typ = F.when(F.col("entity") != "O", F.substring("entity", 3, 99))
    rows = tokens.where("s is not null").withColumn("piece", F.coalesce(piece, F.lit(False))).withColumn("t0", typ)
    rows = rows.withColumn("type", F.when(F.col("piece"), F.last("t0", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.col("t0")))
    new = F.col("type").isNull() | (~F.col("piece") & (F.col("entity").startswith("B-") | ~F.lag("type").over(w).eqNullSafe(F.col("type"))))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("type is not null").groupBy(*by, "island").agg(F.first("type").alias("type"), F.min("s").alias("s"), F.max("e").alias("e"), F.min("score").alias("score")).drop("island")


def align(text: str, words: list[str], slack: int = 2) -> list[tuple[int, int] | None]:
    """Positions of a model's words in a text by forward search; a jump over more than the pending words and ``slack`` is
    refused. Sequential, so it runs per text."""
    at, out, pending = 0, [], 0
    low = text.lower()
    for raw in words:
        w = raw.removeprefix("##").lower()
        k = low.find(w, at) if w else -1
        skipped = len(low[at:k].split()) if k >= 0 else 0
        if k < 0 or skipped > pending + slack:
            out.append(None)
            pending += 1
            continue
        out.append((k, k + len(w)))
        at, pending = k + len(w), 0
    return out


def clean_entities(ents: DataFrame, titles: list[str], least: float = 0.6) -> DataFrame:
    """(value, kind, n, score) of ents(type, text, score): above the threshold, without edges and titles, kinds mapped,
    counted; values inside a longer one of the same kind go."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("PER", "NAME", "ORG", "ORG", "GPE", "PLACE", "LOC", "PLACE", "FAC", "PLACE")]), F.col("type"))
    value = F.regexp_replace(F.trim("text"), "^(?:(?:" + "|".join(titles) + r")\.?\s+)+", "")
    rows = ents.where(F.col("score") >= least).select(value.alias("value"), kind.alias("kind"), "score").where("value <> '' and kind is not null")
    g = rows.groupBy("value", "kind").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    words = g.select(F.col("kind").alias("k2"), F.col("value").alias("v2"), F.explode(F.split("value", " ")).alias("word")).where(F.contains("v2", F.lit(" ")))
    inside = (g["kind"] == words["k2"]) & (F.element_at(F.split(g["value"], " "), 1) == words["word"]) & (g["value"] != words["v2"]) & F.contains(F.concat(F.lit(" "), words["v2"], F.lit(" ")), F.concat(F.lit(" "), g["value"], F.lit(" ")))
    return g.join(words, inside, "left_anti")


def to_bio(labels: DataFrame, by: list[str], types: dict[str, str]) -> DataFrame:
    """labels(by, ix, tag) of BIOES, IO or BIO as BIO with mapped types."""
    w = Window.partitionBy(*by).orderBy("ix")
    typ = F.regexp_replace("tag", "^[BIOES]-", "")
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), typ), typ)
    rows = labels.withColumn("t", F.when(F.col("tag") != "O", mapped)).withColumn("h", F.substring("tag", 1, 1)).withColumn("dash", F.col("tag").rlike("^[BIES]-"))
    starts = F.col("h").isin("B", "S") & F.col("dash") | ~F.lag("t").over(w).eqNullSafe(F.col("t"))
    return rows.withColumn("bio", F.when(F.col("t").isNull(), "O").otherwise(F.concat(F.when(starts, "B-").otherwise("I-"), F.col("t")))).select(*by, "ix", "bio")


def decode_bioes(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last, type, repaired): mentions; one that does not open with B or S and close with E or S counts as
    repaired."""
    w = Window.partitionBy(*by).orderBy("ix")
    rows = labels.withColumn("t", F.when(F.col("tag") != "O", F.substring("tag", 3, 99))).withColumn("h", F.substring("tag", 1, 1))
    new = F.col("h").isin("B", "S", "O") | ~F.lag("t").over(w).eqNullSafe(F.col("t")) | F.lag("h").over(w).isin("E", "S")
    rows = rows.withColumn("k", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("t is not null")
    g = rows.groupBy(*by, "k").agg(F.min("ix").alias("first"), F.max("ix").alias("last"), F.first("t").alias("type"), F.min_by("h", "ix").alias("o"), F.max_by("h", "ix").alias("c"))
    return g.select(*by, "first", "last", "type", (~(F.col("o").isin("B", "S") & F.col("c").isin("E", "S"))).alias("repaired"))


def outer_wins(mentions: DataFrame, by: list[str]) -> DataFrame:
    """mentions(by, s, e, ...) without repeats and without those inside another."""
    w = Window.partitionBy(*by).orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    return mentions.dropDuplicates([*by, "s", "e"]).withColumn("_m", F.max("e").over(w)).where("_m is null or e > _m").drop("_m")


def fold_evidence(forms: DataFrame, prefixes: str = "הובלמכש") -> DataFrame:
    """(form, base, verdict) of forms(value, n): a prefixed form and the base it may be; yes if the base is as frequent."""
    a, b = forms.alias("a"), forms.alias("b")
    pairs = a.where(F.col("a.value").rlike(f"^[{prefixes}]")).join(b, F.substring("a.value", 2, 99) == F.col("b.value"))
    return pairs.select(F.col("a.value").alias("form"), F.col("b.value").alias("base"), F.when(F.col("b.n") >= F.col("a.n"), "yes").otherwise("unknown").alias("verdict"))


def predict(texts: DataFrame, load, by: str = "doc_id") -> DataFrame:
    """(doc_id, s, e, type, score): a pluggable model over texts, loaded once per task; load() gives a function from a list
    of texts to lists of (s, e, type, score)."""
    import pandas as pd

    def work(batches):
        model = load()
        for pdf in batches:
            rows = [(i, *p) for i, ps in zip(pdf[by], model(list(pdf["text"].fillna("")))) for p in ps]
            yield pd.DataFrame(rows, columns=[by, "s", "e", "type", "score"])

    return texts.select(by, "text").mapInPandas(work, f"{by} long, s int, e int, type string, score double")
