"""The second pass and the way back: parts of names, reports, aliases, restoration, distances on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, text as tx, validators as va


def name_parts(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(part, to, shared): first, last and remaining words of values(real, fake) with the part of the substitute; a part
    that means several people is shared and only flagged."""
    rw, fw = F.split("real", r"\s+"), F.split("fake", r"\s+")
    rest = lambda w: F.array_join(F.slice(w, 2, 99), " ")
    rows = F.array(
        F.struct(F.get(rw, 0).alias("part"), F.get(fw, 0).alias("to")),
        F.struct(F.element_at(rw, -1).alias("part"), F.element_at(fw, -1).alias("to")),
        F.struct(rest(rw).alias("part"), rest(fw).alias("to")),
    )
    made = pairs.where(F.size(rw) > 1).select(F.explode(rows).alias("x")).select("x.part", "x.to").where(F.length("part") >= least).distinct()
    return made.groupBy("part").agg(F.min("to").alias("to"), (F.count("*") > 1).alias("shared"))


#: Words that come before a street's name. Fixed values.
STREET_HEADS = ["רחוב", "רח'", "שדרות", "שד'", "סמטת", "סמטה", "דרך", "שכונת", "כיכר", "ככר", "מעלה", "נחל", "משעול"]


def street_names(values: Column, heads: list[str], prefixes: str = "בהולמכש", least: int = 3) -> Column:
    """The name alone of a street, address or quarter that was replaced: what follows its head word, without the house
    number and what comes after it; the head may carry one prefix letter. Null without a head or under ``least`` letters."""
    head = "|".join(rf"\Q{h}\E" for h in sorted(heads, key=lambda h: (-len(h), h)))
    name = F.trim(F.regexp_extract(F.trim(values), rf"^[{prefixes}]?(?:{head})\s+(.+?)(?:\s+\d.*)?$", 1))
    return F.when(F.length(name) >= least, name)


def swept_values(applied: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """(by, value, rep) of applied(by, value, rep): the values that a second pass looks for everywhere. A value that its own
    substitute holds would be found in the substitute, so it is left out; of several substitutes the first in order stays."""
    value = F.trim("value")
    fit = (F.length(value) >= least) & F.col("rep").isNotNull() & ~F.contains(F.col("rep"), value)
    return applied.where(fit).groupBy(*by, value.alias("value")).agg(F.min("rep").alias("rep"))


def protected(hits: Column, zones: Column) -> Column:
    """The hits (structs with s, e) that lie in no zone: substitutes that are written already are not text of the document."""
    return F.filter(hits, lambda h: ~F.exists(zones, lambda z: (z["s"] <= h["s"]) & (h["e"] <= z["e"])))


def label_suggestions(label: Column, name: str = r"\p{Lu}\p{L}{2,13}", most: int = 3) -> Column:
    """Whether a chart's label may be a name: one to ``most`` words, each like a name."""
    words = F.split(label, " ")
    return F.forall(words, lambda w: w.rlike(f"^{name}$")) & (F.size(words) <= most) & (label != "")


def closure(edges: DataFrame, most: int = 20) -> DataFrame:
    """(name, root): where each chain name -> same_as ends; a cycle ends at its own smallest name. Chains are followed by
    doubling, so the number of joins is the logarithm of the longest."""
    now = edges.select(F.col("name"), F.col("same_as").alias("root")).where("name <> root")
    now = now.groupBy("name").agg(F.min("root").alias("root"))
    back = now.withColumn("low", F.least("name", "root"))
    steps = max(1, (most - 1).bit_length())
    for _ in range(steps):
        n = back.select(F.col("name").alias("n"), F.col("root").alias("r"), F.col("low").alias("l"))
        back = back.join(n, back["root"] == n["n"], "left").select("name", F.coalesce("r", "root").alias("root"), F.least("low", F.coalesce("l", "low")).alias("low"))
    ends = edges.select(F.col("name").alias("e")).distinct()
    return back.join(ends, back["root"] == ends["e"], "left").select("name", F.when(F.col("e").isNull(), F.col("root")).otherwise(F.col("low")).alias("root"))


def restore(text: Column, pairs: list[tuple[str, str]], titles: tuple[str, ...] = ("Mr", "Ms", "Dr")) -> Column:
    """struct<text, count, missing, conflict>: the answer with real values for pairs (real, fake). Phases claim spans in
    this order: whole substitutes, longest first; parts after a title; bare parts of three letters and more. A claim never
    overlaps an earlier one. Substitutes of several values are conflicts and stay."""
    by: dict[str, set[str]] = {}
    for real, fake in pairs:
        by.setdefault(fake, set()).add(real)
    conflict = sorted(f for f, r in by.items() if len(r) > 1)
    good = [(r, f) for r, f in pairs if len(by[f]) == 1]
    parts: dict[str, set[str]] = {}
    for r, f in good:
        rw, fw = r.split(), f.split()
        if len(rw) > 1 and len(fw) > 1:
            for k in (0, -1):
                parts.setdefault(fw[k], set()).add(rw[k])
    phases = [(f, r, rf"(?<![\p{{L}}\p{{N}}])\Q{f}\E(?![\p{{L}}\p{{N}}])") for r, f in sorted(good, key=lambda x: (-len(x[1]), x[1]))]
    single = sorted((f, next(iter(r))) for f, r in parts.items() if len(r) == 1 and f not in conflict)
    phases += [(f, r, rf"(?<=(?:{'|'.join(titles)})\.? )\Q{f}\E(?![\p{{L}}\p{{N}}])") for f, r in single if len(f) >= 2]
    phases += [(f, r, rf"(?<![\p{{L}}\p{{N}}])\Q{f}\E(?![\p{{L}}\p{{N}}])") for f, r in single if len(f) >= 3]
    empty = F.array().cast("array<struct<s:int,e:int,r:string>>")
    found = F.array(*[_with(spans.matches(text, rx), real) for _, real, rx in phases]) if phases else F.array(empty)
    claims = F.aggregate(found, empty, lambda taken, phase: F.concat(taken, _free(phase, taken)))
    sorted_claims = F.array_sort(claims)
    missing = F.filter(F.array(*[F.when(~F.contains(text, F.lit(f)), F.lit(f)) for _, f in good]) if good else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return F.struct(spans.splice(text, sorted_claims).alias("text"), F.size(claims).alias("count"), missing.alias("missing"), F.array(*map(F.lit, conflict)).cast("array<string>").alias("conflict"))


def _free(found: Column, taken: Column) -> Column:
    return F.filter(found, lambda m: ~F.exists(taken, lambda c: (c["s"] < m["e"]) & (m["s"] < c["e"])))


def _with(found: Column, real: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(real).alias("r")))


def left_over(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """array<struct<s, e, fake, real>>: substitutes of pairs (real, fake) that a restored text still holds, longest first where they
    overlap, with all values that each may stand for."""
    by: dict[str, set[str]] = {}
    for real, fake in pairs:
        by.setdefault(fake, set()).add(real)
    if not by:
        return F.array().cast("array<struct<s:int,e:int,fake:string,real:string>>")
    rx = "|".join(rf"\Q{f}\E" for f in sorted(by, key=lambda f: (-len(f), f)))
    names = F.create_map(*[F.lit(x) for f, r in sorted(by.items()) for x in (f, " or ".join(sorted(r)))])
    found = spans.matches(text, rf"(?<![\p{{L}}\p{{N}}])(?:{rx})(?![\p{{L}}\p{{N}}])")
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), m["t"].alias("fake"), F.element_at(names, m["t"]).alias("real")))


#: Any spelling of a full date.
_DATES = r"(?<![0-9.])(?:\d{1,2}([./-])\d{1,2}\1(?:\d{4}|\d{2})|\d{4}-\d{1,2}-\d{1,2})(?![0-9])"


def restore_dates(answers: DataFrame, pairs: DataFrame, by: list[str], ids: list[str], ref_year: int = 2026) -> DataFrame:
    """(by, ids, s, e, t, real): the dates of answers(by, ids, text) that are, in any spelling, the substitute of one real day among
    pairs(by, real, fake) of the same case. A substitute of two real days is left alone."""
    def day(c: Column) -> Column:
        return spans.let(va.parse_date(c, ref_year), lambda p: F.when(p["y"].isNotNull(), p["date"]))

    known = pairs.select(*by, day(F.col("fake")).alias("day"), day(F.col("real")).alias("real")).where("day IS NOT NULL AND real IS NOT NULL")
    known = known.groupBy(*by, "day").agg(F.min("real").alias("real"), F.max("real").alias("other")).where("real = other").drop("other")
    found = answers.select(*by, *ids, F.inline(spans.matches(F.col("text"), _DATES))).withColumn("day", day(F.col("t")))
    return found.join(known, [*by, "day"]).select(*by, *ids, "s", "e", "t", "real")


def first_names(texts: DataFrame, cues: dict[str, str], ordinary: list[str], word: str = r"[A-Za-z]+") -> DataFrame:
    """(first, n, gender): words right after a cue (cue: gender) in texts(text), but ordinary ones; the gender is that of most of
    its cues, null where they are even."""
    rx = rf"(?<![A-Za-z])(?:{'|'.join(sorted(cues, key=len, reverse=True))}) {word}"
    rows = texts.select(F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("m"))
    rows = rows.select(F.substring_index("m", " ", 1).alias("cue"), F.substring_index("m", " ", -1).alias("first")).where(~F.col("first").isin(ordinary))
    said = F.element_at(F.create_map(*[F.lit(x) for kv in cues.items() for x in kv]), F.col("cue"))
    score = F.sum(F.when(said == "m", 1).otherwise(-1))
    return rows.groupBy("first").agg(F.count("*").alias("n"), F.when(score > 0, "m").when(score < 0, "f").alias("gender"))


def restore_pairs(document: DataFrame, case: DataFrame) -> DataFrame:
    """Pairs (real, fake) of the document; the case's fill what is missing if their substitute is free."""
    more = case.join(document.select("real"), "real", "left_anti")
    taken = document.select(F.lower(F.trim("fake")).alias("k"))
    more = more.withColumn("k", F.lower(F.trim("fake"))).join(taken, "k", "left_anti").drop("k")
    return document.select("real", "fake").unionByName(more.select("real", "fake"))


def haversine(a1: Column, o1: Column, a2: Column, o2: Column) -> Column:
    """Kilometres between two places."""
    r = F.radians
    x = F.pow(F.sin(r(a2 - a1) / 2), 2) + F.cos(r(a1)) * F.cos(r(a2)) * F.pow(F.sin(r(o2 - o1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(x))


def penalty(a: str, b: str) -> Column:
    """What it costs, in kilometres, that two places (struct columns pop, rel, type, size) differ; null where one cannot
    stand for the other."""
    rural = lambda x: F.col(f"{x}.type").isin("moshav", "kibbutz", "community")
    differ = lambda k: F.col(f"{a}.{k}") != F.col(f"{b}.{k}")
    cost = F.when(differ("rel"), 60).otherwise(0) + F.when(rural(a) != rural(b), 60).when(differ("type"), 15).otherwise(0) + F.when(differ("size"), 30).otherwise(0)
    return F.when(differ("pop"), None).otherwise(cost)


def differing(a: str, b: str, axes: tuple[str, ...] = ("type", "pop", "rel", "size")) -> Column:
    """The axes, without the region, on which two places differ."""
    made = F.array(*[F.when(F.col(f"{a}.{k}") != F.col(f"{b}.{k}"), k) for k in axes])
    return F.filter(made, lambda x: x.isNotNull())


def nearest_in_character(places: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, sub, cost): of each target the place of least penalty, then distance, then name, other than itself."""
    pairs = F.broadcast(targets).alias("a").crossJoin(places.alias("b")).where(F.col("a.name") != F.col("b.name"))  # targets: the towns of one document
    pairs = pairs.withColumn("cost", penalty("a", "b")).where("cost is not null").withColumn("km", haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    pairs = pairs.select(F.col("a.name").alias("name"), F.col("b.name").alias("sub"), "cost", "km")
    first = Window.partitionBy("name").orderBy("cost", F.round("km", 6), "sub")
    return pairs.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def geo_map(places: DataFrame, towns: list[str], keep: int = 41) -> DataFrame:
    """(rank, first, second, err, pen): substitutes of two towns that keep their distance.

    Every place is an anchor, with 12 rotations and 2 mirrors; each town takes the place of least distance and penalty
    there, without reuse; rows are the best ``keep`` by error of the distance and mean penalty. places: name, lat, lon,
    pop, rel, type, size. The grid is places x 24 rows; each step joins it to the places, a table of fixed size.
    """
    one, two = towns
    p = places
    rows = {r["name"]: r for r in p.where(F.col("name").isin(towns)).collect()}  # two rows
    a, b = rows[one], rows[two]
    ca, co = (a["lat"] + b["lat"]) / 2, (a["lon"] + b["lon"]) / 2
    grid = p.select(F.col("name").alias("anchor"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    grid = grid.withColumn("deg", F.explode(F.sequence(F.lit(0), F.lit(330), F.lit(30)))).withColumn("mirror", F.explode(F.array(F.lit(1), F.lit(-1))))
    cosc = F.cos(F.radians(F.lit(ca)))
    table = F.broadcast(p.where(~F.col("name").isin(towns)))

    def place(g: DataFrame, town, name: str, other: str | None) -> DataFrame:
        x, y = F.lit(town["lon"] - co) * cosc * F.col("mirror"), F.lit(town["lat"] - ca)
        cs, sn = F.cos(F.radians("deg")), F.sin(F.radians("deg"))
        g = g.withColumn("tlat", F.col("alat") + x * sn + y * cs).withColumn("tlon", F.col("alon") + (x * cs - y * sn) / F.cos(F.radians("alat")))
        t = F.struct(*[F.lit(town[k]).alias(k) for k in ("type", "pop", "rel", "size")])
        c = g.crossJoin(table.select(F.struct("name", "lat", "lon", "type", "pop", "rel", "size").alias("b"))).withColumn("a", t)
        c = c if other is None else c.where(F.col("b.name") != F.col(f"{other}.name"))
        c = c.withColumn("pen_", penalty("a", "b")).where("pen_ is not null").withColumn("sc", haversine(F.col("b.lat"), F.col("b.lon"), F.col("tlat"), F.col("tlon")) + F.col("pen_"))
        best = c.groupBy("anchor", "alat", "alon", "deg", "mirror", *([other, f"{other}_pen"] if other else [])).agg(F.min_by(F.struct("b", "pen_", "sc"), F.struct(F.round("sc", 9), "b.name")).alias("m"))
        return best.where("m.sc <= 110").withColumn(name, F.col("m.b")).withColumn(f"{name}_pen", F.col("m.pen_")).drop("m")

    made = place(place(grid, a, "u", None), b, "v", "u")
    d0 = haversine(F.lit(a["lat"]), F.lit(a["lon"]), F.lit(b["lat"]), F.lit(b["lon"]))
    d1 = haversine(F.col("u.lat"), F.col("u.lon"), F.col("v.lat"), F.col("v.lon"))
    made = made.withColumn("err", F.round(F.abs(d0 - d1), 6)).withColumn("pen", (F.col("u_pen") + F.col("v_pen")) / 2)
    made = made.groupBy(F.col("u.name").alias("first"), F.col("v.name").alias("second")).agg(F.min("err").alias("err"), F.min("pen").alias("pen"))
    order = Window.orderBy(F.col("err") + F.col("pen"), "first", "second")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
