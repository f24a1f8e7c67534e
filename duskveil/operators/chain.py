"""The whole chain as one projection: list rules, patterns, allowed values and ages meet in one resolution, every kept hit
gets its substitute by style, the text is rewritten and searched for what should be gone.

Rules are the user's list, compiled to one alternation (longest form first), so they are bounded by what one pattern holds:
some thousands. Nothing is shuffled: a document's hits, names, ordinals and edits are arrays in its row. Detection reads
normalised text, whose offsets are those of the text. Null text has no hits and stays null; of equal rules the first counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text as tx, validators as va
from . import detect, substitute as su


@dataclass(frozen=True)
class Rule:
    value: str
    kind: str = "NAME"
    replacement: str | None = None
    style: str | None = None


@dataclass(frozen=True)
class Options:
    """What is on, what is only flagged, how values are replaced, and the pools that substitutes come from."""

    on: tuple[str, ...] = tuple(d.type for d in detect.HEBREW if d.on)
    flag: tuple[str, ...] = ()
    mode: str = "real"
    styles: dict[str, str] = field(default_factory=dict)
    prefixes: str = "normal"
    detectors: tuple[detect.Detector, ...] = tuple(detect.HEBREW)
    names: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    person: str = "פלוני"
    ref_year: int = 2026


#: A hit of the chain, in the order of precedence.
HIT = "struct<s:int,rk:int,prio:int,neg:int,e:int,type:string,t:string,ok:boolean,base:string,pre:string,rep:string,style:string>"
_SIGNS = str.maketrans(tx.MARKS + "".join(tx.SIGNS), tx.SENTINEL * len(tx.MARKS) + "".join(tx.SIGNS.values()))
_GAP = re.compile(r"[\s-]+")


def _plain(value: str) -> str:
    """A value as rules are compared: normalised, without marks, one space between words."""
    return _GAP.sub(" ", value.translate(_SIGNS).replace(tx.SENTINEL, "")).strip()


def forms(rules: list[Rule], level: str = "normal") -> dict[str, tuple[Rule, str]]:
    """Every form under which a rule is found, with its rule and prefix; a prefixed form that is another rule's value is that
    rule's, and of equal forms the first counts."""
    out: dict[str, tuple[Rule, str]] = {}
    for r in rules:
        if _plain(r.value):
            out.setdefault(_plain(r.value), (r, ""))
    letters = {"off": [], "safe": tx.SAFE_PREFIXES, "normal": tx.SINGLE_PREFIXES + tx.DOUBLE_PREFIXES}[level]
    own = list(out.items())
    for p in letters:  # a single letter before a name goes before two letters before another
        for value, (r, _) in own:
            if re.match("[א-ת]", value):
                out.setdefault(p + value, (r, p))
    return out


def pattern(values: list[str]) -> str:
    """A pattern of plain values, longest first: words may be joined by spaces or hyphens, and marks stand between letters."""
    one = lambda v: rf"[\s-]+".join(f"{tx.SENTINEL}*".join(re.escape(c) for c in w) for w in v.split(" "))
    return f"{tx.LEFT}(?:{'|'.join(map(one, sorted(values, key=lambda v: (-len(v), v))))}){tx.RIGHT}"


def _key(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, tx.SENTINEL, ""), r"[\s-]+", " "))


def rule_hits(text: Column, rules: list[Rule], level: str) -> Column:
    """array of HIT of the rules' forms in normalised text, but contact labels and titles of public bodies."""
    made = forms(rules, level)
    if not made:
        return F.array().cast(f"array<{HIT}>")
    table = F.create_map(*[x for form, (r, pre) in made.items() for x in (F.lit(form), F.struct(F.lit(r.value).alias("base"), F.lit(r.kind).alias("kind"), F.lit(pre).alias("pre"), F.lit(r.replacement).cast("string").alias("rep"), F.lit(r.style).cast("string").alias("style")))])

    def hit(m: Column) -> Column:
        return spans.let(F.element_at(table, _key(m["t"])), lambda r: _hit(m, r))

    def _hit(m: Column, r: Column) -> Column:
        return F.struct(m["s"].alias("s"), F.lit(0).alias("rk"), F.lit(0).alias("prio"), (m["s"] - m["e"]).alias("neg"), m["e"].alias("e"), r["kind"].alias("type"), m["t"].alias("t"), F.lit(True).alias("ok"), r["base"].alias("base"), r["pre"].alias("pre"), r["rep"].alias("rep"), r["style"].alias("style")).cast(HIT)

    label = lambda h: h["t"].rlike("^(?:טל|פקס|נייד|טלפון)$") & F.substring(text, h["e"] + 1, F.lit(8)).rlike(r"^\s*:\s*(?:$|[\d+*(]|פקס|נייד|טל)")
    title = lambda h: ~F.contains(F.trim(h["base"]), F.lit(" ")) & detect.public_title(F.concat(h["t"], F.substring(text, h["e"] + 1, F.lit(30))), F.length(h["t"]))
    return F.filter(F.transform(spans.matches(text, pattern(list(made))), hit), lambda h: ~label(h) & ~title(h))


def zones(text: Column, allow: list[str], rules: list[Rule]) -> Column:
    """Spans of allowed values in normalised text, with a prefix letter or without; a prefixed one that is itself listed, or
    holds a listed value after its first letter, is no zone."""
    plain = [_plain(a) for a in allow if _plain(a)]
    if not plain:
        return F.array().cast("array<struct<s:int,e:int,t:string>>")
    listed = {_plain(r.value) for r in rules}
    rx = f"(?:[{''.join(tx.SINGLE_PREFIXES)}]{{0,2}})" + pattern(plain)[len(tx.LEFT) : -len(tx.RIGHT)]
    found = spans.matches(text, tx.LEFT + rx + tx.RIGHT)
    other = lambda z: ~_key(z["t"]).isin(plain) & (_key(z["t"]).isin(sorted(listed)) | F.substring(_key(z["t"]), 2, 10**6).isin(sorted(listed - set(plain)) or [""]))
    return F.filter(found, lambda z: ~other(z)) if listed else found


def detected(docs: DataFrame, text: Column, rules: list[Rule], allow: list[str], opt: Options) -> DataFrame:
    """docs with ``_kept`` (array of HIT): the chain's resolved hits of a text."""
    used = [d for d in opt.detectors if d.type in opt.on or d.type in opt.flag]
    none = F.array().cast(f"array<{HIT}>")
    wide = lambda h: F.struct(*[h[c].alias(c) for c in ("s", "rk", "prio", "neg", "e", "type", "t", "ok")], h["t"].alias("base"), F.lit("").alias("pre"), F.lit(None).cast("string").alias("rep"), F.lit(None).cast("string").alias("style")).cast(HIT)
    n, found = F.col("_n"), F.col("_found")
    made = docs.withColumn("_n", tx.norm(text))
    made = made.withColumn("_found", F.transform(detect.hits(n, used, opt.ref_year), wide) if used else none).withColumn("_allowed", zones(n, allow, rules)).withColumn("_ages", detect.age_zones(n)).withColumn("_listed", rule_hits(n, rules, opt.prefixes))

    def grown(h: Column) -> Column:  # an address takes the prefix letter before it along
        moved = lambda x: F.struct(x["s"].cast("int").alias("s"), h["rk"].alias("rk"), h["prio"].alias("prio"), (x["s"] - h["e"]).cast("int").alias("neg"), h["e"].alias("e"), h["type"].alias("type"), F.concat(x["pre"], h["t"]).alias("t"), h["ok"].alias("ok"), h["base"].alias("base"), x["pre"].alias("pre"), h["rep"].alias("rep"), h["style"].alias("style")).cast(HIT)
        return F.when(h["type"] == "ADDRESS_STREET", spans.let(detect.absorb_prefix(n, h["s"]), moved)).otherwise(h)

    def code(h: Column) -> Column:  # the zip code after an address
        hit = lambda z: F.struct(z["s"].alias("s"), F.lit(1).alias("rk"), F.lit(3).alias("prio"), (z["s"] - z["e"]).alias("neg"), z["e"].alias("e"), F.lit("ZIPCODE").alias("type"), z["t"].alias("t"), h["ok"].alias("ok"), z["t"].alias("base"), F.lit("").alias("pre"), F.lit(None).cast("string").alias("rep"), F.lit(None).cast("string").alias("style")).cast(HIT)
        return spans.let(detect.zip_after(n, h["e"]), hit)

    if any(d.type == "ADDRESS_STREET" for d in used):
        made = made.withColumn("_found", F.transform(found, grown))
        made = made.withColumn("_codes", F.filter(F.transform(F.filter(found, lambda h: h["type"] == "ADDRESS_STREET"), code), lambda z: z["s"].isNotNull()))
        made = made.withColumn("_found", F.concat(found, F.filter("_codes", lambda z: ~F.exists(found, lambda h: (h["s"] < z["e"]) & (z["s"] < h["e"]))))).drop("_codes")
    found = F.filter("_found", lambda h: ~detect.in_zone(h["s"], h["e"], F.col("_allowed")) & ~detect.in_zone(h["s"], h["e"], F.col("_ages")))
    listed = F.filter("_listed", lambda h: ~F.exists("_allowed", lambda z: (z["s"] == h["s"]) & (z["e"] == h["e"])))
    every = F.concat(listed, found)  # a hit whose validator fails is only for review: it hides none that is valid
    made = made.withColumn("_sure", F.coalesce(spans.resolve(F.filter(every, lambda h: h["ok"])), none))
    doubtful = F.filter(every, lambda h: ~h["ok"] & ~F.exists("_sure", lambda k: (k["s"] < h["e"]) & (h["s"] < k["e"])))
    made = made.withColumn("_kept", F.array_sort(F.concat("_sure", F.coalesce(spans.resolve(doubtful), none))))
    return made.drop("_n", "_found", "_allowed", "_ages", "_listed", "_sure")


#: What a hit becomes.
EDIT = "struct<s:int,e:int,r:string,type:string,t:string,apply:boolean,base:string>"


def edited(docs: DataFrame, text: Column, rules: list[Rule], opt: Options) -> DataFrame:
    """docs with ``edits`` (array of EDIT) for ``_kept``: substitutes are the same for equal values, allotted in the order of first
    appearance."""
    by_family = F.create_map(*[F.lit(x) for kv in opt.styles.items() for x in kv]) if opt.styles else F.create_map().cast("map<string,string>")
    fam = lambda h: detect.family(h["type"])
    style = lambda h: su.style(h["style"], by_family, fam(h), opt.mode)
    full = lambda h: F.struct(*[h[c].alias(c) for c in ("s", "e", "type", "t", "base", "pre", "rep")], fam(h).alias("fam"), style(h).alias("style"), detect.canonical_key(h["type"], h["base"]).alias("key"), ((h["rk"] == 0) | h["ok"] & h["type"].isin(list(opt.on) or [""])).alias("apply"))
    made = docs.withColumn("_full", F.transform("_kept", full))
    own = lambda h: h["apply"] & h["rep"].isNull() & ~h["style"].isin("blank", "black")
    listed = F.array(*[F.lit(r.value) for r in rules]).cast("array<string>")
    made = made.withColumn("_firsts", F.array_distinct(F.transform(F.filter("_full", own), lambda h: F.struct(h["fam"].alias("fam"), h["key"].alias("key")))))
    made = made.withColumn("_people", F.array_distinct(F.transform(F.filter("_full", lambda h: own(h) & (h["fam"] == "NAME") & (h["style"] == "name")), lambda h: h["base"])))
    made = made.withColumn("_fakes", su.fake_names(F.col("_people"), list(opt.names), listed) if opt.names else F.array().cast("array<struct<real:string,fake:string>>"))
    made = made.withColumn("_days", (F.lit(30) + tx.hash32(tx.norm(text)) % 371).cast("int"))
    labels = F.create_map(*[F.lit(x) for kv in opt.labels.items() for x in kv]) if opt.labels else F.create_map().cast("map<string,string>")

    def edit(h: Column) -> Column:
        rank = F.array_position(F.transform(F.filter("_firsts", lambda f: f["fam"] == h["fam"]), lambda f: f["key"]), h["key"])
        number = spans.let(rank, tx.numeral)
        label = F.when(h["fam"] == "NAME", F.concat(F.lit(opt.person + " "), number)).otherwise(F.concat(F.lit("["), F.coalesce(F.element_at(labels, h["fam"]), h["fam"]), F.lit(" "), number, F.lit("]")))
        name = F.get(F.filter("_fakes", lambda f: f["real"] == h["base"]), 0)["fake"]
        real = F.when(h["fam"] == "NAME", name).when(h["fam"] == "DATE", va.shift_date(h["base"], F.col("_days"), opt.ref_year))
        base = F.when(h["style"] == "black", F.lit(su.BLACK)).otherwise(F.coalesce(h["rep"], F.when(h["style"] == "name", real), label))
        blank = h["style"] == "blank"
        put = lambda base: lambda room: F.struct(F.when(blank, room["s"]).otherwise(h["s"]).cast("int").alias("s"), F.when(blank, room["e"]).otherwise(h["e"]).cast("int").alias("e"), F.when(blank, "").otherwise(tx.add_prefix(h["pre"], base)).alias("r"), h["type"].alias("type"), F.substring(text, h["s"] + 1, h["e"] - h["s"]).alias("t"), h["apply"].alias("apply"), h["base"].alias("base")).cast(EDIT)
        return spans.let(base, lambda b: spans.let(su.smooth(text, h["s"], h["e"]), put(b)))

    return made.withColumn("edits", F.transform("_full", edit)).drop("_kept", "_full", "_firsts", "_people", "_fakes", "_days")


def redact(docs: DataFrame, rules: list[Rule] | None = None, allow: list[str] | None = None, opt: Options | None = None, text_col: str = "text") -> DataFrame:
    """docs with ``edits`` (array of EDIT, flagged ones with apply false), ``redacted`` and ``leaks``: the distinct replaced values
    of two characters or more that the new text still holds."""
    rules, opt = rules or [], opt or Options()
    text = F.col(text_col)
    made = edited(detected(docs, text, rules, allow or [], opt), text, rules, opt)
    made = made.withColumn("_done", F.filter("edits", lambda x: x["apply"]))
    made = made.withColumn("redacted", spans.splice(text, F.col("_done"))).withColumn("_values", F.array_distinct(F.transform("_done", lambda x: x["t"])))
    return made.withColumn("leaks", F.filter("_values", lambda v: (F.length(v) >= 2) & F.contains(F.col("redacted"), v))).drop("_done", "_values")
