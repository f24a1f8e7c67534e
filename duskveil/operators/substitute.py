"""What takes the place of a value: styles, ordinals, pseudonyms, splicing.

Allocation is per document in first-seen order. It stays inside the document's row: the kept hits are an array, and
ordinals, used names and the new text are folds over it, so redaction needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import spans, text as tx
from . import detect

BLACK = "███"


def style(rule: Column, by_family: Column, fam: Column, default: str = "name") -> Column:
    """Rule, then family, then ``*`` (not for names, bodies and places), then the mode."""
    star = F.when(~fam.isin("NAME", "ORG", "PLACE"), F.element_at(by_family, F.lit("*")))
    return F.coalesce(rule, F.element_at(by_family, fam), star, F.lit({"block": "black", "label": "label"}.get(default, "name")))


def keyed(kept: Column) -> Column:
    """Kept hits as struct<s, e, fam, key, t>."""
    return F.transform(kept, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), detect.family(h["type"]).alias("fam"), detect.canonical_key(h["type"], h["t"]).alias("key"), h["t"].alias("t")))


def ambiguity(text: Column, pairs: Column) -> Column:
    """array<struct<rep, n_values, occurs, ambiguous>> of pairs struct<value, rep>, by first appearance: a substitute is ambiguous if
    it stands for several values or if the source text held it already."""
    reps = F.array_distinct(F.transform(pairs, lambda x: x["rep"]))

    def facts(r: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda x: x["rep"] == r), lambda x: x["value"])
        n, held = F.size(F.array_distinct(own)), F.contains(text, r)
        return F.struct(r.alias("rep"), n.alias("n_values"), held.alias("occurs"), ((n > 1) | held).alias("ambiguous"))

    return F.transform(reps, facts)


def ordinals(hits: Column) -> Column:
    """keyed hits with n, the rank of their key among its family's keys by first appearance."""
    firsts = F.array_distinct(F.transform(hits, lambda h: F.struct(h["fam"].alias("fam"), h["key"].alias("key"))))
    rank = lambda h: F.array_position(F.transform(F.filter(firsts, lambda f: f["fam"] == h["fam"]), lambda f: f["key"]), h["key"])
    return F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), h["fam"].alias("fam"), h["key"].alias("key"), h["t"].alias("t"), rank(h).cast("int").alias("n")))


def labelled(text: Column, hits: Column) -> Column:
    """text with ``[FAMILY n]`` for each of ordinals(hits)."""
    return spans.splice(text, F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), F.concat(F.lit("["), h["fam"], F.lit(" "), h["n"].cast("string"), F.lit("]")).alias("r"))))


def smooth(text: Column, s: Column, e: Column) -> Column:
    """struct<s, e>: the span of a deletion with one neighbouring space, where two would meet or one would stand before
    punctuation or at an edge."""
    before, after = F.substring(text, s, F.lit(1)), F.substring(text, e + 1, F.lit(1))
    left, right = (s > 0) & (before == " "), after == " "
    edge = (s == 0) | (before == "\n")
    close = after.isin(".", ",", ";", ":", ")", "!", "?", "\n", "")
    return F.when(left & (right | close), F.struct((s - 1).alias("s"), e.alias("e"))).when(edge & right, F.struct(s.alias("s"), (e + 1).alias("e"))).otherwise(F.struct(s.alias("s"), e.alias("e")))


def probe_index(seed: Column, k: Column, n: int) -> Column:
    """Where the k-th probe of a seed looks in a pool of n."""
    return (seed + k * 7 + F.shiftrightunsigned(seed, 8) % 3) % n


def pick(seed: Column, pool: list[str], used: Column, forbidden: Column) -> Column:
    """The first of the pool in the seed's probing order that is neither used nor forbidden; null if none is."""
    names = F.array(*map(F.lit, pool))
    order = F.transform(F.sequence(F.lit(0), F.lit(len(pool) * 3)), lambda k: F.get(names, probe_index(seed, k.cast("long"), len(pool)).cast("int")))
    return F.get(F.filter(order, lambda x: ~F.array_contains(used, x) & ~F.array_contains(forbidden, x)), 0)


def fake_names(values: Column, pool: list[str], forbidden: Column) -> Column:
    """array<struct<real, fake>>: a different name of the pool for each value, in order; a name and a number when the pool
    is spent. Order decides, so this is a fold."""
    none = F.array().cast("array<struct<real:string,fake:string>>")
    names = F.array(*map(F.lit, pool))

    def step(acc: Column, v: Column) -> Column:
        seed = tx.hash32(v)
        spare = F.concat(F.get(names, (seed % len(pool)).cast("int")), F.lit(" "), (seed % 89 + 11).cast("string"))
        fake = F.coalesce(pick(seed, pool, F.transform(acc, lambda a: a["fake"]), forbidden), spare)
        return F.when(F.exists(acc, lambda a: a["real"] == v), acc).otherwise(F.concat(acc, F.array(F.struct(v.alias("real"), fake.alias("fake")))))

    return F.aggregate(values, none, step)


def gender(name: Column, hint: Column, female: list[str], male: list[str]) -> Column:
    """A hint, then the lexicons, then the ending."""
    first = F.element_at(F.split(name, r"\s+"), 1)
    return F.coalesce(hint, F.when(first.isin(female), "f").when(first.isin(male), "m").when(first.rlike("(?:ה|ית|a)$"), "f").otherwise("m"))


def fake_org(name: Column, heads: list[str], tails: list[str]) -> Column:
    """The body's head word with a tail chosen by the hash of the rest."""
    head = F.element_at(F.split(name, r"\s+"), 1)
    rest = F.trim(F.substring(name, F.length(head) + 1, F.length(name)))
    tail = F.get(F.array(*map(F.lit, tails)), (tx.hash32(rest) % len(tails)).cast("int"))
    return F.when(head.isin(heads), F.concat(head, F.lit(" "), tail)).otherwise(tail)


def origin(name: Column, particles: list[str]) -> Column:
    """``ar`` where a particle begins a word, else ``he``."""
    return F.when(F.exists(F.split(name, r"[\s-]+"), lambda w: w.isin(particles)), "ar").otherwise("he")
