"""Near misses and signs that two names are one.

The near-miss search is a fuzzy equi-join: both sides enter the keys of their deletion neighbourhood (the form itself and
every form with one letter less), so forms one edit apart meet under a key; the edit is then verified. Work follows the
number of forms, never their product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as va

#: Letters that are heard alike, and letters that spelling adds or drops.
ALIKE = "אה אע הע אי כח קכ תט סש בו זצ וי םמ ןנ ךכ ףפ ץצ שס דת גק לר לנ נר מנ בפ דט גכ".split()
WEAK = ["א", "ה", "ו", "י"]


def deletion_keys(c: Column) -> Column:
    """The form and all forms with one letter less."""
    less = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), less))


def alike(p: Column) -> Column:
    return p.isin(ALIKE + [x[::-1] for x in ALIKE])


def near_pairs(forms: DataFrame, targets: DataFrame, prefixes: str = "", least: int = 4) -> DataFrame:
    """(form, target, k, p, conf): forms(form) one edit from targets(target), by the chain's filters in order: no prefix
    letter more, less or changed; short one-word targets need alike or weak letters."""
    t = targets.where(F.length("target") >= least).distinct()
    bare = F.regexp_replace("form", f"^[{prefixes}]", "") if prefixes else F.col("form")
    f = forms.distinct().withColumn("bare", bare)
    left = f.select("form", "bare", F.explode(F.array_distinct(F.concat(deletion_keys(F.col("form")), deletion_keys(F.col("bare"))))).alias("key"))
    right = t.select("target", F.explode(deletion_keys(F.col("target"))).alias("key"))
    pairs = left.join(right, "key").select("form", "bare", "target").distinct()
    pairs = pairs.where((F.col("form") != F.col("target")) & (F.col("bare") != F.col("target")))
    if prefixes:
        swap = F.col("form").rlike(f"^[{prefixes}]") & F.col("target").rlike(f"^[{prefixes}]") & (F.substring("form", 2, 1 << 20) == F.substring("target", 2, 1 << 20))
        pairs = pairs.where(~swap)
    edit = F.coalesce(va.near1(F.col("form"), F.col("target")), va.near1(F.col("bare"), F.col("target")))
    pairs = pairs.withColumn("r", edit).where("r is not null").select("form", "target", "r.k", "r.p")
    close = F.when(F.col("k") == "sub", alike(F.col("p"))).otherwise(F.col("p").isin(WEAK))
    short = ~F.contains(F.col("target"), F.lit(" ")) & (F.length("target") <= 4)
    if prefixes:
        pairs = pairs.where(~short | close)
    return pairs.withColumn("conf", F.when((F.col("k") == "sub") & alike(F.col("p")), "high").otherwise("medium"))


SIGNALS = ("hyphen", "spelling", "order", "prefix", "first", "last", "part")


def merge_signals(a: Column, b: Column, prefixes: str = "בלמושהכ") -> Column:
    """The signs, by name, that two different names are one person."""
    words = lambda x: F.filter(F.split(F.trim(x), r"[\s\-־–]+"), lambda w: w != "")
    aw, bw = words(a), words(b)
    same_n = (F.size(aw) == F.size(bw)) & (F.size(aw) > 0)
    near = lambda x, y: (x == y) | F.coalesce(F.when(va.near1(x, y)["k"] == "sub", alike(va.near1(x, y)["p"])).otherwise(va.near1(x, y)["p"].isin(WEAK)), F.lit(False))
    equal = same_n & (F.array_join(aw, " ") == F.array_join(bw, " "))
    spelling = same_n & ~equal & F.forall(F.zip_with(aw, bw, near), lambda x: x) & (F.length(F.array_join(aw, "")) >= 4)
    order = same_n & ~equal & ~spelling & (F.size(aw) >= 2) & (F.array_join(F.array_sort(aw), " ") == F.array_join(F.array_sort(bw), " "))
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    prefix = same_n & (F.length(long) == F.length(short) + 1) & long.rlike(f"^[{prefixes}]") & (F.substring(long, 2, 1 << 20) == short) & (F.length(F.regexp_replace(short, r"[\s\-־–]", "")) >= 3)
    sw, lw = F.when(F.size(aw) < F.size(bw), aw).otherwise(bw), F.when(F.size(aw) < F.size(bw), bw).otherwise(aw)
    fewer = (F.size(aw) != F.size(bw)) & F.forall(sw, lambda w: F.length(w) >= 3) & (F.size(sw) > 0)
    one = F.size(sw) == 1
    first = fewer & one & (F.get(lw, 0) == F.get(sw, 0))
    last = fewer & one & ~first & (F.element_at(F.when(F.size(lw) > 0, lw), -1) == F.get(sw, 0))
    part = fewer & ~first & ~last & (F.size(F.array_except(sw, lw)) == 0)
    made = F.array(*[F.when(c, name) for c, name in zip((equal & (a != b), spelling, order, prefix, first, last, part), SIGNALS)])
    return F.when(a == b, F.array().cast("array<string>")).otherwise(F.filter(made, lambda x: x.isNotNull()))
