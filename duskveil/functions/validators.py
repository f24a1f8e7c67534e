"""Checksums and calendar checks as columns; null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans

#: Month names and their numbers (one month has two spellings).
MONTHS = {"ינואר": 1, "פברואר": 2, "מרץ": 3, "מרס": 3, "אפריל": 4, "מאי": 5, "יוני": 6, "יולי": 7, "אוגוסט": 8, "ספטמבר": 9, "אוקטובר": 10, "נובמבר": 11, "דצמבר": 12}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(c: Column, i: Column) -> Column:
    return F.substring(c, i, F.lit(1)).cast("int")


def valid_id(c: Column) -> Column:
    """A national number: up to 9 digits, not all alike, weights 1 and 2 in turn, digit sums, divisible by 10."""
    d = digits(c)
    p = F.lpad(d, 9, "0")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda t, i: t + _fold(_digit(p, i) * F.when(i % 2 == 0, 2).otherwise(1)))
    return (F.length(d) > 0) & (F.length(d) <= 9) & ~d.rlike(r"^(\d)\1*$") & (total % 10 == 0)


def _fold(n: Column) -> Column:
    return F.when(n > 9, n - 9).otherwise(n)


def luhn(c: Column) -> Column:
    """A card number of 12 to 19 digits with the right check digit."""
    d = digits(c)
    return (F.length(d) >= 12) & (F.length(d) <= 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def iban_ok(c: Column) -> Column:
    """IL and 21 digits whose rearranged number leaves 1 when divided by 97."""
    t = F.upper(F.regexp_replace(c, "[\\s ]", ""))
    moved = F.concat(F.substring(t, 5, 40), F.lit("1821"), F.substring(t, 3, 2))  # I is 18, L is 21
    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), lambda m, i: (m * 10 + F.coalesce(_safe_digit(moved, i), F.lit(0))) % 97)
    return t.rlike(r"^IL[0-9]{21}$") & (rest == 1)


def _safe_digit(c: Column, i: Column) -> Column:
    return F.substring(c, i, F.lit(1)).try_cast("int")


def full_year(y: Column, ref_year: int) -> Column:
    """Two digits as 20xx up to ten years after the reference year, else 19xx; other years as they are."""
    n = y.try_cast("int")
    return F.when(F.length(y) != 2, n).when(2000 + n <= ref_year + 10, 2000 + n).otherwise(1900 + n)


def parse_date(c: Column, ref_year: int) -> Column:
    """struct<d, m, y, form, sep, pd, pm, y2, conn> of a date that exists, else null. y is null without a year; then
    29.2 counts as a date."""
    num, iso = r"^(\d{1,2})([./-])(\d{1,2})(?:\2(\d{4}|\d{2}))?$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    word = r"^(\d{1,2})(\s+[בל]?-?)(" + "|".join(MONTHS) + r")(?:(,?\s+)(\d{4}))?$"
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    groups = {"n": (num, 4), "i": (iso, 3), "w": (word, 5)}

    def read(t: Column) -> Column:
        return F.struct(*[F.nullif(F.regexp_extract(t, rx, k), F.lit("")).alias(f"{name}{k}") for name, (rx, size) in groups.items() for k in range(1, size + 1)])

    def parts(x: Column) -> Column:
        form = F.when(x["n1"].isNotNull() & (x["n4"].isNotNull() | (x["n2"] != "-")), "num").when(x["i1"].isNotNull(), "iso").when(x["w1"].isNotNull(), "words")
        return spans.let(form, lambda form: F.struct(
            form.alias("form"), F.when(form == "num", x["n1"]).when(form == "iso", x["i3"]).otherwise(x["w1"]).alias("d"), F.when(form == "num", x["n3"]).when(form == "iso", x["i2"]).alias("m"),
            F.when(form == "words", F.element_at(month, F.coalesce(x["w3"], F.lit("")))).when(form == "num", x["n3"].try_cast("int")).otherwise(x["i2"].try_cast("int")).alias("mi"),
            F.when(form == "num", full_year(x["n4"], ref_year)).when(form == "iso", x["i1"].try_cast("int")).otherwise(x["w5"].try_cast("int")).alias("y"),
            x["n2"].alias("sep"), F.coalesce(F.length(x["n4"]) == 2, F.lit(False)).alias("y2"), F.when(form == "words", x["w2"]).alias("conn"), x["w4"].alias("gap"), x["w3"].alias("month"),
        ))

    def dated(x: Column) -> Column:
        ref = F.coalesce(x["y"], F.when((x["mi"] == 2) & (x["d"].try_cast("int") == 29), 2024).otherwise(2025))
        date = F.try_make_timestamp(ref, x["mi"], x["d"].try_cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        zero = lambda c: F.coalesce((F.length(c) == 2) & c.startswith("0"), F.lit(False))
        pad = lambda c: F.when(x["form"] == "iso", F.length(c) == 2).otherwise(zero(c))
        made = lambda date: F.struct(x["d"].try_cast("int").alias("d"), x["mi"].alias("m"), x["y"].alias("y"), x["form"].alias("form"), x["sep"].alias("sep"), pad(x["d"]).alias("pd"), pad(x["m"]).alias("pm"), x["y2"].alias("y2"), x["conn"].alias("conn"), x["gap"].alias("gap"), x["month"].alias("month"), date.alias("date"))
        return spans.let(date, lambda date: F.when(x["form"].isNotNull() & date.isNotNull(), made(date)))

    return spans.let(F.trim(c), lambda t: spans.let(read(t), lambda x: spans.let(parts(x), dated)))


def shift_date(c: Column, days: Column, ref_year: int) -> Column:
    """The date so many days later in the same spelling; null if it is no date."""
    return spans.let(parse_date(c, ref_year), lambda p: spans.let(F.date_add(p["date"], days), lambda t: _spelled(p, t)))


def _spelled(p: Column, t: Column) -> Column:
    z = lambda n, pad: F.when(pad & (n < 10), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    y, m, d = F.year(t), F.month(t), F.day(t)
    dm = F.concat(z(d, p["pd"]), p["sep"], z(m, p["pm"]))
    year = F.when(p["y2"], F.lpad((y % 100).cast("string"), 2, "0")).otherwise(y.cast("string"))
    names = F.array(*[F.lit(k) for k, v in MONTHS.items() if k != "מרס"])
    name = F.when((m == 3) & (p["month"] == "מרס"), "מרס").otherwise(F.element_at(names, m))
    words = F.concat(d.cast("string"), p["conn"], name, F.when(p["y"].isNull(), "").otherwise(F.concat(p["gap"], y.cast("string"))))
    return F.when(p["form"] == "iso", F.concat_ws("-", y.cast("string"), z(m, p["pm"]), z(d, p["pd"]))).when(p["form"] == "words", words).when(p["y"].isNull(), dm).otherwise(F.concat(dm, p["sep"], year))


def near1(a: Column, b: Column) -> Column:
    """struct<k, p> if one edit separates two strings: ``sub`` and both letters, or ``len`` and the letter more."""
    pre = F.length(F.coalesce(F.array_max(F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.when(F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i), F.substring(a, F.lit(1), i)))), F.lit("")))
    at = lambda x: F.substring(x, pre + 1, F.lit(1))
    made = F.when(F.length(a) == F.length(b), F.struct(F.lit("sub").alias("k"), F.concat(at(a), at(b)).alias("p"))).when(F.length(a) > F.length(b), F.struct(F.lit("len").alias("k"), at(a).alias("p"))).otherwise(F.struct(F.lit("len").alias("k"), at(b).alias("p")))
    return F.when(F.levenshtein(a, b, 1) == 1, made)
