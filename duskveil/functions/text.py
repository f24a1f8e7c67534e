"""Scalar text functions as columns: normalisation, tokens, prefixes, numerals, hashes, classes.

Offsets count code points. Every function takes and gives null for null unless it says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stand-in for marks without width (private use), typographic signs and their ASCII forms, prefix
#: letters, letters that swallow the definite letter after them, numeral letters, months.
SENTINEL = "\ue000"
SIGNS = {"׳": "'", "״": '"', "‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", " ": " ", " ": " ", " ": " "}
MARKS = "‎‏​‌‍" + "".join(map(chr, range(0x0591, 0x05C8)))
SINGLE_PREFIXES = ["ה", "ו", "ב", "ל", "מ", "כ", "ש"]
DOUBLE_PREFIXES = ["וה", "ול", "וב", "ומ", "וכ", "וש", "שה", "של", "שב", "שכ", "שמ", "כש", "מה", "לכ", "בה"]
SAFE_PREFIXES = ["ה", "ו", "ל", "ב"]
MERGING = ["ב", "ל", "כ", "ה"]
ONES = ["", "א", "ב", "ג", "ד", "ה", "ו", "ז", "ח", "ט"]
TENS = ["", "י", "כ", "ל", "מ", "נ", "ס", "ע", "פ", "צ"]
HUNDREDS = ["", "ק", "ר", "ש", "ת"]

#: Words: ``he`` as the Hebrew chain reads them, ``any`` for letters of every script.
WORDS = {"he": "[֐-׿](?:['\"׳״-]?[֐-׿])*['׳]?", "any": r"[\p{L}\p{M}]+(?:['-][\p{L}\p{M}]+)*"}

_H = "֐-׿"
#: Java boundaries of a value: a Latin neighbour blocks, letter beside letter and digit beside digit block, a quote belongs
#: to a word only with letters on both sides.
LEFT = f"(?<![A-Za-z])(?:(?<![{_H}])|(?![{_H}]))(?:(?<![0-9])|(?![0-9]))(?<![{_H}A-Za-z0-9]{{2}}\")(?<![{_H}A-Za-z0-9]')"
RIGHT = f"(?![A-Za-z])(?:(?<![{_H}])|(?![{_H}]))(?:(?<![0-9])|(?![0-9]))(?!['\"][{_H}A-Za-z0-9])"


def norm(c: Column) -> Column:
    """Signs in ASCII, marks without width as the sentinel; the length stays."""
    return F.translate(c, MARKS + "".join(SIGNS), SENTINEL * len(MARKS) + "".join(SIGNS.values()))


def norm_text(c: Column) -> Column:
    """A key of equality: no points, one space between words, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[֑-ׇ]", ""), "[\\s   ]+", " "))


def flex(c: Column) -> Column:
    """A pattern that finds the value with spaces and hyphens alike."""
    return F.regexp_replace(F.regexp_replace(norm(c), r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"[\s-]+", r"[\\s-]+")


def escape_xml(c: Column) -> Column:
    """&, < and > as entities."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column) -> Column:
    """escape_xml and both quotes."""
    return F.replace(F.replace(escape_xml(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def trim_edges(c: Column) -> Column:
    """Without punctuation at the edges; an apostrophe after a Hebrew letter stays."""
    left = F.regexp_replace(c, r"""^[\s.,;:!?()\[\]{}"'«»*_/\\-]+""", "")
    return F.regexp_replace(left, f"""(?:[\\s.,;:!?()\\[\\]{{}}"«»*_/\\\\-]|(?<![{_H}])'|(?<=['"])')+$""", "")


def stems(c: Column) -> Column:
    """The word and what is left without one or two prefix letters, at least two letters each."""
    one = F.when(c.rlike("^[הובלמכש]") & (F.length(c) >= 3), F.substring(c, 2, 1 << 20))
    two = F.when(c.rlike("^[הובלמכש]{2}") & (F.length(c) >= 4), F.substring(c, 3, 1 << 20))
    return F.array_distinct(F.filter(F.array(c, one, two), lambda x: x.isNotNull()))


def variants(c: Column, level: str = "normal", protect: Column | None = None) -> Column:
    """array<struct<form, pre>>: a name with each prefix of a level (off, safe, normal), but no protected string."""
    none = F.array(F.struct(c.alias("form"), F.lit("").alias("pre")))
    prefixes = {"off": [], "safe": SAFE_PREFIXES, "normal": SINGLE_PREFIXES + DOUBLE_PREFIXES}[level]
    if not prefixes:
        return none
    made = F.transform(F.array(*map(F.lit, prefixes)), lambda p: F.struct(F.concat(p, c).alias("form"), p.alias("pre")))
    made = F.filter(made, lambda x: ~F.array_contains(protect, x["form"])) if protect is not None else made
    return F.when(c.rlike("^[א-ת]"), F.concat(none, made)).otherwise(none)


def add_prefix(pre: Column, value: Column, owns_he: Column | bool = False) -> Column:
    """The prefix and the value; the definite letter falls after four prefixes unless the value owns it."""
    owns = F.lit(owns_he) if isinstance(owns_he, bool) else owns_he
    merges = value.startswith("ה") & F.substring(pre, -1, 1).isin(MERGING) & ~owns
    return F.when(F.coalesce(pre, F.lit("")) == "", value).when(F.coalesce(value, F.lit("")) == "", pre).when(merges, F.concat(pre, F.substring(value, 2, 1 << 20))).otherwise(F.concat(pre, value))


def numeral(n: Column) -> Column:
    """1 to 499 in letters (15 and 16 as 9 + 6 and 9 + 7), others as digits between marks of direction."""
    of = lambda table, i: F.element_at(F.array(*map(F.lit, table)), (i + 1).cast("int"))
    rest = n % 100
    tail = F.when(rest == 15, "טו").when(rest == 16, "טז").otherwise(F.concat(of(TENS, F.floor(rest / 10)), of(ONES, rest % 10)))
    letters = F.concat(of(HUNDREDS, F.least(F.floor(n / 100), F.lit(4))), tail)
    quoted = F.regexp_replace(letters, "^(.+)(.)$", '$1"$2')
    return F.when((n < 1) | (n >= 500), F.concat(F.lit("‏"), n.cast("string"), F.lit("‏"))).when(F.length(letters) > 1, quoted).otherwise(F.concat(letters, F.lit("׳")))


def context(text: Column, s: Column, e: Column, width: int = 55) -> tuple[Column, Column, Column]:
    """(before, match, after) with an ellipsis where the text goes on."""
    start, end = F.greatest(s - width, F.lit(0)), F.least(e + width, F.length(text))
    before = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, s - start))
    after = F.concat(F.substring(text, e + 1, end - e), F.when(end < F.length(text), "…").otherwise(""))
    return before, F.substring(text, s + 1, e - s), after


def hash32(c: Column) -> Column:
    """FNV-1a over code points, unsigned, as bigint; of the empty text its offset."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def ner_norm(c: Column) -> Column:
    """Lower case without points and Latin accents (the accents of the two Latin blocks below U+0180)."""
    accented = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    return F.translate(F.regexp_replace(F.lower(c), "[֑-ׇ̀-ͯ]", ""), accented, "aaaaaaceeeeiiiinooooouuuuyy")


def gap_class(c: Column) -> Column:
    """What kind of thing stands beside a match."""
    n = F.length(c).cast("string")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "none").when(c.rlike(r"^\s+$"), "space").when(c.contains("@"), "email")
        .when(c.rlike("^[0-9]+$"), F.concat(F.lit("digits("), n, F.lit(")"))).when(c.rlike("^[A-Za-z]+$"), F.concat(F.lit("latin("), n, F.lit(")")))
        .when(c.rlike(f"^[{_H}]+$"), "word").when(c.rlike("^[A-Za-z0-9]+$"), F.concat(F.lit("mixed("), n, F.lit(")"))).when(c.rlike(r"^[^\p{L}\p{N}]+$"), "punct").otherwise("other")
    )


def doc_shape(paragraphs: Column, turns: Column, numbered: Column, stamps: Column) -> Column:
    """The genre that line counts suggest."""
    return F.when(turns >= F.greatest(F.lit(3), F.ceil(paragraphs * 3 / 10)), "transcript").when(numbered >= 3, "filing").when(stamps >= 1, "chat").otherwise("prose")


def trim_tail_words(c: Column, drop: list[str]) -> Column:
    """Without words of a lexicon at the end, until none is there."""
    words = F.reverse(F.split(F.trim(c), r"\s+"))
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(drop), acc).otherwise(F.concat(F.array(w), acc)))
    return F.array_join(kept, " ")


def clean_name(c: Column, lead: list[str], tail: list[str], most: int = 3) -> Column:
    """A candidate name without lead and tail words, at most three words."""
    words = F.split(F.trim(trim_edges(c)), r"\s+")
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(lead), acc).otherwise(F.concat(acc, F.array(w))))
    return F.array_join(F.slice(F.split(trim_tail_words(F.array_join(kept, " "), tail), " "), 1, most), " ")


def place_kind(text: Column, s: Column, kinds: dict[str, str]) -> Column:
    """The kind whose word stands last in the 20 characters before a place."""
    before = F.concat(F.lit(" "), F.substring(text, F.greatest(s - 19, F.lit(1)), F.least(s, F.lit(20))))
    at = [(kind, F.length(before) - F.instr(F.reverse(before), word[::-1] + " ")) for word, kind in kinds.items()]
    found = F.array(*[F.when(F.instr(before, " " + word) > 0, F.struct(p.alias("p"), F.lit(k).alias("k"))) for (k, p), word in zip(at, kinds)])
    return F.array_max(F.filter(found, lambda x: x.isNotNull()))["k"]


def first_of(*cases: tuple[Column, str]) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
