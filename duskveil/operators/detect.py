"""Table-driven detectors and the passes that follow them.

A detector is a row: type, Java pattern, capture group, validator, priority, on by default. Rows per locale are data:
``HEBREW`` holds the 22 types of Hebrew documents, ``NEUTRAL`` those that need no language. A hit whose validator fails
stays as one to review and is not applied.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text as tx, validators as va

L, R = tx.LEFT, tx.RIGHT
_DAY, _MON = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
_MONTH = "(?:ינואר|פברואר|מר[ץס]|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר)"
_UNIT = "(?:מיליון|מיליארד|אלף|אלפי|אחוז|חדר|ש\"ח|₪|\\$|דולר|יורו|ק\"ג|ק\"מ|מ\"ר|מטר|שנ|נקוד|ליטר|גרם|קילו|דונם|מעלות)"
_CUE = "(?:ביום|מיום|ליום|בתאריך|מתאריך|לתאריך|תאריך|ה[-\ue000]|מה[-\ue000])"
_YEAR = r"(?:\d{4}|\d{2})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_STREET = "(?:רחוב|רח'|שדרות|שד'|סמטת|סמטה|דרך|שכונת|כיכר|ככר|מעלה|נחל|משעול)"
_WORD = "[\u0590-\u05ff\"'-]+"


@dataclass(frozen=True)
class Detector:
    type: str
    rx: str
    group: int = 0
    valid: str | None = None
    prio: int = 3
    on: bool = True
    cue: str | None = None  # text without this string, or without digits for "0-9", has no match: a cheap test first


#: Types of Hebrew documents: fixed values, whose patterns say what an identifier is. They read normalised text.
HEBREW = [
    Detector("EMAIL", r"(?<![\w.%+-])[\w.%+-]+@[\w.-]+\.[A-Za-zא-ת]{2,}", prio=0),
    Detector("DATE", "|".join([
        rf"{L}\d{{1,2}}[./]\d{{1,2}}[./]{_YEAR}{R}", rf"{L}{_DAY}-{_MON}-{_YEAR}{R}", rf"{L}\d{{4}}-{_MON}-{_DAY}{R}",
        rf"{L}{_DAY}\s+[בל]?[-\ue000]?{_MONTH}(?:,?\s+\d{{4}}(?![0-9]))?(?![א-ת0-9])",
        rf"(?<=(?<![א-ת])ו?{_CUE}[:\s]{{0,8}}){_DAY}[./]{_MON}(?![0-9%]|[./-][0-9]|\s*{_UNIT})",
    ]), prio=5),
    Detector("PHONE_MOBILE", rf"{L}(?:\+?972[-\s]?|0)5\d[-\s.]?\d{{3}}[-\s.]?\d{{4}}{R}"),
    Detector("PHONE_LAND", rf"{L}(?:\+?972[-\s]?|0)(?:[2-4689]|7\d)[-\s.]?\d{{3}}[-\s.]?\d{{4}}{R}", prio=4),
    Detector("PHONE_TOLL", r"\*\d{3,5}|1[-\s]?[38]00[-\s]?\d{3}[-\s]?\d{3}"),
    Detector("FAX", r"(?:פקס|פקסימיליה)[:\s]*(\+?\d[\d\-\s]{7,13}\d)", 1),
    Detector("ISRAELI_ID", rf"{L}\d{{9}}{R}", valid="id", prio=1),
    Detector("ISRAELI_ID_LABELED", r"(?:ת\.?\s?ז\.?|ת\"ז|מ\.?\s?ז\.?|תעודת\s+זהות|מספר\s+זהות|ח\.?\s?פ\.?|ח\"פ|ע\"ר|ת\.?\s?ז\.?\s?מס')[:\s.]*(\d{5,9})", 1, prio=0),
    Detector("CREDIT_CARD", rf"{L}\d(?:[ -]?\d){{11,18}}{R}", valid="luhn", prio=1),  # without a separator at the end
    Detector("IBAN", r"(?<![A-Za-z0-9_])IL\d{2}[\d\s]{18,22}\d(?![A-Za-z0-9_])", valid="iban", prio=1),
    Detector("PLATE", rf"{L}(?:\d{{2}}-\d{{3}}-\d{{2}}|\d{{3}}-\d{{2}}-\d{{3}}){R}", prio=2),
    Detector("ADDRESS_STREET", rf"{_STREET}\s+{_WORD}(?:\s+{_WORD}){{0,3}}\s+\d{{1,4}}(?:\s?[א-ת](?![\u0590-\u05ff]))?(?:\s*[/\\]\s*\d{{1,3}}\s?[א-ת]?)?", prio=2),
    Detector("DOB", r"(?:יליד(?:ת|י)?|ת\.?\s?לידה|תאריך\s+לידה)[:\s-]*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", 1, prio=2),
    Detector("URL_PERSONAL", r"https?://(?:www\.)?(?:facebook|linkedin|instagram|twitter|x)\.com/\S+", prio=2),
    Detector("ZIPCODE", r"(?:מיקוד|ת\.?ד\.?)[:\s.]*(\d{5,7})", 1),
    Detector("ZIP_BARE", rf"{L}\d{{7}}{R}", prio=4, on=False),
    Detector("CASE_NUMBER", r"(?:ת\"א|ת\"פ|ע\"א|בג\"ץ|ה\"פ|ת\"ק|רע\"א|ע\"פ|תמ\"ש|עמ\"ש)\s*\d{1,6}[-/]\d{1,2}[-/]\d{2,4}", on=False),
    Detector("BANK_ACCOUNT", r"(?:חשבון|ח-ן)\s*(?:מס'?|מספר)?[:\s]*(\d{2,3}[-/]\d{3}[-/]\d{4,9})", 1),
    Detector("LAWYER_LIC", r"(?:מ\.?\s?ר\.?|מספר\s+רישיון|רישיון\s+מס')[:\s]*(\d{4,7})", 1, prio=2),
    Detector("NOTARY", r"(?:נוטריון|רישיון\s+נוטריון)[^\d]{0,12}(\d{3,7})", 1),
    Detector("PASSPORT", r"(?:דרכון|passport)[:\s.#]*([A-Z0-9]{6,9})", 1),
    Detector("IP", rf"(?<![A-Za-z0-9_])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9_])", on=False),
]

#: Plain patterns without look-around: the same in every regular-expression dialect.
NEUTRAL = [
    Detector("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", prio=0, cue="@"),
    Detector("CREDIT_CARD", r"\b\d(?:[ -]?\d){11,18}\b", valid="luhn", prio=1, cue="0-9"),
    Detector("NATIONAL_ID", r"\b\d{9}\b", valid="id", prio=1, cue="0-9"),
    Detector("PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}", cue="+1 ("),
    Detector("IP", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", valid="octets", cue="0-9"),
]

#: Families of types (fixed values).
FAMILY = {
    "PLACE_CITY": "PLACE", "PLACE_VENUE": "PLACE", "ISRAELI_ID": "ID", "ISRAELI_ID_LABELED": "ID", "NATIONAL_ID": "ID",
    "PHONE_MOBILE": "PHONE", "PHONE_LAND": "PHONE", "PHONE_TOLL": "PHONE", "FAX": "PHONE", "ADDRESS_STREET": "ADDRESS", "NAME_ANCHORED": "NAME",
}


def family(t: Column) -> Column:
    """The family of a type; the type itself where it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv]), t), t)


def canonical_key(t: Column, value: Column) -> Column:
    """Family and normalised value: digits of numbers, the last nine of telephones, lower case of addresses."""
    f, v = family(t), F.trim(tx.norm(value))
    key = F.when(f == "ID", va.digits(v)).when(f == "PHONE", F.substring(va.digits(v), -9, 9)).when(f == "EMAIL", F.lower(v)).otherwise(v)
    return F.concat(f, F.lit("|"), key)


def _valid(kind: str | None, t: Column, ref_year: int) -> Column:
    if kind is None:
        return F.lit(True)
    if kind == "octets":
        return F.forall(F.split(t, r"\."), lambda x: x.try_cast("int") <= 255)
    if kind == "date":
        return va.parse_date(t, ref_year).isNotNull()
    return {"id": va.valid_id, "luhn": va.luhn, "iban": va.iban_ok}[kind](t)


#: A hit as the resolver orders it.
HIT = "struct<s:int,rk:int,prio:int,neg:int,e:int,type:string,t:string,ok:boolean>"


def hits(text: Column, detectors: list[Detector], ref_year: int = 2026) -> Column:
    """array of HIT of all detectors, unresolved; null text has none. ``HEBREW`` expects ``tx.norm(text)``."""
    def of(d: Detector) -> Column:
        found = F.transform(spans.matches(text, d.rx, d.group), lambda m: F.struct(m["s"].alias("s"), F.lit(1).alias("rk"), F.lit(d.prio).alias("prio"), (m["s"] - m["e"]).alias("neg"), m["e"].alias("e"), F.lit(d.type).alias("type"), m["t"].alias("t"), F.coalesce(_valid(d.valid, m["t"], ref_year), F.lit(False)).alias("ok")).cast(HIT))
        if d.cue is None:
            return found
        cue = text.rlike("[0-9]") if d.cue == "0-9" else F.contains(text, F.lit(d.cue))
        return F.when(cue, found).otherwise(F.array().cast(f"array<{HIT}>"))

    return F.coalesce(F.concat(*map(of, detectors)), F.array().cast(f"array<{HIT}>"))


def verdicts(df: DataFrame, on: set[str], flag: set[str]) -> DataFrame:
    """Rows of hits(type, ok, ...) with apply, review and conf; types neither on nor to flag go."""
    known = F.col("type").isin(sorted(on)) if on else F.lit(False)
    high = F.col("ok") & known
    shown = known | (F.col("type").isin(sorted(flag)) if flag else F.lit(False))
    return df.where(shown).withColumn("apply", high).withColumn("conf", F.when(high, "high").otherwise("medium")).withColumn("review", ~high)


def absorb_prefix(text: Column, s: Column) -> Column:
    """struct<s, pre>: the span's start moved over one attached prefix letter."""
    before = F.substring(text, s, F.lit(1))
    free = (s <= 1) | ~F.substring(text, s - 1, F.lit(1)).rlike("[א-ת]")
    takes = (s > 0) & before.isin("ב", "מ", "ל", "ה") & free
    return F.when(takes, F.struct((s - 1).alias("s"), before.alias("pre"))).otherwise(F.struct(s.alias("s"), F.lit("").alias("pre")))


ZIP_AFTER = r"^[\s,]*(?:[^\s,]+[\s,]+){0,3}?(\d{7}|\d{5})(?!\d)"


def zip_after(text: Column, e: Column) -> Column:
    """struct<s, e, t> of the 5 or 7 digits that follow an address after at most three words within 60 characters."""
    tail = F.substring(text, e + 1, F.lit(60))
    z, whole = F.regexp_extract(tail, ZIP_AFTER, 1), F.regexp_extract(tail, ZIP_AFTER, 0)
    end = e + F.length(whole)
    return F.when(z != "", F.struct((end - F.length(z)).cast("int").alias("s"), end.cast("int").alias("e"), z.alias("t")))


#: Ages: a number after a word of age, or before a word of years (fixed values).
AGE_AFTER, AGE_BEFORE = r"(?<![א-ת])(?:בן|בת|בני|בנות|גיל|בגיל|כבן|כבת)\s+(\d{1,3})(?!\d)", r"(?<!\d)(\d{1,3})\s+(?:שנה|שנים|שנתיים|וחצי)(?![א-ת])"


def age_zones(text: Column) -> Column:
    """Spans of numbers that are ages."""
    return F.array_sort(F.array_distinct(F.concat(spans.matches(text, AGE_AFTER, 1), spans.matches(text, AGE_BEFORE, 1))))


def in_zone(s: Column, e: Column, zones: Column) -> Column:
    """Whether a span lies within one of the zones."""
    return F.exists(zones, lambda z: (z["s"] <= s) & (e <= z["e"]))


def literal_zones(text: Column, allowed: list[str]) -> Column:
    """Spans of allowed values, with a prefix letter or without."""
    rx = "(?:" + "|".join(r"\Q" + a + r"\E" for a in sorted(allowed, key=len, reverse=True)) + ")"
    return spans.matches(text, f"{L}[הובלמכש]?{rx}{R}") if allowed else F.array().cast("array<struct<s:int,e:int,t:string>>")


def contact_label(text: Column, e: Column) -> Column:
    """Whether what follows makes a word the label of a number: a colon and digits."""
    return F.substring(text, e + 1, F.lit(12)).rlike(r"^\s*:\s*[+*\d]")


PUBLIC_BODIES = ["עיריית", "משרד", "בית משפט", "מועצה", "Ministry", "Court", "Council"]


def public_title(text: Column, e: Column, bodies: list[str] | None = None) -> Column:
    """Whether the next word makes a one-word value a public body."""
    tail = F.ltrim(F.substring(text, e + 1, F.lit(24)))
    return reduce(lambda a, b: a | b, [tail.startswith(w) for w in bodies or PUBLIC_BODIES])
