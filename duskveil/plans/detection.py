"""Queries of detection and redaction: detectors, passes, resolution, the minimum chain (P, D, R1, R2, R5-R7, R12-R17, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans, text as tx
from ..operators import chain as whole, detect, substitute as su
from .registry import query, read, sql_values, values

N = {d.type: d for d in detect.NEUTRAL}
_VALID = {
    "EMAIL": "true", "PHONE": "true",
    "IP": "list_max([CAST(x AS INTEGER) for x in string_split(t, '.')]) <= 255",
    "CREDIT_CARD": "length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i:i] AS INTEGER) > 4 THEN CAST(d[i:i] AS INTEGER) * 2 - 9 ELSE CAST(d[i:i] AS INTEGER) * 2 END ELSE CAST(d[i:i] AS INTEGER) END for i in range(1, length(d) + 1)]) % 10 = 0",
    "NATIONAL_ID": "length(replace(d, d[1:1], '')) > 0 AND list_sum([CASE WHEN CAST(d[i:i] AS INTEGER) * (2 - i % 2) > 9 THEN CAST(d[i:i] AS INTEGER) * 2 - 9 ELSE CAST(d[i:i] AS INTEGER) * (2 - i % 2) END for i in range(1, 10)]) % 10 = 0",
}


def hit_sql(d: detect.Detector, table: str = "documents", key: str = "doc_id") -> str:
    """The hits of a neutral detector, by the same reconstruction of offsets."""
    return f"""
SELECT {key}, CAST(e - length(t) AS INTEGER) AS s, CAST(e AS INTEGER) AS e, '{d.type}' AS type, t, {d.prio} AS prio, {_VALID[d.type]} AS ok FROM (
  SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d, sum(length(g) + length(t)) OVER (PARTITION BY {key} ORDER BY i) AS e FROM (
    SELECT {key}, unnest(m) AS t, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM (
      SELECT {key}, regexp_extract_all(text, '{d.rx}') AS m, string_split_regex(text, '{d.rx}') AS g FROM {table} WHERE regexp_matches(text, '{d.rx}'))))"""


_ALL = " UNION ALL ".join(f"({hit_sql(d)})" for d in detect.NEUTRAL)
#: The greedy walk as recursion over hits in order of precedence.
_WALK = f"""
h AS ({_ALL}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, prio, s - e, type) AS rn FROM h WHERE ok),
w AS (SELECT doc_id, rn, s, e, type, t, true AS keep, e AS last FROM o WHERE rn = 1
  UNION ALL SELECT o.doc_id, o.rn, o.s, o.e, o.type, o.t, o.s >= w.last, CASE WHEN o.s >= w.last THEN o.e ELSE w.last END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1),
k AS (SELECT doc_id, s, e, type, t, CASE type WHEN 'NATIONAL_ID' THEN 'ID' ELSE type END AS fam FROM w WHERE keep),
c AS (SELECT *, fam || '|' || CASE fam WHEN 'ID' THEN regexp_replace(t, '[^0-9]', '', 'g') WHEN 'PHONE' THEN right(regexp_replace(t, '[^0-9]', '', 'g'), 9) WHEN 'EMAIL' THEN lower(t) ELSE t END AS key FROM k),
f AS (SELECT *, min(s) OVER (PARTITION BY doc_id, key) AS first FROM c),
r AS (SELECT doc_id, s, e, type, t, fam, key, CAST(dense_rank() OVER (PARTITION BY doc_id, fam ORDER BY first) AS INTEGER) AS n FROM f)"""


def _detector_query(d: detect.Detector) -> None:
    @query(f"D_{d.type.lower()}", f"SELECT doc_id, s, e, t, ok FROM ({hit_sql(d)})")
    def run(spark, sf_dir):
        rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(detect.hits(F.col("text"), [d])).alias("h"))
        return rows.select("doc_id", "h.s", "h.e", "h.t", "h.ok")


for _d in detect.NEUTRAL:
    if _d.type != "NATIONAL_ID":  # the tables hold none at most sizes; D_verdicts and V1 cover it
        _detector_query(_d)


def resolved_hits(text):
    """The resolved valid hits of a text, as an array."""
    return spans.resolve(F.filter(detect.hits(text, detect.NEUTRAL), lambda h: h["ok"]))


def resolved(spark, sf_dir):
    """documents with their resolved valid hits, as arrays in the document's row."""
    return read(spark, sf_dir, "documents").select("doc_id", "text", resolved_hits(F.col("text")).alias("kept"))


@query("D_verdicts", f"WITH h AS ({_ALL}) SELECT doc_id, s, type, ok AND type <> 'NATIONAL_ID' AS apply, NOT (ok AND type <> 'NATIONAL_ID') AS review, CASE WHEN ok AND type <> 'NATIONAL_ID' THEN 'high' ELSE 'medium' END AS conf FROM h WHERE type <> 'PHONE'")
def verdicts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(detect.hits(F.col("text"), detect.NEUTRAL)).alias("h")).select("doc_id", "h.s", "h.type", "h.ok")
    return detect.verdicts(rows, {"EMAIL", "CREDIT_CARD", "IP"}, {"NATIONAL_ID"}).select("doc_id", "s", "type", "apply", "review", "conf")


_HE = [
    ("EMAIL", "כתבו אל dana@example.co.il היום", "dana@example.co.il", True), ("DATE", "נפגשנו ביום 12.3.2026 בבוקר", "12.3.2026", True), ("DATE", "ביום 31.2.2026 לא היה", "31.2.2026", True),
    ("DATE", "הוגש 12 במרץ 2026 לתיק", "12 במרץ 2026", True), ("DATE", "נקבע ביום 12.3 בשעה", "12.3", True), ("PHONE_MOBILE", "טלפון: 050-123-4567.", "050-123-4567", True), ("PHONE_MOBILE", "חייג +972-52-1234567", "+972-52-1234567", True),
    ("PHONE_LAND", "משרד 03-123-4567", "03-123-4567", True), ("PHONE_TOLL", "מוקד 1-800-123-456", "1-800-123-456", True), ("PHONE_TOLL", "חייגו *1234 עכשיו", "*1234", True), ("FAX", "פקס: 03-7654321", "03-7654321", True),
    ("ISRAELI_ID", "מספרה 123456782 בתיק", "123456782", True), ("ISRAELI_ID", "מספר 123456789 שגוי", "123456789", False), ("ISRAELI_ID_LABELED", 'ת"ז 1234567 ', "1234567", True), ("CREDIT_CARD", "כרטיס 4111 1111 1111 1111 בתוקף", "4111 1111 1111 1111", True),
    ("CREDIT_CARD", "כרטיס 4111-1111-1111-1112", "4111-1111-1111-1112", False), ("IBAN", "לחשבון IL620108000000099999999 בבנק", "IL620108000000099999999", True), ("PLATE", "רכב 12-345-67 חונה", "12-345-67", True), ("ADDRESS_STREET", "גר ברחוב, רחוב הזית הגדול 12א בעיר", "רחוב הזית הגדול 12א", True),
    ("DOB", "תאריך לידה: 1.2.1990", "1.2.1990", True), ("URL_PERSONAL", "ראו https://www.facebook.com/dana.levi שם", "https://www.facebook.com/dana.levi", True), ("ZIPCODE", "מיקוד 1234567", "1234567", True), ("ZIP_BARE", "עיר 7654321 סוף", "7654321", True),
    ("CASE_NUMBER", 'תיק ת"א 12345-06-24 נדון', 'ת"א 12345-06-24', True), ("BANK_ACCOUNT", "חשבון מס' 12-345-678901", "12-345-678901", True), ("LAWYER_LIC", "מ.ר. 12345", "12345", True), ("NOTARY", "נוטריון מספר 2112345", "2112345", True),
    ("PASSPORT", "דרכון: A1234567", "A1234567", True), ("DATE", "מה-4.1 עד סוף", "4.1", True), ("DATE", "בתאריך 2-3-26 נחתם", "2-3-26", True), ("DATE", "שולם 2026-03-12 במלואו", "2026-03-12", True), ("PHONE_MOBILE", "נייד 972.52.123.4567", None, None),
    ("PHONE_MOBILE", "נייד 052.123.4567", "052.123.4567", True), ("PHONE_LAND", "משרד 06-123-4567", "06-123-4567", True), ("PHONE_TOLL", "חייגו *123", "*123", True), ("PHONE_TOLL", "1-300-123-456", "1-300-123-456", True), ("FAX", "פקסימיליה 03 765 4321", "03 765 4321", True),
    ("ISRAELI_ID_LABELED", "ח.פ. 512345678", "512345678", True), ("ISRAELI_ID_LABELED", 'ע"ר 580123456', "580123456", True), ("ADDRESS_STREET", "ברח' בן-גוריון 7/3 דירה", "רח' בן-גוריון 7/3 ד", True), ("DOB", "ת. לידה 1/2/90", "1/2/90", True), ("URL_PERSONAL", "https://x.com/dana", "https://x.com/dana", True),
    ("ZIPCODE", "ת.ד. 12345", "12345", True), ("BANK_ACCOUNT", "ח-ן 12-345-6789", "12-345-6789", True), ("NOTARY", "נוטריון מס' 211", "211", True), ("LAWYER_LIC", "מספר רישיון 54321", "54321", True), ("PASSPORT", "passport AB12345", "AB12345", True),
    (None, "סעיף 12.3 לחוק", None, None), (None, "מחיר 2.5 מיליון", None, None), (None, "רף ה-4.1 מיליון", None, None), (None, "תיק 12345-06-24 נדון", None, None), (None, "כתובת 1.2.3.400 שגויה", None, None), (None, "www.facebook.com/dana", None, None), (None, "נולד 12345", None, None), ("IP", "שרת 192.168.1.20 פעיל", "192.168.1.20", True),
]
_HE_ROWS = [(i, typ, t, t.index(v) if v else None, t.index(v) + len(v) if v else None, v, ok) for i, (typ, t, v, ok) in enumerate(_HE)]


@query("D_hebrew_types", f"SELECT id, typ AS type, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, v AS t, ok FROM {sql_values('id, typ, text, s, e, v, ok', _HE_ROWS)} WHERE v IS NOT NULL")
def hebrew(spark, sf_dir):
    """All 22 detectors meet on every row; what the resolution keeps is all that there is."""
    df = values(spark, "id int, typ string, text string, s int, e int, v string, ok boolean", _HE_ROWS).repartition(4)
    found = df.select("id", F.inline(spans.resolve(detect.hits(tx.norm(F.col("text")), detect.HEBREW))))
    return found.select("id", "type", "s", "e", "t", "ok")


_CHAIN = [
    (1, "דנה לוי פגשה את רון. לדנה-לוי יש טלפון 050-123-4567 והיא בת 9.", "אבי כהן פגשה את גיל. לאבי כהן יש טלפון [טלפון א׳] והיא בת 9.", 4), (2, "ושרון אמרה: טל: 04-1234567.", "ו███ אמרה: טל: [טלפון א׳].", 2),
    (3, "גר ברחוב הזית 12, חיפה 1234567. נולד ביום 12.3.2026 בערב", "גר ב[כתובת א׳], [ZIPCODE א׳]. נולד ביום 12.8.2026 בערב", 4), (4, None, None, 0), (5, 'ת"ז 123456789 ועוד 123456782 ושוב 123456782, ורון ב רון', 'ת"ז [ת"ז א׳] ועוד [ת"ז ב׳] ושוב [ת"ז ב׳], וגיל ב גיל', 5),
    (6, "", "", 0), (7, "דָּנָה לוי וכרמל, 123456789", "אבי כהן וכרמל, 123456789", 1),
]


@query("chain_full", f"SELECT id, redacted, CAST(n AS INTEGER) AS n_applied, 0 AS leaks FROM {sql_values('id, text, redacted, n', _CHAIN)}")
def chain_full(spark, sf_dir):
    """List rules, prefixes, allowed values, ages, addresses, dates, styles and pseudonyms in one chain, on Hebrew documents."""
    rules = [whole.Rule("דנה לוי"), whole.Rule("רון", replacement="גיל"), whole.Rule("שרון", style="black"), whole.Rule("טל"), whole.Rule("חיפה", "PLACE", style="blank"), whole.Rule("כרמל")]
    opt = whole.Options(names=("אבי כהן", "גלית בר"), labels={"PHONE": "טלפון", "ADDRESS": "כתובת", "ID": 'ת"ז'})
    made = whole.redact(values(spark, "id int, text string", [r[:2] for r in _CHAIN]).repartition(4), rules, ["כרמל"], opt)
    return made.select("id", "redacted", F.size(F.filter("edits", lambda x: x["apply"])).alias("n_applied"), F.size("leaks").alias("leaks"))


@query("chain_tables", f"WITH RECURSIVE {_WALK} SELECT doc_id, CAST((SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS INTEGER) AS n_applied, 0 AS leaks FROM documents d")
def chain_tables(spark, sf_dir):
    """The same chain on all documents, with the detectors that need no language."""
    opt = whole.Options(on=tuple(d.type for d in detect.NEUTRAL), detectors=tuple(detect.NEUTRAL), mode="block", prefixes="off")
    made = whole.redact(read(spark, sf_dir, "documents").select("doc_id", "text"), [], [], opt)
    return made.select("doc_id", F.size(F.filter("edits", lambda x: x["apply"])).alias("n_applied"), F.size("leaks").alias("leaks"))


_R1 = [(1, 0, 9, "pattern", 1), (1, 0, 9, "list", 0), (1, 4, 12, "pattern", 0), (1, 9, 14, "pattern", 3), (1, 20, 25, "pattern", 2)]


@query("R1_resolve_fixture", "SELECT 1 AS doc_id, * FROM (VALUES (0, 9, 'list'), (9, 14, 'pattern'), (20, 25, 'pattern')) AS v(s, e, src)")
def r1(spark, sf_dir):
    df = values(spark, "doc_id int, s int, e int, src string, prio int", _R1)
    hit = F.struct("s", F.when(F.col("src") == "list", 0).otherwise(1).alias("rk"), "prio", (F.col("s") - F.col("e")).alias("neg"), "e", "src")
    return df.groupBy("doc_id").agg(F.collect_list(hit).alias("h")).select("doc_id", F.inline(spans.resolve(F.col("h")))).select("doc_id", "s", "e", "src")


@query("R1_resolve", f"WITH RECURSIVE {_WALK} SELECT doc_id, s, e, type, t FROM k")
def r1_docs(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", F.inline("kept")).select("doc_id", "s", "e", "type", "t")


@query("R2_canonical_key", f"WITH RECURSIVE {_WALK} SELECT doc_id, s, fam, key FROM c")
def r2(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", F.inline(su.keyed(F.col("kept")))).select("doc_id", "s", "fam", "key")


@query("R6_ordinals", f"WITH RECURSIVE {_WALK} SELECT doc_id, s, fam, key, n FROM r")
def r6(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", F.inline(su.ordinals(su.keyed(F.col("kept"))))).select("doc_id", "s", "fam", "key", "n")


_GAPS = """,
g AS (SELECT r.doc_id, r.s, r.e, '[' || fam || ' ' || n || ']' AS rep, coalesce(lag(r.e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) AS prev, text, max(r.e) OVER (PARTITION BY r.doc_id) AS last FROM r JOIN documents USING (doc_id)),
red AS (SELECT doc_id, string_agg(substr(text, prev + 1, s - prev) || rep, '' ORDER BY s) || substr(any_value(text), any_value(last) + 1) AS redacted FROM g GROUP BY doc_id)"""


@query("R12_redacted_text", f"WITH RECURSIVE {_WALK}{_GAPS} SELECT doc_id, md5(coalesce(redacted, text)) AS redacted_md5, CAST(length(coalesce(redacted, text)) AS BIGINT) AS n_chars FROM documents LEFT JOIN red USING (doc_id)")
def r12(spark, sf_dir):
    out = su.labelled(F.col("text"), su.ordinals(su.keyed(F.col("kept"))))
    return resolved(spark, sf_dir).select("doc_id", out.alias("r")).select("doc_id", F.md5(F.col("r").cast("binary")).alias("redacted_md5"), F.length("r").cast("long").alias("n_chars"))


def redacted(spark, sf_dir):
    """documents with their hits (ordinals) and redacted text; each document in its own row, nothing shuffled."""
    made = resolved(spark, sf_dir).withColumn("hits", su.ordinals(su.keyed(F.col("kept"))))
    return made.withColumn("redacted", su.labelled(F.col("text"), F.col("hits")))


@query("chain_redact", f"WITH RECURSIVE {_WALK}{_GAPS} SELECT d.doc_id, CAST((SELECT count(*) FROM r WHERE r.doc_id = d.doc_id) AS INTEGER) AS n_hits, md5(coalesce(redacted, text)) AS redacted_md5, CAST((SELECT count(*) FROM r WHERE r.doc_id = d.doc_id AND contains(coalesce(red.redacted, d.text), r.t)) AS INTEGER) AS leaks FROM documents d LEFT JOIN red USING (doc_id)")
def chain(spark, sf_dir):
    """Scan, detect, resolve, label, splice, verify."""
    df = redacted(spark, sf_dir)
    leaks = F.size(F.filter("hits", lambda h: F.contains(F.col("redacted"), h["t"])))
    return df.select("doc_id", F.size("hits").alias("n_hits"), F.md5(F.col("redacted").cast("binary")).alias("redacted_md5"), leaks.alias("leaks"))


@query("W7_verify", f"WITH RECURSIVE {_WALK}{_GAPS} SELECT r.doc_id, r.t AS secret, contains(red.redacted, r.t) AS leaked FROM (SELECT DISTINCT doc_id, t FROM r WHERE length(t) >= 2) r JOIN red USING (doc_id)")
def w7(spark, sf_dir):
    rows = redacted(spark, sf_dir).select("doc_id", "redacted", F.explode(F.array_distinct(F.transform("hits", lambda h: h["t"]))).alias("secret")).where(F.length("secret") >= 2)
    return rows.select("doc_id", "secret", F.contains("redacted", F.col("secret")).alias("leaked"))


@query("R17_shift", f"WITH RECURSIVE {_WALK} SELECT doc_id, s, CAST(s + coalesce(sum(length('[' || fam || ' ' || n || ']') - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS new_s FROM r")
def r17(spark, sf_dir):
    label = lambda h: F.length(h["fam"]) + F.length(h["n"].cast("string")) + 3
    moved = F.transform("hits", lambda h, i: F.struct(h["s"].alias("s"), (h["s"] + F.aggregate(F.slice("hits", F.lit(1), i), F.lit(0), lambda a, x: a + label(x) - (x["e"] - x["s"]))).cast("int").alias("new_s")))
    return redacted(spark, sf_dir).select("doc_id", F.inline(moved))


_STYLES = [(1, "blank", "NAME", "blank"), (2, None, "NAME", "label"), (3, None, "EMAIL", "black"), (4, None, "ORG", "name"), (5, None, "ID", "blank"), (6, None, "PLACE", "name")]


@query("R5_style", f"SELECT id, want AS style FROM {sql_values('id, rule, fam, want', _STYLES)}")
def r5(spark, sf_dir):
    by = F.create_map(*[F.lit(x) for x in ("NAME", "label", "EMAIL", "black", "*", "blank")])
    return values(spark, "id int, rule string, fam string, want string", _STYLES).select("id", su.style(F.col("rule"), by, F.col("fam")).alias("style"))


_GENDER = [(1, "Dana Levi", None, "f"), (2, "Omer Gal", None, "m"), (3, "Omer Gal", "f", "f"), (4, "Noa", None, "f"), (5, "רונית כהן", None, "f"), (6, "רון כהן", None, "m")]


@query("R7_gender", f"SELECT id, want AS gender, CASE WHEN regexp_matches(name, 'Gal') THEN 'ar' ELSE 'he' END AS origin FROM {sql_values('id, name, hint, want', _GENDER)}")
def r7(spark, sf_dir):
    df = values(spark, "id int, name string, hint string, want string", _GENDER)
    return df.select("id", su.gender(F.col("name"), F.col("hint"), ["Noa"], ["Omer"]).alias("gender"), su.origin(F.col("name"), ["Gal"]).alias("origin"))


_POOL = ["Adam", "Bela", "Cleo", "Dov", "Ella", "Finn", "Gil"]


@query(
    "R8_fake_names",
    """
WITH RECURSIVE v AS (SELECT c_nationkey AS g, c_name AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer QUALIFY rn <= 9),
h AS (SELECT *, CAST(list_reduce([ord(c) for c in string_split(v, '') if c <> ''], lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS BIGINT) AS seed FROM v),
p AS (SELECT *, [['Adam', 'Bela', 'Cleo', 'Dov', 'Ella', 'Finn', 'Gil'][((seed + k * 7 + (seed >> 8) % 3) % 7 + 1)] for k in range(0, 22)] AS probes FROM h),
w AS (SELECT g, rn, v, seed, coalesce([x for x in probes if x <> 'Finn'][1], ['Adam', 'Bela', 'Cleo', 'Dov', 'Ella', 'Finn', 'Gil'][seed % 7 + 1] || ' ' || (seed % 89 + 11)) AS fake FROM p WHERE rn = 1),
u AS (SELECT g, rn, v, fake, [fake] AS used FROM w
  UNION ALL SELECT p.g, p.rn, p.v, coalesce([x for x in p.probes if x <> 'Finn' AND NOT list_contains(u.used, x)][1], ['Adam', 'Bela', 'Cleo', 'Dov', 'Ella', 'Finn', 'Gil'][p.seed % 7 + 1] || ' ' || (p.seed % 89 + 11)),
    list_append(u.used, coalesce([x for x in p.probes if x <> 'Finn' AND NOT list_contains(u.used, x)][1], ['Adam', 'Bela', 'Cleo', 'Dov', 'Ella', 'Finn', 'Gil'][p.seed % 7 + 1] || ' ' || (p.seed % 89 + 11)))
  FROM u JOIN p ON p.g = u.g AND p.rn = u.rn + 1)
SELECT g, v AS real, fake FROM u""",
)
def r8(spark, sf_dir):
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("rn <= 9")
    groups = rows.groupBy(F.col("c_nationkey").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "c_name"))), lambda x: x["c_name"]).alias("v"))
    return groups.select("g", F.inline(su.fake_names(F.col("v"), _POOL, F.array(F.lit("Finn")))))


_ORGS = [(1, "Institute Carmel"), (2, "Bank Tavor"), (3, "Orchard"), (4, "Institute of Trees")]
_TAILS = ["North", "Garden", "River"]


@query("R9_fake_org", f"WITH o AS (SELECT *, CASE WHEN contains(name, ' ') THEN trim(name[instr(name, ' ') :]) ELSE '' END AS rest FROM {sql_values('id, name', _ORGS)}), h AS (SELECT *, list_reduce([ord(c) for c in string_split(rest, '') if c <> ''], lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS seed FROM o) SELECT id, CASE WHEN split_part(name, ' ', 1) IN ('Institute', 'Bank') THEN split_part(name, ' ', 1) || ' ' ELSE '' END || ['North', 'Garden', 'River'][seed % 3 + 1] AS fake FROM h")
def r9(spark, sf_dir):
    return values(spark, "id int, name string", _ORGS).select("id", su.fake_org(F.col("name"), ["Institute", "Bank"], _TAILS).alias("fake"))


_DEL = [(1, "a SECRET b", 2, 8, "a b"), (2, "a SECRET.", 2, 8, "a."), (3, "SECRET b", 0, 6, "b"), (4, "xSECRETy", 1, 7, "xy"), (5, "a SECRET", 2, 8, "a")]


@query("R13_deletion", f"SELECT id, want AS made FROM {sql_values('id, t, s, e, want', _DEL)}")
def r13(spark, sf_dir):
    df = values(spark, "id int, t string, s int, e int, want string", _DEL).withColumn("x", su.smooth(F.col("t"), F.col("s"), F.col("e")))
    return df.select("id", F.concat(F.substring("t", F.lit(1), F.col("x.s")), F.substring("t", F.col("x.e") + 1, F.length("t"))).alias("made"))


@query("R14_collisions", "SELECT DISTINCT fake, doc_id FROM (VALUES ('thing'), ('Erin'), ('Zz-none')) AS f(fake) JOIN (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) t ON t.w = f.fake")
def r14(spark, sf_dir):
    fakes = F.broadcast(values(spark, "fake string", [("thing",), ("Erin",), ("Zz-none",)]))  # a pool of fixed size
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("w"))
    return words.join(fakes, F.col("w") == F.col("fake")).select("fake", "doc_id")


_PIN = [(1, "Dana", True, "name"), (2, "Dana", True, "label"), (3, "Dana", False, "blank")]


@query("R15_pinned", f"SELECT id, CASE WHEN pinned AND style <> 'name' THEN NULL ELSE rep END AS rep FROM {sql_values('id, rep, pinned, style', _PIN)}")
def r15(spark, sf_dir):
    return values(spark, "id int, rep string, pinned boolean, style string", _PIN).select("id", F.when(F.col("pinned") & (F.col("style") != "name"), None).otherwise(F.col("rep")).alias("rep"))


@query("R16_ambiguity", f"WITH RECURSIVE {_WALK}, g AS (SELECT doc_id, fam, CAST(count(DISTINCT key) AS INTEGER) AS n_values FROM r GROUP BY doc_id, fam) SELECT doc_id, fam AS rep, n_values, contains(text, fam) AS occurs, n_values > 1 OR contains(text, fam) AS ambiguous FROM g JOIN documents USING (doc_id)")
def r16(spark, sf_dir):
    """Labels without a number as substitutes."""
    pairs = F.transform(su.keyed(F.col("kept")), lambda h: F.struct(h["key"].alias("value"), h["fam"].alias("rep")))
    rows = resolved(spark, sf_dir).select("doc_id", "text", pairs.alias("pairs"))
    return rows.select("doc_id", F.inline(su.ambiguity(F.col("text"), F.col("pairs"))))


_P1 = [(1, "גר ברחוב הזית 3", 4, 3, "ב"), (2, "רחוב הזית 3", 0, 0, ""), (3, "של שברחוב", 5, 5, "")]


@query("P1_address_prefix", f"SELECT id, want_s AS s, want_pre AS pre FROM {sql_values('id, t, s, want_s, want_pre', _P1)}")
def p1(spark, sf_dir):
    return values(spark, "id int, t string, s int, ws int, wp string", _P1).select("id", detect.absorb_prefix(F.col("t"), F.col("s")).alias("x")).select("id", "x.s", "x.pre")


_P2 = [(1, "Oak St 5, Haifa 1234567 end", 8, 16, 23, "1234567"), (2, "Oak St 5 one two three four 12345", 8, None, None, None), (3, "Oak St 5, 12345", 8, 10, 15, "12345"), (4, "Oak St 5", 8, None, None, None)]


@query("P2_zip_after_address", f"SELECT id, CAST(ws AS INTEGER) AS s, CAST(we AS INTEGER) AS e, z FROM {sql_values('id, t, e0, ws, we, z', _P2)}")
def p2(spark, sf_dir):
    df = values(spark, "id int, t string, e int, ws int, we int, z string", _P2).select("id", detect.zip_after(F.col("t"), F.col("e")).alias("x"))
    return df.select("id", "x.s", "x.e", F.col("x.t").alias("z"))


_P3 = [(1, "בת 9 ובן 12", "9", True), (2, "עלה 9 שקלים", "9", False), (3, "3 שנים", "3", True), (4, "גיל 70", "70", True)]


@query("P3_age_zones", f"SELECT id, want AS inside FROM {sql_values('id, t, n, want', _P3)}")
def p3(spark, sf_dir):
    df = values(spark, "id int, t string, n string, want boolean", _P3)
    s = F.instr("t", F.col("n")) - 1
    return df.select("id", detect.in_zone(s, s + F.length("n"), detect.age_zones(F.col("t"))).alias("inside"))


_P4 = [(1, "דנה לוי ולכרמל", 2), (2, "הכרמל", 1), (3, "כרמלית", 0), (4, "כרמל", 1)]


@query("P4_allow_zones", "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 0), (4, 1)) AS v(id, n)")
def p4(spark, sf_dir):
    df = values(spark, "id int, t string, x int", [(1, "דנה לוי ולכרמל לכרמל", 0), *_P4[1:]])
    return df.select("id", F.size(detect.literal_zones(F.col("t"), ["כרמל"])).alias("n"))


@query("P4_zone_antijoin", f"WITH h AS ({hit_sql(N['EMAIL'])}), z AS (SELECT doc_id, instr(text, 'example') - 1 AS zs, instr(text, 'example') + 6 AS ze FROM documents WHERE instr(text, 'example') > 0) SELECT doc_id, s, e FROM h WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = h.doc_id AND h.s < z.ze AND z.zs < h.e)")
def p4_anti(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.inline(detect.hits(F.col("text"), [N["EMAIL"]]))).select("doc_id", "s", "e")
    at = F.instr("text", "example") - 1
    return spans.outside(found, docs.where(at >= 0).select("doc_id", at.alias("s"), (at + 7).alias("e")), ["doc_id"])


_P5 = [(1, "Dana: 050", 4, True, False), (2, "Dana said", 4, False, False), (3, "Haifa Court ruled", 5, False, True)]


@query("P5_guards", f"SELECT id, wl AS label, wt AS public FROM {sql_values('id, t, e, wl, wt', _P5)}")
def p5(spark, sf_dir):
    df = values(spark, "id int, t string, e int, wl boolean, wt boolean", _P5)
    return df.select("id", detect.contact_label(F.col("t"), F.col("e")).alias("label"), detect.public_title(F.col("t"), F.col("e")).alias("public"))
