"""Queries of the text functions, validators and date functions (F, V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans, text as tx, validators as va
from .registry import literal, query, read, sql_values, values

_FROM, _TO = tx.MARKS + "".join(tx.SIGNS), tx.SENTINEL * len(tx.MARKS) + "".join(tx.SIGNS.values())
HEBREW = [(1, "לוי־אבקסיס"), (2, "עו״ד ד׳ כהן"), (3, "רוֹנִית בַּר"), (4, "שרה–לאה"), (5, ""), (6, "ל‏וי"), (7, "בהרצליה"), (8, None)]


@query("F1_norm", f"SELECT doc_id, length(n) AS n_chars, md5(n) AS norm_md5 FROM (SELECT doc_id, translate(text, {literal(_FROM)}, {literal(_TO)}) AS n FROM documents UNION ALL SELECT -id, translate(t, {literal(_FROM)}, {literal(_TO)}) FROM {sql_values('id, t', HEBREW)})")
def norm(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionAll(values(spark, "doc_id long, text string", [(-i, t) for i, t in HEBREW]))
    return docs.select("doc_id", tx.norm(F.col("text")).alias("n")).select("doc_id", F.length("n").cast("long").alias("n_chars"), F.md5(F.col("n").cast("binary")).alias("norm_md5"))


@query("F2_flex", rf"SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), '[\s-]+', '[\\s-]+', 'g') AS pattern FROM supplier")
def flex(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", tx.flex(F.col("s_name")).alias("pattern"))


BOUNDS = [(1, "דנה לוי באה", "לוי"), (2, "דנה לויה", "לוי"), (3, "לוי2", "לוי"), (4, "xלוי", "לוי"), (5, 'אמר ש"לוי" בא', "לוי"), (6, "ת1234", "1234"), (7, "01234", "1234"), (8, "לוי", "לוי")]
_BOUND_TRUE = [1, 3, 5, 6, 8]


@query("F3_word_boundary", f"SELECT id, (id IN ({', '.join(map(str, _BOUND_TRUE))})) AS found FROM {sql_values('id, t, v', BOUNDS)}")
def boundary(spark, sf_dir):
    df = values(spark, "id int, t string, v string", BOUNDS)
    return df.select("id", F.call_function("rlike", F.col("t"), F.concat(F.lit(tx.LEFT), F.col("v"), F.lit(tx.RIGHT))).alias("found"))


@query(
    "F5_tokens",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+(?:[''-][\p{L}\p{M}]+)*') AS m, string_split_regex(text, '[\p{L}\p{M}]+(?:[''-][\p{L}\p{M}]+)*') AS g FROM documents),
r AS (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM w),
o AS (SELECT doc_id, i, w, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r)
SELECT doc_id, count(*) AS n_tokens, CAST(sum(e - length(w)) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end, count(DISTINCT lower(w)) AS n_distinct FROM o GROUP BY doc_id""",
)
def tokens(spark, sf_dir):
    rows = spans.token_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", tx.WORDS["any"], ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("s").alias("sum_start"), F.sum("e").alias("sum_end"), F.countDistinct(F.lower("w")).alias("n_distinct"))


EDGES = [(1, '"דנה",', "דנה"), (2, "ברקוביץ'", "ברקוביץ'"), (3, "(Levi).", "Levi"), (4, " - ", ""), (5, "'x'", "x"), (6, "a-b", "a-b")]


@query("F6_trim_edges", f"SELECT id, want AS trimmed FROM {sql_values('id, t, want', EDGES)}")
def edges(spark, sf_dir):
    return values(spark, "id int, t string, want string", EDGES).select("id", tx.trim_edges(F.col("t")).alias("trimmed"))


WORDS = [(1, "ולבית"), (2, "שרה"), (3, "דנה"), (4, "וה"), (5, "כשהלך"), (6, "בת")]


@query(
    "F7_stems",
    f"""
WITH w AS (SELECT * FROM {sql_values('id, w', WORDS)}),
s AS (SELECT id, w AS stem FROM w UNION SELECT id, w[2:] FROM w WHERE regexp_matches(w, '^[הובלמכש]') AND length(w) >= 3 UNION SELECT id, w[3:] FROM w WHERE regexp_matches(w, '^[הובלמכש][הובלמכש]') AND length(w) >= 4)
SELECT id, stem FROM s""",
)
def stem_rows(spark, sf_dir):
    return values(spark, "id int, w string", WORDS).select("id", F.explode(tx.stems(F.col("w"))).alias("stem"))


NAMES = [(1, "רון לוי"), (2, "דנה"), (3, "Ron"), (4, "הדס כהן")]


@query(
    "F8_variants",
    f"""
WITH n AS (SELECT * FROM {sql_values('id, name', NAMES)}), p AS (SELECT unnest({literal(tx.SINGLE_PREFIXES + tx.DOUBLE_PREFIXES)}) AS pre)
SELECT id, name AS form, '' AS pre FROM n UNION ALL
SELECT id, pre || name, pre FROM n, p WHERE regexp_matches(name, '^[א-ת]') AND pre || name <> 'שרון לוי'""",
)
def variant_rows(spark, sf_dir):
    protect = F.array(F.lit("שרון לוי"))
    return values(spark, "id int, name string", NAMES).select("id", F.explode(tx.variants(F.col("name"), "normal", protect)).alias("v")).select("id", "v.form", "v.pre")


PRE = [(1, "ל", "הבית", False), (2, "ב", "הרצליה", True), (3, "ש", "הבית", False), (4, "", "דנה", False), (5, "ול", "הבית", False), (6, "ו", "", False)]


@query("F9_add_prefix", f"SELECT id, CASE WHEN pre = '' THEN v WHEN v = '' THEN pre WHEN v[1:1] = 'ה' AND pre[-1:] IN ('ב', 'ל', 'כ', 'ה') AND NOT own THEN pre || v[2:] ELSE pre || v END AS made FROM {sql_values('id, pre, v, own', PRE)}")
def prefixed(spark, sf_dir):
    return values(spark, "id int, pre string, v string, own boolean", PRE).select("id", tx.add_prefix(F.col("pre"), F.col("v"), F.col("own")).alias("made"))


@query(
    "F10_numeral",
    f"""
WITH n AS (SELECT range AS n FROM range(0, 502)),
l AS (SELECT n, {literal(tx.HUNDREDS)}[least(n // 100, 4) + 1] || CASE n % 100 WHEN 15 THEN 'טו' WHEN 16 THEN 'טז' ELSE {literal(tx.TENS)}[n % 100 // 10 + 1] || {literal(tx.ONES)}[n % 10 + 1] END AS t FROM n)
SELECT n, CASE WHEN n < 1 OR n >= 500 THEN chr(8207) || n || chr(8207) WHEN length(t) > 1 THEN t[:-2] || '"' || t[-1:] ELSE t || '׳' END AS numeral FROM l""",
)
def numerals(spark, sf_dir):
    return spark.range(0, 502).select(F.col("id").alias("n"), tx.numeral(F.col("id")).alias("numeral"))


@query("F11_trim_lexicon", f"SELECT id, want AS trimmed FROM {sql_values('id, t, x, want', [(1, 'נטע הזה לשם', 'x', 'נטע'), (2, 'נטע', 'x', 'נטע'), (3, 'הזה', 'x', '')])}")
def trim_lexicon(spark, sf_dir):
    df = values(spark, "id int, t string", [(1, "נטע הזה לשם"), (2, "נטע"), (3, "הזה")])
    return df.select("id", tx.trim_tail_words(F.col("t"), ["הזה", "לשם"]).alias("trimmed"))


CLEAN = [(1, "Mr Dana Levi said", "Dana Levi"), (2, "Dr. Omer", "Dr. Omer"), (3, "Mr Mr Noa Bar Gal Tal then", "Noa Bar Gal"), (4, "(Ron)", "Ron")]


@query("F11_clean_name", f"SELECT id, want AS name FROM {sql_values('id, t, want', CLEAN)}")
def clean(spark, sf_dir):
    return values(spark, "id int, t string, want string", CLEAN).select("id", tx.clean_name(F.col("t"), ["Mr", "Ms"], ["said", "then"]).alias("name"))


@query(
    "F12_context",
    r"""
WITH h AS (SELECT doc_id, text, instr(text, '@') - 1 AS s FROM documents WHERE instr(text, '@') > 0)
SELECT doc_id, CAST(s AS INTEGER) AS s, CASE WHEN s > 55 THEN '…' ELSE '' END || substr(text, greatest(s - 55, 0) + 1, s - greatest(s - 55, 0)) AS before,
  substr(text, s + 2, 55) || CASE WHEN length(text) > s + 56 THEN '…' ELSE '' END AS after FROM h""",
)
def contexts(spark, sf_dir):
    s = F.instr("text", "@") - 1
    before, _, after = tx.context(F.col("text"), s, s + 1)
    return read(spark, sf_dir, "documents").where(s >= 0).select("doc_id", s.cast("int").alias("s"), before.alias("before"), after.alias("after"))


@query(
    "F13_examples",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[Tt]hing') AS m, string_split_regex(text, '[Tt]hing') AS g FROM documents WHERE regexp_matches(text, '[Tt]hing')),
r AS (SELECT doc_id, unnest(m) AS t, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM w),
o AS (SELECT doc_id, i, t, sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS s FROM r)
SELECT doc_id, CAST(i AS INTEGER) AS ix, CAST(s AS INTEGER) AS s, t FROM o WHERE i <= 3""",
)
def examples(spark, sf_dir):
    df = read(spark, sf_dir, "documents").where(F.col("text").rlike("[Tt]hing"))
    rows = spans.token_rows(df, "text", "[Tt]hing", ["doc_id"]).where("tok_ix < 3")
    return rows.select("doc_id", (F.col("tok_ix") + 1).alias("ix"), "s", F.col("w").alias("t"))


@query(
    "F14_hash32",
    """
WITH v AS (SELECT doc_id, text AS v FROM documents UNION ALL SELECT -1, 'alpha' UNION ALL SELECT -2, 'Dana Levi' UNION ALL SELECT -3, '')
SELECT doc_id, CAST(list_reduce([ord(c) for c in string_split(v, '') if c <> ''], lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS BIGINT) AS hash FROM v""",
)
def hashes(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("v")).unionAll(values(spark, "doc_id long, v string", [(-1, "alpha"), (-2, "Dana Levi"), (-3, "")]))
    return df.select("doc_id", tx.hash32(F.col("v")).alias("hash"))


@query("F15_wordish", "SELECT DISTINCT w, w IN ('the', 'and', 'of', 'la', 'de') OR w IN (SELECT n_name FROM nation) AS wordish FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def wordish(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    lexicon = values(spark, "w string", [(w,) for w in ("the", "and", "of", "la", "de")]).unionAll(read(spark, sf_dir, "nation").select("n_name")).distinct()
    known = F.broadcast(lexicon.withColumn("known", F.lit(True)))  # a lexicon of fixed size
    return words.join(known, "w", "left").select("w", F.coalesce("known", F.lit(False)).alias("wordish"))


@query("F16_ner_norm", "SELECT doc_id, md5(strip_accents(lower(translate(text, 'ßœæ', 'sss')))) AS m FROM documents")
def ner_norm(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.ner_norm(F.translate("text", "ßœæ", "sss")).cast("binary")).alias("m"))


@query("F17_norm_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key FROM documents")
def norm_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(tx.norm_text(F.col("text")).cast("binary")).alias("key"))


KINDS = {"village": "rural", "city": "urban", "street": "street"}
KIND_ROWS = [(1, "in the village Neta", 15, "rural"), (2, "street of the city Neta", 19, "urban"), (3, "Neta", 0, None), (4, "village and far far far away then Neta", 34, None)]


@query("F19_place_kind", f"SELECT id, want AS kind FROM {sql_values('id, t, s, want', KIND_ROWS)}")
def place_kinds(spark, sf_dir):
    return values(spark, "id int, t string, s int, want string", KIND_ROWS).select("id", tx.place_kind(F.col("t"), F.col("s"), KINDS).alias("kind"))


@query(
    "F20_gap_class",
    r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN coalesce(w, '') = '' THEN 'none' WHEN regexp_matches(w, '^[ \t\n\x0b\f\r]+$') THEN 'space' WHEN contains(w, '@') THEN 'email' WHEN regexp_matches(w, '^[0-9]+$') THEN 'digits(' || length(w) || ')'
  WHEN regexp_matches(w, '^[A-Za-z]+$') THEN 'latin(' || length(w) || ')' WHEN regexp_matches(w, '^[֐-׿]+$') THEN 'word' WHEN regexp_matches(w, '^[A-Za-z0-9]+$') THEN 'mixed(' || length(w) || ')'
  WHEN regexp_matches(w, '^[^\p{L}\p{N}]+$') THEN 'punct' ELSE 'other' END AS class FROM w)
SELECT class, count(*) AS n FROM c GROUP BY class""",
)
def gap_classes(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("w"))
    return words.groupBy(tx.gap_class(F.col("w")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "F21_doc_shape",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
c AS (SELECT doc_id, count(*) AS p, count(*) FILTER (regexp_matches(l, '^\S+ \| ')) AS t, count(*) FILTER (regexp_matches(l, '^[0-9]+[.)]')) AS n, count(*) FILTER (regexp_matches(l, '^\[[0-9]+:')) AS s FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN t >= greatest(3, ceil(p * 3 / 10)) THEN 'transcript' WHEN n >= 3 THEN 'filing' WHEN s >= 1 THEN 'chat' ELSE 'prose' END AS shape FROM c""",
)
def shapes(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    n = lambda rx: F.size(F.filter(lines, lambda x: x.rlike(rx)))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", tx.doc_shape(F.size(lines), n(r"^\S+ \| "), n(r"^[0-9]+[.)]"), n(r"^\[[0-9]+:")).alias("shape"))


@query("T12_escape", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS m3, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS m5 FROM pages")
def escapes(spark, sf_dir):
    md5 = lambda c: F.md5(c.cast("binary"))
    return read(spark, sf_dir, "pages").select("page_id", md5(tx.escape_xml(F.col("html"))).alias("m3"), md5(tx.escape_attribute(F.col("html"))).alias("m5"))


IDS = [(1, "123456782"), (2, "123456789"), (3, "000000018"), (4, "37"), (5, "111111111"), (6, "12-345678-2"), (7, ""), (8, "1234567890"), (9, "000000000")]


@query(
    "V1_valid_id",
    f"""
WITH d AS (SELECT id, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM {sql_values('id, t', IDS)} UNION ALL SELECT 1000 + o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders),
p AS (SELECT *, lpad(d, 9, '0') AS p FROM d)
SELECT CAST(id AS BIGINT) AS id, length(d) BETWEEN 1 AND 9 AND length(replace(d, d[1:1], '')) > 0
  AND list_sum([CASE WHEN CAST(p[i:i] AS INTEGER) * (2 - i % 2) > 9 THEN CAST(p[i:i] AS INTEGER) * 2 - 9 ELSE CAST(p[i:i] AS INTEGER) * (2 - i % 2) END for i in range(1, 10)]) % 10 = 0 AS ok FROM p""",
)
def ids(spark, sf_dir):
    df = values(spark, "id long, t string", IDS).unionAll(read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000).cast("long"), F.col("o_orderkey").cast("string")))
    return df.select("id", va.valid_id(F.col("t")).alias("ok"))


CARD_RX = r"\b\d(?:[ -]?\d){11,18}\b"
_LUHN_SQL = "length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i:i] AS INTEGER) > 4 THEN CAST(d[i:i] AS INTEGER) * 2 - 9 ELSE CAST(d[i:i] AS INTEGER) * 2 END ELSE CAST(d[i:i] AS INTEGER) END for i in range(1, length(d) + 1)]) % 10 = 0"


@query("V2_luhn", rf"SELECT doc_id, d, {_LUHN_SQL} AS ok FROM (SELECT doc_id, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD_RX}')) AS m FROM documents UNION ALL SELECT -1, '4111 1111 1111 1111' UNION ALL SELECT -2, '4111111111111112' UNION ALL SELECT -3, '79927398713'))")
def cards(spark, sf_dir):
    m = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(CARD_RX), F.lit(0))).alias("m"))
    m = m.unionAll(values(spark, "doc_id long, m string", [(-1, "4111 1111 1111 1111"), (-2, "4111111111111112"), (-3, "79927398713")]))
    return m.select("doc_id", va.digits(F.col("m")).alias("d"), va.luhn(F.col("m")).alias("ok"))


IBANS = [(1, "IL620108000000099999999"), (2, "IL620108000000099999998"), (3, "il62 0108 0000 0009 9999 999"), (4, "GB620108000000099999999"), (5, "IL62"), (6, "")]


@query(
    "V3_iban",
    rf"""
WITH t AS (SELECT id, upper(regexp_replace(t, '\s', '', 'g')) AS t FROM {sql_values('id, t', IBANS)})
SELECT id, regexp_matches(t, '^IL[0-9]{{21}}$') AND (CASE WHEN regexp_matches(t, '^IL[0-9]{{21}}$') THEN CAST(t[5:] || '1821' || t[3:4] AS HUGEINT) % 97 ELSE 0 END) = 1 AS ok FROM t""",
)
def ibans(spark, sf_dir):
    return values(spark, "id int, t string", IBANS).select("id", va.iban_ok(F.col("t")).alias("ok"))


DATES = [(1, "12.3.2026", 12, 3, 2026), (2, "31/12/26", 31, 12, 2026), (3, "01/12/2026", 1, 12, 2026), (4, "2026-03-12", 12, 3, 2026), (5, "30.2.2026", None, None, None), (6, "12.3", 12, 3, None), (7, "29.2", 29, 2, None), (8, "12-3", None, None, None), (9, "12 במרץ 2026", 12, 3, 2026), (10, "8.10.95", 8, 10, 1995), (11, "1.2/2026", None, None, None), (12, "5 מאי", 5, 5, None), (13, "", None, None, None), (14, "12-03-26", 12, 3, 2026)]


@query("V4_parse_date", f"SELECT id, CAST(d AS INTEGER) AS d, CAST(m AS INTEGER) AS m, CAST(y AS INTEGER) AS y FROM {sql_values('id, t, d, m, y', DATES)}")
def dates(spark, sf_dir):
    df = values(spark, "id int, t string, d int, m int, y int", DATES)
    return df.select("id", va.parse_date(F.col("t"), 2026).alias("p")).select("id", "p.d", "p.m", "p.y")


@query("V5_full_year", "SELECT range AS n, CAST(CASE WHEN range >= 100 THEN range WHEN 2000 + range <= 2036 THEN 2000 + range ELSE 1900 + range END AS INTEGER) AS y FROM range(10, 130)")
def years(spark, sf_dir):
    return spark.range(10, 130).select(F.col("id").alias("n"), va.full_year(F.col("id").cast("string"), 2026).alias("y"))


PAIRS = [(1, "dana", "dane", "sub", "ae"), (2, "carmel", "carmeel", "len", "e"), (3, "carmel", "carmel", None, None), (4, "carmel", "carm", None, None), (5, "", "a", "len", "a"), (6, "ab", "ba", None, None), (7, "שלוה", "שלווה", "len", "ו"), (8, "abc", "bc", "len", "a")]


@query("V6_near1", f"SELECT id, CAST(k AS VARCHAR) AS k, CAST(p AS VARCHAR) AS p FROM {sql_values('id, a, b, k, p', PAIRS)}")
def near(spark, sf_dir):
    df = values(spark, "id int, a string, b string, k string, p string", PAIRS)
    return df.select("id", va.near1(F.col("a"), F.col("b")).alias("r")).select("id", "r.k", "r.p")


SHIFTS = [(1, "12.3.2026", 45, "26.4.2026"), (2, "31/12/26", 45, "14/2/27"), (3, "01/12/2026", 45, "15/1/2027"), (4, "2026-03-12", 45, "2026-04-26"), (5, "30.2.2026", 45, None), (6, "12 במרץ 2026", 45, "26 באפריל 2026"), (7, "12.3", 45, "26.4"), (8, "05.06.2026", 1, "06.06.2026")]


@query("R11_date_shift", f"SELECT id, want AS shifted FROM {sql_values('id, t, n, want', SHIFTS)}")
def shifts(spark, sf_dir):
    return values(spark, "id int, t string, n int, want string", SHIFTS).select("id", va.shift_date(F.col("t"), F.col("n"), 2026).alias("shifted"))


@query("R11_doc_offset", "SELECT doc_id, CAST(30 + list_reduce([ord(c) for c in string_split(v, '') if c <> ''], lambda h, c: (xor(h, CAST(c AS BIGINT)) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) % 371 AS BIGINT) AS days FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || coalesce(source, '') AS v FROM documents)")
def offsets(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("source", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", (tx.hash32(name) % 371 + 30).alias("days"))
