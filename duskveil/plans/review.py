"""Queries of the second pass, near misses, restoration and the map (W, R3, R4, RS, GEO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans, text as tx
from ..operators import nearmiss, review as rv
from .detection import _GAPS, _WALK, hit_sql, N, redacted
from .registry import query, read, sql_values, values

_RULES = [("Dana Levi", "NAME"), ("Institute of Trees", "ORG"), ("Tavor Bank House", "ORG"), ("Ron", "NAME"), ("Dana", "NAME")]


@query(
    "R3_rule_forms",
    f"""
WITH r AS (SELECT * FROM {sql_values('value, kind', _RULES)}),
f AS (SELECT value AS base, value AS form, 0 AS alias FROM r UNION ALL
  SELECT value, value[length(split_part(value, ' ', 1)) + 2 :], 1 FROM r WHERE kind = 'ORG' AND (length(value) - length(replace(value, ' ', '')) >= 2 OR length(value[length(split_part(value, ' ', 1)) + 2 :]) >= 5) AND contains(value, ' ')),
d AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY alias, base) AS rn FROM f)
SELECT base, form, length(form) <= 3 AS soft, CAST(row_number() OVER (ORDER BY length(form) DESC, form) AS INTEGER) AS place FROM d WHERE rn = 1""",
)
def r3(spark, sf_dir):
    from pyspark.sql import Window

    rules = values(spark, "value string, kind string", _RULES)
    rest = F.array_join(F.slice(F.split("value", " "), 2, 99), " ")
    drops = (F.col("kind") == "ORG") & ((F.size(F.split("value", " ")) >= 3) | (F.length(rest) >= 5)) & (rest != "")
    forms = rules.select(F.col("value").alias("base"), F.explode(F.filter(F.array(F.struct(F.col("value").alias("form"), F.lit(0).alias("alias")), F.when(drops, F.struct(rest.alias("form"), F.lit(1).alias("alias")))), lambda x: x.isNotNull())).alias("x")).select("base", "x.form", "x.alias")
    forms = forms.withColumn("rn", F.row_number().over(Window.partitionBy("form").orderBy("alias", "base"))).where("rn = 1")
    return forms.select("base", "form", (F.length("form") <= 3).alias("soft"), F.row_number().over(Window.orderBy(F.desc(F.length("form")), "form")).alias("place"))  # the list of rules of one case


_ALIAS = [("a", "b"), ("b", "c"), ("c", "a"), ("p", "q"), ("q", "r"), ("x", "y")]


@query("R4_alias_closure", "SELECT * FROM (VALUES ('a', 'a'), ('b', 'a'), ('c', 'a'), ('p', 'r'), ('q', 'r'), ('x', 'y')) AS v(name, root)")
def r4(spark, sf_dir):
    return rv.closure(values(spark, "name string, same_as string", _ALIAS))


@query("R4_surnames", "WITH f AS (SELECT c_name AS full_name, split_part(c_name, '#', 2) AS last FROM customer), s AS (SELECT DISTINCT split_part(s_name, '#', 2) AS last FROM supplier) SELECT s.last, min(full_name) AS full_name FROM s JOIN f ON s.last = f.last GROUP BY s.last")
def r4_surnames(spark, sf_dir):
    full = read(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"), F.element_at(F.split("c_name", "#"), -1).alias("last"))
    single = read(spark, sf_dir, "supplier").select(F.element_at(F.split("s_name", "#"), -1).alias("last")).distinct()
    return single.join(full, "last").groupBy("last").agg(F.min("full_name").alias("full_name"))


_CUES = [("by", "m"), ("from", "f"), ("with", "f")]
_STOPS = ["the", "and", "of", "in"]


@query(
    "R18_first_names",
    """
WITH w AS (SELECT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])(?:by|from|with) [A-Za-z]+')) AS m FROM documents),
c AS (SELECT regexp_extract(m, '(by|from|with) ', 1) AS cue, regexp_extract(m, '([A-Za-z]+)$', 1) AS first FROM w),
g AS (SELECT first, sum(CASE cue WHEN 'by' THEN 1 ELSE 0 END) AS m, sum(CASE cue WHEN 'by' THEN 0 ELSE 1 END) AS f FROM c WHERE first NOT IN ('the', 'and', 'of', 'in') GROUP BY first)
SELECT first, CAST(m + f AS BIGINT) AS n, CASE WHEN m > f THEN 'm' WHEN f > m THEN 'f' END AS gender FROM g""",
)
def r18(spark, sf_dir):
    """The word after a cue is a first name of the cue's gender, unless it is an ordinary word."""
    return rv.first_names(read(spark, sf_dir, "documents").select("text"), dict(_CUES), _STOPS)


@query("W1_value_sweep", f"WITH h AS ({hit_sql(N['EMAIL'])}), v AS (SELECT DISTINCT lower(t) AS value FROM h), w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z]'))) AS w FROM documents) SELECT doc_id, value FROM w JOIN v ON w.w = v.value")
def w1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    applied = docs.select(F.explode(F.regexp_extract_all("text", F.lit(N["EMAIL"].rx), F.lit(0))).alias("value")).select(F.lower("value").alias("value"), F.lit("[EMAIL]").alias("rep"))
    listed = rv.swept_values(applied, [])
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z]"), F.lit(0))).alias("w")).select("doc_id", F.lower("w").alias("value")).distinct()
    return words.join(listed, "value").select("doc_id", "value")


_PARTS = [("Noa Bar", "Dana Levi"), ("Ron Gal", "Omer Sela"), ("Ron Tal", "Avi Shir"), ("Mia", "Zoe")]


@query("W2_name_parts", "SELECT * FROM (VALUES ('Noa', 'Dana', false), ('Bar', 'Levi', false), ('Ron', 'Avi', true), ('Gal', 'Sela', false), ('Tal', 'Shir', false)) AS v(part, \"to\", shared)")
def w2(spark, sf_dir):
    return rv.name_parts(values(spark, "real string, fake string", _PARTS))


_STREETS = [(1, "רחוב הזית 12", "הזית"), (2, "בשדרות רוטשילד", "רוטשילד"), (3, "אין כאן", None), (4, "רחוב הגפן 3 דירה 4", "הגפן"), (5, "דרך אב", None), (6, "רחוב", None)]


@query("W3_street_names", f"SELECT id, CAST(want AS VARCHAR) AS street FROM {sql_values('id, t, want', _STREETS)} UNION ALL SELECT 1000 + c_custkey, CASE WHEN length(trim(split_part(c_name, '#', 2))) >= 3 THEN trim(split_part(c_name, '#', 2)) END FROM customer")
def w3(spark, sf_dir):
    """Given addresses, and the customers' names as streets of their own with a house number."""
    own = values(spark, "id int, t string, want string", _STREETS).select(F.col("id").cast("long").alias("id"), "t")
    made = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("long"), F.concat(F.lit("ברחוב "), F.trim(F.get(F.split("c_name", "#"), 1)), F.lit(" 7")))
    return own.unionAll(made).select("id", rv.street_names(F.col("t"), rv.STREET_HEADS).alias("street"))


_LABEL = r"\[[A-Z_]+ [0-9]+\]"


@query("W4_protected_zones", rf"WITH RECURSIVE {_WALK}{_GAPS} SELECT doc_id, len(regexp_extract_all(redacted, '{_LABEL}')) AS zones, len(regexp_extract_all(regexp_replace(redacted, '{_LABEL}', ' ', 'g'), '[A-Z]+')) AS free FROM red WHERE regexp_matches(redacted, '{_LABEL}')")
def w4(spark, sf_dir):
    """Runs of capitals that a second pass may touch: those inside labels that are written already are protected."""
    zones = spans.matches(F.col("redacted"), _LABEL)
    free = spans.let(zones, lambda z: F.size(rv.protected(spans.matches(F.col("redacted"), "[A-Z]+"), z)))
    return redacted(spark, sf_dir).where(F.col("redacted").rlike(_LABEL)).select("doc_id", F.size(zones).cast("long").alias("zones"), free.cast("long").alias("free"))


@query(
    "W5_near_miss",
    """
WITH f AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS form FROM documents),
t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS target FROM benchmark)
SELECT form, target, CASE WHEN length(form) = length(target) THEN 'sub' ELSE 'len' END AS k FROM f JOIN t ON length(target) >= 4 AND abs(length(form) - length(target)) <= 1 AND form <> target AND levenshtein(form, target) = 1""",
)
def w5(spark, sf_dir):
    words = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    forms = words(read(spark, sf_dir, "documents")).withColumnRenamed("w", "form")
    targets = words(read(spark, sf_dir, "benchmark")).withColumnRenamed("w", "target")
    return nearmiss.near_pairs(forms, targets).select("form", "target", "k")


_NEAR = [("שלווה", "שלוה"), ("שלזה", "שלוה"), ("בחיים", "שחיים"), ("סלומון", "שלומון"), ("לכרמל", "כרמל"), ("כרמול", "כרמל"), ("ברק", "ברקת")]


@query("W5_near_hebrew", "SELECT * FROM (VALUES ('שלווה', 'שלוה', 'len', 'ו', 'medium'), ('סלומון', 'שלומון', 'sub', 'סש', 'high'), ('כרמול', 'כרמל', 'len', 'ו', 'medium')) AS v(form, target, k, p, conf)")
def w5_hebrew(spark, sf_dir):
    forms = values(spark, "form string", [(f,) for f, _ in _NEAR])
    targets = values(spark, "target string", [(t,) for t in sorted({t for _, t in _NEAR})])
    return nearmiss.near_pairs(forms, targets, "בהולמכש")


_MERGE = [(1, "לוי-אבקסיס", "לוי אבקסיס", "hyphen"), (2, "שלוה כהן", "שלווה כהן", "spelling"), (3, "דנה לוי", "לוי דנה", "order"), (4, "ארסן", "שארסן", "prefix"), (5, "דנה", "דנה לוי", "first"), (6, "לוי", "דנה לוי", "last"), (7, "דנה לוי", "דנה שרה לוי", "part"), (8, "דנה", "דנה", ""), (9, "רון", "יעל", "")]


@query("W6_merge_signals", f"SELECT id, want AS signals FROM {sql_values('id, a, b, want', _MERGE)}")
def w6(spark, sf_dir):
    return values(spark, "id int, a string, b string, want string", _MERGE).select("id", F.array_join(nearmiss.merge_signals(F.col("a"), F.col("b")), ",").alias("signals"))


@query("W8_not_found", "SELECT n_name AS value FROM nation WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(regexp_extract_all(upper(text), '[A-Z]+')) AS w FROM documents) d WHERE d.w = n_name)")
def w8(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]+"), F.lit(0))).alias("w")).distinct()
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    return names.join(words, F.col("value") == F.col("w"), "left_anti")


_LABELS = [(1, "Dana", True), (2, "Dana Levi", True), (3, "total 12", False), (4, "a long label of many words here", False), (5, "", False)]


@query("W9_label_suggestions", f"SELECT id, want AS suggest FROM {sql_values('id, t, want', _LABELS)}")
def w9(spark, sf_dir):
    return values(spark, "id int, t string, want boolean", _LABELS).select("id", rv.label_suggestions(F.col("t")).alias("suggest"))


@query("W10_completeness", f"WITH RECURSIVE {_WALK}{_GAPS}, l AS (SELECT DISTINCT r.doc_id FROM r JOIN red USING (doc_id) WHERE contains(redacted, t)) SELECT (doc_id NOT IN (SELECT doc_id FROM l)) AS passed, doc_id NOT IN (SELECT doc_id FROM l) AND NOT contains(text, '###') AS complete, count(*) AS n FROM documents GROUP BY ALL")
def w10(spark, sf_dir):
    passed = ~F.exists("hits", lambda h: F.contains(F.col("redacted"), h["t"]))
    return redacted(spark, sf_dir).groupBy(passed.alias("passed"), (passed & ~F.contains("text", F.lit("###"))).alias("complete")).agg(F.count("*").alias("n"))


_ANS = [(1, "Dana Levi met Sela", "Noa Bar met Gal", 2, ""), (2, "nobody here", "nobody here", 0, "Dana Levi,Omer Sela"), (3, "Dr. Levi and Dana Levine", "Dr. Bar and Noa Levine", 2, "Omer Sela,Dana Levi"), (4, "X Twin said", "X Twin said", 0, "Dana Levi,Omer Sela")]
_PAIRS = [("Noa Bar", "Dana Levi"), ("Ron Gal", "Omer Sela"), ("One", "X Twin"), ("Two", "X Twin")]


@query("RS5_restore", "SELECT * FROM (VALUES (1, 'Noa Bar met Gal', 2, 'Omer Sela', 'X Twin'), (2, 'nobody here', 0, 'Dana Levi,Omer Sela', 'X Twin'), (3, 'Dr. Bar and Noa Levine', 2, 'Omer Sela', 'X Twin'), (4, 'X Twin said', 0, 'Dana Levi,Omer Sela', 'X Twin')) AS v(id, text, n, missing, conflict)")
def rs5(spark, sf_dir):
    made = values(spark, "id int, t string", [r[:2] for r in _ANS]).select("id", rv.restore(F.col("t"), _PAIRS).alias("r"))
    return made.select("id", "r.text", F.col("r.count").alias("n"), F.array_join("r.missing", ",").alias("missing"), F.array_join("r.conflict", ",").alias("conflict"))


@query("RS5_round_trip", "SELECT count(*) AS n, count(*) AS same FROM documents WHERE contains(text, 'the')")
def round_trip(spark, sf_dir):
    pairs = [("the", "Zeta Omega"), ("thing", "Kappa Tau")]
    docs = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("the")))
    out = F.col("text")
    for real, fake in pairs:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}]){real}(?![\p{{L}}\p{{N}}])", fake)
    back = rv.restore(F.col("out"), pairs)["text"]
    return docs.select("text", out.alias("out")).select((back == F.col("text")).cast("long").alias("same")).agg(F.count("*").alias("n"), F.sum("same").alias("same"))


@query("RS4_name_parts", "SELECT DISTINCT c_nationkey AS g, split_part(c_name, '#', 1) AS first, split_part(c_name, '#', 2) AS last FROM customer WHERE length(split_part(c_name, '#', 2)) >= 3")
def rs4(spark, sf_dir):
    w = F.split("c_name", "#")
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.get(w, 0).alias("first"), F.get(w, 1).alias("last")).where(F.length("last") >= 3).distinct()


@query(
    "RS3_same_day",
    """
WITH p AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderdate AS DATE) AS real, CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 5 AS INTEGER) AS fake FROM orders),
one AS (SELECT k, fake, min(real) AS real FROM p GROUP BY k, fake HAVING count(DISTINCT real) = 1)
SELECT o_orderkey AS id, CAST(length('See ') AS INTEGER) AS s, day(p.fake) || '.' || month(p.fake) || '.' || year(p.fake) AS t, CAST(one.real AS VARCHAR) AS real FROM p JOIN one ON p.k = one.k AND p.fake = one.fake""",
)
def rs3(spark, sf_dir):
    """Answers name a case's shifted days in another spelling; each comes back, but days that stand for two real ones."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("real"))
    o = o.withColumn("fake", F.date_add("real", (30 + F.col("id") % 5).cast("int")))
    answers = o.select("k", "id", F.concat(F.lit("See "), F.concat_ws(".", F.dayofmonth("fake"), F.month("fake"), F.year("fake")), F.lit(" again")).alias("text"))
    pairs = o.select("k", F.col("real").cast("string").alias("real"), F.col("fake").cast("string").alias("fake"))
    return rv.restore_dates(answers, pairs, ["k"], ["id"]).select("id", "s", "t", F.col("real").cast("string").alias("real"))


@query("RS1_prefix_grammar", "SELECT a || b || c || d AS prefix FROM (VALUES (''), ('ו')) AS a(a), (VALUES (''), ('כ'), ('ש')) AS b(b), (VALUES (''), ('ב'), ('ל'), ('מ')) AS c(c), (VALUES (''), ('ה')) AS d(d) WHERE a || b || c || d <> ''")
def rs1(spark, sf_dir):
    lists = {"a": ["", "ו"], "b": ["", "כ", "ש"], "c": ["", "ב", "ל", "מ"], "d": ["", "ה"]}
    df = spark.range(1)
    for name, letters in lists.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, letters))))
    return df.select(F.concat("a", "b", "c", "d").alias("prefix")).where("prefix <> ''")


_TOL = [(1, "Dana  Levi", True), (2, "Dana-Levi", True), (3, "DanaLevi", False), (4, "xDana Levi", False), (5, "(Dana Levi)", True)]


@query("RS2_tolerant_match", f"SELECT id, want AS found FROM {sql_values('id, t, want', _TOL)}")
def rs2(spark, sf_dir):
    return values(spark, "id int, t string, want boolean", _TOL).select("id", F.call_function("rlike", F.col("t"), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), tx.flex(F.lit("Dana Levi")), F.lit(r"(?![\p{L}\p{N}])"))).alias("found"))


@query(
    "RS6_left_over",
    """
WITH t AS (SELECT c_custkey AS id, replace(c_name || ' of ' || n_name || ' met ' || n_name || ' of GERMANY', 'FRANCE', 'Real One') AS t FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM t)
SELECT id, CAST(i - 1 AS INTEGER) AS s, 'GERMANY' AS fake, 'Real Three or Real Two' AS real FROM k WHERE substr(t, i, 7) = 'GERMANY'""",
)
def rs6(spark, sf_dir):
    """Substitutes that stand for several people stay in the restored answer; each is listed where it now stands."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    text = F.concat("c_name", F.lit(" of "), "n_name", F.lit(" met "), "n_name", F.lit(" of GERMANY"))
    pairs = [("Real One", "FRANCE"), ("Real Two", "GERMANY"), ("Real Three", "GERMANY")]
    made = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), rv.restore(text, pairs)["text"].alias("t"))  # nations: a table of fixed size
    return made.select("id", F.inline(rv.left_over(F.col("t"), pairs))).select("id", "s", "fake", "real")


@query("RS7_restore_pairs", "SELECT * FROM (VALUES ('a', 'X'), ('b', 'Y'), ('d', 'W')) AS v(real, fake)")
def rs7(spark, sf_dir):
    one = lambda rows: values(spark, "real string, fake string", rows)
    return rv.restore_pairs(one([("a", "X"), ("b", "Y")]), one([("a", "Z"), ("c", "x "), ("d", "W")]))


_NATION_SQL = "SELECT n_name AS name, 30 + (n_nationkey * 37 % 40) / 20.0 AS lat, 34 + (n_nationkey * 53 % 60) / 30.0 AS lon, CASE n_nationkey % 2 WHEN 0 THEN 'x' ELSE 'y' END AS pop, CASE n_nationkey % 3 WHEN 0 THEN 'r' ELSE 's' END AS rel, CASE n_nationkey % 4 WHEN 0 THEN 'moshav' WHEN 1 THEN 'kibbutz' ELSE 'city' END AS type, CASE WHEN n_nationkey % 5 < 2 THEN 'small' ELSE 'large' END AS size FROM nation"


def nations(spark, sf_dir):
    """Nations as places: coordinates and character from their keys."""
    k = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), (30 + (k * 37 % 40) / 20.0).alias("lat"), (34 + (k * 53 % 60) / 30.0).alias("lon"), F.when(k % 2 == 0, "x").otherwise("y").alias("pop"),
        F.when(k % 3 == 0, "r").otherwise("s").alias("rel"), F.when(k % 4 == 0, "moshav").when(k % 4 == 1, "kibbutz").otherwise("city").alias("type"), F.when(k % 5 < 2, "small").otherwise("large").alias("size"),
    )


def _hav(a, b):
    return f"2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


def _pen(a, b):
    rural = lambda x: f"({x}.type IN ('moshav', 'kibbutz', 'community'))"
    return f"CASE WHEN {a}.pop <> {b}.pop THEN NULL ELSE CASE WHEN {a}.rel <> {b}.rel THEN 60 ELSE 0 END + CASE WHEN {rural(a)} <> {rural(b)} THEN 60 WHEN {a}.type <> {b}.type THEN 15 ELSE 0 END + CASE WHEN {a}.size <> {b}.size THEN 30 ELSE 0 END END"


@query("GEO1_haversine", f"WITH n AS ({_NATION_SQL}) SELECT a.name AS a, b.name AS b, round({_hav('a', 'b')}, 6) AS km FROM n a JOIN n b ON a.name < b.name")
def geo1(spark, sf_dir):
    n = nations(spark, sf_dir)
    pairs = n.alias("a").join(F.broadcast(n).alias("b"), F.col("a.name") < F.col("b.name"))  # nation: 25 rows
    return pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.round(rv.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")), 6).alias("km"))


@query("GEO2_penalty", f"WITH n AS ({_NATION_SQL}) SELECT a.name AS a, b.name AS b, CAST({_pen('a', 'b')} AS INTEGER) AS cost FROM n a JOIN n b ON a.name < b.name")
def geo2(spark, sf_dir):
    n = nations(spark, sf_dir)
    pairs = n.alias("a").join(F.broadcast(n).alias("b"), F.col("a.name") < F.col("b.name"))  # nation: 25 rows
    return pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), rv.penalty("a", "b").cast("int").alias("cost"))


@query("GEO3_differing", f"WITH n AS ({_NATION_SQL}) SELECT a.name AS a, b.name AS b, array_to_string([x for x in [CASE WHEN a.type <> b.type THEN 'type' END, CASE WHEN a.pop <> b.pop THEN 'pop' END, CASE WHEN a.rel <> b.rel THEN 'rel' END, CASE WHEN a.size <> b.size THEN 'size' END] if x IS NOT NULL], ',') AS axes FROM n a JOIN n b ON a.name < b.name")
def geo3(spark, sf_dir):
    n = nations(spark, sf_dir)
    pairs = n.alias("a").join(F.broadcast(n).alias("b"), F.col("a.name") < F.col("b.name"))  # nation: 25 rows
    return pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), F.array_join(rv.differing("a", "b"), ",").alias("axes"))


@query("R10_fake_place", f"WITH n AS ({_NATION_SQL}), p AS (SELECT a.name, b.name AS sub, CAST({_pen('a', 'b')} AS INTEGER) AS cost, {_hav('a', 'b')} AS km FROM n a JOIN n b ON a.name <> b.name) SELECT name, sub, cost FROM p WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY cost, round(km, 6), sub) = 1")
def r10(spark, sf_dir):
    n = nations(spark, sf_dir)
    return rv.nearest_in_character(n, n).select("name", "sub", F.col("cost").cast("int").alias("cost"))


_GEO4 = f"""
WITH n AS ({_NATION_SQL}), a AS (SELECT * FROM n WHERE name = 'NATION_7'), b AS (SELECT * FROM n WHERE name = 'NATION_12'),
c AS (SELECT (a.lat + b.lat) / 2 AS la, (a.lon + b.lon) / 2 AS lo FROM a, b),
g AS (SELECT n.name AS anchor, n.lat, n.lon, d.deg, m.mirror FROM n, (SELECT range * 30 AS deg FROM range(0, 12)) d, (VALUES (1), (-1)) AS m(mirror)),
t AS (SELECT g.*, g.lat + ((a.lon - lo) * cos(radians(la)) * mirror * sin(radians(deg)) + (a.lat - la) * cos(radians(deg))) AS ta, g.lon + ((a.lon - lo) * cos(radians(la)) * mirror * cos(radians(deg)) - (a.lat - la) * sin(radians(deg))) / cos(radians(g.lat)) AS tao,
  g.lat + ((b.lon - lo) * cos(radians(la)) * mirror * sin(radians(deg)) + (b.lat - la) * cos(radians(deg))) AS tb, g.lon + ((b.lon - lo) * cos(radians(la)) * mirror * cos(radians(deg)) - (b.lat - la) * sin(radians(deg))) / cos(radians(g.lat)) AS tbo FROM g, a, b, c),
s1 AS (SELECT t.*, p.name AS u, {_pen('a', 'p')} AS pu, 2 * 6371.0 * asin(sqrt(pow(sin(radians(ta - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(ta)) * pow(sin(radians(tao - p.lon) / 2), 2))) + {_pen('a', 'p')} AS sc FROM t, n p, a WHERE p.name NOT IN ('NATION_7', 'NATION_12') AND {_pen('a', 'p')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anchor, deg, mirror ORDER BY round(sc, 9), p.name) = 1),
s2 AS (SELECT s.*, p.name AS v, {_pen('b', 'p')} AS pv, 2 * 6371.0 * asin(sqrt(pow(sin(radians(tb - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(tb)) * pow(sin(radians(tbo - p.lon) / 2), 2))) + {_pen('b', 'p')} AS sd FROM s1 s, n p, b WHERE s.sc <= 110 AND p.name NOT IN ('NATION_7', 'NATION_12') AND p.name <> s.u AND {_pen('b', 'p')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY anchor, deg, mirror ORDER BY round(sd, 9), p.name) = 1),
r AS (SELECT u AS first, v AS second, round(abs({_hav('a', 'b')} - {_hav('x', 'y')}), 6) AS err, (pu + pv) / 2.0 AS pen FROM s2, a, b, n x, n y WHERE sd <= 110 AND x.name = u AND y.name = v)
SELECT CAST(row_number() OVER (ORDER BY min(err) + min(pen), first, second) AS INTEGER) AS rank, first, second, min(err) AS err, CAST(min(pen) AS DOUBLE) AS pen FROM r GROUP BY first, second QUALIFY rank <= 41"""


@query("GEO4_geo_map", _GEO4)
def geo4(spark, sf_dir):
    return rv.geo_map(nations(spark, sf_dir), ["NATION_7", "NATION_12"]).select("rank", "first", "second", "err", F.col("pen").cast("double").alias("pen"))
