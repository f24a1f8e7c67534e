"""Queries of the measurement engine (M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import measure as ms
from .registry import query, read, sql_values, values

_JOIN = "labels l JOIN documents d USING (doc_id)"
_HIT = "contains(text, '###') OR contains(text, '***')"


def judged(spark, sf_dir):
    """labels with a rule's verdict on the document: hit where it holds runs of signs."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", (F.contains("text", F.lit("###")) | F.contains("text", F.lit("***"))).alias("hit"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id")


_KEY = [(1, "NAME", "Dana Levi"), (1, "NAME", "Omer"), (2, "ORG", "Tavor"), (2, "NAME", "Ron Gal"), (3, "NAME", "Noa")]
_SURF = [(1, "Dana Levi"), (1, "xOmer"), (2, "Bank Tavor House"), (2, "Ron"), (3, "Noam")]


@query("M2_word_in", f"SELECT k.doc, k.v AS value, s.s AS surface, (s.s = k.v OR (length(k.v) >= 3 AND regexp_matches(s.s, '(^|[^A-Za-z])' || k.v || '($|[^A-Za-z])'))) AS hit FROM {sql_values('doc, cat, v', _KEY)} k JOIN {sql_values('doc, s', _SURF)} s ON k.doc = s.doc")
def m2(spark, sf_dir):
    k, s = values(spark, "doc int, cat string, value string", _KEY), values(spark, "doc int, surface string", _SURF)
    inside = F.call_function("rlike", F.col("surface"), F.concat(F.lit("(^|[^A-Za-z])\\Q"), F.col("value"), F.lit("\\E($|[^A-Za-z])")))
    return k.join(s, "doc").select("doc", "value", "surface", ((F.col("surface") == F.col("value")) | ((F.length("value") >= 3) & inside)).alias("hit"))


@query("M1_chain_score", f"WITH x AS (SELECT k.doc, k.cat, k.v, bool_or(s.s = k.v OR contains(s.s, k.v)) AS found, bool_or(contains(s.s, k.v) AND s.s <> k.v) AS leaked FROM {sql_values('doc, cat, v', _KEY)} k LEFT JOIN {sql_values('doc, s', _SURF)} s ON k.doc = s.doc GROUP BY ALL) SELECT doc, cat, v AS value, found, leaked, NOT found AS missed FROM x")
def m1(spark, sf_dir):
    k, s = values(spark, "doc int, cat string, value string", _KEY), values(spark, "doc int, surface string", _SURF)
    has = F.contains("surface", F.col("value"))
    x = k.join(s, "doc", "left").groupBy("doc", "cat", "value").agg(F.bool_or(has).alias("found"), F.bool_or(has & (F.col("surface") != F.col("value"))).alias("leaked"))
    return x.withColumn("missed", ~F.col("found"))


@query("M3_tables", f"SELECT lang, source, count(*) FILTER (toxic = 1 AND ({_HIT})) AS found, count(*) FILTER (toxic = 1 AND NOT ({_HIT})) AS missed, count(*) FILTER (toxic = 0 AND ({_HIT})) AS fp, count(*) AS n FROM {_JOIN} GROUP BY GROUPING SETS ((lang), (source), ())")
def m3(spark, sf_dir):
    judged(spark, sf_dir).createOrReplaceTempView("_judged")
    return spark.sql("SELECT lang, source, count_if(toxic = 1 AND hit) AS found, count_if(toxic = 1 AND NOT hit) AS missed, count_if(toxic = 0 AND hit) AS fp, count(*) AS n FROM _judged GROUP BY GROUPING SETS ((lang), (source), ())")


@query("M4_totals", f"SELECT count(*) AS n, count(*) FILTER ({_HIT}) AS hits, CAST(sum(n_chars) AS BIGINT) AS chars FROM {_JOIN}")
def m4(spark, sf_dir):
    return judged(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum("n_chars").alias("chars"))


_BASE = [(1, "NAME", "a", True, False, 0), (1, "NAME", "b", True, False, 0), (1, "ORG", "c", False, False, 1), (2, "NAME", "d", True, True, 0), (2, "ORG", "e", True, False, 0)]
_NOW = [(1, "NAME", "a", True, True, 0), (1, "NAME", "b", True, False, 0), (1, "ORG", "c", False, False, 2), (2, "NAME", "d", True, False, 0), (3, "NAME", "f", True, False, 0), (3, "NAME", "g", True, True, 0)]


@query("M5_gate", "SELECT * FROM (VALUES (1, 'NAME', 'a', 'worse'), (1, 'NAME', 'b', 'same'), (1, 'ORG', 'c', 'worse'), (2, 'NAME', 'd', 'better'), (2, 'ORG', 'e', 'gone'), (3, 'NAME', 'f', 'added'), (3, 'NAME', 'g', 'added-leaking')) AS v(doc, cat, canonical, verdict)")
def m5(spark, sf_dir):
    s = "doc int, cat string, canonical string, found boolean, leaked boolean, fp int"
    return ms.gate(values(spark, s, _BASE), values(spark, s, _NOW), ["doc", "cat", "canonical"])


@query("M5_gate_documents", "WITH b AS (SELECT doc_id, n_chars > 500 AS leaked FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, n_chars > 700 AS leaked FROM documents WHERE doc_id % 3 <> 1) SELECT doc_id, CASE WHEN b.leaked IS NULL THEN CASE WHEN n.leaked THEN 'added-leaking' ELSE 'added' END WHEN n.leaked IS NULL THEN 'gone' WHEN n.leaked AND NOT b.leaked THEN 'worse' WHEN b.leaked AND NOT n.leaked THEN 'better' ELSE 'same' END AS verdict FROM b FULL JOIN n USING (doc_id)")
def m5_docs(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    row = lambda limit, other: d.where(F.col("doc_id") % 3 != other).select("doc_id", F.lit(True).alias("found"), (F.col("n_chars") > limit).alias("leaked"), F.lit(0).alias("fp"))
    return ms.gate(row(500, 0), row(700, 1), ["doc_id"])


_GOLD = [(1, 1, 5, 10, "PER", True), (1, 2, 20, 24, "ORG", False), (2, 1, 0, 4, "PER", True), (2, 2, 4, 9, "PER", True)]
_PRED = [(1, 1, 5, 10, "PER", 0.9), (1, 2, 6, 12, "PER", 0.8), (1, 3, 20, 22, "ORG", 0.7), (2, 1, 2, 8, "PER", 0.6), (2, 2, 0, 3, "PER", 0.5)]


@query("M7_pair_up", "SELECT * FROM (VALUES (1, 1, 1), (1, 2, 3), (2, 2, 1), (2, 1, 2)) AS v(doc, g, p)")
def m7(spark, sf_dir):
    return ms.pair_up(values(spark, "doc int, id int, s int, e int, type string, must boolean", _GOLD), values(spark, "doc int, id int, s int, e int, type string, score double", _PRED), ["doc"])


@query("M8_doc_counts", "SELECT * FROM (VALUES (1, 1, 2, 0, 1), (2, 2, 0, 0, 0), (98, 0, 0, 1, 0), (99, 0, 1, 0, 0)) AS v(doc, tp, fp, fn, traps)")
def m8(spark, sf_dir):
    """Document 98 has no predictions, document 99 no gold."""
    g = values(spark, "doc int, id int, s int, e int, type string, must boolean", [*_GOLD, (98, 900, 0, 4, "PER", True)])
    p = values(spark, "doc int, id int, s int, e int, type string, score double", [*_PRED, (99, 901, 0, 4, "PER", 0.9)])
    return ms.doc_counts(g, p).select("doc", *[F.col(c).cast("int").alias(c) for c in ("tp", "fp", "fn", "traps")])


@query("M6_snap", "WITH g AS (SELECT doc_id, instr(text, ' ') - 1 AS s FROM documents WHERE instr(text, ' ') > 0), w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ ]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^ ]+'), 1) AS i FROM documents) SELECT g.doc_id, CAST(0 AS INTEGER) AS s, CAST(g.s + 1 + coalesce((SELECT length(w) FROM w WHERE w.doc_id = g.doc_id AND i = 2), 0) AS INTEGER) AS e FROM g JOIN documents d USING (doc_id) WHERE substr(text, 1, 1) <> ' ' AND substr(text, g.s + 2, 1) <> ' ' AND length(text) > g.s + 1")
def m6(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where((F.instr("text", " ") > 1))
    s = F.instr("text", " ") - 1
    d = d.where((F.substring("text", s + 2, F.lit(1)) != " ") & (F.length("text") > s + 1))
    two = F.split(F.col("text"), " ", 3)
    words = d.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("ws"), s.alias("we")), F.struct((s + 1).alias("ws"), (s + 1 + F.length(F.get(two, 1))).alias("we")))).alias("x")).select("doc_id", "x.ws", "x.we")
    spans = d.select("doc_id", F.lit(1).alias("id"), (s - 1).alias("s"), (s + 2).alias("e"))
    return ms.snap(spans, words, ["doc_id"]).select("doc_id", F.col("s").cast("int"), F.col("e").cast("int"))


_PRF = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS p, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS r, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN 5 * tp + fp + 4 * fn = 0 THEN 0 ELSE 5 * tp / (5 * tp + fp + 4 * fn) END, 6) AS f2"


@query("M9_scores", f"WITH c AS (SELECT lang, CAST(count(*) FILTER (quality = 0 AND ({_HIT})) AS DOUBLE) AS tp, CAST(count(*) FILTER (quality = 1 AND ({_HIT})) AS DOUBLE) AS fp, CAST(count(*) FILTER (quality = 0 AND NOT ({_HIT})) AS DOUBLE) AS fn FROM {_JOIN} GROUP BY lang) SELECT lang, {_PRF} FROM c")
def m9(spark, sf_dir):
    j = judged(spark, sf_dir)
    c = j.groupBy("lang").agg(F.count_if((F.col("quality") == 0) & F.col("hit")).alias("tp"), F.count_if((F.col("quality") == 1) & F.col("hit")).alias("fp"), F.count_if((F.col("quality") == 0) & ~F.col("hit")).alias("fn"))
    return c.select("lang", *[v.alias(k) for k, v in ms.scores(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("M10_diff", f"SELECT CASE WHEN ({_HIT}) AND toxic = 1 THEN 'both' WHEN ({_HIT}) THEN 'onlyA' WHEN toxic = 1 THEN 'onlyB' ELSE 'neither' END AS side, count(*) AS n FROM {_JOIN} GROUP BY 1")
def m10(spark, sf_dir):
    return judged(spark, sf_dir).groupBy(ms.agreement(F.col("hit"), F.col("toxic") == 1).alias("side")).agg(F.count("*").alias("n"))


GRID = [x / 100 for x in range(30, 100, 5)]
_SCORED = "(SELECT round(abs(embedding[1]) * 4, 2) AS score, label % 2 = 0 AS hit FROM embeddings)"
_CURVE = f"(SELECT t, CAST(count(*) FILTER (hit AND score >= t) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT hit AND score >= t) AS DOUBLE) AS fp, CAST((SELECT count(*) FROM {_SCORED} WHERE hit) - count(*) FILTER (hit AND score >= t) AS DOUBLE) AS fn FROM {_SCORED} s, (SELECT unnest([{', '.join(map(str, GRID))}]) AS t) GROUP BY t)"


def scored(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.round(F.abs(F.get("embedding", 0).cast("double")) * 4, 2).alias("score"), (F.col("label") % 2 == 0).alias("hit"))


def curve(spark, sf_dir):
    s = scored(spark, sf_dir)
    return ms.sweep(s, s.where("hit").count(), GRID)


@query("M11_sweep", f"SELECT CAST(t AS DOUBLE) AS t, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, p, r, f2 FROM (SELECT *, {_PRF} FROM {_CURVE.replace('embedding[1]', 'CAST(embedding[1] AS DOUBLE)')})")
def m11(spark, sf_dir):
    return curve(spark, sf_dir)


@query("M11_average_precision", f"WITH c AS (SELECT t, {_PRF} FROM {_CURVE.replace('embedding[1]', 'CAST(embedding[1] AS DOUBLE)')}), m AS (SELECT *, max(r) OVER (ORDER BY t DESC) AS rm FROM c), d AS (SELECT p, rm - coalesce(lag(rm) OVER (ORDER BY t DESC), 0) AS d FROM m) SELECT round(sum(p * d), 6) AS ap FROM d")
def m11_ap(spark, sf_dir):
    return ms.average_precision(curve(spark, sf_dir))


@query("M12_bands", f"SELECT CASE WHEN score < 0.25 THEN 'a' WHEN score < 0.5 THEN 'b' WHEN score < 0.75 THEN 'c' ELSE 'd' END AS band, count(*) AS n, count(*) FILTER (hit) AS correct, round(count(*) FILTER (hit) / count(*), 6) AS share FROM {_SCORED.replace('embedding[1]', 'CAST(embedding[1] AS DOUBLE)')} GROUP BY 1")
def m12(spark, sf_dir):
    band = F.when(F.col("score") < 0.25, "a").when(F.col("score") < 0.5, "b").when(F.col("score") < 0.75, "c").otherwise("d")
    return scored(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"), F.round(F.count_if("hit") / F.count("*"), 6).alias("share"))


@query("M13_bootstrap")
def m13(spark, sf_dir):
    units = judged(spark, sf_dir).groupBy(F.col("source").alias("unit")).agg(F.avg("quality").alias("a"), F.avg("toxic").alias("b"))
    return ms.bootstrap(units)


_KNOWN = [(1, 0, 4, 0, 4), (2, 0, 4, 1, 4), (3, 2, 6, 0, 6), (4, 2, 6, 2, 9), (5, 0, 4, None, None), (6, 0, 4, 0, 3), (7, 2, 6, 1, 8)]
_WANT = ["exact", "cut-left", "glued-left", "glued-right", "none", "cut-right", "other"]


@query("M15_boundaries", f"SELECT id, want AS class FROM {sql_values('id, want', list(enumerate(_WANT, 1)))}")
def m15(spark, sf_dir):
    df = values(spark, "id int, gs int, ge int, ps int, pe int", _KNOWN)
    return df.select("id", ms.boundary_class(*map(F.col, ("gs", "ge", "ps", "pe"))).alias("class"))


_RANKS = [("a", "partial"), ("a", "exact"), ("b", "missed"), ("b", "glued"), ("c", "missed")]


@query("M14_known_cases", "SELECT * FROM (VALUES ('a', 'exact', true), ('b', 'glued', false), ('c', 'missed', false)) AS v(name, best, passed)")
def m14(spark, sf_dir):
    rank = F.create_map(*[F.lit(x) for kv in {"missed": 0, "partial": 1, "glued": 2, "glued-prefix": 3, "prefix-cut": 4, "exact": 5}.items() for x in kv])
    best = values(spark, "name string, bucket string", _RANKS).groupBy("name").agg(F.max_by("bucket", F.element_at(rank, F.col("bucket"))).alias("best"))
    return best.withColumn("passed", F.col("best").isin("exact", "prefix-cut"))


@query("M16_gold_synthesis", "SELECT * FROM (VALUES ('Dana Levi', 0, 9, 'must'), ('Dana', 14, 18, 'must'), ('Mount Dana', 24, 34, 'trap')) AS v(surface, s, e, kind)")
def m16(spark, sf_dir):
    from ..functions import spans

    text = F.lit("Dana Levi and Dana near Mount Dana")
    order = [("Mount Dana", "trap"), ("Dana Levi", "must"), ("Dana", "must")]  # traps, then longer surfaces
    found = F.array(*[F.transform(spans.matches(text, rf"\b\Q{v}\E\b"), _named(v, k)) for v, k in order])
    none = F.array().cast("array<struct<surface:string,s:int,e:int,kind:string>>")
    free = lambda m, taken: ~F.exists(taken, lambda c: (c["s"] < m["e"]) & (m["s"] < c["e"]))
    kept = F.aggregate(found, none, lambda taken, phase: F.concat(taken, F.filter(phase, lambda m: free(m, taken))))
    return spark.range(1).select(F.inline(kept))


def _named(v, k):
    return lambda m: F.struct(F.lit(v).alias("surface"), m["s"].alias("s"), m["e"].alias("e"), F.lit(k).alias("kind"))


@query("M17_noise_band", "WITH r AS (SELECT doc_id, 1 AS run, n_chars > 500 AS found FROM documents UNION ALL SELECT doc_id, 2, n_chars > 510 FROM documents UNION ALL SELECT doc_id, 3, n_chars > 490 FROM documents) SELECT doc_id FROM r GROUP BY doc_id HAVING bool_or(found) AND NOT bool_and(found)")
def m17(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    runs = [d.select("doc_id", (F.col("n_chars") > n).alias("found")) for n in (500, 510, 490)]
    both = runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("doc_id").agg(F.bool_or("found").alias("any"), F.bool_and("found").alias("every"))
    return both.where("any and not every").select("doc_id")


@query("M18_decision", f"WITH c AS (SELECT avg(CASE WHEN ({_HIT}) = (quality = 0) THEN 1.0 ELSE 0.0 END) AS acc, count(*) FILTER (toxic = 1 AND NOT ({_HIT})) AS leaks, count(*) AS n FROM {_JOIN}) SELECT acc > 0.8 AS accurate, leaks < n / 2 AS bounded, n >= 100 AS enough, acc > 0.8 AND leaks < n / 2 AND n >= 100 AS accept FROM c")
def m18(spark, sf_dir):
    j = judged(spark, sf_dir).agg(F.avg((F.col("hit") == (F.col("quality") == 0)).cast("double")).alias("acc"), F.count_if((F.col("toxic") == 1) & ~F.col("hit")).alias("leaks"), F.count("*").alias("n"))
    rules = {"accurate": F.col("acc") > 0.8, "bounded": F.col("leaks") < F.col("n") / 2, "enough": F.col("n") >= 100}
    accept = rules["accurate"] & rules["bounded"] & rules["enough"]
    return j.select(*[c.alias(k) for k, c in rules.items()], accept.alias("accept"))


@query("M19_coverage", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT source) >= 3 AS covered FROM documents GROUP BY lang")
def m19(spark, sf_dir):
    n = F.countDistinct("source")
    return read(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("sources"), (n >= 3).alias("covered"))


@query("M20_corpus_dedup", r"WITH l AS (SELECT DISTINCT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM benchmark) SELECT doc_id, count(*) AS kept FROM l WHERE line <> '' AND line NOT IN (SELECT line FROM b) GROUP BY doc_id")
def m20(spark, sf_dir):
    line = lambda df, *c: df.select(*c, F.explode(F.split("text", "\n", -1)).alias("l")).select(*c, F.trim(F.regexp_replace("l", r"\s+", " ")).alias("line")).where("line <> ''").distinct()
    docs = line(read(spark, sf_dir, "documents"), "doc_id")
    return docs.join(line(read(spark, sf_dir, "benchmark")), "line", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("M21_leak_shape", "SELECT CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'digits' WHEN regexp_matches(w, '^[A-Za-z]+$') THEN 'latin' ELSE 'other' END AS class, CAST(least(length(w), 20) AS INTEGER) AS size, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY ALL")
def m21(spark, sf_dir):
    w = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ", -1)).alias("w")).where("w <> ''")
    return w.groupBy(F.when(F.col("w").rlike("^[0-9]+$"), "digits").when(F.col("w").rlike("^[A-Za-z]+$"), "latin").otherwise("other").alias("class"), F.least(F.length("w"), F.lit(20)).alias("size")).agg(F.count("*").alias("n"))


@query("M22_shape_harvest", r"WITH s AS (SELECT source, regexp_replace(regexp_replace(unnest(regexp_extract_all(text, '.@.')), '[A-Za-z0-9]', 'a', 'g'), '[^a@]', '_', 'g') AS shape FROM documents) SELECT shape, count(*) AS n FROM s WHERE shape NOT IN ('_@_') GROUP BY shape")
def m22(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(".@."), F.lit(0))).alias("x"))
    s = s.select(F.regexp_replace(F.regexp_replace("x", "[A-Za-z0-9]", "a"), "[^a@]", "_").alias("shape"))
    known = F.broadcast(values(spark, "shape string", [("_@_",)]))  # listed shapes
    return s.join(known, "shape", "left_anti").groupBy("shape").agg(F.count("*").alias("n"))


@query("M23_reproduction", "WITH RECURSIVE r AS (SELECT 0 AS i, CAST(7 AS BIGINT) AS x UNION ALL SELECT i + 1, (x * 1103515245 + 12345) % 2147483648 FROM r WHERE i < 20) SELECT i, x, chr(CAST(97 + x % 26 AS INTEGER)) AS letter FROM r")
def m23(spark, sf_dir):
    step = lambda x: (x * 1103515245 + 12345) % 2147483648
    seq = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.array(F.lit(7).cast("long")), lambda acc, i: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    return spark.range(1).select(F.posexplode(seq).alias("i", "x")).select("i", "x", F.char(97 + F.col("x") % 26).alias("letter"))


@query("M24_privacy_gate", "SELECT event_type, count(*) FILTER (regexp_matches(props, '^[][{}:,\" A-Za-z0-9_.-]*$')) AS passed, count(*) FILTER (NOT regexp_matches(props, '^[][{}:,\" A-Za-z0-9_.-]*$')) AS refused FROM events GROUP BY event_type")
def m24(spark, sf_dir):
    fine = F.col("props").rlike(r'^[\]\[{}:," A-Za-z0-9_.-]*$')
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(fine).alias("passed"), F.count_if(~fine).alias("refused"))
