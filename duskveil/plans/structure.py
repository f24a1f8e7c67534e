"""Queries of sources, formats and sanitisers (S, T)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as tx
from ..sources import docx, formats
from ..operators import substitute as su
from .detection import _GAPS, _WALK, resolved_hits
from .registry import query, read, sql_values, values


@query("S5_line_blocks", "SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS block_ix, md5(unnest(l)) AS line_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def s5(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_ix", "l")).select("doc_id", "block_ix", F.md5(F.col("l").cast("binary")).alias("line_md5"))


@query("S6_docx_round_trip", "WITH l AS (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ' || chr(9)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) SELECT doc_id AS id, count(*) AS blocks, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM l GROUP BY doc_id")
def s6(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = docx.read_blocks(docx.write_packages(texts))
    g = rows.groupBy("id").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("block_ix", "text"))).alias("b"))
    return g.select("id", "blocks", F.md5(F.array_join(F.transform("b", lambda x: x["text"]), "\n").cast("binary")).alias("text_md5"))


@query("S1_zip_members")
def s1(spark, sf_dir):
    def work(it):
        for pdf in it:
            rows = [(int(i), n, int(m), len(raw)) for i, c in zip(pdf["id"], pdf["content"]) for n, m, raw in docx.members(c)]
            yield pd.DataFrame(rows, columns=["id", "name", "method", "size"])

    made = docx.write_packages(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return made.mapInPandas(work, "id long, name string, method int, size long")


_NAMES = ["word/document.xml", "word/header1.xml", "word/footer.xml", "word/comments.xml", "word/media/image1.png", "docProps/core.xml", "word/styles.xml", "customXml/item1.xml", "docProps/thumbnail.jpeg", "word/charts/chart1.xml", "word/glossary/document.xml", "docProps/custom.xml", "word/people.xml"]
_N_ROWS = [(i, n) for i, n in enumerate(_NAMES)]


@query("S2_zip_writer", "SELECT doc_id AS id, octet_length(encode(text)) AS size, sha256(text) AS content FROM documents WHERE text IS NOT NULL")
def s2(spark, sf_dir):
    """Every text as the only member of a package, read back; the reader checks the member's CRC-32."""
    def work(it):
        for pdf in it:
            rows = [(int(i), raw) for i, t in zip(pdf["doc_id"], pdf["text"]) for _, _, raw in docx.members(docx.package([("text.txt", t.encode())]))]
            yield pd.DataFrame(rows, columns=["id", "raw"])

    made = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInPandas(work, "id long, raw binary")
    return made.select("id", F.octet_length("raw").cast("long").alias("size"), F.sha2("raw", 256).alias("content"))


_XML = [(1, '<a xmlns:w="urn:w" k="1>0"><w:p>x &amp; y</w:p></a>', True, '<a xmlns:w="urn:w" k="1>0">'), (2, "<a><b></a>", False, ""), (3, "<!-- <x> --><r><b/></r>", True, "<r>"), (4, "", False, ""), (5, '<?xml version="1.0"?><r xmlns:u="urn:unused">t</r>', True, '<r xmlns:u="urn:unused">')]


@query("S3_xml", f"SELECT id, ok, tag, ok AS same FROM {sql_values('id, xml, ok, tag', _XML)}")
def s3(spark, sf_dir):
    """Parts parsed and written again: damaged ones are told, the root's tag and the content stay."""
    def one(i, xml):
        try:
            out = docx.serialise(docx.parse_xml(xml.encode()), xml)
        except ValueError:
            return i, False, "", False
        flat = lambda x: [(e.tag, e.text) for e in docx.parse_xml(x.encode()).iter()]
        return i, True, docx.root_tag(out), flat(out) == flat(xml)

    def work(it):
        for pdf in it:
            yield pd.DataFrame([one(int(i), x) for i, x in zip(pdf["id"], pdf["xml"])], columns=["id", "ok", "tag", "same"])

    return values(spark, "id int, xml string, ok boolean, tag string", _XML).select("id", "xml").mapInPandas(work, "id int, ok boolean, tag string, same boolean")


@query("S4_text_parts", rf"SELECT id, name, regexp_matches(name, '^word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes|glossary/document|settings|numbering|styles|diagrams/.+|charts/.+)\.xml$') AS is_text FROM {sql_values('id, name', _N_ROWS)}")
def s4(spark, sf_dir):
    return values(spark, "id int, name string", _N_ROWS).select("id", "name", docx.is_text_part(F.col("name")).alias("is_text"))


@query("T7_dropped_parts", f"SELECT id, name FROM {sql_values('id, name', _N_ROWS)} WHERE NOT (name LIKE 'word/comments%.xml' OR name LIKE 'word/people.xml' OR name = 'docProps/custom.xml' OR name LIKE 'customXml/%' OR name LIKE 'docProps/thumbnail.%')")
def t7(spark, sf_dir):
    return values(spark, "id int, name string", _N_ROWS).where(~docx.is_dropped(F.col("name")))


@query("T11_part_labels", f"SELECT id, CASE WHEN name = 'word/document.xml' THEN 'body' WHEN name = 'word/comments.xml' THEN 'comments' WHEN name = 'docProps/core.xml' THEN 'properties' WHEN name LIKE 'word/header%' THEN 'header' WHEN name LIKE 'word/footer%' THEN 'footer' WHEN name LIKE 'word/media/%' THEN 'image' ELSE name END AS label FROM {sql_values('id, name', _N_ROWS)}")
def t11(spark, sf_dir):
    return values(spark, "id int, name string", _N_ROWS).select("id", docx.part_label(F.col("name")).alias("label"))


_ITEMS = [(1, 10.0, 100.0, "Hello"), (1, 60.0, 101.0, "world"), (1, 10.0, 80.0, "next"), (1, 60.0, 50.0, "שלום"), (1, 10.0, 50.5, "עולם"), (2, 5.0, 10.0, "two")]


@query("S7_pdf_lines", "SELECT * FROM (VALUES (1, 1, 'Hello world'), (1, 2, 'next'), (1, 3, 'שלום עולם'), (2, 1, 'two')) AS v(page, line, text)")
def s7(spark, sf_dir):
    return formats.pdf_lines(values(spark, "page int, x double, y double, text string", _ITEMS))


_LINES = "(SELECT source AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(
    "S8_scanned_pages",
    rf"""
WITH l AS (SELECT doc, page, line, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS key FROM {_LINES}),
k AS (SELECT doc, key FROM (SELECT DISTINCT doc, page, key FROM l WHERE key <> '') JOIN (SELECT doc, count(DISTINCT page) AS of FROM l GROUP BY doc) USING (doc) GROUP BY doc, key, of HAVING count(*) >= greatest(2, ceil(of / 2)))
SELECT l.doc, l.page, CAST(coalesce(sum(CASE WHEN k.key IS NULL THEN length(regexp_replace(line, '\s', '', 'g')) ELSE 0 END), 0) AS BIGINT) AS chars, coalesce(sum(CASE WHEN k.key IS NULL THEN length(regexp_replace(line, '\s', '', 'g')) ELSE 0 END), 0) < 40 AS image
FROM l LEFT JOIN k ON l.doc = k.doc AND l.key = k.key GROUP BY l.doc, l.page""",
)
def s8(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("line"))
    return formats.scanned_pages(lines, "doc", "page", "line")


@query("S9_headings", r"WITH f AS (SELECT doc_id, trim([x for x in string_split(text, chr(10)) if trim(x) <> ''][1]) AS t FROM documents) SELECT doc_id, coalesce(length(t) BETWEEN 1 AND 70 AND NOT regexp_matches(t, '[.!?:;,]$'), false) AS heading FROM f")
def s9(spark, sf_dir):
    first = F.get(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), 0)
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(formats.heading(first), F.lit(False)).alias("heading"))


@query("S10_json_log", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def s10(spark, sf_dir):
    parsed = F.from_json("props", "k string")
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), parsed.isNotNull().alias("valid"))


_CONLL = ["# text", "1\tDana\t_\tEntity=(per-1", "2\tLevi\t_\tEntity=per)", "", "1\tTavor\t_\tEntity=(org", "2\tx\t_\t_", ""]


@query("S11_conllu", 'SELECT * FROM (VALUES (0, 1, 1, 0), (1, 1, 0, 1)) AS v(sent, "open", "close", unmatched)')
def s11(spark, sf_dir):
    df = formats.conllu_entities(values(spark, "n int, line string", list(enumerate(_CONLL))))
    return df.select("sent", *[F.col(c).cast("int") for c in ("open", "close", "unmatched")])


_BMES = ["Dana B-PER", "Levi E-PER", "", "Tavor S-ORG", "x O"]


@query("S12_bmes", "SELECT * FROM (VALUES (0, 0, 'Dana', 'B-PER'), (0, 1, 'Levi', 'E-PER'), (1, 0, 'Tavor', 'S-ORG'), (1, 1, 'x', 'O')) AS v(sent, ix, token, tag)")
def s12(spark, sf_dir):
    return formats.bmes_rows(values(spark, "n int, line string", list(enumerate(_BMES))))


@query("S13_localities", "SELECT DISTINCT trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name FROM (SELECT regexp_replace(p_name || ' ' || p_partkey % 50 || CASE WHEN p_partkey % 3 = 0 THEN ' (old)' ELSE '' END, '\\s*\\([^)]*\\)', '', 'g') AS p_name FROM part) WHERE trim(regexp_replace(p_name, '\\s+', ' ', 'g')) NOT IN (SELECT p_name || ' ' || p_partkey % 50 FROM part WHERE p_partkey % 7 = 0 AND p_partkey < 60)")
def s13(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_partkey") % 3 == 0, " (old)").otherwise("")).alias("name"))
    return formats.localities(names, part.where("p_partkey % 7 = 0 and p_partkey < 60").select(F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 50).cast("string")).alias("name")))


@query("T6_scrub_targets", """SELECT page_id, md5(regexp_replace(html, '(href|src)="/[^"]*"', '\\1="#"', 'g')) AS m, CAST(len(regexp_extract_all(html, '(href|src)="/[^"]*"')) AS INTEGER) AS n FROM pages""")
def t6(spark, sf_dir):
    rx = '(href|src)="/[^"]*"'
    return read(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace("html", rx, '$1="#"').cast("binary")).alias("m"), F.size(F.regexp_extract_all("html", F.lit(rx), F.lit(0))).alias("n"))


_LINKS = [(1, 'a href="mailto:dana@example.com" b', 'a href="#" b'), (2, 'Target="file:///C:/x.doc"', 'Target="#"'), (3, 'href="https://example.com"', 'href="https://example.com"'), (4, r'src="\\server\share"', 'src="#"'), (5, r'href="C:\dana.doc"', 'href="#"')]


@query("T5_scrub_links", f"SELECT id, want AS made FROM {sql_values('id, t, want', _LINKS)}")
def t5(spark, sf_dir):
    return values(spark, "id int, t string, want string", _LINKS).select("id", docx.scrub_links(F.col("t")).alias("made"))


_RSID = [(1, '<w:p w:rsidR="00A1" w:x="1"/>', '<w:p w:x="1"/>'), (2, "<a><w:rsids><w:rsid/></w:rsids></a>", "<a></a>")]


@query("T3_strip_rsid", f"SELECT id, want AS made FROM {sql_values('id, t, want', _RSID)}")
def t3(spark, sf_dir):
    return values(spark, "id int, t string, want string", _RSID).select("id", docx.strip_rsid(F.col("t")).alias("made"))


_XML_HEAD = '<x xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'


def _cleaned(xml, what: str, take: str):
    """xml of a part after one of the sanitisers: its text, or the values of an attribute."""

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            root = docx.parse_xml(x.encode())
            getattr(docx, what)(root)
            return "|".join(e.get(take, "") for e in root.iter() if take in e.attrib) if take else "|".join(e.text or "" for e in root.iter() if not len(e))

        return column.map(one)

    return run(xml)


@query("T8_blank_metadata", "SELECT doc_id, '|||0|1|1970-01-01T00:00:00Z|' || coalesce(lang, '') AS made FROM documents")
def t8(spark, sf_dir):
    """Properties that hold each document's source are blank; times and revisions are the first; others stay."""
    props = F.concat(F.lit(_XML_HEAD + "<creator>"), tx.escape_xml(F.coalesce("source", F.lit(""))), F.lit("</creator><TitlesOfParts><v>"), tx.escape_xml(F.coalesce("source", F.lit(""))), F.lit("</v></TitlesOfParts><LastAuthor>x</LastAuthor><TotalTime>7</TotalTime><revision>9</revision><created>2026-01-01</created><words>"), F.coalesce("lang", F.lit("")), F.lit("</words></x>"))
    return read(spark, sf_dir, "documents").select("doc_id", _cleaned(props, "clean_properties", "").alias("made"))


@query("T2_strip_comments", "SELECT doc_id, 'a' || coalesce(source, '') AS made, 2 AS runs FROM documents")
def t2(spark, sf_dir):
    """Anchors of comments go, and runs that only held them."""
    xml = F.concat(F.lit(_XML_HEAD + '<w:commentRangeStart w:id="1"/><w:r><w:t>a</w:t></w:r><w:r><w:t>'), tx.escape_xml(F.coalesce("source", F.lit(""))), F.lit('</w:t></w:r><w:commentRangeEnd w:id="1"/><w:r><w:rPr/><w:commentReference w:id="1"/></w:r></x>'))
    made = _cleaned(xml, "strip_comments", "")
    return read(spark, sf_dir, "documents").select("doc_id", F.replace(made, F.lit("|"), F.lit("")).alias("made"), F.size(F.split(made, r"\|")).alias("runs"))


@query("T4_strip_hidden", "SELECT doc_id, 'kept' AS made FROM documents")
def t4(spark, sf_dir):
    """Names of content controls and document variables that hold each document's source go."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}val"
    xml = F.concat(F.lit(_XML_HEAD + '<w:sdtPr><w:alias w:val="'), tx.escape_attribute(F.coalesce("source", F.lit(""))), F.lit('"/><w:tag w:val="t"/><w:id w:val="kept"/></w:sdtPr><w:docVars><w:docVar w:val="gone"/></w:docVars></x>'))
    return read(spark, sf_dir, "documents").select("doc_id", _cleaned(xml, "strip_hidden", w).alias("made"))


@query("T5_field_links", "SELECT page_id, 'HYPERLINK \"#\" \\o \"x\"|HYPERLINK \"' || replace(coalesce(url, ''), '\"', '') || '\"' AS made FROM pages")
def t5_fields(spark, sf_dir):
    """Field codes that link to a person's mail lose their target; links to pages stay."""
    url = tx.escape_xml(F.replace(F.coalesce("url", F.lit("")), F.lit('"'), F.lit("")))
    xml = F.concat(F.lit(_XML_HEAD + '<w:instrText>HYPERLINK "mailto:me@'), url, F.lit('" \\o "x"</w:instrText><w:instrText>HYPERLINK "'), url, F.lit('"</w:instrText></x>'))
    return read(spark, sf_dir, "pages").select("page_id", _cleaned(xml, "clean_part", "").alias("made"))


@query("S_redact_package", f"WITH RECURSIVE {_WALK}{_GAPS}, packed AS (SELECT doc_id, coalesce(redacted, text, '') AS t FROM documents LEFT JOIN red USING (doc_id)) SELECT doc_id, md5(t) AS body_md5, md5(split_part(t, chr(10), 1)) AS header_md5, md5(split_part(t, chr(10), 1)) AS chart_md5, 0 AS leaks FROM packed")
def redact_package(spark, sf_dir):
    """Every document as a package (runs, text box, header, chart, comment, deletion, properties); detected, redacted in its
    runs, sanitised, written, verified, and read back from the bytes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source_text"))
    packed = docx.with_text(docx.rich_packages(docs, "source_text"))
    hits = su.ordinals(su.keyed(resolved_hits(F.col("text"))))
    label = lambda h: F.concat(F.lit("["), h["fam"], F.lit(" "), h["n"].cast("string"), F.lit("]"))
    edits = F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"), label(h).alias("r"), h["t"].alias("t"), F.lit(True).alias("apply")))
    made = docx.redacted_packages(packed.withColumn("edits", edits))
    back = docx.with_text(made.select("doc_id", "source_text", F.col("redacted.leaks").alias("package_leaks"), F.col("redacted.content").alias("content")))
    lines, n = F.split("text", "\n", -1), F.size(F.split("source_text", "\n", -1))
    md5 = lambda c: F.md5(c.cast("binary"))
    return back.select("doc_id", md5(F.array_join(F.slice(lines, F.lit(1), n), "\n")).alias("body_md5"), md5(F.element_at(lines, -2)).alias("header_md5"), md5(F.element_at(lines, -1)).alias("chart_md5"), F.size("package_leaks").alias("leaks"))


@query("T9_bookmarks", "SELECT doc_id, '_pib1|chapter|_pib2|_pib1' AS made FROM documents")
def t9(spark, sf_dir):
    """Hebrew bookmarks are numbered in the order of first appearance; each document's own stand for a package's."""
    mark = lambda name: F.concat(F.lit('<w:bookmarkStart w:name="'), name, F.lit('"/>'))
    one, two = F.concat(F.lit("פרק"), F.col("doc_id").cast("string")), F.lit("נספח")
    xml = F.concat(F.lit(_XML_HEAD), mark(one), mark(F.lit("chapter")), mark(two), mark(one), F.lit("</x>"))
    return read(spark, sf_dir, "documents").select("doc_id", _cleaned(xml, "rename_bookmarks", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}name").alias("made"))


_DEL = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a</w:t></w:r><w:ins><w:r><w:t>b</w:t></w:r></w:ins><w:del><w:r><w:delText>c</w:delText></w:r></w:del><w:r><w:tab/><w:t>d</w:t></w:r></w:p></w:body></w:document>'


@query("T1_tracked_changes", "SELECT * FROM (VALUES (1, 'ab' || chr(9) || 'd'), (2, NULL)) AS v(id, text)")
def t1(spark, sf_dir):
    rows = [(1, bytearray(docx.package([("word/document.xml", _DEL.encode())]))), (2, bytearray(b"no package"))]
    made = docx.read_blocks(spark.createDataFrame(rows, "id int, content binary"))
    return made.select(F.col("id").cast("int"), "text")


_RESIDUE = [(1, "<v>Dana Levi &amp; Co</v><v>Dana</v>", "<v>X Y</v><v>[removed]</v>")]


@query("T10_residue", f"SELECT id, want AS made FROM {sql_values('id, t, want', _RESIDUE)}")
def t10(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(r).alias("r")) for v, r in (("Dana Levi & Co", "X Y"), ("Dana Levi", "P Q"), ("Dana", "[removed]"))])  # longest first
    made = F.aggregate(pairs, F.col("t"), lambda t, p: F.replace(F.replace(t, tx.escape_xml(p["v"]), p["r"]), p["v"], p["r"]))
    return values(spark, "id int, t string, want string", _RESIDUE).select("id", made.alias("made"))
