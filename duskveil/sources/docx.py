"""Word packages: reading members, blocks of text, sanitising, writing.

Packages come from ``spark.read.format("binaryFile")``; the bytes are opened where they are, a package per row, in
Arrow batches of bounded size. A damaged package gives one row with ``error``; null content gives none.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import ship

#: Namespaces of the format, parts that hold text, parts that are dropped, properties that are blanked.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TEXT_PARTS = r"^word/(document|header\d*|footer\d*|footnotes|endnotes|glossary/document|settings|numbering|styles|diagrams/.+|charts/.+)\.xml$"
DROPPED = r"^(word/comments.*|word/people|docProps/custom)\.xml$|^customXml/|^docProps/thumbnail\."
BLANKED = ["creator", "title", "subject", "description", "keywords", "lastModifiedBy", "LastAuthor", "category", "contentStatus", "Company", "Manager", "Template", "Application", "AppVersion", "identifier", "TitlesOfParts", "HeadingPairs", "TotalTime", "lastPrinted", "HyperlinkBase"]
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n'
LABELS = {"word/document.xml": "body", "word/footnotes.xml": "footnotes", "word/endnotes.xml": "endnotes", "word/comments.xml": "comments", "docProps/core.xml": "properties"}


def is_text_part(name: Column) -> Column:
    return name.rlike(TEXT_PARTS)


def is_dropped(name: Column) -> Column:
    return name.rlike(DROPPED)


def part_label(name: Column) -> Column:
    """What people call a part."""
    listed = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), name)
    return F.coalesce(listed, F.when(name.rlike("^word/header"), "header").when(name.rlike("^word/footer"), "footer").when(name.rlike("^word/media/"), "image").otherwise(name))


def scrub_links(c: Column, to: str = "#") -> Column:
    """Targets that name a person or a machine: mail, files, drives, network shares."""
    return F.regexp_replace(c, r'(?i)((?:href|src|Target)=")(?:mailto:|file:|[a-z]:\\|\\\\)[^"]*(")', f"$1{to}$2")


def strip_rsid(c: Column) -> Column:
    """XML without revision marks of editing sessions."""
    return F.regexp_replace(F.regexp_replace(c, r'\s+w:rsid\w*="[^"]*"', ""), r"<w:rsids>.*?</w:rsids>", "")


def members(content: bytes) -> list[tuple[str, int, bytes]]:
    """(name, method, bytes) of every member."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(i.filename, i.compress_type, z.read(i)) for i in z.infolist() if not i.is_dir()]


def package(parts: list[tuple[str, bytes]]) -> bytes:
    """A package; members that deflating does not shorten are stored. The bytes depend on the parts alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in parts:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            packed = zlib.compressobj(wbits=-15)
            smaller = len(packed.compress(raw) + packed.flush()) < len(raw)
            z.writestr(info, raw, zipfile.ZIP_DEFLATED if smaller else zipfile.ZIP_STORED)
    return out.getvalue()


def root_tag(xml: str) -> str:
    """The opening tag of the root as it is written, or an empty text."""
    m = re.search(r"""<[^?!/](?:"[^"]*"|'[^']*'|[^>"'])*>""", re.sub(r"<!--.*?-->", "", xml, flags=re.S))
    return m.group() if m else ""


def parse_xml(content: bytes) -> ET.Element:
    """The root of an XML part; ValueError if it is damaged."""
    try:
        return ET.fromstring(content)
    except ET.ParseError as e:
        raise ValueError(f"damaged XML: {e}") from e


def serialise(root: ET.Element, original: str) -> str:
    """The part as text under the original's root tag, which declares all namespaces that the original had."""
    kept = root_tag(original)
    prefixes = dict(re.findall(r"""\sxmlns:([\w.-]+)=["']([^"']*)["']""", kept))
    for prefix, uri in prefixes.items():
        if not re.fullmatch(r"ns\d+", prefix):  # reserved by the writer
            ET.register_namespace(prefix, uri)
    if own_default := re.search(r"""\sxmlns=["']([^"']+)["']""", kept):
        ET.register_namespace("", own_default[1])
    made = ET.tostring(root, encoding="unicode")
    own = root_tag(made)
    if kept and not kept.endswith("/>") and not own.endswith("/>"):
        made = made.replace(own, kept, 1)
    return HEAD + made.replace("\r", "&#13;")  # a bare one would be read as a line's end


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def accept_changes(root: ET.Element) -> None:
    """Tracked changes as accepted: deletions go, insertions stay without their wrapper, records of changes go."""
    for parent in list(root.iter()):
        kept: list[ET.Element] = []
        for child in list(parent):
            t = _tag(child)
            if t in ("del", "moveFrom", "delText") or t.endswith("PrChange"):
                continue
            kept += list(child) if t in ("ins", "moveTo") else [child]
        parent[:] = kept
        if any(_tag(c) in ("ins", "moveTo", "del", "moveFrom") for c in kept):
            accept_changes(parent)


def strip_comments(root: ET.Element) -> None:
    """Without anchors of comments, and without runs that only held them."""
    for parent in list(root.iter()):
        parent[:] = [c for c in parent if _tag(c) not in ("commentRangeStart", "commentRangeEnd", "commentReference")]
    for parent in list(root.iter()):
        parent[:] = [c for c in parent if not (_tag(c) == "r" and not [x for x in c if _tag(x) != "rPr"])]


def strip_hidden(root: ET.Element) -> None:
    """Without document variables and the names of content controls."""
    for parent in list(root.iter()):
        parent[:] = [c for c in parent if not (_tag(c) == "docVars" or _tag(parent) == "sdtPr" and _tag(c) in ("alias", "tag"))]


def rename_bookmarks(root: ET.Element) -> dict[str, str]:
    """Bookmarks with Hebrew names as _pib1, _pib2, ... in order, and what refers to them."""
    names: dict[str, str] = {}
    for e in root.iter():
        if _tag(e) == "bookmarkStart":
            n = e.get(f"{{{W}}}name") or ""
            if re.search("[֐-׿]", n) and n not in names:
                names[n] = f"_pib{len(names) + 1}"
    for e in root.iter():
        for k, v in list(e.attrib.items()):
            if v in names:
                e.set(k, names[v])
        if e.text and _tag(e) == "instrText":
            for old, new in names.items():
                e.text = e.text.replace(old, new)
    return names


@dataclass
class Block:
    """A stretch of text and the runs that hold it: (element, attribute or None for its text, start, end); separators have
    no element."""

    text: str = ""
    label: bool = False
    runs: list[tuple[ET.Element | None, str | None, int, int]] = field(default_factory=list)

    def add(self, element: ET.Element | None, attribute: str | None, text: str) -> None:
        self.runs.append((element, attribute, len(self.text), len(self.text) + len(text)))
        self.text += text


_LABEL_ATTRIBUTES = ("descr", "title", "name", f"{{{W}}}val")


def flatten(root: ET.Element) -> list[Block]:
    """The blocks of a part: each paragraph of text or drawing without those nested in it, then chart labels outside
    paragraphs, alternative texts and captions. Tabs and breaks of runs are one character."""
    out: list[Block] = []

    def walk(e: ET.Element, block: Block | None) -> None:
        t = _tag(e)
        if t == "p" and e.tag != t and not e.tag.endswith("presentationml}p"):
            block = Block()
            out.append(block)
        elif block is not None and t == "t" or t in ("instrText", "v") and (block is not None or t == "v") and (e.text or "").strip():
            if block is None:
                out.append(Block(label=True))
            (block if block is not None else out[-1]).add(e, None, e.text or "")
            return
        elif block is not None and t in ("tab", "br", "cr", "noBreakHyphen"):
            block.add(None, None, {"tab": "\t", "noBreakHyphen": "-"}.get(t, "\n"))
        elif t in ("pPr", "rPr", "sectPr"):  # tab stops are no text
            return
        for child in e:
            walk(child, block)

    walk(root, None)
    for e in root.iter():
        if _tag(e) in ("docPr", "cNvPr", "tblCaption", "tblDescription"):
            for k in _LABEL_ATTRIBUTES:
                if v := e.get(k):
                    out.append(Block(label=True))
                    out[-1].add(e, k, v)
    return out


def rewrite(block: Block, edits: list[tuple[int, int, str]]) -> None:
    """Puts (start, end, text) edits, sorted and apart, into the block's runs, from the right: the new text goes to the first
    run that the span touches, and the others lose their share. Separators inside a span stay."""
    for s, e, new in reversed(edits):
        todo = new
        for element, attribute, a, b in block.runs:
            if element is None or b <= s or a >= e or a == b:
                continue
            old = (element.text or "") if attribute is None else element.get(attribute, "")
            text = old[: max(s, a) - a] + todo + old[min(e, b) - a :]  # what edits further right changed lies behind
            todo = ""
            if attribute is None:
                element.text = text
                if element.tag == f"{{{W}}}t":
                    element.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            else:
                element.set(attribute, text)


def blocks_of(xml: bytes) -> Iterator[tuple[str, bool]]:
    """(text, label) of each block of a part as readers see it: changes accepted, hidden names and comments gone."""
    root = ET.fromstring(xml)
    accept_changes(root)
    strip_hidden(root)
    strip_comments(root)
    for b in flatten(root):
        yield b.text, b.label


def text_to_docx(text: str) -> bytes:
    """A package whose paragraphs are the text's lines."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").split("\n")
    clean = lambda s: re.sub(r"[^\t\x20-퟿-�\U00010000-\U0010ffff]", "", s)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(clean(x.strip()))}</w:t></w:r></w:p>' for x in lines)
    return package([("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'.encode())])


_BLOCK = pa.schema([("id", pa.int64()), ("block_ix", pa.int32()), ("part", pa.string()), ("label", pa.bool_()), ("text", pa.string()), ("error", pa.string())])


def read_blocks(packages: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, block_ix, part, label, text, error): the blocks of all text parts of packages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1)):
                if not c.is_valid:
                    continue
                try:
                    found = [(name, label, text) for name, _, raw in members(c.as_py()) if re.match(TEXT_PARTS, name) for text, label in blocks_of(raw)]
                    rows = [(i, k, *f, None) for k, f in enumerate(found)]
                except (zipfile.BadZipFile, ET.ParseError, zlib.error, ValueError) as e:
                    rows = [(i, 0, None, None, None, str(e)[:200])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_BLOCK)], schema=_BLOCK)

    ship.prepare(packages.sparkSession)
    return packages.select(F.col(id_col).cast("long"), content_col).mapInArrow(work, "id long, block_ix int, part string, label boolean, text string, error string")


def write_packages(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, content): a package per text."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_to_docx(t or "") for t in b.column(1).to_pylist()], pa.binary())], schema=schema)

    ship.prepare(texts.sparkSession)
    return texts.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(work, "id long, content binary")


# --- a redacted package ---------------------------------------------------------------------------------------------------


def _scrubbed_target(target: str) -> str:
    """A link's target, or # where it names a person or a machine."""
    return "#" if re.match(r"(?i)(?:mailto:|file:|[a-z]:\\|\\\\)", target) else target


def clean_part(root: ET.Element) -> list[str]:
    """Everything that is taken out of a part of text before it is read; gives the targets of field links that went."""
    gone: list[str] = []
    accept_changes(root)
    strip_comments(root)
    strip_hidden(root)
    rename_bookmarks(root)
    for parent in list(root.iter()):
        parent[:] = [c for c in parent if _tag(c) not in ("rsids", "rsid")]
        for k in [k for k in parent.attrib if k.rpartition("}")[2].startswith("rsid")]:
            del parent.attrib[k]
        if _tag(parent) == "instrText" and parent.text:
            def scrub(m: re.Match) -> str:
                to = _scrubbed_target(m[2])
                gone.extend([m[2]] if to != m[2] else [])
                return f'{m[1]}"{to}"'

            parent.text = re.sub(r'((?:HYPERLINK|INCLUDETEXT|INCLUDEPICTURE)\s+)"([^"]*)"', scrub, parent.text)
    return gone


def clean_properties(root: ET.Element) -> None:
    """Blank properties: no names, no times, the first revision."""
    for e in root.iter():
        t = _tag(e)
        if t in BLANKED:
            e[:] = []
            e.text = "0" if t == "TotalTime" else ""
        elif t in ("created", "modified"):
            e.text = "1970-01-01T00:00:00Z"
        elif t == "revision":
            e.text = "1"


def _without_dropped(root: ET.Element, base: str) -> None:
    """Relations and content types without those of dropped parts, external targets scrubbed."""
    for parent in list(root.iter()):
        kept = []
        for c in parent:
            name = (c.get("PartName") or "").lstrip("/") or posixpath.normpath(posixpath.join(base, c.get("Target") or "")).lstrip("/")
            if c.get("TargetMode") == "External":
                c.set("Target", _scrubbed_target(c.get("Target") or ""))
                kept.append(c)
            elif not re.match(DROPPED, name):
                kept.append(c)
        parent[:] = kept


def text_of(content: bytes) -> list[str]:
    """The texts of all blocks of a package, in the order of its members."""
    return [b.text for b in _parts(content)[1]]


def _parts(content: bytes) -> tuple[list[tuple[str, bytes, ET.Element | None]], list[Block], list[str]]:
    """(members that stay, with the parsed root of those that are XML; blocks of the text parts; link targets that went)."""
    kept, blocks, gone = [], [], []
    for name, _, raw in members(content):
        if re.match(DROPPED, name):
            continue
        root = parse_xml(raw) if name.endswith((".xml", ".rels")) else None
        if root is not None and re.match(TEXT_PARTS, name):
            gone += clean_part(root)
            blocks += flatten(root)
        elif name.endswith(".rels"):
            _without_dropped(root, posixpath.dirname(posixpath.dirname(name)))
        elif name == "[Content_Types].xml":
            _without_dropped(root, "")
        elif name.startswith("docProps/"):
            clean_properties(root)
        kept.append((name, raw, root))
    return kept, blocks, gone


def redact_package(content: bytes, edits: list[tuple[int, int, str, str]]) -> tuple[bytes, list[str]]:
    """(the package with (start, end, new, old) edits of the blocks' texts joined by newlines, what still leaks as part: value).

    Substitutes go into the runs; parts that hold no blocks lose the old values, longest first, in plain and in escaped form;
    then every member's bytes are searched for every old value of two characters or more."""
    kept, blocks, _ = _parts(content)
    at, k = 0, 0
    for block in blocks:
        own = []
        while k < len(edits) and edits[k][0] < at + len(block.text):
            own.append((edits[k][0] - at, min(edits[k][1] - at, len(block.text)), edits[k][2]))
            k += 1
        rewrite(block, own)
        at += len(block.text) + 1
    secrets = sorted({old: new for _, _, new, old in edits if len(old) >= 2}.items(), key=lambda x: (-len(x[0]), x[0]))
    out = []
    for name, raw, root in kept:
        if root is not None:
            made = serialise(root, raw.decode("utf-8", "replace"))
            if not re.match(TEXT_PARTS, name):
                for old, new in secrets:
                    for a, b in ((old, new), (escape(old), escape(new))):
                        made = made.replace(a, b)
            raw = made.encode()
        out.append((name, raw))
    return package(out), [f"{name}: {old}" for name, raw in out for old, _ in secrets if _leaks(raw, old)]


def _leaks(raw: bytes, old: str) -> bool:
    """Whether a member holds a value: as UTF-8 or UTF-16LE, as it is, without tags, or with underscores for spaces. A value
    that begins or ends with a digit is not found inside a longer number."""
    rx = re.compile(("(?<![0-9])" if old[0].isdigit() else "") + re.escape(old) + ("(?![0-9])" if old[-1].isdigit() else ""))
    plain = raw.decode("utf-8", "replace")
    texts = [plain, re.sub(r"<[^>]*>", "", plain), plain.replace("_", " ")]
    return any(rx.search(t) or rx.search(t.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")) for t in texts) or old.encode("utf-16-le") in raw


def _appended(df: DataFrame, name: str, kind: str, inputs: list[str], work: Callable) -> DataFrame:
    """df with one more column, work(*inputs) of each row, in Arrow batches; null where an input is null or damaged."""
    made = df.sparkSession.createDataFrame([], f"{name} {kind}").schema
    at, arrow = [df.columns.index(c) for c in inputs], to_arrow_schema(made).field(0).type

    def one(*x):
        try:
            return work(*x) if all(v is not None for v in x) else None
        except (zipfile.BadZipFile, ValueError, zlib.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([one(*x) for x in zip(*(b.column(i).to_pylist() for i in at))], arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, name])

    ship.prepare(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, *made.fields]))


def with_text(packages: DataFrame, content_col: str = "content", text_col: str = "text") -> DataFrame:
    """packages with the text of all blocks, joined by newlines, as ``redact_package`` counts them; null for a damaged one."""
    return _appended(packages, text_col, "string", [content_col], lambda c: "\n".join(text_of(c)))


def redacted_packages(packages: DataFrame, edits_col: str = "edits", content_col: str = "content") -> DataFrame:
    """packages with ``redacted`` (struct of content and leaks, part: value), from the applied edits of their text; null for a
    damaged package. Packages are rewritten where they are: nothing is shuffled."""
    done = F.transform(F.filter(edits_col, lambda x: x["apply"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["r"].alias("r"), x["t"].alias("t")))

    def work(content: bytes, edits: list[dict]) -> dict:
        made, leaks = redact_package(content, [(x["s"], x["e"], x["r"], x["t"]) for x in edits])
        return {"content": made, "leaks": leaks}

    return _appended(packages.withColumn("_done", done), "redacted", "struct<content:binary,leaks:array<string>>", [content_col, "_done"], work).drop("_done")


def rich_package(text: str) -> bytes:
    """A package that holds a text in every kind of place: lines as paragraphs of several runs, then the first line again in a
    text box, a header, a chart, a comment, a deletion and the properties. For drills and tests."""
    lines = text.split("\n")
    plain = lambda s: escape(s, {"\r": "&#13;"})
    first = plain(lines[0])
    run = lambda s: f'<w:r w:rsidR="00AB"><w:t xml:space="preserve">{plain(s)}</w:t></w:r>'
    body = "".join(f"<w:p><w:pPr><w:tabs><w:tab w:val=\"left\"/></w:tabs></w:pPr>{''.join(run(x[i : i + 11]) for i in range(0, len(x), 11))}</w:p>" for x in lines)
    box = f"<w:p><w:r><w:pict><w:txbxContent><w:p>{run(lines[0])}</w:p></w:txbxContent></w:pict></w:r><w:del w:author=\"a\"><w:r><w:delText>{first}</w:delText></w:r></w:del></w:p>"
    doc = f'<w:document xmlns:w="{W}"><w:body>{body}{box}</w:body></w:document>'
    chart = f'<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:cat><c:pt><c:v>{first}</c:v></c:pt></c:cat></c:chartSpace>'
    props = f'<cp:coreProperties xmlns:cp="urn:cp" xmlns:dc="urn:dc"><dc:creator>{first}</dc:creator><cp:revision>9</cp:revision></cp:coreProperties>'
    types = '<Types xmlns="urn:types"><Override PartName="/word/comments.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="x"/></Types>'
    header = f'<w:hdr xmlns:w="{W}"><w:p>{run(lines[0])}</w:p></w:hdr>'
    comments = f'<w:comments xmlns:w="{W}"><w:comment w:author="x"><w:p>{run(lines[0])}</w:p></w:comment></w:comments>'
    parts = [("[Content_Types].xml", types), ("word/document.xml", doc), ("word/header1.xml", header), ("word/charts/chart1.xml", chart), ("word/comments.xml", comments), ("docProps/core.xml", props)]
    return package([(name, xml.encode()) for name, xml in parts])


def rich_packages(texts: DataFrame, text_col: str = "text", content_col: str = "content") -> DataFrame:
    """texts with a rich package of each."""
    return _appended(texts, content_col, "binary", [text_col], rich_package)
