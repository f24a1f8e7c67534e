"""Packages redacted in their runs: no secret is left in any member, in either encoding, and what is not secret stays."""

from __future__ import annotations

import re

import pytest

from duskveil.operators import chain
from duskveil.sources import docx

TEXT = "Dana Levi wrote to dana@x.org\nsecond dana@x.org & <b> 4111 1111 1111 1111\n\nlast dana@x.org.uk"
FAKES = {"dana@x.org": "[EMAIL 1]", "4111 1111 1111 1111": "[CARD 1]", "Dana Levi": "A longer name than before", "wrote": ""}


def edits(text):
    return sorted((m.start(), m.end(), FAKES[m[0]], m[0]) for m in re.finditer("|".join(map(re.escape, FAKES)), text))


def test_no_secret_in_any_member():
    content = docx.rich_package(TEXT)
    text = "\n".join(docx.text_of(content))
    assert text.startswith(TEXT) and text.count("Dana Levi") == 4  # body, box, header, chart; not the comment, the deletion or the properties
    out, leaks = docx.redact_package(content, edits(text))
    assert leaks == [] and "\n".join(docx.text_of(out)) == re.sub("|".join(map(re.escape, FAKES)), lambda m: FAKES[m[0]], text)
    names = [n for n, _, _ in docx.members(out)]
    assert "word/comments.xml" not in names and "docProps/core.xml" in names
    for _, _, raw in docx.members(out):
        for secret in FAKES:
            assert secret.encode() not in raw and secret.encode("utf-16-le") not in raw and secret not in re.sub("<[^>]*>", "", raw.decode())
        assert b"rsid" not in raw and b"comments.xml" not in raw


def test_leaks_are_told():
    parts = [(n, raw) for n, _, raw in docx.members(docx.rich_package(TEXT))] + [("word/media/a.bin", "xx dana@x.org".encode("utf-16-le")), ("note.txt", b"Dana_Levi and 24111 1111 1111 1111")]
    text = "\n".join(docx.text_of(docx.package(parts)))
    _, leaks = docx.redact_package(docx.package(parts), edits(text))
    assert sorted(leaks) == ["note.txt: Dana Levi", "word/media/a.bin: dana@x.org"]  # not the card inside a longer number


def test_damaged_and_null_packages(spark):
    rows = [(1, bytearray(docx.rich_package("a dana@x.org")), 7), (2, bytearray(b"no package"), 7), (3, None, 7)]
    made = docx.with_text(spark.createDataFrame(rows, "id int, content binary, leaks int"))
    made = made.selectExpr("*", "array(named_struct('s', 2, 'e', 12, 'r', 'X', 't', 'dana@x.org', 'apply', true)) AS edits")
    got = {r.id: r for r in docx.redacted_packages(made).collect()}
    assert docx.text_of(bytes(got[1].redacted.content))[0] == "a X"  # one of four was edited; the others are told
    assert sorted(got[1].redacted.leaks) == ["word/charts/chart1.xml: dana@x.org", "word/document.xml: dana@x.org", "word/header1.xml: dana@x.org"]
    assert got[2].text is None and got[2].redacted is None and got[3].redacted is None and got[1].leaks == 7


@pytest.mark.parametrize("name,want", [("off", "לרון גיל"), ("safe", "לגיל גיל")])
def test_prefixes_of_rules(spark, name, want):
    df = spark.createDataFrame([("לרון רון",), (None,)], "text string")
    got = chain.redact(df, [chain.Rule("רון", replacement="גיל")], [], chain.Options(prefixes=name, on=(), detectors=())).collect()
    assert got[0].redacted == want and got[1].redacted is None and got[1].leaks == []
