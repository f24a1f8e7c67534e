from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from duskveil.llm import licenses, merkle, registry

SF = "/root/testdata/sf0.001"


def test_licenses(spark, docs):
    mit = "Released under the MIT License."
    files = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "code only"), (3, "a/b/y.py", "print()\n" + mit + "\nmore code\n" + "z " * 4000), (4, "a/b/LICENSE", mit), (5, "q/w.txt", "nothing"), (6, "a/top.py", None),
        (7, None, ""), (8, "LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), (2, "a/b/c/x.py", "code only"), (9, "a/LICENSE", "all rights licensed to nobody at all ever"),
    ]
    got = {(r.id, r.licence, r.via) for r in licenses.scan(spark.createDataFrame([(*f, "dup") for f in files], "id long, path string, text string, own string")).collect()}
    assert got == {(1, "Apache-2.0", "file"), (2, "MIT", "a/b"), (3, "MIT", "header"), (4, "MIT", "file"), (5, "GPL-3.0", ""), (6, "Apache-2.0", "a"), (7, "GPL-3.0", ""), (8, "GPL-3.0", "file"), (9, "Apache-2.0", "a")}
    none = spark.createDataFrame([], "id long, path string, text string")
    assert licenses.scan(none).count() == 0


def test_planted_license_lines_are_found(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT"}
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.license_scan(spark, SF).collect():
        want = [n for line, n in lines.items() if line in text[r.doc_id].split("\n")]
        assert r.own in want if want else r.own is None


def test_licences_against_brute_force(spark):
    """Every stretch of every document scored without the bound; and what every file inherits, walking up."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    df, n = licenses.document_frequencies(docs)
    m = licenses.Matcher(df, n)
    want = {}
    for r in docs.collect():
        text = (r.text or "").encode()
        terms, lines = [], []
        for line in text.split(b"\n"):
            lines.append(len(terms))
            terms += licenses.terms_of(line)
        spans = m.stretches(len(terms), np.array(lines)) if terms else []
        best = max(((m.best(terms[s:e])) for s, e in spans), default=(0.0, None), key=lambda x: x[0])
        whole = r.id % 16 == 0
        if whole and terms:
            best = max(best, m.best(terms), key=lambda x: x[0])
        want[r.id] = (best[1], round(best[0], 9)) if best[0] >= licenses.LEAST else (None, 0.0)
    got = registry.license_scan(spark, SF).collect()
    assert {r.doc_id: (r.own, round(r.cosine, 9)) for r in got} == want and len(got) == len(want)
    given = {}
    for r in sorted(got, key=lambda r: (r.cosine, -r.doc_id)):
        if r.path.endswith("LICENSE") and r.own:
            given[r.path.rsplit("/", 1)[0]] = r.own
    for r in got:
        up = r.path
        found = (r.own, "file" if r.path.endswith("LICENSE") else "header") if r.own else (None, None)
        while found[0] is None and "/" in up:
            up = up.rsplit("/", 1)[0]
            found = (given[up], up) if up in given else found
        assert (r.licence, r.via) == found


def test_real_texts(spark):
    m = licenses.Matcher({t: 50 for t in licenses.VOCABULARY}, 1000)
    name = lambda text, whole=False: m.licence(text.encode(), whole)[0]
    full = {n: max(t, key=len) for n, t in licenses.TEMPLATES.items()}
    for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "Apache-2.0"):
        wrapped = "Copyright (c) 2024 Some One\n\n" + re.sub(r"(.{60}\S*) ", r"\1\n", full[n])
        assert name(wrapped) == n and name(wrapped.replace("\n", " "), True) == n
        assert name("word " * 50_000 + wrapped) == n  # over several stretches
    assert name("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.") == "GPL-2.0"
    assert name("This is free. It is under the GNU General Public License, version 2.") == "GPL-2.0" and name("under the GNU General Public License version 3 since then") == "GPL-3.0"
    assert name("... and more prose here about it. Released under the MIT License. More prose follows here, quite some of it, in one line.") == "MIT"
    assert name("Mozilla Public License Version 2.0") == "MPL-2.0" and name("A plain text on permission and rights of persons.") is None and name("") is None


def test_audit_finds_what_differs(spark):
    F = merkle.F
    rows = [(i, f"http://x/{i}", f"record {i}" * (i % 5 + 1)) for i in range(3000)] + [(None, None, None), (-7, "u", ""), (5, "http://x/5", "record 5"), (9, "long", "w " * 900_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, url string, html string, start int, digest string").repartition(5)
    pages = df.select("id", "start", "digest", merkle.warc_record(F.col("url"), F.col("html")).alias("record"))
    blocks = merkle.archived(pages, "id", per_segment=512).cache()
    left = merkle.manifest(blocks).cache()
    want, at, last = {}, 0, None  # by brute force
    ordered = sorted(((-1 if r.id is None else r.id), hashlib.sha256(r.record).hexdigest(), len(r.record)) for r in pages.collect())
    for i, digest, n in ordered:
        at = 0 if i // 512 != last else at
        last = i // 512
        want[(last, at)] = (n, digest)
        at += n
    assert {(r.segment, r.start): (r.bytes, r.digest) for r in left.collect()} == want
    bad = {k: v for k, v in want.items() if v[1][:2] in ("0a", "0b")}
    got = {(r.segment, r.start): (r.bytes, r.digest, r.kind) for r in merkle.audit(left, merkle.manifest(merkle.with_faults(blocks, "0a", "0b"))).collect()}
    assert got == {k: (*v, "altered" if v[1][:2] == "0a" else "missing") for k, v in bad.items()} and bad
    assert merkle.audit(left, left).count() == 0 and merkle.audit(left.limit(0), left.limit(0)).count() == 0
    assert {r.kind for r in merkle.audit(left, left.limit(0)).collect()} == {"missing"} and merkle.audit(left.limit(0), left).count() == len(rows)


def test_audit_pairs_records_of_one_offset(spark):
    make = lambda rows: spark.createDataFrame(rows, "segment long, start long, bytes long, digest string")
    audit = lambda a, b: sorted((r.segment, r.start, r.kind, r.digest, r.found) for r in merkle.audit(make(a), make(b)).collect())
    assert audit([(1, 5, 3, "x"), (1, 5, 3, "x")], [(1, 5, 3, "x")]) == [(1, 5, "missing", "x", None)]
    assert audit([(1, 5, 3, "a"), (1, 5, 3, "b")], [(1, 5, 3, "c"), (1, 5, 3, "d")]) == [(1, 5, "altered", "a", "c"), (1, 5, "altered", "b", "d")]
    assert audit([(1, 5, 3, "a"), (1, 5, 3, "k")], [(1, 5, 3, "k"), (1, 5, 3, "k"), (None, None, 0, "n")]) == [(0, 0, "extra", None, "n"), (1, 5, "altered", "a", "k")]
    far = [(s, o, 1, f"{s}:{o}") for s in (-300, 0, 5, 70_000) for o in (0, 1 << 30, 1 << 41)]
    assert audit(far, far[:-1]) == [(70_000, 1 << 41, "missing", f"70000:{1 << 41}", None)]


def test_unreadable_bytes_are_records():
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(merkle.spans(one + one)) == [(0, len(one)), (len(one), 2 * len(one))]
    assert list(merkle.spans(bytes(4) + one)) == [(4, 4 + len(one))]
    assert list(merkle.spans(b"junk" + one)) == [(0, 4), (4, 4 + len(one))]
    assert list(merkle.spans(b"WARC/1.1\r\nno length\r\n\r\n" + one))[1][1] - len(one) == 23


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs, names: sorted(str([r[names.index(c)] for c in cols]) for r in rs)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), list(want.columns))


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    ids = [r.doc_id for r in got]
    assert len(got) > 0.7 * len(text) and len(toxic & set(ids)) < 0.3 * len(toxic)
    assert len({text[i] for i in set(ids)}) == len(set(ids))  # no copies of one text under two ids


def test_stages_take_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([(0, 1, 0), (8, 0, 0), (5, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert name == "tokens" or now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert now.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0), str(tmp_path)).count() == 0
