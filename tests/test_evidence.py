"""The ladder of evidence on small texts: kinds of evidence, empty input, repeats, long texts."""

from __future__ import annotations

from duskveil.operators import evidence as ev

LEX = ev.Lexicons(speech=["said"], roles=["nurse"], care=["care"], common=["the", "went", "and"], stop=["said"], plural="(?:ers|ions)$", title="^Mr ", public="^National ")
SCHEMA = "doc_id int, block int, text string"


def found(spark, rows, known=None):
    out = ev.body_names(spark.createDataFrame(rows, SCHEMA), ["doc_id"], LEX, known).collect()
    return {(r.doc_id, r.name): (r.n, r.points, r.why) for r in out}


def test_steps(spark):
    got = found(spark, [(1, 0, "Dana said so"), (2, 0, "the nurse Tavor went"), (3, 0, "Omer, said"), (4, 0, "National Bank said"), (5, 0, "Mr Gal said")])
    assert got[1, "Dana"] == (1, 3, "before a verb")
    assert got[2, "Tavor"] == (1, 3, "after a role")
    assert not [k for k in got if k[0] in (3,)]
    assert (4, "National Bank") not in got and (5, "Mr Gal") not in got


def test_weak_evidence_needs_repeats(spark):
    assert not found(spark, [(1, 0, "care Tavor and the")])
    got = found(spark, [(1, 0, "care Tavor and the"), (1, 1, "care Tavor and the")])
    assert got == {(1, "Tavor"): (2, 5, "near care")}


def test_known_names_alone_suggest_nothing(spark):
    assert not found(spark, [(1, 0, "Dana Tavor Dana")], ["Dana"])


def test_surname_in_full(spark):
    got = found(spark, [(1, 0, "Tavor said"), (1, 1, "the Noah Tavor and")])
    assert set(got) == {(1, "Noah Tavor")}


def test_empty(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 0, None), (1, 1, ""), (2, 0, " .,")]) == {}


def test_long_text(spark):
    got = found(spark, [(1, 0, "the and went " * 20_000 + "Dana said")])
    assert got == {(1, "Dana"): (1, 3, "before a verb")}


def test_predictions(spark):
    texts = spark.createDataFrame([(1, "met Mr Dana Tavor today. Dana left"), (2, None)], "doc_id int, text string")
    ents = [(1, 4, 17, "PER", 0.9), (1, 25, 29, "PER", 0.8), (1, 7, 10, "PER", 0.2), (1, 0, 3, "XYZ", 0.9), (2, 0, 3, "PER", 0.9), (1, 7, 7, "PER", 0.9)]
    ents = spark.createDataFrame(ents, "doc_id int, s int, e int, type string, score double")
    got = ev.clean_predictions(ents, texts, LEX).collect()
    assert [(r.doc_id, r.value, r.kind, r.n, r.score) for r in got] == [(1, "Dana Tavor", "NAME", 1, 0.9)]
    assert ev.clean_predictions(ents.limit(0), texts, LEX).collect() == []
