"""What a reviewer found on larger tables: each case in a few rows."""

from __future__ import annotations

import duckdb

from duskveil.llm import linkage
from duskveil.operators import chain, detect
from duskveil.plans import registry


def equals_sql(spark, tmp_path, name, rows):
    """A query over documents(doc_id, text) of these rows, next to its SQL."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    made = sorted(map(str, map(tuple, df.collect())))
    assert made == sorted(map(str, want))
    return made


#: A card that passes its check digit only without the digits of the address after it.
CARD = "4451718024887799 27.65.93.188 and +1 (863) 555-9426"


def test_failed_card_hides_no_address(spark, tmp_path):
    """digits that fail as a card number are for review and hide no valid address that they overlap."""
    made = equals_sql(spark, tmp_path, "chain_tables", [(1, CARD), (2, ""), (3, None), (4, "4111 1111 1111 1112")])
    assert made[0] == "(1, 2, 0)"
    opt = chain.Options(on=tuple(d.type for d in detect.NEUTRAL), detectors=tuple(detect.NEUTRAL), mode="block", prefixes="off")
    rows = chain.redact(spark.createDataFrame([(CARD,), ("see 4111 1111 1111 1112",)], "text string"), [], [], opt).collect()
    assert "27.65.93.188" not in rows[0].redacted
    assert [(x.t, x.apply) for x in rows[1].edits] == [("4111 1111 1111 1112", False)]  # still shown for review


def test_venues_stay_in_their_line(spark, tmp_path):
    """a head at a line's end, or two spaces before a capital, make no name."""
    made = equals_sql(spark, tmp_path, "G3_venues", [(1, "so the\nOuwhea of  This the Tavor The and Levi"), (2, ""), (3, None)])
    assert made == ["(1, 'body', 'Levi', 1)", "(1, 'school', 'Tavor', 1)"]


def test_only_split_runs_are_joined(spark):
    """op3: of rows that share a key only those in a partition's first or last run meet the table of edges."""
    rows = [(k, i) for k in range(40) for i in range(30 if k % 2 else 1)] + [(99, i) for i in range(3000)]
    made = linkage.blocks_of(spark.createDataFrame(rows, "key long, id long").repartition(4), 512)
    assert "LeftOuter" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.toPandas()
    assert len(got) == 20 * 30 + 3000 and not got.duplicated(["key", "id"]).any()
    assert sorted(got[got.key == 99].groupby("block").size()) == [440, 512, 512, 512, 512, 512] and set(got[got.key == 99]["last"]) == {5}
    assert set(got[got.key != 99].block) == {0} and linkage.blocks_of(spark.createDataFrame([], "key long, id long"), 512).count() == 0


def test_ladder_shuffles_texts_once(spark, tmp_path):
    """only the texts are shuffled, whatever their words; rows without an id, and repeated ids, are as in the SQL."""
    rows = [(1, "from Tavor on\nthat Noah Tavor is\nTavor is"), (2, "the hTavor was by\nTavor that, is"), (2, "this Tavor was"), (None, "this Tavor was"), (3, None), (4, "")]
    made = equals_sql(spark, tmp_path, "G8_body_names", rows)
    assert any("Tavor" in r for r in made) and not any(r.startswith("(None") for r in made)
    plan = registry.queries()["G8_body_names"](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    full = registry.queries()["G8_body_names"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert full.split("Initial Plan")[-1].count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan


def test_packages_keep_carriage_returns(spark, tmp_path):
    """a carriage return in a text is a character of its run, before and after the redaction."""
    equals_sql(spark, tmp_path, "S_redact_package", [(1, "one\r\ntwo dana@x.org\r"), (2, "\r"), (3, None), (4, " & <b>\tdana@x.org\rdana@x.org")])
