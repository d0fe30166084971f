"""Registered queries against their SQL, and the shape of the main plans."""

import sys

import pytest

import __spark_entry__ as entry
from textweir import scan
from textweir.operators import corpus
from textweir.plans.policies import HOUSE, SHADOW, TOPICS_ONLY

sys.path.insert(0, "tools")
from check import TABLES, rows_of  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_scan_is_one_narrow_stage(docs):
    text = plan(scan(docs.select("doc_id", "text"), HOUSE), "executedPlan")
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_do_not_copy_the_patterns(docs):
    out = scan(docs, HOUSE).filter("valid and action = 'redacted' and lang = 'en'").select("doc_id", "sanitized_text")
    text = plan(out)
    # once for the text and once, in the same projection, for its flag
    assert text.count("<EMAIL_REDACTED>") == 2 and text.count("<SSN_REDACTED>") == 2
    # a filter on an input column goes down to the file
    assert "EqualTo(lang,en)" in plan(out, "executedPlan")


def test_sentence_sanitizing_has_no_shuffle(docs):
    out = corpus.sanitize_by_sentence(docs.select("doc_id", "text"), TOPICS_ONLY)
    assert "Exchange" not in plan(out, "executedPlan")
    # nor does a filter on its result copy the work: one matching step, with or without
    assert plan(out).count("license") == plan(out.filter("n_blocked > 0")).count("license") > 0


def test_policies_that_redact_alike_share_the_text(docs):
    text = plan(corpus.multi_policy_scan(docs.select("doc_id", "text"), [HOUSE, SHADOW, TOPICS_ONLY]))
    assert text.count("<EMAIL_REDACTED>") == 2 and text.count("Relation") == 1


def test_latest_rows_are_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["audit_latest"](spark, sf_dir), "executedPlan")
