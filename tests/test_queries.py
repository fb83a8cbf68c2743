"""All registered queries against their SQL, and what their plans may not hold."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from adfacts.plans import CHECKS, QUERIES
from adfacts.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    result = con.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    want = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=str)
    assert got == want
    assert got


RULES = ["rx1_compensation", "rx2_pay_frequency", "rx7_salary_facts", "rx8_arrangement", "vf3_clean_seniority",
         "vf8_first_valid", "ch3_final_answers", "ev5_reported_salary", "rx12_seniority_vote"]


@pytest.mark.parametrize("name", RULES)
def test_rules_do_more_than_default(spark, name):
    df = QUERIES[name](spark, SF)
    for column in df.columns[1:]:
        if column not in ("attempt", "y_true"):
            assert df.select(column).distinct().count() > 1, column


def plan_of(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pf6_preview", "sc2_top_k"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["ex10_exact_split", "ex10_hash_split"])
def test_splits_only_project_the_table(spark, name):
    assert "Join" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["rx8_arrangement", "tx4_salary_prompt", "rx7_salary_facts", "ev6_salary_parts"])
def test_projections_do_not_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan_of(spark, name)


def test_scans_read_only_what_is_used(spark):
    plan = plan_of(spark, "rx1_compensation")
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = plan_of(spark, "io7_prompts_only")
    assert "ReadSchema: struct<text:string>" in plan


def test_entry_is_salary_facts(spark):
    assert entry.entry(spark).columns == ["ad_id", "y_true", "y_pred"]


@pytest.mark.parametrize(
    "name, scans, exchanges",
    [("ch2_speaker_audit", 1, 1), ("ch3_final_answers", 1, 1), ("ch4_rounds_used", 1, 1), ("sc1_softmax", 2, 4)],
)
def test_few_passes_over_the_source(spark, name, scans, exchanges):
    plan = plan_of(spark, name)
    assert len(re.findall(r"FileScan parquet.*?/testdata/", plan)) <= scans
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= exchanges


def test_encoding_tokenises_once_per_use(spark):
    plan = plan_of(spark, "ex1_encoded")
    assert "documents.parquet" not in plan  # the tokens and the vocabulary are written tables
    # Only rare tokens of a row become rows.
    assert re.findall(r"Generate (posexplode\(_rare#|\w+)", plan) == ["posexplode(_rare#"]
