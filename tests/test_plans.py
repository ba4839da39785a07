"""Physical plans: what is pushed down, pruned and broadcast."""

import re

import pytest

from corpusloom.operators import skew
from corpusloom.operators.index import build_postings, write_postings
from corpusloom.operators.search import search_postings
from corpusloom.plans import engine, problems

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*problems.QUERIES, "assoc_pairs", "chain_abc", "search_phrase", "upsert_latest", "kg_relationships", "reindex_incremental", "ngram_counts"])
def test_no_product_of_rows(spark, name):
    p = plan((problems.QUERIES | engine.QUERIES)[name](spark, DATA))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_search_reads_the_ngrams_it_needs(spark, tmp_path):
    write_postings(build_postings(engine.docs(spark, DATA)), str(tmp_path / "i"))
    p = plan(search_postings(spark, spark.read.parquet(str(tmp_path / "i")), ["no difference in", "risk"]))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", p)[1]
    assert "In(ngram" in pushed and "ReadSchema: struct<ngram:string,pmid:bigint,pos:int>" in p


def test_only_needed_columns_are_read(spark):
    p = plan(problems.p1_summary(spark, DATA))
    assert "ReadSchema: struct<frag_id:bigint,ngram:string,data:array<struct<pmid:bigint>>>" in p


def test_hot_keys_are_combined_before_their_shuffle(spark):
    df = spark.range(1000).selectExpr("'k' AS k", "id % 7 AS v")
    p = plan(skew.summarize(skew.compress(df, ["k"], "v"), ["k"], "v"))
    assert p.count("partial_count") >= 2 and "partial_sum" in p


def test_top_articles_are_limited_before_their_shuffle(spark):
    from corpusloom.operators.association import Params, top_articles

    meet = spark.range(100).selectExpr("id % 3 AS x_no", "id AS pmid", "2000 AS year", "1L AS citations")
    assert "WindowGroupLimit" in plan(top_articles(meet, ["x_no"], Params(["a"], ["b"])))
