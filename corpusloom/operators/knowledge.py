"""Knowledge-graph edges with evidence: loading, and undirected lookups with publication-year censoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import sanitized
from corpusloom.operators.corpus import MAX_YEAR, MIN_YEAR, effective_year

#: Fixed value: pmids of an edge that are looked at.
MAX_EVIDENCE = 100


def load_edges(edges: DataFrame) -> DataFrame:
    """Edges with sanitized head and tail and evidence as array<bigint>; every row is kept, repeats too.

    edges: head, head_type, relation, tail, tail_type, evidence (JSON text or array), source.
    """
    if dict(edges.dtypes)["evidence"] == "string":
        edges = edges.withColumn("evidence", F.from_json(F.regexp_replace("evidence", '"', ""), "array<bigint>"))
    return edges.select(sanitized("head").alias("head"), "head_type", "relation", sanitized("tail").alias("tail"), "tail_type", F.coalesce("evidence", F.array().cast("array<bigint>")).alias("evidence"), "source")


def between(edges: DataFrame, pairs: DataFrame, docs: DataFrame | None = None, first: int | None = None, last: int | None = None, cap: int = MAX_EVIDENCE) -> DataFrame:
    """(a, b, a_term, a_type, b_term, b_type, relationship, pmids, source) of the edges between a and b, either way.

    edges as load_edges gives them. An edge keeps its own direction in a_term and b_term. At most cap pmids are looked
    at; with years given, those of other or unknown documents are dropped then, and edges without any left are too.
    NULL names match nothing. Pairs are matched by the two names in order, one equi-join for both directions.
    """
    p = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", sanitized("a").alias("_a"), sanitized("b").alias("_b")).distinct()
    p = p.select("a", "b", F.least("_a", "_b").alias("k1"), F.greatest("_a", "_b").alias("k2"))
    e = edges.where("head IS NOT NULL AND tail IS NOT NULL").select(F.least("head", "tail").alias("k1"), F.greatest("head", "tail").alias("k2"), F.col("head").alias("a_term"), F.col("head_type").alias("a_type"), F.col("tail").alias("b_term"), F.col("tail_type").alias("b_type"), F.col("relation").alias("relationship"), F.slice("evidence", 1, cap).alias("pmids"), "source")
    hit = p.join(e, ["k1", "k2"]).drop("k1", "k2")
    if docs is None or first is None and last is None:
        return hit
    lo, hi = first if first is not None else MIN_YEAR, last if last is not None else MAX_YEAR
    hit = hit.withColumn("_edge", F.xxhash64("a", "b", "a_term", "a_type", "b_term", "b_type", "relationship", F.to_json("pmids"), "source"))
    live = docs.where(effective_year().between(lo, hi)).select("pmid")
    keys = ["a", "b", "a_term", "a_type", "b_term", "b_type", "relationship", "source", "_edge"]
    counted = hit.groupBy(*keys).agg(F.first("pmids").alias("pmids"), F.count(F.lit(1)).alias("_copies"))
    kept = counted.select(*keys, "_copies", F.explode(F.array_distinct("pmids")).alias("pmid")).join(live, "pmid", "left_semi")
    out = kept.groupBy(*keys, "_copies").agg(F.sort_array(F.collect_list("pmid")).alias("pmids"))
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("a", "b", "a_term", "a_type", "b_term", "b_type", "relationship", "pmids", "source")
