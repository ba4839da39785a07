"""Evaluating many terms at once: phrases by relational division over postings, boolean terms by flags per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import terms as T
from corpusloom.operators.corpus import MAX_YEAR, MIN_YEAR, in_years
from corpusloom.operators.index import build_postings

#: So many ranges of n-grams are pushed down to the postings' files as a filter; with fewer n-grams each is a range of its own.
RANGES = 200


def _within(grams: list[str]) -> Column:
    """A filter on ranges that hold the sorted n-grams, in a form that prunes the row groups of sorted files."""
    step = -(-len(grams) // RANGES)
    ranges = [(grams[i], grams[min(i + step, len(grams)) - 1]) for i in range(0, len(grams), step)]
    return reduce(lambda x, y: x | y, [F.col("ngram") == lo if lo == hi else F.col("ngram").between(lo, hi) for lo, hi in ranges])


def _condition(tree: tuple, flags: Column) -> Column:
    if tree[0] == "sub":
        return F.array_contains(flags, tree[1])
    parts = [_condition(t, flags) for t in tree[1:]]
    return reduce((lambda a, b: a & b) if tree[0] == "and" else (lambda a, b: a | b), parts)


def search_postings(spark: SparkSession, postings: DataFrame, terms: list[str]) -> DataFrame:
    """(term_no, pmid), distinct: the documents of each term of the list, by its place in it.

    Subterms of one or two words are looked up as they are. Longer ones are divided: their pairs of words must occur at
    consecutive places, that is all at the same place minus their offset. All terms together take one scan of the
    postings of their n-grams, one grouping by (subterm, pmid, place) and, for terms with operators, one by (term, pmid).
    """
    queries = [T.parse(t) for t in terms]
    phrases = list(dict.fromkeys(s for q in queries if q.tree for s in q.subterms if len(s.split(" ")) <= T.MAX_WORDS))
    number = {p: i for i, p in enumerate(phrases)}
    needed = []
    for p, i in number.items():
        w = p.split(" ")
        grams = [p] if len(w) <= 2 else [f"{a} {b}" for a, b in zip(w, w[1:])]
        needed += [(g, i, k, 1 << k, (1 << len(grams)) - 1) for k, g in enumerate(grams)]
    uses = [(number[s], k, j) for j, q in enumerate(queries) if q.tree for k, s in enumerate(q.subterms) if s in number]
    if not needed:
        return spark.createDataFrame([], "term_no int, pmid long")
    grams = sorted({g for g, *_ in needed})
    wanted = spark.createDataFrame(needed, "ngram string, phrase int, k int, bit int, full int")  # the query's own words; broadcast if their size is small
    hit = postings.where(_within(grams))
    places = hit.join(wanted, "ngram").select("phrase", "full", "pmid", "bit", F.when(F.col("full") == 1, F.lit(0)).otherwise(F.col("pos") - F.col("k")).alias("start"))
    found = places.groupBy("phrase", "full", "pmid", "start").agg(F.bit_or("bit").alias("seen"))
    found = found.where("seen = full").select("phrase", "pmid").distinct()
    member = found.join(spark.createDataFrame(uses, "phrase int, k int, term_no int"), "phrase")
    plain = [j for j, q in enumerate(queries) if q.tree and q.tree[0] == "sub"]
    out = member.where(F.col("term_no").isin(plain)).select("term_no", "pmid")
    composite = [(j, q.tree) for j, q in enumerate(queries) if q.tree and q.tree[0] != "sub"]
    if composite:
        flags = member.where(F.col("term_no").isin([j for j, _ in composite])).groupBy("term_no", "pmid").agg(F.collect_set("k").alias("flags"))
        rule = reduce(lambda c, x: c.when(F.col("term_no") == x[0], _condition(x[1], F.col("flags"))), composite, F.when(F.lit(False), F.lit(False)))
        out = out.unionByName(flags.where(rule).select("term_no", "pmid"))
    return out


def search(docs: DataFrame, terms: list[str], first: int = MIN_YEAR, last: int = MAX_YEAR, postings: DataFrame | None = None) -> DataFrame:
    """search_postings over the documents of a range of years.

    With a written index the years are a semi-join; without one the postings of just these documents are made on the fly.
    """
    spark = docs.sparkSession
    some = in_years(docs, first, last)
    if postings is None:
        return search_postings(spark, build_postings(some), terms)
    found = search_postings(spark, postings, terms)
    return found if some is docs else found.join(some.select("pmid"), "pmid", "left_semi").select("term_no", "pmid")
