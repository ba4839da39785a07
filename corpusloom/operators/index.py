"""The positional n-gram index as a table of postings (ngram, n, pmid, pos), and its incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import words


def _entries(tokens: str, base: Column) -> Column:
    t = F.col(tokens)
    one = F.transform(t, lambda x, i: F.struct(x.alias("ngram"), F.lit(1).alias("n"), (base + i).cast("int").alias("pos")))
    two = F.when(
        F.size(t) > 1,
        F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)).alias("ngram"), F.lit(2).alias("n"), (base + i).cast("int").alias("pos"))),
    ).otherwise(F.array().cast("array<struct<ngram:string,n:int,pos:int>>"))
    return F.concat(one, two)


def build_postings(docs: DataFrame) -> DataFrame:
    """(ngram, n, pmid, pos): words and pairs of neighbouring words of title and abstract.

    Title words count from 0; those of the abstract start two after the last of them (at 2 without title words), so no
    pair or phrase reaches over. Body and origin are not indexed. NULL and empty texts have no postings. A narrow
    transformation: nothing is shuffled until postings are grouped or joined.
    """
    none = F.array().cast("array<string>")
    t = docs.select("pmid", F.coalesce(words("title"), none).alias("tt"), F.coalesce(words("abstract"), none).alias("ta"))
    base = F.greatest(F.size("tt") - 1, F.lit(0)) + 2
    return t.select("pmid", F.explode(F.concat(_entries("tt", F.lit(0)), _entries("ta", base))).alias("x")).select("x.ngram", "x.n", "pmid", "x.pos")


def unigram_postings(docs: DataFrame) -> DataFrame:
    return build_postings(docs).where("n = 1").select("ngram", "pmid").distinct()


def bigram_positions(docs: DataFrame) -> DataFrame:
    return build_postings(docs).where("n = 2").select("ngram", "pmid", "pos")


def write_postings(postings: DataFrame, path: str) -> None:
    """Parquet in order of n-gram: a search reads the row groups of its n-grams only, whatever their frequency.

    Ranges over (ngram, pmid) split frequent n-grams over many files.
    """
    postings.repartitionByRange("ngram", "pmid").sortWithinPartitions("ngram", "pmid", "pos").write.mode("overwrite").parquet(path)


def version_conflicts(versions: DataFrame, docs: DataFrame) -> DataFrame:
    """Indexed versions (uuid, pmid, title, abstract) that are no longer their document's canonical version."""
    old = versions.where("is_indexed = 1").select("uuid", "pmid", "title", "abstract").distinct()
    now = docs.select("pmid", F.col("uuid").alias("canonical"))
    return old.join(now, "pmid").where("uuid <> canonical").select("uuid", "pmid", "title", "abstract")


def removed_ngrams(old: DataFrame, new: DataFrame) -> DataFrame:
    """(ngram, pmid) that the old texts have and the new ones of the same pmid do not."""
    return build_postings(old).select("ngram", "pmid").distinct().join(build_postings(new).select("ngram", "pmid").distinct(), ["ngram", "pmid"], "left_anti")


def reindex(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some documents changed: their old postings leave, their new ones come.

    changed: pmid, title, abstract of all changed documents. The anti-join on pmid is a broadcast if few changed.
    """
    return postings.join(changed.select("pmid").distinct(), "pmid", "left_anti").select("ngram", "n", "pmid", "pos").unionByName(build_postings(changed))


def defragment(fragments: DataFrame) -> DataFrame:
    """(ngram, pmid, pos) without repeats from fragments in any state, to be written again by write_postings."""
    return fragments.select("ngram", F.explode("data").alias("x")).select("ngram", "x.pmid", F.explode_outer("x.pos").alias("pos")).distinct()
