"""Readers of record files: XML articles, JSON-lines citation counts, tab-separated edges; incremental file choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The year of an article without any, and how a year looks in free text.
NO_YEAR = 99999
YEAR = r"(?<!\d)(?:1\d\d\d|20\d\d)(?!\d)"

_DATE = "struct<Year:string,MedlineDate:string>"
ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,DateCompleted:struct<Year:string>,"
    f"Article:struct<ArticleTitle:string,Journal:struct<JournalIssue:struct<PubDate:{_DATE}>>,Abstract:struct<AbstractText:array<string>>>>"
)


def inner_text(xml: Column) -> Column:
    """Text of an element that the reader gives with its inner tags; '<' that starts no tag stays."""
    return F.regexp_replace(xml, r"</?[A-Za-z][^<>]*>", "")


def article_year(year: Column, completed: Column, free: Column) -> Column:
    """The publication year, else the completion year, else the first year of the free-text date, else 99999."""
    found = F.nullif(F.regexp_extract(F.coalesce(free, F.lit("")), YEAR, 0), F.lit(""))
    return F.coalesce(F.trim(year).try_cast("int"), F.trim(completed).try_cast("int"), found.cast("int"), F.lit(NO_YEAR))


def read_articles(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents of XML files, gzipped or not: one per article with a pmid, origin being the file's name.

    Title and abstract are all text inside their elements; several abstract parts are joined by a blank; absent ones are
    NULL. Files are read in parallel, a file that cannot be read fails the job after Spark's retries.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("ignoreSurroundingSpaces", False).schema(ARTICLE).load(paths)
    a = raw.select("MedlineCitation.*", F.col("_metadata.file_name").alias("origin"))
    date = F.col("Article.Journal.JournalIssue.PubDate")
    parts = F.transform("Article.Abstract.AbstractText", lambda x: inner_text(F.coalesce(x, F.lit(""))))
    docs = a.select(
        F.trim(F.col("PMID._VALUE")).try_cast("bigint").alias("pmid"),
        article_year(date["Year"], F.col("DateCompleted.Year"), date["MedlineDate"]).alias("pub_year"),
        inner_text(F.col("Article.ArticleTitle")).alias("title"),
        F.array_join(parts, " ").alias("abstract"),
        F.lit(None).cast("string").alias("body"),
        "origin",
        F.lit(None).cast("bigint").alias("citation_count"),
    )
    return docs.where("pmid IS NOT NULL")


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, citation_count) of JSON lines; broken lines are skipped, a missing count is 0."""
    raw = spark.read.schema("pmid bigint, citation_count bigint").option("mode", "DROPMALFORMED").json(path)
    return raw.where("pmid IS NOT NULL").select("pmid", F.coalesce("citation_count", F.lit(0)).cast("bigint").alias("citation_count"))


def read_edges(spark: SparkSession, path: str, source: str, least: int = 2) -> DataFrame:
    """Edges of a tab-separated file (name, type, relation, name, type, pmids) with at least so many pmids.

    The first line of each file is a header. Evidence is a JSON array of numbers, quoted or not; anything else is an
    error, as in a file that is not what it should be.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).option("quote", "\u0000").schema("head string, head_type string, relation string, tail string, tail_type string, evidence string").csv(path)
    pmids = F.from_json(F.regexp_replace("evidence", '"', ""), "array<bigint>", {"mode": "FAILFAST"})
    return raw.withColumn("evidence", pmids).where(F.size("evidence") >= least).withColumn("source", F.lit(source))


def files_to_read(baseline: DataFrame, update: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """(name, kind) of files not done yet, baseline files before updates, each in order of name, at most so many in all.

    baseline, update: name; done: origin. most is what the caller allows one run to read.
    """
    files = baseline.select("name", F.lit("baseline").alias("kind")).unionByName(update.select("name", F.lit("update").alias("kind"))).distinct()
    todo = files.join(done.select(F.col("origin").alias("name")).distinct(), "name", "left_anti")
    return todo.orderBy("kind", "name").limit(most)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.xml.gz") -> DataFrame:
    """(name) of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
