"""The document corpus: sequential upserts as a set-oriented merge, versions, metadata and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import document_bucket

#: Years and citation counts outside these bounds are taken as unknown.
MIN_YEAR, MAX_YEAR = 1000, 2100
MAX_CITATIONS = 1_000_000_000

TEXTS = ["title", "abstract", "body"]
FIELDS = ["pub_year", *TEXTS, "origin", "citation_count"]
SCHEMA = "pmid long, pub_year int, title string, abstract string, body string, origin string, citation_count long"


def effective_year(year: Column | str = "pub_year") -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return F.when(y.between(MIN_YEAR, MAX_YEAR), y).otherwise(F.when(y.isNotNull(), F.lit(MAX_YEAR))).cast("int")


def effective_citations(count: Column | str = "citation_count") -> Column:
    c = F.col(count) if isinstance(count, str) else count
    return F.when(c.between(0, MAX_CITATIONS), c).otherwise(F.lit(0)).cast("long")


def with_metadata(docs: DataFrame) -> DataFrame:
    """Adds year and citations as filters and rankings see them, beside the raw columns."""
    return docs.withColumn("year", effective_year()).withColumn("citations", effective_citations())


def states(current: DataFrame, updates: DataFrame) -> DataFrame:
    """The state of each document after each row that applies, in order of seq.

    current: pmid and FIELDS, one row per document. updates: pmid, FIELDS, seq; NULL means unchanged. A row without any
    text updates the other fields only, and does nothing while there is no document. A row with text that changes neither
    year, texts nor citations is dropped, its origin too. Result: pmid, seq (NULL for the current state), FIELDS,
    is_current, is_version (the row made a new version), last (the final state).
    """
    fields = [F.col(f) for f in FIELDS]
    rows = current.select("pmid", F.lit(None).cast("long").alias("seq"), *fields, F.lit(True).alias("is_current")).unionByName(updates.select("pmid", F.col("seq").cast("long").alias("seq"), *fields, F.lit(False).alias("is_current")))
    order = Window.partitionBy("pmid").orderBy(F.col("is_current").desc(), "seq", *[F.col(f) for f in FIELDS])
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    has_text = F.col("is_current") | F.coalesce(*[F.col(t) for t in TEXTS]).isNotNull()
    rows = rows.withColumn("_text", has_text).withColumn("_exists", F.max("_text").over(upto)).where("_exists")
    empty = {"pub_year": F.lit(None), "citation_count": F.lit(0)} | dict.fromkeys([*TEXTS, "origin"], F.lit(""))
    kept = [f for f in FIELDS if f != "origin"]
    for f in kept:
        rows = rows.withColumn(f"_{f}", F.coalesce(F.last(f, ignorenulls=True).over(upto), empty[f]))
    same = F.lit(True)
    for f in kept:
        same = same & F.col(f"_{f}").eqNullSafe(F.lag(f"_{f}").over(order))
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("_noop", F.col("_text") & ~F.col("is_current") & ~first & same).where("pmid IS NOT NULL")
    rows = rows.withColumn("_origin", F.coalesce(F.last(F.when(~F.col("_noop"), F.col("origin")), ignorenulls=True).over(upto), empty["origin"])).where(~F.col("_noop"))
    rows = rows.withColumn("last", F.row_number().over(Window.partitionBy("pmid").orderBy(F.col("is_current"), F.col("seq").desc(), *[F.col(f).desc() for f in FIELDS])) == 1)
    return rows.select("pmid", "seq", *[F.col(f"_{f}").alias(f) for f in FIELDS], "is_current", (F.col("_text") & ~F.col("is_current")).alias("is_version"), "last")


def version_id() -> Column:
    """A reproducible id of a version."""
    return F.sha2(F.concat_ws("\x1f", "pmid", F.coalesce(F.col("seq").cast("string"), F.lit("")), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS]), 256)


def upsert(current: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, versions): the corpus after the updates, and the versions to append to the history.

    documents also has changed, whether its text has to be indexed again.
    """
    s = states(current, updates)
    touched = s.groupBy("pmid").agg(F.max("is_version").alias("changed"))
    docs = s.where("last").join(touched, "pmid").select("pmid", *FIELDS, "changed")
    versions = s.join(touched.where("changed").select("pmid"), "pmid", "left_semi").where("is_version OR is_current").withColumn("uuid", version_id()).select("uuid", "pmid", "seq", *FIELDS).dropDuplicates(["uuid"])
    return docs, versions


def get_documents(docs: DataFrame, pmids: list[int]) -> DataFrame:
    """The documents of a list of pmids in its order, repeated ones again, missing ones left out."""
    wanted = docs.sparkSession.createDataFrame(list(enumerate(pmids)), "position int, pmid long")
    return docs.join(wanted, "pmid").orderBy("position")


def get_document(docs: DataFrame, pmid: int) -> DataFrame:
    return docs.where(F.col("pmid") == F.lit(pmid))


def origins(docs: DataFrame) -> DataFrame:
    return docs.where("origin <> ''").select("origin").distinct().orderBy("origin")


def count_documents(docs: DataFrame, first: int = MIN_YEAR, last: int = MAX_YEAR) -> DataFrame:
    return in_years(docs, first, last).agg(F.count(F.lit(1)).alias("n_documents"))


def in_years(docs: DataFrame, first: int = MIN_YEAR, last: int = MAX_YEAR) -> DataFrame:
    """The full range keeps all documents without looking at the year."""
    return docs if first <= MIN_YEAR and last >= MAX_YEAR else docs.where(effective_year().between(first, last))


def write_documents(docs: DataFrame, path: str) -> None:
    """Parquet, partitioned by a million pmids, so that lookups by pmid read one folder; ranges of pmids share the work."""
    docs.withColumn("bucket", document_bucket("pmid")).repartitionByRange("pmid").sortWithinPartitions("pmid").write.mode("overwrite").partitionBy("bucket").parquet(path)


def delete_documents(docs: DataFrame, pmids: list[int]) -> DataFrame:
    """The corpus without these documents."""
    gone = docs.sparkSession.createDataFrame([(p,) for p in pmids], "pmid long")
    return docs.join(gone, "pmid", "left_anti")
