"""Frequency of every distinct value or term: recursive radix spilling, each partition aggregated out of core by DuckDB.

Map tasks combine what they can and the rows (field, term, record, occurrences, records) are partitioned by hash bits of
the term to the shared disk. All partitions above a size limit are read again in one job and split by further bits, as
many as their measured size asks for: bits of the term or, where a single term makes up most of a partition, bits of the
record, since a term's rows cannot be separated by bits of the term. Each leaf is then aggregated by DuckDB with a memory
limit and a spill folder; leaves of one term add up.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import file_system, scratch

#: Parquet bytes of a partition that is aggregated as it is; leaves in all, beyond which they are larger; most bits of a split; distinct terms a map task holds.
LEAF_BYTES = 64 << 20
MOST_LEAVES = 50_000
MAX_BITS = 10
TERMS_HELD = 500_000
MEMORY_LIMIT = "300MB"
SPILL_SCHEMA = "field_name string, term string, record long, occurrences long, records long"
COUNTS = "field_name string, term string, occurrences long, records long"


def count_words(docs: DataFrame, text: str, field_name: str) -> DataFrame:
    """Additive partial counts (record NULL) of the words of a text column, each row of docs being one record.

    Words are the longest runs of letters or digits of the lower-cased text. Tasks combine what they hold and hand it on
    whenever it reaches TERMS_HELD terms. NULL and empty texts give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(r"[^\W_]+").findall
        seen, held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            terms = list(seen)
            n = len(terms)
            return pa.RecordBatch.from_arrays(
                [pa.array([field_name] * n), pa.array(terms, pa.string()), pa.nulls(n, pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array([held[t] for t in terms], pa.int64())],
                ["field_name", "term", "record", "occurrences", "records"],
            )

        for b in batches:
            for t in b[0].to_pylist():
                if t:
                    found = find(t.lower())
                    seen.update(found)
                    held.update(set(found))
            if len(seen) > TERMS_HELD:
                yield out()
                seen.clear()
                held.clear()
        if seen:
            yield out()

    return docs.select(text).mapInArrow(run, SPILL_SCHEMA)


def _digit(level: int, bits: int, by_record: Column) -> Column:
    """A digit of `bits` bits, by hashes that differ from level to level: of the term, or of the record where by_record holds.

    Rows without a record are additive, so any digit of theirs will do.
    """
    record = F.when(F.col("record").isNotNull(), F.xxhash64("record", F.lit(-1 - level))).otherwise(F.xxhash64("occurrences", "records", F.lit(-1 - level)))
    h = F.when(by_record, record).otherwise(F.xxhash64("field_name", "term", F.lit(level)))
    return F.pmod(h, F.lit(1 << bits)).cast("int")


def _spill(rows: DataFrame, level: int, bits: int, by_record: Column) -> dict[str, tuple[str, int]]:
    """Writes rows (and their part, the digits so far) by a further digit; the folder and size of each new part.

    A part is written by as many tasks as the session's partitions allow, so neither few parts nor a hot term's leave tasks
    without work.
    """
    spark = rows.sparkSession
    folder = scratch(spark, f"radix-{level}")
    n = max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("record", "term", "occurrences", "records"), F.lit(max(1, n >> bits)))
    rows.withColumn("part", F.concat("part", F.lpad(F.hex(_digit(level, bits, by_record)), 3, "0"))).repartition(n, "part", spread).write.partitionBy("part").parquet(folder)
    fs, p = file_system(spark, folder)
    parts = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part=")]
    return {q.getName()[5:]: (q.toString(), fs.getContentSummary(q).getLength()) for q in parts}


_SUM = (
    "SELECT field_name, term, CAST(sum(o) AS BIGINT) AS occurrences, CAST(sum(r) AS BIGINT) AS records FROM ("
    "SELECT field_name, term, sum(occurrences) AS o, CASE WHEN record IS NULL THEN sum(records) ELSE max(records) END AS r FROM leaf GROUP BY field_name, term, record"
    ") GROUP BY field_name, term"
)


def _duckdb(spill: str | None):
    """A connection with a memory limit that spills below the given folder, else below the task's Spark folder; and that folder."""
    import duckdb

    folder = f"{spill or SparkFiles.getRootDirectory()}/duckdb-{os.getpid()}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return duckdb.connect(f"{folder}/leaf.db", config={"threads": 1, "memory_limit": MEMORY_LIMIT, "temp_directory": folder}), folder


def _aggregate_files(spill: str):
    """Leaves on a mounted folder, by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        for b in batches:
            for path in b["path"].to_pylist():
                con, folder = _duckdb(spill)
                con.register("leaf", ds.dataset(_local(path), format="parquet"))
                yield from con.sql(_SUM).to_arrow_reader(20_000)
                con.close()
                shutil.rmtree(folder)

    return run


def _aggregate_rows(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A leaf whose rows Spark reads; they stream into DuckDB's own file."""
    con, folder = _duckdb(None)
    con.sql("CREATE TABLE leaf (field_name VARCHAR, term VARCHAR, record BIGINT, occurrences BIGINT, records BIGINT)")
    for b in batches:
        con.register("batch", pa.Table.from_batches([b]))
        con.sql("INSERT INTO leaf SELECT field_name, term, record, occurrences, records FROM batch")
        con.unregister("batch")
    yield from con.sql(_SUM).to_arrow_reader(20_000)
    con.close()
    shutil.rmtree(folder)


def _local(path: str) -> str | None:
    """The path as the executors' operating system knows it, if the shared folder is mounted there; None for object stores and others."""
    return re.sub(r"^(file:)?/+", "/", path) if re.match(r"(file:)?/", path) else None


def _aggregate(spark: SparkSession, leaves: list[str]) -> DataFrame:
    spill = _local(scratch(spark, "duckdb"))
    if spill is not None:
        tasks = spark.createDataFrame(list(enumerate(leaves)), "id int, path string").repartitionByRange(len(leaves), "id").select("path")
        return tasks.mapInArrow(_aggregate_files(spill), COUNTS)
    rows = spark.read.schema(SPILL_SCHEMA).parquet(*leaves).withColumn("leaf", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1))
    return rows.groupBy("leaf").applyInArrow(_aggregate_rows, COUNTS)


def term_frequencies(rows: DataFrame, leaf_bytes: int = LEAF_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """(field_name, term, occurrences, records) from rows (field_name, term, record, occurrences, records).

    Rows with a record say that the record holds the term (records = 1; the same record counts once however many rows it
    has); rows without one are additive counts. NULL terms count nowhere, an empty term is a term as any other. An empty
    table gives no rows. Columns besides these five are not read. leaf_bytes and max_bits change the cost only: parts above
    leaf_bytes (more, if there would be over MOST_LEAVES) are split again, by max_bits bits at most.
    """
    spark = rows.sparkSession
    if leaf_bytes < 1 or not 1 <= max_bits <= 12:
        raise ValueError("leaf_bytes must be positive and max_bits from 1 to 12")
    bits = min(max_bits, max(4, int(log2(int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    parts = _spill(rows.select("field_name", "term", "record", "occurrences", "records").where(F.col("term").isNotNull()).withColumn("part", F.lit("")), 0, bits, F.lit(False))
    most = max(leaf_bytes, sum(n for _, n in parts.values()) // MOST_LEAVES)
    leaves, level, divided, before, by_record = [], 0, set(), {}, set()
    while parts:
        large, hot = {}, set()
        for d, (path, n) in parts.items():
            parent = before.get(d[:-3])
            if n > most and not (d[:-3] in by_record and n > 0.9 * parent):  # else a part of one term that is hardly smaller consists of equal rows
                large[d] = (path, n)
                if parent and n > 0.5 * parent and d[:-3] not in by_record:
                    hot.add(d)
            else:
                leaves.append(path)
        if not large:
            break
        level, by_record = level + 1, hot
        divided |= {d for d in hot}
        bits = min(max_bits, max(1, ceil(log2(1.5 * max(n for _, n in large.values()) / most))))
        before = {d: n for d, (_, n) in large.items()}
        paths = [x[0] for x in large.values()]
        again = spark.read.schema(SPILL_SCHEMA + ", part string").option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths)
        parts = _spill(again, level, bits, F.col("part").isin(list(hot)) if hot else F.lit(False))
    if not leaves:
        return spark.createDataFrame([], COUNTS)
    counts = _aggregate(spark, leaves)
    return counts.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")) if divided else counts


def marked(counts: DataFrame, rare: dict[str, int], common: dict[str, int]) -> DataFrame:
    """counts with mark: 'rare' for at most rare[field] records, 'common' for at least common[field], else NULL.

    A term that is both is rare.
    """
    few, many = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("field_name")] for d in (rare, common))
    return counts.withColumn("mark", F.when(F.col("records") <= few, F.lit("rare")).when(F.col("records") >= many, F.lit("common")))
