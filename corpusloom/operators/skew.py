"""Per-key results where a few keys hold most records: value-frequency compression.

Grouping by (key, value) first turns every repeat of a value into one row with a weight. That grouping combines before
its shuffle and spreads a hot key over its values; all that follows works on weighted values and is either algebraic
(again combined before the shuffle) or bounded per key, so no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Histogram cells of a key that are looked at together are at most 2 ** RADIX_BITS.
RADIX_BITS = 12


def compress(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, weight): the number of rows, or the sum of the weight column, of each value of each key.

    NULL keys and NULL values are groups of their own. A NULL weight counts 0. An empty input gives no rows.
    """
    total = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return df.groupBy(*keys, value).agg(total.cast("long").alias("weight"))


def summarize(compressed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, n_distinct, mode, mode_count) from weighted values.

    n counts all rows, those with a NULL value too; n_distinct and mode ignore NULL values. Of several most frequent
    values the smallest is the mode; a key with NULL values only has a NULL mode and mode_count 0.
    """
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))))
    return (
        compressed.groupBy(*keys)
        .agg(F.sum("weight").alias("n"), F.count(value).alias("n_distinct"), best.alias("best"))
        .select(*keys, "n", "n_distinct", F.col("best.v").alias("mode"), F.coalesce(-F.col("best.w"), F.lit(0)).alias("mode_count"))
    )


def percentiles(compressed: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, prob, percentile): exact nearest-rank percentiles of an integer value, NULL values ignored.

    The value of rank ceil(prob * n), the smallest for prob 0. Radix selection: a histogram over the leading bits of a
    key's values finds the cell that holds the rank, then only the rows of that cell are looked at with the next bits.
    The cells of a key that meet in one task are at most 2 ** RADIX_BITS whatever the number of its rows.
    """
    spark = compressed.sparkSession
    rows = compressed.where(F.col(value).isNotNull() & (F.col("weight") > 0))
    low, high = rows.agg(F.min(value), F.max(value)).first()
    schema = ", ".join([*(f"`{k}` {compressed.schema[k].dataType.simpleString()}" for k in keys), "prob double", "percentile long"])
    if low is None:
        return spark.createDataFrame([], schema)
    bits = max(1, int(high - low).bit_length())
    rows = rows.withColumn("_u", (F.col(value) - F.lit(low)).cast("long"))
    left = max(0, bits - RADIX_BITS)
    null_safe = [F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]  # NULL keys join as any other
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*null_safe, "_u", "weight")

    def pick(cells: DataFrame, by: list[str], rank) -> DataFrame:
        over = Window.partitionBy(*by).orderBy("_cell")
        return cells.withColumn("_cum", F.sum("_w").over(over)).withColumn("_rank", rank).where((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_w")))

    cells = rows.groupBy(*ks, F.shiftright("_u", left).alias("_cell")).agg(F.sum("weight").alias("_w"))
    cells = cells.withColumn("_n", F.sum("_w").over(Window.partitionBy(*ks))).withColumn("_prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    found = pick(cells, [*ks, "_prob"], F.greatest(F.lit(1), F.ceil(F.col("_prob") * F.col("_n"))))
    while left:
        step = min(RADIX_BITS, left)
        wanted = found.select(*ks, "_prob", F.col("_cell").alias("_at"), (F.col("_rank") - (F.col("_cum") - F.col("_w"))).alias("_rest"))
        inner = rows.withColumn("_at", F.shiftright("_u", left)).join(wanted, [*ks, "_at"])
        left -= step
        cells = inner.groupBy(*ks, "_prob", "_rest", F.shiftright("_u", left).alias("_cell")).agg(F.sum("weight").alias("_w"))
        found = pick(cells, [*ks, "_prob"], F.col("_rest"))
    return found.select(*[F.col(f"_k{i}.{k}").alias(k) for i, k in enumerate(keys)], F.col("_prob").alias("prob"), (F.col("_cell") + F.lit(low)).cast("long").alias("percentile"))


def heavy_keys(summary: DataFrame, keys: Sequence[str], one_in: int) -> DataFrame:
    """The keys that hold at least one in so many of all rows, NULL keys left out (their rows count in the total)."""
    kept = materialize(summary.select(*keys, "n"), "heavy")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    some = kept.where(F.col("n") * F.lit(one_in) >= F.lit(total))
    for k in keys:
        some = some.where(F.col(k).isNotNull())
    return some.select(*keys)


def blocks(df: DataFrame, keys: Sequence[str], value: str, payload: str, span: int = 4096) -> DataFrame:
    """(keys, block_no, n_values, entries): the complete lists of all keys in blocks of bounded length.

    payload is an array column. Rows are compressed by (key, value, payload), then put together by (key, value): entries
    are (value, weight, payload: the distinct elements, sorted). Block b holds the values of [b * span, (b + 1) * span),
    so the list of a hot key is spread over many rows and tasks and can be read in order of block_no. NULL values make
    a block of their own with a NULL block_no.
    """
    once = df.groupBy(*keys, value, payload).agg(F.count(F.lit(1)).alias("weight"))
    merged = once.groupBy(*keys, value).agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(payload)))).alias(payload))
    return (
        merged.withColumn("block_no", F.floor(F.col(value) / F.lit(span)).cast("long"))
        .groupBy(*keys, "block_no")
        .agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list(F.struct(value, "weight", payload))).alias("entries"))
    )
