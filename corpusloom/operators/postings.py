"""Index fragments: (n-gram, postings) rows as the index batches deliver them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import trimmed_lower
from corpusloom.operators.dedup import once_per_id


def fragment_postings(fragments: DataFrame, with_pos: bool = False) -> DataFrame:
    """(ngram, pmid[, pos]): one row per element of data, each frag_id counted once, n-grams trimmed and lower-cased.

    NULL or empty data gives no row; elements with a NULL pmid and fragments with a NULL n-gram stay, as NULLs; a NULL
    pos comes out as an empty array. Columns besides frag_id, ngram and data are not read.
    """
    if with_pos:
        data = F.transform("data", lambda x: F.struct(x["pmid"].alias("pmid"), F.coalesce(x["pos"], F.array().cast("array<int>")).alias("pos")))
    else:
        data = F.col("data.pmid")  # as a field path, so that the scan reads no positions
    rows = fragments.select("frag_id", trimmed_lower("ngram").alias("ngram"), data.alias("data")).where(F.size("data") > 0)
    flat = once_per_id(rows, "frag_id", ["ngram", "data"]).select("ngram", F.explode("data").alias("x"))
    return flat.select("ngram", "x.pmid", "x.pos") if with_pos else flat.select("ngram", F.col("x").alias("pmid"))
