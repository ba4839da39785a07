"""Items that appear together: a blocked Gram matrix.

Records (baskets) are hashed to record blocks. A task turns its block into a binary sparse matrix X (records x items) and
adds up its part of the transposed product X'X; the parts are summed over the record blocks. A block that has too many
rows or pairs, for instance because one record holds most items, is divided into item blocks, and a task then computes the
product of two of them; other blocks stay whole. A task holds the rows of its block and at most CELLS summed pairs, which
leave it as counts whenever there are more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import grams, normal_form, words
from corpusloom.session import materialize

#: Rows (record, item) of a block; pairs of a task; pairs or cells held at once in a task.
BLOCK_ROWS = 200_000
BLOCK_PAIRS = 500_000_000
CELLS = 4_000_000


def gram(record: np.ndarray, item: np.ndarray, n_items: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts (i, j, count), i < j, that add up to X'X for distinct (record, item) codes; sparse or dense tiles, whichever is less work.

    With side (0 or 1 for each row) only pairs of items of different sides count.
    """
    order = np.lexsort((item, record) if side is None else (item, side, record))
    record, item = record[order], item[order]
    starts = np.flatnonzero(np.r_[True, record[1:] != record[:-1]]) if len(record) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(record)])
    pairs = float((sizes.astype(float) * (sizes - 1) / 2).sum())
    if n_items <= 2048 and len(sizes) * float(n_items) ** 2 / 200.0 < pairs:
        total = np.zeros((n_items, n_items), np.int64)
        code = np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, CELLS // max(1, n_items))
        for lo in range(0, len(sizes), step):
            some = slice(*np.searchsorted(code, (lo, lo + step)))
            x = np.zeros((min(step, len(sizes) - lo), n_items), np.float32)
            x[code[some] - lo, item[some]] = 1.0
            total += np.rint(x.T @ x).astype(np.int64)
        if side is not None:
            of = np.zeros(n_items, np.int8)
            of[item] = side[order]
            total[of[:, None] == of[None, :]] = 0
        i, j = np.nonzero(np.triu(total, 1))
        yield i, j, total[i, j]
        return
    here = np.arange(len(record))
    end = np.repeat(starts + sizes, sizes)
    if side is None:
        first = here + 1  # items of the same record that follow
    else:
        zeros = np.add.reduceat(side[order] == 0, starts) if len(starts) else sizes
        first = np.where(side[order] == 0, np.repeat(starts + zeros, sizes), end)
    later = end - first
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cum = np.cumsum(later)
    lo = 0
    while lo < len(record):
        hi = max(lo + 1, int(np.searchsorted(cum, (cum[lo - 1] if lo else 0) + CELLS, "right")))
        part = later[lo:hi]
        left = np.repeat(here[lo:hi], part)
        right = np.repeat(first[lo:hi], part) + np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
        a, b = item[left], item[right]
        got, n = np.unique(np.minimum(a, b) * np.int64(n_items) + np.maximum(a, b), return_counts=True)
        codes, at = np.unique(np.r_[codes, got], return_inverse=True)
        counts = np.bincount(at, weights=np.r_[counts, n], minlength=len(codes)).astype(np.int64)
        if len(codes) > CELLS:
            yield codes // n_items, codes % n_items, counts
            codes, counts = codes[:0], counts[:0]
        lo = hi
    yield codes // n_items, codes % n_items, counts


def _block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = key[1].as_py(), key[2].as_py()
    t = pa.Table.from_batches(list(batches))  # the rows of a block or of two parts of one
    names, item = np.unique(t["item"].to_numpy(), return_inverse=True)
    record = t["record"].combine_chunks().dictionary_encode().indices.to_numpy()
    side = None if p == q else (t["part"].to_numpy() == q).astype(np.int8)  # the two diagonal products have tasks of their own
    for i, j, n in gram(record, item.astype(np.int64), len(names), side):
        for lo in range(0, len(i), 500_000):
            s = slice(lo, lo + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[i[s]]), pa.array(names[j[s]]), pa.array(n[s])], ["i", "j", "n"])


def cooccurrence(rows: DataFrame, record: str, item: str, block_rows: int = BLOCK_ROWS, block_pairs: int = BLOCK_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(item, n) and (item_1, item_2, together), item_1 < item_2: records that hold an item, and both items of a pair.

    A block of more than 4 * block_rows rows or more than block_pairs pairs is divided by items, all others are not. A
    record that names an item several times holds it once. Rows with a NULL record or item count nowhere. Pairs that
    never meet have no row. An empty table gives two empty results. Other columns are not read.
    """
    once = rows.where(F.col(record).isNotNull() & F.col(item).isNotNull()).select(F.col(record).alias("record"), F.col(item).alias("name"), F.xxhash64(item).alias("item")).distinct()
    once = materialize(once, "baskets")
    marginals = materialize(once.groupBy("item").agg(F.min("name").alias("name"), F.max("name").alias("other"), F.count(F.lit(1)).alias("n")), "marginals")
    if not marginals.where(F.col("name") != F.col("other")).isEmpty():
        raise RuntimeError("two items share a hash")
    n = once.count()
    blocks = max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("record"), F.lit(blocks)).cast("int")
    sizes = once.groupBy("record").agg(F.count(F.lit(1)).alias("k")).groupBy(block.alias("block")).agg(F.sum("k").alias("k"), F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2).alias("pairs"))
    needed = F.greatest(F.ceil(F.col("k") / (4 * block_rows)), F.ceil(F.sqrt(F.col("pairs") / block_pairs))).cast("int")
    large = sizes.select("block", needed.alias("parts")).where("parts > 1")  # few; the optimizer broadcasts them if they are small
    blocked = once.select("record", "item", block.alias("block")).join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("item", F.lit(1)), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("p"), F.greatest("part", k).alias("q")))
    placed = blocked.withColumn("part", part).withColumn("tile", F.explode(tiles)).select("block", "tile.p", "tile.q", "record", "item", "part")
    partial = placed.groupBy("block", "p", "q").applyInArrow(_block, "i long, j long, n long")
    total = partial.groupBy("i", "j").agg(F.sum("n").alias("together"))
    named = total.join(marginals.select(F.col("item").alias("i"), F.col("name").alias("a")), "i").join(marginals.select(F.col("item").alias("j"), F.col("name").alias("b")), "j")
    return marginals.select(F.col("name").alias("item"), "n"), named.select(F.least("a", "b").alias("item_1"), F.greatest("a", "b").alias("item_2"), "together")


def term_key(term) -> F.Column:
    """A term's alternatives (separated by |) in normal form, joined by |; alternatives without words vanish."""
    forms = F.transform(F.split(term, r"\|"), normal_form)
    return F.array_join(F.filter(forms, lambda x: x != ""), "|")


def asked_pairs(jobs: DataFrame) -> DataFrame:
    """(term_1, term_2), term_1 < term_2: different terms that a job asks for together.

    Any a-term with any b-term, or only those at the same position if paired (the longer list's rest has no partner). A
    NULL or empty list, NULL terms and terms without words ask for none; a NULL paired is false. The product stays within
    the two lists of one job.
    """
    a, b = (F.transform(F.col(c), lambda t: F.coalesce(term_key(t), F.lit(""))) for c in ("a_terms", "b_terms"))
    lists = jobs.where((F.size("a_terms") > 0) & (F.size("b_terms") > 0)).select(a.alias("a"), b.alias("b"), F.coalesce("paired", F.lit(False)).alias("paired"))
    aligned = lists.where("paired").select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    crossed = lists.where(~F.col("paired")).select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    both = aligned.unionByName(crossed).where("a <> '' AND b <> '' AND a <> b")
    return both.select(F.least("a", "b").alias("term_1"), F.greatest("a", "b").alias("term_2")).distinct()


def term_occurrences(docs: DataFrame, record: str, text: str, terms: DataFrame) -> DataFrame:
    """(record, term) of terms (a column of keys as term_key writes them) that a text holds; repeats may occur.

    A text holds a term if the words of an alternative follow one another in it. Texts are cut into runs of words of the
    lengths that occur, which are joined with the alternatives; the optimizer broadcasts these if they are small.
    """
    phrases = materialize(terms.select(F.col("term").alias("_term"), F.explode(F.split("term", r"\|")).alias("phrase")).where("phrase <> ''").distinct(), "phrases")
    lengths = sorted(r[0] for r in phrases.select(F.size(F.split("phrase", " ")).alias("k")).distinct().collect())  # a handful of lengths
    tokens = docs.select(F.col(record).alias("_record"), words(text).alias("w")).where(F.size("w") > 0)
    runs = F.concat(*[grams("w", k) for k in lengths]) if lengths else F.array().cast("array<string>")
    return tokens.select("_record", F.explode(runs).alias("phrase")).join(phrases, "phrase").select(F.col("_record").alias("record"), F.col("_term").alias("term"))


def pair_associations(docs: DataFrame, record: str, text: str, pairs: DataFrame) -> DataFrame:
    """(term_1, term_2, n_docs, n_1, n_2, together, lift) of every asked pair; lift is NULL if a term never occurs.

    docs has one row per record; records without text count in n_docs only.
    """
    n = docs.count()
    pairs = materialize(pairs, "asked")
    terms = pairs.select(F.col("term_1").alias("term")).unionByName(pairs.select(F.col("term_2").alias("term"))).distinct()
    single, both = cooccurrence(term_occurrences(docs, record, text, terms), "record", "term")
    one, two = (single.select(F.col("item").alias(f"term_{k}"), F.col("n").alias(f"n_{k}")) for k in (1, 2))
    met = both.select(F.col("item_1").alias("term_1"), F.col("item_2").alias("term_2"), "together")
    out = pairs.join(one, "term_1", "left").join(two, "term_2", "left").join(met, ["term_1", "term_2"], "left").fillna(0, ["n_1", "n_2", "together"])
    lift = F.when((F.col("n_1") > 0) & (F.col("n_2") > 0), F.col("together") * F.lit(float(n)) / (F.col("n_1") * F.col("n_2")))
    return out.select("term_1", "term_2", F.lit(n).cast("long").alias("n_docs"), "n_1", "n_2", "together", lift.alias("lift"))


