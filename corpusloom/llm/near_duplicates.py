"""Near-duplicate texts: an exact similarity join by the generalised pigeonhole principle.

A text is a sparse bit vector with one bit per distinct run of consecutive words (shingle). Let x be the smaller text of a
pair, with a bits. A Jaccard similarity of at least p/q then allows at most tau = a - ceil(2pa / (p+q)) bits of x to be
missing from the other text.

* Bits that no other text has are missing for certain. They use up part of tau, and a text that cannot keep enough bits
  leaves the collection; this runs in rounds, because every text that leaves makes further bits unique.
* The bits left are grouped into partitions of neighbouring shingles. These are correlated: one edited word loses all the
  shingles around it, and neighbours have largely the same owners.
* Partition i gets a threshold T_i >= -1 with sum(T_i + 1) = tau' + 1. If more than T_i bits were missing in every
  partition, more than tau' would be missing in all; so in some partition at most T_i are, and of any T_i + 1 of its bits
  one is in the other text. The thresholds come from a dynamic program over the estimated number of candidates: the
  frequencies of the bits probed, of which neighbours find mostly the same texts.
* The T_i + 1 rarest bits of each partition are probed in the index of all bits of all texts left. Bits of many texts are
  indexed by size too, so a probe reads only texts of sizes that fit. Candidates are compared by the parities of their bits,
  which differ in no more places than the sets do, and those that pass on their whole sets.

No pair is lost: nothing is sampled or capped, and every step only uses bounds that hold for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WORD
from corpusloom.session import materialize

#: Neighbouring bits in a partition; bits whose thresholds are found together; the share of texts that must leave in a round for another one to be worth it.
GROUP = 3
SPAN = 1500
WORTH = 0.05
MAX_ROUNDS = 6
#: Owners from which on a bit is indexed by size, and the number of size classes from a size to the largest that fits.
HOT = 200
CLASSES = 4
#: Rows that a task works on at once; words of 64 bits of a text's parities.
ROWS = 300_000
PARITIES = 4


def shingles(tokens: Column, n: int) -> Column:
    """The distinct hashes of all runs of n tokens, in order of their first occurrence."""
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def text_classes(docs: DataFrame, key: str, text: Column, n: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(key, cid) without repeats, and (cid, a, bits) with one row per class of texts with the same words.

    Texts of fewer than min_words words and NULL keys are left out. cid is a hash of the words; a second hash proves that
    no two texts share one, otherwise another seed is taken.
    """
    texts = docs.select(F.col(key).alias("key"), F.btrim(F.regexp_replace(F.lower(text), rf"[^{WORD[1:-2]}]+", " ")).alias("t"))  # the words, joined by blanks
    texts = texts.where(F.col("key").isNotNull() & (F.col("t") != "") & (F.length("t") - F.length(F.replace("t", F.lit(" "))) + 1 >= max(min_words, n)))
    for seed in range(8):
        found = materialize(texts.select("key", "t", F.xxhash64("t", F.lit(seed)).alias("cid"), F.xxhash64(F.lit(-1 - seed), "t").alias("check")), "texts")
        classes = found.groupBy("cid").agg(F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("t").alias("t"))
        classes = materialize(classes.select("cid", F.col("lo").eqNullSafe(F.col("hi")).alias("sound"), F.get(F.transform(F.array(F.split("t", " ")), lambda w: shingles(w, n)), 0).alias("bits")), "classes", hashes=True)  # the words are bound once
        if classes.where(~F.col("sound")).isEmpty():
            return materialize(found.select("key", "cid").distinct(), "members"), classes.select("cid", F.size("bits").alias("a"), "bits")
    raise RuntimeError("no seed keeps the texts' hashes apart")


def allocate(pos: np.ndarray, df: np.ndarray, cover: int, group: int = GROUP) -> np.ndarray:
    """allocate_all for one text; the indices of the bits to probe."""
    return np.flatnonzero(allocate_all(pos, df, np.array([0, len(df)]), np.array([cover]), group))


def allocate_all(pos: np.ndarray, df: np.ndarray, first: np.ndarray, cover: np.ndarray, group: int = GROUP) -> np.ndarray:
    """Whether each bit is probed: for each text sum(T_i + 1) = cover bits, at the least estimated number of candidates.

    The bits of text k are those from first[k] to before first[k + 1], in order of pos; 0 <= cover[k] <= their number.
    Partitions are runs of up to `group` neighbouring bits. Very long texts are cut into chunks of SPAN bits; a chunk has to
    cover as many errors as it has of the `cover` rarest bits, so time and memory stay in proportion to the length.
    """
    size = np.diff(first)
    if size.max(initial=0) > SPAN:
        text = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((df, text))
        rare = np.empty(len(df), np.int64)
        rare[order] = (np.arange(len(df)) - first[text] < cover[text]).astype(np.int64)
        starts = np.concatenate([np.arange(s, e, SPAN) for s, e in zip(first[:-1], first[1:]) if e > s])
        return _allocate(pos, df, np.r_[starts, len(df)], np.add.reduceat(rare, starts), group)
    return _allocate(pos, df, first, cover, group)


def _allocate(pos: np.ndarray, df: np.ndarray, first: np.ndarray, cover: np.ndarray, group: int) -> np.ndarray:
    """Probing k bits of a partition costs the sum of their frequencies in index rows read and, as neighbours find the same
    texts, about the largest frequency in candidates to verify; a dynamic program over the partitions minimises the sum,
    for many texts of similar length at once.
    """
    n, size = len(df), np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(n)
    begins = np.r_[True, (text[1:] != text[:-1]) | (np.diff(pos) != 1)] if n else np.zeros(0, bool)
    in_run = at - np.maximum.accumulate(np.where(begins, at, 0))
    heads = np.flatnonzero(begins | (in_run % group == 0))  # first bits of partitions
    part = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, n]))
    order = np.lexsort((df, part))  # by partition, then by frequency
    own, rank = df[order].astype(float), at - heads[part]
    total = np.cumsum(own)
    before = np.r_[0.0, total][heads[part]]
    cost = np.full((len(heads), group + 1), np.inf)
    cost[:, 0] = 0.0
    cost[part, rank + 1] = total - before + 4.0 * own
    parts_of = np.bincount(text[heads], minlength=len(size)) if n else np.zeros(len(size), np.int64)
    from_part = np.r_[0, np.cumsum(parts_of)]
    probed = np.zeros(len(heads), np.int64)
    by_length = np.argsort(parts_of, kind="stable")
    lo = 0
    while lo < len(by_length):
        some = by_length[lo : lo + 256]
        lo += 256
        some = some[cover[some] > 0]
        if not len(some):
            continue
        most, steps, width = int(cover[some].max()), int(parts_of[some].max()), len(some)
        padded = np.zeros((width, steps, group + 1))
        padded[:, :, 1:] = np.inf
        for i, t in enumerate(some):
            padded[i, : parts_of[t]] = cost[from_part[t] : from_part[t + 1]]
        best = np.full((width, most + 1), np.inf)  # the least cost of probing so many bits so far
        best[:, 0] = 0.0
        taken = np.zeros((steps, width, most + 1), np.int8)
        for g in range(steps):
            now = best.copy()
            for k in range(1, min(group, most) + 1):
                other = best[:, : most + 1 - k] + padded[:, g, k, None]
                better = other < now[:, k:]
                np.copyto(taken[g][:, k:], k, where=better)
                np.copyto(now[:, k:], other, where=better)
            best = now
        left, rows = cover[some].astype(np.int64).copy(), np.arange(width)
        for g in range(steps - 1, -1, -1):
            k = taken[g, rows, left].astype(np.int64)
            real = g < parts_of[some]
            probed[from_part[some[real]] + g] = k[real]
            left -= k
    out = np.zeros(n, bool)
    out[order] = rank < probed[part]
    return out


def _keyed(bits: np.ndarray, size_class: np.ndarray) -> np.ndarray:
    """Keys of a bit at a size; two that happen to be equal cost a candidate only."""
    with np.errstate(over="ignore"):
        return (bits ^ (bits >> 29)) * np.int64(-7046029254386353131) + (size_class.astype(np.int64) + 1) * np.int64(-4417276706812531889)


def _size_class(a: np.ndarray, p: int, q: int) -> np.ndarray:
    return np.floor(np.log(a) * (CLASSES / np.log(q / p))).astype(np.int64) if p < q else a.astype(np.int64)


def _texts(cid: np.ndarray, code: np.ndarray, bit: np.ndarray, df: np.ndarray, p: int, q: int, hot_from: int) -> pa.RecordBatch:
    """Whole texts, a row (cid, pos of a) for each bit: (cid, a, bits, hot, keys, probes, parities) of those that keep enough bits for a pair.

    bits are those of few owners, in order, hot the others, and keys those of hot in the index.
    """
    order = np.lexsort((code, cid))
    cid, code, bit, df = cid[order], code[order], bit[order], df[order]
    starts = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
    size, a = np.diff(np.r_[starts, len(cid)]), code[starts] >> 32
    stays = size * q >= a * p
    keep = np.repeat(stays, size)
    cid, code, bit, df, size, a = cid[starts][stays], code[keep], bit[keep], df[keep], size[stays], a[stays]
    first = np.r_[0, np.cumsum(size)]
    pos = code & 0xFFFFFFFF
    cover = np.maximum(0, (a - -(-2 * p * a // (p + q))) - (a - size) + 1)  # 0: it is the smaller text of no pair
    probed = allocate_all(pos, df, first, cover)
    here = np.repeat(_size_class(a, p, q), size)
    hot = df >= hot_from
    cold, warm = np.flatnonzero(probed & ~hot), np.flatnonzero(probed & hot)
    ahead = CLASSES + 2 if p < q else 1  # size classes in which a larger text can be, one more for rounding
    asked = np.r_[bit[cold], *[_keyed(bit[warm], here[warm] + k) for k in range(ahead)]]
    of = np.repeat(np.arange(len(size)), size)
    owner = np.r_[of[cold], np.tile(of[warm], ahead)]
    back = np.argsort(owner, kind="stable")
    slot, mask = (bit >> 6) & (PARITIES - 1), np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64)
    parities = [np.bitwise_xor.reduceat(np.where(slot == w, mask, 0), first[:-1]) if len(size) else np.zeros(0, np.int64) for w in range(PARITIES)]

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))

    def offsets(text: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(np.bincount(text, minlength=len(size)))]

    of_hot = offsets(of[hot])
    arrays = [lists(offsets(of[~hot]), bit[~hot]), lists(of_hot, bit[hot]), lists(of_hot, _keyed(bit[hot], here[hot])), lists(offsets(owner), asked[back])]
    return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(a.astype(np.int32)), *arrays, *map(pa.array, parities)], ["cid", "a", "bits", "hot", "keys", "probes", *[f"s{w}" for w in range(PARITIES)]])


_TEXT = "cid long, a int, bits array<bigint>, hot array<bigint>, keys array<bigint>, probes array<bigint>, " + ", ".join(f"s{w} long" for w in range(PARITIES))


def _assembled(p: int, q: int):
    """Rows (cid, code, bit, df) in order of cid to texts; a batch's last text may go on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def put_together(last: bool) -> pa.RecordBatch | None:
            nonlocal held, n
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            others = np.flatnonzero(cols[0] != cols[0][-1])
            end = len(cols[0]) if last else int(others[-1]) + 1 if len(others) else 0
            held, n = ([[c[end:] for c in cols]], len(cols[0]) - end) if end < len(cols[0]) else ([], 0)
            return _texts(*[c[:end] for c in cols], p, q, HOT) if end else None

        for b in batches:
            if b.num_rows:
                held.append([b.column(i).to_numpy() for i in range(4)])
                n += b.num_rows
                if n >= ROWS:
                    out = put_together(False)
                    if out is not None:
                        yield out
        if n:
            yield put_together(True)

    return run


def _live(flat: DataFrame, p: int, q: int) -> DataFrame:
    """Texts with the bits that at least two texts have, of the texts that keep enough of them for any pair.

    flat: (cid, code, bit), code being a and pos in one number. Counting the owners combines before its shuffle; in the
    join a hot bit may be split over tasks. A text's bits then meet in one task.
    """
    df = flat.groupBy("bit").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    kept = flat.join(df, "bit").select("cid", "code", "bit", "df")
    return kept.repartition("cid").sortWithinPartitions("cid").mapInArrow(_assembled(p, q), _TEXT)


def _flat(texts: DataFrame, bits: Column) -> DataFrame:
    rows = texts.select("cid", "a", F.posexplode(bits).alias("pos", "bit"))
    return rows.select("cid", (F.shiftleft(F.col("a").cast("long"), 32) + F.col("pos")).alias("code"), "bit")


def class_pairs(classes: DataFrame, threshold: Fraction) -> DataFrame:
    """(x, y, shared, union) of all pairs of different classes with a Jaccard similarity of at least the threshold, x < y."""
    p, q = threshold.numerator, threshold.denominator
    texts = classes.where(F.col("a") > 0)
    flat, n = _flat(texts, F.col("bits")), texts.count()
    for _ in range(MAX_ROUNDS):
        left = materialize(_live(flat, p, q), "live", hashes=True)
        before, n = n, left.count()
        if before - n <= WORTH * before:
            break
        flat = _flat(left, F.concat("bits", "hot"))
    probes = left.select(F.col("cid").alias("x"), F.col("a").alias("xa"), F.explode("probes").alias("key"))
    index = left.select(F.col("cid").alias("y"), F.col("a").alias("ya"), F.explode(F.concat("bits", "keys")).alias("key"))
    fits = ((F.col("ya") > F.col("xa")) | ((F.col("ya") == F.col("xa")) & (F.col("y") > F.col("x")))) & (F.col("xa") * q >= F.col("ya") * p)
    candidates = probes.join(index, "key").where(fits).select("x", "y").distinct()
    signs = [f"s{w}" for w in range(PARITIES)]
    one = candidates.join(left.select(F.col("cid").alias("x"), F.col("a").alias("xa"), *[F.col(s).alias(f"x{s}") for s in signs]), "x")
    two = one.join(left.select(F.col("cid").alias("y"), F.col("a").alias("ya"), *[F.col(s).alias(f"y{s}") for s in signs]), "y")
    total = F.col("xa") + F.col("ya")
    apart = sum((F.bit_count(F.col(f"x{s}").bitwiseXOR(F.col(f"y{s}"))) for s in signs), F.lit(0))
    close = two.where(apart <= total - 2 * F.ceil(total * p / (p + q))).select("x", "y", "xa", "ya")
    close = close.join(left.select(F.col("cid").alias("x"), F.concat("bits", "hot").alias("xb")), "x").join(left.select(F.col("cid").alias("y"), F.concat("bits", "hot").alias("yb")), "y")
    counted = close.select("x", "y", F.size(F.array_intersect("xb", "yb")).alias("shared"), total.alias("total"))
    return counted.where(F.col("shared") * (p + q) >= F.col("total") * p).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "shared", (F.col("total") - F.col("shared")).alias("union"))


def near_duplicate_pairs(docs: DataFrame, key: str, text: Column, threshold: Fraction = Fraction(4, 5), n: int = 5, min_words: int = 5) -> DataFrame:
    """(key_1, key_2), key_1 < key_2: all pairs of different keys that have texts of at least the given similarity.

    A key may have several texts (rows); a pair counts once. Texts with the same words are similar, whatever their case
    and punctuation. NULL and empty texts and those of fewer than min_words words are in no pair. Other columns of docs
    are not read, so their names do not matter. An empty table gives no pairs.
    """
    members, classes = text_classes(docs, key, text, n, min_words)
    pairs = class_pairs(classes, threshold).select("x", "y")
    apart = pairs.join(members.select(F.col("cid").alias("x"), F.col("key").alias("k1")), "x").join(members.select(F.col("cid").alias("y"), F.col("key").alias("k2")), "y").select("k1", "k2")
    same = members.select("cid", F.col("key").alias("k1")).join(members.select("cid", F.col("key").alias("k2")), "cid").select("k1", "k2").where(F.col("k1") < F.col("k2"))
    return apart.unionByName(same).where(F.col("k1") != F.col("k2")).select(F.least("k1", "k2").alias("key_1"), F.greatest("k1", "k2").alias("key_2")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): the smallest node of each connected component, by alternating stars.

    Every round is two aggregations and joins and is written to the shared folder; the number of rounds is about the
    logarithm of the longest chain.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        now = materialize(small, "edges")
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == state:
            break
        state = check
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicate_groups(docs: DataFrame, key: str, text: Column, threshold: Fraction = Fraction(4, 5), n: int = 5, min_words: int = 5) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per key and class of its texts.

    class_id names the texts with the same words, group_id the classes connected by similar pairs (the smallest class),
    n_links counts the similar classes. Copies are not expanded into pairs.
    """
    members, classes = text_classes(docs, key, text, n, min_words)
    pairs = materialize(class_pairs(classes, threshold).select("x", "y"), "pairs")
    links = pairs.select(F.col("x").alias("cid")).unionByName(pairs.select(F.col("y").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "cid")
    return members.join(links, "cid", "left").join(roots, "cid", "left").select("key", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
