import math
import random
from collections import Counter, defaultdict

import pytest

from corpusloom.operators import skew
from corpusloom.operators.dedup import once_per_id
from corpusloom.operators.postings import fragment_postings
from tests.conftest import rows


def sample(n=3000, seed=1):
    r = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", None]
    return [(r.choice(keys), None if r.random() < 0.05 else int(r.paretovariate(0.4)) * r.choice([1, -1]) % 2**40) for _ in range(n)]


def groups(data):
    g = defaultdict(list)
    for k, v in data:
        g[k].append(v)
    return g


def test_summary(spark):
    data = sample()
    got = {r[0]: tuple(r)[1:] for r in skew.summarize(skew.compress(spark.createDataFrame(data, "k string, v long"), ["k"], "v"), ["k"], "v").collect()}
    for k, vs in groups(data).items():
        c = Counter(v for v in vs if v is not None)
        best = min(c, key=lambda v: (-c[v], v))
        assert got[k] == (len(vs), len(c), best, c[best])


@pytest.mark.parametrize("probs", [[0.0, 0.01, 0.5, 0.9, 1.0]])
def test_percentiles(spark, probs):
    data = sample()
    got = {(r[0], r[1]): r[2] for r in skew.percentiles(skew.compress(spark.createDataFrame(data, "k string, v long"), ["k"], "v"), ["k"], "v", probs).collect()}
    for k, vs in groups(data).items():
        s = sorted(v for v in vs if v is not None)
        for p in probs:
            assert got[k, p] == s[max(1, math.ceil(p * len(s))) - 1]
    assert len(got) == 4 * len(probs)


def test_weights_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, None, "x"), ("a", 2, 1, "y")], "k string, v long, w long, n string")
    assert rows(skew.compress(df, ["k"], "v", "w")) == [("a", 1, 5), ("a", 2, 1)]


def test_all_null_values_and_ties(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("b", 1)], "k string, v long")
    assert rows(skew.summarize(skew.compress(df, ["k"], "v"), ["k"], "v")) == [("a", 1, 0, None, 0), ("b", 2, 2, 1, 1)]


def test_empty(spark):
    e = spark.createDataFrame([], "k string, v long, p array<int>")
    c = skew.compress(e, ["k"], "v")
    assert c.collect() == [] and skew.summarize(c, ["k"], "v").collect() == [] and skew.percentiles(c, ["k"], "v", [0.5]).collect() == []
    assert skew.heavy_keys(skew.summarize(c, ["k"], "v"), ["k"], 100).collect() == [] and skew.blocks(e, ["k"], "v", "p").collect() == []


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1), (None, 99)], "k string, n long")
    assert rows(skew.heavy_keys(df, ["k"], 2)) == [("a",)]
    assert rows(skew.heavy_keys(df, ["k"], 200)) == [("a",), ("b",)]


def test_blocks_are_complete(spark):
    r = random.Random(3)
    data = [(r.choice(["hot", "hot", "x"]), r.choice([None, *range(0, 30000, 7)]), sorted(r.sample(range(9), r.randint(0, 3)))) for _ in range(2000)]
    got = skew.blocks(spark.createDataFrame(data, "k string, v long, p array<int>"), ["k"], "v", "p", span=1000).collect()
    want = defaultdict(lambda: [0, set()])
    for k, v, p in data:
        want[k, v][0] += 1
        want[k, v][1] |= set(p)
    seen = {}
    for row in got:
        assert row["n_values"] == len(row["entries"]) <= 1000
        for e in row["entries"]:
            assert (row["block_no"] is None) == (e["v"] is None) and (e["v"] is None or e["v"] // 1000 == row["block_no"])
            seen[row["k"], e["v"]] = [e["weight"], set(e["p"])]
    assert seen == dict(want)


FRAG = "frag_id long, shard string, ngram string, data array<struct<pmid:bigint,pos:array<int>>>, batch_no int, weight int, x string"


def test_fragments(spark):
    p = [(7, [1, 2]), (8, None), (None, [3])]
    data = [
        (1, "s", " The ", p, 1, 1, "a"), (1, "s", " The ", p, 1, 2, "b"), (2, "s", "the", [(7, [1, 2])], 1, 1, ""), (3, "s", "x", None, 1, 1, ""), (4, "s", "x", [], 1, 1, ""),
        (None, "s", "y", [(1, None)], 1, 1, ""), (None, "s", "y", [(1, None)], 1, 1, ""), (None, "s", "y", [(2, None)], 1, 1, ""), (5, "s", None, [(9, None)], 1, 1, ""),
    ]
    df = spark.createDataFrame(data, FRAG)
    assert rows(fragment_postings(df)) == sorted([("the", 7), ("the", 8), ("the", None), ("the", 7), ("y", 1), ("y", 2), (None, 9)], key=repr)
    assert ("the", 8, []) in rows(fragment_postings(df, with_pos=True))
    assert fragment_postings(df.limit(0)).collect() == []


def test_once_per_id_takes_the_greatest(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 3, "a"), (1, None, "z"), (None, 1, "q"), (None, 1, "q")], "id int, seq int, body string")
    assert rows(once_per_id(df, "id", ["seq", "body"])) == [(1, 3, "a"), (None, 1, "q")]
