import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P
from tests.conftest import rows


def optimum(sizes, cap):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, [*rooms, cap - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 45))
def test_bins_are_valid_and_near_the_optimum(sizes, cap):
    bins = P.bin_completion(sizes, cap)
    assert Counter(itertools.chain(*bins)) == Counter(sizes) and all(sum(b) <= cap for b in bins)
    if sizes:
        best = optimum(sizes, cap)
        assert P.lower_bound(sizes, cap) <= best <= len(bins) <= len(P.best_fit_decreasing(sizes, cap))
        assert len(bins) <= best + (best > 3)


def test_search_beats_best_fit():
    better = 0
    r = random.Random(0)
    for _ in range(40):
        cap = 100
        sizes = [x for _ in range(8) for x in (lambda a, b: [a, b, cap - a - b])(r.randint(20, 45), r.randint(20, 35))]
        bins = P.bin_completion(sizes, cap)
        better += len(bins) < len(P.best_fit_decreasing(sizes, cap))
        assert Counter(itertools.chain(*bins)) == Counter(sizes) and all(sum(b) <= cap for b in bins)
    assert better > 5


def test_dominance():
    assert P.dominates([10], [4, 5]) and P.dominates([6, 4], [5, 3]) and not P.dominates([6, 4], [7])
    assert P.completions([3, 4, 5, 7], 7)[0] in ([7], [4, 3])


LIMITS = [("small", 10), ("large", 64)]


@pytest.mark.parametrize("block_items", [2000, 16])
def test_pack(spark, block_items):
    r = random.Random(3)
    data = [(i, r.choice([1, 2, 3, 4, 6, 7, 9, 10, 25, 130, 0, None])) for i in range(400)] + [(5, 4), (None, 6), (None, 6)]
    items = spark.createDataFrame([(k, n, 1, "x", 2) for k, n in data], "doc long, n long, uid int, key string, capacity int")
    limits = spark.createDataFrame([(*x, "y") for x in LIMITS] + [("small", 10, "z"), ("bad", 0, ""), ("null", None, "")], "limit_name string, max_tokens int, total string")
    got = P.pack(items, "doc", "n", limits, block_items)
    assert got.columns == ["limit_name", "container_id", "doc", "part_no", "token_start", "token_end", "n_tokens"]
    for name, cap in LIMITS:
        mine = [x for x in got.collect() if x["limit_name"] == name]
        fill, pieces = Counter(), defaultdict(list)
        for x in mine:
            assert x["n_tokens"] == x["token_end"] - x["token_start"]
            if x["container_id"] is None:
                assert x["n_tokens"] == 0
            else:
                fill[x["container_id"]] += x["n_tokens"]
                pieces[x["doc"]].append(x["n_tokens"])
        assert max(fill.values()) <= cap
        want = defaultdict(list)
        for k, n in data:
            if n:
                want[k] += [cap] * (n // cap) + ([n % cap] if n % cap else [])
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
        total = sum(n or 0 for _, n in data)
        assert len(fill) <= -(-total // cap) + 3 + (len(data) // block_items if block_items < 100 else 0)
        assert sum(2 * v <= cap for v in fill.values()) <= 1
        assert sum(x["container_id"] is None for x in mine) == sum(not n for _, n in data)
    assert {x[0] for x in rows(got.select("limit_name").distinct())} == {"small", "large"}
    report = {x["limit_name"]: x for x in P.fill_report(got, limits.where("max_tokens > 0")).collect()}
    assert report["small"]["n_tokens"] == total and report["small"]["least_containers"] == -(-total // 10)


def test_empty(spark):
    items = spark.createDataFrame([], "doc long, n long")
    limits = spark.createDataFrame(LIMITS, "limit_name string, max_tokens int")
    assert P.pack(items, "doc", "n", limits).collect() == []
    some = spark.createDataFrame([(1, 5)], "doc long, n long")
    assert P.pack(some, "doc", "n", limits.limit(0)).collect() == []


def test_blocks_that_fill_less_than_a_container_end(spark):
    items = spark.createDataFrame([(i, 1) for i in range(40)], "doc long, n long")
    limits = spark.createDataFrame([("l", 100), ("m", 7)], "limit_name string, max_tokens int")
    got = P.pack(items, "doc", "n", limits, block_items=10).collect()
    assert len(got) == 80 and {x["container_id"] for x in got if x["limit_name"] == "l"}.__len__() == 1
    fill = Counter(x["container_id"] for x in got if x["limit_name"] == "m")
    assert max(fill.values()) <= 7 and len(fill) <= 8


def test_containers_of_thousands_of_items(spark):
    r = random.Random(8)
    data = [(i, r.randint(1, 8)) for i in range(6000)] + [(9000 + i, 3000) for i in range(3)]
    items = spark.createDataFrame(data, "doc long, n long")
    limits = spark.createDataFrame([("l", 4096)], "limit_name string, max_tokens int")
    got = P.pack(items, "doc", "n", limits, block_items=100).collect()
    fill = Counter()
    for x in got:
        fill[x["container_id"]] += x["n_tokens"]
    assert sorted(x["doc"] for x in got) == sorted(i for i, _ in data) and max(fill.values()) <= 4096
    assert len(fill) <= -(-sum(n for _, n in data) // 4096) + 1


def test_without_bounds_a_block_is_optimal(spark):
    r = random.Random(4)
    for _ in range(6):  # triplets that fill their containers
        sizes = [x for _ in range(12) for a in [r.randint(380, 490)] for b in [r.randint(250, (1000 - a) // 2)] for x in (a, b, 1000 - a - b)]
        assert len(P.bin_completion(sizes, 1000, None, None, None)) == 12
    for _ in range(40):
        sizes = [r.randint(3, 30) for _ in range(9)]
        assert len(P.bin_completion(sizes, 40, None, None, None)) == optimum(sizes, 40)
    items = spark.createDataFrame(list(enumerate([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])), "doc long, n long")
    limits = spark.createDataFrame([("l", 10)], "limit_name string, max_tokens int")
    assert P.pack(items, "doc", "n", limits, 2000, None, None, None).select("container_id").distinct().count() == 4
    with pytest.raises(ValueError):
        P.pack(items, "doc", "n", limits, completions=0)
