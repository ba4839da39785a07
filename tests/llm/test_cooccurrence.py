import itertools
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import cooccurrence as C
from tests.conftest import rows


def brute(data):
    baskets = {}
    for r, i in data:
        if r is not None and i is not None:
            baskets.setdefault(r, set()).add(i)
    single, both = Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        both.update(itertools.combinations(sorted(b), 2))
    return sorted(single.items()), sorted((*k, v) for k, v in both.items())


def sample(seed, giant=False):
    r = random.Random(seed)
    data = [(r.choice(["r1", *[f"q{i}" for i in range(200)], None]), r.choice([f"i{int(r.paretovariate(0.6)) % 40}", None, ""])) for _ in range(2500)]
    return data + ([("giant", f"i{k}") for k in range(400)] if giant else [])


@pytest.mark.parametrize(("giant", "block_rows"), [(False, 200_000), (False, 100), (True, 50)])
def test_against_brute_force(spark, giant, block_rows):
    data = sample(1, giant)
    df = spark.createDataFrame([(r, i, 1, "x") for r, i in data], "basket string, thing string, n int, item string")
    single, both = C.cooccurrence(df, "basket", "thing", block_rows)
    want = brute(data)
    assert sorted(map(tuple, single.collect())) == want[0] and sorted(map(tuple, both.collect())) == want[1]


def test_dense_and_sparse_agree():
    r = np.random.default_rng(0)
    for density in (0.02, 0.9):
        x = r.random((300, 40)) < density
        rec, item = np.nonzero(x)
        ((i, j, n),) = C.gram(rec, item, 40)
        want = np.triu(x.astype(int).T @ x.astype(int), 1)
        got = np.zeros((40, 40), int)
        got[i, j] = n
        assert (got == want).all()


def test_empty(spark):
    single, both = C.cooccurrence(spark.createDataFrame([], "r long, i string"), "r", "i")
    assert single.collect() == both.collect() == []


JOBS = "a_terms array<string>, b_terms array<string>, paired boolean, term string"


def test_asked_pairs(spark):
    data = [(["A-1", "b | C d|"], ["x", "a 1", None, "..."], False, "t"), (["p", "q", "r"], ["s", "q"], True, "t"), (None, ["x"], False, "t"), ([], ["x"], None, "t"), (["u"], ["v"], None, "t"), (["u"], ["V"], False, "t")]
    got = rows(C.asked_pairs(spark.createDataFrame(data, JOBS)))
    assert got == sorted([("a 1", "x"), ("a 1", "b|c d"), ("b|c d", "x"), ("p", "s"), ("u", "v")], key=repr)


def test_associations(spark):
    docs = [("d1", "Alpha beta, gamma!"), ("d2", "alpha-BETA"), ("d3", "beta alpha gamma"), ("d4", None), ("d5", ""), ("d6", "gamma " * 20_000), ("d7", "alphabeta gamma_alpha")]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "id string, body string, record string")
    pairs = spark.createDataFrame([("alpha beta", "gamma"), ("alpha", "beta|gamma"), ("gamma", "nothing")], "term_1 string, term_2 string")
    got = {(r["term_1"], r["term_2"]): tuple(r)[2:] for r in C.pair_associations(df, "id", "body", pairs).collect()}
    assert got["alpha beta", "gamma"] == (7, 2, 4, 1, 7 / 8)
    assert got["alpha", "beta|gamma"][1:4] == (4, 5, 4)
    assert got["gamma", "nothing"] == (7, 4, 0, 0, None)
    assert C.pair_associations(df, "id", "body", pairs.limit(0)).collect() == []
    assert C.pair_associations(df.limit(0), "id", "body", pairs).count() == 3


def test_only_blocks_that_are_too_large_are_divided(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 1000)  # of the driver's closure, which the tasks get
    data = [("giant", f"i{k}") for k in range(300)] + [(f"r{k % 40}", f"i{k % 97}") for k in range(800)]
    df = spark.createDataFrame(data, "basket string, thing string")
    single, both = C.cooccurrence(df, "basket", "thing", block_rows=100, block_pairs=5000)
    want = brute(data)
    assert sorted(map(tuple, both.collect())) == want[1] and sorted(map(tuple, single.collect())) == want[0]


def test_parts_of_a_product_add_up(monkeypatch):
    monkeypatch.setattr(C, "CELLS", 500)
    r = np.random.default_rng(1)
    rec, item = np.unique(np.c_[r.integers(0, 30, 6000), r.integers(0, 4000, 6000)], axis=0).T
    side = (item % 2).astype(np.int8)
    for s in (None, side):
        want, got, parts = Counter(), Counter(), 0
        for x in np.unique(rec):
            some = item[rec == x]
            want.update((a, b) for a, b in itertools.combinations(sorted(some.tolist()), 2) if s is None or a % 2 != b % 2)
        for i, j, n in C.gram(rec, item, 4000, s):
            parts += 1
            for a, b, c in zip(i.tolist(), j.tolist(), n.tolist()):
                got[a, b] += c
        assert got == want and parts > 1
