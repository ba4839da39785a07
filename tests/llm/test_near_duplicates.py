import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import near_duplicates as N
from tests.conftest import rows

SCHEMA = "pmid long, text string, cid long, a int, bits string, key string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(data, threshold, n, least):
    sets = [(k, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))) for k, t in {(k, t) for k, t in data} if len(w := words(t)) >= max(least, n) and k is not None]
    out = set()
    for i, (k, s) in enumerate(sets):
        for m, u in sets[i + 1 :]:
            if k != m and threshold.denominator * len(s & u) >= threshold.numerator * len(s | u):
                out.add((min(k, m), max(k, m)))
    return sorted(out)


def make(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    data = []
    for i in range(n):
        if data and r.random() < 0.7:
            w = words(r.choice(data)[1])
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                at, act = r.randrange(len(w) + 1), r.random()
                if act < 0.4 and at < len(w):
                    w[at] = r.choice(vocabulary)
                elif act < 0.6:
                    w.insert(at, r.choice(vocabulary))
                elif act < 0.8 and at < len(w) and len(w) > 3:
                    del w[at]
                else:
                    w = w[at:] + w[:at]
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([5, 20, 40, 80]))]
        data.append((r.randrange(n) if r.random() < 0.1 else i, " ".join(w)))
    return data


def frame(spark, data):
    return spark.createDataFrame([(k, t, 1, 2, "x", "y") for k, t in data], SCHEMA)


@pytest.mark.parametrize(("seed", "threshold", "n", "least"), [(1, Fraction(6, 10), 3, 20), (2, Fraction(4, 5), 5, 5), (3, Fraction(1, 2), 2, 2), (4, Fraction(1), 3, 3)])
def test_all_pairs_are_found(spark, seed, threshold, n, least):
    data = make(seed)
    got = rows(N.near_duplicate_pairs(frame(spark, data), "pmid", F.col("text"), threshold, n, least))
    assert sorted(got) == brute(data, threshold, n, least) and got


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    data = [(1, None), (2, ""), (3, " .,; "), (4, "a b c"), (None, "p q r s t u"), (5, "P-q R_s, t u"), (6, "p q r s t u"), (6, "p q r s t u"), (7, long), (8, long + " end"), (9, "a b c d e"), (5, "another text of the same key")]
    got = rows(N.near_duplicate_pairs(frame(spark, data), "pmid", F.col("text")))
    assert got == [(5, 6), (7, 8)]
    assert N.near_duplicate_pairs(frame(spark, []), "pmid", F.col("text")).collect() == []
    assert N.near_duplicate_groups(frame(spark, []), "pmid", F.col("text")).collect() == []


def test_groups(spark):
    data = make(7)
    threshold = Fraction(6, 10)
    got = N.near_duplicate_groups(frame(spark, data), "pmid", F.col("text"), threshold, 3, 20).collect()
    texts = {(k, tuple(words(t))) for k, t in data if len(words(t)) >= 20}
    assert len(got) == len(texts)
    group = {}
    parent = {w: w for _, w in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {w: 0 for w in parent}
    sets = {w: {w[i : i + 3] for i in range(len(w) - 2)} for w in parent}
    names = list(parent)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if 10 * len(sets[x] & sets[y]) >= 6 * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    for w in names:
        group.setdefault(root(w), set()).add(w)
    assert sorted(r["n_links"] for r in got) == sorted(links[w] for _, w in texts)
    by = {}
    for r in got:
        by.setdefault(r["group_id"], set()).add(r["class_id"])
    assert sorted(map(len, by.values())) == sorted(map(len, group.values()))


def test_components_of_a_long_chain(spark):
    n = 60
    got = N.components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (102, 100)], "a long, b long"))
    assert rows(got) == sorted([(i, 0) for i in range(n + 1)] + [(100, 100), (101, 100), (102, 100)], key=repr)


def test_thresholds_cover_all_errors():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 40)
        pos = np.array(sorted(r.sample(range(80), n)))
        df = np.array([r.choice([2, 3, 50, 1000]) for _ in range(n)])
        cover = r.randint(1, n)
        probes = N.allocate(pos, df, cover)
        assert len(set(probes.tolist())) == cover == len(probes)


def test_sharing_a_third_of_all_rows(spark):
    r = random.Random(9)
    copy = " ".join(r.choice("abcdefgh") * 2 for _ in range(50))
    data = [(i, copy) for i in range(30)] + [(i, " ".join(f"z{r.randrange(999)}" for _ in range(40))) for i in range(30, 90)]
    got = N.near_duplicate_groups(frame(spark, data), "pmid", F.col("text"), Fraction(6, 10), 3, 20)
    assert got.select("class_id").distinct().count() == 61
    assert N.near_duplicate_pairs(frame(spark, data), "pmid", F.col("text"), Fraction(6, 10), 3, 20).count() == 30 * 29 // 2


def test_thresholds_are_the_cheapest():
    def cost(pos, df, chosen):
        group, total = {}, 0
        first = 0
        for i in range(len(pos)):  # partitions: runs of up to three neighbouring bits
            if i and (pos[i] != pos[i - 1] + 1 or i - first == 3):
                first = i
            group[i] = first
        for g in set(group.values()):
            own = [df[i] for i in chosen if group[i] == g]
            total += sum(own) + 4 * max(own, default=0)
        return total

    r = random.Random(1)
    for _ in range(100):
        n = r.randint(1, 9)
        pos, df = np.array(sorted(r.sample(range(16), n))), np.array([r.choice([2, 3, 5, 50]) for _ in range(n)])
        cover = r.randint(1, n)
        assert cost(pos, df, N.allocate(pos, df, cover)) == min(cost(pos, df, c) for c in itertools.combinations(range(n), cover))


def test_thresholds_of_a_very_long_text():
    n = 40_000
    got = N.allocate(np.arange(n), np.full(n, 2), 9_000)
    assert len(set(got.tolist())) == 9_000


def test_a_shingle_in_every_text(spark, monkeypatch):
    """Hot bits are indexed by size; texts made of boilerplate only have nothing else to probe."""
    monkeypatch.setattr(N, "HOT", 5)  # of the driver's closure, which the tasks get
    r = random.Random(11)
    boiler = [" ".join(r.choice(["the", "results", "of", "this", "study"]) for _ in range(9)) for _ in range(12)]
    data = [(i, " ".join(r.sample(boiler, r.randint(3, 7)))) for i in range(60)] + [(100 + i, "the results of this study " + " ".join(f"w{r.randrange(40)}" for _ in range(r.randint(20, 60)))) for i in range(60)]
    for threshold in (Fraction(6, 10), Fraction(9, 10), Fraction(1)):
        got = rows(N.near_duplicate_pairs(frame(spark, data), "pmid", F.col("text"), threshold, 3, 20))
        assert sorted(got) == brute(data, threshold, 3, 20) and (got or threshold > Fraction(6, 10))


def test_texts_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 50)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        data = make(3)
        got = rows(N.near_duplicate_pairs(frame(spark, data), "pmid", F.col("text"), Fraction(6, 10), 3, 20))
        assert sorted(got) == brute(data, Fraction(6, 10), 3, 20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
