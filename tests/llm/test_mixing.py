import random
from collections import defaultdict

import pytest

from corpusloom.llm import mixing as M

TARGET = "mix_plan string, source string, target_share double, max_repeats int, rate string"
DOC = "doc long, source string, n_tokens long, uid int, bucket string, copies int"


def docs(spark, data):
    return spark.createDataFrame([(*x, 1, "b", 2) for x in data], DOC)


def targets(spark, data):
    return spark.createDataFrame([(*x, "r") for x in data], TARGET)


def sample(seed=1):
    r = random.Random(seed)
    n = {"web": 3000, "books": 60, "rare": 25, "hot": 2500}
    return [(i, s, 40 if s == "hot" and r.random() < 0.9 else max(0, int(r.lognormvariate(5 if s != "books" else 8, 1)))) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]


def test_shares_and_caps(spark):
    data = sample()
    plan = [("p", "web", 0.5, 1), ("p", "books", 0.3, 4), ("p", "hot", 0.2, 2), ("q", "rare", 0.1, 8), ("q", "web", 0.9, 1), ("r", "rare", 0.5, 3), ("r", "gone", 0.5, 9)]
    t = targets(spark, plan)
    mixed = M.mix(docs(spark, data), "doc", t)
    assert mixed.columns == ["mix_plan", "doc", "source", "n_tokens", "copies"]
    size, source = {d: n for d, _, n in data}, {d: s for d, s, _ in data}
    used = defaultdict(dict)
    for r in mixed.collect():
        assert r["source"] == source[r["doc"]] and r["n_tokens"] == size[r["doc"]] and r["doc"] not in used[r["mix_plan"]]
        used[r["mix_plan"]][r["doc"]] = r["copies"]
    all_tokens = defaultdict(int)
    for _, s, n in data:
        all_tokens[s] += n
    for p, goal in {"p": {"web": 0.5, "books": 0.3, "hot": 0.2}, "q": {"rare": 0.1, "web": 0.9}, "r": {"rare": 1.0}}.items():
        cap = {s: m for x, s, _, m in plan if x == p}
        best = min(cap[s] * all_tokens[s] / g for s, g in goal.items())
        got = defaultdict(int)
        for d, c in used[p].items():
            assert 1 <= c <= cap[source[d]]
            got[source[d]] += c * size[d]
        for s, g in goal.items():
            assert got[s] == pytest.approx(g * best, abs=60), (p, s)
    report = {(r["mix_plan"], r["source"]): r for r in M.share_report(mixed, t).collect()}
    assert len(report) == len(plan) and report["r", "gone"]["reached_share"] == 0.0 and report["r", "rare"]["reached_share"] == 1.0
    assert report["q", "rare"]["most_copies"] <= 8


def test_total_and_lengths(spark):
    data = sample(2)
    total = 40_000
    mixed = M.mix(docs(spark, data), "doc", targets(spark, [("p", "web", 1.0, 3)]), total_tokens=total).collect()
    assert sum(r["copies"] * r["n_tokens"] for r in mixed) == pytest.approx(total, abs=20)
    mean = sum(n for _, s, n in data if s == "web") / 3000
    assert total / sum(r["copies"] for r in mixed) == pytest.approx(mean, rel=0.25)  # neither short nor long ones only


def test_solver_reaches_its_constraints(spark):
    hist = spark.createDataFrame([("s", 10, 100), ("s", 50, 20), ("s", 1000, 3), ("one", 7, 5)], "source string, n_tokens long, docs long")
    for ratio in (0.01, 0.5, 1.0, 20.0):
        plans = [{"mix_plan": "p", "source": s, "docs": d, "tokens": t, "wanted": t * ratio} for s, d, t in (("s", 123, 5000), ("one", 5, 35))]
        dual = M.balance(hist, plans)
        import math

        for s, cells, want in (("s", [(10, 100), (50, 20), (1000, 3)], 5000 * ratio), ("one", [(7, 5)], 35 * ratio)):
            a, b, mean = dual["p", s]
            assert sum(d * n * math.exp(a + b * n / mean) for n, d in cells) == pytest.approx(want, rel=1e-6)


def test_edge_cases(spark):
    odd = [(None, "s", 5), (None, "s", 5), (1, "s", 5), (1, "s", None), (2, None, 5), (3, "z", 0), (4, "s", 5)]
    plan = [("p", "s", 0.6, 2), ("p", "s", 0.6, 2), ("p", "z", 0.4, 3), ("p", None, 1.0, 1), (None, "s", 1.0, 1), ("p", "n", None, 1), ("p", "m", -1.0, 1), ("q", "s", 1.0, None), ("x", "s", 1.0, 0)]
    got = M.mix(docs(spark, odd), "doc", targets(spark, plan)).collect()
    assert {r["mix_plan"] for r in got} == {"p", "q"}
    assert sum(r["copies"] * r["n_tokens"] for r in got if r["mix_plan"] == "p") == 40 and sum(r["copies"] * r["n_tokens"] for r in got if r["mix_plan"] == "q") == 20
    assert M.mix(docs(spark, []), "doc", targets(spark, plan)).collect() == [] and M.mix(docs(spark, odd), "doc", targets(spark, [])).collect() == []
    assert M.share_report(M.mix(docs(spark, []), "doc", targets(spark, plan)), targets(spark, plan)).count() == 6


def test_rates_are_tilted_and_keep_the_number_of_copies(spark):
    hist = spark.createDataFrame([("s", 10, 100), ("s", 50, 20), ("s", 1000, 3), ("t", 7, 50), ("t", 300, 5)], "source string, n_tokens long, docs long")
    plans = [{"mix_plan": "p", "source": s, "docs": d, "tokens": t, "wanted": t * w, "max_repeats": 4} for s, d, t, w in (("s", 123, 5000, 0.4), ("t", 55, 1850, 2.5))]
    dual = M.balance(hist, plans)
    import math

    rate = {(r["source"], r["n_tokens"]): min(4.0, math.exp(dual["p", r["source"]][0] + dual["p", r["source"]][1] * r["n_tokens"] / dual["p", r["source"]][2])) for r in hist.collect()}
    docs = {(r["source"], r["n_tokens"]): r["docs"] for r in hist.collect()}
    for s, want in (("s", 2000.0), ("t", 4625.0)):
        assert sum(rate[k] * docs[k] * k[1] for k in rate if k[0] == s) == pytest.approx(want, rel=1e-6)
    assert sum(rate[k] * docs[k] for k in rate) == pytest.approx(0.4 * 123 + 2.5 * 55, rel=1e-6)
    assert rate["s", 10] > rate["s", 1000] * 1.5 and rate["t", 300] > rate["t", 7] * 1.1  # fewer long ones of the source above its share, more of the other


def test_one_source_of_many_lengths_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 50)
    monkeypatch.setattr(M, "SPAN", 16)
    monkeypatch.setattr(M, "REPAIRED", 2)
    data = [(i, "one", 1 + i * i % 997) for i in range(3000)] + [(5000 + i, "two", 100) for i in range(700)]
    t = targets(spark, [("p", "one", 0.3, 2), ("p", "two", 0.7, 9)])
    got = M.mix(docs(spark, data), "doc", t).collect()
    of = defaultdict(int)
    for r in got:
        of[r["source"]] += r["copies"] * r["n_tokens"]
        assert 1 <= r["copies"] <= (2 if r["source"] == "one" else 9)
    total = sum(of.values())
    assert of["one"] / total == pytest.approx(0.3, abs=1e-4) and of["two"] == 630_000
    every = {k: [r["copies"] for r in got if r["source"] == k] for k in ("one", "two")}
    assert len(every["two"]) == 700 and set(every["two"]) == {9}
    by_length = defaultdict(set)
    for i, s, n in data:
        by_length[s, n].add(next((r["copies"] for r in got if r["doc"] == i), 0)) if s == "one" and i < 300 else None
    assert all(max(v) - min(v) <= 1 for v in by_length.values())
