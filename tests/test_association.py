import itertools
import random

import pytest

from corpusloom.functions.stats import hypergeometric_tail
from corpusloom.operators import association as A
from corpusloom.operators import knowledge
from corpusloom.operators.search import search
from tests.conftest import rows

WORDS = ["ant", "bee", "cat", "dog", "eel", "fox"]
DOCS = "pmid long, pub_year int, title string, abstract string, body string, origin string, citation_count long"


@pytest.fixture(scope="module")
def data():
    r = random.Random(5)
    return [(i, r.choice([None, 1990, 2000, 2010, 99999]), r.choice([None, "", " ".join(r.choices(WORDS, k=3))]), " ".join(r.choices(WORDS, k=r.randint(0, 9))), "ant", "o", r.choice([None, -1, 3, 50])) for i in range(1, 121)]


@pytest.fixture(scope="module")
def corpus(spark, data):
    return A.Corpus(spark.createDataFrame(data, DOCS))


def has(doc, phrase):
    return any(f" {phrase} " in f" {t or ''} " for t in doc[2:4])


def year(doc):
    return doc[1] if doc[1] is None or 1000 <= doc[1] <= 2100 else 2100


def test_search_against_brute_force(spark, data, corpus):
    terms = ["ant", "ant bee", "ant bee cat", "ant ant ant", "fox eel", "(ant bee | cat)&dog", "ant&zebra", "ant|zebra", " ".join(["ant"] * 21), " ".join(["ant"] * 21) + "|bee"]
    rule = [lambda d, t=t: has(d, t) for t in terms[:5]] + [lambda d: (has(d, "ant bee") or has(d, "cat")) and has(d, "dog"), lambda d: False, lambda d: has(d, "ant"), lambda d: False, lambda d: has(d, "bee")]
    got = rows(search(corpus.docs, terms))
    assert got == sorted(((k, d[0]) for k, f in enumerate(rule) for d in data if f(d)), key=repr)
    some = rows(search(corpus.docs, ["ant"], 1995, 2100))
    assert some == sorted(((0, d[0]) for d in data if has(d, "ant") and year(d) and year(d) >= 1995), key=repr)
    assert search(corpus.docs, ["", "&"]).collect() == [] and search(corpus.docs.limit(0), ["ant"]).collect() == []


def counts(data, x, y):
    k, a, b = (sum(1 for d in data if f(d)) for f in (lambda d: has(d, x) and has(d, y), lambda d: has(d, x), lambda d: has(d, y)))
    return k, a, b, hypergeometric_tail(k, a, b, len(data))


def test_pairs(data, corpus):
    a, b = ["ant", "bee cat", "zebra"], ["dog", "zebra", "dog", "eel"]
    out = A.associate(corpus, A.Params(a, b)).collect()
    assert len(out) == 12
    assert [(-r["ab_pred_score"], r["b_index"], r["a_index"]) for r in out] == sorted((-r["ab_pred_score"], r["b_index"], r["a_index"]) for r in out)
    for r in out:
        k, na, nb, p = counts(data, r["a_term"], r["b_term"])
        assert (r["ab_count"], r["a_count"], r["b_count"], r["total_count"]) == (k, na, nb, len(data))
        assert r["ab_pvalue"] == pytest.approx(p) and r["ab_sort_ratio"] == (k / nb if nb else 0.0) and r["ab_pmid_intersection"] is None


def test_paired_and_top_articles(data, corpus):
    p = A.Params(["ant", "bee"], ["cat", "dog"], paired=True, return_pmids=True, top_n_articles_most_recent=2, top_n_articles_most_cited=2, top_n_articles_highest_impact_factor=1, as_of_year=2020)
    for r in A.associate(corpus, p).collect():
        both = [(year(d) or 0, d[6] if d[6] and 0 <= d[6] else 0, d[0]) for d in data if has(d, r["a_term"]) and has(d, r["b_term"]) ]
        want = {x[2] for x in sorted(both, key=lambda x: (x[0], x[2]))[-2:]} | {x[2] for x in sorted(both, key=lambda x: (x[1], x[2]))[-2:]}
        known = [x for x in both if x[0]]
        want |= {x[2] for x in sorted(known, key=lambda x: (x[1] / (2020 - x[0] + 0.5), x[2]))[-1:]}
        assert r["ab_pmid_intersection"] == sorted(want)


@pytest.mark.parametrize(("top", "valid"), [(2, 1.0), (1, 0.4), (2, 0.2), (50, 1.0)])
def test_chains(data, corpus, top, valid):
    a, b, c = "ant", ["bee", "cat", "dog", "zebra", "eel", "bee"], ["fox", "eel", "zebra"]
    p = A.Params([a], b, c, top_n_ab=top, ab_fet_threshold=0.95, bc_fet_threshold=0.9, valid_bc_hit_pval=valid)
    got = [(r["b_term"], r["c_term"], round(r["bc_pvalue"], 9), r["ac_count"]) for r in A.associate(corpus, p).collect()]

    def score(x, y):
        import math

        k, na, nb, q = counts(data, x, y)
        r = k / nb if nb else 0.0
        return (min(323, -math.log10(q)) + (323 if r == 1 else min(323, -2500 * math.log10(1 - r)))) / 323, q

    ab = sorted([(-score(a, y)[0], j, y) for j, y in enumerate(b) if score(a, y)[1] <= 0.95])
    first = ab[: top + (20 if valid < 1 else 0)]
    chains = [(-score(y, z)[0], i, rank, y, z) for i, z in enumerate(c) for rank, (_, _, y) in enumerate(first) if score(y, z)[1] <= 0.9]
    if valid < 1:
        good = {x[3] for x in chains if score(x[3], x[4])[1] <= valid}
        keep = set([y for *_, y in ab if y in good][:top])
        chains = [x for x in chains if x[3] in keep]
    assert got == [(y, z, round(score(y, z)[1], 9), counts(data, a, z)[0]) for *_, y, z in sorted(chains)]


def test_paired_chains(data, corpus):
    p = A.Params(["ant", "bee", "cat"], ["cat", "dog", "ant"], ["dog", "eel", "fox"], paired=True, ab_fet_threshold=1.0, bc_fet_threshold=1.0)
    assert {(r["a_term"], r["b_term"], r["c_term"]) for r in A.associate(corpus, p).collect()} == {("ant", "cat", "dog"), ("bee", "dog", "eel"), ("cat", "ant", "fox")}


def test_validation():
    bad = [dict(a_terms=[]), dict(b_terms=[]), dict(censor_year_lower=2001, censor_year_upper=2000), dict(a_terms=["x"] * 101), dict(paired=True, b_terms=["a", "b"]), dict(c_terms=["c"], a_terms=["a", "b"]), dict(c_terms=["c"], top_n_ab=0), dict(scoring="t")]
    for b in bad:
        with pytest.raises(A.UserError):
            A.Params(**({"a_terms": ["a"], "b_terms": ["b"]} | b)).validated()
    p = A.Params.of({"a_terms": ["a"], "b_terms": ["b"], "censor_year": 3000, "top_n": 7, "top_n_articles": 3}).validated()
    assert (p.censor_year_lower, p.censor_year_upper, p.top_n_ab, p.top_n_articles_most_cited) == (1000, 2100, 7, 3)


EDGE = "head string, head_type string, relation string, tail string, tail_type string, evidence string, source string"


def test_edges(spark, data, corpus):
    raw = spark.createDataFrame([("Ant_1", "A", "R", "bee", "B", '["1", 2, 3]', "s"), ("bee", "B", "Q", "ant 1", "A", "[200]", "s"), ("bee", None, "Q", "bee", "B", None, "s"), ("bee", "B", "Q", "ant 1", "A", "[200]", "s"), (None, "B", "Q", "x", "A", "[]", None)], EDGE)
    edges = knowledge.load_edges(raw)
    pairs = spark.createDataFrame([("ant-1", "BEE"), ("bee", "bee"), ("x", "y"), (None, "bee")], "a string, b string")
    got = rows(knowledge.between(edges, pairs).select("a", "b", "a_term", "relationship", "pmids"))
    assert got == sorted([("ant-1", "BEE", "ant 1", "R", [1, 2, 3]), ("ant-1", "BEE", "bee", "Q", [200]), ("ant-1", "BEE", "bee", "Q", [200]), ("bee", "bee", "bee", "Q", [])], key=repr)
    years = {d[0]: year(d) for d in data}
    want = [k for k in (1, 2) if years[k] and 1995 <= years[k] <= 2100]
    got = rows(knowledge.between(edges, pairs, corpus.docs, 1995, 2100, cap=2).select("relationship", "pmids"))
    assert got == ([("R", want)] if want else [])
    withkg = A.Corpus(corpus.docs, None, edges)
    p = A.Params(["bee", "ant"], ["bee", "cat"], query_knowledge_graph=True, rel_pvalue_cutoff=0.5)
    for r in A.associate(withkg, p).collect():
        assert (r["ab_relationship"] is None) == (r["ab_pvalue"] > 0.5)


def test_all_pairs_are_kept_without_documents(corpus):
    assert len(A.associate(A.Corpus(corpus.docs.limit(0)), A.Params(["a"], ["b", "c"])).collect()) == 2
    assert list(itertools.islice(A.Params(["a"], ["b"]).ALIASES, 1)) == ["censor_year"]
