"""Registered queries use all rows of their tables: small tables in which a part of the rows gives another result."""

from pyspark.sql import functions as F

from corpusloom.operators import index, knowledge
from corpusloom.plans import engine
from tests.conftest import rows

DOC = "uuid string, is_indexed int, pmid long, pub_year int, title string, abstract string, body string, origin string, citation_count long"


def save(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")


def doc(pmid, year=2000, title="t", abstract="a", origin="f", citations=0, indexed=1):
    return (f"u{pmid}", indexed, pmid, year, title, abstract, "", origin, citations)


def test_files_of_any_indexed_document_are_done(spark, tmp_path):
    names = [f"feed22n{i:04}" for i in (1, 2, 3, 20, 21)]
    save(spark, tmp_path, "document_versions", [(n,) for n in [*names, names[0], "", None]], "origin string")
    save(spark, tmp_path, "canonical_documents", [doc(7, origin=names[0]), doc(8, origin=names[1]), doc(9, origin=names[3]), doc(10, origin=names[2], indexed=0), doc(11, origin=None)], DOC)
    assert rows(engine.file_anti_join(spark, str(tmp_path))) == [(names[2], "baseline"), (names[4], "update")]


def test_every_version_is_applied_as_an_update(spark, tmp_path):
    versions = [(1, 1990, 2), (1, 1991, 6), (1, 1992, 8), (1, 1993, 9), (2, 1994, 1014), (2, None, 1020), (2, 1995, 1010), (2, 1995, 1010)]
    save(spark, tmp_path, "document_versions", [(p, y, "new", "new", "new", "f", 5, s) for p, y, s in versions], "pmid long, pub_year int, title string, abstract string, body string, origin string, citation_count long, seq long")
    save(spark, tmp_path, "canonical_documents", [doc(1), doc(2), doc(3, citations=4)], DOC)
    assert rows(engine.upsert_partial(spark, str(tmp_path))) == [(1, 1991, "t", 8, False), (2, 1994, "t", 20, False), (3, 2000, "t", 4, False)]


EDGE = "rel_id long, head string, head_type string, relation string, tail string, tail_type string, evidence string, source string"


def test_evidence_behind_the_third_place_counts_within_the_years(spark, tmp_path):
    late = str(list(range(1001, 1100)) + [2, 3])
    save(spark, tmp_path, "relationships", [(1, "tyvi1", "G", "r", "tyvurdolib acetate", "D", "[90, 91, 92, 1]", "s"), (2, "vimi9", "G", "r", "tyvi1", None, '["1", 90, 2, 2, 3]', "s"), (3, "vimi9", "G", "q", "tyvi1", "G", late, "s"), (4, "vimi9", "G", "p", "tyvi1", "G", "[90, 91]", "s")], EDGE)
    save(spark, tmp_path, "canonical_documents", [*[doc(p) for p in (1, 2, 3)], *[doc(p, year=2020) for p in (90, 91, 92)]], DOC)
    found = engine.kg_relationships_censored(spark, str(tmp_path)).select("a", "relationship", "b_type", "pmids")
    assert rows(found) == [("tyvi1", "r", "D", [1]), ("vimi9", "q", "G", [2]), ("vimi9", "r", None, [1, 2, 3])]  # of the 101 pmids the last is not looked at


def test_a_small_cap_comes_before_the_years(spark):
    edges = knowledge.load_edges(spark.createDataFrame([("x", "A", "r", "y", "B", "[90, 1, 2]", "s")], EDGE.removeprefix("rel_id long, ")))
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    docs = spark.createDataFrame([doc(1), doc(2), doc(90, year=2020)], DOC)
    got = {cap: [r["pmids"] for r in knowledge.between(edges, pairs, docs, 1990, 2009, cap=cap).collect()] for cap in (1, 2, 3)}
    assert got == {1: [], 2: [[1]], 3: [[1, 2]]}


def test_edges_without_types_are_written_and_read(spark, tmp_path):
    data = [(1, "a", "G", "r", "b", "D", "[1, 2]", "s"), (2, "a", None, "r", "b", "D", '["1", 2, 3]', "s"), (3, "a", "G", "r", "b", None, "[4, 5]", "s"), (4, None, None, "q", None, None, "[6, 7]", "s"), (5, "a", None, "r", "b", None, "[8]", "s"), (6, "a", "G", "r", "b", "D", None, "s")]
    save(spark, tmp_path, "relationships", data, EDGE)
    assert rows(engine.kg_tsv_ingest(spark, str(tmp_path))) == [("q", 1, 2), ("r", 3, 7)]


def test_only_new_and_changed_documents_are_indexed_again(spark, tmp_path, monkeypatch):
    versions = [(1, "same", "text", 1), (1, "other", "text", 2), (2, "old", "text", 3), (3, None, "text", 4), (4, None, "text", 5)]
    save(spark, tmp_path, "document_versions", versions, "pmid long, title string, abstract string, seq long")
    save(spark, tmp_path, "canonical_documents", [doc(1, title="same", abstract="text"), doc(2, title="new", abstract="text"), doc(3, title=None, abstract="text"), doc(4, title="title", abstract="text"), doc(5, title="fresh", abstract=None), doc(6, title=None, abstract=None)], DOC)
    given, reindex = [], index.reindex
    monkeypatch.setattr(index, "reindex", lambda old, changed: given.append(changed) or reindex(old, changed))
    got = rows(engine.reindex_incremental(spark, str(tmp_path)))
    assert sorted(r["pmid"] for r in given[0].collect()) == [2, 4, 5, 6]
    new = index.build_postings(engine.docs(spark, str(tmp_path))).groupBy("ngram").agg(F.count("*"), F.count_distinct("pmid"))
    assert got == rows(new) and ("new", 1, 1) in got and not any(r[0] == "old" for r in got)
