import random

from corpusloom.operators import corpus as C
from tests.conftest import rows

UP = C.SCHEMA + ", seq long"
ALL = ["pmid", *C.FIELDS]


def sequential(current, updates):
    """Row by row, as a store would do it."""
    docs = {r[0]: list(r[1:]) for r in current}
    for pmid, *new, _ in sorted(updates, key=lambda r: r[-1]):
        year, title, abstract, body, origin, cites = new
        old = docs.get(pmid)
        if title is None and abstract is None and body is None:
            if old:
                docs[pmid] = [n if n is not None else o for n, o in zip(new, old)]
            continue
        if old is None:
            docs[pmid] = [year, title or "", abstract or "", body or "", origin or "", cites or 0]
            continue
        merged = [n if n is not None else o for n, o in zip(new, old)]
        if [merged[i] for i in (0, 1, 2, 3, 5)] != [old[i] for i in (0, 1, 2, 3, 5)]:
            docs[pmid] = merged
    return sorted([(k, *v) for k, v in docs.items()], key=repr)


def test_upsert_against_sequential_store(spark):
    r = random.Random(2)
    pick = lambda *x: r.choice([None, *x])
    for _ in range(3):
        current = [(i, 2000 + i, f"t{i}", "a", "", "o", 1) for i in range(4)]
        updates = [(r.randrange(8), pick(2000, 2001), pick("t1", "t2"), pick("a", "b"), pick("", "c"), pick("o", "p"), pick(1, 5), s) for s in range(60)]
        docs, versions = C.upsert(spark.createDataFrame(current, C.SCHEMA), spark.createDataFrame(updates, UP))
        assert rows(docs.select(ALL)) == sequential(current, updates)
        assert versions.select("uuid").distinct().count() == versions.count()


def test_noop_and_empty(spark):
    current = spark.createDataFrame([(1, 2000, "t", "a", "", "o", 1)], C.SCHEMA)
    same = spark.createDataFrame([(1, 2000, "t", None, None, "elsewhere", None, 1)], UP)
    docs, versions = C.upsert(current, same)
    assert rows(docs.select(ALL + ["changed"])) == [(1, 2000, "t", "a", "", "o", 1, False)] and versions.count() == 0
    docs, versions = C.upsert(current.limit(0), same.limit(0))
    assert docs.count() == versions.count() == 0


def test_metadata(spark):
    d = spark.createDataFrame([(1, 999, None, None, None, "", -1), (2, 2100, None, None, None, "o", 10**9), (3, None, None, None, None, None, 10**9 + 1), (4, 99999, "", "", "", "o", None)], C.SCHEMA)
    assert rows(C.with_metadata(d).select("pmid", "year", "citations")) == [(1, 2100, 0), (2, 2100, 10**9), (3, None, 0), (4, 2100, 0)]
    assert rows(C.origins(d)) == [("o",)] and C.count_documents(d).first()[0] == 4 and C.count_documents(d, 2100, 2100).first()[0] == 3
    assert [tuple(r) for r in C.get_documents(d, [2, 9, 1, 2]).select("position", "pmid").collect()] == [(0, 2), (2, 1), (3, 2)]
    assert C.get_document(d, 77).collect() == [] and rows(C.delete_documents(d, [1, 2, 5]).select("pmid")) == [(3,), (4,)]


def test_partitioned_layout(spark, tmp_path):
    d = spark.createDataFrame([(5, 2000, "t", "a", "", "o", 1), (2_000_001, 2000, "t", "a", "", "o", 1)], C.SCHEMA)
    C.write_documents(d, str(tmp_path / "d"))
    back = spark.read.parquet(str(tmp_path / "d"))
    assert rows(back.select("pmid", "bucket")) == [(2_000_001, "documents_02m"), (5, "documents_00m")]
