import datetime as dt

from pyspark.sql import functions as F

from corpusloom.operators import orphans as O
from tests.conftest import rows

T = [dt.datetime(2024, m, 1) for m in range(1, 13)]
REFS = "child_id string, target_key string, as_of timestamp"
TARGETS = "target_key string, parent_id string, live_from timestamp, live_until timestamp"


def fk(spark, child, field, parent, refs, targets):
    return O.ForeignKey(child, field, parent, spark.createDataFrame(refs, REFS).withColumn("kind", F.lit("extra")), spark.createDataFrame(targets, TARGETS).withColumn("depth", F.lit(1)))


def test_life_spans(spark):
    targets = [("k", "k", T[2], T[5]), ("k", "k", T[7], None), ("open", "open", None, None), (None, "n", None, None)]
    refs = [("r1", "k", T[1]), ("r2", "k", T[2]), ("r3", "k", T[4]), ("r4", "k", T[5]), ("r5", "k", T[8]), ("r6", "k", None), ("r7", "gone", None), ("r8", None, T[1]), ("r9", "open", T[0]), ("r1", "k", T[1])]
    got = O.find_orphans([fk(spark, "c", "f", "p", refs, targets)])
    assert rows(got.select("child_id", "target_key", "kind", "depth")) == [("r1", "k", "direct", 0), ("r4", "k", "direct", 0), ("r7", "gone", "direct", 0)]


def test_cascade(spark):
    def keys(*ids):
        return [(i, i, None, None) for i in ids]

    graph = [
        fk(spark, "order", "customer", "customer", [("o1", "c1", T[0]), ("o2", "c9", T[0]), ("o3", "c9", T[1])], keys("c1")),
        fk(spark, "line", "order", "order", [("l1", "o1", T[0]), ("l2", "o2", T[0]), ("l3", "o8", T[0])], keys("o1", "o2", "o3")),
        fk(spark, "note", "line", "line", [("n1", "l1", T[0]), ("n2", "l2", T[0]), ("n3", "l3", T[2]), ("n3", "l2", T[2])], keys("l1", "l2", "l3")),
        fk(spark, "note", "reply", "note", [("n4", "n3", T[3]), ("n5", "n4", T[3]), ("n6", "n1", T[3]), ("n1", "n6", T[3])], keys("n1", "n2", "n3", "n4", "n5", "n6")),
    ]
    got = O.find_orphans(graph)
    assert rows(got.select("child", "child_id", "target_key", "kind", "depth")) == [
        ("line", "l2", "o2", "inherited", 1), ("line", "l3", "o8", "direct", 0), ("note", "n2", "l2", "inherited", 2), ("note", "n3", "l2", "inherited", 2), ("note", "n3", "l3", "inherited", 1),
        ("note", "n4", "n3", "inherited", 2), ("note", "n5", "n4", "inherited", 3), ("order", "o2", "c9", "direct", 0), ("order", "o3", "c9", "direct", 0),
    ]
    report = rows(O.orphan_report(got).select("table_name", "month", "kind", "n_references", "n_records"))
    assert ("order", "2024-01", "direct", 1, 1) in report and ("note", "2024-03", "inherited", 2, 1) in report


def test_cycle_of_orphans_ends(spark):
    graph = [fk(spark, "a", "f", "a", [("1", "2", None), ("2", "3", None), ("3", "1", None), ("1", "x", None)], [(i, i, None, None) for i in "123"])]
    assert rows(O.find_orphans(graph).select("child_id", "target_key", "kind")) == [("1", "2", "inherited"), ("1", "x", "direct"), ("2", "3", "inherited"), ("3", "1", "inherited")]


def test_empty(spark):
    assert O.find_orphans([fk(spark, "c", "f", "p", [], [("k", "k", None, None)])]).collect() == []
    assert len(O.find_orphans([fk(spark, "c", "f", "p", [("r", "k", None)], [])]).collect()) == 1
    assert O.orphan_report(O.find_orphans([fk(spark, "c", "f", "p", [], [])])).collect() == []


def test_evidence(spark):
    texts = ['["10", 11, 10]', "[]", None, "", "[ 007 ]", '["x", null, ""]', "not json", "[1,2"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "e string").select(O.evidence_keys("e")).collect()]
    assert got[0] == ["10", "11"] and got[1] == [] and got[2] is None and got[5] == ["x"]
    assert got[4] in (["7"], None) and not got[6]
