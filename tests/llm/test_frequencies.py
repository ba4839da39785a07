import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import frequencies as Q
from tests.conftest import rows


def pairs(seed):
    r = random.Random(seed)
    return [(r.choice(["f", "g"]), r.choice(["hot"] * 8 + ["", None] + [f"t{i}" for i in range(300)]), r.randrange(60), r.randint(1, 3), 1) for _ in range(3000)]


def brute(data):
    occ, rec = Counter(), defaultdict(set)
    for f, t, r, o, _ in data:
        if t is not None:
            occ[f, t] += o
            rec[f, t].add(r)
    return sorted(((f, t, n, len(rec[f, t])) for (f, t), n in occ.items()), key=repr)


@pytest.mark.parametrize("leaf_bytes", [1 << 30, 2500])
def test_pairs_against_brute_force(spark, leaf_bytes):
    data = pairs(1)
    df = spark.createDataFrame(data, Q.SPILL_SCHEMA).withColumn("digit", F.lit(3)).withColumn("path", F.lit("p"))
    assert rows(Q.term_frequencies(df, leaf_bytes)) == brute(data)


def test_words_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "...", "A_b a-B Ä ½ 日本語 " + "z " * 30_000] + [" ".join(r.choices(["the", "The", "x1", "µg"], k=r.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([(t, "x") for t in texts], "body string, term string").repartition(3)
    occ, rec = Counter(), Counter()
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        occ.update(w)
        rec.update(set(w))
    assert rows(Q.term_frequencies(Q.count_words(df, "body", "f"))) == sorted((("f", t, n, rec[t]) for t, n in occ.items()), key=repr)


def test_handing_on_in_between(spark, monkeypatch):
    monkeypatch.setattr(Q, "TERMS_HELD", 2)  # of the driver's closure, which the tasks get
    df = spark.createDataFrame([(f"a b{i} c",) for i in range(50)], "t string").coalesce(1)
    got = {r["term"]: r["records"] for r in Q.term_frequencies(Q.count_words(df, "t", "f")).collect()}
    assert got["a"] == got["c"] == 50 and len(got) == 52


def test_both_kinds_of_rows_add_up(spark):
    data = [("f", "t", 1, 2, 1), ("f", "t", 1, 1, 1), ("f", "t", 2, 1, 1), ("f", "t", None, 10, 4), ("f", "t", None, 5, 3)]
    assert rows(Q.term_frequencies(spark.createDataFrame(data, Q.SPILL_SCHEMA))) == [("f", "t", 19, 9)]


def test_empty(spark):
    assert Q.term_frequencies(spark.createDataFrame([], Q.SPILL_SCHEMA)).collect() == []
    assert Q.term_frequencies(Q.count_words(spark.createDataFrame([], "t string"), "t", "f")).collect() == []


def test_marks(spark):
    df = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 9, 9), ("f", "c", 5, 5), ("g", "a", 1, 1)], "field_name string, term string, occurrences long, records long")
    assert [r["mark"] for r in Q.marked(df, {"f": 2}, {"f": 9}).orderBy("field_name", "term").collect()] == ["rare", "common", None, None]
    assert Q.marked(df, {"f": 9}, {"f": 1}).where("mark = 'common'").count() == 0


def test_leaves_that_spark_reads(spark, monkeypatch):
    monkeypatch.setattr(Q, "_local", lambda path: None)  # as if the shared folder were an object store
    data = pairs(3)
    assert rows(Q.term_frequencies(spark.createDataFrame(data, Q.SPILL_SCHEMA), 2500, 4)) == brute(data)


def test_levels_and_writers(spark, monkeypatch):
    spill, levels = Q._spill, []

    def seen(rows, level, bits, by_record):
        parts = spill(rows, level, bits, by_record)
        levels.append((level, bits, {d: n for d, (_, n) in parts.items()}))
        return parts

    monkeypatch.setattr(Q, "_spill", seen)
    data = [("f", "hot", i, 1, 1) for i in range(6000)] + [("f", f"t{i}", None, i + 1, 1) for i in range(3000)] + [("f", "same", 1, 1, 1)] * 500
    df = spark.createDataFrame(data, Q.SPILL_SCHEMA)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in Q.term_frequencies(df, 4000, 4).collect()}
    assert got["hot"] == (6000, 6000) and got["same"] == (500, 1) and got["t7"] == (8, 1) and len(got) == 3002
    assert len(levels) > 2 and levels[0][:2] == (0, 4)  # term, term again, then the record of the hot term's part
    with pytest.raises(ValueError):
        Q.term_frequencies(df, 0)


def test_rows_without_a_record_are_written_by_many_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.createDataFrame([("f", f"t{i}", None, 1, 1) for i in range(4000)], Q.SPILL_SCHEMA).withColumn("part", F.lit(""))
        parts = Q._spill(df, 0, 4, F.lit(False))
        import glob

        files = {d: len(glob.glob(Q._local(path) + "/*.parquet")) for d, (path, _) in parts.items()}
        assert len(files) == 16 and sum(files.values()) > 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
