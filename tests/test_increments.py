import datetime as dt
import uuid

import pytest

from corpusloom.operators import increments as I
from corpusloom.session import scratch
from tests.conftest import rows


@pytest.fixture
def tables(spark):
    return I.VersionedTable(spark, scratch(spark, "t")), I.VersionedTable(spark, scratch(spark, "s"))


def put(spark, data):
    return spark.createDataFrame(data, "id int, v string").coalesce(1)


def delta(spark, a, b):
    d = I.changes(spark, a, b)
    return [] if d is None else rows(d.select("id", "v", "change"))


def test_deltas(spark, tables):
    t, _ = tables
    assert t.latest().version == 0 and delta(spark, t.latest(), t.latest()) == []
    v1 = t.append(put(spark, [(1, "a"), (2, "b"), (3, "c"), (3, "c")]))
    assert delta(spark, I.Manifest(0), v1) == [(1, "a", "insert"), (2, "b", "insert"), (3, "c", "insert"), (3, "c", "insert")]
    v2 = t.delete_rows(t.read().where("id = 2"))
    assert delta(spark, v1, v2) == [(2, "b", "delete")] and delta(spark, v2, v1) == [(2, "b", "insert")]
    v3 = t.append(put(spark, [(2, "B")]))
    assert delta(spark, v1, v3) == [(2, "B", "insert"), (2, "b", "delete")]
    v4 = t.delete_rows(t.read().where("id = 1"))
    assert delta(spark, v2, v4) == [(1, "a", "delete"), (2, "B", "insert")]
    assert rows(t.read().select("id")) == [(2,), (3,), (3,)] and rows(t.read(1).select("id")) == [(1,), (2,), (3,), (3,)]
    v5 = t.overwrite(put(spark, [(9, "z")]))
    assert delta(spark, v4, v5) == [(2, "B", "delete"), (3, "c", "delete"), (3, "c", "delete"), (9, "z", "insert")]


def test_exactly_once_over_failures(spark, tables):
    source, sink = tables
    source.append(put(spark, [(1, "a"), (2, "b")]))
    keep = lambda d: d.select("id", "v", "change")
    I.process_new(source, sink, keep)
    source.append(put(spark, [(3, "c")]))

    def broken(d):
        d.count()
        raise OSError("executor lost")

    with pytest.raises(OSError):
        I.process_new(source, sink, broken)
    orphan = f"{sink.root}/data-{uuid.uuid4().hex}"
    put(spark, [(3, "c")]).write.parquet(orphan)  # output of a run that died before its commit
    assert sink.latest().processed == 1
    I.process_new(source, sink, keep)
    assert I.process_new(source, sink, keep).version == 2  # nothing new: nothing written
    assert rows(sink.read().select("id", "change")) == [(1, "insert"), (2, "insert"), (3, "insert")]
    assert sink.latest().processed == 2


def test_concurrent_commits(spark, tables):
    t, _ = tables
    t.append(put(spark, [(1, "a")]))
    with pytest.raises(I.CommitConflict):
        t.commit(I.Manifest(1, {}))


def test_clashing_columns(spark, tables):
    t, _ = tables
    t.append(spark.createDataFrame([(1, "x", 7, "m")], "id int, file_path string, row_index int, _metadata string"))
    r = t.read().first()
    assert r["id"] == 1 and r["row_index"] == 0 and r["file_path"] != "x" and r["_metadata"] == "m"


NOW = dt.datetime(2024, 5, 1)
DAY = dt.timedelta(days=1)
VERSION = "uuid string, is_indexed int, seq long, changed_at timestamp, run_id long, change string"
RUN = "run_id long, attempt int, status string, started_at timestamp, finished_at timestamp"


def write(spark, data):
    out = scratch(spark, "versions")
    spark.createDataFrame(data, VERSION).repartition(2).write.parquet(out)
    return out


def test_state_delta(spark):
    runs = [(1, 1, "failed", NOW, None), (1, 2, " Finished ", NOW, None), (2, 1, "finished", NOW, NOW), (2, 2, "started", NOW, None), (3, 1, None, NOW, None), (4, 1, "finished", None, None), (1, 2, " Finished ", NOW, None), (None, 9, "finished", NOW, NOW)]
    data = [
        ("taken", 1, 1, NOW - DAY, 1, "x"), ("taken", 1, 1, NOW - DAY, 1, "x"), ("changed", 1, 1, NOW + DAY, 1, "x"), ("same time", 1, 1, NOW, 1, ""), ("last attempt open", 1, 1, NOW - DAY, 2, ""), ("no status", 1, 1, NOW - DAY, 3, ""),
        ("no start", 1, 1, NOW - DAY, 4, ""), ("unknown run", 1, 1, NOW, 99, ""), ("no run", 1, 1, NOW, None, ""), ("new", 0, 1, NOW, None, ""), ("null state", None, 1, NOW, None, ""), ("no time", 1, 1, None, 1, ""),
        ("again", 1, 1, NOW - DAY, 1, ""), ("again", 0, 2, NOW, None, ""), ("went", 0, 1, NOW, None, ""), ("went", 1, 2, NOW, None, ""), (None, 0, 1, NOW, None, ""),
    ]
    got = rows(I.state_delta(spark, write(spark, data), spark.createDataFrame(runs, RUN)))
    inserts = {u for u, _, c in got if c == "insert"}
    assert inserts == {"changed", "last attempt open", "no status", "no start", "unknown run", "new", "null state", "no time", "again"}
    assert sum(c == "insert" for *_, c in got) == len(inserts)
    assert {(u, s) for u, s, c in got if c == "delete" and u == "again"} == {("again", 1)}


def test_state_delta_of_empty_tables(spark):
    empty = spark.createDataFrame([], RUN)
    assert I.state_delta(spark, write(spark, []), empty).collect() == []
    assert [r["uuid"] for r in I.state_delta(spark, write(spark, [("a", 0, 1, NOW, 5, "")]), empty).collect()] == ["a"]


def test_rows_replaced_in_one_commit(spark, tables):
    t, _ = tables
    v1 = t.append(put(spark, [(1, "a"), (2, "b")]))
    v2 = t.replace_rows(t.read().where("id = 2"), put(spark, [(2, "B"), (3, "c")]), linked={"other": 4})
    assert delta(spark, v1, v2) == [(2, "B", "insert"), (2, "b", "delete"), (3, "c", "insert")] and v2.linked == {"other": 4}
    v3 = t.append(put(spark, [(9, "z")]), base=v1)
    assert rows(t.read().select("id", "v")) == [(1, "a"), (2, "b"), (9, "z")] and v3.version == 3
    t.replace_rows(None, put(spark, [(5, "e")]))
    assert t.read().count() == 4


def test_commits_need_a_put_where_renaming_is_none(spark, tables, monkeypatch):
    t, _ = tables
    monkeypatch.setattr(I, "RENAMES", {"hdfs"})
    with pytest.raises(NotImplementedError):
        t.append(put(spark, [(1, "a")]))
    store = {}
    u = I.VersionedTable(spark, t.root, lambda path, content: store.setdefault(path, content) is content)
    u.append(put(spark, [(1, "a")]))
    with pytest.raises(I.CommitConflict):  # another writer's manifest of the same version is there
        u.append(put(spark, [(2, "b")]))
    assert len(store) == 1
