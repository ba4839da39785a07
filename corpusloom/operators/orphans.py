"""References to records that do not exist: direct orphans, and orphans inherited down the foreign-key graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Bounds that stand for an unknown time.
EVER, NEVER = "timestamp'0001-01-01 00:00:00'", "timestamp'9999-12-31 00:00:00'"


@dataclass(frozen=True)
class ForeignKey:
    """One edge of the graph.

    refs: child_id string, target_key string, as_of timestamp; one row per reference, repeats count once.
    targets: target_key string, parent_id string, live_from timestamp, live_until timestamp; NULL for no bound.
    parent_id is the child_id under which the parent's own references are listed.
    """

    child: str
    field: str
    parent: str
    refs: DataFrame
    targets: DataFrame


def _shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def _there() -> F.Column:
    return (F.coalesce("t.live_from", F.expr(EVER)) <= F.coalesce("r.as_of", F.expr(NEVER))) & (F.col("t.live_until").isNull() | (F.col("t.live_until") > F.coalesce("r.as_of", F.expr(NEVER))))


def references(fk: ForeignKey) -> DataFrame:
    return _shape(fk.refs, ["child_id", "target_key", "as_of"]).where(F.col("target_key").isNotNull()).distinct()


def direct_orphans(fk: ForeignKey) -> DataFrame:
    """(child_id, target_key, as_of) of the references without a target that is live at as_of.

    A target is there if live_from is not after as_of and live_until is NULL or after it. A NULL as_of means now: only
    targets without live_until are there. A NULL target_key refers to nothing and is no orphan. One anti-join on the
    key: the optimizer broadcasts small targets by their measured size and otherwise sorts both sides, splitting hot
    keys of the references; a target's side holds the few life spans of a key.
    """
    return references(fk).alias("r").join(_shape(fk.targets, ["target_key", "live_from", "live_until"]).alias("t"), (F.col("r.target_key") == F.col("t.target_key")) & _there(), "left_anti")


def find_orphans(graph: Sequence[ForeignKey]) -> DataFrame:
    """(child, field_name, parent, child_id, target_key, as_of, kind, depth) of every orphan reference of the graph.

    kind is 'direct' if the target is missing and 'inherited' if a live target is itself an orphaned record: one with at
    least one orphan reference. The cascade runs round by round, each semi-joining the references with the records that
    became orphans in the round before (written to the shared folder), until a round finds none; cycles end because a
    record becomes an orphan once. depth is 0 for direct orphans, else the round. A graph in which no table is both child
    and parent needs no round. Empty tables give no rows or, as targets, make every reference a direct orphan.
    """
    names = {(fk.child, fk.parent) for fk in graph}
    direct = [_tag(direct_orphans(fk), fk, "direct", 0) for fk in graph]
    found = direct[0]
    for d in direct[1:]:
        found = found.unionByName(d)
    parents = {p for _, p in names}
    if not any(c in parents for c, _ in names):
        return found
    found = materialize(found, "orphans-0")
    done = new = materialize(found.select("child", "child_id").distinct(), "orphaned-0")
    rounds = 0
    while True:
        reached = {r[0] for r in new.select("child").distinct().collect()}  # names of tables of the graph
        edges = [fk for fk in graph if fk.parent in reached]
        if not edges:
            return found
        rounds += 1
        parts = []
        for fk in edges:
            bad = new.where(F.col("child") == fk.parent).select(F.col("child_id").alias("parent_id"))
            targets = _shape(fk.targets, ["target_key", "parent_id", "live_from", "live_until"]).join(bad, "parent_id", "left_semi")
            hit = references(fk).alias("r").join(targets.alias("t"), (F.col("r.target_key") == F.col("t.target_key")) & _there(), "left_semi")
            parts.append(_tag(hit, fk, "inherited", rounds))
        step = parts[0]
        for p in parts[1:]:
            step = step.unionByName(p)
        step = materialize(step.join(found, ["child", "field_name", "parent", "child_id", "target_key"], "left_anti"), f"orphans-{rounds}")
        new = materialize(step.select("child", "child_id").distinct().join(done, ["child", "child_id"], "left_anti"), f"orphaned-{rounds}")
        found, done = found.unionByName(step), done.unionByName(new)


def _tag(df: DataFrame, fk: ForeignKey, kind: str, depth: int) -> DataFrame:
    return df.select(F.lit(fk.child).alias("child"), F.lit(fk.field).alias("field_name"), F.lit(fk.parent).alias("parent"), "child_id", "target_key", "as_of", F.lit(kind).alias("kind"), F.lit(depth).alias("depth"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(table_name, field_name, parent, month, kind, n_references, n_records); month of as_of as yyyy-MM, NULL if unknown."""
    per_record = orphans.groupBy("child", "field_name", "parent", F.date_format("as_of", "yyyy-MM").alias("month"), "kind", "child_id").agg(F.count(F.lit(1)).alias("n"))
    return per_record.groupBy(F.col("child").alias("table_name"), "field_name", "parent", "month", "kind").agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_records"))


def evidence_keys(evidence: str) -> F.Column:
    """The distinct entries of a JSON array of pmids, numbers or quoted, in decimal; text that is no number stays text.

    NULL, an empty array and text that is no JSON array give none.
    """
    entries = F.transform(F.from_json(evidence, "array<string>"), lambda x: F.btrim(x))
    plain = F.transform(entries, lambda x: F.coalesce(x.try_cast("bigint").cast("string"), x))
    return F.array_distinct(F.filter(plain, lambda x: x != ""))
