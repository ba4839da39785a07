"""Processing only new or changed records: immutable table versions, their differences, and exactly-once commits.

A table is a folder with manifests v00000001.json, v00000002.json, ...; each lists the immutable Parquet files of that
version and, for each, the deletion vector: a Parquet table of (file_path, row_index) of rows that are not part of it.
Comparing two manifests gives the files and deletion vectors that differ, and only those are read to get the records
that came and went. A consumer stores the source version it has processed in the manifest that publishes its own output,
so output and progress become visible together or not at all.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import trimmed_lower
from corpusloom.session import file_system, scratch

POSITION = ["file_path", "row_index"]


#: File systems whose rename never replaces a file, so that of two writers one fails. Object stores need a put of their own.
RENAMES = {"file", "hdfs", "viewfs", "abfs", "abfss"}


class CommitConflict(RuntimeError):
    """Another writer has published this version already."""


@dataclass(frozen=True)
class Manifest:
    version: int
    files: dict[str, str | None] = field(default_factory=dict)  # file -> folder of its deletion vector
    processed: int = 0  # the source version that this output covers
    linked: dict[str, int] = field(default_factory=dict)  # versions of other tables that belong to this one


def data_files(df: DataFrame) -> list[str]:
    """The files of a file-based DataFrame, named as _metadata.file_path names them."""
    return [re.sub(r"^(\w+):///", r"\1:/", f) for f in df.inputFiles()]


def with_positions(spark: SparkSession, files: list[str], columns: list[str] | None = None) -> DataFrame:
    """Records of Parquet files with file_path and row_index; own columns of these names are hidden."""
    df = spark.read.parquet(*map(unquote, files))
    at = df.metadataColumn("_metadata")  # also if the table has a column of that name
    own = [c for c in (columns or df.columns) if c not in POSITION]
    return df.select(*[F.col(f"`{c}`") for c in own], at["file_path"].alias("file_path"), at["row_index"].alias("row_index"))


class VersionedTable:
    """put(path, content) -> bool publishes a manifest only if the path does not exist, in one step. Where renaming is not
    such a step (RENAMES), as on object stores, a table can be read, but be written with a put of the caller's only.
    """

    def __init__(self, spark: SparkSession, root: str, put: Callable[[str, bytes], bool] | None = None):
        self.spark, self.root, self.put = spark, root.rstrip("/"), put

    def _path(self, version: int) -> str:
        return f"{self.root}/v{version:08d}.json"

    def latest(self) -> Manifest:
        fs, p = file_system(self.spark, self.root)
        if not fs.exists(p):
            return Manifest(0)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return self.manifest(max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0))

    def manifest(self, version: int) -> Manifest:
        if version == 0:
            return Manifest(0)
        fs, p = file_system(self.spark, self._path(version))
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def commit(self, manifest: Manifest) -> Manifest:
        """Publishes a manifest under its version's name; an existing version raises CommitConflict."""
        content = json.dumps(manifest.__dict__).encode()
        if not (self.put or self._renamed)(self._path(manifest.version), content):
            raise CommitConflict(f"{self.root}: version {manifest.version} exists")
        return manifest

    def _renamed(self, path: str, content: bytes) -> bool:
        fs, target = file_system(self.spark, path)
        if fs.getUri().getScheme() not in RENAMES:
            raise NotImplementedError(f"{path}: commits need a conditional put on this file system")
        _, temporary = file_system(self.spark, f"{self.root}/.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(temporary, target):
            fs.delete(temporary, False)
            return False
        return True

    def _written(self, df: DataFrame) -> list[str]:
        """New files with records; a failed or repeated task leaves files that no manifest names."""
        folder = f"{self.root}/data-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return data_files(self.spark.read.schema(df.schema).parquet(folder))

    def add_files(self, files: list[str], processed: int | None = None, base: Manifest | None = None) -> Manifest:
        """A version with further files, which stay where they are; base instead of the latest version is what they add to."""
        now = self.latest()
        old = now if base is None else base
        return self.commit(Manifest(now.version + 1, old.files | dict.fromkeys(files), now.processed if processed is None else processed))

    def append(self, df: DataFrame, processed: int | None = None, base: Manifest | None = None) -> Manifest:
        return self.add_files(self._written(df), processed, base)

    def overwrite(self, df: DataFrame, processed: int | None = None) -> Manifest:
        """A version with the records of df only; df may read this table's earlier versions."""
        now = self.latest()
        return self.commit(Manifest(now.version + 1, dict.fromkeys(self._written(df)), now.processed if processed is None else processed, now.linked))

    def replace_rows(self, positions: DataFrame | None, df: DataFrame, processed: int | None = None, linked: dict[str, int] | None = None) -> Manifest:
        """A version without the rows at some positions and with the records of df: what is written is as large as the change.

        positions and df may read this table's latest version. processed and linked are kept unless they are given.
        """
        now = self.latest()
        files = now.files if positions is None or not now.files else self._without(now, positions)
        files = files | dict.fromkeys(self._written(df))
        return self.commit(Manifest(now.version + 1, files, now.processed if processed is None else processed, now.linked if linked is None else linked))

    def _without(self, now: Manifest, positions: DataFrame) -> dict[str, str | None]:
        olds = sorted({d for d in now.files.values() if d})
        gone = positions.select(*POSITION)
        if olds:
            gone = gone.unionByName(self.spark.read.parquet(*olds).select(*POSITION)).distinct()
        folder = f"{self.root}/dv-{uuid.uuid4().hex}"
        gone.write.parquet(folder)
        touched = {r[0] for r in self.spark.read.parquet(folder).select("file_path").distinct().collect()}  # at most the files of the manifest
        return {f: folder if f in touched else None for f in now.files}

    def delete_rows(self, positions: DataFrame) -> Manifest:
        """A version without the rows at (file_path, row_index), in addition to those gone before."""
        now = self.latest()
        return self.commit(Manifest(now.version + 1, self._without(now, positions), now.processed, now.linked))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.latest() if version is None else self.manifest(version)
        return _live(self.spark, m.files)


def _vector(spark: SparkSession, files: dict[str, str | None]) -> DataFrame | None:
    """The deletion vectors of these files; a vector's folder may hold those of others too, which match no row."""
    folders = sorted({d for d in files.values() if d})
    return spark.read.parquet(*folders).select(*POSITION) if folders else None


def _live(spark: SparkSession, files: dict[str, str | None]) -> DataFrame:
    """The rows of these files; only files with a deletion vector are compared with it."""
    plain, marked = sorted(f for f, d in files.items() if d is None), sorted(f for f, d in files.items() if d)
    parts = [with_positions(spark, plain)] if plain else []
    if marked:
        parts.append(with_positions(spark, marked).join(_vector(spark, {f: files[f] for f in marked}), POSITION, "left_anti"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def changes(spark: SparkSession, old: Manifest, new: Manifest) -> DataFrame | None:
    """The records that came and went between two versions, with change 'insert' or 'delete', file_path and row_index.

    Files of one manifest only contribute their live rows. For files of both, the two deletion vectors are compared and
    only rows in one of them are fetched. Equal manifests give None. A record that is rewritten to another file comes
    out as a delete and an insert.
    """
    parts = []
    for here, there, change in ((new.files, old.files, "insert"), (old.files, new.files, "delete")):
        only = {f: d for f, d in here.items() if f not in there}
        if only:
            parts.append(_live(spark, only).withColumn("change", F.lit(change)))
        both = [f for f in here if f in there and there[f] and here[f] != there[f]]
        if both:
            back = _vector(spark, {f: there[f] for f in both})
            still = _vector(spark, {f: here[f] for f in both})
            if still is not None:
                back = back.join(still, POSITION, "left_anti")
            parts.append(with_positions(spark, sorted(both)).join(back, POSITION, "left_semi").withColumn("change", F.lit(change)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def process_new(source: VersionedTable, sink: VersionedTable, work: Callable[[DataFrame], DataFrame]) -> Manifest:
    """Applies work to the changes since the sink's processed version and commits its output with the new one.

    A failure before the commit leaves the sink as it was, so the next run gets the same records again; after it they
    are never seen again. Without changes nothing is written. Of two runs at once one gets CommitConflict.
    """
    done, now = sink.latest(), source.latest()
    delta = changes(source.spark, source.manifest(done.processed), now)
    return done if delta is None else sink.append(work(delta), processed=now.version)


def state_delta(spark: SparkSession, versions_path: str, runs: DataFrame) -> DataFrame:
    """(uuid, seq, change): document states still to be taken by an index run, and taken ones that are out of date.

    Two manifests over the same immutable files are compared. The new one leaves out the rows that do not decide:
    of the rows of a uuid the one with the greatest seq does (ties: the greatest changed_at, run_id, is_indexed, then
    position), and a NULL uuid names no document. The old one, published by the runs' commits, leaves out the rows that
    no successful run has taken: a row is taken if run_id is NULL and is_indexed = 1, or if the attempt with the
    greatest number of its run has the status 'finished' (trimmed, any case) and started not before changed_at; of equal
    attempts one that finished counts, then the later start. NULL times are never in order. Files of which no row was
    taken are new files. Inserts are to be processed, deletes to be withdrawn.
    """
    files = data_files(spark.read.parquet(versions_path))
    if not files:
        return spark.createDataFrame([], "uuid string, seq long, change string")
    rows = with_positions(spark, files, ["uuid", "seq", "changed_at", "run_id", "is_indexed"])
    order = F.struct("seq", "changed_at", "run_id", "is_indexed", *POSITION)
    deciding = rows.where(F.col("uuid").isNotNull()).groupBy("uuid").agg(F.max(order).alias("m")).select(*[F.col(f"m.{c}") for c in POSITION])
    last = (
        runs.groupBy("run_id")
        .agg(F.max(F.struct("attempt", F.coalesce(trimmed_lower("status") == "finished", F.lit(False)).alias("finished"), "started_at")).alias("m"))
        .select("run_id", "m.finished", "m.started_at")
    )
    by_run = F.col("finished") & (F.col("started_at") >= F.col("changed_at"))
    taken = F.coalesce((F.col("run_id").isNull() & (F.col("is_indexed") == 1)) | by_run, F.lit(False))
    state = rows.join(last, "run_id", "left").withColumn("taken", taken)
    source = VersionedTable(spark, scratch(spark, "versions"))
    source.add_files(files)
    current = source.delete_rows(rows.join(deciding, POSITION, "left_anti"))
    index = VersionedTable(spark, scratch(spark, "index"))
    some = [r[0] for r in state.where("taken").select("file_path").distinct().collect()]  # at most the files of the manifest
    index.add_files(some, processed=1)
    covered = index.delete_rows(state.where(~F.col("taken"))) if some else index.latest()
    return changes(spark, covered, current).select("uuid", "seq", "change")
