"""Jobs: a queue with priorities and Spark's fair pools, status and logs, cancelling; listings of a job table."""

from __future__ import annotations

import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import GENERAL_ERROR, short_description
from corpusloom.operators.association import UserError

#: Queues in order of priority; a job of more terms is of medium priority.
QUEUES = ["HIGH", "MEDIUM", "LOW", "INDEXING"]
SMALL_JOB = 50


def priority(n_terms: Column) -> Column:
    return F.when(n_terms <= SMALL_JOB, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))


def priority_of(n_terms: int) -> str:
    return "HIGH" if n_terms <= SMALL_JOB else "MEDIUM"


def local_time(ts: Column | str, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd h:mm:ss a")


def clamp_progress(x: Column) -> Column:
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(0.9999)), 4)


def listing(jobs: DataFrame, zone: str = "UTC") -> DataFrame:
    """Jobs (id, status, description, created_at), the newest first, with local time and short description."""
    return jobs.select("id", "status", short_description("description").alias("description"), local_time("created_at", zone).alias("created"), "created_at").orderBy(F.col("created_at").desc(), "id")


def by_queue(workers: DataFrame) -> DataFrame:
    """Workers (name, queue) in the fixed order of queues, unknown ones last."""
    at = F.array_position(F.lit(QUEUES), F.col("queue"))
    return workers.orderBy(F.when(at == 0, F.lit(len(QUEUES) + 1)).otherwise(at), "name")


@dataclass
class Job:
    id: str
    queue: str
    work: Callable[[Job], object]
    status: str = "queued"
    progress: float = 0.0
    result: object = None
    exception: str | None = None
    created_at: float = field(default_factory=time.time)
    logs: dict[str, str] = field(default_factory=dict)

    def report(self, progress: float, log: str | None = None) -> None:
        self.progress = round(min(max(progress, 0.0), 0.9999), 4)
        if log:
            self.logs[str(len(self.logs))] = log


class StoredRows:
    """A result written as a table in its order; rows are read when they are asked for."""

    def __init__(self, df: DataFrame, path: str):
        self.spark, self.path = df.sparkSession, path
        df.withColumn("_position", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)

    def frame(self) -> DataFrame:
        return self.spark.read.parquet(self.path).orderBy("_position").drop("_position")

    def page(self, first: int, n: int) -> list[dict]:
        return [r.asDict(True) for r in self.frame().offset(first).limit(n).collect()]

    def __len__(self) -> int:
        return self.spark.read.parquet(self.path).count()

    def __getitem__(self, i: int) -> dict:
        found = self.page(i, 1) if i >= 0 else []
        if not found:
            raise IndexError(i)
        return found[0]

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict(True) for r in self.frame().toLocalIterator())


class JobQueue:
    """Runs jobs in threads, the highest priority first and, of one priority, the oldest.

    Each runs in the scheduler pool of its priority if the session schedules fairly (spark.scheduler.mode = FAIR; weights
    come from its allocation file, see fairscheduler.xml beside this package). Indexing runs alone: jobs submitted before
    it run first, jobs submitted after it wait for it, so neither side waits without end; it holds no thread meanwhile.
    """

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self.jobs, self.workers = spark, {}, workers
        self.fair = spark.sparkContext.getConf().get("spark.scheduler.mode", "FIFO") == "FAIR"
        self.state = threading.Condition()
        self.waiting: list[tuple[int, int, Job]] = []  # (priority, number, job)
        self.number, self.running, self.writer, self.threads = 0, 0, False, []

    def submit(self, work: Callable[[Job], object], queue: str = "MEDIUM", id: str | None = None) -> str:
        """Unknown priorities count as medium; only one indexing job may be waiting or running."""
        queue = queue if queue in QUEUES else "MEDIUM"
        with self.state:
            if queue == "INDEXING" and self.indexing():
                raise UserError("an indexing job is waiting or running")
            job = Job(id or uuid.uuid4().hex, queue, work)
            self.jobs[job.id] = job
            self.waiting.append((QUEUES.index(queue), self.number, job))
            self.number += 1
            if len(self.threads) < self.workers:
                self.threads.append(threading.Thread(target=self._serve, daemon=True))
                self.threads[-1].start()
            self.state.notify_all()
        return job.id

    def _next(self) -> Job | None:
        """The job that may start now, taken out of those waiting."""
        if self.writer:
            return None
        writer = next((n for q, n, j in self.waiting if j.queue == "INDEXING"), None)
        open_ = [x for x in self.waiting if x[2].queue != "INDEXING" and (writer is None or x[1] < writer)]
        if not open_ and writer is not None and not self.running:
            open_ = [x for x in self.waiting if x[1] == writer]
        if not open_:
            return None
        best = min(open_, key=lambda x: x[:2])
        self.waiting.remove(best)
        return best[2]

    def _serve(self) -> None:
        while True:
            with self.state:
                while (job := self._next()) is None:
                    self.state.wait()
                self.running, self.writer = self.running + 1, job.queue == "INDEXING"
            try:
                self._run(job)
            finally:
                with self.state:
                    self.running, self.writer = self.running - 1, self.writer and job.queue != "INDEXING"
                    self.state.notify_all()

    def _run(self, job: Job) -> None:
        try:
            if job.status == "canceled":
                return
            job.status = "started"
            sc = self.spark.sparkContext
            if self.fair:
                sc.setLocalProperty("spark.scheduler.pool", job.queue)
            sc.setJobGroup(job.id, job.queue, interruptOnCancel=True)
            result = job.work(job)
            if job.status != "canceled":
                job.result, job.progress, job.status = result, 1.0, "finished"
        except BaseException as e:
            job.exception = traceback.format_exc()
            if job.status != "canceled":
                job.status = "failed"
            job.logs["error"] = str(e) if isinstance(e, UserError) else GENERAL_ERROR

    def get(self, id: str) -> dict | None:
        j = self.jobs.get(id)
        if j is None:
            return None
        info = {"id": j.id, "status": j.status, "result": j.result, "progress": j.progress, "queue": j.queue, **j.logs}
        return info | ({"exception": j.exception} if j.exception else {})

    def cancel(self, id: str) -> dict | None:
        j = self.jobs.get(id)
        if j is None:
            return None
        j.status = "canceled"
        self.spark.sparkContext.cancelJobGroup(id)
        return {"id": id, "status": j.status}

    def indexing(self) -> bool:
        return any(j.queue == "INDEXING" and j.status in ("queued", "started") for j in self.jobs.values())

    def table(self) -> DataFrame:
        rows = [(j.id, j.queue, j.status, j.progress, j.created_at) for j in self.jobs.values()]
        return self.spark.createDataFrame(rows, "id string, queue string, status string, progress double, created double").withColumn("created_at", F.timestamp_seconds("created")).drop("created")
