"""Mixing sources to target shares of all tokens: entropy balancing.

Every document gets a rate, the expected number of its copies, as close as possible to one each (in relative entropy)
under the constraints of its plan: the target's tokens of each source, the most copies of a document, and the number of
copies in all that one uniform rate per source would give, so that the mixture's mean length is not traded away. The
dual of this convex problem has one variable for each source of a plan and one for the plan, and its solution are the
exponentially tilted rates min(cap, exp(a + b * length)). Newton's steps need sums of rate, rate * length and
rate * length^2, which are distributed aggregates over a histogram of lengths; one job evaluates several step lengths.

Rates are then rounded to whole copies so that the rounding errors of documents of neighbouring lengths cancel: a running
sum over the lengths, in two levels of windows, so that no task sees more than the lengths of a span. What is missing or
too much at the end is made up by single copies, the longest that fit first.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

#: Newton stops at this relative error of all constraints, or after so many steps; a step changes a variable by at most 1.
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Parts of a step that are tried together.
TRIED = (1.0, 0.3, 0.08, 0.01)
#: Documents of one source and length that are ranked in one task; lengths in a window; lengths looked at to make up a rest.
BUCKET_DOCS = 200_000
SPAN = 4096
REPAIRED = 256
#: Rows of the targets, which are collected and broadcast; more are an error.
MAX_TARGETS = 10_000


def plan_totals(targets: DataFrame, tokens: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(mix_plan, source, target_share, max_repeats, docs, tokens, wanted): tokens wanted of each source of each plan.

    A plan's total is the largest at which every source that has tokens keeps its share within max_repeats uses of each
    document, or total_tokens if that is less. A source without tokens gets none, and the others keep their proportions.
    A NULL or negative share counts 0, a NULL max_repeats 1, a NULL plan or source is left out; of repeated rows of a
    source in a plan the greatest counts. targets is a settings table of a few rows.
    """
    clean = targets.where("mix_plan IS NOT NULL AND source IS NOT NULL").select("mix_plan", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    one = clean.groupBy("mix_plan", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("mix_plan", "source", "t.*")
    sums = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    j = one.join(sums, "source", "left").fillna(0, ["docs", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    w = Window.partitionBy("mix_plan")
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(w))
    j = j.withColumn("_share", share)
    most = F.min(F.col("max_repeats") * F.col("tokens") / F.col("_share")).over(w)
    total = most if total_tokens is None else F.least(most, F.lit(float(total_tokens)))
    return j.withColumn("wanted", F.coalesce(F.col("_share") * total, F.lit(0.0))).drop("_share")


class _Plan:
    """The dual of one plan: a and the b of its sources; sources that need all copies of all documents are fixed."""

    def __init__(self, name: str, rows: list[dict]):
        self.name = name
        self.cap = {r["source"]: float(r.get("max_repeats") or math.inf) for r in rows}
        self.rows = {r["source"]: r for r in rows}
        ratio = {s: r["wanted"] / r["tokens"] for s, r in self.rows.items()}
        self.free = [s for s in self.rows if ratio[s] < self.cap[s] * (1 - 1e-9)]
        self.mean = {s: r["tokens"] / r["docs"] for s, r in self.rows.items()}
        self.ratio = ratio
        docs = np.array([self.rows[s]["docs"] for s in self.free], float)
        logs = np.array([math.log(ratio[s]) for s in self.free])
        self.goal = docs * np.exp(logs)  # of sum(rate * length / mean) of each source; their total also of sum(rate)
        self.a = float((docs * logs).sum() / docs.sum()) if self.free else 0.0
        self.b = logs - self.a
        self.step, self.scale, self.merit, self.done = (0.0, np.zeros(len(self.free))), 1.0, math.inf, not self.free

    def tried(self) -> list[tuple]:
        parts = [0.0] if self.merit == math.inf else [t * self.scale for t in TRIED]
        self.points = [(self.a + t * self.step[0], self.b + t * self.step[1]) for t in parts]
        return [(self.name, s, k, float(a), float(b[i]), self.mean[s], self.cap[s]) for k, (a, b) in enumerate(self.points) for i, s in enumerate(self.free)]

    def advance(self, sums: dict) -> None:
        """Takes the best point tried, and the next step from there; the plan's equations have the shape of an arrow."""
        best = None
        for k, (a, b) in enumerate(self.points):
            v = np.array([sums[self.name, s, k] for s in self.free], float).T  # s0, s1, h0, h1, h2, dual
            if not np.isfinite(v).all():
                continue
            rest = np.r_[self.goal.sum() - v[0].sum(), self.goal - v[1]]
            error = float(max(abs(rest[0]) / self.goal.sum(), (np.abs(rest[1:]) / self.goal).max()))
            merit = float(v[5].sum() - a * self.goal.sum() - (b * self.goal).sum())
            if best is None or (error < best[1] if max(error, best[1]) < 1e-3 else merit < best[0]):
                best = (merit, error, a, b, v, rest)
        if best is None or (self.merit != math.inf and best[0] > self.merit + 1e-9 * abs(self.merit) and best[1] > self.error):
            self.scale *= TRIED[-1]
            return
        self.merit, self.error, self.a, self.b, v, rest = best
        self.scale, self.done = 1.0, self.error < TOLERANCE
        h0, h1, h2 = v[2], v[3], v[4] + 1e-12 * v[4].max() + 1e-300
        pivot = float((h0 - h1 * h1 / h2).sum())
        da = (rest[0] - float((h1 / h2 * rest[1:]).sum())) / pivot if pivot > 1e-9 * h0.sum() else 0.0
        db = (rest[1:] - h1 * da) / h2
        most = max(1.0, abs(da), float(np.abs(db).max()))
        self.step = (da / most, db / most)

    def rates(self) -> dict[tuple[str, str], tuple[float, float, float]]:
        """Uniform rates, which meet all constraints too, should Newton not have arrived."""
        at = dict(zip(self.free, self.b)) if self.done else {}
        return {(self.name, s): (float(self.a), float(at[s]), self.mean[s]) if s in at else (math.log(self.ratio[s]), 0.0, self.mean[s]) for s in self.rows}


def balance(hist: DataFrame, plans: list[dict]) -> dict[tuple[str, str], tuple[float, float, float]]:
    """(a, b, mean length) of each (plan, source): the rate of a document of length x is min(cap, exp(a + b * x / mean)).

    hist: (source, n_tokens, docs). plans: rows of plan_totals, as many as the settings have.
    """
    spark = hist.sparkSession
    names = dict.fromkeys(p["mix_plan"] for p in plans if p["wanted"] > 0)
    state = [_Plan(n, [p for p in plans if p["mix_plan"] == n and p["wanted"] > 0]) for n in names]
    for _ in range(MAX_STEPS):
        points = [x for p in state if not p.done for x in p.tried()]
        if not points:
            break
        dual = spark.createDataFrame(points, "mix_plan string, source string, k int, a double, b double, mean double, cap double")
        x = F.col("n_tokens") / F.col("mean")
        t = F.col("a") + F.col("b") * x
        open_ = t < F.log("cap")
        rate = F.when(open_, F.exp(t)).otherwise(F.col("cap"))
        inner = F.when(open_, rate).otherwise(0.0)
        value = F.when(open_, rate).otherwise(F.col("cap") * (1.0 + t - F.log("cap")))
        each = hist.join(F.broadcast(dual), "source")
        sums = each.groupBy("mix_plan", "source", "k").agg(*[F.sum(v * F.col("docs")) for v in (rate, rate * x, inner, inner * x, inner * x * x, value)]).collect()  # rows of the settings
        got = {tuple(r[:3]): tuple(r[3:]) for r in sums}
        for p in state:
            if not p.done:
                p.advance(got)
    return {k: v for p in state for k, v in p.rates().items()}


def _rounded(rated: DataFrame) -> DataFrame:
    """rated (mix_plan, source, n_tokens, docs, cap, wanted, rate) with copies, whole numbers that add up to the wanted tokens.

    Lengths of a source share a running sum of fractions. It is exact (decimal), within spans of SPAN lengths and over
    their sums, so a window holds at most SPAN lengths, or the longest length / SPAN spans.
    """
    plan = ["mix_plan", "source"]
    cells = rated.withColumn("e", (F.col("rate") * F.col("docs")).cast("decimal(38,6)")).withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    before = F.sum("e").over(Window.partitionBy(*plan).orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = cells.groupBy(*plan, "span").agg(F.sum("e").cast("decimal(38,6)").alias("e")).select(*plan, "span", F.coalesce(before, F.lit(0)).cast("decimal(38,6)").alias("offset"))
    upto = F.sum("e").over(Window.partitionBy(*plan, "span").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = cells.join(spans, [*plan, "span"]).withColumn("upto", (F.col("offset") + upto).cast("decimal(38,6)"))

    def whole(c: F.Column) -> F.Column:
        return F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")

    copies = F.least(F.greatest(whole(F.col("upto")) - whole(F.col("upto") - F.col("e")), F.lit(0)), F.col("docs") * F.col("cap"))
    return cum.select(*plan, "n_tokens", "docs", "cap", "wanted", copies.alias("copies"))


def _made_up(quota: DataFrame) -> list[tuple[str, str, int, int]]:
    """(mix_plan, source, n_tokens, copies more or fewer): single copies that bring each source to its tokens.

    The longest lengths that fit into the rest come first, REPAIRED of them at a time, until none fits. What is left then
    is less than the shortest length, and one copy is exchanged for another.
    """
    spark, changes, left = quota.sparkSession, [], {}
    sums = quota.groupBy("mix_plan", "source").agg(F.max("wanted"), F.sum(F.col("copies") * F.col("n_tokens")), F.max("n_tokens")).collect()  # rows of the settings
    open_ = {(r[0], r[1]): (int(round(r[2])) - int(r[3]), int(r[4]) + 1) for r in sums}
    left |= {k: v[0] for k, v in open_.items()}
    while open_ := {k: (rest, top) for k, (rest, top) in open_.items() if rest and top > 1}:
        rests = spark.createDataFrame([(*k, *v) for k, v in open_.items()], "mix_plan string, source string, rest long, top long")
        spare = F.when(F.col("rest") > 0, F.col("docs") * F.col("cap") - F.col("copies")).otherwise(F.col("copies"))
        fit = quota.join(F.broadcast(rests), ["mix_plan", "source"]).select("mix_plan", "source", "n_tokens", "rest", "top", spare.alias("spare"))
        fit = fit.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < F.col("top")) & (F.col("n_tokens") <= F.abs("rest")) & (F.col("spare") > 0))
        nth = F.row_number().over(Window.partitionBy("mix_plan", "source").orderBy(F.col("n_tokens").desc()))
        found = fit.withColumn("nth", nth).where(F.col("nth") <= REPAIRED).orderBy("mix_plan", "source", F.col("n_tokens").desc()).collect()  # REPAIRED rows of each target
        rest = {k: v[0] for k, v in open_.items()}
        top = dict.fromkeys(open_, 0)
        for r in found:
            k = (r["mix_plan"], r["source"])
            n = min(abs(rest[k]) // r["n_tokens"], r["spare"]) * (1 if rest[k] > 0 else -1)
            if n:
                changes.append((*k, r["n_tokens"], n))
                rest[k] -= n * r["n_tokens"]
            top[k] = r["n_tokens"]
        open_ = {k: (rest[k], top[k]) for k in open_}
        left |= {k: rest[k] for k in open_}
    return changes + _exchanged(quota, {k: r for k, r in left.items() if r}, changes)


def _exchanged(quota: DataFrame, left: dict[tuple[str, str], int], changes: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    """One copy more and one fewer where their lengths differ by about the rest, of the REPAIRED shortest lengths each."""
    if not left:
        return []
    spark, out = quota.sparkSession, []
    done = {c[:3]: c[3] for c in changes}
    rests = spark.createDataFrame([(*k, r) for k, r in left.items()], "mix_plan string, source string, rest long")
    each = quota.join(F.broadcast(rests), ["mix_plan", "source"]).where("n_tokens > 0")
    nth = F.row_number().over(Window.partitionBy("mix_plan", "source").orderBy("n_tokens"))
    found = each.withColumn("nth", nth).where(F.col("nth") <= REPAIRED).collect()  # REPAIRED rows of each target
    for k, rest in left.items():
        cells = sorted((r["n_tokens"], r["copies"] + done.get((*k, r["n_tokens"]), 0), r["docs"] * r["cap"]) for r in found if (r["mix_plan"], r["source"]) == k)
        add = np.array([n for n, c, most in cells if c < most], np.int64)
        drop = np.array([n for n, c, _ in cells if c > 0], np.int64)
        if len(add) and len(drop):
            miss = np.abs(rest - (add[:, None] - drop[None, :]))
            i, j = np.unravel_index(miss.argmin(), miss.shape)
            if miss[i, j] < abs(rest):
                out += [(*k, int(add[i]), 1), (*k, int(drop[j]), -1)]
    return out


def mix(docs: DataFrame, key: str, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(mix_plan, key, source, n_tokens, copies): how often each document is used in each plan, 1 to max_repeats times.

    docs: (key, source, n_tokens), one row per document; NULL or repeated keys are documents of their own, NULL sources are
    in no plan, NULL sizes count 0. The copies of documents of one length differ by at most one; which get the additional
    one is a matter of a hash. The tokens of a source miss the target by less than its shortest document that has a copy to spare. Empty tables
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    named = targets.select("source").where("source IS NOT NULL").distinct()
    tokens = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).join(named, "source", "left_semi"), "tokens")
    plans = [r.asDict() for r in plan_totals(targets, tokens, total_tokens).limit(MAX_TARGETS + 1).collect()]
    if len(plans) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    buckets = max([1, *(-(-p["docs"] // BUCKET_DOCS) for p in plans)])
    bucketed = tokens.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    cells = materialize(bucketed.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("docs")), "cells")
    hist = materialize(cells.groupBy("source", "n_tokens").agg(F.sum("docs").alias("docs")), "lengths")
    cap = {(p["mix_plan"], p["source"]): p["max_repeats"] for p in plans}
    dual = balance(hist, plans)
    wanted = {(p["mix_plan"], p["source"]): p["wanted"] for p in plans}
    schema = "mix_plan string, source string, a double, b double, mean double, cap int, wanted double"
    rows = [(k[0], k[1], *v, cap[k], wanted[k]) for k, v in dual.items()]
    settings = spark.createDataFrame(rows, schema)
    rate = F.least(F.exp(F.col("a") + F.col("b") * F.col("n_tokens") / F.col("mean")), F.col("cap").cast("double"))
    near = F.round(rate)
    exact = F.when(F.abs(rate - near) < 1e-8, near).otherwise(rate)  # the solver's error makes no copy
    rated = hist.join(F.broadcast(settings), "source").select("mix_plan", "source", "n_tokens", "docs", F.col("cap").cast("long").alias("cap"), "wanted", exact.alias("rate"))
    quota = materialize(_rounded(rated), "quota")
    more = spark.createDataFrame(_made_up(quota), "mix_plan string, source string, n_tokens long, more long").groupBy("mix_plan", "source", "n_tokens").agg(F.sum("more").alias("more"))
    of_length = quota.join(F.broadcast(more), ["mix_plan", "source", "n_tokens"], "left").select("mix_plan", "source", "n_tokens", "cap", F.col("docs").alias("of_docs"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("of_copies"))
    upto = F.sum("docs").over(Window.partitionBy("mix_plan", "source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    split = cells.join(of_length.where("of_copies > 0"), ["source", "n_tokens"]).withColumn("upto", upto)

    def part(docs: F.Column) -> F.Column:
        return F.floor(F.col("of_copies").cast("decimal(19,0)") * docs.cast("decimal(18,0)") / F.col("of_docs").cast("decimal(18,0)")).cast("long")

    own = split.withColumn("own", F.when(F.col("docs") == F.col("of_docs"), F.col("of_copies")).otherwise(part(F.col("upto")) - part(F.col("upto") - F.col("docs")))).where("own > 0")
    each = own.select("mix_plan", "source", "n_tokens", "bucket", "cap", F.expr("own div docs").alias("base"), (F.col("own") % F.col("docs")).alias("extra"))
    placed = bucketed.join(each, ["source", "n_tokens", "bucket"])
    rank = F.row_number().over(Window.partitionBy("mix_plan", "source", "n_tokens", "bucket").orderBy(F.xxhash64("uid", "mix_plan"), "uid"))
    copies = F.least(F.col("base") + (rank <= F.col("extra")).cast("long"), F.col("cap"))
    return placed.withColumn("copies", copies).where("copies > 0").select("mix_plan", F.col("key").alias(key), "source", "n_tokens", "copies")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_plan, source, target_share, reached_share, max_repeats, docs, copies, most_copies, tokens) of every target."""
    got = mixed.groupBy("mix_plan", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    one = targets.where("mix_plan IS NOT NULL AND source IS NOT NULL").groupBy("mix_plan", "source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("mix_plan", "source", "t.*")
    j = one.join(got, ["mix_plan", "source"], "left").fillna(0, ["docs", "copies", "most_copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy("mix_plan"))
    return j.withColumn("reached_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0))).select("mix_plan", "source", "target_share", "reached_share", "max_repeats", "docs", "copies", "most_copies", "tokens")
