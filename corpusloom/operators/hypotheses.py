"""Evaluation of hypotheses about associated terms: year windows, inputs for an external scorer, its results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import iteration_of
from corpusloom.operators.association import Corpus, Params, Sets, UserError, top_articles
from corpusloom.operators.corpus import MAX_YEAR, MIN_YEAR
from corpusloom.session import file_system

#: Most iterations of a job; articles looked up where the caller gives none.
MAX_ITERATIONS = 10
LOOKED_UP = 1000
LISTS = ["ab_pmid_intersection", "bc_pmid_intersection", "ac_pmid_intersection"]
INPUT = "a_term string, b_term string, c_term string, " + ", ".join(f"{c} array<string>" for c in LISTS)


@dataclass
class EvaluationParams:
    data: list[dict]
    pair_hypothesis: str | None = None
    chain_hypotheses: dict | None = None
    is_dch: bool = False
    model: str = "o3-mini"
    top_n_articles_most_cited: int = 5
    top_n_articles_most_recent: int = 5
    post_n: int = 5
    censor_year_lower: int = MIN_YEAR
    censor_year_upper: int = MAX_YEAR
    censor_year_increment: int | None = None
    iterations: int = 1
    id: str | None = None

    @classmethod
    def of(cls, values: dict, names: dict[str, str] | None = None) -> EvaluationParams:
        """From a payload; names maps a client's own names of parameters to ours. Two names of one parameter are an error."""
        ours = [(names or {}).get(k, k) for k in values]
        if len(set(ours)) < len(ours):
            raise UserError("a parameter is given twice")
        return cls(**dict(zip(ours, values.values())))

    def validated(self) -> EvaluationParams:
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise UserError(text)

        def names(text, *terms: str) -> bool:
            return isinstance(text, str) and all(f"{{{t}}}" in text for t in terms)

        need(1 <= self.iterations <= MAX_ITERATIONS, f"iterations must be from 1 to {MAX_ITERATIONS}")
        need(self.censor_year_increment is None or self.censor_year_increment >= 1, "censor_year_increment must be at least 1")
        need(bool(self.data), "data must not be empty")
        if self.is_dch:
            need(len(self.data) == 2, "a direct comparison takes two entries")
            need(self.pair_hypothesis is not None, "a direct comparison needs pair_hypothesis")
            need(all("a_term" in x and "b_term" in x for x in self.data), "a_term and b_term are required")
            need(any(len({x[t] for x in self.data}) == 1 for t in ("a_term", "b_term")), "a direct comparison shares a term")
            need(names(self.pair_hypothesis, "a_term", "b_term"), "pair_hypothesis must name {a_term} and {b_term}")
            return self
        need(len({"c_term" in x for x in self.data}) == 1, "entries must all be pairs or all be chains")
        need(self.pair_hypothesis is not None or self.chain_hypotheses is not None, "a hypothesis is required")
        need(all("a_term" in x and "b_term" in x for x in self.data), "a_term and b_term are required")
        if self.chain_hypotheses is not None:
            need(all("c_term" in x for x in self.data), "c_term is required for chains")
        if self.pair_hypothesis is not None:
            need(names(self.pair_hypothesis, "a_term", "b_term"), "pair_hypothesis must name {a_term} and {b_term}")
            return self
        parts = {"AB": ("a_term", "b_term"), "BC": ("b_term", "c_term"), "AC": ("a_term", "c_term"), "rel_AC": ("a_term", "c_term"), "ABC": ("a_term", "b_term", "c_term")}
        need(isinstance(self.chain_hypotheses, dict), "chain_hypotheses must be a dictionary")
        for part, terms in parts.items():
            need(names(self.chain_hypotheses.get(part), *terms), f"hypothesis {part} must name " + ", ".join(f"{{{t}}}" for t in terms))
        return self


def year_windows(first: Column, last: Column, step: Column) -> Column:
    """array<struct<lo, hi>> of windows of `step` years that tile a range; one window if step is NULL, none if it is empty."""
    tiled = F.when(first <= last, F.transform(F.sequence(first, last, step), lambda s: F.struct(s.alias("lo"), F.least(s + step - 1, last).alias("hi"))))
    return F.when(step.isNull(), F.array(F.struct(first.alias("lo"), last.alias("hi")))).otherwise(F.coalesce(tiled, F.array().cast("array<struct<lo:int,hi:int>>")))


def fill_articles(corpus: Corpus, data: list[dict], first: int, last: int, step: int | None = None) -> DataFrame:
    """(entry, terms, article lists, lo, hi): the entries with their article lists in every window of a range of years.

    Empty or missing lists are looked up (the most recent 1,000 articles); with a step all are, a window of so many years
    at a time. There is one search for all windows: an article belongs to the window of its year.
    """
    spark = corpus.spark
    given = [[[str(p) for p in x.get(c) or []] if step is None else [] for c in LISTS] for x in data]
    rows = [(i, x["a_term"], x["b_term"], x.get("c_term"), *lists) for i, (x, lists) in enumerate(zip(data, given))]
    span = year_windows(F.lit(first), F.lit(last), F.lit(step).cast("int"))
    out = spark.createDataFrame(rows, "entry int, " + INPUT).withColumn("w", F.explode(span)).select("*", "w.lo", "w.hi").drop("w")
    sides = {"ab": (1, 2), "bc": (2, 3), "ac": (1, 3)}
    p = Params([], [], censor_year_lower=first, censor_year_upper=last, return_pmids=True, top_n_articles_most_recent=LOOKED_UP)
    open_pairs = {xy: [(r[s], r[t]) for r in rows if r[s] is not None and r[t] is not None and not r[4 + LISTS.index(f"{xy}_pmid_intersection")]] for xy, (s, t) in sides.items()}
    names = [t for pairs in open_pairs.values() for pair in pairs for t in pair]
    if names:
        sets = Sets(corpus, names, p)
        lo = F.lit(first) if step is None else F.lit(first) + F.floor((F.col("year") - first) / step).cast("int") * step
        for xy, pairs in open_pairs.items():
            if pairs:
                x, y = xy
                c = f"{xy}_pmid_intersection"
                terms = sets.pairs(pairs)
                tops = top_articles(sets.meet(terms).withColumn("lo", lo), ["x_no", "y_no", "lo"], p)
                found = tops.join(terms, ["x_no", "y_no"]).select(F.col("x_term").alias(f"{x}_term"), F.col("y_term").alias(f"{y}_term"), "lo", F.transform("pmids", lambda v: v.cast("string")).alias("_found"))
                out = out.join(found, [f"{x}_term", f"{y}_term", "lo"], "left")
                out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce("_found", F.array().cast("array<string>")))).drop("_found")
    return out.select("entry", "a_term", "b_term", "c_term", *LISTS, "lo", "hi")


def quoted_list(pmids: Column | str) -> Column:
    """A list of quoted strings as the scorer's input files have it."""
    c = F.col(pmids) if isinstance(pmids, str) else pmids
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: F.concat(F.lit("'"), v.cast("string"), F.lit("'"))), ", "), F.lit("]"))


def scorer_input(data: DataFrame, chains: bool) -> DataFrame:
    terms = ["a_term", "b_term", *(["c_term"] if chains else [])]
    lists = LISTS if chains else LISTS[:1]
    return data.select(*terms, *[quoted_list(c).alias(c) for c in lists])


def write_scorer_input(data: DataFrame, chains: bool, folder: str, config: dict) -> None:
    """The job folder of the scorer: data.tsv with a header, files.txt with its name, config.json, and a folder output.

    data are the entries of one job, as many as its client sent; they are streamed into the one file the scorer reads.
    """
    rows = scorer_input(data, chains)
    fs, root = file_system(data.sparkSession, folder)
    path = data.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path

    def write(name: str, lines: Iterator[str]) -> None:
        out = fs.create(path(root, name), True)
        try:
            for line in lines:
                out.write(bytearray(line.encode()))
        finally:
            out.close()

    fs.mkdirs(path(root, "output"))
    write("data.tsv", ("\t".join(r) + "\n" for r in chain([rows.columns], rows.toLocalIterator())))
    write("files.txt", iter(["data.tsv\n"]))
    write("config.json", iter([json.dumps(config, indent=4)]))


#: Where the values of a job stand in a scorer's configuration, unless its caller says otherwise.
PLACES = {
    "JOB_TYPE": "JOB_TYPE", "pair_hypothesis": "pair_hypothesis", "chain_hypotheses": "chain_hypotheses", "MODEL": "MODEL", "POST_N": "POST_N",
    "TOP_N_ARTICLES_MOST_CITED": "TOP_N_ARTICLES_MOST_CITED", "TOP_N_ARTICLES_MOST_RECENT": "TOP_N_ARTICLES_MOST_RECENT", "ITERATIONS": "ITERATIONS",
    "censor_year_lower": "censor_year_lower", "censor_year_upper": "censor_year_upper", "is_dch": "is_dch",
}


def config_template(p: EvaluationParams, chains: bool, template: dict | None = None, places: dict[str, str] | None = None, job_types: tuple[str, str] = ("pairs", "chains")) -> dict:
    """What the scorer is told about a job, without any secrets: a caller's template with the job's values in their places.

    places maps values to dotted paths in the template, None leaving one out; the names of the wire format are the
    caller's. The template is not changed.
    """
    values = {
        "JOB_TYPE": job_types[chains], "pair_hypothesis": None if chains else p.pair_hypothesis, "chain_hypotheses": p.chain_hypotheses if chains else None,
        "MODEL": p.model, "POST_N": p.post_n, "TOP_N_ARTICLES_MOST_CITED": p.top_n_articles_most_cited, "TOP_N_ARTICLES_MOST_RECENT": p.top_n_articles_most_recent,
        "ITERATIONS": p.iterations if p.iterations > 1 else False, "censor_year_lower": p.censor_year_lower, "censor_year_upper": p.censor_year_upper, "is_dch": p.is_dch,
    }
    out = json.loads(json.dumps(template or {}))
    for name, value in values.items():
        place = (PLACES | (places or {}))[name]
        if place is None or value is None:
            continue
        *above, last = place.split(".")
        at = out
        for k in above:
            at = at.setdefault(k, {})
        at[last] = value
    return out


def evaluate(corpus: Corpus, p: EvaluationParams, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a scorer over the entries of every window and iteration; schema is that of its output.

    The scorer gets entry, terms, article lists, window (lo, hi) and iteration in batches and runs on the executors. With
    an increment the callers' lists are replaced by those of each window.
    """
    p = p.validated()
    rows = fill_articles(corpus, p.data, p.censor_year_lower, p.censor_year_upper, p.censor_year_increment)
    return rows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(p.iterations)))).mapInPandas(scorer, schema)


_TALLY = ["support_H1", "support_H2", "both", "neither_or_inconclusive"]


def parse_results(raw: DataFrame) -> DataFrame:
    """Results of (path, json), a JSON object or an array of them; the iteration comes from the path, 1 without one.

    Per object: a comparison gives both hypotheses and score, decision and tallies of its last dictionary entry (missing
    tallies are 0); otherwise a chain gives its terms and result; pairs ab and ac are read in any case, and later blocks
    overwrite the terms.
    """
    each = raw.select("path", F.explode(F.when(F.ltrim("json").startswith("["), F.from_json("json", "array<string>")).otherwise(F.array("json"))).alias("j"))

    def get(path: str) -> Column:
        return F.get_json_object("j", path)

    dch = get("$.Hypothesis_Comparison")
    found = get("$.Hypothesis_Comparison.Result")
    entries = F.when(F.ltrim(found).startswith("["), F.from_json(found, "array<string>")).otherwise(F.array(found))
    last = F.try_element_at(F.filter(entries, lambda x: F.ltrim(x).startswith("{")), F.lit(-1))
    abc = dch.isNull() & get("$.A_B_C_Relationship").isNotNull()

    def term(t: str, *blocks: str) -> Column:
        own = F.when(abc, get(f"$.A_B_C_Relationship.{t}"))
        return F.coalesce(*[get(f"$.{b}.{t}") for b in blocks], own)

    number = F.when(last.isNotNull(), F.lit(0))
    cols = {
        "iteration": F.coalesce(iteration_of("path"), F.lit(1)),
        "a_term": term("a_term", "A_C_Relationship", "A_B_Relationship"),
        "b_term": term("b_term", "A_B_Relationship"),
        "c_term": term("c_term", "A_C_Relationship"),
        "abc_result": F.when(abc, get("$.A_B_C_Relationship.Result")),
        "ab_result": get("$.A_B_Relationship.Result"),
        "ac_result": get("$.A_C_Relationship.Result"),
        "hypothesis1": F.when(dch.isNotNull(), F.coalesce(get("$.Hypothesis_Comparison.hypothesis1"), F.lit(""))),
        "hypothesis2": F.when(dch.isNotNull(), F.coalesce(get("$.Hypothesis_Comparison.hypothesis2"), F.lit(""))),
        "score": F.get_json_object(last, "$.score").cast("double"),
        "decision": F.get_json_object(last, "$.decision"),
        **{t: F.coalesce(F.get_json_object(last, f"$.tallies.{t}").cast("int"), number) for t in _TALLY},
        "total_relevant_abstracts": F.when(dch.isNotNull(), get("$.total_relevant_abstracts").cast("int")),
        "original_json": F.col("j"),
    }
    return each.select(*[c.alias(n) for n, c in cols.items()])


def collect_results(spark: SparkSession, folder: str) -> DataFrame:
    """parse_results of all JSON files below a folder, without debug folders and the job's own files at the root."""
    root = folder.rstrip("/")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    raw = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    below = F.regexp_replace("path", "^file:/*", "/")
    own = F.substring_index(below, root.removeprefix("file://") + "/", -1)
    kept = raw.where(~own.rlike("(^|/)debug/") & ~own.isin("config.json", "secrets.json"))
    if kept.isEmpty():
        raise FileNotFoundError(f"no result files in {folder}")
    return parse_results(kept)


def missing_iterations(results: DataFrame, expected: int) -> DataFrame:
    """(iteration) of 1..expected without a result."""
    return results.sparkSession.range(1, expected + 1).select(F.col("id").cast("int").alias("iteration")).join(results.select("iteration").distinct(), "iteration", "left_anti")
