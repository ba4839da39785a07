"""Association of terms: counts of documents, tests, scores, top articles; pairs, and chains of three terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.operators.corpus import MAX_YEAR, MIN_YEAR, count_documents, in_years, with_metadata
from corpusloom.operators.search import search
from corpusloom.operators.terms import sanitize
from corpusloom.session import materialize

#: Fixed value: first terms added to the top ones when those without valid continuation are replaced.
PADDING = 20
_PAIR = "x_no int, y_no int, x_term string, y_term string"


class UserError(ValueError):
    """An error whose text is meant for the user."""


@dataclass
class Params:
    """Parameters of an association job; a_terms and b_terms, and c_terms for chains."""

    a_terms: list[str]
    b_terms: list[str]
    c_terms: list[str] | None = None
    censor_year_lower: int = MIN_YEAR
    censor_year_upper: int = MAX_YEAR
    scoring: str = "fet"
    return_pmids: bool = False
    top_n_articles_most_cited: int = 0
    top_n_articles_most_recent: int = 10
    top_n_articles_highest_impact_factor: int = 0
    query_knowledge_graph: bool = False
    rel_pvalue_cutoff: float = 1e-5
    top_n_ab: int = 50
    ab_fet_threshold: float = 1e-5
    bc_fet_threshold: float = 0.9999
    valid_bc_hit_pval: float = 1.0
    paired: bool = False
    id: str | None = None
    as_of_year: int | None = field(default=None)

    #: Older names of parameters.
    ALIASES = {"censor_year": "censor_year_upper", "top_n_articles": "top_n_articles_most_cited", "top_n": "top_n_ab"}

    @classmethod
    def of(cls, values: dict) -> Params:
        return cls(**{cls.ALIASES.get(k, k): v for k, v in values.items()})

    def validated(self) -> Params:
        self.censor_year_lower = max(MIN_YEAR, self.censor_year_lower)
        self.censor_year_upper = min(MAX_YEAR, self.censor_year_upper)
        rules = [
            (not self.a_terms, "a_terms must not be empty"),
            (not self.b_terms, "b_terms must not be empty"),
            (self.censor_year_lower > self.censor_year_upper, "censor_year_lower is after censor_year_upper"),
            (len(self.a_terms or []) > 100, "there may be at most 100 a_terms"),
            (self.scoring not in ("fet", "chi-square"), "scoring must be 'fet' or 'chi-square'"),
            (self.paired and len(self.a_terms or []) != len(self.b_terms or []), "paired lists must have the same length"),
            (self.paired and bool(self.c_terms) and len(self.a_terms or []) != len(self.c_terms or []), "paired lists must have the same length"),
            (bool(self.c_terms) and not self.paired and len(self.a_terms or []) > 1, "chains start from one a_term"),
            (bool(self.c_terms) and not (self.top_n_ab or 0) > 0, "top_n_ab must be positive"),
        ]
        for bad, text in rules:
            if bad:
                raise UserError(text)
        return self


@dataclass
class Corpus:
    """The tables a job works on; all but docs are optional.

    kept: (term, pmid), the stored documents of the sanitized terms kept_terms.
    """

    docs: DataFrame
    postings: DataFrame | None = None
    relationships: DataFrame | None = None
    kept: DataFrame | None = None
    kept_terms: frozenset[str] = frozenset()

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession


class Sets:
    """Documents of the distinct terms of a job, found in one pass and written once."""

    def __init__(self, corpus: Corpus, terms: list[str], p: Params):
        self.corpus, self.p = corpus, p
        self.terms = list(dict.fromkeys(terms))
        self.number = {t: i for i, t in enumerate(self.terms)}
        clean = {t: sanitize(t) for t in self.terms}
        stored = {t for t in self.terms if clean[t] in corpus.kept_terms}
        # an empty term finds nothing, so the others keep their numbers
        found = search(corpus.docs, ["" if t in stored else t for t in self.terms], p.censor_year_lower, p.censor_year_upper, corpus.postings)
        if stored:
            numbers = corpus.spark.createDataFrame([(clean[t], self.number[t]) for t in self.terms if t in stored], "term string, term_no int")
            lists = corpus.kept.where(F.col("term").isin(sorted({clean[t] for t in stored}))).join(numbers, "term")
            live = in_years(corpus.docs, p.censor_year_lower, p.censor_year_upper).select("pmid")
            found = found.unionByName(lists.join(live, "pmid", "left_semi").select("term_no", "pmid"))
        if p.return_pmids:
            found = found.join(with_metadata(corpus.docs).select("pmid", "year", "citations"), "pmid").select("term_no", "pmid", "year", "citations")
        self.members = materialize(found, "members")
        self.sizes = self.members.groupBy("term_no").agg(F.count(F.lit(1)).alias("n"))
        self.total = count_documents(corpus.docs, p.censor_year_lower, p.censor_year_upper).first()[0]

    def _meet(self, wanted: DataFrame) -> DataFrame:
        left = self.members.withColumnRenamed("term_no", "x_no").join(wanted.select("x_no").distinct(), "x_no", "left_semi")
        right = self.members.select(F.col("term_no").alias("y_no"), "pmid").join(wanted.select("y_no").distinct(), "y_no", "left_semi")
        return left.join(right, "pmid")

    def meet(self, pairs: DataFrame) -> DataFrame:
        """The documents that hold both terms of pairs (x_no, y_no)."""
        wanted = pairs.select("x_no", "y_no").distinct()
        return self._meet(wanted).join(wanted, ["x_no", "y_no"], "left_semi")

    def test(self, pairs: DataFrame, x: str, y: str) -> DataFrame:
        """pairs (x_no, y_no) with counts, ratio, p-value and score of the prefix xy; pairs that never meet too.

        Documents meet on pmid, so each brings the pairs of the few terms it holds, whatever the number of asked pairs;
        counts are combined before their shuffle, and only then the asked pairs are looked up.
        """
        p, xy = self.p, f"{x}{y}"
        wanted = pairs.select("x_no", "y_no").distinct()
        meet = self._meet(wanted)
        both = meet.groupBy("x_no", "y_no").agg(F.count(F.lit(1)).alias(f"{xy}_count"))
        nx, ny = (self.sizes.select(F.col("term_no").alias(f"{s}_no"), F.col("n").alias(f"{t}_count")) for s, t in (("x", x), ("y", y)))
        out = wanted.join(nx, "x_no", "left").join(ny, "y_no", "left").join(both, ["x_no", "y_no"], "left").fillna(0, [f"{x}_count", f"{y}_count", f"{xy}_count"])
        n, c = F.lit(self.total).cast("long"), {k: F.col(f"{k}_count") for k in (x, y, xy)}
        out = out.withColumn(f"{xy}_pvalue", stats.p_value(c[xy], c[x], c[y], n, p.scoring)).withColumn(f"{xy}_sort_ratio", stats.sort_ratio(c[xy], c[y]))
        out = out.withColumn(f"{xy}_pred_score", stats.prediction_score(F.col(f"{xy}_pvalue"), F.col(f"{xy}_sort_ratio")))
        if p.return_pmids:
            tops = top_articles(meet.join(wanted, ["x_no", "y_no"], "left_semi"), ["x_no", "y_no"], p)
            out = out.join(tops.withColumnRenamed("pmids", f"{xy}_pmid_intersection"), ["x_no", "y_no"], "left")
            out = out.withColumn(f"{xy}_pmid_intersection", F.coalesce(f"{xy}_pmid_intersection", F.array().cast("array<bigint>")))
        else:
            out = out.withColumn(f"{xy}_pmid_intersection", F.lit(None).cast("array<bigint>"))
        return out

    def pairs(self, couples: list[tuple[str, str]]) -> DataFrame:
        return self.corpus.spark.createDataFrame([(self.number[a], self.number[b], a, b) for a, b in dict.fromkeys(couples)], _PAIR)

    def asked(self, a_terms: list[str], b_terms: list[str], paired: bool) -> DataFrame:
        """(a_term, b_term, x_no, y_no, a_index, b_index): the aligned pairs, or every b-term with each of the few a-terms."""
        b = self.corpus.spark.createDataFrame([(t, self.number[t], j) for j, t in enumerate(b_terms)], "b_term string, y_no int, b_index int")
        a = [F.struct(F.lit(t).alias("a_term"), F.lit(self.number[t]).alias("x_no"), F.lit(i).alias("a_index")) for i, t in enumerate(a_terms)]
        each = F.array(F.get(F.array(*a), F.col("b_index"))) if paired else F.array(*a)
        return b.withColumn("a", F.explode(each)).select("a.a_term", "b_term", "a.x_no", "y_no", "a.a_index", "b_index")


def ranked(meet: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. The limit is applied before the shuffle too, so a hot key sends n rows a task."""
    return meet.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def impact(as_of_year: int | None) -> F.Column:
    now = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    return F.col("citations") / (now - F.col("year") + F.lit(0.5))


def top_articles(meet: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """(keys, pmids): the union of the most recent, most cited and highest-impact articles, sorted."""
    orders = [
        (p.top_n_articles_most_recent, [F.col("year").desc(), F.col("pmid").desc()]),
        (p.top_n_articles_most_cited, [F.col("citations").desc(), F.col("pmid").desc()]),
        (p.top_n_articles_highest_impact_factor, [impact(p.as_of_year).desc(), F.col("pmid").desc()]),
    ]
    parts = [ranked(meet, keys, o, n).select(*keys, "pmid") for n, o in orders if n and n > 0]
    if not parts:
        return meet.limit(0).groupBy(*keys).agg(F.collect_set("pmid").alias("pmids"))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out.groupBy(*keys).agg(F.sort_array(F.collect_set("pmid")).alias("pmids"))


def _edges(corpus: Corpus, df: DataFrame, x: str, y: str, p: Params) -> DataFrame:
    """Adds xy_relationship where the p-value is at most the cutoff."""
    name = f"{x}{y}_relationship"
    kind = "array<struct<a_term:string,a_type:string,b_term:string,b_type:string,relationship:string,pmids:array<bigint>,source:string>>"
    if not p.query_knowledge_graph or corpus.relationships is None:
        return df.withColumn(name, F.lit(None).cast(kind))
    from corpusloom.operators.knowledge import between

    wanted = df.where(F.col(f"{x}{y}_pvalue") <= p.rel_pvalue_cutoff).select(F.col(f"{x}_term").alias("a"), F.col(f"{y}_term").alias("b")).distinct()
    found = between(corpus.relationships, wanted, corpus.docs, p.censor_year_lower, p.censor_year_upper)
    per = found.groupBy(F.col("a").alias(f"{x}_term"), F.col("b").alias(f"{y}_term")).agg(F.array_sort(F.collect_list(F.struct("a_term", "a_type", "b_term", "b_type", "relationship", "pmids", "source"))).cast(kind).alias(name))
    out = df.join(per, [f"{x}_term", f"{y}_term"], "left")
    return out.withColumn(name, F.when(F.col(f"{x}{y}_pvalue") <= p.rel_pvalue_cutoff, F.coalesce(name, F.array().cast(kind))))


def associate_pairs(corpus: Corpus, p: Params) -> DataFrame:
    """All (or, if paired, the aligned) pairs of a- and b-terms, the best first; ties in order of b, then a.

    Every asked pair has a row, also if the terms never meet; repeated terms repeat rows.
    """
    p = p.validated()
    sets = Sets(corpus, [*p.a_terms, *p.b_terms], p)
    asked = sets.asked(p.a_terms, p.b_terms, p.paired)
    tested = sets.test(asked, "a", "b")
    out = _edges(corpus, asked.join(tested, ["x_no", "y_no"]).drop("x_no", "y_no"), "a", "b", p)
    return out.withColumn("total_count", F.lit(sets.total).cast("long")).orderBy(F.col("ab_pred_score").desc(), "b_index", "a_index")


def associate_chains(corpus: Corpus, p: Params) -> DataFrame:
    """Chains a - b - c: the top pairs of a and b, continued by every c that is associated with b, the best first.

    With valid_bc_hit_pval below 1 more pairs are continued, and only those among the first top_n_ab of all valid pairs
    whose b has a valid continuation are kept. paired takes the aligned triples within both thresholds instead.
    """
    p = p.validated()
    if not p.c_terms:
        raise UserError("chains need c_terms")
    spark = corpus.spark
    sets = Sets(corpus, [*p.a_terms, *p.b_terms, *p.c_terms], p)
    num = sets.number
    if p.paired:
        rows = [(a, b, c, num[a], num[b], num[c], i, i) for i, (a, b, c) in enumerate(zip(p.a_terms, p.b_terms, p.c_terms))]
        firsts = spark.createDataFrame(rows, "a_term string, b_term string, c_term string, a_no int, b_no int, c_no int, c_index int, ab_rank int")
        ab = _tested(sets, firsts.select(F.col("a_no").alias("x_no"), F.col("b_no").alias("y_no")), "a", "b")
        chains = firsts.join(ab, ["a_no", "b_no"]).where(F.col("ab_pvalue") <= p.ab_fet_threshold)
        chains = _edges(corpus, chains, "a", "b", p)
        ranked_ab = None
    else:
        asked = sets.asked(p.a_terms, p.b_terms, False).withColumnsRenamed({"x_no": "a_no", "y_no": "b_no"})
        ab = _tested(sets, asked.select(F.col("a_no").alias("x_no"), F.col("b_no").alias("y_no")), "a", "b")
        best = [F.col("ab_pred_score").desc(), "b_index", "a_index"]
        ranked_ab = materialize(asked.join(ab, ["a_no", "b_no"]).where(F.col("ab_pvalue") <= p.ab_fet_threshold), "valid")
        padding = PADDING if p.valid_bc_hit_pval < 1.0 else 0
        first = ranked_ab.orderBy(*best).limit(p.top_n_ab + padding)  # only these are put in one task to number them
        top = first.withColumn("ab_rank", F.row_number().over(Window.orderBy(*best))).drop("a_index", "b_index")
        top = _edges(corpus, materialize(top, "ranked"), "a", "b", p)
        last = F.array(*[F.struct(F.lit(c).alias("c_term"), F.lit(num[c]).alias("c_no"), F.lit(i).alias("c_index")) for i, c in enumerate(p.c_terms)])
        chains = top.withColumn("c", F.explode(last)).select(*top.columns, "c.c_term", "c.c_no", "c.c_index")  # the job's own list
    bc = _tested(sets, chains.select(F.col("b_no").alias("x_no"), F.col("c_no").alias("y_no")), "b", "c").drop("b_count")
    ac = _tested(sets, chains.select(F.col("a_no").alias("x_no"), F.col("c_no").alias("y_no")), "a", "c").drop("a_count", "c_count")
    out = chains.join(bc, ["b_no", "c_no"]).where(F.col("bc_pvalue") <= p.bc_fet_threshold).join(ac, ["a_no", "c_no"])
    out = _edges(corpus, _edges(corpus, out, "b", "c", p), "a", "c", p)
    if ranked_ab is not None and p.valid_bc_hit_pval < 1.0:
        out = materialize(out, "chains")
        good = out.where(F.col("bc_pvalue") <= p.valid_bc_hit_pval).select("b_term").distinct()
        kept = ranked_ab.join(good, "b_term", "left_semi").orderBy(*best).limit(p.top_n_ab).select("b_term").distinct()
        out = out.join(kept, "b_term", "left_semi")
    return out.drop("a_no", "b_no", "c_no").withColumn("total_count", F.lit(sets.total).cast("long")).orderBy(F.col("bc_pred_score").desc(), "c_index", "ab_rank")


def _tested(sets: Sets, pairs: DataFrame, x: str, y: str) -> DataFrame:
    return sets.test(pairs, x, y).withColumnsRenamed({"x_no": f"{x}_no", "y_no": f"{y}_no"})


def associate(corpus: Corpus, p: Params) -> DataFrame:
    return associate_chains(corpus, p) if p.c_terms else associate_pairs(corpus, p)
