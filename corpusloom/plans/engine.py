"""Registered queries of the corpus engine: text, index, search, association, edges, upserts, sources, evaluations, jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import association, corpus, hypotheses, index, jobs, knowledge, terms
from corpusloom.operators.association import Params
from corpusloom.operators.dedup import once_per_id
from corpusloom.operators.search import search
from corpusloom.plans.tables import table
from corpusloom.session import scratch
from corpusloom.sources import records

A_TERMS = ["tyvi1", "pellelr cortex", "vimi9&(risk|dose|level)"]
B_TERMS = ["older adults", "regimen | usual care", "no difference in", "ulmovt type-2 anemia", "tyvurdolib_acetate", "risk & (dose", "zzzz", "older adults"]
C_TERMS = ["treated animals", "knockout animals", "therapy", "were enrolled between", "zzzz"]
SEARCHES = {
    "search_unigram": ["risk", "Therapy", "zzzz"],
    "search_bigram": ["older adults", "usual-care", "care usual"],
    "search_phrase": ["no difference in", "were enrolled between", "ulmovt type 2 anemia", "at a dose of"],
    "search_boolean": ["(tyvi1|vimi9)&risk", "dose & older adults | level & usual care", "(risk|dose)&(level|therapy)&regimen", "risk (dose)", "& risk &", "risk | | dose", "()"],
}
YEARS = (1990, 2009)
AS_OF = 2025
WORK_YEARS = [(2020, 2025, None), (2020, 2022, 1), (2020, 2025, 2), (2020, 2024, 2), (2020, 2020, 1), (2020, 2020, 5), (2022, 2020, 1)]
PATHS = ["/job/output/iteration_3/x.json", "/job/output/x.json", "/job/output/results/iteration_2/x.json", "/iteration_1/a/iteration_10/b.json"]
RESULTS = {
    "/job/iteration_1/a.json": {"A_B_Relationship": {"a_term": "a", "b_term": "b", "Result": ["Score: 1"]}},
    "/job/iteration_3/b.json": [
        {"A_B_C_Relationship": {"a_term": "a", "b_term": "b", "c_term": "c", "Result": "r"}, "A_C_Relationship": {"a_term": "a2", "c_term": "c2", "Result": "s"}},
        {"Hypothesis_Comparison": {"hypothesis1": "h1", "Result": [{"score": 1, "decision": "x"}, {"score": 2.5, "decision": "y", "tallies": {"support_H1": 3}}]}, "total_relevant_abstracts": 9},
    ],
}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_documents").select("uuid", "is_indexed", "pmid", *corpus.FIELDS)


_INDEXES: dict[tuple[str, str], str] = {}


def postings(spark: SparkSession, d: str) -> DataFrame:
    """The written index of a folder's documents; the first query of a session that needs it builds it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _INDEXES:
        folder = scratch(spark, "index")
        index.write_postings(index.build_postings(docs(spark, d)), folder)
        _INDEXES[at] = folder
    return spark.read.parquet(_INDEXES[at])


def _corpus(spark: SparkSession, d: str, edges: bool = False) -> association.Corpus:
    return association.Corpus(docs(spark, d), postings(spark, d), knowledge.load_edges(_edges(spark, d)) if edges else None)


def index_build(spark, d):
    """A whole index, written; its n-grams and postings by order."""
    folder = scratch(spark, "index")
    index.write_postings(index.build_postings(docs(spark, d)), folder)
    return spark.read.parquet(folder).groupBy("n").agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("ngram").alias("n_ngrams"))


def tokenize_documents(spark, d):
    return docs(spark, d).select("pmid", X.words("title").alias("title_words"), X.words("abstract").alias("abstract_words"))


def _asked_terms(spark, d):
    j = table(spark, d, "kinderminer_jobs")
    return j.select(F.explode(F.concat(F.coalesce("a_terms", F.array()), F.coalesce("b_terms", F.array()))).alias("term")).where("term IS NOT NULL").distinct()


def sanitize_terms(spark, d):
    return _asked_terms(spark, d).select("term", X.sanitized("term").alias("with_operators"), X.sanitized("term", False).alias("words_only"))


def split_subterms(spark, d):
    return _asked_terms(spark, d).select("term", X.subterms("term").alias("subterms"))


def ngram_counts(spark, d):
    return index.build_postings(docs(spark, d)).groupBy("ngram", "n").agg(F.count(F.lit(1)).alias("n_positions"), F.count_distinct("pmid").alias("n_documents"))


def unigram_postings(spark, d):
    return index.unigram_postings(docs(spark, d))


def bigram_positions(spark, d):
    return index.bigram_positions(docs(spark, d))


def shard_assignment(spark, d):
    """The shards of all fragments' n-grams, computed and as delivered."""
    f = table(spark, d, "fragmented_shard").where("ngram IS NOT NULL").select(X.trimmed_lower("ngram").alias("ngram"), "shard").distinct()
    return f.select("ngram", "shard", X.shard_of("ngram").alias("computed"), X.gram_order("ngram").alias("n"), X.document_bucket(F.lit(10_029_447)).alias("bucket"))


def _search(name):
    def run(spark, d):
        names = spark.createDataFrame(list(enumerate(SEARCHES[name])), "term_no int, term string")
        return search(docs(spark, d), SEARCHES[name], postings=postings(spark, d)).join(names, "term_no").select("term", "pmid")

    run.__name__ = name
    return run


def search_year_censored(spark, d):
    found = [search(docs(spark, d), ["no difference in"], *y, postings=postings(spark, d)).select(F.lit(f"{y[0]}-{y[1]}").alias("years"), "pmid") for y in [(1000, 2100), YEARS, (2100, 2100)]]
    return found[0].unionByName(found[1]).unionByName(found[2])


def query_cache(spark, d):
    """Document lists of the asked terms, as a table that searches can join."""
    asked = ["older adults", "no difference in", "regimen | usual care"]
    names = spark.createDataFrame(list(enumerate(asked)), "term_no int, term string")
    return search(docs(spark, d), asked, postings=postings(spark, d)).join(names, "term_no").groupBy("term").agg(F.count(F.lit(1)).alias("n_documents"), F.min("pmid").alias("first_pmid"), F.max("pmid").alias("last_pmid"))


def count_documents_by_range(spark, d):
    spans = [(1000, 2100), YEARS, (2019, 2019), (2100, 2100)]
    parts = [corpus.count_documents(docs(spark, d), *s).select(F.lit(s[0]).alias("first_year"), F.lit(s[1]).alias("last_year"), "n_documents") for s in spans]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def get_document(spark, d):
    return corpus.get_document(docs(spark, d), 10_000_011).select("pmid", "title", "pub_year", "citation_count")


def multi_get(spark, d):
    asked = [10_000_085, 10_000_011, 1, 10_000_025, 10_000_011]
    return corpus.get_documents(docs(spark, d), asked).select("position", "pmid", "title")


def distinct_origins(spark, d):
    return corpus.origins(docs(spark, d))


def metadata_clamp(spark, d):
    return corpus.with_metadata(docs(spark, d)).select("pmid", "pub_year", "year", "citation_count", "citations")


def _rounded(df: DataFrame, prefixes: list[str]) -> DataFrame:
    for xy in prefixes:
        p = F.col(f"{xy}_pvalue")
        df = df.withColumn(f"{xy}_neg_log_p", F.abs(F.round(F.when(p == 0, F.lit(323.0)).otherwise(-F.log10(p)), 5))).drop(f"{xy}_pvalue")
        df = df.withColumn(f"{xy}_sort_ratio", F.abs(F.round(f"{xy}_sort_ratio", 6))).withColumn(f"{xy}_pred_score", F.abs(F.round(f"{xy}_pred_score", 6)))
    return df


def _pairs(spark, d, **more):
    return association.associate(_corpus(spark, d, edges=True), Params(A_TERMS, B_TERMS, as_of_year=AS_OF, **more))


_PAIR_COLUMNS = ["a_index", "b_index", "a_term", "b_term", "total_count", "a_count", "b_count", "ab_count", "ab_sort_ratio", "ab_neg_log_p", "ab_pred_score"]


def contingency_table(spark, d):
    r = _pairs(spark, d)
    from corpusloom.functions.stats import contingency

    cells = contingency(F.col("ab_count"), F.col("a_count"), F.col("b_count"), F.col("total_count"))
    return r.select("a_term", "b_term", *[c.alias(n) for c, n in zip(cells, ["both", "only_a", "only_b", "neither"])]).distinct()


def assoc_pairs(spark, d):
    return _rounded(_pairs(spark, d), ["ab"]).select(_PAIR_COLUMNS)


def assoc_pairs_censored(spark, d):
    return _rounded(_pairs(spark, d, censor_year_lower=YEARS[0], censor_year_upper=YEARS[1]), ["ab"]).select(_PAIR_COLUMNS)


def assoc_chi_square(spark, d):
    return _rounded(_pairs(spark, d, scoring="chi-square"), ["ab"]).select(_PAIR_COLUMNS)


def assoc_paired(spark, d):
    return _rounded(association.associate(_corpus(spark, d), Params(A_TERMS, B_TERMS[1:4], paired=True)), ["ab"]).select(_PAIR_COLUMNS)


def assoc_without_index(spark, d):
    """The same pairs with postings made on the fly."""
    c = association.Corpus(docs(spark, d))
    return _rounded(association.associate(c, Params(A_TERMS, B_TERMS)), ["ab"]).select(_PAIR_COLUMNS)


def assoc_jobs(spark, d):
    """Every pair that a job of the job table asks for, all jobs' terms being found in one pass over the index."""
    j = table(spark, d, "kinderminer_jobs").where("size(a_terms) > 0 AND size(b_terms) > 0").select("a_terms", "b_terms", F.coalesce("paired", F.lit(False)).alias("paired"))
    aligned = j.where("paired").select(F.explode(F.arrays_zip("a_terms", "b_terms")).alias("x")).select(F.col("x.a_terms").alias("x_term"), F.col("x.b_terms").alias("y_term"))
    crossed = j.where("NOT paired").select(F.explode("a_terms").alias("x_term"), "b_terms").select("x_term", F.explode("b_terms").alias("y_term"))
    asked = aligned.unionByName(crossed).where("x_term IS NOT NULL AND y_term IS NOT NULL").distinct()
    names = [r[0] for r in asked.select(F.col("x_term").alias("t")).union(asked.select("y_term")).distinct().collect()]  # the jobs' terms
    sets = association.Sets(_corpus(spark, d), names, Params([], []))
    number = spark.createDataFrame(list(sets.number.items()), "term string, no int")
    pairs = asked.join(number.select(F.col("term").alias("x_term"), F.col("no").alias("x_no")), "x_term").join(number.select(F.col("term").alias("y_term"), F.col("no").alias("y_no")), "y_term")
    tested = _rounded(sets.test(pairs, "a", "b"), ["ab"])
    return pairs.join(tested, ["x_no", "y_no"]).select(F.col("x_term").alias("a_term"), F.col("y_term").alias("b_term"), "a_count", "b_count", "ab_count", "ab_sort_ratio", "ab_neg_log_p", "ab_pred_score")


def _top(name, **counts):
    def run(spark, d):
        return _pairs(spark, d, return_pmids=True, **counts).select("a_term", "b_term", F.col("ab_pmid_intersection").alias("pmids")).distinct()

    run.__name__ = name
    return run


_TOPS = {
    "top_recent": {"top_n_articles_most_recent": 5},
    "top_cited": {"top_n_articles_most_recent": 0, "top_n_articles_most_cited": 5},
    "top_impact": {"top_n_articles_most_recent": 0, "top_n_articles_highest_impact_factor": 5},
    "top_union": {"top_n_articles_most_recent": 3, "top_n_articles_most_cited": 3, "top_n_articles_highest_impact_factor": 3},
}

_CHAIN_COLUMNS = ["a_term", "b_term", "c_term", "total_count", "a_count", "b_count", "c_count", *[f"{xy}_{m}" for xy in ("ab", "bc", "ac") for m in ("count", "sort_ratio", "neg_log_p", "pred_score")]]


def _chains(spark, d, **more):
    return _rounded(association.associate(_corpus(spark, d), Params(more.pop("a", A_TERMS[:1]), B_TERMS[:7], more.pop("c", C_TERMS), ab_fet_threshold=0.9, **more)), ["ab", "bc", "ac"]).select(_CHAIN_COLUMNS)


def chain_abc(spark, d):
    return _chains(spark, d, top_n_ab=3)


def chain_padded(spark, d):
    return _chains(spark, d, top_n_ab=2, valid_bc_hit_pval=0.3)


def chain_paired(spark, d):
    p = Params(A_TERMS, B_TERMS[:3], C_TERMS[:3], paired=True, ab_fet_threshold=1.0)
    return _rounded(association.associate(_corpus(spark, d), p), ["ab", "bc", "ac"]).select(_CHAIN_COLUMNS)


def _edges(spark, d):
    return once_per_id(table(spark, d, "relationships"), "rel_id", ["head", "head_type", "relation", "tail", "tail_type", "evidence", "source"])


EDGE_PAIRS = [("tyvi1", "tyvurdolib acetate"), ("Tyvi1", "TYVI1"), ("vimi9", "tyvi1"), ("pellelr_cortex", "tyvi1"), ("zzzz", "tyvi1")]


def kg_load(spark, d):
    return knowledge.load_edges(_edges(spark, d)).groupBy("head", "relation", "tail", "source").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.size("evidence")).alias("n_evidence"))


def _between(spark, d, *years):
    pairs = spark.createDataFrame(EDGE_PAIRS, "a string, b string")
    return knowledge.between(knowledge.load_edges(_edges(spark, d)), pairs, docs(spark, d), *years)


def kg_relationships(spark, d):
    return _between(spark, d)


def kg_relationships_censored(spark, d):
    return _between(spark, d, *YEARS)


def assoc_with_kg(spark, d):
    r = association.associate(_corpus(spark, d, edges=True), Params(["tyvi1", "vimi9"], ["tyvurdolib acetate", "tyvi1", "older adults"], query_knowledge_graph=True, rel_pvalue_cutoff=0.5))
    return r.select("a_term", "b_term", "a_count", "b_count", "ab_count", F.coalesce(F.size("ab_relationship"), F.lit(-1)).alias("n_edges"))


def _updates(spark, d):
    return table(spark, d, "document_versions").select("pmid", *corpus.FIELDS, "seq")


def _nothing(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def upsert_latest(spark, d):
    """The corpus after all versions, in order of arrival."""
    return corpus.upsert(_nothing(spark), _updates(spark, d))[0].select("pmid", *corpus.FIELDS)


def upsert_partial(spark, d):
    """Updates without text, of existing and of unknown documents."""
    now = docs(spark, d).select("pmid", *corpus.FIELDS)
    bare = _updates(spark, d).select(F.when(F.col("seq") % 2 == 0, F.col("pmid")).otherwise(F.col("pmid") + 500_000_000).alias("pmid"), F.when(F.col("seq") % 3 == 0, F.col("pub_year")).alias("pub_year"), *[F.lit(None).cast("string").alias(c) for c in corpus.TEXTS], F.lit(None).cast("string").alias("origin"), (F.col("seq") % 1000).alias("citation_count"), "seq")
    return corpus.upsert(now, bare)[0].select("pmid", "pub_year", "title", "citation_count", "changed")


def upsert_noop(spark, d):
    """The canonical rows again: nothing changes, whatever their origin."""
    now = docs(spark, d).select("pmid", *corpus.FIELDS)
    again = now.withColumn("origin", F.lit("elsewhere")).withColumn("seq", F.lit(1))
    out, versions = corpus.upsert(now, again)
    return out.groupBy("changed").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("origin") == "elsewhere").alias("n_moved"))


def version_history(spark, d):
    """Versions stored for each document while all rows arrive."""
    return corpus.upsert(_nothing(spark), _updates(spark, d).distinct())[1].groupBy("pmid").agg(F.count(F.lit(1)).alias("n_versions"), F.max("seq").alias("last_seq"))


def version_conflicts(spark, d):
    return index.version_conflicts(table(spark, d, "document_versions"), docs(spark, d)).select("uuid", "pmid")


def removed_ngrams(spark, d):
    """N-grams that an indexed version has and the canonical text no longer has."""
    old = index.version_conflicts(table(spark, d, "document_versions"), docs(spark, d)).select("pmid", "title", "abstract")
    return index.removed_ngrams(old, docs(spark, d))


def reindex_incremental(spark, d):
    """Postings after documents went from their first versions to the canonical text: equal to a new build."""
    first = table(spark, d, "document_versions").groupBy("pmid").agg(F.min(F.struct("seq", "title", "abstract")).alias("v")).select("pmid", "v.title", "v.abstract")
    old = index.build_postings(first)
    before = first.select("pmid", F.struct("title", "abstract").alias("_before"))
    now = docs(spark, d).select("pmid", "title", "abstract").join(before, "pmid", "left")
    changed = now.where(F.col("_before").isNull() | ~F.struct("title", "abstract").eqNullSafe(F.col("_before"))).drop("_before")
    return index.reindex(old, changed).groupBy("ngram").agg(F.count(F.lit(1)).alias("n_positions"), F.count_distinct("pmid").alias("n_documents"))


def defragment(spark, d):
    f = once_per_id(table(spark, d, "fragmented_shard"), "frag_id", ["ngram", "data"]).withColumn("ngram", X.trimmed_lower("ngram"))
    return index.defragment(f).groupBy("ngram").agg(F.count_distinct("pmid").alias("n_pmids"), F.count("pos").alias("n_positions"))


def delete_documents(spark, d):
    gone = [10_000_011, 10_000_025]
    return corpus.delete_documents(docs(spark, d), gone).select("pmid")


def file_anti_join(spark, d):
    """Source files not read yet: of all origins, those without an indexed document."""
    every = table(spark, d, "document_versions").where("origin <> ''").select(F.col("origin").alias("name")).distinct()
    done = docs(spark, d).where("is_indexed = 1").select("origin")
    return records.files_to_read(every.where("name < 'feed22n0020'"), every.where("name >= 'feed22n0020'"), done, 25)


def year_windows(spark, d):
    rows = spark.createDataFrame(WORK_YEARS, "first int, last int, step int")
    return rows.select("*", F.explode_outer(hypotheses.year_windows(F.col("first"), F.col("last"), F.col("step"))).alias("w")).select("first", "last", "step", "w.lo", "w.hi")


def scorer_inputs(spark, d):
    """Input rows of the external scorer, article lists looked up where the caller gave none."""
    data = [{"a_term": "tyvi1", "b_term": "older adults"}, {"a_term": "vimi9", "b_term": "usual care", "ab_pmid_intersection": [3, "5"]}]
    filled = hypotheses.fill_articles(_corpus(spark, d), data, 2015, 2018)
    return hypotheses.scorer_input(filled, chains=False)


def parse_results(spark, d):
    rows = [(p, json.dumps(j)) for p, j in RESULTS.items()]
    return hypotheses.parse_results(spark.createDataFrame(rows, "path string, json string")).drop("original_json")


def iteration_from_path(spark, d):
    return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", X.iteration_of("path").alias("iteration"))


def missing_iterations(spark, d):
    return hypotheses.missing_iterations(parse_results(spark, d), 4)


def xml_ingest(spark, d):
    """The canonical documents written as gzipped XML files and read again.

    A third of them has the year in the completion date only and a third in the free text of the date; abstracts have two
    parts.
    """
    out = scratch(spark, "xml")
    form = F.col("pmid") % 3
    year = F.col("pub_year").cast("string")
    issue = F.struct(F.when(form == 0, year).alias("Year"), F.when(form == 2, F.concat(F.lit("Winter "), year, F.lit(" Jan-Feb"))).alias("MedlineDate"))
    date = F.struct(F.struct(issue.alias("PubDate")).alias("JournalIssue"))
    parts = F.array(F.substring("abstract", 1, 50), F.expr("substring(abstract, 51)"))
    article = F.struct(date.alias("Journal"), F.col("title").alias("ArticleTitle"), F.struct(parts.alias("AbstractText")).alias("Abstract"))
    completed = F.struct(F.when(form == 1, year).alias("Year"))
    citation = F.struct(F.struct(F.col("pmid").cast("string").alias("_VALUE"), F.lit("1").alias("_Version")).alias("PMID"), completed.alias("DateCompleted"), article.alias("Article"))
    docs(spark, d).select(citation.alias("MedlineCitation")).write.format("xml").options(rowTag="PubmedArticle", rootTag="PubmedArticleSet", compression="gzip").save(out)
    return records.read_articles(spark, out).select("pmid", "pub_year", "title", "abstract")


def icite_ingest(spark, d):
    """Citation counts written as JSON lines, read again and applied."""
    out = scratch(spark, "jsonl")
    corpus.with_metadata(docs(spark, d)).select("pmid", (F.col("citations") + 1).alias("citation_count")).write.json(out)
    counts = records.read_citations(spark, out)
    updates = counts.select("pmid", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in corpus.SCHEMA.split(", ")) if c not in ("pmid", "citation_count")], "citation_count", F.lit(1).alias("seq"))
    return corpus.upsert(docs(spark, d).select("pmid", *corpus.FIELDS), updates)[0].select("pmid", "citation_count")


def kg_tsv_ingest(spark, d):
    """Edges written as tab-separated text and read again; edges of fewer than two pmids are left out."""
    out = scratch(spark, "tsv")
    e = _edges(spark, d).where("evidence IS NOT NULL")
    e.select("head", "head_type", "relation", "tail", "tail_type", "evidence").write.option("sep", "\t").option("header", True).option("quote", "\u0000").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return records.read_edges(spark, out, "file").groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.size("evidence")).alias("n_evidence"))


def job_listing(spark, d):
    """Jobs as a dashboard lists them."""
    j = table(spark, d, "kinderminer_jobs").groupBy("id").agg(F.max(F.struct("created_at", F.array_join("a_terms", ", "))).alias("j"))
    rows = j.select("id", F.lit("finished").alias("status"), F.col("j.col2").alias("description"), F.col("j.created_at").alias("created_at"))
    return jobs.listing(rows, "America/Chicago")


def job_priority(spark, d):
    j = table(spark, d, "kinderminer_jobs")
    n = F.greatest(F.size("a_terms"), F.lit(0)) + F.greatest(F.size("b_terms"), F.lit(0)) + F.greatest(F.size("c_terms"), F.lit(0))
    return j.select("id", n.alias("n_terms"), jobs.priority(n).alias("priority")).distinct()


def worker_order(spark, d):
    rows = [("w3", "LOW"), ("w1", "INDEXING"), ("w2", "HIGH"), ("w0", "OTHER"), ("w4", "MEDIUM")]
    out = jobs.by_queue(spark.createDataFrame(rows, "name string, queue string"))
    return out.withColumn("progress", jobs.clamp_progress(F.lit(1.5)))


def user_errors(spark, d):
    rows = [("x -BEGIN USER-FACING ERROR- bad term -END USER-FACING ERROR- y",), ("Traceback",), (None,), ("-BEGIN USER-FACING ERROR- a -BEGIN USER-FACING ERROR- b",)]
    return spark.createDataFrame(rows, "trace string").select("trace", X.user_error("trace").alias("message"))


_FUNCTIONS = [
    tokenize_documents, sanitize_terms, split_subterms, ngram_counts, index_build, unigram_postings, bigram_positions, shard_assignment,
    *[_search(n) for n in SEARCHES], search_year_censored, query_cache, count_documents_by_range, get_document, multi_get, distinct_origins, metadata_clamp,
    contingency_table, assoc_pairs, assoc_pairs_censored, assoc_chi_square, assoc_paired, assoc_without_index, assoc_jobs, *[_top(n, **c) for n, c in _TOPS.items()],
    chain_abc, chain_padded, chain_paired, kg_load, kg_relationships, kg_relationships_censored, assoc_with_kg,
    upsert_latest, upsert_partial, upsert_noop, version_history, version_conflicts, removed_ngrams, reindex_incremental, defragment, delete_documents,
    file_anti_join, year_windows, scorer_inputs, parse_results, iteration_from_path, missing_iterations, xml_ingest, icite_ingest, kg_tsv_ingest,
    job_listing, job_priority, worker_order, user_errors,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

# --- SQL -------------------------------------------------------------------------------------------------------------

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_DOCS = f"""
docs AS (SELECT pmid, title, abstract, origin, pub_year, citation_count, is_indexed, CASE WHEN pub_year BETWEEN 1000 AND 2100 THEN pub_year ELSE 2100 END AS yr,
  CASE WHEN citation_count BETWEEN 0 AND 1000000000 THEN citation_count ELSE 0 END AS cites,
  ' ' || array_to_string({_W.format("title")}, ' ') || ' ' AS t, ' ' || array_to_string({_W.format("abstract")}, ' ') || ' ' AS a FROM canonical_documents)"""


def _has(*phrases: str) -> str:
    """A text holds one of the phrases."""
    return "(" + " OR ".join(f"contains(t, ' {p} ') OR contains(a, ' {p} ')" for p in phrases) + ")"


#: What the terms ask for, written out by hand so that the SQL does not depend on the parser. All others are one phrase.
_CONDITIONS = {
    "vimi9&(risk|dose|level)": f"{_has('vimi9')} AND {_has('risk', 'dose', 'level')}",
    "regimen | usual care": _has("regimen", "usual care"),
    "ulmovt type-2 anemia": _has("ulmovt type 2 anemia"),
    "tyvurdolib_acetate": _has("tyvurdolib acetate"),
    "Therapy": _has("therapy"),
    "usual-care": _has("usual care"),
    "(tyvi1|vimi9)&risk": f"{_has('tyvi1', 'vimi9')} AND {_has('risk')}",
    "dose & older adults | level & usual care": f"({_has('dose')} AND {_has('older adults')} OR {_has('level')} AND {_has('usual care')})",
    "(risk|dose)&(level|therapy)&regimen": f"{_has('risk', 'dose')} AND {_has('level', 'therapy')} AND {_has('regimen')}",
    "& risk &": _has("risk"),
} | dict.fromkeys(["risk & (dose", "risk (dose)", "risk | | dose", "()"], "false")


def _holds(term: str) -> str:
    return _CONDITIONS.get(term) or _has(term)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sets(names: list[str], where: str = "true") -> str:
    return "s AS (" + " UNION ALL ".join(f"SELECT {_quoted(t)} AS term, pmid, yr, cites FROM docs WHERE {where} AND {_holds(t)}" for t in dict.fromkeys(names)) + "), sz AS (SELECT term, count(*) AS n FROM s GROUP BY term)"


def _values(rows: list[tuple], columns: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") AS v({columns})"


#: Complementary error function: its Taylor series below 3, its continued fraction above (DuckDB has none).
_ERFC = (
    "CASE WHEN z < 3 THEN 1 - 2 / sqrt(pi()) * z * (1 + list_sum(list_transform(range(1, 70), lambda i: exp(i * ln(greatest(z, 1e-150)) * 2 - lgamma(i + 1)) * (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) / (2 * i + 1)))) "
    "ELSE exp(-z * z) / sqrt(pi()) / list_reduce(list_prepend(z, list_transform(range(1, 121), lambda i: CAST(i AS DOUBLE))), lambda acc, i: z + (121 - i) / 2 / acc) END"
)


def _test(name: str, x: str, y: str, source: str, where: str = "true", scoring: str = "fet") -> str:
    """CTE of tested pairs (x_term, y_term) of a source."""
    if scoring == "chi-square":
        return f"""
{name}0 AS (SELECT DISTINCT p.{x}_term, p.{y}_term, coalesce(sx.n, 0) AS na, coalesce(sy.n, 0) AS nb, (SELECT count(*) FROM docs WHERE {where}) AS n,
  (SELECT count(*) FROM s s1 JOIN s s2 USING (pmid) WHERE s1.term = p.{x}_term AND s2.term = p.{y}_term) AS k
  FROM {source} p LEFT JOIN sz sx ON sx.term = p.{x}_term LEFT JOIN sz sy ON sy.term = p.{y}_term),
{name}z AS (SELECT *, greatest(abs(k - CAST(na AS DOUBLE) * nb / n) - 0.5, 0) AS diff, na > 0 AND nb > 0 AND na < n AND nb < n AS ok FROM {name}0),
{name}y AS (SELECT *, CASE WHEN ok THEN sqrt(diff * diff * n * (1 / (CAST(na AS DOUBLE) * nb) + 1 / (CAST(na AS DOUBLE) * (n - nb)) + 1 / ((n - na) * CAST(nb AS DOUBLE)) + 1 / ((n - na) * CAST(n - nb AS DOUBLE))) / 2) ELSE 0.0 END AS z FROM {name}z),
{name}1 AS (SELECT *, CASE WHEN ok THEN {_ERFC} ELSE 1.0 END AS p, CASE WHEN nb = 0 THEN 0.0 ELSE k / CAST(nb AS DOUBLE) END AS ratio FROM {name}y),""" + _scored(name, x, y)
    g = lambda n, k: f"lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
    return f"""
{name}0 AS (SELECT DISTINCT p.{x}_term, p.{y}_term, coalesce(sx.n, 0) AS na, coalesce(sy.n, 0) AS nb, (SELECT count(*) FROM docs WHERE {where}) AS n,
  (SELECT count(*) FROM s s1 JOIN s s2 USING (pmid) WHERE s1.term = p.{x}_term AND s2.term = p.{y}_term) AS k
  FROM {source} p LEFT JOIN sz sx ON sx.term = p.{x}_term LEFT JOIN sz sy ON sy.term = p.{y}_term),
{name}1 AS (SELECT *, CASE WHEN k = 0 OR na >= n OR nb >= n THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(k, least(na, nb) + 1), lambda i: exp({g("na", "i")} + {g("(n - na)", "(nb - i)")} - ({g("n", "nb")}))))) END AS p,
  CASE WHEN nb = 0 THEN 0.0 ELSE k / CAST(nb AS DOUBLE) END AS ratio FROM {name}0),""" + _scored(name, x, y)


def _scored(name: str, x: str, y: str) -> str:
    xy = f"{x}{y}"
    return f"""
{name} AS (SELECT {x}_term, {y}_term, n AS total_count, na AS {x}_count, nb AS {y}_count, k AS {xy}_count, ratio AS {xy}_sort_ratio, p AS {xy}_pvalue,
  abs(round(CASE WHEN p = 0 THEN 323.0 ELSE -log10(p) END, 5)) AS {xy}_neg_log_p,
  (CASE WHEN p = 0 THEN 323.0 ELSE least(323.0, -log10(p)) END + CASE WHEN ratio = 1 THEN 323.0 ELSE least(323.0, -2500 * log10(1 - ratio)) END) / 323.0 AS {xy}_pred_score FROM {name}1)"""


def _nice(xy: str, q: str = "") -> str:
    return f"abs(round({q}{xy}_sort_ratio, 6)) AS {xy}_sort_ratio, {q}{xy}_neg_log_p, abs(round({q}{xy}_pred_score, 6)) AS {xy}_pred_score, {q}{xy}_count"


def _pair_sql(couples: list[tuple], where: str = "true", scoring: str = "fet") -> str:
    names = [t for c in couples for t in c[:2]]
    return f"WITH {_DOCS}, {_sets(names, where)}, asked AS (SELECT * FROM {_values(couples, 'a_term, b_term, a_index, b_index')}), {_test('ab', 'a', 'b', 'asked', where, scoring)} SELECT a_index, b_index, a_term, b_term, total_count, a_count, b_count, {_nice('ab')} FROM asked JOIN ab USING (a_term, b_term)"


_COUPLES = [(a, b, i, j) for j, b in enumerate(B_TERMS) for i, a in enumerate(A_TERMS)]
_ALL_PAIRS = _pair_sql(_COUPLES)


def _top_sql(orders: list[tuple[str, int]]) -> str:
    ranks = ", ".join(f"row_number() OVER (PARTITION BY a_term, b_term ORDER BY {o} DESC, pmid DESC) AS r{i}" for i, (o, _) in enumerate(orders))
    keep = " OR ".join(f"r{i} <= {n}" for i, (_, n) in enumerate(orders))
    return f"""WITH {_DOCS}, {_sets(A_TERMS + B_TERMS)}, asked AS (SELECT DISTINCT a_term, b_term FROM {_values(_COUPLES, "a_term, b_term, a_index, b_index")}),
m AS (SELECT a_term, b_term, s1.pmid, s1.yr, s1.cites FROM asked JOIN s s1 ON s1.term = a_term JOIN s s2 ON s2.term = b_term AND s2.pmid = s1.pmid),
r AS (SELECT *, {ranks} FROM m), g AS (SELECT a_term, b_term, list(pmid ORDER BY pmid) AS pmids FROM r WHERE {keep} GROUP BY 1, 2)
SELECT a_term, b_term, coalesce(pmids, []) AS pmids FROM asked LEFT JOIN g USING (a_term, b_term)"""


_IMPACT = f"cites / ({AS_OF} - yr + 0.5)"


def _chain_sql(a: list[str], b: list[str], c: list[str], pairs: list[tuple], threshold: float, top: int | None, valid: float = 1.0) -> str:
    head = f"WITH {_DOCS}, {_sets(a + b + c)}, asked AS (SELECT * FROM {_values(pairs, 'a_term, b_term, a_index, b_index')}), {_test('ab', 'a', 'b', 'asked')}, "
    if top is None:
        firsts = f"f AS (SELECT a_term, b_term, c_term, b_index AS rk FROM {_values([(x, y, z, i) for i, (x, y, z) in enumerate(zip(a, b, c))], 'a_term, b_term, c_term, b_index')} JOIN ab USING (a_term, b_term) WHERE ab_pvalue <= {threshold}), "
    else:
        pad = 20 if valid < 1 else 0
        firsts = f"rk AS (SELECT asked.a_term, asked.b_term, row_number() OVER (ORDER BY ab_pred_score DESC, b_index, a_index) AS rk FROM asked JOIN ab USING (a_term, b_term) WHERE ab_pvalue <= {threshold}), f AS (SELECT a_term, b_term, c_term, rk FROM rk, {_values([(x,) for x in c], 'c_term')} WHERE rk <= {top + pad}), "
    tail = f"{_test('bc', 'b', 'c', 'f')}, {_test('ac', 'a', 'c', 'f')}, o AS (SELECT f.*, ab.total_count, ab.a_count, ab.b_count, bc.c_count, ab.* EXCLUDE (a_term, b_term, a_count, b_count, total_count), bc.* EXCLUDE (b_term, c_term, b_count, c_count, total_count), ac.* EXCLUDE (a_term, c_term, a_count, c_count, total_count) FROM f JOIN ab USING (a_term, b_term) JOIN bc USING (b_term, c_term) JOIN ac USING (a_term, c_term) WHERE bc_pvalue <= 0.9999)"
    keep = "true" if valid >= 1 else f"b_term IN (SELECT b_term FROM (SELECT b_term, rk FROM rk WHERE b_term IN (SELECT b_term FROM o WHERE bc_pvalue <= {valid}) ORDER BY rk LIMIT {top}))"
    return head + firsts + tail + f" SELECT a_term, b_term, c_term, total_count, a_count, b_count, c_count, {_nice('ab')}, {_nice('bc')}, {_nice('ac')} FROM o WHERE {keep}"


_CHAIN_PAIRS = [(A_TERMS[0], b, 0, j) for j, b in enumerate(B_TERMS[:7])]
_ALIGNED = [(a, b, i, i) for i, (a, b) in enumerate(zip(A_TERMS, B_TERMS[:3]))]
_POST = f"""
WITH tok AS (SELECT pmid, {_W.format("title")} AS tt, {_W.format("abstract")} AS ta FROM @src),
f AS (SELECT pmid, tt AS w, 0 AS base FROM tok UNION ALL SELECT pmid, ta, greatest(len(tt) - 1, 0) + 2 FROM tok),
u AS (SELECT pmid, w, base, unnest(range(1, len(w) + 1)) AS i FROM f),
post AS (SELECT w[i] AS ngram, 1 AS n, pmid, CAST(base + i - 1 AS INTEGER) AS pos FROM u UNION ALL SELECT w[i] || ' ' || w[i + 1], 2, pmid, CAST(base + i - 1 AS INTEGER) FROM u WHERE i < len(w))
"""
_CANON = _POST.replace("@src", "canonical_documents")
_SAN = r"regexp_replace(array_to_string(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+|[&|()]'), ' '), ' ?([&|()]) ?', '\1', 'g')"
_EDGE = f"""
WITH e0 AS (SELECT DISTINCT rel_id, head, head_type, relation, tail, tail_type, evidence, source FROM relationships),
e AS (SELECT {_SAN.format("head")} AS head, head_type, relation, {_SAN.format("tail")} AS tail, tail_type, list_transform(regexp_extract_all(coalesce(evidence, ''), '[0-9]+'), lambda x: CAST(x AS BIGINT)) AS evidence, source, rel_id FROM e0)
"""
_PAIR_VALUES = _values([(a, b, terms.sanitize(a), terms.sanitize(b)) for a, b in EDGE_PAIRS], "a, b, sa, sb")
_LASTS = "last_value({0} IGNORE NULLS) OVER (PARTITION BY pmid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_UPSERT = f"""
WITH d AS (SELECT DISTINCT pmid, pub_year, title, abstract, body, origin, citation_count, seq FROM document_versions),
ex AS (SELECT *, title IS NOT NULL OR abstract IS NOT NULL OR body IS NOT NULL AS txt, max(CASE WHEN title IS NOT NULL OR abstract IS NOT NULL OR body IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pmid ORDER BY seq) AS there FROM d),
l AS (SELECT pmid, seq, txt, origin AS own, {_LASTS.format("pub_year")} AS pub_year, coalesce({_LASTS.format("title")}, '') AS title, coalesce({_LASTS.format("abstract")}, '') AS abstract, coalesce({_LASTS.format("body")}, '') AS body, coalesce({_LASTS.format("citation_count")}, 0) AS citation_count FROM ex WHERE there = 1),
c AS (SELECT *, txt AND row_number() OVER w > 1 AND pub_year IS NOT DISTINCT FROM lag(pub_year) OVER w AND title = lag(title) OVER w AND abstract = lag(abstract) OVER w AND body = lag(body) OVER w AND citation_count = lag(citation_count) OVER w AS noop FROM l WINDOW w AS (PARTITION BY pmid ORDER BY seq)),
o AS (SELECT *, coalesce(last_value(CASE WHEN NOT noop THEN own END IGNORE NULLS) OVER (PARTITION BY pmid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS origin FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY seq DESC) AS rn FROM o WHERE NOT noop)
"""
_RES = [
    (1, "a", "b", None, None, '["Score: 1"]', None, None, None, None, None, None, None, None, None, None),
    (3, "a2", "b", "c2", "r", None, "s", None, None, None, None, None, None, None, None, None),
    (3, None, None, None, None, None, None, "h1", "", 2.5, "y", 3, 0, 0, 0, 9),
]
_RES_COLUMNS = "iteration, a_term, b_term, c_term, abc_result, ab_result, ac_result, hypothesis1, hypothesis2, score, decision, support_H1, support_H2, \"both\", neither_or_inconclusive, total_relevant_abstracts"

_KG_TERMS = ["tyvi1", "vimi9", "tyvurdolib acetate", "older adults"]
_KG_PAIRS = [(a, b) for a in _KG_TERMS[:2] for b in ("tyvurdolib acetate", "tyvi1", "older adults")]
ORACLE = {
    "tokenize_documents": f"SELECT pmid, {_W.format('title')} AS title_words, {_W.format('abstract')} AS abstract_words FROM canonical_documents",
    "sanitize_terms": f"WITH t AS (SELECT DISTINCT unnest(list_concat(coalesce(a_terms, []), coalesce(b_terms, []))) AS term FROM kinderminer_jobs) SELECT term, {_SAN.format('term')} AS with_operators, array_to_string({_W.format('term')}, ' ') AS words_only FROM t WHERE term IS NOT NULL",
    "split_subterms": f"WITH t AS (SELECT DISTINCT unnest(list_concat(coalesce(a_terms, []), coalesce(b_terms, []))) AS term FROM kinderminer_jobs) SELECT term, list_filter(list_transform(regexp_split_to_array({_SAN.format('term')}, '[&|()]'), lambda x: trim(x)), lambda x: x <> '') AS subterms FROM t WHERE term IS NOT NULL",
    "ngram_counts": _CANON + "SELECT ngram, n, count(*) AS n_positions, count(DISTINCT pmid) AS n_documents FROM post GROUP BY 1, 2",
    "index_build": _CANON + "SELECT n, count(*) AS n_postings, count(DISTINCT ngram) AS n_ngrams FROM post GROUP BY 1",
    "unigram_postings": _CANON + "SELECT DISTINCT ngram, pmid FROM post WHERE n = 1",
    "bigram_positions": _CANON + "SELECT ngram, pmid, pos FROM post WHERE n = 2",
    **{n: f"WITH {_DOCS} " + " UNION ALL ".join(f"SELECT {_quoted(t)} AS term, pmid FROM docs WHERE {_holds(t)}" for t in ts) for n, ts in SEARCHES.items()},
    "search_year_censored": f"WITH {_DOCS}, h AS (SELECT * FROM docs WHERE {_holds('no difference in')}) SELECT '1000-2100' AS years, pmid FROM h UNION ALL SELECT '1990-2009', pmid FROM h WHERE yr BETWEEN 1990 AND 2009 UNION ALL SELECT '2100-2100', pmid FROM h WHERE yr = 2100",
    "query_cache": f"WITH {_DOCS} " + " UNION ALL ".join(f"SELECT {_quoted(t)} AS term, count(*) AS n_documents, min(pmid) AS first_pmid, max(pmid) AS last_pmid FROM docs WHERE {_holds(t)} HAVING count(*) > 0" for t in ["older adults", "no difference in", "regimen | usual care"]),
    "count_documents_by_range": f"WITH {_DOCS} " + " UNION ALL ".join(f"SELECT {lo} AS first_year, {hi} AS last_year, count(*) AS n_documents FROM docs WHERE yr BETWEEN {lo} AND {hi}" for lo, hi in [(1000, 2100), YEARS, (2019, 2019), (2100, 2100)]),
    "get_document": "SELECT pmid, title, pub_year, citation_count FROM canonical_documents WHERE pmid = 10000011",
    "multi_get": f"SELECT position, CAST(pmid AS BIGINT) AS pmid, title FROM {_values(list(enumerate([10000085, 10000011, 1, 10000025, 10000011])), 'position, pmid')} JOIN canonical_documents USING (pmid)",
    "distinct_origins": "SELECT DISTINCT origin FROM canonical_documents WHERE origin <> ''",
    "metadata_clamp": f"WITH {_DOCS} SELECT pmid, pub_year, CAST(yr AS INTEGER) AS year, citation_count, cites AS citations FROM docs",
    "contingency_table": f"WITH p AS ({_ALL_PAIRS}) SELECT DISTINCT a_term, b_term, ab_count AS both, a_count - ab_count AS only_a, b_count - ab_count AS only_b, total_count - a_count - b_count + ab_count AS neither FROM p",
    "assoc_pairs": _ALL_PAIRS,
    "assoc_without_index": _ALL_PAIRS,
    "assoc_jobs": f"""WITH {_DOCS}, j AS (SELECT row_number() OVER () AS job, a_terms, b_terms, coalesce(paired, false) AS paired FROM kinderminer_jobs WHERE len(a_terms) > 0 AND len(b_terms) > 0),
x AS (SELECT job, unnest(a_terms) AS a_term, generate_subscripts(a_terms, 1) AS i FROM j), y AS (SELECT job, unnest(b_terms) AS b_term, generate_subscripts(b_terms, 1) AS k FROM j),
asked AS (SELECT DISTINCT a_term, b_term FROM x JOIN y USING (job) JOIN j USING (job) WHERE (NOT paired OR i = k) AND a_term IS NOT NULL AND b_term IS NOT NULL),
terms AS (SELECT a_term AS term FROM asked UNION SELECT b_term FROM asked), ph AS (SELECT term, unnest(string_split(term, '|')) AS part FROM terms),
pw AS (SELECT term, ' ' || array_to_string({_W.format("part")}, ' ') || ' ' AS phrase FROM ph), s AS (SELECT DISTINCT term, pmid, yr, cites FROM docs JOIN pw ON contains(t, phrase) OR contains(a, phrase)), sz AS (SELECT term, count(*) AS n FROM s GROUP BY term),
met AS (SELECT a_term, b_term, count(*) AS k FROM asked JOIN s s1 ON s1.term = a_term JOIN s s2 ON s2.term = b_term AND s2.pmid = s1.pmid GROUP BY 1, 2), {_test('ab', 'a', 'b', 'asked').replace("(SELECT count(*) FROM s s1 JOIN s s2 USING (pmid) WHERE s1.term = p.a_term AND s2.term = p.b_term)", "coalesce((SELECT met.k FROM met WHERE met.a_term = p.a_term AND met.b_term = p.b_term), 0)")}
SELECT a_term, b_term, a_count, b_count, {_nice('ab')} FROM ab""",
    "assoc_chi_square": _pair_sql(_COUPLES, scoring="chi-square"),
    "assoc_pairs_censored": _pair_sql(_COUPLES, "yr BETWEEN 1990 AND 2009"),
    "assoc_paired": _pair_sql([(a, b, i, i) for i, (a, b) in enumerate(zip(A_TERMS, B_TERMS[1:4]))]),
    "top_recent": _top_sql([("yr", 5)]),
    "top_cited": _top_sql([("cites", 5)]),
    "top_impact": _top_sql([(_IMPACT, 5)]),
    "top_union": _top_sql([("yr", 3), ("cites", 3), (_IMPACT, 3)]),
    "chain_abc": _chain_sql(A_TERMS[:1], B_TERMS[:7], C_TERMS, _CHAIN_PAIRS, 0.9, 3),
    "chain_padded": _chain_sql(A_TERMS[:1], B_TERMS[:7], C_TERMS, _CHAIN_PAIRS, 0.9, 2, 0.3),
    "chain_paired": _chain_sql(A_TERMS, B_TERMS[:3], C_TERMS[:3], _ALIGNED, 1.0, None),
    "kg_load": _EDGE + "SELECT head, relation, tail, source, count(*) AS n_edges, CAST(sum(len(evidence)) AS BIGINT) AS n_evidence FROM e GROUP BY 1, 2, 3, 4",
    "kg_relationships": _EDGE + f"SELECT a, b, head AS a_term, head_type AS a_type, tail AS b_term, tail_type AS b_type, relation AS relationship, evidence[1:100] AS pmids, source FROM {_PAIR_VALUES} JOIN e ON (head = sa AND tail = sb) OR (head = sb AND tail = sa)",
    "kg_relationships_censored": _EDGE
    + f", {_DOCS.strip()}, h AS (SELECT a, b, rel_id, head, head_type, tail, tail_type, relation, source, unnest(list_distinct(evidence[1:100])) AS pmid FROM {_PAIR_VALUES} JOIN e ON (head = sa AND tail = sb) OR (head = sb AND tail = sa)) SELECT h.a, h.b, any_value(head) AS a_term, any_value(head_type) AS a_type, any_value(tail) AS b_term, any_value(tail_type) AS b_type, any_value(relation) AS relationship, list(pmid ORDER BY pmid) AS pmids, any_value(source) AS source FROM h JOIN docs USING (pmid) WHERE yr BETWEEN 1990 AND 2009 GROUP BY h.a, h.b, rel_id",
    "assoc_with_kg": _EDGE
    + f", {_DOCS.strip()}, {_sets(_KG_TERMS)}, asked AS (SELECT * FROM {_values(_KG_PAIRS, 'a_term, b_term')}), {_test('ab', 'a', 'b', 'asked')}, g AS (SELECT a_term, b_term, count(*) AS c FROM asked JOIN e ON (head = a_term AND tail = b_term) OR (head = b_term AND tail = a_term) WHERE list_has_any(evidence[1:100], (SELECT list(pmid) FROM docs)) GROUP BY 1, 2) SELECT a_term, b_term, a_count, b_count, ab_count, CAST(CASE WHEN ab_pvalue <= 0.5 THEN coalesce(c, 0) ELSE -1 END AS INTEGER) AS n_edges FROM ab LEFT JOIN g USING (a_term, b_term)",
    "kg_tsv_ingest": _EDGE + "SELECT relation, count(*) AS n_edges, CAST(sum(len(evidence)) AS BIGINT) AS n_evidence FROM e WHERE len(evidence) >= 2 GROUP BY 1",
    "shard_assignment": "SELECT DISTINCT lower(trim(ngram)) AS ngram, shard, replace(shard, 'fragmented_', '') AS computed, CAST(len(string_split(trim(ngram), ' ')) AS INTEGER) AS n, 'documents_10m' AS bucket FROM fragmented_shard WHERE ngram IS NOT NULL",
    "upsert_latest": _UPSERT + "SELECT pmid, pub_year, title, abstract, body, origin, citation_count FROM r WHERE rn = 1",
    "version_history": _UPSERT + "SELECT pmid, count(*) AS n_versions, max(seq) AS last_seq FROM r WHERE txt GROUP BY pmid",
    "upsert_partial": """WITH b AS (SELECT DISTINCT pmid, pub_year, seq FROM document_versions WHERE seq % 2 = 0),
l AS (SELECT pmid, arg_max(seq % 1000, seq) AS c, arg_max(CASE WHEN seq % 3 = 0 THEN pub_year END, CASE WHEN seq % 3 = 0 THEN seq END) AS y FROM b GROUP BY pmid)
SELECT pmid, CAST(coalesce(y, pub_year) AS INTEGER) AS pub_year, title, coalesce(c, citation_count) AS citation_count, false AS changed FROM canonical_documents LEFT JOIN l USING (pmid)""",
    "upsert_noop": "SELECT false AS changed, count(*) AS n_documents, CAST(0 AS BIGINT) AS n_moved FROM canonical_documents",
    "version_conflicts": "SELECT DISTINCT v.uuid, v.pmid FROM document_versions v JOIN canonical_documents d USING (pmid) WHERE v.is_indexed = 1 AND v.uuid <> d.uuid",
    "removed_ngrams": _POST.replace("@src", "canonical_documents") + ", v AS (SELECT DISTINCT v.pmid, v.title, v.abstract FROM document_versions v JOIN canonical_documents d USING (pmid) WHERE v.is_indexed = 1 AND v.uuid <> d.uuid), "
    + _POST.replace("@src", "v").strip().removeprefix("WITH ").replace("tok", "tok2").replace("f AS", "f2 AS").replace("FROM f)", "FROM f2)").replace("u AS", "u2 AS").replace("FROM u ", "FROM u2 ").replace("post AS", "post2 AS")
    + " SELECT DISTINCT ngram, pmid FROM post2 EXCEPT SELECT ngram, pmid FROM post",
    "reindex_incremental": _CANON + "SELECT ngram, count(*) AS n_positions, count(DISTINCT pmid) AS n_documents FROM post GROUP BY 1",
    "defragment": "WITH f AS (SELECT DISTINCT frag_id, lower(trim(ngram)) AS ngram, data FROM fragmented_shard), x AS (SELECT ngram, unnest(data) AS x FROM f), q AS (SELECT ngram, x.pmid AS pmid, unnest(x.pos) AS pos FROM x) SELECT ngram, count(DISTINCT x.pmid) AS n_pmids, any_value(coalesce(k, 0)) AS n_positions FROM x LEFT JOIN (SELECT ngram, count(*) AS k FROM (SELECT DISTINCT * FROM q) GROUP BY ngram) USING (ngram) GROUP BY ngram",
    "delete_documents": "SELECT pmid FROM canonical_documents WHERE pmid NOT IN (10000011, 10000025)",
    "file_anti_join": "WITH o AS (SELECT DISTINCT origin AS name FROM document_versions WHERE origin <> '') SELECT name, CASE WHEN name < 'feed22n0020' THEN 'baseline' ELSE 'update' END AS kind FROM o WHERE name NOT IN (SELECT origin FROM canonical_documents WHERE is_indexed = 1) ORDER BY kind, name LIMIT 25",
    "year_windows": f"WITH w AS (SELECT * FROM {_values(WORK_YEARS, 'first, last, step')}), s AS (SELECT first, last, step, CAST(unnest(CASE WHEN step IS NULL THEN [first] WHEN first > last THEN [NULL] ELSE range(first, last + 1, step) END) AS INTEGER) AS lo FROM w) SELECT first, last, step, lo, CASE WHEN lo IS NULL THEN NULL WHEN step IS NULL THEN last ELSE least(lo + step - 1, last) END AS hi FROM s",
    "scorer_inputs": f"WITH {_DOCS} SELECT 'tyvi1' AS a_term, 'older adults' AS b_term, '[' || coalesce(string_agg('''' || pmid || '''', ', ' ORDER BY pmid), '') || ']' AS ab_pmid_intersection FROM docs WHERE yr BETWEEN 2015 AND 2018 AND {_holds('tyvi1')} AND {_holds('older adults')} UNION ALL SELECT 'vimi9', 'usual care', '[''3'', ''5'']'",
    "parse_results": f"SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM {_values(_RES, _RES_COLUMNS)}",
    "iteration_from_path": f"SELECT * FROM {_values(list(zip(PATHS, [3, None, 2, 10])), 'path, iteration')}",
    "missing_iterations": "SELECT 2 AS iteration UNION ALL SELECT 4",
    "xml_ingest": r"""SELECT pmid, CAST(CASE WHEN pub_year IS NULL OR pmid % 3 = 2 AND NOT regexp_matches(CAST(pub_year AS VARCHAR), '^(1\d\d\d|20\d\d)$') THEN 99999 ELSE pub_year END AS INTEGER) AS pub_year,
regexp_replace(title, '</?[A-Za-z][^<>]*>', '', 'g') AS title, regexp_replace(substr(abstract, 1, 50), '</?[A-Za-z][^<>]*>', '', 'g') || ' ' || regexp_replace(substr(abstract, 51), '</?[A-Za-z][^<>]*>', '', 'g') AS abstract FROM canonical_documents""",
    "icite_ingest": f"WITH {_DOCS} SELECT pmid, cites + 1 AS citation_count FROM docs",
    "job_listing": """WITH j AS (SELECT id, max(created_at) AS created_at, arg_max(coalesce(array_to_string(a_terms, ', '), ''), {'a': created_at, 'b': coalesce(array_to_string(a_terms, ', '), '')}) AS d, bool_and(a_terms IS NULL) AS none FROM kinderminer_jobs GROUP BY id),
l AS (SELECT id, created_at, CASE WHEN none THEN NULL ELSE d END AS d, timezone('America/Chicago', timezone('UTC', created_at)) AS here FROM j)
SELECT id, 'finished' AS status, CASE WHEN length(d) > 80 THEN d[1:77] || '...' ELSE d END AS description, strftime(here, '%Y-%m-%d ') || CAST(strftime(here, '%I') AS INTEGER) || strftime(here, ':%M:%S %p') AS created, created_at FROM l""",
    "job_priority": "SELECT DISTINCT id, CAST(coalesce(len(a_terms), 0) + coalesce(len(b_terms), 0) + coalesce(len(c_terms), 0) AS INTEGER) AS n_terms, CASE WHEN coalesce(len(a_terms), 0) + coalesce(len(b_terms), 0) + coalesce(len(c_terms), 0) <= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM kinderminer_jobs",
    "worker_order": f"SELECT name, queue, CAST(0.9999 AS DOUBLE) AS progress FROM {_values([('w2', 'HIGH'), ('w4', 'MEDIUM'), ('w3', 'LOW'), ('w1', 'INDEXING'), ('w0', 'OTHER')], 'name, queue')}",
    "user_errors": f"SELECT * FROM {_values([('x -BEGIN USER-FACING ERROR- bad term -END USER-FACING ERROR- y', 'bad term'), ('Traceback', 'An error occurred during execution of this job.'), (None, None), ('-BEGIN USER-FACING ERROR- a -BEGIN USER-FACING ERROR- b', 'An error occurred during execution of this job.')], 'trace, message')}",
}
