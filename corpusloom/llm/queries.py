"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.llm import cooccurrence, frequencies, mixing, near_duplicates, packing, splitting
from corpusloom.llm.tokens import token_counts
from corpusloom.operators.dedup import once_per_id
from corpusloom.operators.postings import fragment_postings
from corpusloom.plans.tables import table
from corpusloom.session import materialize

TITLE_ABSTRACT = "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))"
SIMILAR = {"threshold": Fraction(6, 10), "n": 3, "min_words": 20}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pmids with similar versions."""
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "document_versions"), "pmid", F.expr(TITLE_ABSTRACT), **SIMILAR)
    return pairs.select(F.col("key_1").alias("pmid_1"), F.col("key_2").alias("pmid_2"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every pmid and text with the least pmid of the text, that of the group of near-duplicates, and the number of similar texts."""
    found = materialize(near_duplicates.near_duplicate_groups(table(spark, d, "document_versions"), "pmid", F.expr(TITLE_ABSTRACT), **SIMILAR), "groups")
    of_class = found.groupBy("class_id").agg(F.min("key").alias("class_pmid"))
    of_group = found.groupBy("group_id").agg(F.min("key").alias("group_pmid"))
    return found.join(of_class, "class_id").join(of_group, "group_id").select(F.col("key").alias("pmid"), "class_pmid", "group_pmid", "n_links")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return once_per_id(table(spark, d, "document_versions"), "uuid", ["seq", "abstract"])


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of terms that jobs ask for, with counts and lift."""
    return cooccurrence.pair_associations(_versions(spark, d), "uuid", "abstract", cooccurrence.asked_pairs(table(spark, d, "kinderminer_jobs"))).withColumn("lift", F.round("lift", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in at least 3 and 1/1000 of all versions, at least four times as often as by chance."""
    k, n = F.col("together"), F.col("n_docs")
    hit = (k >= 3) & (k * 1000 >= n) & (k * n >= 4 * F.col("n_1") * F.col("n_2"))
    return cooccurrence.pair_associations(_versions(spark, d), "uuid", "abstract", cooccurrence.asked_pairs(table(spark, d, "kinderminer_jobs"))).where(hit).select("term_1", "term_2")


def p5_counts(spark: SparkSession, d: str, **how: int) -> DataFrame:
    """Occurrences and records of every word of the abstracts and every n-gram of the fragments, with marks."""
    docs = _versions(spark, d)
    postings = fragment_postings(table(spark, d, "fragmented_shard"), with_pos=True).where(F.col("pmid").isNotNull())
    ngrams = postings.select(F.lit("ngram").alias("field_name"), F.col("ngram").alias("term"), F.col("pmid").alias("record"), F.greatest(F.size("pos"), F.lit(1)).cast("long").alias("occurrences"), F.lit(1).cast("long").alias("records"))
    counts = frequencies.term_frequencies(frequencies.count_words(docs, "abstract", "abstract").unionByName(ngrams), **how)
    n_docs = table(spark, d, "document_versions").select("uuid").distinct().count()
    n_pmids = table(spark, d, "fragmented_shard").select(F.explode("data").alias("x")).select("x.pmid").where("pmid IS NOT NULL").distinct().count()
    return frequencies.marked(counts, {"abstract": 2, "ngram": 2}, {"abstract": -(-56 * n_docs // 100), "ngram": -(-n_pmids // 4)})


def p5_counts_deep(spark: SparkSession, d: str) -> DataFrame:
    """p5_counts by several levels of splits: the leaves and digits of a far larger collection's proportions."""
    return p5_counts(spark, d, leaf_bytes=8_000, max_bits=4)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p5_counts(spark, d).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def _limits(spark: SparkSession, d: str, purpose: str) -> DataFrame:
    return table(spark, d, "size_limits").where(F.col("purpose") == purpose)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or part of one above the limit, with its container under each container limit."""
    return packing.pack(token_counts(table(spark, d, "documents"), "text", ["doc_id"]), "doc_id", "n_tokens", _limits(spark, d, "container"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and room used under each container limit."""
    return packing.fill_report(p7_containers(spark, d), _limits(spark, d, "container"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed under each container limit, and faults: rooms exceeded, parts that do not join to the document, whole documents split, fewer containers than tokens ask for."""
    limits = _limits(spark, d, "container").select("limit_name", F.col("max_tokens").cast("long").alias("max_tokens")).distinct()
    packed = materialize(p7_containers(spark, d), "packed")
    sizes = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.size(words("text")).alias("words"))
    room = packed.where("container_id IS NOT NULL").groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("used")).join(limits, "limit_name")
    rooms = room.groupBy("limit_name").agg(F.count_if(F.col("used") > F.col("max_tokens")).alias("over"), F.count(F.lit(1)).alias("n"), F.ceil(F.sum("used") / F.max("max_tokens")).alias("least"))
    after = F.lag("token_end", 1, 0).over(Window.partitionBy("limit_name", "doc_id").orderBy("part_no"))
    parts = packed.withColumn("gap", (F.col("token_start") != after).cast("int"))
    docs = parts.groupBy("limit_name", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("tokens"), F.sum("gap").alias("gaps"), F.count("container_id").alias("placed"))
    docs = docs.join(sizes, "doc_id").join(limits, "limit_name")
    wrong = (F.col("gaps") > 0) | (F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("max_tokens")))) | (F.col("tokens") > F.coalesce("bytes", F.lit(0))) | (F.col("tokens") < F.coalesce(F.greatest("words", F.lit(0)), F.lit(0)))
    per = docs.groupBy("limit_name", "max_tokens").agg(F.count_if(F.col("placed") > 0).alias("n_placed"), F.count_if(F.col("placed") == 0).alias("n_empty"), F.count_if(wrong).alias("wrong"))
    return per.join(rooms, "limit_name").select("limit_name", "max_tokens", "n_placed", "n_empty", (F.col("wrong") + F.col("over") + (F.col("n") < F.col("least")).cast("int")).alias("n_faults"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Copies of each document in each plan."""
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").join(targets.select("source").distinct(), "source", "left_semi")
    return mixing.mix(token_counts(docs, "text", ["doc_id", "source"]), "doc_id", targets)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each plan."""
    return mixing.share_report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """The share each source should have of its plan, and faults: too many copies, tokens off by a document that could have been taken or left."""
    targets, docs = table(spark, d, "mix_targets"), table(spark, d, "documents")
    tokens = materialize(token_counts(docs.join(targets.select("source").distinct(), "source", "left_semi"), "text", ["doc_id", "source"]), "counted")
    plans = mixing.plan_totals(targets, tokens).withColumn("share", F.col("wanted") / F.sum("wanted").over(Window.partitionBy("mix_plan")))
    mixed = p8_mix(spark, d).select("mix_plan", "doc_id", "copies")
    each = plans.join(tokens.withColumnRenamed("tokens", "t"), "source", "left").join(mixed, ["mix_plan", "doc_id"], "left").fillna(0, ["copies"])
    size = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    per = each.groupBy("mix_plan", "source", "share", "wanted", "max_repeats").agg(
        F.coalesce(F.sum(F.col("copies") * F.col("n_tokens")), F.lit(0)).alias("got"),
        F.max("copies").alias("most"),
        F.min(F.when(F.col("copies") < F.col("max_repeats"), size)).alias("could_add"),
        F.min(F.when(F.col("copies") > 0, size)).alias("could_drop"),
    )
    off = F.round("wanted") - F.col("got")
    wrong = (F.col("most") > F.col("max_repeats")).cast("int") + F.coalesce((off > 0) & (off >= F.col("could_add")), F.lit(False)).cast("int") + F.coalesce((off < 0) & (-off >= F.col("could_drop")), F.lit(False)).cast("int")
    return per.select("mix_plan", "source", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), "max_repeats", wrong.alias("n_faults"))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents above each piece limit."""
    limits = [tuple(r) for r in _limits(spark, d, "piece").select("limit_name", "max_tokens", "overlap_tokens").distinct().orderBy("limit_name").collect()]  # settings
    return splitting.split_texts(table(spark, d, "documents"), "doc_id", "text", limits)


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """The hash of every text put together again from its pieces, or of the text itself if it was not split, and faults: pieces above the limit, gaps, a text split or left whole that cannot be."""
    pieces = materialize(p9_pieces(spark, d), "pieces")
    limits = _limits(spark, d, "piece").select("limit_name", "max_tokens").distinct()
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("limit_name", "doc_id").orderBy("piece_no"))
    own = pieces.withColumn("before", before).join(limits, "limit_name")
    own = own.select("limit_name", "doc_id", "piece_no", F.expr("substring(piece, cast(before - char_start + 1 as int))").alias("own"), ((F.col("char_start") > F.col("before")) | (F.col("n_tokens") > F.col("max_tokens")) & (F.length("piece") > 1)).cast("int").alias("wrong"))
    again = own.groupBy("limit_name", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "").alias("again"), F.sum("wrong").alias("wrong"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    names = F.array(*[F.struct(F.lit(r[0]).alias("limit_name"), F.lit(r[1]).alias("most")) for r in limits.collect()])  # settings
    each = docs.withColumn("l", F.explode(names)).select("doc_id", "text", "l.*").join(again, ["limit_name", "doc_id"], "left")
    must, may = F.size(words("text")) > F.col("most"), F.octet_length("text") > F.col("most")
    wrong = F.coalesce("wrong", F.lit(0)) + F.coalesce(must & F.col("again").isNull(), F.lit(False)).cast("int") + F.coalesce(~may & F.col("again").isNotNull(), F.lit(False)).cast("int")
    return each.select("limit_name", "doc_id", F.md5(F.coalesce("again", "text")).alias("text_md5"), wrong.alias("n_faults"))


QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p4_found, p4_pairs, p5_found, p5_counts, p5_counts_deep, p7_containers, p7_fill, p7_check, p8_mix, p8_shares, p8_check, p9_pieces, p9_check)}

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_ALL_TEXT = _W.format("coalesce(title, '') || ' ' || coalesce(abstract, '')")
_TERM = "list_transform({}, lambda t: list_aggregate(list_filter(list_transform(string_split(t, '|'), lambda x: array_to_string(" + _W.format("x").replace("{", "{{").replace("}", "}}") + ", ' ')), lambda x: x <> ''), 'string_agg', '|'))"
_P4 = f"""
WITH v AS (SELECT uuid, any_value(' ' || array_to_string({_W.format("abstract")}, ' ') || ' ') AS w FROM document_versions GROUP BY uuid),
jobs AS (SELECT coalesce(paired, false) AS paired, {_TERM.format("a_terms")} AS a, {_TERM.format("b_terms")} AS b FROM kinderminer_jobs WHERE len(a_terms) > 0 AND len(b_terms) > 0),
a AS (SELECT row_number() OVER () AS job, * FROM jobs),
x AS (SELECT job, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM a), y AS (SELECT job, unnest(b) AS b, generate_subscripts(b, 1) AS j FROM a),
asked AS (SELECT DISTINCT least(x.a, y.b) AS term_1, greatest(x.a, y.b) AS term_2 FROM x JOIN y USING (job) JOIN a USING (job) WHERE x.a <> y.b AND (NOT paired OR i = j)),
terms AS (SELECT term_1 AS term FROM asked UNION SELECT term_2 FROM asked),
ph AS (SELECT term, unnest(string_split(term, '|')) AS phrase FROM terms),
hit AS (SELECT DISTINCT uuid, term FROM v JOIN ph ON contains(w, ' ' || phrase || ' ')),
n AS (SELECT term, count(*) AS n FROM hit GROUP BY term),
k AS (SELECT p.term_1, p.term_2, count(*) AS k FROM asked p JOIN hit h ON h.term = p.term_1 JOIN hit g ON g.term = p.term_2 AND g.uuid = h.uuid GROUP BY 1, 2),
total AS (SELECT p.term_1, p.term_2, (SELECT count(*) FROM v) AS n_docs, coalesce(n1.n, 0) AS n_1, coalesce(n2.n, 0) AS n_2, coalesce(k, 0) AS together
FROM asked p LEFT JOIN n n1 ON n1.term = p.term_1 LEFT JOIN n n2 ON n2.term = p.term_2 LEFT JOIN k ON k.term_1 = p.term_1 AND k.term_2 = p.term_2)
"""
_P5 = f"""
WITH v AS (SELECT uuid, any_value({_W.format("abstract")}) AS w FROM document_versions GROUP BY uuid),
t AS (SELECT uuid, unnest(w) AS term FROM v),
frag AS (SELECT DISTINCT frag_id, lower(trim(ngram)) AS term, data FROM fragmented_shard),
f AS (SELECT term, unnest(data) AS x FROM frag),
c AS (SELECT 'abstract' AS field_name, term, count(*) AS occurrences, count(DISTINCT uuid) AS records FROM t GROUP BY term
UNION ALL SELECT 'ngram', term, CAST(sum(greatest(1, coalesce(len(x.pos), 1))) AS BIGINT), count(DISTINCT x.pmid) FROM f WHERE term IS NOT NULL GROUP BY term),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN field_name = 'abstract' AND 100 * records >= 56 * (SELECT count(*) FROM v) THEN 'common'
WHEN field_name = 'ngram' AND 4 * records >= (SELECT count(DISTINCT x.pmid) FROM f) THEN 'common' END AS mark FROM c)
"""
ORACLE = {
    "p2_found": f"""
WITH v AS (SELECT DISTINCT pmid, {_ALL_TEXT} AS w FROM document_versions),
b AS (SELECT row_number() OVER () AS id, pmid, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM v WHERE len(w) >= 20),
f AS (SELECT id, pmid, len(s) AS n, unnest(s) AS g FROM b),
k AS (SELECT x.id, y.id AS id2, any_value(x.pmid) AS p1, any_value(y.pmid) AS p2, any_value(x.n) AS n1, any_value(y.n) AS n2, count(*) AS k FROM f x JOIN f y ON x.g = y.g AND x.pmid < y.pmid GROUP BY 1, 2)
SELECT DISTINCT p1 AS pmid_1, p2 AS pmid_2 FROM k WHERE 10 * k >= 6 * (n1 + n2 - k)""",
    "p2_groups": f"""
WITH RECURSIVE v AS (SELECT DISTINCT pmid, {_ALL_TEXT} AS w FROM document_versions),
c AS (SELECT w, min(pmid) AS first, row_number() OVER () AS id FROM v WHERE len(w) >= 20 GROUP BY w),
f AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM c),
n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
k AS (SELECT x.id, y.id AS id2, count(*) AS k FROM f x JOIN f y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
e AS (SELECT k.id, k.id2 FROM k JOIN n ON n.id = k.id JOIN n m ON m.id = k.id2 WHERE 10 * k >= 6 * (n.n + m.n - k)),
r(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, e.id2 FROM r JOIN e ON e.id = r.other)
SELECT v.pmid, c.first AS class_pmid, (SELECT min(o.first) FROM r JOIN c o ON o.id = r.other WHERE r.id = c.id) AS group_pmid, (SELECT count(*) FROM e WHERE e.id = c.id) AS n_links FROM v JOIN c USING (w)""",
    "p4_found": _P4 + "SELECT term_1, term_2 FROM total WHERE together >= 3 AND 1000 * together >= n_docs AND together * n_docs >= 4 * n_1 * n_2",
    "p4_pairs": _P4 + "SELECT *, round(CASE WHEN n_1 > 0 AND n_2 > 0 THEN together * CAST(n_docs AS DOUBLE) / (n_1 * n_2) END, 6) AS lift FROM total",
    "p5_found": _P5 + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": _P5 + "SELECT * FROM m",
    "p5_counts_deep": _P5 + "SELECT * FROM m",
    # the tokenizer decides sizes, so SQL has what must hold whatever they are
    "p7_check": """SELECT limit_name, CAST(max_tokens AS BIGINT) AS max_tokens, (SELECT count(*) FROM documents WHERE text <> '') AS n_placed, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS n_empty, CAST(0 AS BIGINT) AS n_faults
FROM (SELECT DISTINCT limit_name, max_tokens FROM size_limits WHERE purpose = 'container')""",
    "p8_check": """WITH s AS (SELECT source FROM documents WHERE text <> '' GROUP BY source), u AS (SELECT t.*, CASE WHEN s.source IS NULL THEN 0 ELSE target_share END AS usable FROM mix_targets t LEFT JOIN s USING (source))
SELECT mix_plan, source, round(usable / sum(usable) OVER (PARTITION BY mix_plan), 6) AS share, max_repeats, CAST(0 AS INTEGER) AS n_faults FROM u""",
    "p9_check": "SELECT limit_name, doc_id, md5(text) AS text_md5, CAST(0 AS BIGINT) AS n_faults FROM documents, (SELECT DISTINCT limit_name FROM size_limits WHERE purpose = 'piece')",
}
