"""The general problems' queries: hot keys, increments, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import normal_form
from corpusloom.operators import increments, orphans, skew
from corpusloom.operators.dedup import once_per_id
from corpusloom.operators.postings import fragment_postings
from corpusloom.plans.tables import path, table
from corpusloom.session import scratch

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    return skew.compress(fragment_postings(table(spark, d, "fragmented_shard")), ["ngram"], "pmid")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """N-grams with at least 1/100 of all postings."""
    return skew.heavy_keys(skew.summarize(_weighted(spark, d), ["ngram"], "pmid"), ["ngram"], 100)


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """Postings, distinct pmids and the most frequent pmid of every n-gram."""
    return skew.summarize(_weighted(spark, d), ["ngram"], "pmid")


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the pmids of every n-gram."""
    return skew.percentiles(_weighted(spark, d), ["ngram"], "pmid", PROBS)


def p1_postings(spark: SparkSession, d: str) -> DataFrame:
    """The complete postings of every n-gram, in blocks of 4,096 pmids; positions as text."""
    b = skew.blocks(fragment_postings(table(spark, d, "fragmented_shard"), with_pos=True), ["ngram"], "pmid", "pos")
    return b.select("ngram", "block_no", "n_values", F.col("entries.pmid").alias("pmids"), F.col("entries.weight").alias("weights"), F.transform("entries.pos", lambda p: F.array_join(p, " ")).alias("positions"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """uuids still to be processed."""
    return p3_changes(spark, d).where(F.col("change") == "insert").select("uuid")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    """States to be taken by the next index run and states to be withdrawn from the index."""
    return increments.state_delta(spark, path(d, "document_versions"), table(spark, d, "index_runs"))


def p3_process(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer has of every row of a table after added files, deletion vectors and rewritten files, with failed runs.

    The rows arrive in two batches; then those that a later one of their uuid replaces are marked as gone, and the rest is
    written to other files. n is what is left of a row by the consumer's records, n_records their number.
    """
    source, sink = (increments.VersionedTable(spark, scratch(spark, t)) for t in ("source", "sink"))
    rows = table(spark, d, "document_versions").select("uuid", "seq", "run_id", "changed_at")

    def kept(delta: DataFrame) -> DataFrame:
        return delta.select("uuid", "seq", "change")

    def lost(delta: DataFrame) -> DataFrame:
        kept(delta).write.parquet(f"{sink.root}/data-lost-{source.latest().version}")  # output of a run that ends before its commit
        raise InterruptedError

    def run() -> None:
        try:
            increments.process_new(source, sink, lost)
        except InterruptedError:
            pass
        increments.process_new(source, sink, kept)

    source.append(rows.where("run_id IS NOT NULL"))
    run()
    source.append(rows.where("run_id IS NULL"))
    run()
    now = source.read()
    last = now.where("uuid IS NOT NULL").groupBy("uuid").agg(F.max(F.struct("seq", "changed_at", *increments.POSITION)).alias("m")).select("m.*").select(*increments.POSITION)
    source.delete_rows(now.join(last, increments.POSITION, "left_anti"))
    run()
    source.overwrite(source.read().drop(*increments.POSITION))
    run()
    net = F.sum(F.when(F.col("change") == "insert", 1).otherwise(-1))
    return sink.read().groupBy("uuid", "seq").agg(net.alias("n"), F.count(F.lit(1)).alias("n_records"))


def _relationship_keys(spark: SparkSession, d: str) -> list[orphans.ForeignKey]:
    rel = once_per_id(table(spark, d, "relationships"), "rel_id", ["loaded_at", "head", "evidence"]).select(F.col("rel_id").cast("string").alias("child_id"), "head", "evidence", F.col("loaded_at").alias("as_of"))
    docs = table(spark, d, "canonical_documents").select(F.col("pmid").cast("string").alias("target_key"), F.col("pmid").cast("string").alias("parent_id"), F.col("loaded_at").alias("live_from"), F.col("deleted_at").alias("live_until"))
    names = table(spark, d, "entities").select(F.col("entity_name").alias("target_key"), F.col("entity_name").alias("parent_id"), F.col("loaded_at").alias("live_from"), F.col("deleted_at").alias("live_until"))
    cited = rel.select("child_id", F.explode(orphans.evidence_keys("evidence")).alias("target_key"), "as_of")
    heads = rel.select("child_id", normal_form("head").alias("target_key"), "as_of")
    return [orphans.ForeignKey("relationships", "evidence", "canonical_documents", cited, docs), orphans.ForeignKey("relationships", "head", "entities", heads, names)]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan pmids and names of relationships."""
    return orphans.find_orphans(_relationship_keys(spark, d)).select(F.col("child_id").cast("long").alias("rel_id"), "field_name", "target_key")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month: runs <- versions <- documents <- relationships -> entities."""
    always = F.lit(None).cast("timestamp")
    versions, docs, runs = (table(spark, d, t) for t in ("document_versions", "canonical_documents", "index_runs"))
    graph = [
        *_relationship_keys(spark, d),
        orphans.ForeignKey(
            "canonical_documents", "uuid", "document_versions",
            docs.select(F.col("pmid").cast("string").alias("child_id"), F.col("uuid").alias("target_key"), F.col("loaded_at").alias("as_of")),
            versions.select(F.col("uuid").alias("target_key"), F.col("uuid").alias("parent_id")).distinct().withColumns({"live_from": always, "live_until": always}),
        ),
        orphans.ForeignKey(
            "document_versions", "run_id", "index_runs",
            versions.select(F.col("uuid").alias("child_id"), F.col("run_id").cast("string").alias("target_key"), F.col("changed_at").alias("as_of")),
            runs.select(F.col("run_id").cast("string").alias("target_key"), F.col("run_id").cast("string").alias("parent_id")).distinct().withColumns({"live_from": always, "live_until": always}),
        ),
    ]
    return orphans.orphan_report(orphans.find_orphans(graph))


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p1_percentiles, p1_postings, p3_found, p3_changes, p3_process, p6_found, p6_report)}

_POSTINGS = """
WITH frag AS (SELECT DISTINCT frag_id, lower(trim(ngram)) AS ngram, data FROM fragmented_shard),
post AS (SELECT ngram, unnest(data) AS x FROM frag),
flat AS (SELECT ngram, x.pmid AS pmid, x.pos AS pos FROM post)
"""
_REL = r"""
WITH rel AS (SELECT DISTINCT rel_id, loaded_at, head, evidence FROM relationships),
cited AS (SELECT DISTINCT rel_id, loaded_at, unnest(regexp_extract_all(evidence, '\d+')) AS target_key FROM rel),
heads AS (SELECT rel_id, loaded_at, array_to_string(regexp_extract_all(lower(head), '[\p{L}\p{N}]+'), ' ') AS target_key FROM rel WHERE head IS NOT NULL),
docs AS (SELECT CAST(pmid AS VARCHAR) AS target_key, uuid, loaded_at, deleted_at FROM canonical_documents),
miss AS (SELECT * FROM cited c WHERE NOT EXISTS (SELECT 1 FROM docs t WHERE t.target_key = c.target_key AND t.loaded_at <= c.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > c.loaded_at))),
nohead AS (SELECT * FROM heads h WHERE NOT EXISTS (SELECT 1 FROM entities t WHERE t.entity_name = h.target_key AND t.loaded_at <= h.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > h.loaded_at)))
"""
_STATE = """
WITH run AS (SELECT run_id, max({'a': attempt, 'f': lower(trim(status)) = 'finished', 's': started_at}) AS m FROM index_runs GROUP BY run_id),
st AS (SELECT DISTINCT v.uuid, v.seq, v.changed_at, v.run_id, v.is_indexed,
  coalesce((v.run_id IS NULL AND v.is_indexed = 1) OR (run.m.f AND run.m.s >= v.changed_at), false) AS taken
  FROM document_versions v LEFT JOIN run ON run.run_id = v.run_id),
top AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY seq DESC, changed_at DESC, run_id DESC NULLS LAST, is_indexed DESC) AS rn FROM st)
"""
ORACLE = {
    "p1_found": _POSTINGS + "SELECT ngram FROM flat GROUP BY ngram HAVING count(*) * 100 >= (SELECT count(*) FROM flat)",
    "p1_summary": _POSTINGS
    + """, w AS (SELECT ngram, pmid, count(*) AS weight FROM flat GROUP BY 1, 2)
SELECT ngram, CAST(sum(weight) AS BIGINT) AS n, count(pmid) AS n_distinct, arg_min(pmid, {'a': -weight, 'b': pmid}) AS mode, max(weight) AS mode_count FROM w GROUP BY 1""",
    "p1_percentiles": _POSTINGS
    + ", p AS (SELECT unnest([0.0, 0.25, 0.5, 0.9, 1.0]) AS prob), r AS (SELECT ngram, pmid, row_number() OVER (PARTITION BY ngram ORDER BY pmid) AS rn, count(*) OVER (PARTITION BY ngram) AS n FROM flat) "
    "SELECT ngram, CAST(prob AS DOUBLE) AS prob, pmid AS percentile FROM r, p WHERE rn = greatest(1, ceil(CAST(prob AS DOUBLE) * n))",
    "p1_postings": _POSTINGS
    + """, o AS (SELECT ngram, pmid, count(*) AS weight, list_sort(list_distinct(flatten(list(coalesce(pos, []))))) AS pos FROM flat GROUP BY 1, 2)
SELECT ngram, CAST(floor(pmid / 4096) AS BIGINT) AS block_no, count(*) AS n_values, list(pmid ORDER BY pmid) AS pmids, list(weight ORDER BY pmid) AS weights, list(array_to_string(pos, ' ') ORDER BY pmid) AS positions FROM o GROUP BY 1, 2""",
    "p3_found": _STATE + "SELECT uuid FROM top WHERE rn = 1 AND NOT taken",
    "p3_changes": _STATE.replace("SELECT DISTINCT v.uuid", "SELECT v.uuid") + "SELECT uuid, seq, CASE WHEN rn = 1 THEN 'insert' ELSE 'delete' END AS change FROM top WHERE (rn = 1) = (NOT taken)",
    "p3_process": """WITH c AS (SELECT uuid, seq, count(*) AS n FROM document_versions GROUP BY uuid, seq), t AS (SELECT uuid, max(seq) AS seq FROM c WHERE uuid IS NOT NULL GROUP BY uuid)
SELECT c.uuid, c.seq, CAST(t.uuid IS NOT NULL AS BIGINT) AS n, CASE WHEN t.uuid IS NULL THEN 2 * n ELSE 2 * n + 1 END AS n_records FROM c LEFT JOIN t ON t.uuid = c.uuid AND t.seq = c.seq""",
    "p6_found": _REL + "SELECT rel_id, 'evidence' AS field_name, target_key FROM miss UNION ALL SELECT rel_id, 'head', target_key FROM nohead",
    "p6_report": _REL
    + """, v0 AS (SELECT DISTINCT uuid, changed_at, run_id FROM document_versions WHERE run_id IS NOT NULL AND run_id NOT IN (SELECT run_id FROM index_runs)),
d0 AS (SELECT DISTINCT pmid, uuid, loaded_at FROM canonical_documents WHERE uuid NOT IN (SELECT uuid FROM document_versions)),
d1 AS (SELECT DISTINCT pmid, uuid, loaded_at FROM canonical_documents WHERE uuid IN (SELECT uuid FROM v0)),
bad AS (SELECT CAST(pmid AS VARCHAR) AS k FROM d0 UNION SELECT CAST(pmid AS VARCHAR) FROM d1),
r1 AS (SELECT * FROM cited c WHERE EXISTS (SELECT 1 FROM docs t WHERE t.target_key = c.target_key AND t.loaded_at <= c.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > c.loaded_at) AND t.target_key IN (SELECT k FROM bad))),
u AS (
SELECT 'relationships' AS table_name, 'evidence' AS field_name, 'canonical_documents' AS parent, loaded_at AS seen, 'direct' AS kind, CAST(rel_id AS VARCHAR) AS id FROM miss
UNION ALL SELECT 'relationships', 'head', 'entities', loaded_at, 'direct', CAST(rel_id AS VARCHAR) FROM nohead
UNION ALL SELECT 'relationships', 'evidence', 'canonical_documents', loaded_at, 'inherited', CAST(rel_id AS VARCHAR) FROM r1
UNION ALL SELECT 'canonical_documents', 'uuid', 'document_versions', loaded_at, 'direct', CAST(pmid AS VARCHAR) FROM d0
UNION ALL SELECT 'canonical_documents', 'uuid', 'document_versions', loaded_at, 'inherited', CAST(pmid AS VARCHAR) FROM d1
UNION ALL SELECT 'document_versions', 'run_id', 'index_runs', changed_at, 'direct', uuid FROM v0)
SELECT table_name, field_name, parent, strftime(seen, '%Y-%m') AS month, kind, count(*) AS n_references, count(DISTINCT id) AS n_records FROM u GROUP BY 1, 2, 3, 4, 5""",
}
