"""One object with everything a client asks for: documents, index, associations, edges, evaluations, jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import association, corpus, hypotheses, index, knowledge
from corpusloom.operators.corpus import MAX_YEAR, MIN_YEAR
from corpusloom.operators.increments import POSITION, Manifest, VersionedTable
from corpusloom.operators.jobs import JobQueue, StoredRows, priority_of
from corpusloom.operators.search import search
from corpusloom.operators.terms import sanitize
from corpusloom.session import file_system, materialize
from corpusloom.sources import records


class Engine:
    """Tables below a folder, each a series of immutable snapshots; a reader keeps the snapshot it began with."""

    def __init__(self, spark: SparkSession, root: str, workers: int = 4, put: Callable[[str, bytes], bool] | None = None):
        self.spark, self.root, self.put = spark, root.rstrip("/"), put
        self.queue = JobQueue(spark, workers)

    def _table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}", self.put)

    def _read(self, name: str, schema: str) -> DataFrame:
        t = self._table(name)
        return t.read().drop("file_path", "row_index") if t.latest().files else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, df: DataFrame, processed: int | None = None) -> None:
        self._table(name).overwrite(df, processed)

    def documents(self) -> DataFrame:
        return self._read("documents", corpus.SCHEMA + ", is_indexed boolean")

    def processed(self) -> int:
        return self._table("documents").latest().processed

    def versions(self) -> DataFrame:
        """The history that belongs to the published documents; a repeated attempt to store a version changes nothing."""
        m = self._history()
        t = self._table("versions")
        rows = t.read(m.version).drop(*POSITION) if m.files else self.spark.createDataFrame([], "uuid string, seq long, " + corpus.SCHEMA)
        return rows.dropDuplicates(["uuid"])

    def _history(self) -> Manifest:
        return self._table("versions").manifest(self._table("documents").latest().linked.get("versions", 0))

    def origins(self) -> DataFrame:
        """All files that a version came from."""
        return self.versions().where("origin <> ''").select("origin").distinct()

    def unindexed(self) -> int:
        """Documents whose text has changed since they were indexed."""
        return self.documents().where("NOT is_indexed").count()

    def postings(self) -> DataFrame:
        return self._read("postings", "ngram string, n int, pmid long, pos int")

    def relationships(self) -> DataFrame:
        return self._read("relationships", "head string, head_type string, relation string, tail string, tail_type string, evidence array<bigint>, source string")

    def add_documents(self, updates: DataFrame, processed: int | None = None) -> None:
        """Upserts rows of pmid, any of the fields and optionally seq (else the order of rows).

        processed is stored in the commit that publishes the documents.
        """
        for f, kind in (x.split(" ") for x in corpus.SCHEMA.split(", ")):
            updates = updates.withColumn(f, F.col(f).cast(kind) if f in updates.columns else F.lit(None).cast(kind))
        if "seq" not in updates.columns:
            updates = updates.withColumn("seq", F.monotonically_increasing_id())
        table = self._table("documents")
        old = table.read() if table.latest().files else self.documents().withColumns({"file_path": F.lit(""), "row_index": F.lit(0)})
        touched = updates.select("pmid").distinct()
        before = materialize(old.join(touched, "pmid", "left_semi"), "before")  # the other documents are neither read in full nor written
        docs, versions = corpus.upsert(before.select("pmid", *corpus.FIELDS), updates)
        kept = docs.join(before.select("pmid", "is_indexed"), "pmid", "left").withColumn("is_indexed", F.coalesce(~F.col("changed") & F.col("is_indexed"), F.lit(False))).drop("changed")
        history = self._table("versions").append(versions, base=self._history())
        table.replace_rows(before, kept, processed, {"versions": history.version})  # both become visible here

    def load_articles(self, folder: str, most: int = 100, pattern: str = "*.xml.gz") -> int:
        """Adds the articles of files that are not loaded yet, at most so many files in order of name; their number.

        A file is loaded if a version has it as its origin or if it was listed as done by an earlier call.
        """
        log = self._read("loaded_files", "origin string")
        done = log.unionByName(self.origins())
        files = records.list_files(self.spark, folder, pattern)
        names = [r[0] for r in records.files_to_read(files, files.limit(0), done, most).select("name").collect()]  # at most `most`
        if names:
            self.add_documents(records.read_articles(self.spark, [f"{folder}/{n}" for n in names]).withColumn("seq", F.lit(0)))
            self._table("loaded_files").append(self.spark.createDataFrame([(n,) for n in names], "origin string"))
        return len(names)

    def load_citations(self, path: str) -> None:
        self.add_documents(records.read_citations(self.spark, path))

    def load_edges(self, path: str, source: str) -> None:
        self._table("relationships").append(knowledge.load_edges(records.read_edges(self.spark, path, source)))

    def keep_terms(self, terms: list[str]) -> None:
        """Stores the documents of these terms; searches for them read the stored lists, and indexing renews these."""
        known = [r[0] for r in self._read("kept_terms", "term string").collect()]  # the terms that were asked for
        self._replace("kept_terms", self.spark.createDataFrame([(t,) for t in dict.fromkeys([*known, *map(sanitize, terms)])], "term string"))
        self._renew_terms()

    def _renew_terms(self) -> None:
        terms = [r[0] for r in self._read("kept_terms", "term string").collect()]
        if terms:
            c = self.corpus()
            names = self.spark.createDataFrame(list(enumerate(terms)), "term_no int, term string")
            found = search(c.docs, terms, postings=c.postings).join(names, "term_no").select("term", "pmid")
            self._replace("term_documents", found.repartitionByRange("term", "pmid"))

    def index(self, report: Callable[[float], None] = lambda x: None) -> None:
        """Brings postings and stored term lists up to date with the documents that changed since the last time.

        Only the postings of changed documents are marked as gone and written anew; the others stay in their files. The
        four stages are reported: what has changed, new postings, the documents' marks, and the stored term lists.
        """
        table, postings = self._table("documents"), self._table("postings")
        if not table.latest().files:
            return
        docs = table.read()
        changed = materialize(docs.where("NOT is_indexed"), "changed")
        report(0.25)
        if not changed.isEmpty():
            gone = postings.read().join(changed.select("pmid"), "pmid", "left_semi").select(*POSITION) if postings.latest().files else None
            fresh = index.build_postings(changed.select("pmid", "title", "abstract"))
            postings.replace_rows(gone, fresh.repartitionByRange("ngram", "pmid").sortWithinPartitions("ngram", "pmid", "pos"))
            report(0.5)
            table.replace_rows(changed, changed.drop(*POSITION).withColumn("is_indexed", F.lit(True)))
            report(0.75)
        self._renew_terms()

    def compact(self) -> None:
        """Writes postings in order of n-gram and documents in order of pmid again, without the rows marked as gone."""
        self._replace("postings", self.postings().repartitionByRange("ngram", "pmid").sortWithinPartitions("ngram", "pmid", "pos"))
        self._replace("documents", self.documents().repartitionByRange("pmid").sortWithinPartitions("pmid"))

    def add_relationships(self, edges: DataFrame) -> None:
        self._table("relationships").append(knowledge.load_edges(edges))

    def corpus(self) -> association.Corpus:
        terms = frozenset(r[0] for r in self._read("kept_terms", "term string").collect())  # the terms that were asked for
        kept = self._read("term_documents", "term string, pmid long") if terms else None
        return association.Corpus(self.documents(), self.postings() if self._table("postings").latest().files else None, self.relationships(), kept, terms)

    def search(self, term: str, first: int = MIN_YEAR, last: int = MAX_YEAR) -> DataFrame:
        c, text = self.corpus(), sanitize(term)
        if not self._read("kept_terms", "term string").where(F.col("term") == text).isEmpty():
            found = self._read("term_documents", "term string, pmid long").where(F.col("term") == text).select("pmid")
            return found.join(corpus.in_years(c.docs, first, last).select("pmid"), "pmid", "left_semi")
        return search(c.docs, [term], first, last, c.postings).select("pmid")

    def count(self, first: int = MIN_YEAR, last: int = MAX_YEAR) -> int:
        return corpus.count_documents(self.documents(), first, last).first()[0]

    def associate(self, **params) -> DataFrame:
        return association.associate(self.corpus(), association.Params.of(params))

    def edges(self, a_term: str, b_term: str, first: int | None = None, last: int | None = None) -> DataFrame:
        return knowledge.between(self.relationships(), self.spark.createDataFrame([(a_term, b_term)], "a string, b string"), self.documents(), first, last).drop("a", "b")

    def evaluate(self, params: dict, scorer: Callable, schema: str, names: dict[str, str] | None = None) -> DataFrame:
        return hypotheses.evaluate(self.corpus(), hypotheses.EvaluationParams.of(params, names), scorer, schema)

    def submit_association(self, **params) -> str:
        """Queues a job; small jobs come first. Its result is a table, read row by row or by pages as dictionaries."""
        p = association.Params.of(params).validated()
        n = len(p.a_terms) + len(p.b_terms) + len(p.c_terms or [])
        return self.queue.submit(lambda job: StoredRows(association.associate(self.corpus(), p), f"{self.root}/results/{job.id}"), priority_of(n), p.id)

    def submit_index(self) -> str:
        return self.queue.submit(lambda job: self.index(job.report), "INDEXING")

    def exists(self) -> bool:
        fs, p = file_system(self.spark, self.root)
        return fs.exists(p)
