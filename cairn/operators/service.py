"""A library of documents: ingest to chunk and index tables, search for many queries at once, and tools over them.

Tables live under one path: chunks, gone, index, postings, lengths and, where an embedder is given, vectors. Each ingest
appends one batch to all of them, whose size is that of its documents: earlier chunks of these documents are told by a row
in ``gone``, not rewritten. A batch counts from the moment its commit is written, so a run that breaks off leaves the last
state, and one that is repeated replaces its own rows. ``compact`` writes the live rows of all batches as one.

An embedder takes (rows, text column, vector column) and adds the vector column; a reranker takes (query column, passage
column) and gives a score column, null where the model failed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunking, merge, rerank, retrieval, store, tools
from cairn.operators.agent import Registry, Result, Token, Tool

INDEXED = ("content", "source_id", "chunk_id", "knowledge_id", "kb_id")


def local_embedder(dim: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    def embed(rows: DataFrame, text: str, to: str) -> DataFrame:
        with_terms = rows.withColumn("_terms", rerank.local_terms(T.sanitised_for_embedding(F.col(text))))
        return rerank.hash_embed(with_terms, "_terms", dim, to).drop("_terms")

    return embed


def local_reranker(query: Column, passage: Column) -> Column:
    return rerank.lexical_score(F.array_distinct(rerank.local_terms(query)), F.array_distinct(rerank.local_terms(passage)))


@dataclass
class Library:
    spark: SparkSession
    path: str
    embedder: Callable[[DataFrame, str, str], DataFrame] | None = None
    reranker: Callable[[Column, Column], Column] | None = None

    def _folder(self, name: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, int]]:
        """(batch, first batch that counts) of all commits, in order."""
        at, fs = self._folder("commits")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(tuple(map(int, n.split("-"))) for n in names if "-" in n)

    def _commit(self, batch: int, first: int) -> None:
        at, fs = self._folder(f"commits/{batch}-{first}")
        fs.create(at, True).close()

    def rows(self, name: str) -> DataFrame | None:
        """A table's rows of all committed batches."""
        done, (at, fs) = self.commits(), self._folder(name)
        if not done or not fs.exists(at):
            return None
        last, first = done[-1]
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch").between(first, last))

    def table(self, name: str) -> DataFrame | None:
        """A table as it stands: chunks with their time of deletion, and of the others the rows of live chunks."""
        found = self.rows(name)
        if found is None:
            return None
        if name == "chunks":
            gone = self.rows("gone").groupBy("knowledge_id").agg(F.max(F.struct("batch", "at")).alias("_gone"))
            at = F.when(F.col("_gone.batch") > F.col("batch"), F.col("_gone.at"))
            return found.join(gone, "knowledge_id", "left").withColumn("deleted_at", at).drop("batch", "_gone")
        key = "row_id" if name in ("postings", "lengths") else "chunk_id"
        kept = store.live(self.table("chunks")).select(F.col("chunk_id").alias(key), "_batch")
        return found.withColumnRenamed("batch", "_batch").join(kept, [key, "_batch"], "left_semi").drop("_batch")

    def _append(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def ingest(self, docs: DataFrame, plan: chunking.Plan | None = None, at: str = "1970-01-01 00:00:00") -> dict[str, int]:
        """docs: tenant_id, kb_id, knowledge_id, title, text. Counts of chunks written, replaced and indexed."""
        done, now = self.commits(), F.lit(at).cast("timestamp")
        batch, first = (done[-1][0] + 1, done[-1][1]) if done else (0, 0)
        cut = chunking.chunks(docs.select("knowledge_id", "text"), "knowledge_id", "text", plan).withColumnRenamed("kind", "chunk_type")
        clean = store.without_blank(store.cleaned(cut))
        keyed = clean.join(docs.select("tenant_id", "kb_id", "knowledge_id", "title"), "knowledge_id").withColumn("chunk_id", store.chunk_key(F.col("tenant_id"), F.col("kb_id"), F.col("knowledge_id"), F.col("chunk_type"), F.col("seq")))
        parent = F.when(F.col("parent_index") >= 0, store.chunk_key(F.col("tenant_id"), F.col("kb_id"), F.col("knowledge_id"), F.lit("parent_text"), F.col("parent_index")))
        old = self.rows("chunks")
        last = old.agg(F.coalesce(F.max("seq_id"), F.lit(0))).first()[0] if old is not None else 0
        linked = store.with_links(keyed.withColumn("parent_chunk_id", parent).withColumn("chunk_index", F.col("seq")).withColumn("is_enabled", F.lit(True)).withColumn("created_at", now).withColumn("metadata", F.lit(None).cast("string")).withColumn("image_info", F.lit(None).cast("string")))
        replaced = store.live(self.table("chunks")).join(docs.select("knowledge_id").distinct(), "knowledge_id", "left_semi").count() if old is not None else 0
        self._append(store.with_seq(linked, last, ["kb_id", "knowledge_id"]).withColumn("_batch", F.lit(batch)), "chunks", batch)
        self._append(docs.select("knowledge_id", now.alias("at")).distinct(), "gone", batch)
        self._index(self.spark.read.parquet(f"{self.path}/chunks/batch={batch}"), batch)
        self._commit(batch, first)
        return {"chunks": store.live(self.table("chunks")).count(), "replaced": replaced, "indexed": self.table("index").count()}

    def _index(self, chunks: DataFrame, batch: int) -> None:
        """Index rows, postings, lengths and vectors of a batch of chunks."""
        text = T.embedding_text(F.col("title"), F.col("context_header"), F.col("content"))
        made = chunks.where("chunk_type <> 'parent_text'").select("chunk_id", F.col("chunk_id").alias("source_id"), "knowledge_id", "kb_id", "tenant_id", "is_enabled", text.alias("content"))
        self._append(made, "index", batch)
        index = self.spark.read.parquet(f"{self.path}/index/batch={batch}")
        spread = index.withColumn("content", F.array_join(T.cjk_terms(F.col("content")), " "))
        self._append(retrieval.postings(spread, "chunk_id", *INDEXED), "postings", batch)
        self._append(retrieval.lengths(spread, "chunk_id", *INDEXED), "lengths", batch)
        if self.embedder:
            self._append(self.embedder(index.select("chunk_id", "content"), "content", "vector").select("chunk_id", "vector"), "vectors", batch)

    def compact(self) -> None:
        """The live rows of all batches as one new batch; earlier ones count no more and are deleted."""
        done = self.commits()
        if not done:
            return
        batch = done[-1][0] + 1
        for name in ("chunks", "index", "postings", "lengths", "vectors"):
            found = self.table(name)
            if found is not None:
                self._append(store.live(found).drop("deleted_at").withColumn("_batch", F.lit(batch)) if name == "chunks" else found, name, batch)
        self._append(self.rows("gone").limit(0).drop("batch"), "gone", batch)
        self._commit(batch, batch)
        for name in ("chunks", "gone", "index", "postings", "lengths", "vectors"):
            for old, _ in done:
                at, fs = self._folder(f"{name}/batch={old}")
                fs.delete(at, True)

    def search(self, queries: DataFrame, scope: DataFrame | None = None, k: int = 5, vector_threshold: float = 0.0, keyword_threshold: float = 0.0, rerank_threshold: float = 0.3, faq_boost: float = 1.0, history: DataFrame | None = None) -> DataFrame:
        """queries (query_id, query): query_id, chunk_id, knowledge_id, content, start_at, end_at, score, rank of the best k.

        Keyword and vector lists are fused, reranked, and merged to passages (``merge.merged``); history has earlier results
        (query_id, chunk_id, knowledge_id, chunk_type, content, start_at, end_at, score). A query whose rerank fails or
        leaves nothing has its search results, best first.
        """
        chunks = store.live(self.table("chunks")).where("is_enabled")
        if scope is not None:
            chunks = tools.in_scope(chunks, scope)
        fetch = retrieval.overfetch(k, (chunks if scope is None else scope).select("kb_id").distinct().count())
        allowed = chunks.select(F.col("chunk_id").alias("row_id"))
        asked = queries.withColumn("query", F.array_join(T.cjk_terms(F.col("query")), " "))
        words = retrieval.bm25(asked, self.table("postings"), self.table("lengths")).join(allowed, "row_id", "left_semi")
        lists = [retrieval.over_threshold(retrieval.top(words, fetch), keyword_threshold)]
        if self.embedder:
            vectors = self.embedder(queries, "query", "query_vec").select("query_id", "query_vec")
            near = retrieval.top(retrieval.vector_hits(vectors, self.table("vectors"), "chunk_id", "vector"), fetch).join(allowed, "row_id", "left_semi")
            lists.append(retrieval.over_threshold(near, vector_threshold))
        shaped = [x.select("query_id", F.col("row_id").alias("chunk_id"), "score", F.col("rank").cast("int").alias("rank")) for x in lists]
        fused = retrieval.fuse_or_dedup(shaped[1] if len(shaped) > 1 else shaped[0].limit(0), shaped[0])
        best = retrieval.top(fused, fetch, tie="chunk_id").withColumn("ordinal", F.col("rank") - 1)
        found = merge.cut(best.select("query_id", "chunk_id", "score", "match_type", "ordinal")).join(chunks.select("chunk_id", "knowledge_id", "chunk_type", "parent_chunk_id", "content", "start_at", "end_at", "image_info", "metadata"), "chunk_id").join(queries, "query_id")
        hits = found
        if self.reranker:
            chosen = merge.cut(rerank.stage(found, lambda passage: self.reranker(F.col("query"), passage), k, rerank_threshold, faq_boost).withColumn("ordinal", F.col("mmr_rank") - 1))
            hits = chosen.select(*found.columns).unionByName(found.join(chosen.select("query_id").distinct(), "query_id", "left_anti"))
        earlier = None
        if history is not None:
            earlier = history.join(queries, "query_id").withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in ("parent_chunk_id", "image_info", "metadata")}).withColumn("match_type", F.lit(merge.HISTORY)).withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).select(*found.columns)
        final = merge.merged(hits, chunks, earlier)
        ranked = final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))).where(F.col("rank") <= k)
        return ranked.select("query_id", "chunk_id", "knowledge_id", "content", "start_at", "end_at", "score", "rank")

    def counts(self) -> DataFrame:
        """kb_id, documents and live chunks of each base."""
        return store.base_counts(store.live(self.table("chunks")))

    def titles(self) -> DataFrame:
        return self.table("chunks").groupBy("knowledge_id").agg(F.first("title", ignorenulls=True).alias("title"))

    def registry(self, scope: DataFrame) -> Registry:
        """The four tools within a scope; none where the scope is empty."""
        registry = Registry()
        if scope.isEmpty():
            return registry
        chunks = lambda: tools.in_scope(self.table("chunks"), scope)
        listed = lambda df: Result(True, json.dumps(rows := [r.asDict() for r in df.collect()], ensure_ascii=False, default=str), rows)

        def search(args: dict, token: Token) -> Result:
            asked = self.spark.createDataFrame([(i, q) for i, q in enumerate(args["queries"])], "query_id int, query string")
            hits = self.search(asked, tools.narrowed(scope, args.get("knowledge_base_ids") or [], "kb_id"))
            one = hits.withColumn("request_id", F.lit(0)).withColumn("parent_chunk_id", F.lit(None).cast("string")).withColumn("chunk_index", F.col("start_at")).withColumn("ordinal", F.col("query_id") * 1000 + F.col("rank")).drop("rank")
            return listed(tools.knowledge_search(one).select("chunk_id", "knowledge_id", "content", F.round("score", 4).alias("score"), T.relevance_level(F.col("score")).alias("relevance")).orderBy(F.desc("score"), "knowledge_id"))

        def grep(args: dict, token: Token) -> Result:
            found = tools.grep(chunks().drop("title"), args["patterns"], self.titles().join(chunks().select("knowledge_id").distinct(), "knowledge_id", "left_semi"))
            return listed(found.select("chunk_id", "knowledge_id", T.truncated(F.col("content"), 800).alias("content"), "score"))

        def pages(args: dict, token: Token) -> Result:
            return listed(store.page(store.live(chunks()).where(F.col("knowledge_id") == args["knowledge_id"]), args.get("offset", 0), args.get("limit", 100)).select("chunk_id", "chunk_index", "content"))

        def info(args: dict, token: Token) -> Result:
            return listed(store.document_info(store.live(chunks()).where(F.col("knowledge_id").isin(args["knowledge_ids"][:20]))))

        strings = lambda most: {"type": "array", "minItems": 1, "maxItems": most, "items": {"type": "string", "minLength": 1}}
        for tool in (
            Tool("knowledge_search", "Search by meaning and keywords.", {"type": "object", "properties": {"queries": strings(5), "knowledge_base_ids": {"type": "array", "items": {"type": "string"}}}, "required": ["queries"]}, search),
            Tool("grep_chunks", "Search by regular expressions.", {"type": "object", "properties": {"patterns": strings(5)}, "required": ["patterns"]}, grep),
            Tool("list_knowledge_chunks", "List a document's chunks.", {"type": "object", "properties": {"knowledge_id": {"type": "string"}, "offset": {"type": "integer", "minimum": 0}, "limit": {"type": "integer", "minimum": 1, "maximum": 200}}, "required": ["knowledge_id"]}, pages),
            Tool("get_document_info", "Counts of documents' chunks.", {"type": "object", "properties": {"knowledge_ids": strings(20)}, "required": ["knowledge_ids"]}, info),
        ):
            registry.add(tool)
        return registry
