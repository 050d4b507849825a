"""A knowledge base: chunks, vectors and a graph as tables, and batches of queries against them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import query_analysis
from lodeseek.operators import chunking, graph_query, implicit_graph, retrieval, store
from lodeseek.operators.case_documents import case_document

Embed = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class Settings:
    """How queries are answered."""

    search_mode: str = "vector"
    final_top_k: int = 10
    recall_top_k: int = 50
    similarity_threshold: float = 0.0
    bm25_top_k: int = 50
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    rrf_k: int = 60
    use_graph: bool = True
    graph_weight: float = 0.5
    implicit_weight: float = 0.4
    damping: float = 0.85
    implicit_damping: float = 0.8
    coverage: float = 0.999
    graph_seeds: int = 10
    graph_top_k: int = 50
    graph_iterations: int = 20
    lexical: bool = False
    lexical_top_k: int = 20
    min_rerank_score: float = 0.0

    @classmethod
    def options(cls) -> dict[str, object]:
        return {f.name: f.default for f in fields(cls)}


@dataclass
class KnowledgeBase:
    """Tables: chunks (chunk_id, file_id, chunk_index, content, graph_indexed), vectors (id, vector), mentions (chunk_id, entity_id), relations (src, dst)."""

    spark: SparkSession
    embed: Embed
    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    mentions: DataFrame | None = None
    relations: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    def ingest(self, docs: DataFrame, preset: str = "case_document", **params) -> None:
        """Chunk and embed documents (file_id, filename, content); chunks of their files are replaced."""
        if preset == "case_document":
            told, made = case_document(docs), None
            for kind in ("transcript", "chat", "csv", "spreadsheet", "general"):
                part = chunking.chunk(told.filter(F.col("preset") == kind), kind, **params)
                made = part if made is None else made.unionByName(part)
        else:
            made = chunking.chunk(docs, preset, **params)
        made = made.withColumn("graph_indexed", F.lit(False))
        vectors = self.embed(made.select(F.col("chunk_id").alias("id"), "content"), "content", "vector").select("id", "vector")
        if self.chunks is not None:
            old = store.without(self.chunks, docs.select(F.col("file_id").cast("string").alias("file_id")), "file_id")
            vectors = vectors.unionByName(self.vectors.join(old.select(F.col("chunk_id").alias("id")), "id", "left_semi"))
            made = made.unionByName(old)
        self.chunks, self.vectors = made, vectors

    def query(self, queries: DataFrame, files: DataFrame | None = None, **changed) -> DataFrame:
        """Answer queries (query_id, text): query_id, chunk_id, file_id, content, score, rank."""
        s = Settings(**{**self.settings.__dict__, **changed})
        chunks = self.chunks if files is None else self.chunks.join(files.select("file_id"), "file_id", "left_semi")
        recall = max(s.recall_top_k, s.final_top_k) if s.use_graph else s.final_top_k
        analysed = queries.select("query_id", "text", query_analysis(F.col("text")).alias("a"))
        terms = analysed.select("query_id", F.when(F.size(F.concat("a.exact", "a.terms")) > 0, F.concat("a.exact", "a.terms")).otherwise(F.slice(F.filter(F.split("a.phrase", " "), lambda w: F.length(w) >= 2), 1, 4)).alias("terms"))
        rows = chunks.select(F.col("chunk_id").alias("id"), "content", F.col("chunk_index").alias("pos"))
        base = None
        if s.search_mode in ("vector", "hybrid"):
            asked = self.embed(queries.select("query_id", "text"), "text", "query").select("query_id", "query")
            vectors = self.vectors.join(rows.select("id"), "id", "left_semi")
            base = retrieval.dense_top_k(vectors, asked, recall, s.similarity_threshold)
        if s.search_mode in ("keyword", "hybrid"):
            words = retrieval.bm25(rows, terms, s.bm25_top_k).select("query_id", "id", "score", "rank")
            base = words if base is None else retrieval.fuse(base, words, s.bm25_weight / s.vector_weight, s.rrf_k)
        if s.lexical:
            exact = analysed.select("query_id", F.col("a.exact").alias("terms")).filter(F.size("terms") > 0)
            base = retrieval.fuse(base, retrieval.bm25(rows, exact, s.lexical_top_k), 1.0, s.rrf_k)
        if s.use_graph:
            found = self._graph(base, s)
            base = retrieval.fuse(base, found[0], found[1], s.rrf_k) if found else base
        top = base.filter(F.col("rank") <= s.final_top_k).select("query_id", F.col("id").alias("chunk_id"), "score", "rank")
        return top.join(chunks.select("chunk_id", "file_id", "content"), "chunk_id").select("query_id", "chunk_id", "file_id", "content", "score", "rank")

    def _graph(self, base: DataFrame, s: Settings) -> tuple[DataFrame, float] | None:
        """Chunks by PageRank from each query's first chunks, over entities and relations once most chunks are in the graph, else over chunks that stand together.

        Where the graph of entities gives a query nothing, its seeds' neighbours by shared entities do."""
        seeds = base.filter(F.col("rank") <= s.graph_seeds).select("query_id", F.col("id").alias("seed"), "score")
        seeds = seeds.withColumn("score", F.greatest("score", F.lit(0.0)) + 1e-9)
        covered = store.coverage(self.chunks).first().coverage
        ids = self.chunks.select(F.col("chunk_id").alias("id"))
        if self.mentions is not None and covered >= s.coverage:
            held = self.mentions.select("chunk_id", "entity_id").distinct()
            # Chunks and entities are nodes of one graph; the kind keeps equal ids apart.
            chunk, entity = (lambda c: F.concat(F.lit("c:"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("e:"), F.col(c).cast("string")))
            edges = held.select(chunk("chunk_id").alias("src"), entity("entity_id").alias("dst"), F.lit(1.0).alias("weight"))
            if self.relations is not None:
                edges = edges.unionByName(self.relations.select(entity("src").alias("src"), entity("dst").alias("dst"), F.lit(1.0).alias("weight")))
            reset = seeds.join(held, F.col("seed") == F.col("chunk_id")).select("query_id", entity("entity_id").alias("node"), F.col("score").alias("p"))
            scores = graph_query.pagerank_batch(graph_query.undirected(edges), reset, s.damping, s.graph_iterations)
            reached = scores.join(ids.withColumn("node", chunk("id")), "node").select("query_id", "id", "score")
            near = graph_query.co_mentions(held, seeds.select(F.col("seed").alias("chunk_id")).distinct())
            hops = seeds.join(near, F.col("seed") == F.col("u")).groupBy("query_id", F.col("v").alias("id")).agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
            reached = reached.unionByName(hops.join(reached.select("query_id").distinct(), "query_id", "left_anti"))
            weight = s.graph_weight
        else:
            near = implicit_graph.adjacent_edges(self.chunks.select(F.col("chunk_id").alias("id"), "file_id", "chunk_index"))
            edges = graph_query.undirected(near.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"))
            reset = seeds.select("query_id", F.col("seed").alias("node"), F.col("score").alias("p"))
            scores = graph_query.pagerank_batch(edges, reset, s.implicit_damping, s.graph_iterations)
            reached = scores.join(ids, F.col("node") == F.col("id"), "left_semi").select("query_id", F.col("node").alias("id"), "score")
            weight = s.implicit_weight
        return retrieval.ranked(reached, [F.col("score").desc(), F.col("id").asc()], s.graph_top_k), weight
