"""The life of a query, from text to ranked hits with a trace."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.operators import bm25, filters, fuse, rerank, vector
from lexivec.operators.embed import Embedder, checked_query
from lexivec.schema import DEFAULT_TOP_K, PAYLOAD, RERANK_FAN_IN, FusionConfig
from lexivec.sources.store import ChunkStore


def pre_fusion_k(k: int) -> int:
    """How deep each leg is read before fusion."""
    return max(2 * k, 20)


def effective_k(k: int, reranked: bool) -> int:
    return min(k, RERANK_FAN_IN) if reranked else k


@dataclass
class Outcome:
    """Hits, and the lists that led to them."""

    hits: DataFrame
    legs: dict[str, DataFrame] = field(default_factory=dict)
    fused: DataFrame | None = None


#: Winners that are broadcast at most; with more, or no bound, Spark picks the join by size.
FEW = 100_000


def with_payload(scored: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """What the winners, at most ``k``, carry; joined after the cut so that ranking never moves texts."""
    have = [c for c in PAYLOAD if c in chunks.columns]
    few = F.broadcast(scored) if k is not None and k <= FEW else scored
    return few.join(chunks.select("id", *have), "id").select("id", *have, "score")


def hybrid(
    chunks: DataFrame,
    query: str,
    embedding: list[float],
    k: int,
    collection: str | None = None,
    index: bm25.LexicalIndex | None = None,
    vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The two ranked lists (id, score) before fusion; ``index`` is one over all chunks, if there is one.

    ``vectors`` (id, embedding) is where they aren't a column of the chunks; those without a chunk don't
    count. Only ids and scores meet, never texts.
    """
    rows = chunks if collection is None else chunks.where(F.col("collection") == collection)
    lexical = bm25.search_index(index, query, k) if index is not None and collection is None else bm25.search_text(rows, query, k)
    if vectors is None:
        return lexical, vector.search(rows, embedding, k)
    return lexical, bm25.top(vector.scored(vectors, embedding).join(rows.select("id"), "id", "left_semi"), k)


def run_query(
    chunks: DataFrame,
    query: str,
    embedding: list[float],
    k: int = DEFAULT_TOP_K,
    least: float | None = None,
    scorer: rerank.Scorer | None = None,
    config: FusionConfig = FusionConfig(),
    collection: str | None = None,
    index: bm25.LexicalIndex | None = None,
    vectors: DataFrame | None = None,
) -> Outcome:
    """BM25 and vector lists fused, optionally reranked (at most 64 of them), then filtered."""
    k = effective_k(k, scorer is not None)
    lexical, near = hybrid(chunks, query, embedding, pre_fusion_k(k), collection, index, vectors)
    fused = fuse.fuse({"lex": lexical, "vec": near}, config)
    scored = fused.select("id", F.col("final_score").alias("score"))
    if scorer is not None:
        pool = F.broadcast(scored.limit(RERANK_FAN_IN)).join(chunks.select("id", "text"), "id")
        pool = pool.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "id")))
        scored = rerank.rerank(pool.drop("score"), query, scorer).select("id", F.col("rerank_score").alias("score"))
    hits = filters.apply(scored, k, least)
    return Outcome(filters.top_k(with_payload(hits, chunks, k), k), {"lex": lexical, "vec": near}, fused)


def explain(outcome: Outcome) -> DataFrame:
    """(id, rank, score, source, source_rank, weight, rrf_value, bonus): why each shown hit is there."""
    shown = fuse.ranked(outcome.hits.select("id", "score"))
    rows = F.broadcast(shown).join(outcome.fused.select("id", F.explode("contributions").alias("c")), "id")
    return rows.select("id", "rank", "score", F.col("c.source").alias("source"), F.col("c.rank").alias("source_rank"), "c.weight", "c.rrf_value", "c.bonus").orderBy("rank", "source")


def search(store: ChunkStore, query: str, k: int | None = DEFAULT_TOP_K, least: float | None = None) -> DataFrame:
    """Lexical search, in the store's index if it has one; ``k`` None gives all. A blank query finds nothing."""
    chunks, index = store.table(), store.lexical()
    found = bm25.search_text(chunks, query, k, stemmed=True) if index is None else bm25.search_index(index, query, k)
    return filters.apply(with_payload(found, chunks, k), k, least)


def vsearch(store: ChunkStore, model: Embedder, query: str, k: int | None = DEFAULT_TOP_K, least: float | None = None) -> DataFrame:
    embedding = checked_query(store, model, query)
    chunks = store.table()
    return filters.apply(with_payload(vector.search(chunks, embedding, k), chunks, k), k, least)


def query(store: ChunkStore, model: Embedder, text: str, k: int = DEFAULT_TOP_K, least: float | None = None, scorer: rerank.Scorer | None = None) -> Outcome:
    return run_query(store.table(), text, checked_query(store, model, text), k, least, scorer, index=store.lexical())


def get(store: ChunkStore, what: str) -> DataFrame:
    """Chunks in order of a path, or of an id that starts with what follows ``#``."""
    rows = store.table()
    found = rows.where(F.col("id").startswith(what[1:])) if what.startswith("#") else rows.where(F.col("path") == what)
    return found.orderBy("path", "chunk_index")


def multi_get(store: ChunkStore, what: str) -> DataFrame:
    """Chunks of several: comma-separated paths or ``#ids``, or a glob over paths."""
    rows = store.table()
    if "*" in what or "?" in what:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_" else c) for c in what.replace("**", "\0"))
        return rows.where(F.col("path").rlike("(^|/)" + pattern.replace("\\\0", ".*") + "$")).orderBy("path", "chunk_index")
    parts = [p.strip() for p in what.split(",") if p.strip()]
    ids, paths = [p[1:] for p in parts if p[0] == "#"], [p for p in parts if p[0] != "#"]
    test = F.col("path").isin(paths)
    for i in ids:
        test = test | F.col("id").startswith(i)
    return rows.where(test).orderBy("path", "chunk_index")
