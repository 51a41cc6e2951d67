"""Cosine nearest neighbours: exact, in batches of queries, and by an inverted file of centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.vectors import cosine, cosine_to
from lexivec.operators.bm25 import top


def search(vectors: DataFrame, query: list[float], k: int | None = 10) -> DataFrame:
    """(id, score), best first; rows without an embedding never match, an empty query matches nothing."""
    return top(scored(vectors, query), k)


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, score) of all that match, in no order."""
    if not len(query):
        return vectors.select("id").limit(0).withColumn("score", F.lit(0.0))
    known = vectors.where(F.col("embedding").isNotNull())
    return known.select("id", cosine_to(F.col("embedding"), query).alias("score")).where(F.col("score").isNotNull())


def with_distance(hits: DataFrame) -> DataFrame:
    return hits.withColumn("_distance", 1 - F.col("score"))


def search_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank) of a stated set of queries (query_id, embedding) against all rows.

    Queries go out in blocks as NumPy matrices; each batch of vectors keeps its k best per query, so
    what is shuffled is k rows per query and batch.
    """
    rows = queries.orderBy("query_id").collect()
    out = None
    for at in range(0, len(rows), query_block):
        block = rows[at : at + query_block]
        ids = np.array([r["query_id"] for r in block])
        table = np.array([r["embedding"] for r in block], np.float64)
        table /= np.maximum(np.sqrt((table * table).sum(axis=1, keepdims=True)), 1e-300)

        def best(parts, ids=ids, table=table):
            for part in parts:
                part = part[part["embedding"].notna()]
                if not len(part):
                    continue
                own = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                own /= np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-300)
                scores = np.round(table @ own.T, 12)
                names = part["id"].to_numpy()
                take = [np.lexsort((names, -s))[:k] for s in scores]
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(ids, [len(t) for t in take]),
                        "id": np.concatenate([names[t] for t in take]),
                        "score": np.concatenate([s[t] for s, t in zip(scores, take)]),
                    }
                )

        kind = dict(vectors.dtypes)["id"]
        found = vectors.select("id", "embedding").mapInPandas(best, f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class InvertedFile:
    """Centroids on the driver, vectors with the number of their nearest centroid."""

    centroids: np.ndarray
    assigned: DataFrame


def build_ivf(vectors: DataFrame, lists: int = 16, sample_rows: int = 20_000, seed: int = 7) -> InvertedFile:
    """K-means on a bounded sample of unit vectors, then every row assigned."""
    known = vectors.where(F.col("embedding").isNotNull())
    sample = known.orderBy(F.xxhash64("id")).limit(sample_rows).select("embedding").toPandas()
    if not len(sample):
        return InvertedFile(np.zeros((0, 0)), known.withColumn("list", F.lit(0)))
    x = _unit(np.stack(sample["embedding"].to_numpy()).astype(np.float64))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(15):
        near = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(np.bincount(near, minlength=len(centroids))[:, None] > 0, _unit(sums), centroids)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.stack(v.to_numpy()).astype(np.float64) @ centroids.T, axis=1).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    return InvertedFile(centroids, known.withColumn("list", nearest("embedding")))


def search_ivf(index: InvertedFile, query: list[float], k: int = 10, probes: int = 4) -> DataFrame:
    """As ``search`` within the lists whose centroids are nearest; written by list, the rest is pruned."""
    if not len(index.centroids):
        return search(index.assigned, query, k)
    near = np.argsort(-(index.centroids @ np.asarray(query, np.float64)))[:probes]
    return search(index.assigned.where(F.col("list").isin([int(i) for i in near])), query, k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def pairwise(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Cosine of two tables' embeddings that share a key."""
    joined = left.join(right.select(key, F.col("embedding").alias("other")), key)
    return joined.select(key, cosine(F.col("embedding"), F.col("other")).alias("score"))
