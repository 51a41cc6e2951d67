"""What happens to hits after ranking: threshold, cut, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def min_score(hits: DataFrame, least: float | None) -> DataFrame:
    """Hits of at least that score; a NaN score never passes (Spark would sort it above all)."""
    return hits if least is None else hits.where((F.col("score") >= least) & ~F.isnan("score"))


def top_k(hits: DataFrame, k: int | None) -> DataFrame:
    ordered = hits.orderBy(F.desc(F.round("score", 9)), "id")
    return ordered if k is None else ordered.limit(k)


def apply(hits: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """The threshold first, then the cut."""
    return top_k(min_score(hits, least), k)


def files(hits: DataFrame) -> DataFrame:
    """(path, rank): each path once, in the order of its best hit."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "id")
    numbered = hits.withColumn("rank", F.row_number().over(order))
    return numbered.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank")
