"""Weighted reciprocal rank fusion of any number of ranked lists, with its trace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.schema import PAYLOAD, FusionConfig


def ranked(hits: DataFrame) -> DataFrame:
    """Hits with ``rank`` from 1, best first; lists are at most a few hundred rows by now."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "id")
    return hits.withColumn("rank", F.row_number().over(order))


def _bonus(rank: Column, bonus: tuple[float, ...]) -> Column:
    cases = [F.when(rank == i, F.lit(float(b))) for i, b in enumerate(bonus, 1)]
    return F.coalesce(*cases, F.lit(0.0))


def contributions(lists: dict[str, DataFrame], config: FusionConfig = FusionConfig()) -> DataFrame:
    """(id, source, source_order, rank, weight, rrf_value, bonus, payload...) of every list entry.

    A list comes with a rank or is ranked by score. A source without a weight counts 0 but still
    earns the bonus; an id that a list holds twice contributes twice.
    """
    parts = []
    for order, (source, hits) in enumerate(lists.items()):
        own = hits if "rank" in hits.columns else ranked(hits)
        weight = float(config.weights.get(source, 0.0))
        payload = [c for c in PAYLOAD if c in hits.columns]
        parts.append(
            own.select(
                "id",
                F.lit(source).alias("source"),
                F.lit(order).alias("source_order"),
                F.col("rank").cast("int").alias("rank"),
                F.lit(weight).alias("weight"),
                (F.lit(weight) / (F.lit(config.k) + F.col("rank"))).alias("rrf_value"),
                _bonus(F.col("rank"), config.bonus).alias("bonus"),
                *payload,
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fuse(lists: dict[str, DataFrame], config: FusionConfig = FusionConfig()) -> DataFrame:
    """(id, final_score, contributions, payload...), best first, ties by id.

    The lists are concatenated and grouped by id; the payload is that of the first list with the id.
    """
    rows = contributions(lists, config)
    payload = [c for c in PAYLOAD if c in rows.columns]
    trace = F.struct("source_order", "rank", "source", "weight", "rrf_value", "bonus")
    fused = rows.groupBy("id").agg(
        F.sum(F.col("rrf_value") + F.col("bonus")).alias("final_score"),
        F.sort_array(F.collect_list(trace)).alias("contributions"),
        *[F.min_by(c, F.struct("source_order", "rank")).alias(c) for c in payload],
    )
    return fused.orderBy(F.desc(F.round("final_score", 12)), "id")


def total_bonus(fused: DataFrame) -> DataFrame:
    added = F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["bonus"])
    return fused.withColumn("total_bonus", added)


def blend(lexical: DataFrame, vector: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, score): alpha times the vector score plus the rest of the lexical one, each over its best."""

    def scaled(hits: DataFrame, share: float) -> DataFrame:
        best = F.max("score").over(Window.partitionBy())
        return hits.select("id", (F.when(best > 0, F.col("score") / best).otherwise(0.0) * share).alias("part"))

    both = scaled(lexical, 1 - alpha).unionByName(scaled(vector, alpha))
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc(F.round("score", 9)), "id")
