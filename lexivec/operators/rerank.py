"""Second-stage ranking: candidates, prompts, pluggable scorers and the final order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.functions.text import RERANK_INSTRUCTION, RERANK_PROMPT
from lexivec.schema import LexivecError

CONTEXT_TOKENS = 2048
RESERVED_TOKENS = 8


class Scorer(Protocol):
    """Relevance of documents to a query, from 0 to 1. Loaded once per worker."""

    def score(self, query: str, documents: list[str], instruction: str | None = None) -> list[float]: ...


class OverlapScorer:
    """A stand-in without a model: the share of the query's terms that the document has.

    It is deterministic and says nothing about how a trained reranker would score.
    """

    def score(self, query: str, documents: list[str], instruction: str | None = None) -> list[float]:
        asked = set(re.findall(r"[^\W_]+", query.lower()))
        if not asked:
            return [0.0] * len(documents)
        return [len(asked & set(re.findall(r"[^\W_]+", d.lower()))) / len(asked) for d in documents]


def fit_document(query: str, document: str, count: Callable[[str], int], cut: Callable[[str, int], str], instruction: str | None = None) -> str:
    """The document cut so that the whole prompt fits the context; the scaffold is never cut."""

    def prompt(text: str) -> str:
        return RERANK_PROMPT.format(instruction=instruction or RERANK_INSTRUCTION, query=query, document=text)

    overhead = count(prompt("")) + RESERVED_TOKENS
    if overhead >= CONTEXT_TOKENS:
        raise LexivecError(f"query is too long to rerank: {overhead} of {CONTEXT_TOKENS} tokens without a document")
    fitted = cut(document, CONTEXT_TOKENS - overhead)
    if count(prompt(fitted)) > CONTEXT_TOKENS:
        raise LexivecError("prompt is over the context after the document was cut")
    return fitted


def validated(spark: SparkSession, text: str) -> DataFrame:
    """(pos, id, text, extra) of a JSON array of candidates; the first bad one is named.

    ``extra`` holds the other fields as a JSON object, without earlier ranks.
    """
    rows = json.loads(text)
    if not isinstance(rows, list):
        raise LexivecError("candidates must be a JSON array")
    found = []
    for i, row in enumerate(rows):
        for name in ("id", "text"):
            value = row.get(name) if isinstance(row, dict) else None
            if not isinstance(value, str) or not value:
                raise LexivecError(f"candidate {i}: field {name!r} must be a non-empty string")
        extra = {k: v for k, v in row.items() if k not in ("id", "text", "rank", "rerank_score")}
        found.append((i, row["id"], row["text"], json.dumps(extra, sort_keys=True)))
    return spark.createDataFrame(found, "pos int, id string, text string, extra string")


def first_violation(candidates: DataFrame) -> DataFrame:
    """(pos, field) of the first candidate without a usable id or text; no row if all are good."""
    bad = lambda c: F.col(c).isNull() | (F.col(c) == "")
    named = candidates.withColumn("field", F.when(bad("id"), "id").when(bad("text"), "text")).where(F.col("field").isNotNull())
    return named.orderBy("pos").limit(1).select("pos", "field")


def order_by_relevance(scored: DataFrame, top_k: int | None = None, score: str = "rerank_score") -> DataFrame:
    """By score, best first, ties in input order (``pos``), with ``rank`` from 1."""
    out = scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "pos")))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def rerank(candidates: DataFrame, query: str, scorer: Scorer | None = None, top_k: int | None = None, instruction: str | None = None) -> DataFrame:
    """Candidates (pos, id, text, ...) with rerank_score and rank; stale ones are replaced."""
    own = candidates.drop("rank", "rerank_score")
    if top_k == 0:
        return own.limit(0).selectExpr("*", "double(0) AS rerank_score", "int(0) AS rank")
    scorer = scorer or OverlapScorer()

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(rerank_score=scorer.score(query, part["text"].tolist(), instruction))

    schema = ", ".join(f"`{n}` {t}" for n, t in [*own.dtypes, ("rerank_score", "double")])
    return order_by_relevance(own.mapInPandas(batches, schema), top_k).orderBy("rank")
