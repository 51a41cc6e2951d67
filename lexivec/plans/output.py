"""Results as text: tables, JSON, file lists, vectors and traces. All of them are small by now."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.text import preview_line
from lexivec.operators.filters import files
from lexivec.schema import LexivecError

PREVIEW = 80


def as_table(hits: DataFrame) -> str:
    rows = hits.withColumn("preview", preview_line(F.col("text"), PREVIEW)).collect()
    if not rows:
        return "(no results)\n"
    return "".join(f"{i:>3}  {r['score']:.4f}  {r['path']}\n     {r['preview']}\n" for i, r in enumerate(rows, 1))


def as_json(hits: DataFrame) -> str:
    return json.dumps([r.asDict(recursive=True) for r in hits.collect()], indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def as_files(hits: DataFrame) -> str:
    return "".join(r["path"] + "\n" for r in files(hits).collect())


def render(hits: DataFrame, as_: str = "table") -> str:
    return {"table": as_table, "json": as_json, "files": as_files}[as_](hits)


def vector_json(vector: list[float]) -> str:
    """One line; a value that is not finite is an error and nothing is written."""
    for i, x in enumerate(vector):
        if not math.isfinite(x):
            raise LexivecError(f"embedding value {i} is not finite: {x}")
    return json.dumps(vector) + "\n"


def reranked_json(rows: DataFrame) -> str:
    out = []
    for r in rows.collect():
        extra = json.loads(r["extra"]) if "extra" in r.asDict() and r["extra"] else {}
        out.append(extra | {"id": r["id"], "text": r["text"], "rerank_score": r["rerank_score"], "rank": r["rank"]})
    return json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def reranked_table(rows: DataFrame) -> str:
    found = rows.withColumn("preview", preview_line(F.col("text"), PREVIEW)).collect()
    return "".join(f"{r['rank']:>3}  {r['rerank_score']:.4f}  {r['id']}  {r['preview']}\n" for r in found)


def trace(outcome) -> str:
    """The legs' sizes, the fused documents and each hit's contributions."""
    from lexivec.plans.hybrid import explain

    lines = [f"{name}: {hits.count()} hits" for name, hits in outcome.legs.items()]
    lines.append(f"fuse: {outcome.fused.count()} unique docs")
    for r in explain(outcome).collect():
        lines.append(f"#{r['rank']} {r['id'][:12]} {r['score']:.6f}  {r['source']}@{r['source_rank']}: {r['weight']} -> {r['rrf_value']:.6f} + {r['bonus']}")
    return "\n".join(lines) + "\n"


def describe(store) -> str:
    now = store.manifest()
    lines = [f"dataset: {store.root}", f"version: {now.version}", f"rows: {now.rows}", f"embedder: {now.embedder_model or '-'} ({now.embedder_dim or '-'})", "schema:"]
    return "\n".join(lines + [f"  {n}: {t}" for n, t in store.table().dtypes]) + "\n"
