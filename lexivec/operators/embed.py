"""Filling in vectors: the plug-in protocol, a stand-in without a model, and the distributed pass."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.batches import slices, tidy
from lexivec.schema import DEFAULT_DIM, EMBED_BATCH, LexivecError
from lexivec.session import materialise
from lexivec.sources.store import ChunkStore


class Embedder(Protocol):
    """Vectors of texts. Made once per worker from a factory."""

    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A stand-in without a model: signed feature hashing of words, of unit length.

    It is deterministic; near vectors mean shared words and nothing more.
    """

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim, self.model_id = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float]:
        words = re.findall(r"[^\W_]+", text.lower())
        if not words:
            raise LexivecError("nothing to embed: the text has no tokens")
        out = [0.0] * self.dim
        for w in words:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else [1.0] + out[1:]


@dataclass(frozen=True)
class EmbedReport:
    rows: int
    batches: int
    model_id: str
    dim: int


def embed_batches(parts: Iterator[pa.RecordBatch], make: Callable[[], Embedder], batch: int) -> Iterator[pa.RecordBatch]:
    model = make()
    for part in parts:
        for some in slices(part):
            texts = some.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t and re.search(r"[^\W_]", t)]
            for at in range(0, len(known), batch):
                own = known[at : at + batch]
                found = np.asarray(model.embed([texts[i] for i in own]), np.float32)
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(own)), pa.ListArray.from_arrays(ends, found.ravel())], ["id", "embedding"])


def embed_table(rows: DataFrame, make: Callable[[], Embedder], batch: int = EMBED_BATCH) -> DataFrame:
    """(id, embedding) of (id, text); a text without tokens gets no vector. A worker holds one slice of texts."""

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return embed_batches(parts, make, batch)

    return rows.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(batches, "id string, embedding array<float>")


def run_embed(store: ChunkStore, make: Callable[[], Embedder]) -> EmbedReport:
    """Vectors for every row that has none, published at once; a second run finds nothing to do."""
    model = make()
    store.validate_or_record_embedder(model.model_id, model.dim)
    new = materialise(embed_table(store.scan_unembedded(), make), "vectors")
    rows = new.count()
    if rows:
        store.apply_embeddings(new)
    return EmbedReport(rows, -(-rows // EMBED_BATCH), model.model_id, model.dim)


def checked_query(store: ChunkStore, model: Embedder, query: str) -> list[float]:
    """The query's vector, after the guards that need no model have passed."""
    now = store.manifest()
    if now.embedder_model is None:
        raise LexivecError("dataset has no embeddings (run `lexivec embed` first)")
    if now.embedder_model != model.model_id:
        raise LexivecError(f"dataset was embedded with {now.embedder_model!r}, the query embedder is {model.model_id!r}")
    return model.embed([query])[0]


def unembedded_longest(chunks: DataFrame, n: int, vectors: DataFrame | None = None) -> DataFrame:
    """(id, chars) of the longest rows without a vector, in a column or in ``vectors`` (id, embedding)."""
    size = F.length("text").alias("chars")
    if vectors is None:
        left = chunks.where(F.col("embedding").isNull()).select("id", size)
    else:
        left = chunks.select("id", size).join(vectors.where(F.col("embedding").isNotNull()).select("id"), "id", "left_anti")
    return left.orderBy(F.desc("chars"), "id").limit(n)
