"""The chunk table, the ranked-hit table and the constants that queries share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SCHEMA_VERSION = 1
DEFAULT_DIM = 1024
DEFAULT_COLLECTION = "default"
URI_SCHEME = "lexivec"
DEFAULT_TOP_K = 10
EMBED_BATCH = 256
RERANK_FAN_IN = 64

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("collection", T.StringType(), False),
        T.StructField("uri", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("mtime", T.LongType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("tokens", T.IntegerType(), True),
        T.StructField("embedding", T.ArrayType(T.FloatType(), True), True),
        T.StructField("context_id", T.StringType(), True),
        T.StructField("schema_version", T.IntegerType(), False),
    ]
)

HITS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

#: What a hit carries besides id and score, when its table has it.
PAYLOAD = ("path", "uri", "chunk_index", "text")

FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("uri", T.StringType(), False),
        T.StructField("mtime", T.LongType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)


class LexivecError(Exception):
    """Anything a caller did that the engine cannot honour."""


class EmbedderDimMismatch(LexivecError):
    def __init__(self, dataset: int, embedder: int):
        super().__init__(f"embedder dimension mismatch: dataset has {dataset}, embedder gives {embedder}")
        self.dataset, self.embedder = dataset, embedder


class EmbedderModelMismatch(LexivecError):
    def __init__(self, dataset: str, embedder: str):
        super().__init__(f"embedder model mismatch: dataset was embedded with {dataset!r}, not {embedder!r}")
        self.dataset, self.embedder = dataset, embedder


@dataclass(frozen=True)
class FusionConfig:
    """Weighted reciprocal rank fusion: w / (k + rank), plus a bonus for the first ranks of a list."""

    k: int = 60
    weights: dict[str, float] = field(default_factory=lambda: {"lex": 0.75, "vec": 0.60})
    bonus: tuple[float, ...] = (0.05, 0.02, 0.02)


@dataclass(frozen=True)
class ChunkOptions:
    max_tokens: int = 900
    overlap_tokens: int = 135
    min_tokens: int = 64
