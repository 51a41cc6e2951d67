"""The engine's functions for plain SQL: scalar ones with SQL bodies, chunking as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lexivec.operators.chunker import chunk_markdown
from lexivec.schema import ChunkOptions

SCALARS = {
    "l2_norm(v ARRAY<DOUBLE>)": "DOUBLE RETURN sqrt(aggregate(transform(v, x -> x * x), 0D, (s, x) -> s + x))",
    "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": "DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE RETURN CASE WHEN l2_norm(a) * l2_norm(b) > 0 THEN dot_product(a, b) / (l2_norm(a) * l2_norm(b)) END"
    ),
    "approx_tokens(t STRING)": "INT RETURN CAST(ceil(char_length(coalesce(t, '')) / 4) AS INT)",
    "yes_no_softmax(y DOUBLE, n DOUBLE)": "DOUBLE RETURN exp(y - greatest(y, n)) / (exp(y - greatest(y, n)) + exp(n - greatest(y, n)))",
}


class ChunkTable:
    """``SELECT * FROM chunk_markdown(text, max_tokens, overlap_tokens)``."""

    def eval(self, source: str, max_tokens: int = 900, overlap_tokens: int = 135) -> Iterator[tuple]:
        for c in chunk_markdown(source or "", ChunkOptions(max_tokens, overlap_tokens)):
            yield c.index, c.start_byte, c.end_byte, c.text, c.token_count


def register(spark: SparkSession) -> None:
    """Make the functions known to the session."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {body}")
    made = udtf(ChunkTable, returnType="chunk_index int, start_byte bigint, end_byte bigint, chunk string, tokens int")
    spark.udtf.register("chunk_markdown", made)
