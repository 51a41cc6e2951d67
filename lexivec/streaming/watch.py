"""Indexing as a stream of new and changed files, and embedding in micro-batches.

Spark's file stream reports files that appear or change, never those that go, so each batch ends with
the same full comparison that ``run_index`` makes; what didn't change is skipped by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexivec.operators.embed import Embedder, embed_table
from lexivec.operators.ingest import IndexReport, run_index
from lexivec.schema import DEFAULT_COLLECTION
from lexivec.session import materialise
from lexivec.sources.store import ChunkStore

CHANGES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of Markdown files as they appear."""
    stream = spark.readStream.format("binaryFile").schema(CHANGES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
    return stream.load(root).drop("content")


def watch(
    spark: SparkSession,
    store: ChunkStore,
    root: str,
    checkpoint: str,
    collection: str = DEFAULT_COLLECTION,
    on_report: Callable[[IndexReport], None] | None = None,
    once: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Index whenever files arrive; ``once`` takes what is there and stops."""

    def batch(changed: DataFrame, _: int) -> None:
        if changed.isEmpty():
            return
        done = run_index(spark, store, root, collection)
        if on_report:
            on_report(done)

    writer = file_stream(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def embed_in_batches(store: ChunkStore, make: Callable[[], Embedder], batch: int, stop: Callable[[], bool] = lambda: False) -> int:
    """Vectors in published batches of so many rows; stops between batches when told to."""
    model = make()
    store.validate_or_record_embedder(model.model_id, model.dim)
    done = 0
    while not stop():
        rows = materialise(store.scan_unembedded().where(F.col("text").rlike(r"[\p{L}\p{N}]")).orderBy("id").limit(batch).select("id", "text"), "embed-batch")
        n = rows.count()
        if not n:
            break
        store.apply_embeddings(materialise(embed_table(rows, make), "vectors"))
        done += n
    return done
