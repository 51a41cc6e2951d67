"""Incremental indexing: files against what is stored, then one published snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.functions.text import chunk_id, under
from lexivec.operators.chunker import chunk_table
from lexivec.schema import CHUNKS, DEFAULT_COLLECTION, SCHEMA_VERSION, ChunkOptions
from lexivec.session import materialise
from lexivec.sources.mdtree import UNREADABLE, canonical, read_tree
from lexivec.sources.store import ChunkStore


@dataclass(frozen=True)
class IndexReport:
    files: int = 0
    chunks: int = 0
    skipped: int = 0
    removed: int = 0
    failed: int = 0


def diff(disk: DataFrame, existing: DataFrame, root: str | None = None) -> DataFrame:
    """(path, action): add, replace, skip, remove or failed. Both sides have path and content_hash.

    Only stored paths under the root can be removed. A file that cannot be read fails and keeps what
    is stored of it.
    """
    d = disk.select("path", F.col("content_hash").alias("disk_hash"))
    e = existing.select("path", F.col("content_hash").alias("kept_hash"))
    inside = F.lit(True) if root is None else under(F.col("path"), root)
    action = (
        F.when(F.col("disk_hash") == UNREADABLE, "failed")
        .when(F.col("kept_hash").isNull(), "add")
        .when(F.col("disk_hash").isNull(), F.when(inside, "remove"))
        .when(F.col("disk_hash") == F.col("kept_hash"), "skip")
        .otherwise("replace")
    )
    return d.join(e, "path", "full_outer").select("path", action.alias("action")).where(F.col("action").isNotNull())


def report(actions: DataFrame) -> DataFrame:
    """One row: files indexed, skipped, removed, failed."""
    of = lambda *names: F.count(F.when(F.col("action").isin(*names), 1))
    return actions.agg(of("add", "replace").alias("files"), of("skip").alias("skipped"), of("remove").alias("removed"), of("failed").alias("failed"))


def chunk_rows(files: DataFrame, collection: str = DEFAULT_COLLECTION, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Rows of the chunk table for files (path, uri, mtime, content_hash, text), without vectors."""
    keys = ["path", "uri", "mtime", "content_hash"]
    rows = chunk_table(files, keys, "text", options).withColumns(
        {
            "id": chunk_id(F.col("uri"), F.col("content_hash"), F.col("chunk_index")),
            "collection": F.lit(collection),
            "text": F.col("chunk"),
            "embedding": F.lit(None).cast("array<float>"),
            "context_id": F.lit(None).cast("string"),
            "schema_version": F.lit(SCHEMA_VERSION),
        }
    )
    return rows.select(*CHUNKS.fieldNames())


def run_index(spark: SparkSession, store: ChunkStore, root: str, collection: str = DEFAULT_COLLECTION, options: ChunkOptions = ChunkOptions()) -> IndexReport:
    """Bring the store up to what the folder holds; nothing is published if nothing changed."""
    root = canonical(root)
    files = materialise(read_tree(spark, root, collection), "files")
    actions = materialise(diff(files, store.file_hashes(collection), root), "actions")
    counts = report(actions).first()
    if not counts["files"] and not counts["removed"]:
        return IndexReport(skipped=counts["skipped"], failed=counts["failed"])
    fresh = files.join(actions.where(F.col("action").isin("add", "replace")).select("path"), "path", "left_semi")
    new = materialise(chunk_rows(fresh, collection, options), "chunks")
    gone = actions.where(F.col("action").isin("replace", "remove")).select("path", F.lit(collection).alias("collection"))
    kept = store.table().join(gone, ["collection", "path"], "left_anti")
    bare = files.where((F.col("text") == "") & (F.col("content_hash") != UNREADABLE))
    empty = {r["path"]: r["content_hash"] for r in bare.select("path", "content_hash").collect()}
    held = dict(store.manifest().files)
    outside = {p: h for p, h in held.get(collection, {}).items() if not (p == root or p.startswith(root + "/"))}
    store.replace(kept.unionByName(new), "index", index=True, files=held | {collection: outside | empty})
    return IndexReport(counts["files"], new.count(), counts["skipped"], counts["removed"], counts["failed"])
