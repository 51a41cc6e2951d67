"""The chunk table as immutable Parquet snapshots with manifests.

``root/_meta/N.json`` is the manifest of version N. It names the folder of its rows and that of its
lexical index, which no other writer uses; a version that changes neither points at those before. A
version exists once its manifest does, and the manifest is moved into place after the data, so readers
never see half a write, every version stays readable, and of two writers at once one fails without harm.
Files go through Hadoop's file system, so the root can be any path Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec import __version__
from lexivec.operators.bm25 import LexicalIndex, build_index, read_index, write_index
from lexivec.schema import CHUNKS, DEFAULT_DIM, SCHEMA_VERSION, EmbedderDimMismatch, EmbedderModelMismatch, LexivecError


@dataclass
class Manifest:
    version: int
    rows: int
    created: float
    action: str
    dim: int = DEFAULT_DIM
    schema_version: int = SCHEMA_VERSION
    engine_version: str = __version__
    embedder_model: str | None = None
    embedder_dim: int | None = None
    files: dict = field(default_factory=dict)
    tags: list[str] = field(default_factory=list)
    folder: str = ""
    lexical: str | None = None


class Storage:
    """The few file operations that a store needs, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file appears whole or not at all; an existing one is not replaced."""
        part = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(part), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(name) or not self.fs.rename(self.path(part), self.path(name)):
            self.fs.delete(self.path(part), False)
            raise LexivecError(f"{name} was written by someone else")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class ChunkStore:
    """Open a store with ``open`` or ``open_or_create``; each mutation publishes a new version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage = Storage(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> ChunkStore:
        store = cls(spark, root)
        if not store.versions_held():
            raise LexivecError(f"dataset not found at {root} (run `lexivec index` first)")
        return store

    @classmethod
    def open_or_create(cls, spark: SparkSession, root: str, dim: int = DEFAULT_DIM) -> ChunkStore:
        store = cls(spark, root)
        if not store.versions_held():
            store._publish(spark.createDataFrame([], CHUNKS), "create", Manifest(0, 0, 0.0, "create", dim))
        return store

    # Reading

    def versions_held(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.storage.names("_meta") if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        held = self.versions_held()
        version = held[-1] if version is None else version
        if version not in held:
            raise LexivecError(f"version {version} not found; there are {held}")
        try:
            return Manifest(**json.loads(self.storage.read(f"_meta/{version}.json")))
        except (TypeError, ValueError) as error:
            raise LexivecError(f"bad manifest of version {version}: {error}") from error

    def table(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{self.manifest(version).folder}")

    def lexical(self) -> LexicalIndex | None:
        """The index over the texts of the newest version, stemmed and folded; None if it has none."""
        folder = self.manifest().lexical
        return read_index(self.spark, f"{self.root}/{folder}", stemmed=True) if folder else None

    def count_rows(self) -> int:
        return self.table().count()

    def versions(self) -> DataFrame:
        rows = [(m.version, m.action, m.rows, m.created) for m in map(self.manifest, self.versions_held())]
        return self.spark.createDataFrame(rows, "version long, action string, rows long, created double")

    def config(self) -> DataFrame:
        rows = [(k, json.dumps(v)) for k, v in asdict(self.manifest()).items()]
        return self.spark.createDataFrame(rows, "key string, value string")

    def stats(self) -> DataFrame:
        """One row: live rows, rows without a vector, files of Parquet, versions, files indexed."""
        parts = sum(n.endswith(".parquet") for n in self.storage.names(self.manifest().folder))
        missing = F.count(F.when(F.col("embedding").isNull(), 1))
        counted = self.table().agg(F.count("*").alias("rows"), missing.alias("unembedded"), F.countDistinct("path").alias("paths"))
        return counted.withColumns({"parquet_files": F.lit(parts), "versions": F.lit(len(self.versions_held()))})

    def file_hashes(self, collection: str) -> DataFrame:
        """(path, content_hash) of every indexed file; files without chunks stand in the manifest."""
        rows = self.table().where(F.col("collection") == collection).select("path", "content_hash").distinct()
        empty = [(p, h) for p, h in self.manifest().files.get(collection, {}).items()]
        return rows.unionByName(self.spark.createDataFrame(empty, "path string, content_hash string")) if empty else rows

    def scan_unembedded(self, limit: int | None = None) -> DataFrame:
        rows = self.table().where(F.col("embedding").isNull())
        return rows if limit is None else rows.limit(limit)

    # Writing

    def _publish(self, rows: DataFrame | None, action: str, base: Manifest, index: bool = False, **changes) -> Manifest:
        """A new version: of rows, with an index of their texts if asked for, or of what ``base`` has."""
        held = self.versions_held()
        version = held[-1] + 1 if held else 1
        new = asdict(base) | {"version": version, "created": time.time(), "action": action, "tags": []}
        if rows is not None:
            folder = f"v={version}-{uuid.uuid4().hex[:12]}"
            rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS]).write.parquet(f"{self.root}/{folder}")
            written = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/{folder}")
            new |= {"folder": folder, "rows": written.count()}
            if index:
                write_index(build_index(written, stemmed=True), f"{self.root}/index-{folder}")
                new["lexical"] = f"index-{folder}"
        made = Manifest(**(new | changes))
        self.storage.write(f"_meta/{version}.json", json.dumps(asdict(made), indent=1))
        return made

    def replace(self, rows: DataFrame, action: str, texts: bool = True, index: bool = False, **changes) -> Manifest:
        """Publish other rows. An index that is there is made anew, unless no ``texts`` changed."""
        base = self.manifest()
        return self._publish(rows, action, base, texts and (index or base.lexical is not None), **changes)

    def build_lexical(self) -> Manifest:
        """Index the texts of the newest version."""
        base = self.manifest()
        folder = f"index-{uuid.uuid4().hex[:12]}"
        write_index(build_index(self.table(), stemmed=True), f"{self.root}/{folder}")
        return self._publish(None, "index-text", base, lexical=folder)

    def append(self, rows: DataFrame) -> Manifest:
        return self.replace(self.table().unionByName(rows), "append")

    def apply_embeddings(self, updates: DataFrame) -> int:
        """Vectors by id (id, embedding); rows without an update stay, updates without a row don't enter.

        Returns the number of updates given.
        """
        given = updates.select("id", F.col("embedding").alias("new"))
        rows = self.table().join(given, "id", "left").withColumn("embedding", F.coalesce("new", "embedding")).drop("new")
        self.replace(rows, "embed", texts=False)
        return given.count()

    def delete_by_path(self, collection: str, path: str) -> int:
        before = self.manifest().rows
        gone = (F.col("collection") == collection) & (F.col("path") == path)
        return before - self.replace(self.table().where(~gone), "delete").rows

    def delete_paths(self, collection: str, paths: DataFrame) -> int:
        before = self.manifest().rows
        gone = paths.select("path", F.lit(collection).alias("collection")).distinct()
        return before - self.replace(self.table().join(gone, ["collection", "path"], "left_anti"), "delete").rows

    def validate_or_record_embedder(self, model: str, dim: int) -> bool:
        """True if this call recorded the embedder; the dimension is checked before the model."""
        now = self.manifest()
        if (now.embedder_model is None) != (now.embedder_dim is None):
            raise LexivecError("embedder metadata is incomplete")
        if now.embedder_model is not None:
            if now.embedder_dim != dim:
                raise EmbedderDimMismatch(now.embedder_dim, dim)
            if now.embedder_model != model:
                raise EmbedderModelMismatch(now.embedder_model, model)
            return False
        if now.dim != dim:
            raise EmbedderDimMismatch(now.dim, dim)
        self._publish(None, "embedder", now, embedder_model=model, embedder_dim=dim)
        return True

    def compact(self, partitions: int = 8, keep: int = 1) -> Manifest:
        """One version in few, sorted files; older ones than the last ``keep`` are dropped."""
        done = self.replace(self.table().repartition(partitions, "path").sortWithinPartitions("path", "chunk_index"), "compact", texts=False)
        held = self.versions_held()
        gone, left = (list(map(self.manifest, part)) for part in (held[: -keep or None], held[len(held) - keep :] if keep else []))
        used = {x for m in left for x in (m.folder, m.lexical)}
        for m in gone:
            self.storage.delete(f"_meta/{m.version}.json")
            for folder in {m.folder, m.lexical} - used - {None, ""}:
                self.storage.delete(folder)
        return done

    def attach(self, view: str = "chunks", version: int | None = None) -> DataFrame:
        """The table as a temporary view, for SQL."""
        rows = self.table(version)
        rows.createOrReplaceTempView(view)
        return rows
