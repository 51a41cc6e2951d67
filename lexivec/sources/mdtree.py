"""A folder of Markdown as a Spark data source.

Spark's own file source skips names that start with an underscore, follows links and goes into hidden
and dependency folders; this walk does not. The driver lists paths only; executors read the files, so
the folder must be one that they share.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexivec.schema import DEFAULT_COLLECTION, FILES, URI_SCHEME

# Folders that hold no documents.
SKIPPED = ("node_modules", "target")
FILES_PER_TASK = 256
#: In place of the hash of a file that is there but cannot be read.
UNREADABLE = ""


def canonical(root: str) -> str:
    return os.path.realpath(root, strict=True)


def excluded(name: str) -> bool:
    return name.startswith(".") or name in SKIPPED


def walk(root: str) -> Iterator[str]:
    """Paths of regular ``.md`` files below the root; links and unreadable folders are passed over."""
    if os.path.isfile(root):
        if root.endswith(".md"):
            yield root
        return
    for folder, names, files in os.walk(root, followlinks=False):
        names[:] = sorted(n for n in names if not excluded(n))
        for name in sorted(files):
            path = os.path.join(folder, name)
            if name.endswith(".md") and not excluded(name) and not os.path.islink(path) and os.path.isfile(path):
                yield path


def uri(path: str, root: str, collection: str = DEFAULT_COLLECTION) -> str:
    relative = "" if path == root else os.path.relpath(path, root)
    return f"{URI_SCHEME}://{collection}/" + relative.replace("\\", "/")


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, collection: str):
        self.root, self.collection = root, collection

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root))
        return [Paths(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    data = f.read()
                stamp = os.stat(path).st_mtime_ns
            except OSError:
                yield path, uri(path, self.root, self.collection), 0, UNREADABLE, ""
                continue
            stamp = stamp if stamp >= 0 else time.time_ns()
            yield path, uri(path, self.root, self.collection), stamp, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")


class MarkdownTree(DataSource):
    """``spark.read.format("mdtree").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "mdtree"

    def schema(self):
        return FILES

    def reader(self, schema) -> TreeReader:
        return TreeReader(canonical(self.options["path"]), self.options.get("collection", DEFAULT_COLLECTION))


def read_tree(spark: SparkSession, root: str, collection: str = DEFAULT_COLLECTION) -> DataFrame:
    """The files of a folder; fails if it doesn't exist."""
    root = canonical(root)
    spark.dataSource.register(MarkdownTree)
    return spark.read.format("mdtree").option("collection", collection).load(root)
