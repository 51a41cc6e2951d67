"""Collections and their context notes, kept as TOML."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.schema import LexivecError


@dataclass
class Collection:
    name: str
    root: str
    contexts: dict[str, str] = field(default_factory=dict)


@dataclass
class Registry:
    collections: list[Collection] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Registry:
        """A missing file is an empty registry; a bad one is an error that names it."""
        if not os.path.exists(path):
            return cls()
        try:
            with open(path, "rb") as f:
                return cls([Collection(**c) for c in tomllib.load(f).get("collections", [])])
        except (tomllib.TOMLDecodeError, TypeError) as error:
            raise LexivecError(f"cannot read registry {path}: {error}") from error

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        parts = []
        for c in self.collections:
            parts.append(f"[[collections]]\nname = {json.dumps(c.name)}\nroot = {json.dumps(c.root)}\n")
            if c.contexts:
                rows = "\n".join(f"{json.dumps(k)} = {json.dumps(v)}" for k, v in sorted(c.contexts.items()))
                parts.append(f"[collections.contexts]\n{rows}\n")
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(parts))

    def add(self, name: str, root: str) -> None:
        if any(c.name == name for c in self.collections):
            raise LexivecError(f"collection {name!r} exists already")
        self.collections.append(Collection(name, root))

    def remove(self, name: str) -> None:
        left = [c for c in self.collections if c.name != name]
        if len(left) == len(self.collections):
            raise LexivecError(f"no collection {name!r}")
        self.collections = left

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.root, c.contexts) for c in self.collections]
        return spark.createDataFrame(rows, "name string, root string, contexts map<string,string>")


def with_context(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows (with uri) and the note of the longest prefix (prefix, note) that their uri starts with.

    Prefixes end at a slash or at the whole uri: each uri meets its own few prefixes by equality.
    """
    parts = F.split("uri", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    keyed = rows.select("uri").distinct().select("uri", F.explode(prefixes).alias("prefix"))
    trimmed = contexts.select(F.rtrim(F.col("prefix"), F.lit("/")).alias("prefix"), "note")
    found = keyed.join(trimmed, "prefix").groupBy("uri").agg(F.max_by("note", F.length("prefix")).alias("context"))
    return rows.join(found, "uri", "left")
