"""Exact dedup through a minimal perfect hash over historical distinct digests.

Rows with a doc_id up to a pivot (the approximate median of the ids) are the history, the others
are new. The distinct digests of the history go, in shards of bounded size, into minimal perfect
hashes: bit arrays by level, whose slots hold the full 32-byte digest, the winner's id and locator and the
group's size. They are stored, one row per shard, and can be probed again and again. Every distinct new
digest is looked up in its shard and checked byte by byte; members join the group in the slot,
nonmembers are grouped on their own. Nothing is dropped: each document comes back with its group.

Defined cases: null text counts as empty; a very long text is digested whole; an empty table gives no
rows; a null doc_id sorts last, so a group keeps a null id only if it has no other; of repeated rows (same
doc_id and text) exactly one is kept; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import ASCII_SPACE, shuffle_partitions, text_of
from lexivec.session import discard, materialise

#: Distinct digests in one shard, on average: what one task holds in memory (56 bytes each).
SHARD_DIGESTS = 200_000
#: Cells of a level for each key that is left.
LOAD = 1.5
#: Levels after which it is checked that the keys left are distinct, as they must be to be parted.
PATIENCE = 48
#: A group that has more than this share of the rows is broadcast when rows meet their groups.
HOT_SHARE = 0.001

GROUPS = "digest binary, keep_id long, keep_row long, group_size long"
INDEX = "shard int, bits binary, digests binary, keep_id array<long>, keep_row array<long>, group_size array<long>"


class MinimalPerfectHash:
    """Levels of bit arrays: a key lives at the first level where it is alone in its cell.

    Its slot is the rank of that bit among all set bits, so n keys fill slots 0..n-1.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        """``levels``: the number of cells and the bits, as unsigned 64-bit words, of each level."""
        self.levels = levels
        counts = [np.bitwise_count(bits).astype(np.int64) for _, bits in levels]
        base = np.cumsum([0, *(int(c.sum()) for c in counts)])
        #: Set bits before each word, over all levels.
        self.before = [np.cumsum(c) - c + b for c, b in zip(counts, base)]

    @classmethod
    def of(cls, words: np.ndarray) -> MinimalPerfectHash:
        """``words``: distinct keys as an (n, 4) array of unsigned 64-bit words."""
        levels: list[tuple[int, np.ndarray]] = []
        left = words
        while len(left):
            if len(levels) % PATIENCE == PATIENCE - 1 and len(np.unique(left, axis=0)) < len(left):
                raise ValueError("keys are not distinct")
            cells = max(64, int(len(left) * LOAD))
            at = cls._cell(left, len(levels), cells)
            alone = np.bincount(at, minlength=-(-cells // 64) * 64) == 1
            levels.append((cells, np.packbits(alone, bitorder="little").view(np.uint64)))
            left = left[~alone[at]]
        return cls(levels)

    @staticmethod
    def _cell(words: np.ndarray, level: int, cells: int) -> np.ndarray:
        """The cell of each key at a level: its words mixed with the level's seed."""
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
        x = (words[:, level % 4] ^ seed) + (words[:, (level + 1) % 4] << np.uint64(1 + level % 7))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(cells)).astype(np.int64)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """The only slot each key can have; -1 where no level has its cell set."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for level, ((cells, bits), before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = self._cell(words[left], level, cells)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (before[at >> 6] + below)[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *(cells for cells, _ in self.levels)], np.uint64)
        return b"".join([head.tobytes(), *(bits.tobytes() for _, bits in self.levels)])

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        words = np.frombuffer(data, np.uint64)
        levels, at = [], 1 + int(words[0])
        for cells in words[1:at].astype(np.int64).tolist():
            n = -(-cells // 64)
            levels.append((cells, words[at : at + n]))
            at += n
        return cls(levels)


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _nullable(values) -> pd.Series:
    return pd.Series(values).astype("Int64")


def _build(part: pd.DataFrame) -> pd.DataFrame:
    """One shard's row of the index."""
    words = _words(part["digest"])
    index = MinimalPerfectHash.of(words)
    order = np.argsort(index.lookup(words))
    own = part.iloc[order]
    lists = {c: [[None if pd.isna(x) else int(x) for x in own[c]]] for c in ("keep_id", "keep_row", "group_size")}
    return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "bits": [index.to_bytes()], "digests": [words[order].tobytes()], **lists})


def _probe(fresh: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    """The groups of one shard: the slots with what they gained, then the nonmembers."""
    member = np.zeros(len(fresh), bool)
    parts = []
    if len(stored):
        row = stored.iloc[0]
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        size = np.array(row["group_size"], np.int64)
        if len(fresh):
            keys = _words(fresh["digest"])
            at = MinimalPerfectHash.from_bytes(row["bits"]).lookup(keys)
            member = (at >= 0) & (held[np.maximum(at, 0)] == keys).all(axis=1)
            np.add.at(size, at[member], fresh["group_size"].to_numpy(np.int64)[member])
        raw = row["digests"]
        digest = [raw[i : i + 32] for i in range(0, len(raw), 32)]
        ids, rows = (_nullable(list(row[c])) for c in ("keep_id", "keep_row"))
        parts.append(pd.DataFrame({"digest": digest, "keep_id": ids, "keep_row": rows, "group_size": size}))
    if len(fresh):
        parts.append(fresh.loc[~member, ["digest", "keep_id", "keep_row", "group_size"]])
    out = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
    for name in ("keep_id", "keep_row", "group_size"):
        out[name] = _nullable(out[name])
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest): the digest of the normalised text, with a number for each row."""
    text = F.regexp_replace(text_of(), ASCII_SPACE, " ")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("first_row", "doc_id"), F.min("first_row")).alias("keep_row"),
        F.sum("n").alias("group_size"),
    )


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    """The groups of some rows (digest, doc_id, first_row, n), and the shard of each."""
    return _grouped(rows).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The stored index of historical rows, one row per shard. See ``digests`` for the rows."""
    return materialise(_sharded(_repeats(rows), shards).groupBy("shard").applyInPandas(_build, INDEX), "perfect-hash")


def _repeats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest", "doc_id").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))


def probe(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest of the index or the new rows: the winner and the size of its group."""
    fresh = _sharded(_repeats(rows), shards)
    both = fresh.groupBy("shard").cogroup(index.groupBy("shard"))
    return both.applyInPandas(_probe, GROUPS)


def groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row per distinct digest, stored, and the number of all rows."""
    middle, total = rows.agg(F.percentile_approx("doc_id", 0.5), F.count("*")).first()
    old = F.coalesce(F.col("doc_id") <= F.lit(middle if middle is not None else -1), F.lit(False))
    shards = max(shuffle_partitions(rows.sparkSession), -(-total // SHARD_DIGESTS))
    index = build_index(rows.where(old), shards)
    found = materialise(probe(rows.where(~old), index, shards), "groups")
    discard(index)
    return found, total


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    rows = materialise(digests(docs), "digests")
    found, total = groups(rows)
    # Fewer groups than 1 / HOT_SHARE can have that share of the rows; the others have no key that skews a join.
    is_hot = F.col("group_size") > max(1.0, total * HOT_SHARE)
    hot, cold = F.broadcast(found.where(is_hot)), found.where(~is_hot)
    joined = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest"))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
