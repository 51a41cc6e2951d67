"""Best-fit packing by linear grouping.

Documents become token sequences and end with an end id; only those over the capacity are cut. What
packing needs of them is how many pieces have each length: at most ``capacity`` numbers, whatever the
corpus. On the driver these are packed. Large lengths are rounded up to the largest of their group,
the groups holding equally many pieces. How often to use which configuration of these few sizes is the
linear program of cutting stock, solved by generating columns: a basis of one configuration per size,
priced by a knapsack over the capacity. Its solution is rounded down; what that leaves fills sequences
best around the largest size left. Actual pieces take the places of the rounded ones; small pieces go,
longest first, where they fit best. The plan is a list of ranges: pieces of one length, by rank, to
consecutive sequences at one offset. It has some rows per length and configuration, so its size does not
grow with the corpus. Ranks are found in Spark without gathering a length's pieces in one task.

Defined cases: null and empty text give one piece with the end id; a very long text is cut into pieces
by the worker that encodes it; an empty table gives no rows; repeated rows are packed once each; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.bpe import ENCODED_BYTES, VOCABULARY, codec, vocabulary_path
from lexivec.llm.common import shuffle_partitions, slices, text_of, tidy
from lexivec.session import materialise

CAPACITY = 4096
END_ID = 1
#: (share of the capacity over which lengths are large, groups of large lengths): each is tried on the
#: counts, the plan with the fewest sequences is used. Fewer groups leave more room for small pieces.
TRIES = tuple((large, groups) for large in (1 / 4, 3 / 8, 1 / 8) for groups in (16, 32, 24))
#: Configurations that enter the basis at most; the optimum of a few dozen sizes needs far fewer.
ROUNDS = 2_000
#: Pieces ranked in one bucket, on average.
BUCKET_PIECES = 100_000

PIECES = 100_000
#: Ranges a plan may have; it has a few per distinct length, so this is far off for any input.
PLAN_ROWS = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every document, without their ids."""

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        for part in (x for whole in parts for x in slices(whole, most=ENCODED_BYTES)):
            doc, number, start, length, crc = [], [], [], [], []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.batch(part.column("text"))):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    one = ids[at : at + capacity]
                    doc.append(doc_id)
                    number.append(i)
                    start.append(at)
                    length.append(len(one))
                    crc.append(zlib.crc32(one.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        own.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(batches, PIECES)


class Plan:
    """Ranges of pieces to sequences: ``rows`` of (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: float = 1 / 4, groups: int = 64):
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.rank = dict.fromkeys(counts, 0)
        #: Runs of consecutive sequences that have so many tokens left, and those numbers in order.
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []
        big = {n: c for n, c in counts.items() if n > capacity * large and c}
        self._large(big, groups)
        for length in sorted((n for n in counts if n not in big), reverse=True):
            self._small(length, counts[length])

    def _put(self, length: int, count: int, first: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count

    def _leave(self, left: int, first: int, count: int) -> None:
        if left > 0 and count:
            if left not in self.open:
                self.open[left] = []
                bisect.insort(self.free, left)
            self.open[left].append((first, count))

    def _new(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def _large(self, counts: dict[int, int], groups: int) -> None:
        sizes, members = linear_groups(counts, groups)
        left = [sum(c for _, c in m) for m in members]
        for config, times in configurations(sizes, left, self.capacity):
            runs = [(self._new(times), times, 0)]
            for group, copies in config:
                for _ in range(copies):
                    runs = self._substitute(runs, members[group])
            for first, count, used in runs:
                self._leave(self.capacity - used, first, count)

    def _substitute(self, runs: list[tuple[int, int, int]], members: list[list[int]]) -> list[tuple[int, int, int]]:
        """One actual piece of a group, longest first, into every sequence of the runs."""
        out = []
        for first, count, used in runs:
            while count:
                length, has = members[0]
                n = min(count, has)
                self._put(length, n, first, used)
                out.append((first, n, used + length))
                first, count = first + n, count - n
                members[0][1] -= n
                if not members[0][1]:
                    members.pop(0)
        return out

    def _small(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.free, length)
            if at == len(self.free):
                need = -(-count // (self.capacity // length))
                self._leave(self.capacity, self._new(need), need)
                continue
            left = self.free[at]
            first, has = self.open[left].pop()
            if not self.open[left]:
                del self.open[left]
                self.free.pop(at)
            n = min(count, has)
            self._put(length, n, first, self.capacity - left)
            self._leave(left - length, first, n)
            self._leave(left, first + n, has - n)
            count -= n

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The rows ordered by (length, first rank), as columns."""
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(np.ascontiguousarray(table[:, i]) for i in range(5))


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences; trying stops at the bound that total length sets."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for large, groups in TRIES:
        plan = Plan(counts, capacity, large, groups)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def linear_groups(counts: dict[int, int], groups: int) -> tuple[list[int], list[list[list[int]]]]:
    """Rounded sizes, largest first, and each group's [length, count] runs, longest first."""
    total = sum(counts.values())
    share = max(1, -(-total // groups)) if total else 1
    sizes: list[int] = []
    members: list[list[list[int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        count = counts[length]
        while count:
            if not room or (sizes and sizes[-1] != length and not members[-1]):
                if sizes and sizes[-1] == length:
                    room = share
                else:
                    sizes.append(length)
                    members.append([])
                    room = share
            n = min(room, count)
            if members[-1] and members[-1][-1][0] == length:
                members[-1][-1][1] += n
            else:
                members[-1].append([length, n])
            room -= n
            count -= n
    return sizes, members


def configurations(sizes: list[int], left: list[int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """([(group, copies)], times) until nothing is left: the program's solution rounded down, then best filling."""
    left = list(left)
    for config, times in relaxed(sizes, left, capacity):
        times = min(times, *(left[g] // n for g, n in config))
        if times:
            for g, n in config:
                left[g] -= n * times
            yield config, times
    for seed in range(len(sizes)):
        while left[seed]:
            config = dict([(seed, 1)])
            room = capacity - sizes[seed]
            spare = list(left)
            spare[seed] -= 1
            for group in best_fill(sizes, spare, room, seed):
                config[group] = config.get(group, 0) + 1
            times = min(left[g] // n for g, n in config.items())
            for g, n in config.items():
                left[g] -= n * times
            yield sorted(config.items()), times


def relaxed(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations of the cutting-stock program's fractional optimum, each as often as rounded down."""
    n = len(sizes)
    if not n:
        return []
    basis = np.diag([float(capacity // size) for size in sizes])
    for _ in range(ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(n))
        column = knapsack(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-9:
            break
        use = np.linalg.solve(basis, np.array(counts, float))
        step = np.linalg.solve(basis, column.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, np.maximum(use, 0) / step, np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = column
    use = np.floor(np.linalg.solve(basis, np.array(counts, float)) + 1e-9).astype(np.int64)
    order = np.argsort(-(basis.T @ np.array(sizes)), kind="stable")
    return [([(g, int(basis[g, i])) for g in range(n) if basis[g, i]], int(use[i])) for i in order if use[i] > 0]


def knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the sequence of the greatest worth."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int32)
    for g, size in enumerate(sizes):
        if worth[g] <= 0:
            continue
        base = best.copy()
        for copies in range(1, capacity // size + 1):
            with_it = base[: -size * copies] + copies * worth[g]
            better = with_it > best[size * copies :] + 1e-12
            best[size * copies :][better] = with_it[better]
            took[g, size * copies :][better] = copies
    out = np.zeros(len(sizes), np.int64)
    room = int(np.argmax(best))
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = took[g, room]
        room -= int(out[g]) * sizes[g]
    return out


def best_fill(sizes: list[int], left: list[int], room: int, first: int) -> list[int]:
    """Groups from ``first`` on, each as often as is left, whose sizes fill the room best."""
    if first >= len(sizes) or room < sizes[-1]:
        return []
    by = np.full(room + 1, -1, np.int64)
    by[0] = len(sizes)
    for group in range(first, len(sizes)):
        size = sizes[group]
        if size > room:
            continue
        for _ in range(min(left[group], room // size)):
            new = (by[:-size] >= 0) & (by[size:] < 0)
            if not new.any():
                break
            by[size:][new] = group
        if by[room] >= 0:
            break
    at = int(np.flatnonzero(by >= 0)[-1])
    out = []
    while at:
        out.append(int(by[at]))
        at -= sizes[out[-1]]
    return out


def ranked(found: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The pieces with their rank among those of the same length, and the counts of lengths.

    Pieces are spread over buckets by hash, ranked within bucket and length, and moved up by what
    the buckets before hold of that length.
    """
    total = found.count()
    buckets = max(shuffle_partitions(found.sparkSession), -(-total // BUCKET_PIECES))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = materialise(dealt.groupBy("bucket", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    rows = (
        dealt.withColumn("own", F.row_number().over(within) - 1)
        .join(base, ["bucket", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))
    )
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    return rows, {r["length"]: r["n"] for r in histogram}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece with its sequence and offset."""
    found = materialise(pieces(docs, capacity, vocabulary), "pieces")
    rows, counts = ranked(found)
    plan = docs.sparkSession.sparkContext.broadcast(best_plan(counts, capacity).arrays())

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, _, sequences, offsets = plan.value
        keys = lengths << 40 | ranks
        for part in parts:
            length, rank = part.column("length").to_numpy(), part.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            sequence = sequences[at] + rank - ranks[at]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:5], pa.array(sequence, pa.int64()), pa.array(offsets[at], pa.int64())],
                [*part.schema.names[:5], "sequence_id", "offset"],
            )

    return rows.mapInArrow(place, PIECES + ", sequence_id long, offset long")
