"""N-gram Jaccard join by universe partition, exact, for one threshold.

Sets of k-word shingles are joined at Jaccard >= num/den. Equal sets are one class first; only the
classes are joined. Two sets of sizes r and s that link differ in at most H = (r+s)(den-num)/(den+num)
tokens. Sizes are cut into bands; the universe is hashed into m segments per band. H differences can
spoil at most H segments, so sets that link agree on the rest. Each segment's subset is a signature;
a segment may also be indexed with its one-deletion neighbourhood and then stands one difference. The
allocation per band, how many segments and how many with neighbourhoods, minimises rows and expected
collisions given how many documents the band holds. Segments that hold nothing but tokens of many
documents (or nothing at all) say little: the allocation leaves c segments to spare, and a set doesn't
index its c commonest segments, in an order by what they hold. Agreeing segments have the same place in
that order, so two sets together leave out at most c of those on which they agree, and none is missed.

Sets with a common signature are compared by sketches whose bits never differ more than the sets do;
what is left makes small clusters, in which shared tokens are counted. No bucket or cluster must fit
one task: see ``within_groups``.

Defined cases: null text, and text without words, has an empty set and links with nothing; fewer than
k words are one shingle; a very long text is taken whole; a null doc_id has component null and links with
nothing (in the stage: see there); rows with the same doc_id count as linked; an empty table gives no rows;
columns other than doc_id and text are ignored (by the stage: passed through).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import shuffle_partitions, slices, text_of, tidy
from lexivec.llm.graph import connected_components
from lexivec.session import discard, materialise

#: A token is frequent if at least this share of the documents has it; at most (mean set size)/share
#: tokens can be, so their list has a bound that doesn't grow with the corpus.
FREQUENT = 0.0002
#: Tokens that a task counts together to find the frequent ones.
COUNTED = 1_000_000
#: Members and tokens of a group that one task takes; larger groups are dealt in parts.
GROUP_ROWS = 256
GROUP_TOKENS = 2_000_000
#: Members of a large group, on average, that all its others meet first.
CENTRES = 24
#: Pairs that a task looks at in one step.
PAIRS = 500_000
#: Rows of ids that are broadcast at most (about 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SIGNATURES_PER_TASK = 1_000_000
#: Where the numbers of rows without a doc_id begin, and the column that has them.
NO_ID = 2**62
OWN = "__lx_own"

#: What tells sets apart, and what a task of ``within_groups`` takes together.
SET = ["n_shingles", "k1", "k2"]
KEYS = ["group", "i", "j"]

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = texts.cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))
    codes = coded.indices.to_numpy()
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    for a, b in zip(offsets, offsets[1:]):
        own = codes[a:b]
        h = hashes[own[real[own]]]
        if not len(h):
            yield np.empty(0, np.uint64)
            continue
        n = min(k, len(h))
        rolled = h[: len(h) - n + 1] + U(n)
        for j in range(1, n):
            rolled = mix(rolled) + h[j : len(h) - n + 1 + j]
        rolled = np.sort(mix(rolled))
        yield rolled[np.concatenate([[True], rolled[1:] != rolled[:-1]])]


@dataclass(frozen=True)
class Band:
    """How sets of sizes ``low`` to ``high`` - 1, and smaller ones that may link with them, are cut."""

    number: int
    low: int
    high: int
    segments: int
    deletions: int
    spare: int


@dataclass(frozen=True)
class Join:
    """The parameters of one join and the cuts that its statistics led to."""

    k: int
    num: int
    den: int
    bands: tuple[Band, ...]
    frequent: np.ndarray
    often: np.ndarray

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How many documents have each token, as far as it is frequent; else 0."""
        out = np.zeros(len(tokens), np.int64)
        held = among(tokens, self.frequent)
        out[held] = self.often[np.searchsorted(self.frequent, tokens[held])]
        return out

    def differences(self, total: int) -> int:
        """The most tokens in which sets of so many tokens together may differ and still link."""
        return total * (self.den - self.num) // (self.den + self.num)


def band_edges(num: int, den: int, top: int = 2**31) -> list[int]:
    """Lower ends of the bands, each about (den/num)^2 times the one before."""
    edges = [1]
    while edges[-1] < top:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * (den / num) ** 2)))
    return edges


def allocate(number: int, low: int, high: int, documents: int, num: int, den: int) -> Band:
    """The cheapest cut of a band: signatures per set plus collisions expected among its documents.

    A segment is taken to collide by chance if a set has none (with a neighbourhood: at most one) of
    its own tokens there, and the other set shares the rest, as a ``FREQUENT`` share of them may.
    """
    most = 2 * high * (den - num) // (den + num)
    if most < 1:
        return Band(number, low, high, 0, 0, 0)
    size = (low + high) / 2
    best, cost = None, math.inf
    for share in (0.0, 0.25, 0.5, 1.0):
        spare = 0
        for _ in range(4):
            units = most + 1 + spare
            segments = max(1, math.ceil(units / (1 + share)))
            bare = segments * (1 - share) * math.exp(-0.5 * low / segments)
            spare = math.ceil(bare + 3 * math.sqrt(bare) + 0.02 * most) if share < 1 else 0
        units = most + 1 + spare
        segments = max(1, math.ceil(units / (1 + share)))
        deletions = units - segments
        x = 0.8 * low / segments
        chance = (segments - deletions) * math.exp(-2 * x) + deletions * (math.exp(-x) * (1 + x)) ** 2
        # With a token or none, a segment's neighbourhood is that of any other such set.
        y = low / segments
        empty = deletions * (math.exp(-y) * (1 + y)) ** 2
        total = (segments - deletions - spare) + deletions * (1 + size / segments) + documents * (FREQUENT * chance + empty)
        if total < cost:
            best, cost = Band(number, low, high, segments, deletions, spare), total
    return best


def among(tokens: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which tokens are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(tokens), bool)
    return ordered[np.minimum(np.searchsorted(ordered, tokens), len(ordered) - 1)] == tokens


def signatures(tokens: np.ndarray, join: Join) -> np.ndarray:
    """The signatures of one set in its band and, where it may link upwards, in the next."""
    size = len(tokens)
    out = []
    often = join.counts(tokens)
    largest = size * join.den // join.num
    weight = mix(tokens ^ U(0xA0761D6478BD642F))
    for band in join.bands:
        if size >= band.high or largest < band.low or not band.segments:
            continue
        partner = min(largest, band.high - 1)
        units = join.differences(size + partner) + 1 + band.spare
        # The first ``deletions`` segments stand for two units each.
        used = min(band.segments, (units + 1) // 2 if units <= 2 * band.deletions else units - band.deletions)
        seed = U((0x9E3779B97F4A7C15 * (2 * band.number + 1)) % 2**64)
        segment = (mix(tokens ^ seed) % U(band.segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, w = segment[order], weight[order]
        counts = np.bincount(segment, minlength=band.segments)
        sums = np.zeros(band.segments, np.uint64)
        full = counts > 0
        sums[full] = np.add.reduceat(w, (np.cumsum(counts) - counts)[full])
        # The commonest segments are left out: by the rarest token of each, then by what they hold.
        rarest = np.full(band.segments, np.iinfo(np.int64).max)
        rarest[full] = np.minimum.reduceat(often[order], (np.cumsum(counts) - counts)[full])
        own = np.arange(band.deletions, used)
        common = own[np.lexsort((sums[own], -rarest[own]))[: band.spare]]
        keep = np.arange(band.segments) < used
        keep[common] = False
        base = mix(np.arange(band.segments, dtype=np.uint64) * U(0xE7037ED1A0B428DB) + seed)
        out.append(mix(sums[keep] + base[keep]))
        near = segment < min(band.deletions, used)
        if near.any():
            at = segment[near]
            out.append(mix(sums[at] - w[near] + base[at]))
    found = np.concatenate(out) if out else np.empty(0, np.uint64)
    return np.unique(found).view(np.int64)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def statistics(docs: DataFrame, k: int, num: int, den: int) -> Join:
    """The cuts for all documents: counts per band and the frequent tokens, summed over parts.

    A part of ``COUNTED`` tokens reports those that a ``FREQUENT`` share of its documents has, three at
    least; what is frequent overall is so in some part. Which tokens count as frequent changes the
    cost, never the result.
    """
    edges = band_edges(num, den)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        at = np.bincount(np.searchsorted(edges, [len(s) for s in sets], side="right") - 1, minlength=1)
        band = np.flatnonzero(at)
        tokens, total = np.concatenate(sets), len(sets)
        sets.clear()
        tokens.sort()
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.append(start, len(tokens)))
        often = n >= max(3, total * FREQUENT)
        kind = np.repeat([0, 1], [len(band), often.sum()])
        key = np.concatenate([band, tokens[start[often]].view(np.int64)])
        count = np.concatenate([at[band], n[often]])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kind, key, count)], ["kind", "key", "n"])

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        held = 0
        for part in (x for whole in parts for x in slices(whole)):
            sets += [s for s in shingle_sets(part.column("text"), k) if len(s)]
            held = sum(map(len, sets))
            if held >= COUNTED:
                yield counted(sets)
                held = 0
        if held:
            yield counted(sets)

    found = _own(docs).mapInArrow(batches, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = materialise(found, "statistics")
    counts = {r["key"]: r["n"] for r in found.where("kind = 0").collect()}
    total = sum(counts.values())
    often = found.where((F.col("kind") == 1) & (F.col("n") >= max(8.0, total * FREQUENT))).select("key", "n").toArrow()
    frequent = often.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    bands = tuple(allocate(i, a, b, counts.get(i, 0), num, den) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return Join(k, num, den, bands, frequent[order], often.column("n").to_numpy().astype(np.int64)[order])


def signed(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sketch, signatures) of every document; k1 and k2 identify the set."""
    sent = docs.sparkSession.sparkContext.broadcast(join)

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in (x for whole in parts for x in slices(whole)):
            n, k1, k2, drawn, sigs = [], [], [], [], []
            for tokens in shingle_sets(part.column("text"), own.k):
                n.append(len(tokens))
                key = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                k1.append(key[0])
                k2.append(key[1])
                drawn.append(sketch(tokens, sketch_bits(len(tokens), own.num, own.den)))
                sigs.append(signatures(tokens, own))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(list(map(len, sigs)))]).astype(np.int32)),
                pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64)),
            )
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            columns += [pa.array(drawn, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *SET, "sketch", "signatures"])

    return _own(docs).mapInArrow(batches, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary, signatures array<long>")


BUCKETS = "bucket long, doc_id long"


@tidy
def _buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a signature as (bucket, doc_id) rows, from sorted rows; equal runs come once.

    A run within the partition is named by what is in it. The first and the last may go on in other
    partitions: they are named by their signature, so that their parts meet again.
    """
    columns = [(p.column("signature").to_numpy(), p.column("doc_id").to_numpy()) for p in parts if len(p)]
    if not columns:
        return
    sig, doc = (np.concatenate(c) for c in zip(*columns))
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    inner = np.ones(len(start), bool)
    inner[[0, -1]] = False
    name = mix(np.add.reduceat(mix(doc.view(np.uint64)), start) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    name[~inner] = mix(sig[start[~inner]].view(np.uint64) ^ U(0xD1B54A32D192ED03))
    _, first = np.unique(name, return_index=True)
    once = np.zeros(len(start), bool)
    once[first] = True
    take = np.repeat((inner & once & (size > 1)) | ~inner, size)
    bucket = np.repeat(name.view(np.int64), size)[take]
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(doc[take])], ["bucket", "doc_id"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def runs(found: DataFrame) -> DataFrame:
    """(bucket, doc_id), stored: the rows of ``found`` (doc_id, signatures) that share a signature.

    Ranges of (signature, doc_id) also split a signature that very many sets have.
    """
    total = found.agg(F.coalesce(F.sum(F.size("signatures")), F.lit(0))).first()[0]
    tasks = max(shuffle_partitions(found.sparkSession), -(-total // SIGNATURES_PER_TASK))
    rows = found.where("doc_id IS NOT NULL").select("doc_id", F.explode("signatures").alias("signature"))
    dealt = rows.repartitionByRange(tasks, "signature", "doc_id").sortWithinPartitions("signature", "doc_id")
    return materialise(dealt.mapInArrow(_buckets, BUCKETS), "runs")


def candidate_buckets(docs: DataFrame, found: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(bucket, doc_id, n_shingles), stored: classes, by the doc_id that stands for each, that may link.

    ``found`` is what ``signed`` gives. What is in a bucket too large for a task (it holds copies, or a
    passage that many sets have) is dealt anew by the rarest tokens of its sets: of sets that link, so
    many of the rarest as one may lack, and one more, have a token in common.
    """
    homes = found.join(classes, SET).select("doc_id", "rep", "n_shingles").distinct()

    def named(met: DataFrame) -> DataFrame:
        rows = met.join(homes, "doc_id").groupBy("bucket", F.col("rep").alias("doc_id"))
        return rows.agg(F.first("n_shingles").alias("n_shingles"))

    met = runs(found)
    first = materialise(named(met), "buckets")
    discard(met)
    large = materialise(first.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS), "large")
    if large.isEmpty():
        return first
    wanted = materialise(first.join(large, "bucket", "left_semi").select("doc_id").distinct(), "wanted")
    rare = materialise(rarest(docs, wanted, join), "rare")
    met = runs(rare)
    out = materialise(first.join(large, "bucket", "left_anti").unionByName(named(met)), "buckets")
    discard(first, large, wanted, rare, met)
    return out


def rarest(docs: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(doc_id, signatures): so many of each set's rarest tokens that sets which link share one.

    Frequent tokens come last, by their counts; the others are ordered by hash.
    """
    wanted = bounded(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(join)

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in (x for whole in parts for x in slices(whole)):
            lists = []
            for tokens in shingle_sets(part.column("text"), own.k):
                first = np.lexsort((mix(tokens ^ U(0x8EBC6AF09C88C6E3)), own.counts(tokens)))
                most = len(tokens) - -(-own.num * len(tokens) // own.den) + 1
                lists.append(tokens[first[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "signatures"])

    return _own(docs).join(wanted, "doc_id").mapInArrow(batches, "doc_id long, signatures array<long>")


def complete_runs(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that hold whole runs of equal keys, and where each run starts."""
    held: list[pa.Table] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for part in parts:
        if not len(part):
            continue
        table = pa.Table.from_batches([part])
        starts = bounds(table)
        last = [table.column(k)[0].as_py() for k in keys]
        if held and [held[-1].column(k)[-1].as_py() for k in keys] == last and len(starts) == 1:
            held.append(table)
            continue
        whole = pa.concat_tables([*held, table.slice(0, int(starts[-1]))])
        held = [table.slice(int(starts[-1]))]
        if len(whole):
            yield whole, bounds(whole)
    if held:
        whole = pa.concat_tables(held)
        yield whole, bounds(whole)


def within_groups(members: DataFrame, edges_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): edges that span the components which ``edges_of`` finds within groups.

    ``members`` (group, doc_id, n_shingles) is a stored table. ``edges_of`` gets rows (group, i, j, side,
    doc_id), works within equal (group, i, j) and, where both sides are there, on pairs across them only.
    A group that is too large for a task is dealt in parts. All of its members meet some centres, drawn by
    hash. What doesn't end in the group's main component with them, the rest, then meets everything in
    the group, part by part: as much work as there are pairs with the rest, and none is left out.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("has"), F.sum("n_shingles").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("has") / GROUP_ROWS, F.col("tokens") / GROUP_TOKENS)).cast("int")
    large = materialise(sizes.where((parts > 1) & (F.col("has") > 1)).select("group", "has", parts.alias("parts")), "large")
    tagged = members.join(large, "group", "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")
    row = lambda i, j, side: ["group", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "doc_id"]
    every = tagged.select(*row(part, F.lit(0), 0))
    if large.isEmpty():
        return materialise(edges_of(every), "edges")
    held = members.join(large, "group")
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "group"), F.col("has")) < CENTRES
    spots = held.where(drawn).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    edges = materialise(edges_of(every.unionByName(spots.select(*row(F.col("at"), F.lit(0), 1)))), "edges")
    component = connected_components(edges)
    named = held.join(component, held["doc_id"] == component["node"], "left").select(
        *[held[c] for c in held.columns], F.coalesce("component", "doc_id").alias("component")
    )
    main = named.groupBy("group", "component").agg(F.count("*").alias("n")).groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = materialise(named.join(main, "group").where("component <> main").select("group", "doc_id", "n_shingles"), "rest")
    if rest.isEmpty():
        return edges
    left = rest.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / GROUP_ROWS, F.sum("n_shingles") / GROUP_TOKENS)).cast("int").alias("blocks"))
    wide = F.greatest(F.ceil(F.col("parts") / 8), F.lit(1)).cast("int")
    all_of = held.join(left, "group").withColumn("wide", wide)
    own = all_of.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.select(*row(F.col("i"), F.pmod(F.xxhash64("doc_id"), F.col("wide")).cast("int"), 0))
    met = rest.join(left, "group").join(large.withColumn("wide", wide), "group").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    met = met.select(*row(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.col("j"), 1))
    more = materialise(edges_of(own.unionByName(met)), "edges")
    return edges.unionByName(more)


def run_pairs(starts: np.ndarray, total: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i before j, of the pairs within runs, about ``most`` at a time."""
    at = np.arange(total)
    before = at - np.repeat(starts, np.diff(np.append(starts, total)))
    ends = np.cumsum(before)
    low = 0
    while low < total:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
        n = before[low:high]
        j = np.repeat(at[low:high], n)
        nth = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        if len(j):
            yield j - 1 - nth, j
        low = high


def close_pairs(table: pa.Table, starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): edges that span what may link within runs, by sizes and sketches.

    No pair that links is missed: linked sets differ in at most so many tokens, and so many bits.
    """
    ids, size, side = (table.column(c).to_numpy() for c in ("doc_id", "n_shingles", "side"))
    flat = pa.concat_arrays(table.column("sketch").cast(pa.large_binary()).chunks)
    words = pc.binary_length(flat).to_numpy() // 8
    data = np.frombuffer(flat.buffers()[2], np.uint64)
    begin = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset :][: len(flat)] // 8
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Every sketch of that width or more, folded to it, and the row of each in that matrix."""
        if width not in folded:
            where, rows = np.full(len(ids), -1, np.int64), []
            done = 0
            for w in np.unique(words[words >= width]):
                own = np.flatnonzero(words == w)
                block = data[(begin[own][:, None] + np.arange(w)).ravel()].reshape(len(own), w // width, width)
                rows.append(np.bitwise_xor.reduce(block, axis=1))
                where[own] = done + np.arange(len(own))
                done += len(own)
            folded[width] = np.concatenate(rows), where
        return folded[width]

    both = np.maximum.reduceat(side, starts) != np.minimum.reduceat(side, starts)
    cross = np.repeat(both, np.diff(np.append(starts, len(ids))))
    label = np.arange(len(ids))
    for i, j in run_pairs(starts, len(ids), PAIRS):
        fit = (num * np.maximum(size[i], size[j]) <= den * np.minimum(size[i], size[j])) & (ids[i] != ids[j])
        fit &= ~cross[j] | (side[i] != side[j])
        i, j = i[fit], j[fit]
        width = np.minimum(words[i], words[j])
        for w in np.unique(width):
            matrix, where = at_width(int(w))
            own = width == w
            x, y = i[own], j[own]
            for low in range(0, len(x), max(1, PAIRS // int(w))):
                p, q = x[low : low + max(1, PAIRS // int(w))], y[low : low + max(1, PAIRS // int(w))]
                apart = np.bitwise_count(matrix[where[p]] ^ matrix[where[q]]).sum(axis=1, dtype=np.int64)
                near = apart <= (size[p] + size[q]) * (den - num) // (den + num)
                label = merged(label, p[near], q[near])
    own = np.flatnonzero(label != np.arange(len(ids)))
    pairs = np.unique(np.stack([ids[label[own]], ids[own]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the pairs (i, j) are linked: the least position that each reaches."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def sketch_edges(found: DataFrame, classes: DataFrame, join: Join) -> Callable[[DataFrame], DataFrame]:
    """For ``within_groups``: what may link by the sketches that ``signed`` made."""
    one = found.join(classes, SET).where("doc_id = rep").select("doc_id", "n_shingles", "sketch").distinct()
    num, den = join.num, join.den

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete_runs(parts, KEYS):
            yield _edges(*close_pairs(table, starts, num, den))

    def edges_of(rows: DataFrame) -> DataFrame:
        full = rows.join(one, "doc_id").select(*KEYS, "side", "doc_id", "n_shingles", "sketch")
        # By doc_id, too: the groups of the same copies then give the same edges, to the least.
        return full.repartition(*KEYS).sortWithinPartitions(*KEYS, "doc_id").mapInArrow(batches, "a long, b long")

    return edges_of


class Forest:
    """Union-find over positions; ``root`` is always up to date."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Parity bits of a set: each token flips the bit that it hashes to.

    A token that only one of two sets has flips one bit of their difference, so the number of bits
    that differ is never more than the number of tokens that do. Half of the bits laid over the other
    half give the sketch of half the width.
    """
    odd = np.bincount((mix(tokens) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sketch_bits(size: int, num: int, den: int) -> int:
    """A width that tells apart sets of about this size: over four times what linked ones may differ in."""
    most = (size + size * den // num) * (den - num) // (den + num)
    return 1 << min(max((4 * most).bit_length(), 7), 14)


def linked(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> np.ndarray:
    """Component numbers of sets under the exact threshold; with two sides, only pairs across count.

    Sets are ordered by size; each in turn meets the run of sizes it may link with. Those in its
    component already are passed over, those whose sketches differ in more bits than linked sets may
    differ in tokens cannot link, and of the rest the shared tokens are counted.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    ordered = [sets[i] for i in order]
    _, local = np.unique(np.concatenate(ordered), return_inverse=True)
    bound = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(local.max() + 1, np.int32)
    forest = Forest(len(sets))
    cross = len(np.unique(side)) > 1
    bits = sketch_bits(int(np.quantile(size, 0.75)), num, den)
    flags = np.frombuffer(b"".join(sketch(s, bits) for s in ordered), np.uint64).reshape(len(sets), -1)
    for i in range(len(sets)):
        stop = int(np.searchsorted(size, size[i] * den // num, side="right"))
        there = np.arange(i + 1, stop)
        there = there[forest.root[there] != forest.root[i]]
        if cross:
            there = there[side[there] != side[i]]
        if not len(there):
            continue
        apart = np.bitwise_count(flags[there] ^ flags[i]).sum(axis=1, dtype=np.int64)
        there = there[apart <= (size[i] + size[there]) * (den - num) // (den + num)]
        if not len(there):
            continue
        mine = local[bound[i] : bound[i + 1]]
        mark[mine] = 1
        theirs = np.concatenate([local[bound[j] : bound[j + 1]] for j in there])
        shared = np.add.reduceat(mark[theirs], np.cumsum(size[there]) - size[there])
        mark[mine] = 0
        hit = there[den * shared.astype(np.int64) >= num * (size[i] + size[there] - shared)]
        if len(hit):
            forest.union(i, hit)
    out = np.empty(len(sets), np.int64)
    out[order] = forest.root
    return out


def exact_edges(docs: DataFrame, join: Join, few: bool) -> Callable[[DataFrame], DataFrame]:
    """For ``within_groups``: the exact links, from the texts. ``few``: the rows may be broadcast."""
    k, num, den = join.k, join.num, join.den

    def group_edges(ids: np.ndarray, texts: pa.Array, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sets = list(shingle_sets(texts, k))
        full = [x for x in range(len(sets)) if len(sets[x])]
        if len(full) < 2:
            return ids[:0], ids[:0]
        own = ids[full]
        root = linked([sets[x] for x in full], side[full], num, den)
        least = np.full(len(full), np.iinfo(np.int64).max)
        np.minimum.at(least, root, own)
        return least[root], own

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in complete_runs((x for whole in parts for x in slices(whole)), KEYS):
            ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
            texts = pa.concat_arrays(table.column("text").cast(pa.large_string()).chunks)
            for low, high in zip(starts, np.append(starts[1:], len(ids))):
                a, b = group_edges(ids[low:high], texts.slice(low, high - low), side[low:high])
                yield _edges(a[a != b], b[a != b])

    def edges_of(rows: DataFrame) -> DataFrame:
        wanted = F.broadcast(rows) if few else rows
        full = _own(docs).join(wanted, "doc_id").select(*KEYS, "side", "doc_id", "text")
        return full.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(batches, "a long, b long")

    return edges_of


def class_links(docs: DataFrame, found: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(a, b): exact links that span every component of classes.

    Sets that share a signature and may link by their sketches make clusters, in which texts decide.
    """
    buckets = candidate_buckets(docs, found, classes, join)
    near = within_groups(buckets.withColumnRenamed("bucket", "group"), sketch_edges(found, classes, join))
    clusters = connected_components(near)
    size = classes.groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    members = clusters.join(size, "node").select(F.col("component").alias("group"), F.col("node").alias("doc_id"), "n_shingles")
    members = materialise(members, "members")
    discard(buckets)
    return within_groups(members, exact_edges(docs, join, members.count() <= BROADCAST_ROWS))


def join_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that each document reaches by links."""
    join = statistics(docs, k, num, den)
    found = materialise(signed(docs, join), "signed")
    classes = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    classes = materialise(classes, "classes")
    links = class_links(docs, found, classes, join)
    # A doc_id that stands in several classes links them: its copies are one document.
    homes = found.join(classes, SET).groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all"))
    several = homes.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    components = connected_components(links.unionByName(several))
    named = classes.join(components, classes["rep"] == components["node"], "left").select(
        *SET, "rep", "top", F.coalesce("component", "rep").alias("component_id")
    )
    moved = named.where("top <> rep OR component_id <> rep").select(*SET, "component_id")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    out = found.select("doc_id", *SET).join(moved, SET, "left")
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one_stage(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group: the rows without those that link, directly or over others, with a smaller doc_id.

    A null doc_id counts as one above all others that follows from the text. Of the rows of one doc_id, one
    stays: that of the least hash. Rows with an empty set all stay.
    """
    columns = docs.columns
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text_of()), F.lit(2**61)))
    marked = docs.withColumn(OWN, own)
    found = materialise(join_components(marked.select(F.col(OWN).alias("doc_id"), "text"), k, num, den), "components")
    gone = bounded(materialise(found.where("component_id <> doc_id").select(F.col("doc_id").alias(OWN)).distinct(), "gone"))
    twice = found.where("component_id = doc_id AND n_shingles > 0").groupBy(F.col("doc_id").alias(OWN)).agg(F.count("*").alias("n"))
    twice = materialise(twice.where("n > 1").select(OWN), "twice")
    kept = marked.join(gone, OWN, "left_anti")
    if twice.isEmpty():
        return kept.select(*columns)
    once = kept.join(bounded(twice), OWN, "left_anti").select(*columns)
    rows = kept.join(bounded(twice), OWN, "left_semi").select(OWN, F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("order"))
    return once.unionByName(rows.groupBy(OWN).agg(F.min_by("row", "order").alias("row")).select("row.*"))


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
