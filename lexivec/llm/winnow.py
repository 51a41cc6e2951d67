"""Document fingerprints by winnowing, in DataFrame functions only.

Words are runs of anything but ASCII white space. Every k words hash to one 32-bit value; in each
window of ``WINDOW`` consecutive k-grams the smallest hash is chosen, the rightmost of equals. The
chosen (hash, position) pairs are the fingerprint, so any passage of ``K + WINDOW - 1`` words that
two texts share gives both the same hash, and the position says where. A text shorter than k words
is one k-gram, one shorter than a window of k-grams is one window.

Documents meet their next in ranges of the ids that hold about equally many rows; an id that very many
rows have is cut by the hashes of their texts, and copies of one text anywhere. Texts travel once.

Defined cases: null text counts as empty; a text without words has an empty fingerprint, alike (1.0)
only to another empty one; a very long text is taken whole; documents follow each other by descending
doc_id, null ids last, equal ids by text hash, copies in any order; after the last comes the first, so a
single document follows itself; an empty table gives no rows; columns other than ``doc_id`` and ``text``
are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import ASCII_SPACE, shuffle_partitions, text_of

K = 5
WINDOW = 6
#: A chosen k-gram is one long: the hash above 31 bits of (last position - position), so the least
#: long of a window is the least hash and, among equals, the rightmost.
LAST = 2**31 - 1
#: Characters of text a bucket of neighbouring documents holds on average.
BUCKET_CHARS = 32_000_000
#: Cuts between buckets that are found by quantiles; between them buckets share the keys evenly.
COARSE = 128
NO_ID = -(2**63)
#: Bits at the end of a text's hash that tell its copies apart.
COPY_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chosen(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The fingerprint of a text as an array of longs by position."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.transform(F.split(trimmed, ASCII_SPACE), lambda w: F.xxhash64(w))

    def packed(h: Column) -> Column:
        grams = F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0)))
        return F.transform(
            grams,
            lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(h, i + 1, k)), 32), 31).bitwiseOR(
                F.lit(LAST).cast("long") - i
            ),
        )

    def minima(g: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(g, i, window))))

    whole = let(let(words, packed), minima)
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(whole)


def as_text(picked: Column) -> Column:
    """``hash:position`` pairs, the hash in hexadecimal, the position in words."""
    one = lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(LAST).cast("long") - x.bitwiseAND(F.lit(LAST).cast("long"))).cast("string")
    )
    return F.array_join(F.transform(picked, one), " ")


def hashes(picked: Column) -> Column:
    return F.array_distinct(F.transform(picked, lambda x: F.shiftright(x, 31)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; of two empty ones 1."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, F.lit(1.0)).otherwise(shared / whole)


def _branch(bounds: list[tuple[int, int]], low: int, high: int) -> Column:
    """How many of ``bounds[low:high]`` (key, tie) are at most the row's, plus ``low``: a compiled binary search."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    key, tie = bounds[mid]
    below = F.col("key") < key if tie == NO_ID else (F.col("key") < key) | ((F.col("key") == key) & (F.col("tie") < tie))
    return F.when(below, _branch(bounds, low, mid)).otherwise(_branch(bounds, mid + 1, high))


def _bounds(rows: DataFrame, coarse: int) -> list[tuple[int, int]]:
    """Cuts (key, tie) between about equally many rows; a key with several shares is cut by its ties."""
    found = rows.agg(F.percentile_approx("key", [i / coarse for i in range(coarse + 1)], 10_000)).first()[0] or []
    shares = Counter(found[1:-1])
    cuts = [(key, NO_ID) for key in shares]
    for key, n in shares.items():
        if n > 1:
            own = rows.where(F.col("key") == key).agg(F.percentile_approx("tie", [i / (n + 1) for i in range(1, n + 1)], 10_000))
            cuts += [(key, tie) for tie in set(own.first()[0])]
    return sorted(cuts)


def _bucket(rows: DataFrame, buckets: int) -> Column:
    """A bucket number that rises with (key, tie); beyond ``COARSE`` buckets cuts are spread evenly between bounds."""
    coarse = min(buckets, COARSE)
    fine = -(-buckets // coarse)
    inner = _bounds(rows, coarse)
    at = _branch(inner, 0, len(inner))
    if fine == 1 or not inner:
        return at.cast("long")
    ends = rows.agg(F.min("key"), F.max("key")).first()
    edges = [(ends[0], NO_ID), *inner, (ends[1] + 1 if ends[1] < 2**63 - 1 else ends[1], NO_ID)]
    edge = lambda part, i: F.element_at(F.array(*[F.lit(float(e[part])) for e in edges]), at + i)
    same = edge(0, 1) == edge(0, 2)
    low = F.when(same, edge(1, 1)).otherwise(edge(0, 1))
    high = F.when(same, edge(1, 2)).otherwise(edge(0, 2))
    value = F.when(same, F.col("tie")).otherwise(F.col("key")).cast("double")
    share = (value - low) / F.greatest(high - low, F.lit(1.0))
    return (at * fine + F.least(F.greatest(F.floor(share * fine), F.lit(0)), F.lit(fine - 1))).cast("long")


def with_next(docs: DataFrame, made: dict[str, Column], columns: list[str]) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by descending (key, tie), the first after the last.

    Rows are dealt by ranges; the columns ``made`` are added where they arrive. The top row of every range
    also goes, as a guest, to the range above, whose last row it follows; only the keys of these rows, one
    per range, pass the driver.
    """
    spark = docs.sparkSession
    stats = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(2 * shuffle_partitions(spark), -(-stats // BUCKET_CHARS))
    dealt = docs.withColumn("bucket", _bucket(docs.select("key", "tie"), buckets))
    tops = dealt.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("top")).collect()
    ranges = sorted((r["bucket"], *r["top"]) for r in tops)
    above = [r[0] for r in ranges[1:]] + [r[0] for r in ranges[:1]]
    moves = json.dumps([{"key": key, "tie": tie, "goes": goes} for (_, key, tie), goes in zip(ranges, above)])
    table = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(moves), "array<struct<key:bigint,tie:bigint,goes:bigint>>")))
    guests = dealt.join(F.broadcast(table), ["key", "tie"]).withColumn("bucket", F.col("goes")).drop("goes")
    both = dealt.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("tie"))
    lead = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return both.repartition(max(len(ranges), 1), "bucket").withColumns(made).withColumns(lead).where("guest = 0").drop("guest", "bucket")


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and how alike they are.

    ``docs`` is read several times and gives its rows in the same partitions each time, as stored tables do.
    """
    # Copies of a text have hashes that differ in their last bits only, so that ranges can part them.
    copy = F.pmod(F.monotonically_increasing_id() * 7919, F.lit(2**COPY_BITS)).cast("long")
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.shiftleft(F.shiftright(F.xxhash64(text_of()), COPY_BITS), COPY_BITS).bitwiseOR(copy).alias("tie"),
    )
    picked = chosen(F.col("text"), k, window)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(own, {"picked": picked}, ["text", "picked"]).withColumn("edited", edited)
    rows = rows.withColumn("edited_picked", chosen(F.col("edited"), k, window))
    mine = rows.withColumn("mine", hashes(F.col("picked")))
    return mine.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("picked")).alias("fingerprint"),
        as_text(F.col("edited_picked")).alias("edited_fingerprint"),
        likeness(F.col("mine"), hashes(F.col("edited_picked"))).alias("near_edited"),
        likeness(F.col("mine"), hashes(F.col("next_picked"))).alias("near_next"),
    )
