"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is the text between newlines, compared after white space is turned into single spaces and
trimmed. Per line hash a HyperLogLog sketch of the sites (``source``) is merged by aggregation;
lines whose estimate is near the threshold get an exact distinct count. A line on ``min_sites`` or
more sites is cross-site boilerplate, however short: it stays in the document with the smallest doc_id
that has it and leaves all others. Empty lines are never judged. Lines are told apart by 128 hash bits.

Texts are not shuffled: the spread lines, if they are at most ``LISTED``, go into the expression that
cleans a text. Beyond that the positions to drop are joined to the texts by a row key of 128 bits.

Defined cases: null text counts as empty and stays null in the cleaned text; a null site is no site; a
very long text is taken whole; an empty table gives no rows; rows with equal doc_id and text are cleaned
alike; a line seen only under null doc_ids keeps every occurrence; other columns, whatever their names,
pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import ASCII_SPACE, text_of
from lexivec.session import discard, materialise

MIN_SITES = 10
#: Of the threshold, to either side: 15 standard errors of a sketch with 2^12 registers.
NEAR = 0.25
SKETCH_BITS = 12
#: Spread lines that go into an expression at most (48 bytes each).
LISTED = 10_000


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, ASCII_SPACE, " "))


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, source, k1, k2) of every line that isn't empty."""
    lines = docs.select("doc_id", "source", F.explode(F.split(text_of(), "\n", -1)).alias("line"))
    k1, k2 = hash_pair(F.col("line"))
    return lines.withColumn("line", normal(F.col("line"))).where("line <> ''").select("doc_id", "source", k1.alias("k1"), k2.alias("k2"))


def spread_lines(keys: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(k1, k2, first), stored: the lines on at least ``min_sites`` sites and the doc_id that keeps each."""
    sketched = (
        keys.groupBy("k1", "k2")
        .agg(
            F.hll_sketch_agg("source", F.lit(SKETCH_BITS)).alias("sketch"),
            F.min("doc_id").alias("first"),
            F.count("source").alias("seen"),
        )
        .where(F.col("seen") >= min_sites)
        .select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR))
    )
    found = materialise(sketched, "line-spread")
    sure = found.where(F.col("sites") > min_sites * (1 + NEAR)).select("k1", "k2", "first")
    near = found.where(F.col("sites") <= min_sites * (1 + NEAR)).select("k1", "k2", "first")
    exact = (
        keys.where(F.col("source").isNotNull())
        .join(near, ["k1", "k2"])
        .groupBy("k1", "k2", "first", "source")
        .agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2", "first")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("k1", "k2", "first")
    )
    out = materialise(sure.unionByName(exact).where("first IS NOT NULL"), "spread-lines")
    discard(found)
    return out


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, n_lines, kept): each row of ``docs`` as a struct, its lines' number and those that stay.

    ``kept`` is null where all stay.
    """
    keys = materialise(line_keys(docs), "line-keys")
    spread = spread_lines(keys, min_sites)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.split(text_of(), "\n", -1).alias("lines"), docs["doc_id"].alias("id"))
    if spread.count() <= LISTED:
        own1, own2 = hash_pair(F.col("k1"), F.col("k2"), F.col("first"))
        listed = spread.select("k1", "k2", own1.alias("o1"), own2.alias("o2")).toPandas()
        in1, in2, own1, own2 = (sorted(listed[c].tolist()) for c in ("k1", "k2", "o1", "o2"))

        def stays(line: Column) -> Column:
            k1, k2 = hash_pair(normal(line))
            o1, o2 = hash_pair(k1, k2, F.col("id"))
            return ~(k1.isin(in1) & k2.isin(in2)) | (o1.isin(own1) & o2.isin(own2))

        kept = F.filter("lines", stays) if in1 else F.col("lines")
        made = rows.select("doc", "lines", kept.alias("kept"))
        whole = F.size("kept") == F.size("lines")
    else:
        r1, r2 = hash_pair(F.col("doc_id"), F.col("text"))
        each = docs.select(r1.alias("r1"), r2.alias("r2"), "doc_id", F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
        k1, k2 = hash_pair(normal(F.col("line")))
        gone = (
            each.withColumns({"k1": k1, "k2": k2})
            .join(spread, ["k1", "k2"])
            .where(~F.col("doc_id").eqNullSafe(F.col("first")))
            .groupBy("r1", "r2")
            .agg(F.collect_set("pos").alias("at"))
        )
        r1, r2 = hash_pair(F.col("id"), F.col("doc.text"))
        met = rows.withColumns({"r1": r1, "r2": r2}).join(gone, ["r1", "r2"], "left")
        made = met.select("doc", "lines", F.filter("lines", lambda x, i: ~F.array_contains("at", i)).alias("kept"), "at")
        whole = F.col("at").isNull()
    out = made.select("doc", F.size("lines").cast("long").alias("n_lines"), F.when(~whole, F.col("kept")).alias("kept"))
    return out


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text of every document."""
    rows = cleaned(docs.select("doc_id", "text", "source"), min_sites)
    removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("kept"))
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_lines",
        removed.cast("long").alias("n_removed"),
        F.coalesce(F.array_join("kept", "\n"), F.col("doc.text"), F.lit("")).alias("text"),
    )


def dedup_stage(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with cleaned text and matching n_chars, in their own columns."""
    text = F.coalesce(F.array_join("kept", "\n"), F.col("doc.text"))
    rows = cleaned(docs, min_sites).select("doc", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return rows.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
