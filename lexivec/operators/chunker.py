"""Markdown to chunks: whole blocks packed to a token budget, split at headings, with overlap.

Every byte of a source is in some chunk and each chunk's text is the slice of its range. Offsets are
bytes, token counts are made of characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.functions.batches import slices, tidy
from lexivec.operators.blocks import Block, segment
from lexivec.schema import ChunkOptions

Tokenize = Callable[[str], int]


def approx_tokens(text: str) -> int:
    return -(-len(text) // 4)


@dataclass(frozen=True)
class Chunk:
    index: int
    start_byte: int
    end_byte: int
    text: str
    token_count: int


def _take(blocks: list[Block], costs: list[int], first: int, carried: int, options: ChunkOptions) -> int:
    """The block after the last one that goes into the chunk whose first new block is ``first``."""
    total, stop = carried + costs[first], first + 1
    while stop < len(blocks) and total < options.max_tokens:
        ripe = total >= options.min_tokens
        if ripe and (blocks[stop].kind == "heading" or total + costs[stop] > options.max_tokens):
            break
        total += costs[stop]
        stop += 1
    return stop


def _carry(blocks: list[Block], costs: list[int], stop: int, target: int) -> int:
    """The first block to repeat before block ``stop``: back to the target, never past a heading."""
    at, total = stop, 0
    while at > 0 and total < target and blocks[at - 1].kind != "heading":
        if total and total + costs[at - 1] > target:
            break
        at -= 1
        total += costs[at]
    return at


def chunk_markdown(source: str | bytes, options: ChunkOptions = ChunkOptions(), tokenize: Tokenize = approx_tokens) -> list[Chunk]:
    """The chunks of one source; none for an empty one, one for a source without blocks."""
    data = source.encode() if isinstance(source, str) else source
    if not data:
        return []

    def text(a: int, b: int) -> str:
        return data[a:b].decode("utf-8", "replace")

    blocks = segment(data)
    if not blocks:
        whole = text(0, len(data))
        return [Chunk(0, 0, len(data), whole, tokenize(whole))]
    costs = [tokenize(text(b.start, b.end)) for b in blocks]
    ranges: list[tuple[int, int]] = []
    first = 0
    while first < len(blocks):
        seed = _carry(blocks, costs, first, options.overlap_tokens) if ranges else first
        stop = _take(blocks, costs, first, sum(costs[seed:first]), options)
        start = min(blocks[seed].start, ranges[-1][1]) if ranges else 0
        ranges.append((start, blocks[stop - 1].end if stop < len(blocks) else len(data)))
        first = stop
    return [Chunk(i, a, b, t, tokenize(t)) for i, (a, b) in enumerate(ranges) for t in [text(a, b)]]


#: Bytes of text that a worker cuts at a time; what it holds beside them is several times as much.
SLICE_BYTES = 500_000
KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
SCHEMA = "chunk_index int, start_byte long, end_byte long, chunk string, tokens int"


def chunk_batches(parts: Iterator[pa.RecordBatch], keys: list[str], text: str, options: ChunkOptions, tokenize: Tokenize) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for part in slices(batch, text, SLICE_BYTES):
            at, found = [], []
            for i, source in enumerate(part.column(text)):
                made = chunk_markdown(source.as_py(), options, tokenize)
                at += [i] * len(made)
                found += [(c.index, c.start_byte, c.end_byte, c.text, min(c.token_count, 2**31 - 1)) for c in made]
            own = part.select(keys).take(pa.array(at, pa.int64()))
            columns = zip(*found) if found else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, columns, KINDS)], [*keys, "chunk_index", "start_byte", "end_byte", "chunk", "tokens"])


def chunk_table(docs: DataFrame, keys: list[str], text: str = "text", options: ChunkOptions = ChunkOptions(), tokenize: Tokenize = approx_tokens) -> DataFrame:
    """One row per chunk, with the key columns of its document. A worker holds the chunks of one slice of texts."""

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_batches(parts, keys, text, options, tokenize)

    own = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias(text))
    kinds = dict(own.dtypes)
    return own.mapInArrow(batches, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + SCHEMA)
