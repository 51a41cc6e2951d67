"""Chunk invariants on any input, and the shapes that must stay whole."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivec.operators.blocks import frontmatter_end, segment
from lexivec.operators import chunker
from lexivec.operators.chunker import approx_tokens, chunk_markdown
from lexivec.schema import ChunkOptions

SMALL = ChunkOptions(60, 12, 8)


def whole(source, options=SMALL):
    data = source.encode()
    chunks = chunk_markdown(source, options)
    if not data:
        assert chunks == []
        return chunks
    assert [c.index for c in chunks] == list(range(len(chunks)))
    assert chunks[0].start_byte == 0 and chunks[-1].end_byte == len(data)
    for c in chunks:
        assert c.text == data[c.start_byte : c.end_byte].decode("utf-8", "replace")
        assert c.token_count == approx_tokens(c.text)
    for a, b in zip(chunks, chunks[1:]):
        assert a.start_byte <= b.start_byte <= a.end_byte < b.end_byte
    return chunks


PIECES = st.sampled_from(
    ["# Head\n", "para words here\n", "\n", "```\ncode # no head\n```\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "- item\n  more\n",
     "> quote\nlazy\n", "<div>\n<p>x</p>\n</div>\n", "[^1]: note\n", "---\n", "Title\n=====\n", "    indented\n", "é ü 漢字\n", "\r\n", "text"]
)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30), st.integers(1, 80), st.integers(0, 40), st.integers(0, 30))
def test_invariants(parts, most, overlap, least):
    whole("".join(parts), ChunkOptions(most, overlap, least))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_any_text(source):
    whole(source.encode("utf-8", "replace").decode())


@pytest.mark.parametrize(
    "source, kinds",
    [
        ("# A\n\npara\n", ["heading", "paragraph"]),
        ("```rust\nfn x() {}\n```\n", ["code"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n", ["table"]),
        ("<div>\nhi\n</div>\n\nafter\n", ["html", "paragraph"]),
        ("- a\n- b\n\n  more\n\npara\n", ["list", "paragraph"]),
        ("> q\nlazy\n\nx\n", ["quote", "paragraph"]),
        ("Title\n---\n\n---\n", ["heading", "rule"]),
        ("[^n]: note\n    more\n\nx\n", ["footnote", "paragraph"]),
        ("    code\n\n    more\n", ["code"]),
        ("[ref]: http://x\n\ntext\n", ["paragraph"]),
    ],
)
def test_block_kinds(source, kinds):
    assert [b.kind for b in segment(source.encode())] == kinds


def test_frontmatter():
    assert frontmatter_end(b"---\na: 1\n---\nbody") == 13
    assert frontmatter_end(b"---\r\na: 1\r\n---\r\nbody") == 16
    assert frontmatter_end(b"---\nnever closed\n") == 0
    assert frontmatter_end(b"x\n---\n") == 0
    chunks = whole("---\ntitle: x\n---\n\n# H\n\nbody\n")
    assert chunks[0].text.startswith("---\ntitle")


def test_table_stays_whole():
    table = "| col | val |\n|---|---|\n" + "".join(f"| row {i} | some value {i} |\n" for i in range(40))
    assert any(table in c.text for c in whole("# H\n\nintro text\n\n" + table + "\nafter\n"))


def test_fence_in_list_stays_whole():
    source = "- step one\n\n  ```\n  # not a heading\n\n  more\n  ```\n\n- step two\n"
    assert len(segment(source.encode())) == 1 and len(whole(source)) == 1


def test_headings_split_sections():
    source = "".join(f"# Section {i}\n\n{'word ' * 40}\n\n" for i in range(6))
    chunks = whole(source, ChunkOptions(60, 0, 8))
    assert len(chunks) == 6 and all(c.text.lstrip().startswith(f"# Section {i}") for i, c in enumerate(chunks))


def test_small_cases():
    assert whole("") == []
    assert len(whole(" \n\n")) == 1
    assert len(whole("no newline at end")) == 1
    assert whole("```\ncode\n```")[0].text == "```\ncode\n```"


def test_overlap_repeats_last_paragraph():
    source = "".join(f"paragraph {i} {'w ' * 30}\n\n" for i in range(8))
    with_overlap, without = whole(source, ChunkOptions(60, 20, 8)), whole(source, ChunkOptions(60, 0, 8))
    assert any(b.start_byte < a.end_byte for a, b in zip(with_overlap, with_overlap[1:]))
    assert all(b.start_byte == a.end_byte for a, b in zip(without, without[1:])) or all(
        b.start_byte <= a.end_byte for a, b in zip(without, without[1:])
    )


def test_chunk_table_works_in_slices_and_keeps_keys(spark):
    texts = [("word " * 40 + "\n\n") * 20] * 500
    given = pa.RecordBatch.from_pydict({"id": list(range(500)), "text": texts})
    made = list(chunker.chunk_batches(iter([given]), ["id"], "text", SMALL, approx_tokens))
    assert max(b.nbytes for b in made) < 3 * chunker.SLICE_BYTES
    want = [(i, c.index, c.text) for i in range(500) for c in chunk_markdown(texts[i], SMALL)]
    assert [(r["id"], r["chunk_index"], r["chunk"]) for b in made for r in b.to_pylist()] == want
    docs = spark.createDataFrame([(2**53 + 1, "x"), (None, "y"), (3, None)], "id long, text string").coalesce(1)
    assert [tuple(r) for r in chunker.chunk_table(docs, ["id"]).collect()] == [(2**53 + 1, 0, 0, 1, "x", 1), (None, 0, 0, 1, "y", 1)]
