"""Text, hash and prompt expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexivec.schema import URI_SCHEME

# The default instruction and the whole template that a yes/no reranker is prompted with.
RERANK_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
RERANK_PROMPT = """<|im_start|>system
Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".<|im_end|>
<|im_start|>user
<Instruct>: {instruction}
<Query>: {query}
<Document>: {document}<|im_end|>
<|im_start|>assistant
<think>

</think>

"""


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; anything else separates."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def approx_tokens(text: Column) -> Column:
    """Characters by four, rounded up; none for an empty text."""
    return F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def preview_line(text: Column, limit: int) -> Column:
    """Trimmed non-empty lines on one line, cut after ``limit`` characters with an ellipsis."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    flat = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(uri: Column, digest: Column, index: Column) -> Column:
    """Hash of the uri, a zero byte, the content hash as text and the index as four little-endian bytes."""
    big = F.lpad(F.hex(index.cast("long")), 8, "0")
    little = F.concat(*[F.substring(big, at, 2) for at in (7, 5, 3, 1)])
    joined = F.concat(F.encode(uri, "utf-8"), F.unhex(F.lit("00")), F.encode(digest, "utf-8"), F.unhex(little))
    return F.sha2(joined, 256)


def short_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, 12)


def uri_of(collection: Column, relative: Column) -> Column:
    return F.concat(F.lit(f"{URI_SCHEME}://"), collection, F.lit("/"), F.translate(relative, "\\", "/"))


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or lies below it, component by component."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def yes_no_softmax(yes: Column, no: Column) -> Column:
    """P(yes) of two logits, stable for any size."""
    top = F.greatest(yes, no)
    a, b = F.exp(yes - top), F.exp(no - top)
    return a / (a + b)


def render_prompt(query: Column, document: Column, instruction: str | None = None) -> Column:
    """The reranker's prompt for one document."""
    head, rest = RERANK_PROMPT.replace("{instruction}", instruction or RERANK_INSTRUCTION).split("{query}")
    middle, tail = rest.split("{document}")
    return F.concat(F.lit(head), query, F.lit(middle), document, F.lit(tail))
