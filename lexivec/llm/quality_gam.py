"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are binned by quantiles of a bounded sample of labelled rows. Boosting goes
round the features in cycles; each step fits a shallow tree to the gradients in one feature's bins and
adds it to that feature's lookup table. Then the pairs whose grids explain most of what is left get
tables of two features the same way. A score is the logistic of an intercept plus one table entry per
feature and pair, so scoring a batch is a row of vectorised look-ups and additions.

Defined cases: null text counts as empty, empty texts are scored; a null doc_id is not held out and
has no label; of repeated labels the highest counts; without labels of both kinds every score is the
share of label 1 (1 without any label); an empty table gives no rows. Never inputs: labels, language,
source and ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import slices, text_of, tidy

#: Labelled rows the model is fitted on, at most in expectation; they are chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
KEEP_AT = 0.7
BINS = 48
PAIR_BINS = 12
PAIRS = 8
CYCLES = 250
RATE = 0.1
LEAST_IN_LEAF = 12
RIDGE = 1.0

NAMES = (
    "log_bytes", "upper", "digit", "symbol", "exclaim", "pipe", "stop", "comma", "space", "newline", "other_bytes",
    "log_words", "word_bytes", "short_words", "distinct_words", "equal_neighbours", "distinct_lines", "longest_word",
    "symbol_words", "upper_words",
)

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+<>{}[]\\_/", b"!", b"|", b".", b",", b" \t\r\x0b\x0c", b"\n"), 1
):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10
_SYMBOL = b"#$%&*@^~=+<>{}[]\\_/!|"


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of ``NAMES``."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=11) if data else np.zeros(11)
    n = max(len(data), 1)
    words = data.split()
    m = max(len(words), 1)
    lines = data.split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = b"".join([w[-1:] for w in words])
    tails = np.frombuffer(ends, np.uint8)
    equal = sum(map(bytes.__eq__, words, words[1:]))
    uppers = np.fromiter(map(bytes.isupper, words), bool, len(words))
    return [
        np.log1p(len(data)),
        *(counts[1:11] / n),
        np.log1p(len(words)),
        sizes.sum() / m,
        (sizes <= 3).sum() / m,
        len(set(words)) / m,
        equal / m,
        len(set(lines)) / len(lines),
        np.log1p(sizes.max(initial=0)),
        np.isin(tails, list(_SYMBOL)).sum() / m,
        (uppers & (sizes >= 3)).sum() / m,
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts], np.float64).reshape(-1, len(NAMES))


@dataclass
class Model:
    """Lookup tables: one per feature, and one per pair of features on coarser bins."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            rows = np.searchsorted(self.coarse[a], x[:, a], side="right")
            out += table[rows, np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(x))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton values per bin of a tree of at most 2^depth leaves over ordered bins."""
    value = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth == 0 or len(g) < 2:
        return value
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain[(nl < LEAST_IN_LEAF) | (n.sum() - nl < LEAST_IN_LEAF)] = -1
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= 1e-9:
        return value
    return np.concatenate([shallow_tree(g[:cut], h[:cut], n[:cut], depth - 1), shallow_tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values on a grid of one cut along one axis and one along the other in each half; and the gain."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh, nn = (x.T if flip else x for x in (g, h, n))
        for cut in range(1, gg.shape[0]):
            value, gain = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                col = [x[part].sum(axis=0) for x in (gg, hh, nn)]
                tree = shallow_tree(*col, depth=1)
                value[part] = tree
                gain += float((2 * col[0] * tree - (col[1] + RIDGE / len(tree)) * tree * tree).sum())
            if gain > best:
                best, out = gain, value.T if flip else value
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of a feature matrix and labels 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    share = y.mean()
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [quantile_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [quantile_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    size = [len(e) + 1 for e in model.edges]
    count = [np.bincount(b, minlength=s) for b, s in zip(bins, size)]
    model.tables = [np.zeros(s) for s in size]
    z = np.full(len(y), model.intercept)
    for _ in range(CYCLES):
        for j, b in enumerate(bins):
            p = logistic(z)
            tree = shallow_tree(np.bincount(b, y - p, size[j]), np.bincount(b, p * (1 - p), size[j]), count[j])
            model.tables[j] += RATE * tree
            z += RATE * tree[b]
    cells = {}
    p = logistic(z)
    for a in range(len(bins)):
        for b in range(a + 1, len(bins)):
            shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            at = np.searchsorted(model.coarse[a], x[:, a], side="right") * shape[1]
            at = at + np.searchsorted(model.coarse[b], x[:, b], side="right")
            g, h, n = (np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y))))
            cells[a, b] = (float(_gain(g, h)[n >= LEAST_IN_LEAF].sum()), at, shape)
    chosen = sorted(cells, key=lambda k: -cells[k][0])[:PAIRS]
    grids = {k: np.zeros(cells[k][2]) for k in chosen}
    for _ in range(CYCLES // 5):
        for k in chosen:
            _, at, shape = cells[k]
            p = logistic(z)
            g, h, n = (np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(len(y))))
            tree, _ = pair_tree(g, h, n)
            grids[k] += RATE * tree
            z += RATE * tree.ravel()[at]
    model.pairs = [(a, b, grids[a, b]) for a, b in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample; its labels are broadcast, about ``bound`` rows at most."""
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("y"))
    )
    share = min(1.0, bound / max(1, usable.count()))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    joined = own.join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            x = matrix(part.column("text"))
            columns = [part.column("doc_id"), part.column("y"), *(pa.array(x[:, j]) for j in range(len(NAMES)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", *NAMES])

    schema = "doc_id long, y int, " + ", ".join(f"{n} double" for n in NAMES)
    # Rows that share a doc_id count once, so no more rows come back than labels went out.
    one = joined.mapInArrow(batches, schema).groupBy("doc_id").agg(F.max(F.struct("y", *NAMES)).alias("f"))
    table = one.select("doc_id", "f.*").toArrow().sort_by("doc_id")
    x = np.column_stack([table.column(n).to_numpy() for n in NAMES]) if len(table) else np.empty((0, len(NAMES)))
    return x, table.column("y").to_numpy().astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    return fit(*training_rows(docs, labels, bound))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            s = model.score(matrix(part.column("text")))
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= KEEP_AT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of().alias("text")
    )
    return own.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, bound))


def keep_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, in their own columns."""
    model, schema = train(docs, labels), docs.schema

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            yield part.filter(pa.array(model.score(matrix(part.column("text"))) >= KEEP_AT))

    return docs.mapInArrow(batches, schema)
