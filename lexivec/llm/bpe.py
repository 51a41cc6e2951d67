"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A long text is halved, wherever the middle falls, down to leaves; the leaves of all texts of a batch are
encoded in parallel, and at each join a window of pieces on either side is encoded anew, growing until
its first and last piece are those that both sides have there. A piece is what stands between ASCII white
space; the vocabulary drops that, so pieces can be encoded apart, and each distinct one is encoded once. A
piece over ``LEAF`` characters that the pre-tokenizer doesn't split further is halved in turn, and joined
by windows of tokens. Every neighbouring pair of tokens then stands in some correct encoding, which makes
the whole one correct.

Defined cases: null and empty text give no ids and an empty decoded text; special-token strings in a
text become their ids, as in the library, also where a cut goes through them; a very long text is taken
whole, by one worker, leaf by leaf; repeated rows are encoded alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from lexivec.llm.common import slices, text_of, tidy

#: Threads that encode in one worker, of which a machine has many; each keeps memory of its own.
os.environ.setdefault("RAYON_NUM_THREADS", "2")

VOCABULARY = "word_bpe_49k.json"
#: Characters (bytes in the byte-level alphabet) of an unsplit run that is encoded in one piece.
LEAF = 24
#: Characters of a text that are cut into pieces in one go; longer texts are halved.
LEAF_TEXT = 8_192
#: Distinct pieces that a worker remembers, about 200 bytes each; when there are more it begins anew.
REMEMBERED = 200_000
#: Bytes of text that a worker encodes at a time; a longer text comes alone, and whole.
ENCODED_BYTES = 1_500_000
#: Pieces that are encoded together, and how many times so many one call takes.
TOGETHER = 2_000
CALLS = 4


class Codec:
    """Ids of texts under one vocabulary file, with a memory of pieces."""

    def __init__(self, path: str, leaf: int = LEAF, leaf_text: int = LEAF_TEXT):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Encodes runs, whose ends it marks; it neither normalises them nor splits them but at a space.
        self.end = Tokenizer.from_file(path)
        self.end.no_truncation()
        self.end.no_padding()
        self.end.normalizer = normalizers.Sequence([])
        self.end.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.path, self.suffix = path, self.end.model.end_of_word_suffix or ""
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        numbered = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(numbered.values()) + 1)
        for text, i in numbered.items():
            self.token[i] = text
        #: Whether a token ends a run.
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.token])
        self.leaf, self.leaf_text = leaf, leaf_text
        #: How many joins of halves there were, of texts and of runs.
        self.joins = 0
        self.forget()

    @cached_property
    def inside(self) -> Tokenizer:
        """Encodes the inside of runs; made only where a run is long."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))

    def text_of_token(self, i: int, last: bool) -> str:
        text = self.token[i]
        return text.removesuffix(self.suffix) if last and self.suffix else text

    def run(self, run: str) -> list[int]:
        """Ids of one unsplit run in the byte-level alphabet, by tree concatenation."""
        if len(run) <= self.leaf:
            return self.end.encode(run, add_special_tokens=False).ids
        self.joins += 1
        n = 1
        while len(run) > n * self.leaf:
            n *= 2
        cuts = [len(run) * i // n for i in range(n + 1)]
        leaves = [run[a:b] for a, b in zip(cuts, cuts[1:])]
        parts = [e.ids for e in self.inside.encode_batch(leaves[:-1], add_special_tokens=False)]
        parts.append(self.end.encode(leaves[-1], add_special_tokens=False).ids)
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in range(0, len(parts), 2)]
        return parts[0]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of two neighbours' text from their encodings; ``last``: the run ends here."""
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            whole = len(b) == len(right)
            text = "".join(self.token[i] for i in a) + "".join(
                self.text_of_token(i, last and whole and j == len(b) - 1) for j, i in enumerate(b)
            )
            coder = self.end if last and whole else self.inside
            window = coder.encode(text, add_special_tokens=False).ids
            fits_left = len(a) == len(left) or window[0] == a[0]
            fits_right = whole or window[-1] == b[-1]
            if fits_left and fits_right:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def long_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for part in self.special_at.split(piece) if self.special_at else [piece]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    ids += self.run(run)
        return ids

    def forget(self) -> None:
        """Give up the memory, as a worker does at the end of a partition."""
        #: Numbers of pieces, and their ids one after the other.
        self.memory: dict[str, int] = {}
        self.flat, self.size = np.empty(0, "<u4"), np.empty(0, np.int64)

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and how many each has."""
        if len(self.memory) > REMEMBERED:
            self.forget()
        number = np.fromiter((self.memory.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new = [pieces[i] for i in missing.tolist()]
            flat, size = self.encoded(new)
            first = len(self.size)
            number[missing] = np.arange(first, first + len(new))
            self.memory.update(zip(new, range(first, first + len(new))))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        start = (np.cumsum(self.size) - self.size)[number]
        size = self.size[number]
        ends = np.cumsum(size)
        return self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``pieces``, of pieces that are not remembered."""
        plain = np.fromiter((len(p) <= self.leaf and PLAIN(p) is not None for p in pieces), bool, len(pieces))
        ready = [byte_level(pieces[i].lower()) for i in np.flatnonzero(plain).tolist()]
        joined = [" ".join(ready[i : i + TOGETHER]) for i in range(0, len(ready), TOGETHER)]
        # A few at a time: the library's encodings hold much beside the ids.
        ids = [
            np.array(e.ids, "<u4")
            for i in range(0, len(joined), CALLS)
            for e in self.end.encode_batch_fast(joined[i : i + CALLS], add_special_tokens=False)
        ]
        easy = np.concatenate([np.empty(0, "<u4"), *ids])
        ends = np.flatnonzero(self.ends[easy])
        if len(ends) != len(ready):  # a vocabulary that doesn't mark the ends of runs
            own = [self.end.encode(r, add_special_tokens=False).ids for r in ready]
            easy, ends = np.array([i for x in own for i in x], "<u4"), np.cumsum(list(map(len, own)), dtype=np.int64) - 1
        others = np.flatnonzero(~plain).tolist()
        short = [i for i in others if len(pieces[i]) <= self.leaf]
        found = {}
        for a in range(0, len(short), TOGETHER):
            own = short[a : a + TOGETHER]
            found |= zip(own, [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in own], add_special_tokens=False)])
        found |= {i: self.long_piece(pieces[i]) for i in others if i not in found}
        size = np.zeros(len(pieces), np.int64)
        size[plain] = np.diff(np.append(-1, ends))
        size[others] = [len(found[i]) for i in others]
        flat = np.empty(size.sum(), "<u4")
        own = np.repeat(plain, size)
        flat[own] = easy
        flat[~own] = [x for i in others for x in found[i]]
        return flat, size

    def batch(self, texts: pa.Array) -> EncodedBatch:
        if texts.offset:  # string kernels misread a slice that starts inside its buffer
            texts = texts.take(pa.array(np.arange(len(texts))))
        texts = eased(pc.fill_null(texts.cast(pa.large_string()), ""))
        n = pc.utf8_length(texts).to_numpy()
        leaves = np.ones(len(n), np.int64)
        while (more := n > leaves * self.leaf_text).any():
            leaves[more] *= 2
        if (leaves > 1).any():
            parts: list[str] = []
            for text, length, count in zip(texts.to_pylist(), n.tolist(), leaves.tolist()):
                cuts = [length * i // count for i in range(count + 1)]
                parts += [text[a:b] for a, b in zip(cuts, cuts[1:])] if count > 1 else [text]
            texts = pa.array(parts, pa.large_string())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = split.offsets.to_numpy()
        offsets = offsets - offsets[0]
        if (leaves > 1).any():
            own, at = [], 0
            for count in leaves.tolist():
                parts = [codes[offsets[i] : offsets[i + 1]] for i in range(at, at + count)]
                own.append(parts[0] if count == 1 else self.tree(parts, names))
                at += count
            codes, offsets = np.concatenate(own), np.concatenate([[0], np.cumsum(list(map(len, own)))])
        return EncodedBatch(self, names, codes, offsets)

    def tree(self, parts: list[np.ndarray], names: list[str]) -> np.ndarray:
        """Piece numbers of a text from those of its leaves; pieces that the joins make get new names."""
        while len(parts) > 1:
            parts = [self.join_pieces(parts[i], parts[i + 1], names) for i in range(0, len(parts), 2)]
        return parts[0]

    def join_pieces(self, left: np.ndarray, right: np.ndarray, names: list[str]) -> np.ndarray:
        self.joins += 1
        k = 1
        while True:
            a, b = [names[i] for i in left[-k:]], [names[i] for i in right[:k]]
            window = ASCII_SPACES((" ".join(a) + " ".join(b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                break
            k *= 2
        new = np.arange(len(names), len(names) + len(window))
        names += window
        return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])


#: Latin-1 letters only: the normaliser just lowers them and the pre-tokenizer keeps them together.
PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The pieces of a text, with empty ones at its ends where there is white space.
ASCII_SPACES = re.compile("[\x20\x09-\x0d]+").split
#: Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_LEVEL = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(_HIDDEN)}


def byte_level(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LEVEL)


def eased(texts: pa.Array) -> pa.Array:
    """The texts with fewer distinct pieces and the same ids.

    A-Z become lower case, as the normaliser would make them, unless a combining mark could compose
    with the upper-case letter only or a special token be made of it. A space goes between a letter
    and a comma or full stop, where the pre-tokenizer splits anyway.
    """
    odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"\p{M}"))
    lower = pc.if_else(odd, texts, pc.ascii_lower(texts))
    return pc.replace_substring_regex(lower, r"(\p{L})([,.])", r"\1 \2")


class EncodedBatch:
    """Texts as codes of distinct pieces; ``offsets`` bound each text's codes."""

    def __init__(self, codec: Codec, pieces: list[str], codes: np.ndarray, offsets: np.ndarray):
        self.codes, self.offsets = codes, offsets
        self.flat, self.size = codec.pieces(pieces)
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __iter__(self) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for a, b in zip(self.offsets, self.offsets[1:]):
            codes = self.codes[a:b]
            size = self.size[codes]
            ends = np.cumsum(size)
            shift = self.start[codes] - (ends - size)
            yield self.flat[np.repeat(shift, size) + np.arange(ends[-1] if len(ends) else 0)]

    def counts(self) -> np.ndarray:
        """The number of ids of each text."""
        sums = np.concatenate([[0], np.cumsum(self.size[self.codes])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def rendered(self, of_id: list[bytes]) -> Iterator[bytes]:
        """Each text's ids rendered and joined by a space."""
        words = [of_id[i] for i in self.flat.tolist()]
        start = self.start.tolist()
        pieces = [b" ".join(words[a : a + n]) for a, n in zip(start, self.size.tolist())]
        for a, b in zip(self.offsets, self.offsets[1:]):
            yield b" ".join(filter(None, map(pieces.__getitem__, self.codes[a:b].tolist())))


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, leaf: int = LEAF) -> Codec:
    """One codec per process and vocabulary."""
    if (path, leaf) not in _CODECS:
        _CODECS[path, leaf] = Codec(path, leaf)
    return _CODECS[path, leaf]


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document."""

    @tidy
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary), leaf)
        digits, tokens = [b"%d" % i for i in range(len(own.token))], [t.encode() for t in own.token]
        for part in (x for whole in parts for x in slices(whole, most=ENCODED_BYTES)):
            coded = own.batch(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(coded.counts(), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded.rendered(digits)], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded.rendered(tokens)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.forget()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(batches, RESULT)


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the ids themselves, for callers that want more than digests."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path(vocabulary))
        for part in (x for whole in parts for x in slices(whole, most=ENCODED_BYTES)):
            ids = [x.astype(np.int32) for x in own.batch(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return own.mapInArrow(batches, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the decoded text of (doc_id, ids): tokens joined by a space, as the library does."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = codec(vocabulary_path(vocabulary)).token
        for part in parts:
            text = [" ".join(token[i] for i in x or ()) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(batches, "doc_id long, text string")
