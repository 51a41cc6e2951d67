import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexivec.llm import ngram_join as j
from tests.llm.conftest import words


def shingles(text, k):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    n = min(k, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1)) if found else frozenset()


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, base=12, copies=7):
    r = random.Random(seed)
    rows = []
    for g in range(base):
        text = words(r.choice([4, 9, 14, 25, 60, 150]), seed * 100 + g)
        rows.append(" ".join(text))
        for _ in range(r.randint(0, copies)):
            edited = list(text)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                edited[r.randrange(len(edited))] = r.choice(words(50, 1))
            rows.append((r.choice([" ", "\n", " \t "])).join(edited).upper() if r.random() < 0.3 else " ".join(edited))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80), (1, 60)])
def test_against_brute_force(docs, k, num):
    rows = corpus(k + num)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.join_components(docs(*rows), k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_edge_rows(docs):
    text = " ".join(words(40))
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, " \n"), (10, "two words"), (11, "TWO  words"), (12, "x " * 30_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.join_components(docs(*rows)).collect()), key=str)
    assert got == sorted(
        [(5, 38, 3), (3, 38, 3), (3, 38, 3), (None, 38, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 1, 12)], key=str
    )
    assert j.join_components(docs((1, "a")).limit(0)).count() == 0
    kept = j.keep_one_stage(docs(*rows))
    assert kept.columns == docs((1, "a")).columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9, 10, 12]


def test_one_row_of_each_group_stays(docs, monkeypatch):
    text, other = " ".join(words(30)), " ".join(words(40, 5))
    rows = [(4, text), (4, text), (4, text + " x"), (None, text), (None, other), (None, other), (None, other + " y"), (8, None), (8, ""), (None, None), (None, "")]
    for bound in (1_000_000, 0):
        monkeypatch.setattr(j, "BROADCAST_ROWS", bound)
        kept = [(r["doc_id"], r["text"]) for r in j.keep_one_stage(docs(*rows)).collect()]
        assert sum(t in (None, "") for _, t in kept) == 4 and sum(i == 4 for i, _ in kept) == 1 and len(kept) == 6
        assert [t in (other, other + " y") for i, t in kept if i is None and t] == [True]


@pytest.mark.parametrize("rows, tokens, centres", [(4, 300, 2), (3, 10**6, 0), (256, 300, 24)])
def test_large_groups_are_dealt_in_parts(docs, monkeypatch, rows, tokens, centres):
    monkeypatch.setattr(j, "GROUP_ROWS", rows)
    monkeypatch.setattr(j, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(j, "CENTRES", centres)
    shared = words(30, 77)
    corpus_rows = corpus(4, 5, 12)
    # A passage that many texts share, some of which link.
    for n in range(30):
        corpus_rows.append((len(corpus_rows), " ".join(shared + words(n % 7, n // 2))))
    got = {r["doc_id"]: r["component_id"] for r in j.join_components(docs(*corpus_rows), 3, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(corpus_rows, 3, 80, 100).items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=30, unique=True), min_size=2, max_size=30), st.sampled_from([60, 80, 90]), st.integers(0, 3))
def test_sketches_miss_no_link(lists, num, cut):
    sets = [np.sort(j.mix(np.array(x, np.uint64) + np.uint64(1))) for x in lists]
    group = np.sort(np.arange(len(sets)) % (cut + 1))
    table = pa.table(
        {
            "doc_id": np.arange(len(sets)),
            "n_shingles": [len(x) for x in sets],
            "side": np.zeros(len(sets), np.int64),
            "sketch": pa.array([j.sketch(x, j.sketch_bits(len(x), num, 100)) for x in sets], pa.binary()),
        }
    )
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    a, b = j.close_pairs(table, starts, num, 100)
    label = j.merged(np.arange(len(sets)), a, b)
    for x in range(len(sets)):
        for y in range(x):
            shared = len(set(lists[x]) & set(lists[y]))
            if group[x] == group[y] and 100 * shared >= num * len(set(lists[x]) | set(lists[y])):
                assert label[x] == label[y]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), st.integers(1, 7))
def test_complete_runs(pairs, step):
    pairs = sorted(pairs)
    whole = pa.table({"group": pa.array([a for a, _ in pairs], pa.int64()), "i": pa.array([b for _, b in pairs], pa.int64())})
    parts = [b for n in range(0, len(pairs), step) for b in whole.slice(n, step).to_batches()]
    seen = []
    for table, starts in j.complete_runs(iter(parts), ["group", "i"]):
        rows = list(zip(table["group"].to_pylist(), table["i"].to_pylist()))
        for low, high in zip(starts, [*starts[1:], len(rows)]):
            assert len(set(rows[low:high])) == 1
            seen.append(rows[low:high])
    assert [x for run in seen for x in run] == pairs and len(seen) == len(set(pairs))


def test_ids_are_joined_beyond_the_broadcast_bound(docs, monkeypatch):
    monkeypatch.setattr(j, "BROADCAST_ROWS", 0)
    rows = corpus(5, 4, 4)
    got = {r["doc_id"]: r["component_id"] for r in j.join_components(docs(*rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 90, 100).items()}
    assert j.keep_one_stage(docs(*rows), 3, 90).count() == len(set(got.values()))


def cuts(num, documents=1000, frequent=()):
    edges = j.band_edges(num, 100, 5000)
    bands = tuple(j.allocate(i, a, b, documents, num, 100) for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return j.Join(1, num, 100, bands, np.sort(np.array(frequent, np.uint64)), np.ones(len(frequent), np.int64))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.sampled_from([60, 80, 90, 95]), st.integers(0, 10**6), st.sampled_from([0, 1000, 10**12]), st.floats(0, 1))
def test_linked_sets_share_a_signature(size, num, seed, documents, share):
    """Any two sets at the threshold, however their differences fall, whatever is frequent."""
    r = np.random.default_rng(seed)
    tokens = j.mix(r.integers(1, 2**62, 2 * size + 50).astype(np.uint64))
    a = np.sort(tokens[:size])
    drop = r.integers(0, size + 1)
    add = r.integers(0, size + 1)
    while 100 * (size - drop) < num * (size + add):
        drop, add = drop * 2 // 3, add * 2 // 3
    b = np.sort(np.concatenate([r.permutation(a)[drop:], tokens[size : size + add]]))
    join = cuts(num, documents, tokens[r.random(len(tokens)) < share])
    if not np.array_equal(a, b):
        assert np.intersect1d(j.signatures(a, join), j.signatures(b, join)).size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 25), min_size=1, max_size=20, unique=True), min_size=2, max_size=25), st.sampled_from([50, 80, 90]))
def test_linked_against_pairs(lists, num):
    sets = [np.array(sorted(x), np.uint64) for x in lists]
    root = j.linked(sets, np.zeros(len(sets), int), num, 100)
    want = {i: c for i, (_, c) in brute([(i, " ".join(map(str, x))) for i, x in enumerate(lists)], 1, num, 100).items()}
    assert len(set(root)) == len(set(want.values()))
    for a in want:
        for b in want:
            assert (root[a] == root[b]) == (want[a] == want[b])


def test_shingle_sets():
    texts = ["A b  c\tD", "", None, "one", "a b c a b c", "é É e"]
    sets = list(j.shingle_sets(pa.array(texts, pa.string()), 3))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 3, 1]
    assert Counter(map(len, j.shingle_sets(pa.array(["x y z w"] * 3).slice(1), 3))) == {2: 2}
