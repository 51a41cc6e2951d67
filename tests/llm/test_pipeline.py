"""Every pipeline stage against a plain version on the smallest tables, and run() against its stages."""

import os
import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from lexivec.llm import bpe, line_dedup, quality_gam, secret_scan
from tests.llm.test_ngram_join import brute

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain_line_dedup(rows):
    """doc_id to text: lines on ten sites or more stay with the smallest id."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
    sites, first = defaultdict(set), {}
    for r in rows:
        for line in r["text"].split("\n"):
            key = norm(line)
            if key:
                sites[key].add(r["source"])
                first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    spread = {k for k, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    return {
        r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if norm(x) not in spread or first[norm(x)] == r["doc_id"]) for r in rows
    }


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, tables = docs.columns, []
    for i, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        tables.append(after)
        if i < 4:
            assert docs.columns == columns
        texts = {r["doc_id"]: r["text"] for r in before}
        if name == "quality_classifier":
            model = quality_gam.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            scores = model.score(np.array([quality_gam.features(t) for t in texts.values()]))
            assert {r["doc_id"] for r in after} == {d for d, s in zip(texts, scores) if s >= quality_gam.KEEP_AT}
            assert len(after) < len(before)
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in after} == plain_line_dedup(before)
        elif name == "ngram_join":
            want = brute(list(texts.items()), 5, 80, 100)
            assert {r["doc_id"] for r in after} == {d for d, (_, c) in want.items() if c == d}
            assert all(texts[r["doc_id"]] == r["text"] for r in after)
        elif name == "secret_scan":
            assert {r["doc_id"]: r["text"] for r in after} == {d: secret_scan.redact(t) for d, t in texts.items()}
            assert not any(secret_scan.base_spans(r["text"]) for r in after)
        else:
            library = Tokenizer.from_file(bpe.vocabulary_path())
            sizes = defaultdict(int)
            for r in after:
                sizes[r["doc_id"]] += r["length"]
            assert sizes == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(p.run(spark, DATA).collect()) == key(tables[-1])
