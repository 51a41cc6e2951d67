import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexivec.llm import quality_gam as q

DATA = "/root/testdata/sf0.1"


def test_tree_and_tables_learn_a_step_and_a_pair():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = q.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    assert (0, 1) in {p[:2] for p in model.pairs}


def test_score_is_a_sum_of_table_entries():
    r = np.random.default_rng(2)
    x = r.random((500, 2))
    model = q.fit(x, (x[:, 0] > 0.4).astype(float))
    one = x[7]
    total = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(model.edges, model.tables, one))
    total += sum(t[np.searchsorted(model.coarse[a], one[a], side="right"), np.searchsorted(model.coarse[b], one[b], side="right")] for a, b, t in model.pairs)
    assert model.logits(x)[7] == pytest.approx(total)


@pytest.mark.parametrize("text", ["", " ", "a", "é" * 10, "\n\n", "x " * 200_000, "\ud7ff ok"])
def test_features_are_finite(text):
    assert np.isfinite(q.features(text)).all()


def test_edge_rows(spark, docs):
    table = docs((1, None), (2, ""), (None, "text"), (1, None), (4, "word " * 50_000))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    got = q.classify(table, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got}[2] == (zlib.crc32(b"2") % 4 == 2)
    assert q.classify(table.limit(0), labels).count() == 0
    assert q.keep_stage(table, labels.limit(0)).count() == 5
    assert q.keep_stage(table, labels).columns == table.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    import lexivec.llm.queries as queries

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality_gam(spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    right = np.array([r["predicted"] == labels[r["doc_id"]] for r in rows])
    bad = np.array([labels[r["doc_id"]] == 0 for r in rows])
    assert len(rows) > 500 and right.mean() > 0.98 and right[bad].mean() > 0.93


def test_matrix_of_no_rows():
    assert q.matrix(pa.array([], pa.string())).shape == (0, len(q.NAMES))
