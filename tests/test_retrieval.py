"""Ranking: BM25, vectors, fusion, reranking, filters and text functions."""

import itertools
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexivec.functions.stem import analyzed, fold, stem
from lexivec.functions.text import RERANK_INSTRUCTION, RERANK_PROMPT, preview_line, render_prompt, under, yes_no_softmax
from lexivec.functions.vectors import cosine_to
from lexivec.operators import bm25, embed, filters, fuse, rerank, vector
from lexivec.plans import hybrid, output
from lexivec.schema import FusionConfig, LexivecError


def hits(spark, *ids):
    rows = [(i, f"{i}.md", f"lexivec://default/{i}.md", 0, i, float(len(ids) - n)) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id string, path string, uri string, chunk_index int, text string, score double")


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_bm25_prefers_more_occurrences_and_matches_any_term(spark):
    docs = texts(spark, "widgetron a b c d", "widgetron " * 5, "nothing here", None, "")
    found = bm25.search_text(docs, "widgetron absent", 10).collect()
    assert [r["id"] for r in found] == [1, 0]
    indexed = bm25.search_index(bm25.build_index(docs), "widgetron absent", 10).collect()
    assert [(r["id"], round(r["score"], 9)) for r in found] == [(r["id"], round(r["score"], 9)) for r in indexed]


def test_bm25_score_by_hand(spark):
    docs = texts(spark, "x y", "y z z")
    row = bm25.search_text(docs, "x", 1).first()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert row["score"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2.5)))


def test_bm25_empty(spark):
    docs = texts(spark, "x")
    assert bm25.search_text(docs, " -- ", 5).count() == 0
    assert bm25.search_text(docs.limit(0), "x", 5).count() == 0
    assert bm25.search_index(bm25.build_index(docs), "absent", 5).count() == 0


def test_bm25_ties_by_id_and_batch(spark):
    docs = texts(spark, "same words", "same words", "other")
    assert [r["id"] for r in bm25.search_text(docs, "same", 5).collect()] == [0, 1]
    asked = spark.createDataFrame([(7, "same"), (8, "other thing")], "query_id int, text string")
    found = bm25.search_batch(bm25.build_index(docs), asked, 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(7, 0), (8, 2)]


def test_bm25_batch_equals_brute_force_and_shuffles_only_winners(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bm25.bm25_batch, "QUERY_BLOCK", 4)
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [None, "", "- _", *[" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(200)], *["w1 w2 W3"] * 40]
    texts(spark, *rows).selectExpr("-id AS id", "text").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    asked = [(i, " ".join(r.choices(words, k=5))) for i in range(5)] + [(5, "w1 w2 w3"), (6, "absent"), (7, None)]
    queries = spark.createDataFrame(asked, "query_id int, text string").coalesce(1)
    split = [[] if t is None else [w for w in t.lower().split() if w.isalnum()] for t in rows]
    avgdl, want = sum(map(len, split)) / len(split), set()
    for i, q in asked:
        scored = []
        for n, w in enumerate(split):
            df = {t: sum(t in x for x in split) for t in set((q or "").split()) & set(w)}
            part = [math.log(1 + (len(split) - f + 0.5) / (f + 0.5)) * bm25.term_part(w.count(t), len(w), avgdl) for t, f in df.items()]
            scored += [(-round(sum(part), 8), -n)] if part else []
        want |= {(i, n, x, -s) for n, (s, x) in enumerate(sorted(scored)[:4], 1)}
    plain = bm25.search_batch_text(docs, queries, 4)
    for found in (plain, bm25.search_batch(bm25.build_index(docs), queries, 4)):
        assert {(x["query_id"], x["rank"], x["id"], round(x["score"], 8)) for x in found.collect()} == want
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    assert bm25.search_batch_text(docs.limit(0), queries, 4).count() == 0


def test_embedding_works_in_slices(spark, monkeypatch):
    calls = []

    class Counting(embed.HashingEmbedder):
        def embed(self, texts):
            calls.append(sum(map(len, texts)))
            return super().embed(texts)

    rows = [(str(i), f"word{i} " * 2000) for i in range(400)] + [("none", None), ("blank", " _ "), ("last", "é 漢")]
    given = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["id", "text"])
    made = [r for b in embed.embed_batches(iter([given]), lambda: Counting(8), 256) for r in b.to_pylist()]
    assert max(calls) < 2_600_000 < sum(calls)
    assert [r["id"] for r in made] == [i for i, t in rows if i not in ("none", "blank")]
    assert made[7]["embedding"] == pytest.approx(embed.HashingEmbedder(8).one(rows[7][1]))
    docs = spark.createDataFrame(rows[-3:], "id string, text string").coalesce(1)
    assert [(r["id"], len(r["embedding"])) for r in embed.embed_table(docs, lambda: embed.HashingEmbedder(8)).collect()] == [("last", 8)]


def test_stemmed_search_joins_no_tokens_and_equals_the_index(spark):
    assert all(analyzed(t)[:1] == t[:1] for a in itertools.product("aybtls", repeat=3) for e in ("", "ies", "y", "ed", "ing", "eed", "s", "ll", "ational", "e") for t in ["".join(a) + e, a[0] + e] if t)
    docs = texts(spark, "Running runs, run! ÉTAT", "a runner ran", None, "", "états etats runs", "nothing").coalesce(1)
    index = bm25.build_index(docs, True)
    assert "Join" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["term"], r["id"], r["dl"], r["tf"]) for r in index.postings.collect()}
    assert {("run", 0, 4, 3), ("runner", 1, 3, 1), ("etat", 0, 4, 1), ("etat", 4, 3, 1), ("etats", 4, 3, 1), ("run", 4, 3, 1)} <= got and len(got) == 9
    for asked in ("run etats", "absent", "running absent"):
        found = bm25.search_text(docs, asked, 5, stemmed=True)
        assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
        want = [(r["id"], round(r["score"], 9)) for r in bm25.search_index(index, asked, 5).collect()]
        assert [(r["id"], round(r["score"], 9)) for r in found.collect()] == want and len(want) == (0 if asked == "absent" else 2)


def test_stemmed_search_and_index_files(spark, tmp_path):
    docs = texts(spark, "Running cafés", "nothing")
    assert bm25.search_text(docs, "run cafe", 5, stemmed=True).count() == 1
    bm25.write_index(bm25.build_index(docs), str(tmp_path / "ix"), 4)
    assert bm25.search_index(bm25.read_index(spark, str(tmp_path / "ix")), "nothing", 5).first()["id"] == 1


@pytest.mark.parametrize(
    "word, expected",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"),
     ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formalize", "formal"), ("adjustment", "adjust"),
     ("probate", "probat"), ("controlling", "control"), ("sky", "sky"), ("is", "is"), ("digitizer", "digit")],
)
def test_porter(word, expected):
    assert stem(word) == expected


def test_fold():
    assert fold("Straße".lower()) == "strasse" and fold("élève") == "eleve" and fold("œuvre") == "oeuvre" and fold("plain") == "plain"


def test_vector_search(spark):
    rows = [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", None), ("z", [0.0] * 4)]
    table = spark.createDataFrame(rows, "id string, embedding array<float>")
    found = vector.search(table, [0.9, 0.1, 0.0, 0.0], 2).collect()
    assert [r["id"] for r in found] == ["a", "b"] and found[0]["score"] > 0.99
    assert vector.search(table, [], 2).count() == 0
    asked = spark.createDataFrame([("q", [0.0, 1.0, 0.1, 0.0])], "query_id string, embedding array<float>")
    assert [r["id"] for r in vector.search_batch(table, asked, 1).collect()] == ["b"]


def test_wide_vectors_take_the_arrow_path(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(200)]) for i in range(5)] + [(9, None)]
    table = spark.createDataFrame(rows, "id int, embedding array<float>")
    query = [float(j % 5 - 2) for j in range(200)]
    got = {r["id"]: r["s"] for r in table.select("id", cosine_to(F.col("embedding"), query).alias("s")).collect()}
    for i, v in rows[1:5]:
        want = sum(a * b for a, b in zip(v, query)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in query))
        assert got[i] == pytest.approx(want)
    assert got[9] is None


def test_ivf_recall(spark):
    import random

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    table = spark.createDataFrame(rows, "id int, embedding array<float>")
    index = vector.build_ivf(table, 8)
    exact, near = ([x["id"] for x in f.collect()] for f in (vector.search(table, rows[0][1], 20), vector.search_ivf(index, rows[0][1], 20, 6)))
    assert len(set(exact) & set(near)) >= 18
    assert index.assigned.count() == 400


def test_rrf_numbers(spark):
    fused = fuse.fuse({"lex": hits(spark, "a", "b", "c"), "vec": hits(spark, "b", "a", "d")}).collect()
    assert [r["id"] for r in fused] == ["a", "b", "c", "d"]
    assert fused[0]["final_score"] == pytest.approx(0.75 / 61 + 0.05 + 0.60 / 62 + 0.02)
    assert [c["source"] for c in fused[0]["contributions"]] == ["lex", "vec"]


def test_rrf_bonus_ties_unknown_sources(spark):
    many = fuse.total_bonus(fuse.fuse({"lex": hits(spark, "d0", "d1", "d2", "d3")})).collect()
    assert [r["total_bonus"] > 0 for r in many] == [True, True, True, False]
    both = fuse.total_bonus(fuse.fuse({"lex": hits(spark, "x"), "vec": hits(spark, "x")})).first()
    assert both["total_bonus"] == pytest.approx(0.10)
    plain = FusionConfig(weights={"lex": 1.0, "vec": 1.0}, bonus=())
    assert [r["id"] for r in fuse.fuse({"lex": hits(spark, "z"), "vec": hits(spark, "a")}, plain).collect()] == ["a", "z"]
    assert fuse.fuse({"other": hits(spark, "q")}).first()["final_score"] == pytest.approx(0.05)
    assert fuse.fuse({"lex": hits(spark, "solo"), "vec": hits(spark).limit(0)}).count() == 1


def test_rerank_order_and_passthrough(spark):
    rows = [(i, s) for i, s in enumerate([0.9, 0.5, 0.9, 0.5])]
    table = spark.createDataFrame(rows, "pos int, rerank_score double")
    order = lambda k: [r["pos"] for r in rerank.order_by_relevance(table, k).orderBy("rank").collect()]
    assert order(None) == [0, 2, 1, 3] and order(2) == [0, 2] and order(99) == [0, 2, 1, 3] and order(0) == []
    given = json.dumps([{"id": "a", "text": "no match", "rank": 9, "rerank_score": 5, "path": "p"}, {"id": "b", "text": "red fox"}])
    out = rerank.rerank(rerank.validated(spark, given), "red fox")
    shown = json.loads(output.reranked_json(out))
    assert [r["id"] for r in shown] == ["b", "a"] and shown[1]["path"] == "p" and shown[1]["rank"] == 2
    assert output.reranked_json(rerank.rerank(rerank.validated(spark, given), "x", top_k=0)) == "[]\n"
    assert output.reranked_table(rerank.rerank(rerank.validated(spark, "[]"), "x")) == ""


@pytest.mark.parametrize("bad, named", [([{"id": "a"}], "0.*text"), ([{"text": "a"}], "0.*id"), ([{"id": "", "text": "x"}], "0.*id"), ([{"id": "a", "text": "b"}, {"id": 1, "text": "b"}], "1.*id")])
def test_bad_candidates(spark, bad, named):
    with pytest.raises(LexivecError, match=named):
        rerank.validated(spark, json.dumps(bad))


def test_softmax_prompt_and_fit(spark):
    rows = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (1e6, -1e6), (-1e6, 1e6)]
    got = [r[0] for r in spark.createDataFrame(rows, "y double, n double").select(yes_no_softmax(F.col("y"), F.col("n"))).collect()]
    assert got[0] == 0.5 and got[1] > 0.5 > got[2] and all(0 <= x <= 1 for x in got)
    row = spark.range(1).select(render_prompt(F.lit("sample query"), F.lit("sample document"))).first()[0]
    assert row == RERANK_PROMPT.format(instruction=RERANK_INSTRUCTION, query="sample query", document="sample document")
    count, cut = (lambda s: len(s) // 4), (lambda s, n: s[: 4 * n])
    assert len(rerank.fit_document("q", "d" * 99_999, count, cut)) < 8192
    with pytest.raises(LexivecError, match="too long"):
        rerank.fit_document("q" * 9000, "d", count, cut)


def test_filters_and_formats(spark):
    rows = [("1", "a.md", 0.9, "x"), ("2", "a.md", 0.5, " two\n\n lines "), ("3", "b.md", 0.1, "z"), ("4", "c.md", float("nan"), "n")]
    table = spark.createDataFrame(rows, "id string, path string, score double, text string")
    assert filters.apply(table, None, 0.5).count() == 2
    good = table.where("id <> '4'")
    assert filters.apply(good, 2).count() == 2
    assert output.as_files(good) == "a.md\nb.md\n"
    assert output.as_table(table.limit(0)) == "(no results)\n" and "two lines" in output.as_table(good)
    assert [r["id"] for r in json.loads(output.as_json(good.limit(1)))] == ["1"]
    assert json.loads(output.vector_json([0.5, -1.0])) == [0.5, -1.0]
    with pytest.raises(LexivecError, match="value 1"):
        output.vector_json([0.0, float("inf")])


def test_preview_and_prefix(spark):
    row = spark.createDataFrame([("  a\r\n\n\u00a0b  \n" + "c" * 10,)], "t string").select(preview_line(F.col("t"), 6).alias("p")).first()
    assert row["p"] == "a b cc…"
    paths = spark.createDataFrame([("/r/a",), ("/rx",), ("/r",)], "p string").where(under(F.col("p"), "/r")).count()
    assert paths == 2


def test_depths_and_query(spark):
    assert (hybrid.pre_fusion_k(5), hybrid.pre_fusion_k(50)) == (20, 100)
    assert (hybrid.effective_k(100, True), hybrid.effective_k(100, False)) == (64, 100)
    rows = [("s", "red fox " * 3, [1.0, 0.0]), ("t", "a red animal, the fox", [0.9, 0.1]), ("u", "stone", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "id string, text string, embedding array<float>")
    done = hybrid.run_query(chunks, "red fox", [1.0, 0.0], 3)
    assert [r["id"] for r in done.hits.collect()][0] == "s" and hybrid.explain(done).count() >= 5
    assert "fuse: 3 unique docs" in output.trace(done)
    assert hybrid.run_query(chunks, "red fox", [1.0, 0.0], 1, scorer=rerank.OverlapScorer()).hits.count() == 1
