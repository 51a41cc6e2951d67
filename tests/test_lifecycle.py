"""Store, incremental indexing, embedding, streaming, registry and command line."""

import io
import json
import os

import pytest

from lexivec import cli
from lexivec.operators import bm25
from lexivec.operators.embed import HashingEmbedder, checked_query, run_embed
from lexivec.operators.ingest import IndexReport, diff, run_index
from lexivec.plans import hybrid
from lexivec.schema import CHUNKS, EmbedderDimMismatch, EmbedderModelMismatch, LexivecError
from lexivec.session import clear_scratch, materialise
from lexivec.sources.mdtree import walk
from lexivec.sources.registry import Registry, with_context
from lexivec.sources.store import ChunkStore
from lexivec.streaming.watch import embed_in_batches, watch


def put(folder, **files):
    for name, text in files.items():
        path = folder / (name.replace("__", "/") + ".md")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def found(store, text):
    return {r["path"].rsplit("/", 1)[-1] for r in hybrid.search(store, text, 10).collect()}


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore.open_or_create(spark, str(tmp_path / "store"), 8)


def rows(spark, *parts):
    full = [(i, c, f"u/{i}", p, h, 1, 0, t, 1, e, None, 1) for i, c, p, h, t, e in parts]
    return spark.createDataFrame(full, CHUNKS)


def test_empty_store(spark, store, tmp_path):
    assert store.count_rows() == 0 and store.file_hashes("default").count() == 0 and store.scan_unembedded().count() == 0
    assert found(store, "anything") == set() and store.delete_by_path("default", "/none") == 0
    assert [f.name for f in store.table().schema] == CHUNKS.fieldNames()
    with pytest.raises(LexivecError, match="dataset not found"):
        ChunkStore.open(spark, str(tmp_path / "absent"))


def test_merge_delete_and_time_travel(spark, store):
    store.append(rows(spark, *[(i, "default", f"/{i}.md", "h", i, None) for i in "abcd"]))
    new = spark.createDataFrame([("a", [1.0] * 8), ("c", [2.0] * 8), ("zz", [3.0] * 8)], "id string, embedding array<float>")
    assert store.apply_embeddings(new) == 3 and store.count_rows() == 4
    assert {r["id"] for r in store.scan_unembedded().collect()} == {"b", "d"}
    store.append(rows(spark, ("x", "other", "/a.md", "h2", "x", None)))
    assert {r["content_hash"] for r in store.file_hashes("other").collect()} == {"h2"}
    assert store.delete_by_path("default", "/a.md") == 1 and store.delete_by_path("default", "/it's.md") == 0
    assert store.table(2).count() == 4 and store.table().count() == 4
    assert store.versions().count() == len(store.versions_held())
    assert store.stats().first()["rows"] == 4
    store.compact(2)
    assert store.versions_held() == [store.manifest().version] and store.count_rows() == 4
    with pytest.raises(LexivecError, match="not found"):
        store.table(1)


def test_embedder_metadata(spark, store):
    assert store.validate_or_record_embedder("A", 8) and not store.validate_or_record_embedder("A", 8)
    with pytest.raises(EmbedderDimMismatch):
        store.validate_or_record_embedder("A", 16)
    with pytest.raises(EmbedderModelMismatch):
        store.validate_or_record_embedder("B", 8)


def test_wrong_dim_records_nothing(spark, tmp_path):
    four = ChunkStore.open_or_create(spark, str(tmp_path / "four"), 4)
    with pytest.raises(EmbedderDimMismatch):
        four.validate_or_record_embedder("A", 8)
    assert four.manifest().embedder_model is None


def test_index_lifecycle(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, a="# A\n\nzephyrquux text", b="# B\n\nother", c="# C\n\ngone soon")
    assert run_index(spark, store, str(root)) == IndexReport(3, 3, 0, 0)
    before = store.manifest().version
    assert run_index(spark, store, str(root)) == IndexReport(0, 0, 3, 0) and store.manifest().version == before
    put(root, b="# B\n\nplingwobble", d="# D\n\nnew")
    (root / "c.md").unlink()
    assert run_index(spark, store, str(root)) == IndexReport(2, 2, 1, 1)
    assert found(store, "plingwobble") == {"b.md"} and found(store, "other") == set() and found(store, "gone") == set()
    assert store.table().select("id").distinct().count() == store.count_rows()


def test_subroot_and_empty_file(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, sub1__x="one", sub2__y="two", sub1__empty="")
    assert run_index(spark, store, str(root)).files == 3
    assert run_index(spark, store, str(root)) == IndexReport(0, 0, 3, 0)
    (root / "sub1" / "x.md").unlink()
    assert run_index(spark, store, str(root / "sub1")).removed == 1
    assert {r["path"].rsplit("/", 1)[-1] for r in store.table().collect()} == {"y.md"}


def test_unreadable_file_keeps_its_rows(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, a="alpha", b="beta")
    run_index(spark, store, str(root))
    (root / "a.md").unlink()
    (root / "a.md").mkdir()
    assert run_index(spark, store, str(root)).removed == 1
    disk = spark.createDataFrame([("/x", ""), ("/y", "h2")], "path string, content_hash string")
    kept = spark.createDataFrame([("/x", "h1"), ("/y", "h1")], "path string, content_hash string")
    assert {r["path"]: r["action"] for r in diff(disk, kept).collect()} == {"/x": "failed", "/y": "replace"}


def test_walk(tmp_path):
    put(tmp_path, _x="1", node_modules__n="2", target__t="3", deep__ok="4")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.md").write_text("5")
    (tmp_path / "UP.MD").write_text("6")
    os.symlink(tmp_path / "deep", tmp_path / "link")
    assert sorted(os.path.relpath(p, tmp_path) for p in walk(str(tmp_path))) == ["_x.md", "deep/ok.md"]


def test_embed_and_query(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, fox="a red fox", stone="grey stone", bird="small bird")
    run_index(spark, store, str(root))
    with pytest.raises(LexivecError, match="no embeddings"):
        checked_query(store, HashingEmbedder(8), "fox")
    assert run_embed(store, lambda: HashingEmbedder(8)).rows == 3
    assert run_embed(store, lambda: HashingEmbedder(8)).rows == 0
    first = hybrid.vsearch(store, HashingEmbedder(8), "grey stone", 1).first()
    assert first["path"].endswith("stone.md")
    assert hybrid.query(store, HashingEmbedder(8), "red fox", 2).hits.first()["path"].endswith("fox.md")
    with pytest.raises(LexivecError, match="embedded with"):
        checked_query(store, HashingEmbedder(16), "x")
    assert hybrid.get(store, first["path"]).count() == 1 and hybrid.get(store, "#" + first["id"][:12]).count() == 1
    assert hybrid.multi_get(store, "*.md").count() == 3 and hybrid.multi_get(store, f"{first['path']},#zzz").count() == 1


def test_embed_in_batches_stops_between(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, **{f"f{i}": f"text number {i}" for i in range(5)})
    run_index(spark, store, str(root))
    calls = iter([False, True])
    assert embed_in_batches(store, lambda: HashingEmbedder(8), 2, lambda: next(calls)) == 2
    assert embed_in_batches(store, lambda: HashingEmbedder(8), 2) == 3


def test_watch_once(spark, store, tmp_path):
    root = tmp_path / "docs"
    put(root, a="alpha")
    reports = []
    for n in (1, 2):
        watch(spark, store, str(root), str(tmp_path / "cp"), on_report=reports.append, once=True).awaitTermination()
        put(root, b="beta")
    assert [r.files for r in reports] == [1, 1] and found(store, "beta") == {"b.md"}


def test_scratch_is_cleared(spark):
    made = materialise(spark.range(3), "test")
    assert made.count() == 3 and clear_scratch(spark) >= 1 and clear_scratch(spark) == 0


def test_registry(spark, tmp_path):
    path = str(tmp_path / "sub" / "r.toml")
    held = Registry.load(path)
    assert held.collections == []
    held.add("notes", "/n")
    held.collections[0].contexts["lexivec://notes/x"] = 'say "hi"'
    held.add("other", "/o")
    held.save(path)
    again = Registry.load(path)
    assert again == held and again.table(spark).count() == 2
    again.remove("other")
    with pytest.raises(LexivecError):
        again.remove("other")
    with open(path, "w") as f:
        f.write("collections = [")
    with pytest.raises(LexivecError, match="r.toml"):
        Registry.load(path)


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("s://a/b/c",), ("s://a/z",), ("s://q",)], "uri string")
    notes = spark.createDataFrame([("s://a/", "A"), ("s://a/b", "AB")], "prefix string, note string")
    got = {r["uri"]: r["context"] for r in with_context(rows, notes).collect()}
    assert got == {"s://a/b/c": "AB", "s://a/z": "A", "s://q": None}


def test_cli(spark, tmp_path):
    root, data = tmp_path / "docs", str(tmp_path / "ds")
    put(root, a="# A\n\nred fox", b="# B\n\nblue stone")

    def call(*argv, stdin=""):
        out = io.StringIO()
        cli.run(cli.parser().parse_args(["--dataset", data, "--dim", "8", "--registry", str(tmp_path / "r.toml"), *argv]), out, io.StringIO(stdin), io.StringIO())
        return out.getvalue()

    assert call("index", str(root)).startswith("indexed 2 files, 2 chunks")
    assert "embedded 2 rows" in call("embed")
    shown = json.loads(call("search", "fox", "--json"))
    assert len(shown) == 1 and shown[0]["id"] and shown[0]["text"]
    assert call("vsearch", "blue stone", "--files", "-n", "1").endswith("b.md\n")
    assert call("query", "fox", "--all", "--explain").count("\n") >= 2
    assert len(json.loads(call("embed-query", "fox"))) == 8
    assert json.loads(call("rerank", "--query", "fox", "--json", stdin=json.dumps(shown)))[0]["rank"] == 1
    assert "rows: 2" in call("inspect") and "0..12" in call("chunk", str(root / "a.md"))
    call("collection", "add", "docs", str(root))
    call("context", "add", "lexivec://docs/", "about docs")
    assert call("collection", "list").startswith("docs\t") and "rows: 2" in call("doctor") and "dim" in call("config")
    assert "a.md#0" in call("get", str(root / "a.md")) and "fox" in call("multi-get", "*.md")
    call("compact")
    with pytest.raises(SystemExit):
        call("search", "x", "--json", "--files")
    assert cli.main(["--dataset", str(tmp_path / "none"), "search", "x"]) == 1


def test_the_index_of_a_store_answers_searches(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("Runners run daily. A café opens early.")
    (folder / "b.md").write_text("Nothing of that kind.")
    store = ChunkStore.open_or_create(spark, str(tmp_path / "store"))
    run_index(spark, store, str(folder))
    assert store.lexical() is not None
    for asked in ("running", "cafe", "opening"):
        hits = hybrid.search(store, asked)
        assert [r["path"].rsplit("/", 1)[-1] for r in hits.collect()] == ["a.md"], asked
    plan = bm25.search_index(store.lexical(), "running", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "regexp" not in plan
    first = store.manifest()
    store.validate_or_record_embedder("m", first.dim)
    assert store.manifest().folder == first.folder and store.manifest().version == first.version + 1
    (folder / "b.md").write_text("It runs now.")
    run_index(spark, store, str(folder))
    assert store.manifest().folder != first.folder and hybrid.search(store, "runs").count() == 2
    store.compact()
    assert len(store.versions_held()) == 1 and hybrid.search(store, "runs").count() == 2
