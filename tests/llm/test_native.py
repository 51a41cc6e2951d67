"""Exact dedup, URL reputation, winnowing and line dedup."""

import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import exact_dedup, line_dedup, queries, url_reputation, winnow
from lexivec.llm.sql import SQL
from tests.llm.conftest import words

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.sql(SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a, b = (sorted(map(repr, f[names].astype(object).where(f[names].notna(), None).values.tolist())) for f in (got, want))
    assert a == b


@pytest.mark.parametrize("name", ["op8_url_reputation", "op9_winnowing", "op10_line_dedup"])
def test_no_python_on_the_main_path(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_perfect_hash_is_minimal_and_checks_bytes():
    r = np.random.default_rng(0)
    keys = r.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    index = exact_dedup.MinimalPerfectHash.of(keys)
    assert sorted(index.lookup(keys).tolist()) == list(range(5000))
    again = exact_dedup.MinimalPerfectHash.from_bytes(index.to_bytes())
    assert (again.lookup(keys) == index.lookup(keys)).all() and len(index.to_bytes()) < 5000
    others = r.integers(0, 2**63, (5000, 4)).astype(np.uint64)
    held = np.empty_like(keys)
    held[index.lookup(keys)] = keys
    at = index.lookup(others)
    assert not ((at >= 0) & (held[np.maximum(at, 0)] == others).all(axis=1)).any()
    assert exact_dedup.MinimalPerfectHash.of(keys[:1]).lookup(keys[:1]).tolist() == [0]
    assert exact_dedup.MinimalPerfectHash.of(keys[:0]).lookup(keys[:2]).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        exact_dedup.MinimalPerfectHash.of(keys[[1, 1]])


def test_an_index_is_probed_again(docs):
    old = exact_dedup.digests(docs((1, "a"), (2, "b"), (3, "a")))
    index = exact_dedup.build_index(old, 3)
    for rows, want in (([(8, "a"), (9, "c")], {("1", 3), ("2", 1), ("9", 1)}), ([(7, "b"), (7, "b")], {("1", 2), ("2", 3)}), ([], {("1", 2), ("2", 1)})):
        new = exact_dedup.digests(docs(*rows) if rows else docs((1, "a")).limit(0))
        assert {(str(r["keep_id"]), r["group_size"]) for r in exact_dedup.probe(new, index, 3).collect()} == want


@pytest.mark.parametrize("share", [1e-9, 0.3])
def test_hot_groups_and_others(docs, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = [(i, "copy" if i % 3 == 0 else f"own {i // 4}") for i in range(90)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(*rows)).collect()}
    members = {}
    for i, t in rows:
        members.setdefault(t, []).append(i)
    assert got == {i: (members[t][0], len(members[t]), i == members[t][0]) for i, t in rows}


def test_exact_dedup_edges(docs):
    long = "word " * 200_000
    table = docs((4, "a  b"), (2, "a\tb"), (9, "a b "), (7, None), (6, ""), (None, "a b"), (2, "a\tb"), (None, "q"), (None, "q"), (11, long), (10, long))
    got = exact_dedup.exact_dedup(table).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ab = [r for r in got if r["text_sha256"] == sha("a b")]
    assert {r["keep_id"] for r in ab} == {2} and {r["group_size"] for r in ab} == {4} and len(ab) == 4
    assert sorted(str(r["doc_id"]) for r in ab if r["kept"]) == ["2"]
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["text_sha256"] == sha("")} == {(6, 6, True), (7, 6, False)}
    q = [r for r in got if r["text_sha256"] == sha("q")]
    assert [r["keep_id"] for r in q] == [None, None] and sum(r["kept"] for r in q) == 1
    assert {(r["doc_id"], r["kept"]) for r in got if r["doc_id"] in (10, 11)} == {(10, True), (11, False)}
    assert [r["kept"] for r in got if r["doc_id"] == 9] == [True] and len(got) == 11
    assert exact_dedup.exact_dedup(table.limit(0)).count() == 0


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, "h", "x") for i, u in rows], "page_id long, url string, html string, rule string")


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/100", "example.org", "/en/100", "example.org/en/1", "block"),
        ("https://example.org/en/200", "example.org", "/en/200", "org/", "allow"),
        ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("https://x.com/fr", "x.com", "/fr", None, "allow"),
        ("https://notexample.org?x://y/", "notexample.org", "", None, "allow"),
        ("ftp://telecom/de/", "telecom", "/de/", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("no scheme/org", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("https://É.org/x\ny", "É.org", "/x\ny", "org/", "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = url_reputation.url_filter(pages(spark, (1, url)), labels).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_reputation_shrinks(spark):
    rows = [(i, f"http://bad.net/{i}") for i in range(40)] + [(100 + i, f"http://good.net/{100 + i}") for i in range(40)] + [(200, "http://new.net/1000"), (201, "http://one.net/201")]
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(201, 0, 0), (5, None, None), (None, 0, 1), (5, 0, 1)]
    got = {r["page_id"]: r for r in url_reputation.url_filter(pages(spark, *rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[0]["verdict"] == "block" and got[100]["verdict"] == "allow" and got[200]["verdict"] == "allow"
    assert got[100]["bad_rate_low"] < got[200]["bad_rate_low"] < got[201]["bad_rate_low"] < got[0]["bad_rate_low"]
    assert url_reputation.url_filter(pages(spark, (1, "x")).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_outcome_of_the_shown_document(spark):
    ends = ["", "/", ".html", "?page=2", "#top"]
    rows = [(i, f"http://bad.net/en/{500 + i}{ends[i % 5]}") for i in range(40)]
    rows += [(500 + i, f"http://good.net/en/{i}{ends[i % 5]}") for i in range(40)]
    rows += [(600, "http://bad.net/about"), (601, "http://none.net/en/x500"), (602, None), (None, "http://bad.net/x" + "y" * 100_000), (600, "http://bad.net/about")]
    labels = spark.createDataFrame([(500 + i, 0, 0) for i in range(40)] + [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = url_reputation.url_filter(pages(spark, *rows), labels).collect()
    got = {r["page_id"]: r for r in out}
    assert all(got[i]["verdict"] == "block" and got[500 + i]["verdict"] == "allow" for i in range(40))
    assert got[600]["verdict"] == "block" and got[601]["verdict"] == got[602]["verdict"] == "allow" and len(out) == len(rows)
    assert got[None]["verdict"] == "block" and len(got[None]["path"]) == 100_002


def test_reputation_against_exact_posteriors(spark):
    """Many hosts of many rates: the quantile against one by summing the density, blocked those over the base rate."""
    r = np.random.default_rng(3)
    rows, labels, counts = [], [], {}
    for h in range(40):
        n, rate = int(r.integers(1, 60)), float(r.choice([0.05, 0.2, 0.7]))
        for i in range(n):
            number = len(rows)
            bad = int(r.random() < rate)
            rows.append((number, f"http://h{h}.site.com/x/{number}"))
            labels.append((number, 1 - bad, 0))
            a, b = counts.get(f"h{h}.site.com", (0, 0))
            counts[f"h{h}.site.com"] = a + 1, b + bad
    parts = pages(spark, *rows).select(url_reputation.split_url(F.col("url"))[0].alias("host"), F.col("page_id").alias("shown"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    hosts, base = url_reputation.host_table(parts, url_reputation.outcomes(table))
    found = {x["host"]: x for x in hosts.collect()}
    assert abs(base - sum(b for _, b in counts.values()) / len(rows)) < 0.01
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = {x["host"]: x["verdict"] for x in url_reputation.url_filter(pages(spark, *rows), table, rules=()).collect()}
    strength = None
    for host, x in found.items():
        n, bad = counts[host]
        if strength is None:  # the mean is (prior * s + bad) / (s + n), with one prior and strength for all
            others = [(found[o]["rate"], *counts[o]) for o in found if counts[o] != (n, bad)]
            rate2, n2, bad2 = others[0]
            a = np.array([[1, -x["rate"]], [1, -rate2]])
            prior_s, strength = np.linalg.solve(a, [x["rate"] * n - bad, rate2 * n2 - bad2])
        shape = x["rate"] * (strength + n), (1 - x["rate"]) * (strength + n)
        density = np.exp((shape[0] - 1) * np.log(grid) + (shape[1] - 1) * np.log1p(-grid))
        exact = grid[np.searchsorted(np.cumsum(density) / density.sum(), 0.05)]
        assert abs(x["low"] - exact) < 0.02, (host, x["low"], exact, shape)
        assert out[host] == ("block" if x["low"] >= base else "allow")
    assert {"block", "allow"} == set(out.values())


@pytest.mark.parametrize(
    "host, suffix, domain",
    [("www.a.co.uk", "co.uk", "a.co.uk"), ("a.co.uk", "co.uk", "a.co.uk"), ("x.y.example.com:8080", "com", "example.com"), ("u@b.example.org", "org", "example.org"),
     ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("localhost", "localhost", "localhost"), ("", "", ""), ("shop.com.co", "com.co", "shop.com.co")],
)
def test_registered_domains(spark, host, suffix, domain):
    assert tuple(spark.range(1).select(*url_reputation.registered(F.lit(host))).first()) == (suffix, domain)


def picked(text, k=winnow.K, w=winnow.WINDOW):
    """Positions that winnowing by definition chooses, given the hashes that Spark computes."""
    n = max(len(text) - w + 1, 1) if text else 0
    out = []
    for i in range(n):
        window = text[i : i + w]
        least = min(window)
        out.append(i + max(x for x, v in enumerate(window) if v == least))
    return sorted(set(out))


def test_winnowing_by_definition(spark, docs):
    texts = [" ".join(words(n, n)) for n in (1, 4, 5, 16, 17, 60, 300)] + ["a " * 80, " lead and trail ", "", None, " \n"]
    table = docs(*enumerate(texts))
    found = {r["doc_id"]: r for r in winnow.fingerprints(table).collect()}
    for i, text in enumerate(texts):
        ws = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        grams = [ws[x : x + winnow.K] for x in range(max(len(ws) - winnow.K + 1, 1 if ws else 0))]
        frame = spark.createDataFrame([(x, g) for x, g in enumerate(grams)], "i int, g array<string>")
        values = F.shiftrightunsigned(F.xxhash64(F.transform("g", lambda v: F.xxhash64(v))), 32)
        hashes = [r["v"] for r in frame.select("i", values.alias("v")).orderBy("i").collect()] if grams else []
        want = " ".join(f"{hashes[p]:x}:{p}" for p in picked(hashes))
        assert found[i]["fingerprint"] == want, i


def test_edited_and_next(docs):
    texts = {3: "abcdef", 2: "XY", 1: "", 9: "tail " * 40_000, None: "none!"}
    table = docs(*texts.items(), (2, "XY"))
    rows = winnow.fingerprints(table).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert got[3][0]["edited_sha256"] == sha("abcXY") and got[3][0]["n_chars"] == 6
    assert sorted(r["edited_sha256"] for r in got[2]) == sorted([sha("XX"), sha("X")])
    assert got[1][0]["edited_sha256"] == sha("") and got[None][0]["edited_sha256"] == sha("nonta")
    assert len(rows) == 6 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    alone = winnow.fingerprints(docs((1, "a b c d e f g"))).first()
    assert alone["near_next"] == 1.0 and winnow.fingerprints(table.limit(0)).count() == 0


def test_many_buckets_keep_the_order(docs, monkeypatch):
    monkeypatch.setattr(winnow, "COARSE", 4)
    monkeypatch.setattr(winnow, "BUCKET_CHARS", 1)
    ids = [i * i for i in range(60)]
    rows = {r["doc_id"]: r for r in winnow.fingerprints(docs(*[(i, f"{i:04d}" * 2) for i in ids])).collect()}
    order = sorted(ids, reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        assert rows[a]["edited_sha256"] == hashlib.sha256(f"{a:04d}{b:04d}".encode()).hexdigest()


@pytest.mark.parametrize("coarse, chars", [(8, 1), (8, 40), (128, 32_000_000)])
def test_every_row_against_a_plain_version(spark, docs, monkeypatch, coarse, chars):
    """Edited texts, both fingerprints and both likenesses, with one id and one text on very many rows."""
    monkeypatch.setattr(winnow, "COARSE", coarse)
    monkeypatch.setattr(winnow, "BUCKET_CHARS", chars)
    rows = [(5, " ".join(words(n % 30, n))) for n in range(60)] + [(5, "one text of many copies")] * 60
    rows += [(i, " ".join(words(9 + i, i))) for i in range(20)] + [(None, f"no id {i % 3}") for i in range(12)] + [(7, None)]
    table = docs(*rows)
    hashed = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.shiftright(F.xxhash64("text"), winnow.COPY_BITS)).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] if r["doc_id"] is not None else -(2**63), r["h"]), reverse=True)
    texts = [r["text"] for r in order]
    plain = []
    for mine, after in zip(texts, texts[1:] + texts[:1]):
        half = len(mine) // 2
        plain.append((mine, mine[: len(mine) - half] + after[:half], after))
    every = sorted({t for x in plain for t in x})
    prints = {r["t"]: r["p"] for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", winnow.as_text(winnow.chosen(F.col("t"))).alias("p")).collect()}
    sets = {t: {x.split(":")[0] for x in p.split()} for t, p in prints.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    want = [
        (r["doc_id"], len(a), hashlib.sha256(e.encode()).hexdigest(), prints[a], prints[e], round(like(a, e), 9), round(like(a, b), 9))
        for r, (a, e, b) in zip(order, plain)
    ]
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in winnow.fingerprints(table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


LINE = "this line is on many sites"


@pytest.fixture(params=[10_000, 0])
def listed(request, monkeypatch):
    """Either way to clean the texts: spread lines in an expression, and by a join."""
    monkeypatch.setattr(line_dedup, "LISTED", request.param)


def test_line_dedup(docs, listed):
    rows = [(i, f"own text number {i} here ok\n{LINE if i % 2 else ' this  line is on many\tsites '}\nsame", f"s{i % 9}") for i in range(12)]
    rows += [(50, "only one site says this line", "s1")] * 12 + [(60, None, None), (61, "", "s1"), (None, LINE, "s11"), (62, LINE + "\n" + LINE, None)]
    out = line_dedup.report(docs(*rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"].split("\n")[1].strip() and got[0]["n_removed"] == 0
    assert all(got[i]["text"] == f"own text number {i} here ok\nsame" for i in range(1, 12))
    assert got[50]["n_removed"] == 0 and got[60]["text"] == "" and got[61]["n_lines"] == 1
    assert got[62]["text"] == "" and got[62]["n_removed"] == 2 and got[None]["text"] == "" and out.count() == len(rows)
    stage = line_dedup.dedup_stage(docs(*rows))
    assert stage.columns == docs(*rows).columns and stage.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in stage.collect() if r["text"] is not None)
    assert [r["text"] for r in stage.where("doc_id = 60").collect()] == [None]
    assert line_dedup.report(docs(*rows).limit(0)).count() == 0


@pytest.mark.parametrize("sites, gone", [(9, False), (10, True), (11, True)])
def test_threshold_is_exact(docs, listed, sites, gone):
    rows = [(i, LINE, f"s{i % sites}") for i in range(40)]
    got = line_dedup.report(docs(*rows)).where("doc_id > 0")
    assert {r["text"] == "" for r in got.collect()} == {gone}


def test_short_lines_are_judged_by_their_sites(docs, listed):
    few = "only here"
    rows = [(i, f"own {i}\n\n All  rights reserved.\nYes.\n{few if i < 9 else i}\n", f"s{i}") for i in range(12)]
    want = {i: f"own {i}\n\n{few if i < 9 else i}\n" for i in range(1, 12)} | {0: rows[0][1]}
    for out in (line_dedup.dedup_stage(docs(*rows)), line_dedup.report(docs(*rows))):
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want


def test_lines_with_clashing_columns_and_long_texts(docs, listed):
    long = "\n".join(f"line {i}" for i in range(60_000))
    table = docs(*[(i, f"{LINE}\n{i}", f"s{i}") for i in range(12)], (99, long, "s1"), (5, f"{LINE}\n5", "s5"), (None, None, None))
    for name in ("__lx_line", "kept", "lines", "doc", "k1", "r1", "at", "first"):
        table = table.withColumn(name, F.lit(name))
    out = line_dedup.dedup_stage(table)
    rows = out.collect()
    assert out.columns == table.columns and len(rows) == 15 and all(r["kept"] == "kept" and r["at"] == "at" for r in rows)
    assert sorted(r["text"] for r in rows if r["doc_id"] == 5) == ["5", "5"] and [r["text"] for r in rows if r["doc_id"] == 99] == [long]
