import datetime as dt

import numpy as np

from pyspark.sql import functions as F

from codelattice.operators.packs import candidates, clip_to_budget, cross_repo_score, finding_events, first_json, frameworks
from codelattice.operators.search import bm25, fuse, rerank, substring_hits, tiers, top_k
from codelattice.operators.vectors import exact_search, hashed_search

t = lambda d: dt.datetime(2025, 1, d)


def test_events_need_a_human(spark):
    f = spark.createDataFrame([("a", "m", "high", "open", None, None), ("b", "m", "low", "open", None, None), ("c", "m", None, "closed", "fixed", t(1))], "finding_id string, branch string, severity string, state string, closed_reason string, closed_at timestamp_ntz")
    e = spark.createDataFrame([("a", "m", "close", "x", t(2), "agent"), ("b", "m", "close", "accept", t(2), "agent"), ("b", "m", "close", "stale", t(3), "agent"), ("c", "m", "reopen", None, t(4), "human")], "finding_id string, branch string, op string, reason string, at timestamp_ntz, actor_kind string")
    assert {r.finding_id: (r.state, r.closed_reason) for r in finding_events(f, e).collect()} == {"a": ("open", None), "b": ("closed", "stale"), "c": ("open", None)}
    assert finding_events(f, e.limit(0)).where("state = 'open'").count() == 2


def test_json_and_frameworks(spark):
    df = spark.createDataFrame([(1, 'so {"a": "}{", "b": {"c": "\\""}} and {}'), (2, "none"), (3, None), (4, "{open")], "i int, s string")
    assert {r.i: r.j for r in df.select("i", first_json("s").alias("j")).collect()} == {1: '{"a": "}{", "b": {"c": "\\""}}', 2: None, 3: None, 4: None}
    src = 'r.GET("/users/:id", h)\nmux.HandleFunc("/x", f)\nvar c = &cobra.Command{\n\tUse: "serve [x]",\n}\nr.GET("/users/:id", h)'
    got = frameworks(spark.createDataFrame([("r", "m", "f", src), ("r", "m", "g", None)], "repo_id string, branch string, file_path string, content string")).collect()
    assert {(r.kind, r.name) for r in got} == {("route", "/users/:id"), ("route", "/x"), ("command", "serve")}


def test_ranking(spark):
    docs = spark.createDataFrame([("d1", ["parse", "file"]), ("d2", ["parse", "parse", "tree"]), ("d3", ["other"]), ("d4", []), ("d5", ["tree"])], "doc_id string, tokens array<string>")
    q = spark.createDataFrame([("q", ["parse", "parse", "zzz"]), ("none", ["zzz"]), ("empty", [])], "query_id string, tokens array<string>")
    hits = bm25(docs, q).collect()
    n, df, al = 4, 2, 7 / 4
    want = lambda tf, ln: max(1e-6, np.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * ln / al))
    assert [(r.query_id, r.doc_id) for r in sorted(hits, key=lambda r: r["rank"])] == [("q", "d2"), ("q", "d1")] and abs(hits[0].score - want(2, 3)) < 1e-6
    assert bm25(docs.limit(0), q).count() == 0
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, doc_id string, rank int")
    got = {r.doc_id: (round(r.score, 6), r["rank"]) for r in top_k(fuse([a, b]), None).collect()}
    assert got == {"y": (round(1 / 62 + 1 / 61, 6), 1), "x": (round(1 / 61, 6), 2), "z": (round(1 / 62, 6), 3)}
    text = spark.createDataFrame([("d1", "ParseFile"), ("d2", "x"), ("d3", None)], "doc_id string, text string")
    ph = spark.createDataFrame([("q", 'sefi'), ("r", "pa"), ("s", '"FILE"')], "query_id string, phrase string")
    assert {(r.query_id, r.doc_id) for r in substring_hits(text, ph).collect()} == {("q", "d1"), ("s", "d1")}


def test_rerank_and_tiers(spark):
    rows = [("q", "a", 1.0, ["load"], "Store.load", "method", "s/store.go"), ("q", "b", 1.0, ["load"], "x", "package", "s/store.go"), ("q", "c", 1.0, ["load"], "other", "function", "s/a_test.go"), ("q", "d", 0.5, ["load"], None, "function", None)]
    h = spark.createDataFrame(rows, "query_id string, doc_id string, score double, tokens array<string>, symbol_path string, kind string, file_path string")
    got = {r.doc_id: round(r.score, 4) for r in rerank(h).collect()}
    assert got == {"a": round(1 + 1 + 0.25 + 0.05, 4), "b": round((1 + 0.05) * 0.5, 4), "c": 0.6, "d": 0.5}
    x = {r.doc_id: (r.tier, r.normal) for r in tiers(spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.9), ("q", "c", 0.2), ("z", "a", 0.0)], "query_id string, doc_id string, score double").where("query_id = 'q'")).collect()}
    assert x == {"a": ("top", 1.0), "b": ("strong", 0.875), "c": ("weak", 0.0)}


def test_cross_repo_and_budget(spark):
    v = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.8)], "query_id string, doc_id string, rank int, score double")
    x = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("r", "c", 1)], "query_id string, doc_id string, rank int")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in cross_repo_score(candidates(v, x)).collect()}
    assert got == {("q", "a"): 0.9, ("q", "b"): 0.84, ("q", "c"): round(1 / 62, 6), ("r", "c"): round(1 / 61, 6)}
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "i int, n int")
    assert [r.i for r in clip_to_budget(rows, [F.col("i")], "n", 10).orderBy("i").collect()] == [1, 2]


def test_hashed_search_recall(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(30, 24))
    x = c[rng.integers(30, size=600)] + 0.2 * rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(9000, None), (9001, [float("nan")] * 24)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0 AND vec_id < 9000")
    want = {(r.query_id, r.vec_id) for r in exact_search(df, q).collect()}
    got = {(r.query_id, r.vec_id) for r in hashed_search(df, q, profile="accurate").collect()}
    assert len(want & got) / len(want) >= 0.9
