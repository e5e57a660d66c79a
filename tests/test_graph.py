import random
from datetime import datetime

import pytest

from codelattice.operators.clones import groups_by_hash, propagate_labels
from codelattice.operators.gates import changed_nodes, scope_guard
from codelattice.operators.graph import blast_radius, covering, file_reach, hot_zones, strong_components

E = "src string, dst string"


def test_blast_distance_hub_and_cap(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), *[(f"x{i}", "b") for i in range(4)], ("a", "a"), (None, "a"), ("b", "a")], E)
    seeds = spark.createDataFrame([("o", "a"), ("p", "c"), ("p", "lonely"), ("q", None)], "origin string, node string")
    got = {(r.origin, r.node): (r.distance, r.is_hub) for r in blast_radius(edges, seeds, hub=None).collect()}
    assert got[("o", "d")] == (3, False) and ("o", "e") not in got and got[("p", "lonely")] == (0, False) and got[("p", "e")] == (2, False)
    gated = {r.node: r.is_hub for r in blast_radius(edges, seeds.where("origin = 'o'"), hub=4).collect()}
    assert gated == {"a": False, "b": True}  # five entries: reported, not expanded
    few = blast_radius(edges, seeds.where("origin = 'o'"), hub=None, cap=3).collect()
    assert sorted(r.node for r in few) == ["a", "b", "c"]
    ahead = {r.node for r in blast_radius(edges, spark.createDataFrame([("o", "d")], "origin string, node string"), "callees", hub=None).collect()}
    assert ahead == {"d", "c", "b", "a"}
    assert blast_radius(edges.limit(0), seeds.limit(0)).count() == 0


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if sum(m in reach[n] and n in reach[m] for m in nodes) > 1}


def test_strong_components(spark):
    rnd = random.Random(6)
    pairs = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(32)] + [("z1", "z2"), ("z2", "z1"), ("s", "s")]
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame([*pairs, ("s", "s"), (None, "n1")], E)
    for finish in (1_000, 0):
        assert {r.node: r.component for r in strong_components(df, finish=finish).collect()} == brute_scc(pairs)
    assert strong_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [9, 40])
def test_strong_components_side_by_side(spark, finish):
    """Groups that one task holds leave the rounds; ids are longs on the way."""
    rnd = random.Random(8)
    pairs = [(f"{g}{rnd.randrange(6)}", f"{g}{rnd.randrange(6)}") for g in "abcd" for _ in range(10)] + [("a0", "b0"), ("b0", "c0"), ("c0", "d0")]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r.node: r.component for r in strong_components(spark.createDataFrame(pairs, E), finish=finish, direct=0).collect()}
    assert got == brute_scc(pairs)


def test_one_large_ring_needs_no_rounds(spark, monkeypatch):
    def no(*_):
        raise AssertionError("rounds over a table that one task holds as longs")

    monkeypatch.setattr("codelattice.operators.graph._least_reaching", no)
    ring = spark.range(120_000).selectExpr("concat('n', id) AS src", "concat('n', (id + 1) % 120000) AS dst")
    found = strong_components(ring)
    assert {(r.component, r["count"]) for r in found.groupBy("component").count().collect()} == {("n0", 120_000)}


def test_labels_and_groups(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), *[(f"l{i:02d}", f"l{i + 1:02d}") for i in range(20)]], "a string, b string")
    for finish in (1_000, 0):
        got = {r.node: r.component for r in propagate_labels(df, finish=finish).collect()}
        assert len(got) == 26 and got["c"] == "a" and got["y"] == "x" and got["l20"] == "l00"
    assert propagate_labels(df.limit(0)).count() == 0
    g = groups_by_hash(spark.createDataFrame([("h", 1), ("h", 2), ("h", 3), ("", 4), ("", 5), (None, 6), ("q", 7)], "k string, m int"), "k", ["m"], preview=2).collect()
    assert [(r.k, r["size"], r.members) for r in g] == [("h", 3, ["1", "2"])]


def test_changes_and_guard(spark):
    n = "node_id string, branch string, content_hash string"
    base = spark.createDataFrame([("a", "m", "1"), ("b", "m", None), ("c", "m", "3")], n)
    after = spark.createDataFrame([("a", "m", "2"), ("b", "m", None), ("d", "m", None)], n)
    assert {(r.node_id, r.change) for r in changed_nodes(base, after).collect()} == {("a", "modified"), ("c", "removed"), ("d", "added")}
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node string")
    edges = spark.createDataFrame([("k", "n1"), ("n2", "n1"), ("n3", "z")], E)
    assert {r.node for r in scope_guard(one("k", "n2", "n3", "o"), one("k"), one("n1", "n2", "n3"), edges).collect()} == {"n3", "o"}


def test_covering_walks_to_the_end_and_through_helpers(spark):
    chain = [("TestFar", "c14"), *[(f"c{i + 1}", f"c{i}") for i in range(14)], ("c0", "c3")]
    calls = spark.createDataFrame([*chain, ("helper", "c0"), ("TestNear", "helper"), ("TestOuter", "TestNear"), ("suite", "helper"), ("Testify", "c0"), ("TestProd", "c0")], "src string, dst string")
    named = [("TestFar", "a/far_test.go", "function"), ("TestNear", "a/near_test.go", "function"), ("TestOuter", "a/near_test.go", "function"), ("helper", "a/near_test.go", "function"), ("suite", "a/near_test.go", "method"), ("Testify", "a/near_test.go", "function"), ("TestProd", "a/prod.go", "function"), *[(f"c{i}", "a/a.go", "function") for i in range(15)], ("nameless", None, None)]
    nodes = spark.createDataFrame([(n, None if n == "nameless" else n, f, k) for n, f, k in named], "node_id string, symbol_path string, file_path string, kind string")
    seeds = spark.createDataFrame([("all", "c0")], "origin string, node string")
    assert {(r.node, r.distance) for r in covering(calls, nodes, seeds).collect()} == {("TestFar", 15), ("TestNear", 2)}
    assert covering(calls.limit(0), nodes, seeds.limit(0)).count() == 0


def _graph(spark, d):
    """Files of one symbol each, called in a row but for one import; a type nobody calls but one route; and a finding."""
    at = datetime(2026, 6, 15)
    kinds = {"f0": "function", "f1": "function", "f2": "function", "f3": "function", "f4": "function", "t": "struct", "r": "function", "p": "package"}
    nodes = [(k, "main", "r1", f"a/{k}.go", kind, k, "go", k, at) for k, kind in kinds.items()]
    spark.createDataFrame(nodes, "node_id string, branch string, repo_id string, file_path string, kind string, symbol_path string, language string, content_hash string, last_promoted_at timestamp_ntz").write.parquet(f"{d}/nodes.parquet")
    edges = [("f1", "f0", "CALLS"), ("f2", "f1", "CALLS"), ("f3", "f2", "IMPORTS"), ("f4", "f3", "CALLS"), ("r", "t", "ROUTES"), ("p", "t", "CONTAINS")]
    spark.createDataFrame([(s + t, "main", s, t, k, None, at, None, None) for s, t, k in edges], "edge_id string, branch string, src_node_id string, dst_node_id string, kind string, score float, last_promoted_at timestamp_ntz, confidence string, resolved boolean").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([("x", "main", "r1", "a/t.go", "t", "open", "high", at)], "finding_id string, branch string, repo_id string, file_path string, node_id string, state string, severity string, created_at timestamp_ntz").write.parquet(f"{d}/findings.parquet")
    spark.createDataFrame([], "repo_id string, branch string, file_path string, deleted_at timestamp_ntz").write.parquet(f"{d}/deleted_files.parquet")


def test_reach_of_files_goes_three_hops_over_every_kind(spark, tmp_path):
    from codelattice.operators.packs import change_report

    d = str(tmp_path)
    _graph(spark, d)
    zones = {r.file_path: (r.changes, r.blast) for r in hot_zones(spark, d).collect()}
    assert zones["a/f0.go"] == (1, 4) and zones["a/t.go"] == (1, 3) and zones["a/p.go"] == (1, 1) and len(zones) == 8
    report = {r.file_path: (r.symbols, r.callers, r.findings, r.risk) for r in change_report(spark, d).collect()}
    assert report["a/f0.go"] == (1, 3, 0, 4) and report["a/t.go"] == (1, 1, 1, 7) and report["a/p.go"] == (0, 0, 0, 0) and len(report) == 8
    none = spark.createDataFrame([("n", "r1", None)], "node_id string, repo_id string, file_path string")
    assert file_reach(spark.createDataFrame([], "src string, dst string"), none).count() == 0


def test_caps_are_marked(spark):
    edges = spark.createDataFrame([(f"c{i}", "s") for i in range(9)] + [("d", "c0"), ("e", "t")], "src string, dst string")
    seeds = spark.createDataFrame([("one", "s"), ("two", "t"), ("three", "alone")], "origin string, node string")
    out = blast_radius(edges, seeds, cap=5, mark=True).collect()
    by = {o: (sorted(r.node for r in out if r.origin == o), {r.truncated for r in out if r.origin == o}) for o in ("one", "two", "three")}
    assert by == {"one": (["c0", "c1", "c2", "c3", "s"], {True}), "two": (["e", "t"], {False}), "three": (["alone"], {False})}
    assert {r.truncated for r in blast_radius(edges, seeds, mark=True).collect()} == {False}
    assert "truncated" not in blast_radius(edges, seeds, cap=5).columns


def test_call_edges_by_direction(spark):
    from codelattice.operators.graph import call_edges

    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("p", "b"), ("x", "a"), ("b", "b")], "src string, dst string")
    kinds = spark.createDataFrame([("p", "package"), ("a", "function"), ("b", "function"), ("c", None)], "node string, kind string")
    seed = spark.createDataFrame([("all", "b")], "origin string, node string")
    got = lambda way, depth=3: {(r.src, r.dst): r.hop for r in call_edges(calls, kinds, seed, way, depth).collect()}
    assert got("out") == {("b", "c"): 1, ("b", "b"): 1}
    assert got("in") == {("a", "b"): 1, ("b", "b"): 1, ("x", "a"): 2}
    assert got("both", 1) == {("b", "c"): 1, ("b", "b"): 1, ("a", "b"): 1}
