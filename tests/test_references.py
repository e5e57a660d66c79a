import datetime as dt
import random

from codelattice.operators.references import live_nodes, orphan_edges, orphan_report, orphan_rows, orphan_suppressions

T = lambda m, d=1: dt.datetime(2025, m, d)
NODE = "node_id string, branch string, repo_id string, file_path string, last_promoted_at timestamp_ntz"
TOMB = "repo_id string, branch string, file_path string, deleted_at timestamp_ntz"


def tables(spark):
    nodes = spark.createDataFrame([("a", "m", "r", "f1", T(1)), ("a", "m", "r", "f1", T(5)), ("b", "m", "r", "f2", T(1)), ("c", "m", "r", None, T(1)), ("d", "m", "r", "f2", T(3)), ("e", "m", "r", "f1", None), (None, "m", "r", "f1", T(9))], NODE)
    gone = spark.createDataFrame([("r", "m", "f1", T(4)), ("r", "m", "f1", T(2)), ("r", "m", "f2", T(3))], TOMB)
    return nodes, gone


def test_live(spark):
    assert {r.node_id for r in live_nodes(*tables(spark)).collect()} == {"a", "c", None}


def test_edges(spark):
    rows = [("e1", "a", "m", T(2)), ("e2", "b", "m", T(2)), ("e3", "a", "x", T(3)), ("e4", None, "m", T(3)), ("e5", "zz", None, None), ("e2", "b", "m", T(2))]
    e = spark.createDataFrame([(*r, "x") for r in rows], "edge_id string, dst_node_id string, branch string, last_promoted_at timestamp_ntz, node_id string")
    got = sorted(tuple(r) for r in orphan_edges(e, *tables(spark)).distinct().collect() if r.period)
    assert got == [("edges", "e2", "m", "2025-02"), ("edges", "e3", "x", "2025-03"), ("edges", "e4", "m", "2025-03")]
    assert {r.ref_id for r in orphan_edges(e, *tables(spark)).where("period IS NULL").collect()} == {"e5"}


def test_report_counts_what_is_found(spark):
    rnd = random.Random(3)
    nodes = spark.createDataFrame([(f"n{i}", "m", "r", "f1", T(5)) for i in range(0, 30, 2)], NODE)
    gone = spark.createDataFrame([("r", "m", "f1", T(4))], TOMB)
    rows = [(f"e{i}", rnd.choice(["hot", "n0", None, f"n{rnd.randrange(40)}"]), rnd.choice(["m", "m", None, "x"]), rnd.choice([T(1), T(2), None])) for i in range(400)]
    e = spark.createDataFrame(rows + rows[:90], "edge_id string, dst_node_id string, branch string, last_promoted_at timestamp_ntz")
    s = spark.createDataFrame([(f"s{i}", rnd.choice(["finding", "file", "odd", None]), rnd.choice(["hot", " F1", "f1", None]), rnd.choice(["m", None]), rnd.choice([T(1), T(7)])) for i in range(200)], "suppression_id string, scope string, target string, branch string, created_at timestamp_ntz")
    f, x, r = spark.createDataFrame([("f1",)], "finding_id string"), spark.createDataFrame([("f1",)], "file_path string"), spark.createDataFrame([("r",)], "repo_id string")
    found = orphan_edges(e, nodes, gone).unionByName(orphan_suppressions(s, f, nodes, gone, x, r)).distinct().collect()
    want = {}
    for o in found:
        want[(o.ref_table, o.period)] = want.get((o.ref_table, o.period), 0) + 1
    for kw in ({}, {"floor": 5, "share": 20}):
        assert {(o.ref_table, o.period): o.orphans for o in orphan_report(e, s, f, nodes, gone, x, r, **kw).collect()} == want
    assert orphan_report(e.limit(0), s.limit(0), f, nodes, gone, x, r).count() == 0


def test_heavy_keys_equal_light(spark):
    rnd = random.Random(1)
    keys = ["hot1"] * 400 + ["hot2"] * 300 + [f"k{rnd.randrange(60)}" for _ in range(300)] + [None] * 5
    refs = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    there = spark.createDataFrame([("hot1",), ("hot1",), *[(f"k{i}",) for i in range(0, 60, 2)], (None,)], "k string")
    want = sorted(i for i, k in enumerate(keys) if k is None or k == "hot2" or k[0] == "k" and int(k[1:]) % 2)
    for kw in ({}, {"floor": 10, "share": 20}):
        assert sorted(r.i for r in orphan_rows(refs, ["k"], there, **kw).collect()) == want
    assert orphan_rows(refs, ["k"], there.limit(0), floor=10, share=20).count() == len(keys)
    assert orphan_rows(refs.limit(0), ["k"], there).count() == 0


def test_suppressions(spark):
    nodes, gone = tables(spark)
    s = spark.createDataFrame(
        [("s1", "finding", " F1 ", None, T(1)), ("s2", "finding", "nope", "m", T(1)), ("s3", "symbol", "A", "m", T(1)), ("s4", "symbol", "b", "m", T(2)), ("s5", "file", "./src/X.go", "m", T(2)), ("s6", "file", "src/x.go", "m", T(2)), ("s7", "repo", "R", "m", T(2)), ("s8", "other", "r", "m", T(2)), ("s9", "file", None, "m", T(2))],
        "suppression_id string, scope string, target string, branch string, created_at timestamp_ntz",
    )
    f, x, r = spark.createDataFrame([("f1",)], "finding_id string"), spark.createDataFrame([("src/X.go",)], "file_path string"), spark.createDataFrame([("r",)], "repo_id string")
    got = {(r.ref_id, r.branch) for r in orphan_suppressions(s, f, nodes, gone, x, r).collect()}
    assert got == {("s2", "m"), ("s4", "m"), ("s6", "m"), ("s8", "m"), ("s9", "m")}
