import random

import pytest

from codelattice.operators.hierarchy import descendants, hierarchy, paths


def brute(links):
    par = {}
    for c, p in links:
        if c is not None and p is not None:
            par[c] = min(par.get(c, p), p)
    out = {}
    for n in set(par) | set(par.values()):
        seen, x, d = {n}, n, 0
        while x in par:
            x, d = par[x], d + 1
            if x in seen:
                x, d = "(cycle)", -1
                break
            seen.add(x)
        out[n] = (x, d)
    # a node below a ring never comes back to itself but its line never ends
    return out, par


def check(spark, links, **kw):
    df = spark.createDataFrame(links, "child string, parent string")
    rows = hierarchy(df, **kw).collect()
    want, par = brute(links)
    assert len(rows) == len(want)
    assert {r.node_id: (r.root_id, r.depth) for r in rows} == want
    by = {r.node_id: r for r in rows}
    for r in rows:
        if r.depth > 0:
            up = by[par[r.node_id]]
            assert up.entry < r.entry < r.exit < up.exit and r.parent_id == up.node_id
        assert r.depth >= 0 or (r.entry is None and r.exit is None)
    kids = {}
    for r in rows:
        if r.depth >= 0:
            kids.setdefault(r.root_id, []).append(r)
    for group in kids.values():
        assert len({r.entry for r in group}) == len(group)
        root = next(r for r in group if r.depth == 0)
        assert (root.exit - root.entry - 1) // 2 == len(group) - 1


@pytest.fixture
def small_skew(monkeypatch):
    """Every key with more than a few rows counts as heavy."""
    from codelattice.plans import skew

    monkeypatch.setattr(skew.split_join, "__defaults__", ("inner", 8, 3))


def test_heavy_parents_and_roots(spark, small_skew):
    links = [(f"w{i}", "top") for i in range(30)] + [(f"x{i}", f"w{i % 3}") for i in range(20)] + [("a", "b"), ("b", "a"), *((f"y{i}", "a") for i in range(9))]
    check(spark, links, finish=5)


@pytest.mark.parametrize("kw", [{}, {"finish": 8}, {"finish": 20, "wide": 7}])
def test_random_forest_with_rings(spark, kw):
    rnd = random.Random(5)
    links = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60) if i % 11]
    links += [(f"w{i}", "n3") for i in range(25)]
    links += [(f"c{i}", f"c{i + 1}") for i in range(40)]
    links += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("b1", "r1"), ("b2", "b1"), ("s", "s"), ("t", "s")]
    check(spark, links + links[:9], **kw)


@pytest.mark.parametrize("shape", ["roots", "rings"])
def test_more_trees_and_rings_than_one_task_holds(spark, shape):
    """Lists and rings that are one element each never shrink below their number."""
    if shape == "roots":
        links = [(f"{x}{i}", f"{y}{i}") for i in range(20) for x, y in (("a", "r"), ("b", "a"), ("c", "a"), ("d", "c"))]
    else:
        links = [(f"a{i}", f"r{i}") for i in range(20)] + [(f"r{i}", f"{'a' if i % 4 else 'r'}{i}") for i in range(20)] + [(f"b{i}", f"a{i}") for i in range(9)] + [(f"c{i}", f"b{i}") for i in range(5)]
    check(spark, links, finish=4)


def test_dirty(spark):
    check(spark, [("a", "b"), ("a", "b"), (None, "x"), ("y", None), ("", "b"), ("ü", "a" * 5000)])


def test_ring_only_and_single(spark):
    check(spark, [("a", "b"), ("b", "a")])
    check(spark, [("a", "r")])


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "child string, parent string, node long, entry string")
    assert hierarchy(df).count() == 0
    df = spark.createDataFrame([("a", "b", 1, "e")], "child string, parent string, node long, entry string")
    assert {(r.node_id, r.depth) for r in hierarchy(df).collect()} == {("a", 1), ("b", 0)}


@pytest.mark.parametrize("kw", [{}, {"block_rows": 3, "elements": 7}, {"block_rows": 1, "elements": 1}])
def test_paths_and_descendants(spark, kw):
    rnd = random.Random(9)
    links = [(f"n{i}", f"n{rnd.randrange(max(0, i - 4), i)}") for i in range(1, 40)] + [("x", "y"), ("r0", "r1"), ("r1", "r0"), ("b", "r0")]
    h = hierarchy(spark.createDataFrame(links, "child string, parent string"))
    par = dict(links)

    def up(n):
        return [*up(par[n]), n] if n in par else [n]

    nodes = [n for n in {x for link in links for x in link} if n not in ("r0", "r1", "b")]
    assert {r.node_id: r.path for r in paths(h, **kw).collect()} == {n: up(n) for n in nodes}
    got = {(r.node_id, r.descendant_id): r.levels for r in descendants(h, **kw).collect()}
    assert got == {(a, n): len(up(n)) - 1 - i for n in nodes for i, a in enumerate(up(n)[:-1])}
    empty = hierarchy(spark.createDataFrame([], "child string, parent string"))
    assert paths(empty).count() == 0 and descendants(empty).count() == 0


def test_descendant_rows_are_a_query(spark, tmp_path):
    from codelattice.operators.entry import QUERIES

    spark.createDataFrame([("CONTAINS", "a", "b"), ("contains", "b", "c"), ("CONTAINS", "b", "d"), ("CALLS", "d", "e"), ("CONTAINS", "x", "y"), ("CONTAINS", "y", "x"), ("CONTAINS", "b", None)], "kind string, src_node_id string, dst_node_id string").write.parquet(f"{tmp_path}/edges.parquet")
    rows = QUERIES["p3_descendant_rows"](spark, str(tmp_path)).collect()
    assert sorted((r.node_id, r.descendant_id, r.levels) for r in rows) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
    n = {r.node_id: r.descendants for r in QUERIES["p3_descendants"](spark, str(tmp_path)).collect()}
    assert {k: sum(r.node_id == k for r in rows) for k in n} == n
    assert all(r.exit - r.entry - 1 == 2 * n[r.node_id] for r in rows)
