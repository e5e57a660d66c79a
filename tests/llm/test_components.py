import random

from codelattice.llm import components as C


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


def groups(spark, pairs):
    rows = C.components(spark.createDataFrame(pairs, "src string, dst string")).collect()
    found = {r.node_id: r.group_id for r in rows}
    assert len(found) == len(rows)
    return found


def test_random_chain_and_star(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(90)}", f"n{rnd.randrange(90)}") for _ in range(60)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"h{i}") for i in range(40)]
    pairs += pairs[:5] + [(b, a) for a, b in pairs[5:10]]
    assert groups(spark, pairs) == brute(pairs)


def test_hubs_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(C, "HUB_FLOOR", 5)
    monkeypatch.setattr(C, "HUB_SHARE", 10)
    pairs = [("m", f"x{i}") for i in range(60)] + [("x3", "a"), ("x3", None), ("q", "q"), ("", "y")]
    assert groups(spark, pairs) == brute(pairs)


def test_empty_and_extra_columns(spark):
    assert groups(spark, []) == {}
    df = spark.createDataFrame([("b", "a", 1, "z")], "src string, dst string, u long, v string")
    assert {(r.node_id, r.group_id) for r in C.components(df).collect()} == {("a", "a"), ("b", "a")}
