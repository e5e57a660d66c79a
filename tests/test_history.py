import datetime as dt

from pyspark.sql import functions as F

from codelattice.operators import history as H

t = lambda d, h=0: dt.datetime(2025, 6, d, h)


def log(spark):
    rs, us = H.RECORD, H.FIELD
    rec = lambda h, p, a, x, y, files: rs + us.join([h, p, a, x, y, "msg"]) + "\n" + "\n".join(files) + "\n"
    one = rec("c1", "", "ann", "2025-06-01T00:00:00Z", "2025-06-01T00:00:00Z", ["a", "b"]) + rec("c2", "c1", "bob", "2025-06-02T00:00:00Z", "2025-06-20T00:00:00Z", ["a"]) + rec("c3", "c2 c1", "cy", "2025-06-03T00:00:00Z", "2025-06-21T00:00:00Z", ["a", "", "c"]) + rs + "broken\nq\n"
    return H.commit_log(spark.createDataFrame([("r", one), ("s", ""), ("u", None)], "repo_id string, log string"))


def test_log_history_and_owners(spark):
    commits, files = log(spark)
    assert {(r.hash, tuple(r.parents)) for r in commits.collect()} == {("c1", ()), ("c2", ("c1",)), ("c3", ("c2", "c1"))}
    hist = H.file_history(commits, files, spark.createDataFrame([("r", "a"), ("r", "zz")], "repo_id string, file_path string"), 2).orderBy("place").collect()
    assert [r.hash for r in hist] == ["c3", "c2"]
    assert {r.file_path: r.changes for r in H.change_counts(commits, files, "2025-06-21", 10).collect()} == {"a": 2, "c": 1}
    assert {r.file_path: r.author for r in H.last_authors(commits, files).collect()} == {"a": "cy", "b": "ann", "c": "cy"}


def test_ancestors_and_replay(spark):
    n = 40
    rows = [("r", f"h{i:02d}", [f"h{i - 1:02d}"] if i else []) for i in range(n)] + [("r", "side", ["h03"]), ("q", "x1", []), ("q", "x2", ["x1", "gone"]), ("w", "y1", [])]
    c = spark.createDataFrame(rows, "repo_id string, hash string, parents array<string>")
    k = "repo_id string, hash string"
    got = {r.hash for r in H.ancestors(c, spark.createDataFrame([("r", f"h{n - 1:02d}"), ("q", "x2"), ("q", "unknown")], k)).collect()}
    assert got == {f"h{i:02d}" for i in range(n)} | {"x1", "x2"}
    plan = H.replay_plan(c, spark.createDataFrame([("r", "h39"), ("q", "x2"), ("w", "y1"), ("v", "z")], k), spark.createDataFrame([("r", "h30"), ("q", "x2"), ("w", "lost")], k))
    assert {r.repo_id: (r.plan, r.missed) for r in plan.collect()} == {"r": ("replay", 9), "q": ("nothing", 0), "w": ("full scan", 0), "v": ("full scan", 0)}


def test_lanes(spark):
    s = "id int, kind string, state string, attempts int, available_at timestamp, created_at timestamp"
    q = spark.createDataFrame([(1, "a", "pending", 0, None, t(2)), (2, "a", "pending", 2, None, t(1)), (3, "a", "pending", 3, None, t(1)), (4, "b", "done", 0, None, t(1)), (5, "b", "pending", 0, t(20), t(1)), (6, "b", "pending", 0, t(3), t(9))], s)
    now = F.lit(t(10))
    assert {r.id for r in H.claim(q, 1, now).collect()} == {2, 6} and {r.id for r in H.claim(q, 5, now).collect()} == {1, 2, 6}
    out = {r.id: (r.state, r.attempts) for r in H.settle(q, spark.createDataFrame([(1, "defer"), (2, "error"), (6, "done")], "id int, outcome string"), now).collect()}
    assert out[1] == ("pending", 0) and out[2] == ("failed", 3) and out[6] == ("done", 0) and out[5] == ("pending", 0)
    refs = spark.createDataFrame([("n", "ready", 1, "m1"), ("o", "ready", 2, "m2"), ("p", "failed", 3, None)], "node_id string, state string, attempts int, model string")
    assert {r.node_id: (r.state, r.attempts, r.model) for r in H.switch_model(refs, "m1").collect()} == {"n": ("ready", 1, "m1"), "o": ("pending", 0, "m1"), "p": ("pending", 0, "m1")}
