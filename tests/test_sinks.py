import datetime as dt

from codelattice.operators import reports as R
from codelattice.operators.upkeep import promote_files, run_checks
from codelattice.sources import code, sinks

t = lambda h: dt.datetime(2025, 1, 1, h)


def test_vectors_are_saved_with_tries(spark):
    store = spark.createDataFrame([("a", "pending", 0, None), ("b", "pending", 2, None), ("c", "ready", 1, [1.0]), ("d", "pending", 1, None), ("e", "pending", 0, None)], "embed_hash string, state string, attempts int, embedding array<float>")
    got = spark.createDataFrame([("a", [2.0]), ("a", None), ("b", None), ("c", [9.0]), ("d", None), ("z", [1.0])], "embed_hash string, embedding array<float>")
    out = {r.embed_hash: (r.state, r.attempts, r.embedding) for r in sinks.save_vectors(store, got).collect()}
    assert out == {"a": ("ready", 0, [2.0]), "b": ("failed", 3, None), "c": ("ready", 1, [1.0]), "d": ("pending", 2, None), "e": ("pending", 0, None)}


def test_backups(spark, tmp_path):
    d = str(tmp_path / "b")
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    for k, day in enumerate("1 2 3 4".split()):
        stays = sinks.backup(spark, {"t": df}, d, f"2026-01-0{day}", keep=2)
        assert len(stays) == min(k + 1, 2) and stays[0] == f"2026-01-0{day}"
    assert sinks.verify(spark, d, "2026-01-04", {"t": df}) == {"t": True} and sinks.verify(spark, d, "2026-01-04", {"t": df.distinct()}) == {"t": False}
    assert sinks.restore(spark, d, "2026-01-03", ["t"])["t"].count() == 3


def test_audit_rotation(spark, tmp_path):
    d = str(tmp_path / "a")
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        sinks.append_audit(spark.createDataFrame([("TOKEN=x", day)], "m string, on string"), "m", d, day, 2)
    assert {(r.on, r.m) for r in spark.read.json(d).collect()} == {("2026-01-02", "TOKEN=[REDACTED]"), ("2026-01-03", "TOKEN=[REDACTED]")}


def test_index_is_loaded_by_model(spark, tmp_path):
    d = str(tmp_path / "i")
    sinks.save_index(spark.createDataFrame([("a", "m1", "ready", [1.0]), ("b", "m1", "ready", [1.0]), ("c", "m2", "ready", [1.0]), ("d", "m1", "pending", None)], "embed_hash string, model string, state string, embedding array<float>"), d)
    have, lost = sinks.load_index(spark, d, "m1", spark.createDataFrame([("a",), ("c",), ("d",)], "embed_hash string"))
    assert {r.embed_hash for r in have.collect()} == {"a"} and {r.embed_hash for r in lost.collect()} == {"c", "d"}


def test_delete_files_add_vectors_postings(spark):
    n = spark.createDataFrame([("a", "r", "m", "f1", "function", "runFast"), ("b", "r", "m", "f2", "function", "stop"), ("c", "r", "x", "f1", "function", "go")], "node_id string, repo_id string, branch string, file_path string, kind string, symbol_path string")
    e = spark.createDataFrame([("a", "b", "m"), ("b", "b", "m"), ("c", "c", "x"), ("b", "a", "m")], "src_node_id string, dst_node_id string, branch string")
    gone = spark.createDataFrame([("r", "m", "f1")], "repo_id string, branch string, file_path string")
    kept, edges = sinks.delete_files(n, e, gone)
    assert {r.node_id for r in kept.collect()} == {"b", "c"} and {(r.src_node_id, r.dst_node_id) for r in edges.collect()} == {("b", "b"), ("c", "c")}
    s = spark.createDataFrame([("h1", "m")], "embed_hash string, model string")
    assert sinks.add_vectors(s, spark.createDataFrame([("h1", "n"), ("h2", "n"), ("h2", "n")], "embed_hash string, model string")).count() == 2
    assert {(r.term, r.node_id) for r in sinks.postings(n, gone).collect()} == {("function", "a"), ("runfast", "a"), ("run", "a"), ("fast", "a")}


def test_promotion_keeps_the_old_signature(spark):
    cols = "node_id string, repo_id string, branch string, file_path string, content_hash string, signature string, prev_signature string, last_promoted_at timestamp_ntz"
    edge = "edge_id string, branch string, src_node_id string, dst_node_id string, kind string, confidence string"
    old = spark.createDataFrame([("a", "r", "m", "f1", "1", "s1", None, t(1)), ("b", "r", "m", "f1", "1", "s1", None, t(1)), ("c", "r", "m", "f2", "1", "s1", "s0", t(1))], cols)
    new = spark.createDataFrame([("a", "r", "m", "f1", "2", "s2", None, t(2)), ("a", "r", "m", "f1", "2", "s2", None, t(2)), ("d", "r", "m", "f1", "2", "s9", None, t(2))], cols)
    edges = spark.createDataFrame([("e1", "m", "a", "c", "calls", None), ("e2", "m", "c", "a", "calls", None), ("e3", "m", "c", "b", "calls", None)], edge)
    came = spark.createDataFrame([("e4", "m", "d", "c", "calls", None), ("e5", "m", "d", "zz", "calls", None)], edge)
    n, e = promote_files(old, edges, new, came)
    assert {(r.node_id, r.signature, r.prev_signature) for r in n.collect()} == {("a", "s2", "s1"), ("d", "s9", None), ("c", "s1", "s0")}
    assert {r.edge_id for r in e.collect()} == {"e2", "e4"}


def test_check_run(spark):
    c = "finding_id string, branch string, node_id string"
    now = {"x": spark.createDataFrame([("1", "m", "a"), ("1", "m", "a"), ("2", "m", "b"), (None, "m", "q")], c), "y": spark.createDataFrame([], c)}
    had = spark.createDataFrame([("x", "2", "m", "b"), ("x", "3", "m", "c"), ("y", "4", "m", "d")], "rule string, " + c)
    got = lambda strict: {(r.rule, r.finding_id): r.action for r in run_checks(now, had, strict).collect()}
    assert got(("x",)) == {("x", "1"): "open", ("x", "2"): "keep", ("x", "3"): "close", ("y", "4"): "keep"}
    assert got(())[("x", "3")] == "keep"


def test_walk_takes_large_files_and_minds_negation(spark, tmp_path):
    for p, text in (("a.go", "x" * 2_000_000), ("gen/b.pb.go", "y"), ("gen/keep.pb.go", "z"), ("vendor/v.go", "v"), ("n.log", "l")):
        (tmp_path / "w" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / p).write_text(text)
    got = {r.file_path for r in code.walk(spark, str(tmp_path / "w"), ["*.log", "!keep.pb.go", "!vendor/v.go"]).select("file_path").collect()}
    assert got == {"a.go", "gen/keep.pb.go"}
    (tmp_path / "u.jsonl").write_text('{"ts": "2026-01-01T00:00:00", "repo_id": "r", "query": "q", "n_results": 2, "file_chars": 9, "snippet_chars": 3}\nbroken\n')
    assert [r.n_results for r in code.usage_log(spark, str(tmp_path / "u.jsonl")).collect()] == [2]
    (tmp_path / "CODEOWNERS").write_text("# c\n* @a @b\n\nonly\n")
    assert [(r.pattern, r.owner) for r in code.codeowners(spark, str(tmp_path / "CODEOWNERS")).collect()] == [("*", "@a")]


def test_scope(spark):
    n = spark.createDataFrame([("r", "m", "a/x"), ("r", "m", None), ("s", "m", "a/y"), ("r", "x", "a/z")], "repo_id string, branch string, file_path string")
    one = spark.createDataFrame([("r",), ("r",)], "repo_id string")
    assert R.in_scope(n).count() == 4 and R.in_scope(n, one).count() == 3 and R.in_scope(n, one, "m").count() == 2 and R.in_scope(n, one, "m", ["a/"]).count() == 1 and R.in_scope(n, prefixes=[]).count() == 0
