import pytest

from pyspark.sql import functions as F

from codelattice.operators import checks as C, predicates as P
from codelattice.operators.lookup import enclosing, longest_prefix, resolve_prefixes, symbol_matches
from codelattice.operators.reports import nearest_rank, owners, retrieval_quality
from codelattice.operators.resolve import resolve_stubs

N = "node_id string, branch string, repo_id string, kind string, symbol_path string, file_path string"


def test_dead_and_untested(spark):
    rows = [
        ("a", "m", "r", "function", "helper", "x/a.go"), ("b", "m", "r", "function", "used", "x/a.go"), ("c", "m", "r", "function", "Exported", "x/a.go"), ("d", "m", "r", "function", "main", "x/a.go"),
        ("e", "m", "r", "method", "T.Exported", "x/a.go"), ("f", "m", "r", "method", "t.read", "x/a.go"), ("g", "m", "r", "interface", "reader", "x/a.go"), ("h", "m", "r", "method", "reader.read", "x/a.go"),
        ("i", "m", "r", "function", "helper", "x/a_test.go"), ("j", "m", "r", "function", "helper", "vendor/a.go"), ("k", "m", "eph", "function", "helper", "x/a.go"), ("l", "m", "r", "method", "t.other", "x/a.go"), ("o", "m", "r", "function", "self", "x/a.go"),
    ]
    nodes = spark.createDataFrame(rows, N)
    edges = spark.createDataFrame([("e1", "i", "b", "m", "calls"), ("e2", "o", "o", "m", "calls"), ("e3", "a", "l", "x", "calls"), ("e4", "a", "a2", "m", "contains")], "edge_id string, src_node_id string, dst_node_id string, branch string, kind string")
    repos = spark.createDataFrame([("r", "tracked"), ("eph", "ephemeral")], "repo_id string, kind string")
    assert {r.node_id for r in C.dead_code(nodes, edges, repos).collect()} == {"a", "l", "o"}
    assert {r.node_id for r in C.untested(nodes, edges, repos).collect()} == {"a", "c", "e", "l", "o"}


@pytest.mark.parametrize("low,high", [("1.2.3", "1.10.0"), ("1.0.0-alpha", "1.0.0"), ("1.0.0-alpha.1", "1.0.0-alpha.beta"), ("1.0.0-2", "1.0.0-10"), ("v1.0.0", "1.0.1+build5"), ("1.0.0-rc.1", "1.0.0-rc.1.1"), ("2", "2.0.1")])
def test_semver_order(spark, low, high):
    df = spark.createDataFrame([(low, high)], "a string, b string")
    assert df.select(C.semver_key(F.col("a")) < C.semver_key(F.col("b"))).head()[0]


def test_vulnerable(spark):
    ev = "id string, aliases array<string>, severity string, affected array<struct<package:string,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    adv = spark.createDataFrame([
        ("CVE-1", ["GHSA-1"], "HIGH", [("p", [("SEMVER", [("0", None, None), (None, "1.2.0", None), ("2.0.0", None, None), (None, "2.3.0", None)])])]),
        ("GHSA-1", ["CVE-1"], "low", [("p", [(None, [("0", None, None), (None, "1.2.0", None)])])]),
        ("GO-9", None, None, [("q", [("SEMVER", [("1.0.0", None, None), (None, None, "1.5.0")])])]),
        ("X-1", [], "critical", [("p", [("GIT", [("0", None, None)])])]),
    ], ev)
    deps = spark.createDataFrame([("p", "1.1.9"), ("p", "1.2.0"), ("p", "2.1.0"), ("p", "2.3.0"), ("q", "1.5.0"), ("q", "1.5.1"), ("q", "bad"), ("q", None), ("z", "1.0.0")], "name string, version string")
    got = {(r.name, r.version): (r.advisory, r.severity, r.fixed_in) for r in C.vulnerable(deps, adv).collect()}
    assert got == {("p", "1.1.9"): ("GHSA-1", "low", "1.2.0"), ("p", "2.1.0"): ("CVE-1", "high", "2.3.0"), ("q", "1.5.0"): ("GO-9", "medium", None)}


def test_secrets(spark):
    lines = ['key = "AKIA' + "ABCDEFGHIJKLMNOP" + '"', 'apiKey: "f81kd93KfjaLx02mQz"', 'token = "aaaaaaaaaaaaaaaaaaaa"', "See config.api-key.value-of-the-service-name.", "password: see the notes", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    got = {r.i: r.text for r in C.secrets(df).collect()}
    assert set(got) == {0, 1} and "AKIA" not in got[0]


def test_predicates(spark):
    paths = ["a/b_test.go", "test_x.py", "a/x.spec.tsx", "a/test.go", "vendor/x.go", "a/vendored/x.go", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(P.is_test_file(F.col("p"))).collect()] == [True, True, True, False, False, False, False]
    assert [r[0] for r in df.select(P.is_vendored(F.col("p"))).collect()] == [False, False, False, False, True, False, False]
    s = spark.createDataFrame([(x,) for x in ["main", "initX", "TestA", "Élan", "lower", "", None, "recv.Method", "Recv.method"]], "s string")
    assert [r[0] for r in s.select(P.is_external_entry(F.col("s"))).collect()] == [True, False, True, True, False, True, True, False, True]
    t = spark.createDataFrame([(x,) for x in ["TestX", "Testing", "Test", "T.BenchmarkA", "Fuzz_x"]], "s string")
    assert [r[0] for r in t.select(P.is_go_test_name(F.col("s"))).collect()] == [True, False, True, True, True]


def test_lookups(spark):
    nodes = spark.createDataFrame([("1", "a.b.C"), ("2", "C"), ("3", "b.CC"), ("4", None)], "node_id string, symbol_path string")
    hits = symbol_matches(nodes, spark.createDataFrame([("C",), ("b.C",), (None,)], "symbol string")).collect()
    assert {(r.symbol, r.node_id, r.exact) for r in hits} == {("C", "1", False), ("C", "2", True), ("b.C", "1", False)}
    ids = spark.createDataFrame([("abcd1",), ("abcd2",), ("efgh9",)], "id string")
    got = {r.prefix: (r.id, r.matches) for r in resolve_prefixes(ids, spark.createDataFrame([("abcd",), ("abcd1",), ("efgh",), ("zzzz",), ("ab",)], "prefix string")).collect()}
    assert got == {"abcd": (None, 2), "abcd1": ("abcd1", 1), "efgh": ("efgh9", 1), "zzzz": (None, 0), "ab": (None, 0)}
    spans = spark.createDataFrame([("r", "m", "f", "k", "function", 1, 300), ("r", "m", "f", "j", "function", 90, 130), ("r", "m", "f", "z", "function", 0, 5), ("r", "m", "f", "x", "file", 1, 999)], "repo_id string, branch string, file_path string, node_id string, kind string, line_start int, line_end int")
    at = spark.createDataFrame([("r", "m", "f", x) for x in (1, 100, 131, 301)], "repo_id string, branch string, file_path string, line int")
    assert {r.line: r.node_id for r in enclosing(spans, at).collect()} == {1: "k", 100: "j", 131: "k"}
    m = spark.createDataFrame([("r1", "x/a"), ("r2", "x/a/b"), ("r3", "x/ab"), ("r4", None)], "repo_id string, module_path string")
    p = spark.createDataFrame([("x/a/b/c",), ("x/a",), ("x/abc",), (None,)], "path string")
    assert {r.path: r.repo_id for r in longest_prefix(p, m).collect()} == {"x/a/b/c": "r2", "x/a": "r1"}


def test_resolution(spark):
    nodes = spark.createDataFrame([("1", "m", "r1", "function", "Go", "d/a.go"), ("2", "m", "r1", "function", "Go", "d/a_test.go"), ("3", "m", "r1", "method", "T.Run", "d/b.go"), ("4", "m", "r1", "method", "U.Run", "d/b.go"), ("5", "m", "r1", "function", "Only", "d/x_test.go")], N)
    repos = spark.createDataFrame([("r1", "ex.io/m"), ("r2", "ex.io/m/d/deeper"), ("r3", None)], "repo_id string, module_path string")
    stubs = spark.createDataFrame([("ex.io/m/d", "Go"), ("ex.io/m/d", "Run"), ("ex.io/m/d", "T.Run"), ("ex.io/m/d", "Only"), ("ex.io/m", "Go"), ("other/x", "Go"), (None, "Go")], "module_path string, symbol string")
    assert {(r.symbol): r.node_id for r in resolve_stubs(stubs, repos, nodes).collect()} == {"Go": "1", "T.Run": "3", "Only": "5"}


def test_reports(spark):
    rules = spark.createDataFrame([("*", "all"), ("*.go", "go"), ("/src/", "src"), ("docs/*.md", "docs"), ("a+b/", "plus")], "pattern string, owner string")
    paths = spark.createDataFrame([(x,) for x in ["x.go", "src/x.go", "lib/src/x.ts", "docs/a.md", "docs/b/a.md", "q/a+b/c", None]], "path string")
    got = {r.path: r.owner for r in owners(paths.where("path IS NOT NULL"), rules).collect()}
    assert got == {"x.go": "go", "src/x.go": "src", "lib/src/x.ts": "all", "docs/a.md": "docs", "docs/b/a.md": "all", "q/a+b/c": "plus"}
    v = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", 5.0), ("b", None)], "k string, v double")
    assert {r.k: r.quantile for r in nearest_rank(v, "k", "v", 0.95).collect()} == {"a": 19.0, "b": 5.0}
    hits = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("r", "z", 1)], "query_id string, doc_id string, rank int")
    truth = spark.createDataFrame([("q", "y"), ("q", "w"), ("s", "x")], "query_id string, doc_id string")
    assert {r.query_id: (r.recall, r.rr) for r in retrieval_quality(hits, truth, 2).collect()} == {"q": (0.5, 0.5), "s": (0.0, 0.0)}


def test_alias_chains_are_one_vulnerability(spark):
    ev = "id string, aliases array<string>, severity string, affected array<struct<package:string,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
    hit = lambda p: [(p, [("SEMVER", [("0", None, None), (None, "9.0.0", None)])])]
    rows = [("GO-1", ["CVE-1"], None, hit("p")), ("CVE-1", ["GHSA-1"], "low", hit("p")), ("GHSA-1", None, "high", hit("p")), ("GO-2", ["CVE-2"], None, hit("q")), ("CVE-7", [], None, hit("p")), ("CVE-7", [], None, hit("p"))]
    got = {(r.name, r.advisory): r.aliases for r in C.vulnerable(spark.createDataFrame([("p", "1.0.0"), ("q", "1.0.0"), ("p", "1.0.0")], "name string, version string"), spark.createDataFrame(rows, ev)).collect()}
    assert got == {("p", "GHSA-1"): ["CVE-1"], ("p", "CVE-7"): [], ("q", "GO-2"): ["CVE-2"]}


def test_redaction(spark):
    from codelattice.functions.text import redact

    want = {
        "key sk-a1 and ghp_x": "key [REDACTED] and [REDACTED]", "https://u:p@ss@host/x": "https://u:[REDACTED]@host/x", "Bearer a.b/c=|d e": "Bearer [REDACTED] e",
        "DB_PASSWD=x y": "DB_PASSWD=[REDACTED] y", "MY_API_KEY=1": "MY_API_KEY=[REDACTED]", "token=abc": "token=[REDACTED]", "nothing": "nothing", None: None, "": "",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", redact(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == want


def test_noise_paths(spark):
    from codelattice.operators import predicates as P

    want = {"a/b_TEST.go": True, "x.d.ts": True, "a/legacy/b.go": True, "legacy/b.go": False, "a/vendor/b.go": True, "docs/a.md": False, "a/mocks/b.go": False, None: False, "": False}
    df = spark.createDataFrame([(k,) for k in want], "p string").select("p", P.is_noise_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == want
