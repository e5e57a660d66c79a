import datetime as dt

from codelattice.sources import code, sinks
from codelattice.functions import text as T
from codelattice.operators.text import todos, uncovered_chunks
from codelattice.operators.vectors import condense, embed_new, exact_search, links, static_embedding
from codelattice.streaming.flow import debounce, overlay, resync, same_generation, start_promotion

from pyspark.sql import functions as F

t = lambda h, m=0, s=0: dt.datetime(2025, 1, 1, h, m, s)
NODE = "node_id string, branch string, repo_id string, file_path string, content_hash string, last_promoted_at timestamp_ntz"


def test_promotion_stream(spark, tmp_path):
    src, out, marks = (str(tmp_path / x) for x in ("src", "out", "marks"))
    first = spark.createDataFrame([("a", "m", "r", "f1", "1", t(1)), ("b", "m", "r", "f1", "1", t(1)), ("c", "m", "q", "f2", "1", t(1))], NODE)
    first.coalesce(1).write.parquet(src)
    start_promotion(spark, src, first.schema, out, marks).awaitTermination()
    spark.createDataFrame([("a", "m", "r", "f1", "2", t(2)), ("a", "m", "r", "f1", "2", t(2))], NODE).coalesce(1).write.mode("append").parquet(src)
    start_promotion(spark, src, first.schema, out, marks).awaitTermination()
    start_promotion(spark, src, first.schema, out, marks).awaitTermination()  # nothing new: nothing changes
    assert {(r.node_id, r.content_hash) for r in spark.read.parquet(out).collect()} == {("a", "2"), ("c", "1")}


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [("p", t(1, 0, 0)), ("p", t(1, 0, 20)), ("p", t(1, 2)), ("q", t(1, 0, 5)), ("z", t(9))]
    df = spark.createDataFrame(rows, "path string, ts timestamp_ntz")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in debounce(df, ["path"], "ts", "30 seconds").collect()}
    assert len(batch) == 4
    s = debounce(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute"), ["path"], "ts", "30 seconds")
    q = s.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.path, r.events) for r in spark.sql("SELECT * FROM bursts").collect()}
    assert got <= {(p, n) for p, _, _, n in batch} and ("p", 2) in got


def test_overlay_generation_resync(spark):
    base = spark.createDataFrame([("a", "r", "m", "f1"), ("b", "r", "m", "f2"), ("c", "r", "m", "f3")], "node_id string, repo_id string, branch string, file_path string")
    staged = spark.createDataFrame([("a2", "r", "m", "f1", t(1), False), ("a3", "r", "m", "f1", t(2), False), (None, "r", "m", "f2", t(1), True)], "node_id string, repo_id string, branch string, file_path string, staged_at timestamp_ntz, deleted boolean")
    assert {r.node_id for r in overlay(base, staged).collect()} == {"a3", "c"}
    w = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], "repo_id string, generation int")
    assert same_generation(w, spark.createDataFrame([("r", 2)], "repo_id string, generation int")).count() == 1
    s = "path string, mtime long, size long"
    got = lambda u: {(r.path, r.op) for r in resync(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("n", 1, 1)], s), spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("x", 1, 1)], s), u).collect()}
    assert got(True) == {("b", "write"), ("n", "write"), ("x", "remove")} and got(False) == {("b", "write"), ("x", "remove")}


def test_parser_and_sources(spark, tmp_path):
    go = 'package a\n\nimport (\n\t"fmt"\n\tx "ex.io/m/d"\n)\n\n// func Hidden() {}\ntype Box struct {\n\tw int\n}\n\ntype Doer interface {\n\tDo(n int) error\n}\n\nfunc (b *Box) Size() int {\n\treturn helper(b.w) // {\n}\n\nfunc helper(n int) int { fmt.Println("}"); return n }\n\nvar Total = 3\n'
    ts = "import { a } from './lib/a';\nexport class Cart {\n  private n: number;\n  async add(x: number) {\n    if (x) { this.save(x); }\n  }\n}\nexport function total(c: Cart) {\n  return sum(c);\n}\nconst K = 1;\n"
    rows = [("r", "m", "d/a.go", "go", go), ("r", "m", "b.ts", None, ts), ("r", "m", "c.py", "python", "def f(): pass"), ("r", "m", "n.go", "go", None), ("r", "m", "e.go", "go", "")]
    df = spark.createDataFrame(rows, "repo_id string, branch string, file_path string, language string, content string")
    got = {(r.kind, r.symbol_path): r for r in code.parse_sources(df).collect()}
    assert set(got) == {("struct", "Box"), ("interface", "Doer"), ("method", "Doer.Do"), ("method", "Box.Size"), ("function", "helper"), ("variable", "Total"), ("class", "Cart"), ("method", "Cart.add"), ("function", "total"), ("variable", "K")}
    assert got[("method", "Box.Size")].calls == ["helper"] and (got[("struct", "Box")].line_start, got[("struct", "Box")].line_end) == (9, 11) and got[("class", "Cart")].line_end == 7
    assert {r.import_path for r in code.imports(df).collect()} == {"fmt", "ex.io/m/d", "./lib/a"}
    assert code.structural_hash("func a(x int) { return x + 1 }") == code.structural_hash("func  b(y int) { return y + 2 } // c") != code.structural_hash("func a(x int) { return x - 1 }")
    mod = spark.createDataFrame([("r", "go.mod", "module ex.io/m\n\ngo 1.22\n\nrequire ex.io/one v1.2.3\nrequire (\n\tex.io/two/v2 v2.0.0-rc.1 // indirect\n)\n")], "repo_id string, file_path string, content string")
    assert {(r.module_path, r.name, r.version) for r in code.manifest(mod).collect()} == {("ex.io/m", "ex.io/one", "v1.2.3"), ("ex.io/m", "ex.io/two/v2", "v2.0.0-rc.1")}
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n ctx\n+new one\n-old\n+new two\n@@ -9,0 +20,1 @@\n+far\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
    added = code.added_lines(spark.createDataFrame([("r", "s", patch)], "repo_id string, git_sha string, patch string")).collect()
    assert {(r.file_path, r.line_no, r.text) for r in added} == {("x", 2, "new one"), ("x", 3, "new two"), ("x", 20, "far")}
    (tmp_path / "w" / ".git").mkdir(parents=True)
    (tmp_path / "w" / "build").mkdir()
    for p, c in (("a.go", b"x"), (".git/c", b"x"), ("build/o.go", b"x"), ("bin", b"a\0b"), ("n.log", b"x")):
        (tmp_path / "w" / p).write_bytes(c)
    assert {r.file_path for r in code.walk(spark, str(tmp_path / "w"), ["build/", "*.log"]).collect()} == {"a.go"}


def test_sinks_and_text(spark, tmp_path):
    f = "finding_id string, branch string, state string, created_at timestamp_ntz"
    up = sinks.upsert_findings(spark.createDataFrame([("a", "m", "open", t(1)), ("b", "m", "open", t(1))], f), spark.createDataFrame([("a", "m", "closed", t(5)), ("c", "m", "open", t(5))], f))
    assert {(r.finding_id, r.state, r.created_at) for r in up.collect()} == {("a", "closed", t(1)), ("b", "open", t(1)), ("c", "open", t(5))}
    sinks.append_audit(spark.createDataFrame([("Authorization: Bearer abc.def",), ("x https://u:pw@h/p MY_TOKEN=zz",)], "m string"), "m", str(tmp_path / "log"))
    said = " ".join(r.m for r in spark.read.json(str(tmp_path / "log")).collect())
    assert "abc.def" not in said and "pw" not in said and "zz" not in said and "u:[REDACTED]@h" in said
    one = spark.createDataFrame([("é" * 5, "HTTPServer2go_fooBar", "git@Forge.example:Team/App.git")], "a string, b string, u string")
    r = one.select(T.truncate_bytes(F.col("a"), 5).alias("a"), T.symbol_tokens(F.col("b")).alias("b"), T.identifier_parts(F.col("b")).alias("i"), T.canonical_url(F.col("u")).alias("u")).head()
    assert r.a == "éé" and r.b == ["httpserver2go", "foobar", "http", "server", "2", "go", "foo", "bar"] and r.i == ["http", "server2go", "foo", "bar"] and r.u == "forge.example/team/app"
    files = spark.createDataFrame([("r", "m", "f", "x\n// TODO: fix\r\n# FIXME\n// TODOS no\n/* XXX y */", 200)], "repo_id string, branch string, file_path string, content string, n_lines int")
    assert [(r.line, r.marker) for r in todos(files).orderBy("line").collect()] == [(2, "TODO"), (3, "FIXME"), (5, "XXX")]
    spans = spark.createDataFrame([("r", "m", "f", "function", 10, 20), ("r", "m", "f", "function", 15, 30)], "repo_id string, branch string, file_path string, kind string, line_start int, line_end int")
    assert sorted((r.from_line, r.to_line) for r in uncovered_chunks(spans, files).collect()) == [(1, 9), (31, 110), (111, 190), (191, 200)]
    assert sinks.wiki_page(spark.createDataFrame([("a|b", None)], "x string, y string"), "T").splitlines()[-1] == "| a\\|b |  |"
    assert sinks.snapshot(spark, {"t": files}, str(tmp_path / "snap")) == {"t": 1}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [5.0, 5.0]), (5, None), (6, [1.0]), (7, [float("nan"), 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in exact_search(v, v.where("vec_id IN (1, 4)"), 2, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2), (4, 2, 1), (4, 1, 2)]
    nodes = spark.createDataFrame([("a", "A.run", "method", "f"), ("b", "B.run", "method", "g"), ("c", "C", "file", "h"), ("d", "main", "function", "i"), ("e", "main", "function", "j"), ("f", "D", "function", "f")], "node_id string, symbol_path string, kind string, file_path string")
    hits = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("d", "e", 0.9), ("a", "f", 0.9), ("b", "a", 0.5)], "src string, dst string, score double")
    assert {(r.src, r.dst) for r in links(hits, nodes).collect()} == {("a", "b")}
    e = spark.createDataFrame([(1, "parseFile reader"), (2, "parse_file reader"), (3, "billing invoice"), (4, ""), (5, None)], "id int, text string").withColumn("v", static_embedding(64)("text"))
    x = {r.id: r.v for r in e.collect()}
    dot = lambda a, b: sum(p * q for p, q in zip(x[a], x[b], strict=True))
    assert abs(dot(1, 1) - 1) < 1e-5 and dot(1, 2) > dot(1, 3) and not any(x[4]) and not any(x[5])
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    store = embed_new(texts.where("id = 3"), spark.createDataFrame([], "embed_hash string"), "m")
    assert embed_new(texts, store, "m").count() == 1 and embed_new(texts, store, "other").count() == 2
    parts = spark.createDataFrame([("g", i, [float(i), 1.0]) for i in range(5)], "group string, place int, embedding array<float>")
    assert sorted(r.place for r in condense(parts, 2).collect()) == [3, 4]
