from codelattice.operators.search import FAN, bm25, lexical, nearest, rerank

D = "doc_id string, tokens array<string>, text string, symbol_path string, kind string, file_path string"


def test_words_by_their_beginnings(spark):
    docs = spark.createDataFrame([("a", ["parcel", "route"]), ("b", ["parcels", "parcel"]), ("c", ["par"]), ("d", ["ship"]), *[(f"x{i}", ["other"]) for i in range(9)]], "doc_id string, tokens array<string>")
    q = spark.createDataFrame([("q", ["parcel"]), ("s", ["sh"])], "query_id string, tokens array<string>")
    assert {(r.query_id, r.doc_id) for r in bm25(docs, q, prefix=True).collect()} == {("q", "a"), ("q", "b")}
    score = {r.doc_id: r.score for r in bm25(docs, spark.createDataFrame([("q", ["parc"])], q.schema), prefix=True).collect()}
    assert set(score) == {"a", "b"} and score["b"] > score["a"]  # two words that begin so
    assert bm25(docs, spark.createDataFrame([("q", ["parc"])], q.schema)).count() == 0


def test_lists_are_long_and_verbs_alike(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", ["method", "parcel"], f"Parcel{i}", f"Parcel{i}", "method", f"f{i}.go") for i in range(150)], D)
    q = spark.createDataFrame([("x: parcel", ["parcel"], "parcel")], "query_id string, tokens array<string>, phrase string")
    assert lexical(docs, q).count() == FAN == nearest(docs, q, FAN).count() == 100
    hits = spark.createDataFrame([("q", n, 1.0, ["register"], n, k, None) for n, k in (("Command.AddCommand", "method"), ("Command.ToAdd", "method"), ("AddCommands", "field"))], "query_id string, doc_id string, score double, tokens array<string>, symbol_path string, kind string, file_path string")
    assert {r.doc_id: r.score for r in rerank(hits).collect()} == {"Command.AddCommand": 2.0, "Command.ToAdd": 1.0, "AddCommands": 1.0}
