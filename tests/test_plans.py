import pytest

from pyspark.sql import functions as F

from codelattice.operators.current import current_edges, current_nodes
from codelattice.plans.identify import heavy_keys, number_ids
from codelattice.plans.materialize import Workspace, shared_dir
from codelattice.sources.tables import canonical_kind, edges_of_kind


def test_written_tables(spark):
    work = Workspace(spark, "test")
    assert work.root.startswith(shared_dir(spark))
    df = work.write(spark.createDataFrame([(1, "a"), (2, None)], "i int, s string"), "t")
    assert {tuple(r) for r in df.collect()} == {(1, "a"), (2, None)}
    assert work.write(df.where("i > 9"), "empty").count() == 0
    work.drop(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist|FAILED_READ"):
        df.count()


def test_numbers_and_heavy_keys(spark):
    ids = number_ids(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string"), "id", Workspace(spark, "ids"), "ids")
    assert ids.count() == 2 and ids.select("nr").distinct().count() == 2
    df = spark.createDataFrame([("h",)] * 30 + [("x",), ("y",)], "k string")
    assert [(r.k, r.heavy_n) for r in heavy_keys(df, ["k"], 32, share=4, floor=5).collect()] == [("h", 30)]


def test_split_join_equals_a_join(spark):
    from codelattice.plans.skew import split_join

    work = Workspace(spark, "skew")
    rows = work.write(spark.createDataFrame([("h", i) for i in range(40)] + [("x", 1), ("y", 2), (None, 3), ("gone", 4), ("gone", 5)], "k string, i int"), "rows")
    side = spark.createDataFrame([("h", "H"), ("x", "X"), (None, "N")], "k string, v string")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "k", how).collect()))
        for kw in ({}, {"share": 4, "floor": 5}, {"share": 100, "floor": 1}):
            assert sorted(map(str, split_join(rows, side, "k", 45, work, how, **kw).select("k", "i", "v").collect())) == want
    two = work.write(rows.withColumn("m", F.lit("a")), "two")
    assert split_join(two, side.where("k IS NOT NULL").withColumn("m", F.lit("a")), ["m", "k"], 45, work, share=4, floor=5).count() == 41
    assert split_join(rows.limit(0), side, "k", 0, work).count() == 0


def test_kinds_and_latest(spark):
    rows = [("e1", "m", "Similar To", 0.5, "2025-01-01"), ("e1", "m", "similar-to", None, "2025-02-01"), ("e2", "m", " CALLS ", None, "2025-01-01"), ("e3", "m", None, None, None)]
    e = spark.createDataFrame(rows, "edge_id string, branch string, kind string, score double, at string").select("*", F.col("at").cast("timestamp_ntz").alias("last_promoted_at"), F.lit("x").alias("confidence"), F.lit(None).cast("boolean").alias("resolved"))
    assert edges_of_kind(e, "SIMILAR_TO").count() == 2 and edges_of_kind(e, "calls").count() == 1
    now = {r.edge_id: (r.kind, r.score) for r in current_edges(e).collect()}
    assert now == {"e1": ("similarto", 0.5), "e2": ("calls", None), "e3": (None, None)}
    assert e.select(canonical_kind(F.col("kind"))).where("kind IS NULL").count() == 1
    n = spark.createDataFrame([("a", "m", "1", "2025-01-01"), ("a", "m", "2", "2025-03-01"), ("a", "m", "3", None)], "node_id string, branch string, content_hash string, at string").withColumn("last_promoted_at", F.col("at").cast("timestamp_ntz"))
    assert [r.content_hash for r in current_nodes(n).collect()] == ["2"]


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names and {"p3_found", "p5_found"} <= names and len(names) > 80
