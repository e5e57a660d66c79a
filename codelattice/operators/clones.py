"""Exact, structural and near clones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelattice.operators.current import SQL, current_edges, current_nodes
from codelattice.operators.predicates import CLONE_EXCLUDED_KINDS
from codelattice.plans.materialize import Workspace
from codelattice.plans.skew import split_join
from codelattice.sources.tables import table

#: Near-duplicate thresholds by embedding model, with or without a tag behind a colon; another model's is the default.
NEAR_THRESHOLDS, NEAR_DEFAULT = {"model2vec(potion-code-16M)": 0.68, "nomic-embed-text": 0.85, "static-hash-v2": 0.70}, 0.68


def near_threshold(model: Column) -> Column:
    """The score from which nodes of a model count as near-duplicates; null is another model."""
    at = F.create_map(*[x for m, t in NEAR_THRESHOLDS.items() for x in (F.lit(m), F.lit(t))])
    return F.coalesce(F.element_at(at, model), F.element_at(at, F.substring_index(model, ":", 1)), F.lit(NEAR_DEFAULT))


def groups_by_hash(rows: DataFrame, key: str, members: list[str], preview: int = 25) -> DataFrame:
    """Groups of two or more rows of equal ``key``: size and the first ``preview`` members in order.

    Null and empty keys form no group.  Counts are pre-aggregated; previews are cut by rank
    before the shuffle, so no group is ever held whole.
    """
    some = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    sizes = some.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    w = Window.partitionBy(key).orderBy(*members)
    first = some.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= preview).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn_", *members))).alias("m_"))
    return sizes.join(first, key).select(key, "size", F.transform("m_", lambda x: x[members[-1]].cast("string")).alias("members"))


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded edge set by union-find, each under its least node."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.string()), pa.array([find(x) for x in list(root)], pa.string())], ["node", "component"])


def propagate_labels(edges: DataFrame, max_rounds: int = 60, finish: int = 100_000) -> DataFrame:
    """Connected components of (a, b) pairs of strings: (node, component), component its least node.

    Up to the fixed bound ``finish`` one task joins them; beyond, least labels spread with
    pointer jumps until nothing changes.  Null ends and pairs of a node with itself don't count.
    """
    work = Workspace(edges.sparkSession, "labels")
    e = work.write(edges.where("a <> b").select("a", "b").distinct(), "pairs")
    if e.count() <= finish:
        return e.coalesce(1).mapInArrow(_union, "node string, component string")
    e = work.write(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n = e.count()
    labels = work.write(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = split_join(e, labels.select(F.col("node").alias("b"), "label"), "b", n, work).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        step = work.write(step, "step")  # a component's label is a hot key
        new = work.write(split_join(step, jump, "low", n, work, "left").select("node", F.coalesce("lower", "low").alias("new"), "label"), "labels")
        changed = not new.where("new <> label").isEmpty()
        work.drop(labels)
        labels = new.select("node", F.col("new").alias("label"))
        labels._written_at = new._written_at
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def exact_clones(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same text."""
    docs = table(spark, d, "documents").where("text <> ''").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return groups_by_hash(docs, "content_hash", ["doc_id"]).select("content_hash", "size", F.array_join("members", ",").alias("members"))


def _clone_nodes(spark: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*CLONE_EXCLUDED_KINDS)).where("branch = 'main'")


def clusters_tiered(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal structure: exact if all contents are equal too, and whether they cross repos."""
    n = _clone_nodes(spark, d).where("structural_hash IS NOT NULL AND structural_hash <> ''")
    g = n.groupBy("structural_hash").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("content_hash").alias("contents"), F.count_distinct("repo_id").alias("repos"), F.min("node_id").alias("first_member")).where("size >= 2")
    return g.select("structural_hash", "size", F.when(F.col("contents") == 1, "exact").otherwise("structural").alias("tier"), (F.col("repos") > 1).alias("cross_repo"), "first_member")


def content_clones(spark: SparkSession, d: str) -> DataFrame:
    """Members of content groups (no group collected): one row a member."""
    n = current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*CLONE_EXCLUDED_KINDS)).where("content_hash IS NOT NULL")
    size = n.groupBy("content_hash").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    return n.join(size, "content_hash").select("content_hash", "node_id", "branch", "file_path", "size")


def similar_edges(spark: SparkSession, d: str) -> DataFrame:
    """SIMILAR_TO edges whose two ends are there on the branch."""
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "branch", "file_path")
    e = current_edges(table(spark, d, "edges")).where("kind = 'similarto' AND src_node_id <> dst_node_id")
    a = n.select(F.col("node_id").alias("src_node_id"), "branch", F.col("file_path").alias("src_path"))
    b = n.select(F.col("node_id").alias("dst_node_id"), "branch", F.col("file_path").alias("dst_path"))
    return e.join(a, ["src_node_id", "branch"]).join(b, ["dst_node_id", "branch"]).select("edge_id", "branch", "src_node_id", "dst_node_id", "src_path", "dst_path", F.round(F.col("score").cast("double"), 4).alias("score"))


def elected_model(spark: SparkSession, d: str) -> DataFrame:
    """The one model that vectors are compared by: the one of most of them, ties by name, with its near-duplicate threshold: one row."""
    n = table(spark, d, "node_vectors").groupBy("model").agg(F.count_distinct("vec_id").alias("vectors"))
    first = n.orderBy(F.col("vectors").desc(), F.col("model").asc_nulls_last()).limit(1)
    return spark.range(1).select("id").join(first.withColumn("id", F.lit(0)), "id", "left").select("model", F.coalesce("vectors", F.lit(0)).alias("vectors"), near_threshold(F.col("model")).alias("threshold"))


def near_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components over SIMILAR_TO edges of at least the near-duplicate threshold of the elected model, with their least and greatest score."""
    e = similar_edges(spark, d).where(F.col("score") >= elected_model(spark, d).first()["threshold"])
    e = Workspace(spark, "near").write(e.select(F.col("src_node_id").alias("a"), F.col("dst_node_id").alias("b"), "score"), "edges")
    labels = propagate_labels(e)
    scores = e.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(scores, "component")


_X = ", ".join(f"'{x}'" for x in CLONE_EXCLUDED_KINDS)
_SIM = """se AS (SELECT e.edge_id, e.branch, e.src_node_id, e.dst_node_id, a.file_path AS src_path, b.file_path AS dst_path, round(e.score::DOUBLE, 4) AS score FROM ce e
 JOIN cn a ON a.node_id = e.src_node_id AND a.branch = e.branch JOIN cn b ON b.node_id = e.dst_node_id AND b.branch = e.branch WHERE e.kind = 'similarto' AND e.src_node_id <> e.dst_node_id)"""
_ELECTED = """WITH el AS (SELECT model, count(DISTINCT vec_id) AS vectors, CASE split_part(model, ':', 1) WHEN 'nomic-embed-text' THEN 0.85::DOUBLE WHEN 'static-hash-v2' THEN 0.70::DOUBLE ELSE 0.68::DOUBLE END AS threshold
 FROM node_vectors GROUP BY 1 ORDER BY vectors DESC, model LIMIT 1)"""
QUERIES = {f.__name__: f for f in (exact_clones, clusters_tiered, content_clones, similar_edges, near_clusters, elected_model)}
ORACLE = {
    "exact_clones": "SELECT sha256(text) AS content_hash, count(*) AS size, array_to_string(list(doc_id ORDER BY doc_id)[1:25], ',') AS members FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) >= 2",
    "clusters_tiered": f"""WITH {SQL} SELECT structural_hash, count(*) AS size, CASE WHEN count(DISTINCT content_hash) = 1 THEN 'exact' ELSE 'structural' END AS tier,
count(DISTINCT repo_id) > 1 AS cross_repo, min(node_id) AS first_member FROM cn WHERE kind NOT IN ({_X}) AND branch = 'main' AND structural_hash <> '' GROUP BY 1 HAVING count(*) >= 2""",
    "content_clones": f"WITH {SQL} SELECT content_hash, node_id, branch, file_path, count(*) OVER (PARTITION BY content_hash) AS size FROM cn WHERE kind NOT IN ({_X}) AND content_hash IS NOT NULL QUALIFY size >= 2",
    "similar_edges": f"WITH {SQL}, {_SIM} SELECT * FROM se",
    "elected_model": f"{_ELECTED} SELECT * FROM el",
    "near_clusters": f"""{_ELECTED.replace('WITH', 'WITH RECURSIVE')}, {SQL}, {_SIM}, e AS (SELECT src_node_id AS a, dst_node_id AS b, score FROM se WHERE score >= (SELECT threshold FROM el)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, seen) AS (SELECT a, a FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.id), l AS (SELECT id, min(seen) AS component FROM r GROUP BY 1)
SELECT l.component, count(DISTINCT l.id) AS size, min(e.score) AS min_score, max(e.score) AS max_score FROM l LEFT JOIN e ON e.a = l.id GROUP BY 1""",
}
