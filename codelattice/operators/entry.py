"""Queries p3 and p5 of the general operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelattice.operators.hierarchy import descendants, hierarchy, paths
from codelattice.operators.references import orphan_edges, orphan_report, orphan_suppressions
from codelattice.sources.tables import edges_of_kind, table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return edges_of_kind(table(spark, d, "edges"), "CONTAINS").select(F.col("dst_node_id").alias("child"), F.col("src_node_id").alias("parent"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_contains(spark, d), intervals=False).select("node_id", "root_id", "depth")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants of every node outside the rings, from its interval."""
    h = hierarchy(_contains(spark, d))
    return h.where("depth >= 0").select("node_id", "parent_id", ((F.col("exit") - F.col("entry") - 1) / 2).cast("long").alias("descendants"))


def p3_descendant_rows(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node outside the rings, a row for each pair that is there, with the nodes' intervals."""
    return descendants(hierarchy(_contains(spark, d)))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every node outside the rings, root first, from the intervals."""
    return paths(hierarchy(_contains(spark, d))).select("node_id", F.array_join("path", "/").alias("path"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    a = orphan_edges(t("edges"), t("nodes"), t("deleted_files"))
    b = orphan_suppressions(t("suppressions"), t("findings"), t("nodes"), t("deleted_files"), t("source_files"), t("repos"))
    return a.unionByName(b)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month, counted per key and month before they are looked up."""
    t = lambda name: table(spark, d, name)
    return orphan_report(t("edges"), t("suppressions"), t("findings"), t("nodes"), t("deleted_files"), t("source_files"), t("repos"))


_KIND = "regexp_replace(lower(kind), '[^a-z0-9]', '', 'g')"
_TREE = f"""
WITH RECURSIVE l AS (SELECT dst_node_id AS c, min(src_node_id) AS p FROM edges
  WHERE {_KIND} = 'contains' AND src_node_id IS NOT NULL AND dst_node_id IS NOT NULL GROUP BY 1),
n AS (SELECT c AS id FROM l UNION SELECT p FROM l),
t(id, root, depth) AS (
  SELECT id, id, 0 FROM n WHERE id NOT IN (SELECT c FROM l)
  UNION ALL SELECT l.c, t.root, t.depth + 1 FROM t JOIN l ON l.p = t.id)"""
_ORPHANS = f"""
WITH live AS (SELECT n.node_id, n.branch FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM deleted_files f
   WHERE f.repo_id = n.repo_id AND f.branch = n.branch AND f.file_path = n.file_path AND (f.deleted_at >= n.last_promoted_at OR n.last_promoted_at IS NULL))),
s AS (SELECT *, lower(trim(scope)) AS sc, CASE WHEN lower(trim(scope)) = 'file'
   THEN regexp_replace(regexp_replace(target, '^\\s+|\\s+$', '', 'g'), '^(\\./)+', '')
   ELSE lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')) END AS tg FROM suppressions),
o AS (
SELECT DISTINCT 'edges' AS ref_table, edge_id AS ref_id, coalesce(branch, '') AS branch, strftime(last_promoted_at, '%Y-%m') AS period
FROM edges e WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.node_id = e.dst_node_id AND live.branch = e.branch)
UNION
SELECT DISTINCT 'suppressions', suppression_id, coalesce(branch, ''), strftime(created_at, '%Y-%m') FROM s
WHERE NOT coalesce(CASE sc WHEN 'finding' THEN tg IN (SELECT lower(finding_id) FROM findings WHERE finding_id IS NOT NULL)
  WHEN 'symbol' THEN tg IN (SELECT lower(node_id) FROM live WHERE node_id IS NOT NULL)
  WHEN 'file' THEN tg IN (SELECT file_path FROM source_files WHERE file_path IS NOT NULL)
  WHEN 'repo' THEN tg IN (SELECT lower(repo_id) FROM repos WHERE repo_id IS NOT NULL) ELSE false END, false))"""

QUERIES = {"p3_found": p3_found, "p3_descendants": p3_descendants, "p3_descendant_rows": p3_descendant_rows, "p3_paths": p3_paths, "p5_found": p5_found, "p5_report": p5_report}
ORACLE = {
    "p3_found": _TREE + " SELECT n.id AS node_id, coalesce(t.root, '(cycle)') AS root_id, coalesce(t.depth, -1) AS depth FROM n LEFT JOIN t ON t.id = n.id",
    "p3_descendants": _TREE + """, up(id, a) AS (SELECT t.id, l.p FROM t JOIN l ON l.c = t.id UNION ALL SELECT up.id, l.p FROM up JOIN l ON l.c = up.a)
SELECT t.id AS node_id, any_value(l.p) AS parent_id, count(DISTINCT up.id) AS descendants FROM t LEFT JOIN l ON l.c = t.id LEFT JOIN up ON up.a = t.id GROUP BY 1""",
    "p3_paths": _TREE.replace("t(id, root, depth)", "t(id, root, depth, path)").replace("SELECT id, id, 0 FROM n", "SELECT id, id, 0, id FROM n").replace("t.depth + 1 FROM", "t.depth + 1, t.path || '/' || l.c FROM") + " SELECT id AS node_id, path FROM t",
    "p5_found": _ORPHANS + " SELECT * FROM o",
    "p5_report": _ORPHANS + " SELECT ref_table, period, count(*) AS orphans FROM o GROUP BY 1, 2",
}
