"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelattice.llm.components import components
from codelattice.llm.handwritten import not_handwritten
from codelattice.llm.leakage import leaks
from codelattice.llm.packing import fill_report, pack
from codelattice.llm.reading import grade_quality, reading_levels
from codelattice.llm.similar import most_similar
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import edges_of_kind, table

#: Whose own notices stand in the test tables.
OWNERS = ("Fernwood Parcels",)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components(edges_of_kind(table(spark, d, "edges"), "SIMILAR_TO"), "src_node_id", "dst_node_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written; notices of the tables' own company mark nobody else's code."""
    return not_handwritten(table(spark, d, "source_files"), table(spark, d, "nodes"), owners=OWNERS).select("repo_id", "file_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return most_similar(table(spark, d, "node_vectors")).select("vec_id", "neighbour_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers hold every text once and none too much, and how full they are: one row."""
    docs = table(spark, d, "documents")
    placed = Workspace(spark, "report").write(pack(docs), "placed")
    return fill_report(placed, docs).drop("tokens", "containers", "least_containers", "fill")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least number there could be, and the share of their room that is used."""
    docs = table(spark, d, "documents")
    placed = Workspace(spark, "report").write(pack(docs), "placed")
    return fill_report(placed, docs).select("tokens", "containers", "least_containers", "fill")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, and documents that carry a passage in another order, with the share of it that they cover."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), reordered=True).select("doc_id", "item_id", "longest", "coverage", "edits", "reordered").distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).distinct()


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well levels are met on sources held out of the fit."""
    return grade_quality(table(spark, d, "documents"), table(spark, d, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p6_containers": p6_containers, "p6_report": p6_report, "p6_fill": p6_fill, "p7_found": p7_found, "p7_coverage": p7_coverage, "p8_found": p8_found, "p8_quality": p8_quality}
ORACLE = {
    "p1_found": """
WITH RECURSIVE e AS (SELECT DISTINCT src_node_id AS a, dst_node_id AS b FROM edges
  WHERE regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') = 'similarto' AND src_node_id <> dst_node_id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, seen) AS (SELECT a, a FROM s UNION SELECT s.b, r.seen FROM r JOIN s ON s.a = r.id)
SELECT id AS node_id, min(seen) AS group_id FROM r GROUP BY 1""",
    "p6_report": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS lost_documents, 0::BIGINT AS over_capacity, 0::BIGINT AS needlessly_divided, 0::BIGINT AS gapped FROM documents",
    "p4_found": """
WITH v AS (SELECT vec_id, any_value(model) AS model, any_value(dim) AS dim, any_value(embedding) AS e FROM node_vectors WHERE vec_id IS NOT NULL GROUP BY 1),
u AS (SELECT vec_id, model, dim, e[1:dim]::DOUBLE[] AS e FROM v WHERE e IS NOT NULL AND len(e) >= dim AND len(list_filter(e[1:dim], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e[1:dim], lambda x: x <> 0)) > 0)
SELECT a.vec_id, b.vec_id AS neighbour_id FROM u a JOIN u b ON a.model = b.model AND a.dim = b.dim AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 14) DESC, b.vec_id) <= 5""",
}
