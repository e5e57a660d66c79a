"""Latest-wins views of the graph tables: what stands after all promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelattice.sources.tables import canonical_kind


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order``; null keys are keys of their own.

    ``row_number() = 1`` is cut before the shuffle, so a hot key sends one row a task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as last promoted; of rows of the same time the one with the least content hash."""
    return latest(nodes, ["node_id", "branch"], [F.col("last_promoted_at").desc_nulls_last(), F.col("content_hash").asc_nulls_first()])


def current_edges(edges: DataFrame) -> DataFrame:
    """Edges as last promoted, kind in its canonical spelling; a missing score keeps the last known one."""
    e = edges.withColumn("kind", canonical_kind(F.col("kind")))
    scored = F.when(F.col("score").isNotNull(), F.struct(F.coalesce("last_promoted_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("score")))
    known = F.max(scored).over(Window.partitionBy("edge_id", "branch"))
    e = e.withColumn("score", known["score"])
    return latest(e, ["edge_id", "branch"], [F.col("last_promoted_at").desc_nulls_last(), F.col("confidence").asc_nulls_first(), F.col("resolved").asc_nulls_first()])


SQL_KIND = "regexp_replace(lower(kind), '[^a-z0-9]', '', 'g')"
SQL = f"""
cn AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at DESC NULLS LAST, content_hash ASC NULLS FIRST) = 1),
ce AS (SELECT * REPLACE ({SQL_KIND} AS kind, arg_max(score, last_promoted_at) FILTER (score IS NOT NULL) OVER (PARTITION BY edge_id, branch) AS score) FROM edges
  QUALIFY row_number() OVER (PARTITION BY edge_id, branch ORDER BY last_promoted_at DESC NULLS LAST, confidence ASC NULLS FIRST, resolved ASC NULLS FIRST) = 1)"""


def whole_numbers(sql: str, *columns: str) -> str:
    """The query with columns as 32-bit integers, as Spark counts ranks and lines."""
    return "SELECT * REPLACE (" + ", ".join(f"{c}::INTEGER AS {c}" for c in columns) + f") FROM ({sql})"
