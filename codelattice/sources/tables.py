"""Parquet readers for the tables the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_kind(kind: Column) -> Column:
    """Edge or node kind without regard to letter case, blanks and separators: ``Similar To`` -> ``similarto``."""
    return F.regexp_replace(F.lower(kind), "[^a-z0-9]", "")


def edges_of_kind(edges: DataFrame, kind: str) -> DataFrame:
    """Rows of ``edges`` whose kind is ``kind`` in any spelling; a null kind never matches."""
    wanted = "".join(c for c in kind.lower() if c.isalnum())
    return edges.where(canonical_kind(F.col("kind")) == wanted)
