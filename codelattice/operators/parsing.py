"""Queries over parsed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelattice.operators.current import whole_numbers
from codelattice.operators.text import _FILES, _LINES, _files
from codelattice.sources.code import imports, parse_sources


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parse_sources(_files(spark, d)).drop("calls")


def parsed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls by name within a file: caller, callee and how many symbols of the file have that name (0: elsewhere)."""
    s = parse_sources(_files(spark, d))
    keys = ["repo_id", "branch", "file_path"]
    calls = s.select(*keys, F.col("symbol_path").alias("caller"), F.explode("calls").alias("name"))
    names = s.where("kind IN ('function', 'method')").groupBy(*keys, F.substring_index("symbol_path", ".", -1).alias("name")).agg(F.count(F.lit(1)).alias("targets"))
    return calls.withColumn("name", F.substring_index("name", ".", -1)).join(names, [*keys, "name"], "left").select(*keys, "caller", "name", F.coalesce("targets", F.lit(0)).alias("targets")).distinct()


def go_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods that Go files declare, with the line each begins on."""
    s = parse_sources(_files(spark, d)).where("kind IN ('function', 'method') AND signature LIKE 'func%'")
    return s.where(F.col("file_path").endswith(".go")).select("repo_id", "branch", "file_path", "symbol_path", "line_start")


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    """Import lines of all files, counted by what they import."""
    return imports(_files(spark, d)).groupBy("import_path").agg(F.count_distinct("repo_id", "branch", "file_path").alias("files"))


QUERIES = {f.__name__: f for f in (parsed_symbols, parsed_calls, file_imports, go_functions)}
ORACLE = {
    "go_functions": whole_numbers(rf"""WITH {_FILES}, {_LINES}, g AS (SELECT repo_id, branch, file_path, line AS line_start, regexp_extract(ltrim(raw, chr(65279)), '^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)[^)]*\)\s*)?(\w+)', ['owner', 'name']) AS m FROM l WHERE file_path LIKE '%.go')
SELECT repo_id, branch, file_path, CASE WHEN m.owner <> '' THEN m.owner || '.' || m.name ELSE m.name END AS symbol_path, line_start FROM g WHERE m.name <> ''""", "line_start"),
    "file_imports": rf"""WITH {_FILES}, i AS (SELECT repo_id, branch, file_path, unnest(CASE WHEN file_path LIKE '%.go' THEN regexp_extract_all(content, '(?m)^\s*(?:import\s+)?(?:(?:\w+|\.|_)\s+)?"([\w./~-]+)"\s*$', 1)
 ELSE regexp_extract_all(content, '(?m)^\s*(?:import|export)\b[^''"\n]*\bfrom\s+[''"]([^''"]+)[''"]', 1) END) AS import_path FROM f WHERE content IS NOT NULL)
SELECT import_path, count(DISTINCT (repo_id, branch, file_path)) AS files FROM i GROUP BY 1""",
}
