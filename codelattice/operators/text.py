"""Text queries: to-do scan, chunk ranges, redaction, tokenisers, URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.functions import text as T
from codelattice.operators.current import SQL, current_nodes, whole_numbers
from codelattice.sources.tables import table

CHUNK_LINES = 80


def source_lines(files: DataFrame) -> DataFrame:
    """(repo_id, branch, file_path, line, text): one row a line, from 1; CR at line ends dropped."""
    return files.where("content IS NOT NULL").select("repo_id", "branch", "file_path", F.posexplode(F.split("content", "\n")).alias("line", "text")).select("repo_id", "branch", "file_path", (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def todos(files: DataFrame) -> DataFrame:
    """Comment lines that start with a to-do marker: marker, line and what it says."""
    pattern = r"^\s*(?://+|#+|/\*+|\*)\s*(" + "|".join(T.TODO_MARKERS) + r")(?:[^A-Za-z0-9_]|$)"
    marker = F.regexp_extract("text", pattern, 1)
    found = source_lines(files).withColumn("marker", marker).where("marker <> ''")
    return found.select("repo_id", "branch", "file_path", "line", "marker", F.trim(F.regexp_replace("text", r"^\s*(?://+|#+|/\*+|\*)\s*", "")).alias("text"))


def uncovered_chunks(nodes: DataFrame, files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Line ranges of each file that no symbol covers, in windows of ``size`` lines: gaps between merged spans."""
    keys = ["repo_id", "branch", "file_path"]
    spans = nodes.where("line_start > 0 AND line_end >= line_start AND kind NOT IN ('file', 'package', 'module', 'chunk')").select(*keys, "line_start", "line_end")
    ends = files.select(*keys, (F.col("n_lines") + 1).alias("line_start"), (F.col("n_lines") + 1).alias("line_end"))
    w = Window.partitionBy(*keys).orderBy("line_start", "line_end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("line_end").over(w), F.lit(0))
    inside = files.select(*keys)
    gaps = spans.join(inside, keys, "left_semi").unionByName(ends).withColumn("a", before + 1).withColumn("b", F.col("line_start") - 1).where("b >= a")
    gaps = gaps.select(*keys, "a", "b", F.explode(F.sequence("a", "b", F.lit(size))).alias("from_line"))
    return gaps.select(*keys, "from_line", F.least(F.col("from_line") + size - 1, F.col("b")).alias("to_line"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").dropDuplicates(["repo_id", "branch", "file_path"])


def todo_scan(spark: SparkSession, d: str) -> DataFrame:
    return todos(_files(spark, d))


def todo_findings(spark: SparkSession, d: str) -> DataFrame:
    """One finding a file: how many markers, and the first five in line order."""
    t = todos(_files(spark, d))
    w = Window.partitionBy("repo_id", "branch", "file_path").orderBy("line")
    t = t.withColumn("k", F.row_number().over(w))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "marker", "line")))), lambda x: F.concat(x["marker"], F.lit(":"), x["line"].cast("string"))), ",")
    return t.groupBy("repo_id", "branch", "file_path").agg(F.count(F.lit(1)).alias("markers"), first.alias("first_markers"))


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).select("repo_id", "branch", "file_path", "n_lines").where("n_lines IS NOT NULL")
    return uncovered_chunks(current_nodes(table(spark, d, "nodes")), files).distinct()


def symbol_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols hold each token of their path."""
    s = table(spark, d, "nodes").select("symbol_path").where("symbol_path IS NOT NULL").distinct()
    return s.select("symbol_path", F.explode(F.array_distinct(T.symbol_tokens(F.col("symbol_path")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("symbols"))


def ident_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "nodes").select("symbol_path").where("symbol_path IS NOT NULL").distinct()
    return s.select("symbol_path", F.array_join(T.identifier_parts(F.col("symbol_path")), " ").alias("parts"))


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every document after redaction."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact(F.coalesce("text", F.lit(""))), 256).alias("digest"))


def repo_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "repos").select("repo_id", T.canonical_url(F.col("canonical_url")).alias("url"))


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids made of repo, path, kind and name, and clipped snippets."""
    n = current_nodes(table(spark, d, "nodes"))
    return n.select("node_id", "branch", T.stable_id(F.col("repo_id"), F.col("file_path"), F.col("kind"), F.col("symbol_path")).alias("made"), T.stable_id(F.col("node_id"), F.col("kind"), length=32).alias("short"))


_FILES = "f AS (SELECT * FROM source_files QUALIFY row_number() OVER (PARTITION BY repo_id, branch, file_path) = 1)"
_LINES = "l AS (SELECT repo_id, branch, file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, unnest(string_split(content, chr(10))) AS raw FROM f WHERE content IS NOT NULL)"
_LEAD = r"^\s*(?://+|#+|/\*+|\*)\s*"
_TODO = rf"""WITH {_FILES}, {_LINES}, t AS (SELECT repo_id, branch, file_path, line, regexp_extract(raw, '{_LEAD}(TODO|FIXME|XXX)(?:[^A-Za-z0-9_]|$)', 1) AS marker,
trim(regexp_replace(regexp_replace(raw, '\r$', ''), '{_LEAD}', '')) AS text FROM l)"""
_CAMEL = r"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
_DIGIT = r"regexp_replace(regexp_replace({x}, '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
_PARTS = _DIGIT.format(x=_CAMEL.format(x="c"))
SQL_TOKENS = f"""(SELECT s, lower(t) AS token FROM (SELECT s, unnest(string_split(c || CASE WHEN position(' ' IN p) > 0 THEN ' ' || p ELSE '' END, ' ')) AS t FROM
 (SELECT s, c, {_PARTS} AS p FROM (SELECT s, unnest(string_split(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS c FROM {{src}}) WHERE c <> '')) WHERE t <> '')"""
_IDENT = _CAMEL.format(x="symbol_path")

QUERIES = {f.__name__: f for f in (todo_scan, todo_findings, chunk_ranges, symbol_token_counts, ident_split, redacted_documents, repo_urls, node_ids)}
ORACLE = {
    "todo_scan": _TODO + " SELECT * FROM t WHERE marker <> ''",
    "todo_findings": _TODO + " SELECT repo_id, branch, file_path, count(*) AS markers, array_to_string(list(marker || ':' || line ORDER BY line)[1:5], ',') AS first_markers FROM t WHERE marker <> '' GROUP BY 1, 2, 3",
    "chunk_ranges": f"""WITH {SQL}, {_FILES}, s AS (SELECT n.repo_id, n.branch, n.file_path, n.line_start, n.line_end FROM cn n WHERE n.line_start > 0 AND n.line_end >= n.line_start AND n.kind NOT IN ('file', 'package', 'module', 'chunk')
  AND EXISTS (SELECT 1 FROM f WHERE f.repo_id = n.repo_id AND f.branch = n.branch AND f.file_path = n.file_path AND n_lines IS NOT NULL) UNION ALL SELECT repo_id, branch, file_path, n_lines + 1, n_lines + 1 FROM f WHERE n_lines IS NOT NULL),
g AS (SELECT repo_id, branch, file_path, line_start - 1 AS b, 1 + coalesce(max(line_end) OVER (PARTITION BY repo_id, branch, file_path ORDER BY line_start, line_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s),
c AS (SELECT *, unnest(range(a, b + 1, {CHUNK_LINES})) AS from_line FROM g WHERE b >= a) SELECT DISTINCT repo_id, branch, file_path, from_line, least(from_line + {CHUNK_LINES} - 1, b) AS to_line FROM c""",
    "symbol_token_counts": f"SELECT token, count(DISTINCT s) AS symbols FROM {SQL_TOKENS.format(src='(SELECT DISTINCT symbol_path AS s FROM nodes WHERE symbol_path IS NOT NULL)')} GROUP BY 1",
    "ident_split": rf"SELECT DISTINCT symbol_path, trim(regexp_replace(lower(regexp_replace({_IDENT}, '[_./\-\s]+', ' ', 'g')), ' +', ' ', 'g')) AS parts FROM nodes WHERE symbol_path IS NOT NULL",
    "redacted_documents": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?:sk-|ghp_|xoxb-)[\w\-]+', '[REDACTED]', 'g'), '(Bearer )\S+', '\1[REDACTED]', 'g'),
'(://[^:/\s]+:)[^/\s]+(@)', '\1[REDACTED]\2', 'g'), '(?i)(\b(?:\w*_)?(?:API_KEY|TOKEN|SECRET|PASSWORD|PASSWD)=)\S+', '\1[REDACTED]', 'g')) AS digest FROM documents""",
    "repo_urls": r"SELECT repo_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(canonical_url), '^(?:[a-z+]+://)?(?:[^@/]+@)?', ''), '^([^/:]+):(?:\d+/)?', '\1/'), '(?:\.git)?/*$', '')) AS url FROM repos",
    "node_ids": f"WITH {SQL} SELECT node_id, branch, sha256(coalesce(repo_id, '') || chr(0) || coalesce(file_path, '') || chr(0) || coalesce(kind, '') || chr(0) || coalesce(symbol_path, '')) AS made, substr(sha256(node_id || chr(0) || kind), 1, 32) AS short FROM cn",
}
ORACLE["todo_scan"] = whole_numbers(ORACLE["todo_scan"], "line")
ORACLE["chunk_ranges"] = whole_numbers(ORACLE["chunk_ranges"], "from_line", "to_line")
