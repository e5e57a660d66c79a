"""Lookups: symbols, id prefixes, enclosing spans, finding lists, exported symbols, module prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_nodes, latest, whole_numbers
from codelattice.sources.tables import table


def symbol_matches(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes whose symbol is a wanted ``symbol`` or ends in ``.symbol``, case-sensitive.

    Every dot-suffix of a symbol is a key, so this is a hash join, whatever the number of
    wanted symbols.  Null symbols never match; ``exact`` tells the two ways apart.
    """
    parts = F.split("symbol_path", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    keyed = nodes.where(F.col("symbol_path").isNotNull()).withColumn("symbol", F.explode(F.array_distinct(suffixes)))
    found = keyed.join(symbols.select("symbol").where("symbol IS NOT NULL").distinct(), "symbol")
    return found.withColumn("exact", F.col("symbol") == F.col("symbol_path"))


def find_symbol_order() -> list:
    """Exact name first, then no containers, then name, repo, id."""
    return [F.col("exact").desc(), F.col("kind").isin(*P.CONTAINER_KINDS).asc(), F.col("symbol_path").asc(), F.col("repo_id").asc(), F.col("node_id").asc(), F.col("branch").asc()]


def resolve_prefixes(ids: DataFrame, prefixes: DataFrame, length: int = 4) -> DataFrame:
    """``(prefix, id, matches)``: the one id that starts with a prefix, null where none or several do.

    Joined on the first ``length`` characters, so prefixes must be that long; shorter ones match nothing.
    """
    a = ids.select("id").distinct().withColumn("k_", F.substring("id", 1, length))
    b = prefixes.select("prefix").distinct().withColumn("k_", F.when(F.length("prefix") >= length, F.substring("prefix", 1, length)))
    hit = b.join(a, (b["k_"] == a["k_"]) & a["id"].startswith(b["prefix"]), "left")
    g = hit.groupBy("prefix").agg(F.count("id").alias("matches"), F.min("id").alias("one"))
    return g.select("prefix", F.when(F.col("matches") == 1, F.col("one")).alias("id"), "matches")


def enclosing(nodes: DataFrame, places: DataFrame, bucket: int = 64) -> DataFrame:
    """The node with the smallest span round each (repo_id, branch, file_path, line); ties by node_id.

    A range join in buckets of ``bucket`` lines: spans are laid into the buckets they touch.
    Zero or null lines enclose nothing; places without an enclosing node give no row.
    """
    keys = ["repo_id", "branch", "file_path"]
    spans = nodes.where("line_start > 0 AND line_end >= line_start AND kind NOT IN ('file', 'package', 'module')").select(*keys, "node_id", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / bucket), F.floor(F.col("line_end") / bucket))).alias("b_"))
    at = places.withColumn("b_", F.floor(F.col("line") / bucket))
    hit = at.join(spans, [*keys, "b_"]).where("line BETWEEN line_start AND line_end")
    best = F.min_by("node_id", F.struct(F.col("line_end") - F.col("line_start"), F.col("node_id")))
    return hit.groupBy(*keys, "line").agg(best.alias("node_id"))


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """(path) -> the longest module that is the path or a directory prefix of it, by exploding the path's prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    keyed = paths.select("path").where("path IS NOT NULL").distinct().select("path", F.explode(prefixes).alias("module_path"))
    hit = keyed.join(modules.where("module_path IS NOT NULL"), "module_path")
    return latest(hit, ["path"], [F.length("module_path").desc(), F.col("repo_id").asc()])


def _open(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings")
    return latest(f, ["finding_id", "branch"], [F.col("created_at").desc_nulls_last(), F.col("state").asc(), F.col("severity").asc()])


def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every method's bare name looked up among all nodes of the main branch: best hit each."""
    nodes = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    wanted = nodes.where("kind = 'method'").select(P.last_segment(F.col("symbol_path")).alias("symbol"))
    hits = symbol_matches(nodes.select("node_id", "branch", "repo_id", "kind", "symbol_path"), wanted)
    w = Window.partitionBy("symbol").orderBy(*find_symbol_order())
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return hits.withColumn("hits", n).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("symbol", "node_id", "symbol_path", "hits")


def id_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Six-character prefixes of all node ids."""
    nodes = table(spark, d, "nodes")
    return resolve_prefixes(nodes.select(F.col("node_id").alias("id")), nodes.select(F.substring("node_id", 1, 6).alias("prefix")))


def enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    """Enclosing symbol of every call line."""
    nodes = current_nodes(table(spark, d, "nodes"))
    e = table(spark, d, "edges").where("src_line > 0").select("src_node_id", "branch", F.col("src_line").alias("line"))
    files = nodes.where("kind IN ('function', 'method')").select(F.col("node_id").alias("src_node_id"), "branch", "repo_id", "file_path")
    return enclosing(nodes, e.join(files, ["src_node_id", "branch"]).select("repo_id", "branch", "file_path", "line").distinct())


def file_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each file in order of their lines, summarised."""
    n = current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*P.CONTAINER_KINDS))
    w = Window.partitionBy("repo_id", "branch", "file_path").orderBy(F.coalesce("line_start", F.lit(0)), "node_id")
    summary = F.coalesce("short_summary", P.heuristic_summary(F.col("signature"), F.col("kind"), F.col("symbol_path")))
    return n.select("repo_id", "branch", "file_path", "node_id", F.row_number().over(w).alias("place"), summary.alias("summary"))


def exported_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = current_nodes(table(spark, d, "nodes"))
    keep = F.col("kind").isin(*P.EXPORTED_KINDS) & F.coalesce("exported", F.lit(False)) & ~P.is_test_file(F.col("file_path"))
    return n.where(keep).select("file_path", "node_id", "branch", "symbol_path", "kind")


def path_classes(spark: SparkSession, d: str) -> DataFrame:
    """Path predicates over all files of the graph, counted."""
    p = F.col("file_path")
    n = table(spark, d, "nodes").select("file_path").distinct()
    return n.groupBy(P.is_test_file(p).alias("test"), P.is_vendored(p).alias("vendored"), P.is_noise_path(p).alias("noise")).agg(F.count(F.lit(1)).alias("files"))


def findings_list(spark: SparkSession, d: str) -> DataFrame:
    """Open findings of at least medium severity without a live suppression, with their anchor's path."""
    f = _open(spark, d).where("state = 'open'").where(P.rank_of(F.col("severity"), P.SEVERITIES) >= 2)
    as_of = F.lit("2026-07-01").cast("timestamp_ntz")
    s = table(spark, d, "suppressions").where(F.lower(F.trim("scope")) == "finding").where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    s = s.groupBy(F.lower(F.trim("target")).alias("finding_id")).agg(F.min("suppression_id").alias("suppression_id"))
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "branch", F.col("file_path").alias("anchor_path"))
    out = f.join(s.select(F.col("finding_id")), "finding_id", "left_anti").join(n, ["node_id", "branch"], "left")
    return out.select("finding_id", "branch", "rule", "severity", F.coalesce("anchor_path", "file_path").alias("path"))


def findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    f = _open(spark, d)
    return f.groupBy("rule").agg(F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "closed").alias("closed"), F.count_distinct(F.when(F.col("state") == "open", F.col("node_id"))).alias("open_nodes"))


def repo_of_import(spark: SparkSession, d: str) -> DataFrame:
    """Longest module prefix of every import path (here: each module path with each of its files' directories)."""
    repos = table(spark, d, "repos").select("repo_id", "module_path").where("module_path IS NOT NULL").distinct()
    n = table(spark, d, "nodes").select("repo_id", "file_path").distinct()
    paths = n.join(repos, "repo_id").select(F.concat_ws("/", "module_path", F.regexp_replace("file_path", "/[^/]*$", "")).alias("path"))
    return longest_prefix(paths, repos).select("path", "module_path", "repo_id")


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_TEST = r"coalesce(regexp_matches(parse_filename(file_path), '_test\.go$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$'), false)"
_OPEN = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"

QUERIES = {f.__name__: f for f in (symbol_lookup, id_prefix, enclosing_span, file_nodes, exported_symbols, path_classes, findings_list, findings_by_rule, repo_of_import)}
ORACLE = {
    "symbol_lookup": f"""WITH {SQL}, m AS (SELECT * FROM cn WHERE branch = 'main'),
w AS (SELECT DISTINCT split_part(symbol_path, '.', -1) AS symbol FROM m WHERE kind = 'method'),
h AS (SELECT w.symbol, m.*, m.symbol_path = w.symbol AS exact FROM m JOIN w ON m.symbol_path = w.symbol OR ends_with(m.symbol_path, '.' || w.symbol))
SELECT symbol, node_id, symbol_path, hits FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS hits,
 row_number() OVER (PARTITION BY symbol ORDER BY exact DESC, (kind IN ({_IN(P.CONTAINER_KINDS)})), symbol_path, repo_id, node_id, branch) AS rn FROM h) WHERE rn = 1""",
    "id_prefix": "SELECT substr(node_id, 1, 6) AS prefix, CASE WHEN count(DISTINCT node_id) = 1 THEN min(node_id) END AS id, count(DISTINCT node_id) AS matches FROM nodes GROUP BY 1",
    "enclosing_span": f"""WITH {SQL}, p AS (SELECT DISTINCT n.repo_id, n.branch, n.file_path, e.src_line AS line FROM edges e JOIN cn n ON n.node_id = e.src_node_id AND n.branch = e.branch
  WHERE e.src_line > 0 AND n.kind IN ('function', 'method'))
SELECT p.repo_id, p.branch, p.file_path, p.line, arg_min(n.node_id, (n.line_end - n.line_start, n.node_id)) AS node_id FROM p JOIN cn n
 ON n.repo_id = p.repo_id AND n.branch = p.branch AND n.file_path = p.file_path AND p.line BETWEEN n.line_start AND n.line_end AND n.line_start > 0 AND n.kind NOT IN ('file', 'package', 'module') GROUP BY 1, 2, 3, 4""",
    "file_nodes": f"""WITH {SQL} SELECT repo_id, branch, file_path, node_id, row_number() OVER (PARTITION BY repo_id, branch, file_path ORDER BY coalesce(line_start, 0), node_id) AS place,
coalesce(short_summary, substr(coalesce(nullif(trim(signature), ''), concat_ws(' ', kind, symbol_path)), 1, 280)) AS summary FROM cn WHERE kind NOT IN ({_IN(P.CONTAINER_KINDS)})""",
    "exported_symbols": f"WITH {SQL} SELECT file_path, node_id, branch, symbol_path, kind FROM cn WHERE kind IN ({_IN(P.EXPORTED_KINDS)}) AND coalesce(exported, false) AND NOT {_TEST}",
    "path_classes": f"""SELECT {_TEST} AS test, coalesce(len(list_intersect(string_split(file_path, '/'), [{_IN(P.VENDORED_SEGMENTS)}])) > 0, false) AS vendored,
coalesce(ends_with(lower(file_path), '_test.go') OR ends_with(lower(file_path), '.d.ts') OR contains(lower(file_path), '/legacy/') OR contains(lower(file_path), '/examples/') OR contains(lower(file_path), '/vendor/') OR contains(lower(file_path), '/testdata/'), false) AS noise, count(*) AS files FROM (SELECT DISTINCT file_path FROM nodes) GROUP BY 1, 2, 3""",
    "findings_list": f"""WITH {SQL}, {_OPEN} SELECT f.finding_id, f.branch, f.rule, f.severity, coalesce(n.file_path, f.file_path) AS path FROM cf f LEFT JOIN cn n ON n.node_id = f.node_id AND n.branch = f.branch
WHERE f.state = 'open' AND f.severity IN ('medium', 'high', 'critical') AND NOT EXISTS (SELECT 1 FROM suppressions s WHERE lower(trim(s.scope)) = 'finding' AND lower(trim(s.target)) = f.finding_id
  AND (s.expires_at IS NULL OR s.expires_at > TIMESTAMP '2026-07-01'))""",
    "findings_by_rule": f"WITH {_OPEN} SELECT rule, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'closed') AS closed, count(DISTINCT node_id) FILTER (state = 'open') AS open_nodes FROM cf GROUP BY 1",
    "repo_of_import": """WITH r AS (SELECT DISTINCT repo_id, module_path FROM repos WHERE module_path IS NOT NULL),
p AS (SELECT DISTINCT r.module_path || '/' || regexp_replace(n.file_path, '/[^/]*$', '') AS path FROM nodes n JOIN r USING (repo_id) WHERE n.file_path IS NOT NULL)
SELECT p.path, r.module_path, r.repo_id FROM p JOIN r ON p.path = r.module_path OR starts_with(p.path, r.module_path || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(r.module_path) DESC, r.repo_id) = 1""",
}
ORACLE["file_nodes"] = whole_numbers(ORACLE["file_nodes"], "place")
