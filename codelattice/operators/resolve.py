"""Resolving names to symbols: cross-repo stubs by longest module prefix, calls by directory and unique suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.functions.text import directory
from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_edges, current_nodes
from codelattice.operators.lookup import longest_prefix
from codelattice.sources.tables import table


def unique_or_none(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The one production symbol a key has, else the one test symbol, else nothing: (keys, node_id)."""
    g = hits.groupBy(*keys).agg(F.count_distinct(F.when(~F.col("test"), F.col("node_id"))).alias("prod"), F.min(F.when(~F.col("test"), F.col("node_id"))).alias("p"), F.count_distinct(F.when(F.col("test"), F.col("node_id"))).alias("tests"), F.min(F.when(F.col("test"), F.col("node_id"))).alias("t"))
    return g.select(*keys, F.when(F.col("prod") == 1, F.col("p")).when((F.col("prod") == 0) & (F.col("tests") == 1), F.col("t")).alias("node_id")).where("node_id IS NOT NULL")


def resolve_stubs(stubs: DataFrame, repos: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(module_path, symbol, node_id)``: stubs whose module lies in a known repo and whose symbol is unique there.

    The repo is the one with the longest module path that is a prefix of the stub's; the
    rest is the directory; the symbol is the node's whole path or its last segment.
    """
    s = stubs.select("module_path", "symbol").where("module_path IS NOT NULL AND symbol IS NOT NULL").distinct()
    at = longest_prefix(s.select(F.col("module_path").alias("path")), repos.select("repo_id", "module_path").where("module_path IS NOT NULL").distinct()).select(F.col("path").alias("full"), "module_path", "repo_id")
    located = s.withColumnRenamed("module_path", "full").join(at, "full").withColumn("dir", F.regexp_replace(F.expr("substring(full, length(module_path) + 1)"), "^/", ""))
    n = nodes.where(~F.col("kind").isin(*P.CONTAINER_KINDS) & F.col("symbol_path").isNotNull())
    n = n.select("repo_id", directory(F.col("file_path")).alias("dir"), "node_id", P.is_test_file(F.col("file_path")).alias("test"), F.explode(F.array_distinct(F.array("symbol_path", P.last_segment(F.col("symbol_path"))))).alias("symbol"))
    hits = located.join(n, ["repo_id", "dir", "symbol"])
    return unique_or_none(hits, ["full", "symbol"]).select(F.col("full").alias("module_path"), "symbol", "node_id")


def _stubs(spark: SparkSession, d: str) -> DataFrame:
    """Edges into another repo, as the (module path, symbol) a parser would have left."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    repos = table(spark, d, "repos").select("repo_id", "module_path").where("module_path IS NOT NULL").distinct()
    e = current_edges(table(spark, d, "edges")).where("branch = 'main' AND kind IN ('calls', 'similarto')")
    dst = n.join(repos, "repo_id").select(F.col("node_id").alias("dst_node_id"), F.col("repo_id").alias("dst_repo"), F.regexp_replace(F.concat_ws("/", "module_path", directory(F.col("file_path"))), "/$", "").alias("module_path"), F.col("symbol_path").alias("symbol"))
    return e.join(dst, "dst_node_id").where("repo_id <> dst_repo").select("edge_id", "src_node_id", "dst_node_id", "module_path", "symbol")


def cross_repo_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Outbound: what each cross-repo edge resolves to from names alone."""
    s = _stubs(spark, d)
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    return s.join(resolve_stubs(s, table(spark, d, "repos"), n), ["module_path", "symbol"]).select("edge_id", "module_path", "symbol", "node_id")


def inbound_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Inbound: how many foreign edges name each node."""
    return cross_repo_stubs(spark, d).groupBy("node_id").agg(F.count_distinct("edge_id").alias("foreign"))


def calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Calls resolved by name: the only symbol of that name in the caller's directory, else the only one in its repo."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main' AND symbol_path IS NOT NULL")
    e = current_edges(table(spark, d, "edges")).where("branch = 'main' AND kind = 'calls'")
    code = n.where("kind IN ('function', 'method')").select("node_id", "repo_id", directory(F.col("file_path")).alias("dir"), P.last_segment(F.col("symbol_path")).alias("name"), P.is_test_file(F.col("file_path")).alias("test"))
    src = code.select(F.col("node_id").alias("src_node_id"), F.col("repo_id").alias("r"), "dir")
    dst = code.select(F.col("node_id").alias("dst_node_id"), "name")
    calls = e.select("edge_id", "src_node_id", "dst_node_id").join(src, "src_node_id").join(dst, "dst_node_id").withColumnRenamed("r", "repo_id")
    near = unique_or_none(code, ["repo_id", "dir", "name"]).withColumnRenamed("node_id", "near")
    wide = unique_or_none(code, ["repo_id", "name"]).withColumnRenamed("node_id", "wide")
    j = calls.join(near, ["repo_id", "dir", "name"], "left").join(wide, ["repo_id", "name"], "left")
    rule = F.when(F.col("near").isNotNull(), "directory").when(F.col("wide").isNotNull(), "repo").otherwise("none")
    return j.select("edge_id", rule.alias("rule"), F.coalesce("near", "wide").alias("node_id"))


def qualified_calls(calls: DataFrame, imports: DataFrame, repos: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(repo_id, branch, file_path, caller, name, node_id, rule)``: what a call by name means.

    ``calls`` (repo_id, branch, file_path, caller, name), ``imports`` (the same file,
    import_path, alias).  ``alias.Name`` is a symbol of the imported package, by longest
    module prefix; any other name is a symbol of the caller's file, else of its directory,
    else the only one of that name in its repo, with and without its receiver.  What is
    in none of them, or twice, stays unresolved; null names are left out.
    """
    at = ["repo_id", "branch", "file_path"]
    c = calls.where("name IS NOT NULL").select(*at, "caller", "name").distinct()
    c = c.withColumn("head", F.substring_index("name", ".", 1)).withColumn("last", P.last_segment(F.col("name"))).withColumn("dir", directory(F.col("file_path")))
    i = imports.select(*at, F.col("alias").alias("head"), "import_path").dropDuplicates([*at, "head"])
    q = c.where(F.col("name").contains(".")).join(i, [*at, "head"])
    by_import = resolve_stubs(q.select(F.col("import_path").alias("module_path"), F.expr("substring(name, length(head) + 2)").alias("symbol")), repos, nodes)
    q = q.withColumn("rest", F.expr("substring(name, length(head) + 2)"))
    found = q.join(by_import.select(F.col("module_path").alias("import_path"), F.col("symbol").alias("rest"), F.col("node_id").alias("imported")), ["import_path", "rest"], "left").select(*at, "caller", "name", F.lit(True).alias("is_import"), "imported")
    code = nodes.where("kind IN ('function', 'method', 'class') AND symbol_path IS NOT NULL").select("repo_id", "branch", "file_path", directory(F.col("file_path")).alias("dir"), "node_id", P.is_test_file(F.col("file_path")).alias("test"), F.explode(F.array_distinct(F.array("symbol_path", P.last_segment(F.col("symbol_path"))))).alias("want"))
    asked = c.join(found.select(*at, "caller", "name").distinct(), [*at, "caller", "name"], "left_anti").withColumn("want", F.explode(F.array_distinct(F.array("name", "last"))))
    out = c.join(found, [*at, "caller", "name"], "left")
    for rule, keys in (("file", [*at, "want"]), ("directory", ["repo_id", "branch", "dir", "want"]), ("repo", ["repo_id", "branch", "want"])):
        one = unique_or_none(code, keys)
        hit = asked.join(one, keys).groupBy(*at, "caller", "name").agg(F.min_by("node_id", F.struct(F.col("want") != F.col("name"), F.col("node_id"))).alias(rule))
        out = out.join(hit, [*at, "caller", "name"], "left")
    rule = F.when(F.col("imported").isNotNull(), "import").when(F.col("is_import"), "external").when(F.col("file").isNotNull(), "file").when(F.col("directory").isNotNull(), "directory").when(F.col("repo").isNotNull(), "repo").otherwise("unresolved")
    return out.select(*at, "caller", "name", F.when(F.col("is_import"), F.col("imported")).otherwise(F.coalesce("file", "directory", "repo")).alias("node_id"), rule.alias("rule"))


def symbol_repos(spark: SparkSession, d: str) -> DataFrame:
    """In how many repos each symbol name stands, and the first of them."""
    n = current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*P.CONTAINER_KINDS))
    return n.groupBy("symbol_path").agg(F.count_distinct("repo_id").alias("repos"), F.min("repo_id").alias("first_repo")).where("repos > 1 AND symbol_path IS NOT NULL")


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges after upsert: one for each key, score kept from the last promotion that had one, and edges without both ends dropped."""
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "branch")
    e = current_edges(table(spark, d, "edges"))
    e = e.join(n.withColumnRenamed("node_id", "src_node_id"), ["src_node_id", "branch"], "left_semi").join(n.withColumnRenamed("node_id", "dst_node_id"), ["dst_node_id", "branch"], "left_semi")
    return e.select("edge_id", "branch", "kind", F.round(F.col("score").cast("double"), 5).alias("score"), P.rank_of(F.col("confidence"), P.CONFIDENCES).alias("confidence_rank"))


_TEST = r"coalesce(regexp_matches(parse_filename(file_path), '_test\.go$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$'), false)"
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END"
_PICK = "CASE WHEN count(DISTINCT node_id) FILTER (NOT test) = 1 THEN min(node_id) FILTER (NOT test) WHEN count(*) FILTER (NOT test) = 0 AND count(DISTINCT node_id) = 1 THEN min(node_id) END"
_CONT = ", ".join(f"'{x}'" for x in P.CONTAINER_KINDS)
_STUBS = f"""WITH {SQL}, m AS (SELECT DISTINCT repo_id, module_path FROM repos WHERE module_path IS NOT NULL), n AS (SELECT * FROM cn WHERE branch = 'main'),
st AS (SELECT e.edge_id, regexp_replace(m.module_path || '/' || coalesce({_DIR}, ''), '/$', '') AS module_path, n.symbol_path AS symbol FROM ce e JOIN n ON n.node_id = e.dst_node_id JOIN m ON m.repo_id = n.repo_id
 WHERE e.branch = 'main' AND e.kind IN ('calls', 'similarto') AND e.repo_id <> n.repo_id),
lp AS (SELECT DISTINCT s.module_path, m.repo_id, regexp_replace(substr(s.module_path, length(m.module_path) + 1), '^/', '') AS dir FROM st s JOIN m ON s.module_path = m.module_path OR starts_with(s.module_path, m.module_path || '/')
 QUALIFY rank() OVER (PARTITION BY s.module_path ORDER BY length(m.module_path) DESC, m.repo_id) = 1),
nd AS (SELECT repo_id, {_DIR} AS dir, node_id, {_TEST} AS test, symbol_path, split_part(symbol_path, '.', -1) AS last FROM n WHERE kind NOT IN ({_CONT}) AND symbol_path IS NOT NULL),
rs AS (SELECT s.module_path, s.symbol, {_PICK} AS node_id FROM (SELECT DISTINCT module_path, symbol FROM st WHERE symbol IS NOT NULL) s JOIN lp ON lp.module_path = s.module_path JOIN nd ON nd.repo_id = lp.repo_id AND nd.dir = lp.dir AND (nd.symbol_path = s.symbol OR nd.last = s.symbol) GROUP BY 1, 2),
out AS (SELECT st.edge_id, st.module_path, st.symbol, rs.node_id FROM st JOIN rs ON rs.module_path = st.module_path AND rs.symbol = st.symbol WHERE rs.node_id IS NOT NULL)"""
QUERIES = {f.__name__: f for f in (cross_repo_stubs, inbound_stubs, calls_resolved, symbol_repos, merged_edges)}
ORACLE = {
    "cross_repo_stubs": _STUBS + " SELECT * FROM out",
    "inbound_stubs": _STUBS + " SELECT node_id, count(DISTINCT edge_id) AS foreign FROM out GROUP BY 1",
    "calls_resolved": f"""WITH {SQL}, c AS (SELECT node_id, repo_id, {_DIR} AS dir, split_part(symbol_path, '.', -1) AS name, {_TEST} AS test FROM cn WHERE branch = 'main' AND symbol_path IS NOT NULL AND kind IN ('function', 'method')),
a AS (SELECT repo_id, dir, name, {_PICK} AS near FROM c GROUP BY 1, 2, 3), b AS (SELECT repo_id, name, {_PICK} AS wide FROM c GROUP BY 1, 2)
SELECT e.edge_id, CASE WHEN near IS NOT NULL THEN 'directory' WHEN wide IS NOT NULL THEN 'repo' ELSE 'none' END AS rule, coalesce(near, wide) AS node_id FROM ce e JOIN c s ON s.node_id = e.src_node_id JOIN c t ON t.node_id = e.dst_node_id
LEFT JOIN a ON a.repo_id = s.repo_id AND a.dir = s.dir AND a.name = t.name LEFT JOIN b ON b.repo_id = s.repo_id AND b.name = t.name WHERE e.branch = 'main' AND e.kind = 'calls'""",
    "symbol_repos": f"WITH {SQL} SELECT symbol_path, count(DISTINCT repo_id) AS repos, min(repo_id) AS first_repo FROM cn WHERE kind NOT IN ({_CONT}) AND symbol_path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo_id) > 1",
    "merged_edges": f"""WITH {SQL} SELECT edge_id, branch, kind, round(score::DOUBLE, 5) AS score, list_position(['unresolved', 'probable', 'strong', 'definite'], confidence) - 1 AS confidence_rank FROM ce e
WHERE EXISTS (SELECT 1 FROM cn WHERE cn.node_id = e.src_node_id AND cn.branch = e.branch) AND EXISTS (SELECT 1 FROM cn WHERE cn.node_id = e.dst_node_id AND cn.branch = e.branch)""",
}
