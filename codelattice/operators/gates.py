"""Comparing two states of the graph: what a change adds, removes and breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelattice.functions.text import directory
from codelattice.operators import predicates as P
from codelattice.operators.checks import _T, _V, contract_drift, untested
from codelattice.operators.current import SQL, current_edges, current_nodes
from codelattice.operators.graph import blast_radius, strong_components
from codelattice.operators.lookup import _open
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

BASE_TIME = "2026-03-01"


def as_of(nodes: DataFrame, deleted: DataFrame, at: str | None) -> DataFrame:
    """Nodes as they stood at a time: the last promotion up to then, files deleted since gone."""
    if at is not None:
        t = F.lit(at).cast("timestamp_ntz")
        nodes, deleted = nodes.where(F.col("last_promoted_at") <= t), deleted.where(F.col("deleted_at") <= t)
    gone = deleted.groupBy("repo_id", "branch", "file_path").agg(F.max("deleted_at").alias("gone_at"))
    n = current_nodes(nodes).join(gone, ["repo_id", "branch", "file_path"], "left")
    return n.where("gone_at IS NULL OR last_promoted_at > gone_at").drop("gone_at")


def changed_nodes(base: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes that are new or whose content differs, null-safe: (node_id, branch, change)."""
    b = base.select("node_id", "branch", F.col("content_hash").alias("old_hash"), F.lit(True).alias("was"))
    j = after.select("node_id", "branch", F.col("content_hash").alias("new_hash"), F.lit(True).alias("is_")).join(b, ["node_id", "branch"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return j.select("node_id", "branch", change.alias("change")).where("change IS NOT NULL")


def scope_guard(changed: DataFrame, allowed: DataFrame, new: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Changed nodes outside the allowed set: new nodes count as allowed if they hang on it, directly or over new ones.

    All three sets are (node); ``edges`` (src, dst) are taken both ways.  Repeats until nothing joins.
    """
    work = Workspace(changed.sparkSession, "guard")
    both = work.write(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    ok = work.write(allowed.select("node").distinct(), "allowed")
    for _ in range(max_rounds):
        grown = both.join(ok.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).join(new.select("node"), "node", "left_semi").distinct().join(ok, "node", "left_anti")
        grown = work.write(grown, "grown")
        if grown.isEmpty():
            break
        ok = work.write(ok.unionByName(grown), "allowed")
    return changed.select("node").distinct().join(ok, "node", "left_anti")


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, x = table(spark, d, "nodes"), table(spark, d, "deleted_files")
    return as_of(n, x, BASE_TIME), as_of(n, x, None)


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return changed_nodes(*_states(spark, d))


def api_removed(spark: SparkSession, d: str) -> DataFrame:
    """Exported symbols (by directory and name) that are no longer there."""
    base, after = _states(spark, d)
    api = lambda n: n.where(F.col("kind").isin(*P.EXPORTED_KINDS) & F.coalesce("exported", F.lit(False)) & F.col("symbol_path").isNotNull()).select("repo_id", "branch", directory(F.col("file_path")).alias("dir"), "symbol_path").distinct()
    return api(base).join(api(after), ["repo_id", "branch", "dir", "symbol_path"], "left_anti")


def api_gate(spark: SparkSession, d: str) -> DataFrame:
    """Breaking changes for each repo: removed and drifted exported symbols."""
    _, after = _states(spark, d)
    removed = api_removed(spark, d).groupBy("repo_id").agg(F.count(F.lit(1)).alias("removed"))
    drifted = contract_drift(after).where("exported").groupBy("repo_id").agg(F.count(F.lit(1)).alias("drifted"))
    j = removed.join(drifted, "repo_id", "full")
    return j.select("repo_id", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("drifted", F.lit(0)).alias("drifted"))


def clone_gate(spark: SparkSession, d: str) -> DataFrame:
    """Structural groups that have two or more members now and had fewer before."""
    base, after = _states(spark, d)
    count = lambda n, name: n.where("structural_hash IS NOT NULL AND structural_hash <> ''").groupBy("branch", "structural_hash").agg(F.count(F.lit(1)).alias(name))
    j = count(after, "now").join(count(base, "before"), ["branch", "structural_hash"], "left")
    return j.where("now >= 2 AND coalesce(before, 0) < 2").select("branch", "structural_hash", F.coalesce("before", F.lit(0)).alias("before"), "now")


def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Changed nodes without a test."""
    base, after = _states(spark, d)
    lost = untested(after, current_edges(table(spark, d, "edges")), table(spark, d, "repos"))
    changed = changed_nodes(base, after).where("change <> 'removed'")
    return lost.join(changed, ["node_id", "branch"]).select("node_id", "branch", "change")


def cycles_new(spark: SparkSession, d: str) -> DataFrame:
    """Members of call cycles now that were in none, or in no single one, before, where a member changed."""
    work = Workspace(spark, "cycles")
    base, after = (work.write(x.where("branch = 'main'").select("node_id", "branch", "content_hash"), "state") for x in _states(spark, d))
    e = work.write(current_edges(table(spark, d, "edges")).where("branch = 'main' AND kind = 'calls'").select("src_node_id", "dst_node_id", "last_promoted_at"), "calls")
    inside = lambda n: e.join(n.select(F.col("node_id").alias("src_node_id")), "src_node_id", "left_semi").join(n.select(F.col("node_id").alias("dst_node_id")), "dst_node_id", "left_semi")
    pick = lambda x: x.select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst"))
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    old = work.write(strong_components(pick(inside(base).where(F.col("last_promoted_at") <= t))), "old")
    now = work.write(strong_components(pick(inside(after))), "now")
    j = now.join(old.withColumnRenamed("component", "old"), "node", "left")
    same = j.groupBy("component").agg(F.count_distinct("old").alias("olds"), F.count_if(F.col("old").isNull()).alias("without"))
    touched = now.join(changed_nodes(base, after).select(F.col("node_id").alias("node")), "node", "left_semi").select("component").distinct()
    new = same.where("olds <> 1 OR without > 0").join(touched, "component", "left_semi")
    return now.join(new.select("component"), "component", "left_semi").select("node", "component")


def guard_report(spark: SparkSession, d: str) -> DataFrame:
    """Changed nodes of the main branch outside the blast radius of open high findings."""
    work = Workspace(spark, "scope")
    base, after = _states(spark, d)
    changed = work.write(changed_nodes(base, after).where("branch = 'main' AND change <> 'removed'"), "changed")
    seeds = _open(spark, d).where("state = 'open' AND severity IN ('high', 'critical') AND branch = 'main' AND node_id IS NOT NULL").select(F.lit("all").alias("origin"), F.col("node_id").alias("node")).distinct()
    e = work.write(current_edges(table(spark, d, "edges")).where("branch = 'main'").select(F.col("src_node_id").alias("src"), F.col("dst_node_id").alias("dst")), "edges")
    near = blast_radius(e, seeds, hub=None)
    return scope_guard(changed.select(F.col("node_id").alias("node")), near, changed.where("change = 'added'").select(F.col("node_id").alias("node")), e)


def new_findings(spark: SparkSession, d: str) -> DataFrame:
    """Finding ids made since the base time that no earlier finding had: EXCEPT."""
    f = _open(spark, d)
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    return f.where(F.col("created_at") > t).select("finding_id").exceptAll(f.where(F.col("created_at") <= t).select("finding_id")).distinct()


def security_gate(added: DataFrame, base: DataFrame, candidate: DataFrame, advisories: DataFrame | None) -> DataFrame:
    """``(repo_id, new_secrets, new_vulnerable, vuln_checked, passed)`` for each repo of a change.

    ``added`` (repo_id, file_path, line_no, text) are lines the change adds; ``base`` and
    ``candidate`` (repo_id, name, version) what manifests require before and after.  A
    vulnerable dependency is new if its repo, package and advisory were not there before, whatever the
    version.  Without ``advisories`` that part does not apply and does not fail the change.
    """
    from codelattice.operators.checks import secrets, vulnerable

    repos = added.select("repo_id").unionByName(candidate.select("repo_id")).unionByName(base.select("repo_id")).distinct()
    leaks = secrets(added).groupBy("repo_id").agg(F.count(F.lit(1)).alias("new_secrets"))
    out = repos.join(leaks, "repo_id", "left").withColumn("new_secrets", F.coalesce("new_secrets", F.lit(0)))
    if advisories is None:
        return out.select("repo_id", "new_secrets", F.lit(0).cast("long").alias("new_vulnerable"), F.lit(False).alias("vuln_checked"), (F.col("new_secrets") == 0).alias("passed"))
    bad = Workspace(added.sparkSession, "security").write(vulnerable(base.unionByName(candidate).select("name", "version"), advisories).select("name", "version", "advisory"), "found")
    ids = lambda x: x.join(bad, ["name", "version"]).select("repo_id", "name", "advisory").distinct()
    new = ids(candidate).join(ids(base), ["repo_id", "name", "advisory"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("new_vulnerable"))
    out = out.join(new, "repo_id", "left").withColumn("new_vulnerable", F.coalesce("new_vulnerable", F.lit(0)))
    return out.select("repo_id", "new_secrets", "new_vulnerable", F.lit(True).alias("vuln_checked"), ((F.col("new_secrets") == 0) & (F.col("new_vulnerable") == 0)).alias("passed"))


_LATEST = "QUALIFY row_number() OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at DESC NULLS LAST, content_hash ASC NULLS FIRST) = 1"
_LIVE = "NOT EXISTS (SELECT 1 FROM deleted_files x WHERE x.repo_id = n.repo_id AND x.branch = n.branch AND x.file_path = n.file_path AND x.deleted_at >= n.last_promoted_at{0})"
_STATES = f"""b0 AS (SELECT * FROM nodes WHERE last_promoted_at <= TIMESTAMP '{BASE_TIME}' {_LATEST}), a0 AS (SELECT * FROM nodes {_LATEST}),
base AS (SELECT * FROM b0 n WHERE {_LIVE.format(f" AND x.deleted_at <= TIMESTAMP '{BASE_TIME}'")}), aft AS (SELECT * FROM a0 n WHERE {_LIVE.format('')})"""
_API = "kind IN (" + ", ".join(f"'{x}'" for x in P.EXPORTED_KINDS) + ") AND coalesce(exported, false) AND symbol_path IS NOT NULL"
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '' END AS dir"
_CHANGED = """ch AS (SELECT coalesce(a.node_id, b.node_id) AS node_id, coalesce(a.branch, b.branch) AS branch, CASE WHEN b.node_id IS NULL THEN 'added' WHEN a.node_id IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM aft a FULL JOIN base b ON a.node_id = b.node_id AND a.branch = b.branch WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash)"""
_REMOVED = f"rm AS (SELECT DISTINCT repo_id, branch, {_DIR}, symbol_path FROM base WHERE {_API} EXCEPT SELECT repo_id, branch, {_DIR}, symbol_path FROM aft WHERE {_API})"
_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
QUERIES = {f.__name__: f for f in (changed_symbols, api_removed, api_gate, clone_gate, coverage_gate, cycles_new, guard_report, new_findings)}
ORACLE = {
    "changed_symbols": f"WITH {_STATES}, {_CHANGED} SELECT * FROM ch",
    "api_removed": f"WITH {_STATES}, {_REMOVED} SELECT * FROM rm",
    "api_gate": f"""WITH {_STATES}, {_REMOVED}, r AS (SELECT repo_id, count(*) AS removed FROM rm GROUP BY 1), g AS (SELECT repo_id, count(*) AS drifted FROM aft WHERE signature <> prev_signature AND kind IN ('function', 'method', 'interface') AND exported GROUP BY 1)
SELECT coalesce(r.repo_id, g.repo_id) AS repo_id, coalesce(removed, 0) AS removed, coalesce(drifted, 0) AS drifted FROM r FULL JOIN g ON r.repo_id = g.repo_id""",
    "clone_gate": f"""WITH {_STATES}, a AS (SELECT branch, structural_hash, count(*) AS now FROM aft WHERE structural_hash <> '' GROUP BY 1, 2), b AS (SELECT branch, structural_hash, count(*) AS before FROM base WHERE structural_hash <> '' GROUP BY 1, 2)
SELECT a.branch, a.structural_hash, coalesce(before, 0) AS before, now FROM a LEFT JOIN b ON a.branch = b.branch AND a.structural_hash = b.structural_hash WHERE now >= 2 AND coalesce(before, 0) < 2""",
    "new_findings": f"WITH {_CF} SELECT DISTINCT finding_id FROM cf WHERE created_at > TIMESTAMP '{BASE_TIME}' AND finding_id NOT IN (SELECT finding_id FROM cf WHERE created_at <= TIMESTAMP '{BASE_TIME}')",
}
ORACLE["coverage_gate"] = f"""WITH {SQL}, {_STATES}, {_CHANGED}, im AS (SELECT DISTINCT m.branch, split_part(m.symbol_path, '.', -1) AS name FROM aft m JOIN aft i ON i.kind = 'interface' AND m.kind = 'method' AND i.branch = m.branch AND i.repo_id = m.repo_id AND i.symbol_path = regexp_extract(m.symbol_path, '^(.*)\\.[^.]+$', 1)),
t AS (SELECT DISTINCT e.dst_node_id AS node_id, e.branch FROM ce e JOIN aft x ON x.node_id = e.src_node_id AND x.branch = e.branch WHERE e.kind = 'calls' AND {_T.format('x.')})
SELECT a.node_id, a.branch, ch.change FROM aft a JOIN ch ON ch.node_id = a.node_id AND ch.branch = a.branch AND ch.change <> 'removed' WHERE a.kind IN ('function', 'method', 'class') AND NOT {_T.format('a.')} AND NOT {_V}
AND a.repo_id NOT IN (SELECT repo_id FROM repos WHERE kind = 'ephemeral') AND NOT EXISTS (SELECT 1 FROM im WHERE im.branch = a.branch AND im.name = split_part(a.symbol_path, '.', -1))
AND NOT coalesce(a.symbol_path IN ('main', 'init'), false) AND NOT EXISTS (SELECT 1 FROM t WHERE t.node_id = a.node_id AND t.branch = a.branch)"""
ORACLE["cycles_new"] = f"""WITH RECURSIVE {SQL}, {_STATES}, {_CHANGED}, e AS (SELECT src_node_id AS s, dst_node_id AS t, last_promoted_at AS at_ FROM ce WHERE branch = 'main' AND kind = 'calls' AND src_node_id <> dst_node_id),
eb AS (SELECT DISTINCT s, t FROM e WHERE at_ <= TIMESTAMP '{BASE_TIME}' AND s IN (SELECT node_id FROM base WHERE branch = 'main') AND t IN (SELECT node_id FROM base WHERE branch = 'main')),
ea AS (SELECT DISTINCT s, t FROM e WHERE s IN (SELECT node_id FROM aft WHERE branch = 'main') AND t IN (SELECT node_id FROM aft WHERE branch = 'main')),
rb(a, b) AS (SELECT s, t FROM eb UNION SELECT rb.a, eb.t FROM rb JOIN eb ON eb.s = rb.b), ra(a, b) AS (SELECT s, t FROM ea UNION SELECT ra.a, ea.t FROM ra JOIN ea ON ea.s = ra.b),
ob AS (SELECT x.a AS node, least(x.a, min(x.b)) AS c FROM rb x JOIN rb y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1), na AS (SELECT x.a AS node, least(x.a, min(x.b)) AS c FROM ra x JOIN ra y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1),
g AS (SELECT na.c FROM na LEFT JOIN ob ON ob.node = na.node GROUP BY 1 HAVING count(DISTINCT ob.c) <> 1 OR count(*) > count(ob.c))
SELECT node, c AS component FROM na WHERE c IN (SELECT c FROM g) AND c IN (SELECT n2.c FROM na n2 JOIN ch ON ch.node_id = n2.node AND ch.branch = 'main')"""
ORACLE["guard_report"] = f"""WITH RECURSIVE {SQL}, {_CF}, {_STATES}, {_CHANGED}, c AS (SELECT node_id AS node, change FROM ch WHERE branch = 'main' AND change <> 'removed'),
e AS (SELECT src_node_id AS a, dst_node_id AS b FROM ce WHERE branch = 'main'), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, k) AS (SELECT DISTINCT node_id, 0 FROM cf WHERE state = 'open' AND severity IN ('high', 'critical') AND branch = 'main' AND node_id IS NOT NULL UNION SELECT e.a, r.k + 1 FROM r JOIN e ON e.b = r.node WHERE r.k < 3),
w(node) AS (SELECT node FROM r UNION SELECT s.b FROM w JOIN s ON s.a = w.node JOIN c ON c.node = s.b AND c.change = 'added') SELECT DISTINCT node FROM c WHERE node NOT IN (SELECT node FROM w)"""
