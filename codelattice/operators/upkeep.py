"""Keeping the graph up: promotion of nodes and edges, check runs, deletions, readiness, resync, reconciled branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.functions.text import directory, stable_id
from codelattice.operators import predicates as P
from codelattice.operators.checks import _CAND, _TESTED, contract_drift, dead_code, untested
from codelattice.operators.current import SQL, SQL_KIND, current_edges, current_nodes, latest
from codelattice.operators.gates import BASE_TIME, _CF, _CHANGED, _STATES, _states, changed_nodes
from codelattice.operators.graph import _BASE, _main_edges, _seeds, blast_radius
from codelattice.operators.lookup import _open
from codelattice.operators.resolve import _STUBS, cross_repo_stubs
from codelattice.operators.text import SQL_TOKENS
from codelattice.plans.materialize import Workspace
from codelattice.sources.sinks import delete_files, postings, upsert_findings
from codelattice.sources.tables import table
from codelattice.streaming.flow import overlay, resync, same_generation

FILE = ["repo_id", "branch", "file_path"]
#: Reasons that are shown for an incomplete answer.
EMBED_BATCH = 32


def promote_files(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after whole files were promoted.

    A promoted file's nodes replace those it had; each carries the signature of the row it
    replaces as ``prev_signature``.  Edges that start in a replaced file go, new ones come in
    (of repeated keys the least kind, then confidence); an edge without both ends goes.
    """
    touched = new_nodes.select(*FILE).distinct()
    before = nodes.select("node_id", "branch", F.col("signature").alias("sig_"))
    fresh = latest(new_nodes, ["node_id", "branch"], [F.col("last_promoted_at").desc_nulls_last(), F.col("content_hash").asc_nulls_first()])
    fresh = fresh.join(before, ["node_id", "branch"], "left").withColumn("prev_signature", F.col("sig_")).select(*nodes.columns)
    kept = nodes.join(touched, FILE, "left_anti").join(fresh.select("node_id", "branch"), ["node_id", "branch"], "left_anti")
    work = Workspace(nodes.sparkSession, "promotion")
    after = work.write(kept.unionByName(fresh), "nodes")
    starts = nodes.join(touched, FILE, "left_semi").select(F.col("node_id").alias("src_node_id"), "branch").distinct()
    came = latest(new_edges, ["edge_id", "branch"], [F.col("kind").asc(), F.col("confidence").asc_nulls_first()])
    rest = edges.join(starts, ["src_node_id", "branch"], "left_anti").join(came.select("edge_id", "branch"), ["edge_id", "branch"], "left_anti")
    all_edges = work.write(rest.unionByName(came.select(*edges.columns)), "edges")
    for end in ("src_node_id", "dst_node_id"):
        all_edges = all_edges.join(after.select(F.col("node_id").alias(end), "branch"), [end, "branch"], "left_semi")
    return after, all_edges.select(*edges.columns)


def _promoted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the base time after the last promotion of each file since."""
    n, e = table(spark, d, "nodes").where("file_path IS NOT NULL"), table(spark, d, "edges").withColumn("kind", F.regexp_replace(F.lower("kind"), "[^a-z0-9]", ""))
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    old = current_nodes(n.where(F.col("last_promoted_at") <= t))
    late = n.where(F.col("last_promoted_at") > t)
    newest = F.max("last_promoted_at").over(Window.partitionBy(*FILE))
    late = late.withColumn("n_", newest).where("last_promoted_at = n_").drop("n_")
    order = [F.col("last_promoted_at").desc_nulls_last(), F.col("kind").asc(), F.col("confidence").asc_nulls_first(), F.col("resolved").asc_nulls_first(), F.col("score").asc_nulls_first()]
    pick = lambda x: latest(x, ["edge_id", "branch"], order)
    starts = late.select(F.col("node_id").alias("src_node_id"), "branch").distinct()
    return promote_files(old, pick(e.where(F.col("last_promoted_at") <= t)), late, pick(e.where(F.col("last_promoted_at") > t)).join(starts, ["src_node_id", "branch"], "left_semi"))


def promoted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d)[0].select("node_id", "branch", "file_path", "signature", "prev_signature")


def promoted_edges(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d)[1].select("edge_id", "branch", "src_node_id", "dst_node_id", "kind")


def deleted_graph(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the current graph that are left when all files that were ever deleted are gone."""
    kept, edges = delete_files(current_nodes(table(spark, d, "nodes")), current_edges(table(spark, d, "edges")), table(spark, d, "deleted_files"))
    return kept.groupBy("branch").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("nodes").alias("what"), "branch", "rows").unionByName(edges.groupBy("branch").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("edges").alias("what"), "branch", "rows"))


def findings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the base time under those written since: the first time of creation stays."""
    f = table(spark, d, "findings").where("finding_id IS NOT NULL AND branch IS NOT NULL AND created_at IS NOT NULL").select("finding_id", "branch", "rule", "state", "created_at").distinct()
    f = f.withColumn("state", F.min("state").over(Window.partitionBy("finding_id", "branch", "created_at"))).distinct()
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    return upsert_findings(f.where(F.col("created_at") <= t), f.where(F.col("created_at") > t)).select("finding_id", "branch", "state", "created_at")


def postings_touched(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the main branch's files that were promoted since the base time, counted by word."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    p = postings(n, n.where((F.col("last_promoted_at") > t) & F.col("file_path").isNotNull()))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("nodes"), F.sum("tf").alias("tf"))


def run_checks(checks: dict[str, DataFrame], findings: DataFrame, authoritative: tuple[str, ...]) -> DataFrame:
    """``(rule, finding_id, node_id, branch, action)``: what a run of checks does to the findings: open, keep or close.

    ``checks`` name the rule of each frame (finding_id, node_id, branch); ``findings`` has the open
    ones.  An authoritative rule closes its open findings that it no longer emits; others
    leave theirs as they are.  A finding emitted twice counts once; null ids are left out.
    """
    out = None
    for rule, emitted in checks.items():
        now = emitted.where("finding_id IS NOT NULL").select("finding_id", "branch", "node_id").groupBy("finding_id", "branch").agg(F.min("node_id").alias("node_id"))
        had = findings.where(F.col("rule") == rule).select("finding_id", "branch", F.col("node_id").alias("had_node")).distinct()
        j = now.withColumn("now_", F.lit(True)).join(had.withColumn("had_", F.lit(True)), ["finding_id", "branch"], "full")
        action = F.when(F.col("had_").isNull(), "open").when(F.col("now_").isNotNull(), "keep").when(F.lit(rule in authoritative), "close").otherwise("keep")
        one = j.select(F.lit(rule).alias("rule"), "finding_id", F.coalesce("node_id", "had_node").alias("node_id"), "branch", action.alias("action"))
        out = one if out is None else out.unionByName(one)
    return out


def check_run(spark: SparkSession, d: str) -> DataFrame:
    """All structural checks over the graph as it stands, against the open findings: how many each opens, keeps and closes."""
    n, e, repos = current_nodes(table(spark, d, "nodes")), current_edges(table(spark, d, "edges")), table(spark, d, "repos")
    ids = lambda rule, df: df.select(stable_id(F.lit(rule), F.col("node_id"), F.lit(""), length=32).alias("finding_id"), "node_id", "branch")
    checks = {"dead-code": ids("dead-code", dead_code(n, e, repos)), "untested-symbol": ids("untested-symbol", untested(n, e, repos)), "contract-drift": ids("contract-drift", contract_drift(n))}
    had = _open(spark, d).where("state = 'open' AND node_id IS NOT NULL").select("rule", stable_id(F.col("rule"), F.col("node_id"), F.lit(""), length=32).alias("finding_id"), "branch", "node_id")
    return run_checks(checks, had, ("dead-code", "contract-drift")).groupBy("rule", "action").agg(F.count(F.lit(1)).alias("findings"))


def files_resync(spark: SparkSession, d: str) -> DataFrame:
    """Files to look at again: the sources as they are against those known at the base time, by time and size; unknown ones too."""
    s = table(spark, d, "source_files").where("repo_id IS NOT NULL AND branch IS NOT NULL AND file_path IS NOT NULL AND last_promoted_at IS NOT NULL")
    path = F.concat_ws(":", *FILE).alias("path")
    last = lambda df: df.groupBy(path).agg(F.max(F.struct(F.col("last_promoted_at").alias("mtime"), F.col("n_bytes").alias("size"))).alias("m")).select("path", "m.mtime", "m.size")
    gone = table(spark, d, "deleted_files").groupBy(path).agg(F.max("deleted_at").alias("gone_at"))
    now = last(s).join(gone, "path", "left").where("gone_at IS NULL OR mtime > gone_at").drop("gone_at")
    return resync(now, last(s.where(F.col("last_promoted_at") <= F.lit(BASE_TIME).cast("timestamp_ntz"))), True)


def late_writes(spark: SparkSession, d: str) -> DataFrame:
    """Promotions by generation: a repo's generation is the month it was last promoted in; older writes are dropped."""
    w = table(spark, d, "nodes").where("last_promoted_at IS NOT NULL").select("repo_id", "node_id", "branch", F.date_format("last_promoted_at", "yyyy-MM").alias("generation"))
    return same_generation(w, w.groupBy("repo_id").agg(F.max("generation").alias("generation"))).groupBy("repo_id", "generation").agg(F.count(F.lit(1)).alias("writes"))


def _vector_state(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "node_vectors").where("node_id IS NOT NULL")
    return latest(v, ["node_id"], [F.col("embedded_at").desc_nulls_last(), F.col("vec_id").asc()]).select("node_id", "state", "vec_id", "embedded_at")


def linkable_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of which some symbol is to be embedded: auto-links wait until all those are ready."""
    n = current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*P.CONTAINER_KINDS)).select("node_id", *FILE)
    g = n.join(_vector_state(spark, d), "node_id").groupBy(*FILE).agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("state") == "ready").alias("ready"))
    return g.select(*FILE, "symbols", "ready", (F.col("symbols") == F.col("ready")).alias("linkable"))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pending vectors in the order and batches in which they are drained, oldest first."""
    v = _vector_state(spark, d).where("state = 'pending'")
    hour = F.date_trunc("MONTH", F.coalesce("embedded_at", F.lit("1970-01-01").cast("timestamp_ntz")))
    w = Window.partitionBy(hour).orderBy("vec_id")  # a month is drained by itself: no order over everything
    return v.select("vec_id", F.date_format(hour, "yyyy-MM").alias("month"), F.floor((F.row_number().over(w) - 1) / EMBED_BATCH).cast("int").alias("batch"))


def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each repo's scan is: its files, those with symbols in the graph, and the phase that follows from them."""
    s = table(spark, d, "source_files").select(*FILE).distinct()
    n = table(spark, d, "nodes").select(*FILE).distinct().withColumn("done", F.lit(True))
    g = s.join(n, FILE, "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count("done").alias("parsed"))
    return g.withColumn("phase", F.when(F.col("parsed") == 0, "queued").when(F.col("parsed") < F.col("files"), "parsing").otherwise("done"))


def branch_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Branches of the graph against each repo's active one: what stays active, what is kept as another branch, and repos the registry lacks."""
    n = table(spark, d, "nodes").groupBy("repo_id", "branch").agg(F.max("last_promoted_at").alias("at"))
    r = table(spark, d, "repos").groupBy("repo_id").agg(F.max("active_branch").alias("active"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "unknown repo").when(F.col("active").isNull() | (F.col("active") == F.col("branch")), "active").otherwise("other")
    return n.join(r, "repo_id", "left").select("repo_id", "branch", state.alias("state"), F.date_format("at", "yyyy-MM-dd").alias("last"))


def cross_repo_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Edges into other repos from all nodes that a call walk from the seeds meets, resolved by name, each once."""
    work = Workspace(spark, "expansion")
    seen = work.write(blast_radius(_main_edges(spark, d).select("src", "dst"), _seeds(spark, d), "both", depth=2, hub=None).select("node"), "seen")
    e = current_edges(table(spark, d, "edges")).where("branch = 'main'").select("edge_id", "src_node_id", "kind")
    s = work.write(cross_repo_stubs(spark, d).select("edge_id", F.col("node_id").alias("dst")).join(e, "edge_id").select(F.col("src_node_id").alias("src"), "dst", "kind"), "stubs")
    out = s.join(seen.select(F.col("node").alias("src")), "src", "left_semi").unionByName(s.join(seen.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "kind"))
    return out.distinct()


def fix_verify(spark: SparkSession, d: str) -> DataFrame:
    """Whether each open finding of the structural checks is resolved on the graph as it stands, and how many new ones its file has since the base time."""
    work = Workspace(spark, "verify")
    n, e, repos = current_nodes(table(spark, d, "nodes")), current_edges(table(spark, d, "edges")), table(spark, d, "repos")
    f = work.write(_open(spark, d).where("state = 'open' AND node_id IS NOT NULL AND rule IN ('dead-code', 'untested-symbol', 'contract-drift')").select("finding_id", "branch", "rule", "node_id", "created_at", "repo_id", "file_path"), "open")
    still = None
    for rule, df in (("dead-code", dead_code(n, e, repos)), ("untested-symbol", untested(n, e, repos)), ("contract-drift", contract_drift(n))):
        one = df.select("node_id", "branch", F.lit(rule).alias("rule"))
        still = one if still is None else still.unionByName(one)
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    fresh = f.where(F.col("created_at") > t).groupBy("repo_id", "branch", "file_path").agg(F.count(F.lit(1)).alias("fresh"))
    j = f.join(still.distinct().withColumn("still", F.lit(True)), ["node_id", "branch", "rule"], "left").join(fresh, ["repo_id", "branch", "file_path"], "left")
    return j.select("finding_id", "branch", "rule", F.col("still").isNull().alias("resolved"), F.coalesce("fresh", F.lit(0)).alias("fresh"))


def vendored_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules that lie in dependency directories: the folder behind the last such segment, at most two names deep, with its files and symbols."""
    n = current_nodes(table(spark, d, "nodes")).where(P.is_vendored(F.col("file_path")) & ~F.col("kind").isin("package", "module"))
    tail = F.regexp_extract("file_path", r"^.*(?:^|/)(?:" + "|".join(P.VENDORED_SEGMENTS) + r")/(.*)$", 1)
    module = F.regexp_extract(directory(tail), r"^([^/]+(?:/[^/]+)?)", 1)
    return n.groupBy("repo_id", module.alias("module")).agg(F.count_distinct("file_path").alias("files"), F.count_if(~F.col("kind").isin(*P.CONTAINER_KINDS)).alias("symbols")).where("module <> ''")


def external_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes after the vendored ones were upserted as external: a flag once set stays, whatever is promoted later."""
    n = table(spark, d, "nodes")
    flag = n.groupBy("node_id", "branch").agg(F.max(F.coalesce("external", F.lit(False)) | P.is_vendored(F.col("file_path"))).alias("is_external"))
    return current_nodes(n).join(flag, ["node_id", "branch"]).where("is_external").select("node_id", "branch", "file_path")


def touched_scope(spark: SparkSession, d: str) -> DataFrame:
    """Changed nodes within a scope: the main branch of tracked repos, below the first folder of the repo that holds most of them."""
    base, after = _states(spark, d)
    repos = table(spark, d, "repos").where("kind = 'tracked'").select("repo_id").distinct()
    c = changed_nodes(base, after).where("branch = 'main' AND change <> 'removed'").join(after.select("node_id", "branch", "repo_id", "file_path"), ["node_id", "branch"]).join(repos, "repo_id", "left_semi")
    folder = F.substring_index("file_path", "/", 1)
    g = c.where("file_path IS NOT NULL").groupBy("repo_id", folder.alias("folder")).agg(F.count(F.lit(1)).alias("changed"))
    return latest(g, ["repo_id"], [F.col("changed").desc(), F.col("folder").asc()])


_LATEST_E = "QUALIFY row_number() OVER (PARTITION BY edge_id, branch ORDER BY last_promoted_at DESC NULLS LAST, kind, confidence NULLS FIRST, resolved NULLS FIRST, score NULLS FIRST) = 1"
_PROMOTED = f"""ke AS (SELECT * REPLACE ({SQL_KIND} AS kind) FROM edges),
old AS (SELECT * FROM nodes WHERE file_path IS NOT NULL AND last_promoted_at <= TIMESTAMP '2026-03-01' QUALIFY row_number() OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at DESC, content_hash NULLS FIRST) = 1),
lt AS (SELECT * FROM nodes WHERE file_path IS NOT NULL AND last_promoted_at > TIMESTAMP '2026-03-01' QUALIFY last_promoted_at = max(last_promoted_at) OVER (PARTITION BY repo_id, branch, file_path)),
fr AS (SELECT * FROM lt QUALIFY row_number() OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at DESC, content_hash NULLS FIRST) = 1),
pn AS (SELECT node_id, branch, file_path, signature, prev_signature FROM old WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.repo_id = old.repo_id AND lt.branch = old.branch AND lt.file_path = old.file_path) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.node_id = old.node_id AND fr.branch = old.branch)
 UNION ALL SELECT fr.node_id, fr.branch, fr.file_path, fr.signature, old.signature FROM fr LEFT JOIN old ON old.node_id = fr.node_id AND old.branch = fr.branch),
oe AS (SELECT * FROM ke WHERE last_promoted_at <= TIMESTAMP '2026-03-01' {_LATEST_E}), ne AS (SELECT * FROM (SELECT * FROM ke WHERE last_promoted_at > TIMESTAMP '2026-03-01' {_LATEST_E}) k WHERE EXISTS (SELECT 1 FROM lt WHERE lt.node_id = k.src_node_id AND lt.branch = k.branch)),
re AS (SELECT edge_id, branch, src_node_id, dst_node_id, kind FROM oe WHERE NOT EXISTS (SELECT 1 FROM old o JOIN lt ON lt.repo_id = o.repo_id AND lt.branch = o.branch AND lt.file_path = o.file_path WHERE o.node_id = oe.src_node_id AND o.branch = oe.branch)
 AND NOT EXISTS (SELECT 1 FROM ne WHERE ne.edge_id = oe.edge_id AND ne.branch = oe.branch) UNION ALL SELECT edge_id, branch, src_node_id, dst_node_id, kind FROM ne),
pe AS (SELECT * FROM re WHERE EXISTS (SELECT 1 FROM pn WHERE pn.node_id = re.src_node_id AND pn.branch = re.branch) AND EXISTS (SELECT 1 FROM pn WHERE pn.node_id = re.dst_node_id AND pn.branch = re.branch))"""
_VS = "vs AS (SELECT node_id, state, vec_id, embedded_at FROM node_vectors WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY embedded_at DESC NULLS LAST, vec_id) = 1)"
_CONT = "('package', 'file', 'module', 'chunk')"
_ID = "substr(sha256('{0}' || chr(0) || node_id || chr(0)), 1, 32)"
_UNT = "unt AS (SELECT node_id, branch FROM cand c WHERE NOT coalesce(symbol_path IN ('main', 'init'), false) AND NOT EXISTS (SELECT 1 FROM tested t WHERE t.node_id = c.node_id AND t.branch = c.branch))"
_DRIFT = "dr AS (SELECT node_id, branch FROM cn WHERE signature <> prev_signature AND kind IN ('function', 'method', 'interface'))"
_VEND = "len(list_intersect(string_split(file_path, '/'), ['vendor', 'node_modules', 'third_party', 'thirdparty', 'bower_components'])) > 0"
QUERIES = {
    f.__name__: f
    for f in (
        promoted_nodes, promoted_edges, deleted_graph, findings_upsert, postings_touched, check_run, files_resync, late_writes, linkable_files, embed_batches, scan_progress, branch_reconcile, cross_repo_expansion, fix_verify,
        vendored_modules, external_nodes, touched_scope,
    )
}
ORACLE = {
    "promoted_nodes": f"WITH {_PROMOTED} SELECT * FROM pn",
    "promoted_edges": f"WITH {_PROMOTED} SELECT * FROM pe",
    "deleted_graph": f"""WITH {SQL}, g AS (SELECT * FROM cn WHERE EXISTS (SELECT 1 FROM deleted_files x WHERE x.repo_id = cn.repo_id AND x.branch = cn.branch AND x.file_path = cn.file_path))
SELECT 'nodes' AS what, branch, count(*) AS rows FROM cn WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.node_id = cn.node_id AND g.branch = cn.branch) GROUP BY 2
UNION ALL SELECT 'edges', branch, count(*) FROM ce WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.branch = ce.branch AND g.node_id IN (ce.src_node_id, ce.dst_node_id)) GROUP BY 2""",
    "findings_upsert": """WITH f AS (SELECT finding_id, branch, rule, created_at, min(state) AS state FROM findings WHERE finding_id IS NOT NULL AND branch IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT finding_id, branch, arg_max(state, created_at) AS state, min(created_at) AS created_at FROM f GROUP BY 1, 2""",
    "postings_touched": f"""WITH {SQL}, t AS (SELECT DISTINCT repo_id, file_path FROM cn WHERE branch = 'main' AND last_promoted_at > TIMESTAMP '2026-03-01' AND file_path IS NOT NULL),
x AS (SELECT node_id, concat_ws(' ', kind, symbol_path) AS s FROM cn WHERE branch = 'main' AND EXISTS (SELECT 1 FROM t WHERE t.repo_id = cn.repo_id AND t.file_path = cn.file_path)),
k AS (SELECT s, token, count(*) AS tf FROM {SQL_TOKENS.format(src='(SELECT DISTINCT s FROM x)')} GROUP BY 1, 2) SELECT token AS term, count(*) AS nodes, sum(tf)::BIGINT AS tf FROM x JOIN k USING (s) GROUP BY 1""",
    "check_run": f"""WITH {SQL}, {_CF}, {_CAND}, {_TESTED}, {_UNT}, {_DRIFT},
em AS (SELECT 'dead-code' AS rule, node_id, branch FROM dead UNION SELECT 'untested-symbol', node_id, branch FROM unt UNION SELECT 'contract-drift', node_id, branch FROM dr),
had AS (SELECT DISTINCT rule, node_id, branch FROM cf WHERE state = 'open' AND node_id IS NOT NULL AND rule IN ('dead-code', 'untested-symbol', 'contract-drift')),
j AS (SELECT coalesce(em.rule, had.rule) AS rule, CASE WHEN had.rule IS NULL THEN 'open' WHEN em.rule IS NOT NULL THEN 'keep' WHEN had.rule <> 'untested-symbol' THEN 'close' ELSE 'keep' END AS action FROM em FULL JOIN had ON em.rule = had.rule AND em.node_id = had.node_id AND em.branch = had.branch)
SELECT rule, action, count(*) AS findings FROM j GROUP BY 1, 2""",
    "files_resync": """WITH s AS (SELECT repo_id || ':' || branch || ':' || file_path AS path, last_promoted_at AS m, n_bytes AS z FROM source_files WHERE last_promoted_at IS NOT NULL), n AS (SELECT path, max(m) AS m, max((m, z)) AS b FROM s GROUP BY 1),
g AS (SELECT concat_ws(':', repo_id, branch, file_path) AS path, max(deleted_at) AS ga FROM deleted_files GROUP BY 1), w AS (SELECT n.* FROM n LEFT JOIN g USING (path) WHERE ga IS NULL OR m > ga), k AS (SELECT path, max((m, z)) AS b FROM s WHERE m <= TIMESTAMP '2026-03-01' GROUP BY 1)
SELECT * FROM (SELECT coalesce(k.path, w.path) AS path, CASE WHEN w.path IS NULL THEN 'remove' WHEN k.path IS NULL THEN 'write' WHEN k.b IS DISTINCT FROM w.b THEN 'write' END AS op FROM k FULL JOIN w USING (path)) WHERE op IS NOT NULL""",
    "late_writes": "WITH w AS (SELECT repo_id, strftime(last_promoted_at, '%Y-%m') AS generation FROM nodes WHERE last_promoted_at IS NOT NULL) SELECT repo_id, generation, count(*) AS writes FROM w GROUP BY 1, 2 QUALIFY generation = max(generation) OVER (PARTITION BY repo_id)",
    "linkable_files": f"WITH {SQL}, {_VS} SELECT n.repo_id, n.branch, n.file_path, count(*) AS symbols, count(*) FILTER (state = 'ready') AS ready, count(*) = count(*) FILTER (state = 'ready') AS linkable FROM cn n JOIN vs USING (node_id) WHERE n.kind NOT IN {_CONT} GROUP BY 1, 2, 3",
    "embed_batches": f"WITH {_VS}, p AS (SELECT vec_id, strftime(coalesce(embedded_at, TIMESTAMP '1970-01-01'), '%Y-%m') AS month FROM vs WHERE state = 'pending') SELECT vec_id, month, ((row_number() OVER (PARTITION BY month ORDER BY vec_id) - 1) // 32)::INTEGER AS batch FROM p",
    "scan_progress": """WITH s AS (SELECT DISTINCT repo_id, branch, file_path FROM source_files), g AS (SELECT s.repo_id, count(*) AS files, count(*) FILTER (EXISTS (SELECT 1 FROM nodes n WHERE n.repo_id = s.repo_id AND n.branch = s.branch AND n.file_path = s.file_path)) AS parsed FROM s GROUP BY 1)
SELECT *, CASE WHEN parsed = 0 THEN 'queued' WHEN parsed < files THEN 'parsing' ELSE 'done' END AS phase FROM g""",
    "branch_reconcile": """WITH r AS (SELECT repo_id, max(active_branch) AS active FROM repos GROUP BY 1) SELECT n.repo_id, n.branch, CASE WHEN r.repo_id IS NULL THEN 'unknown repo' WHEN active IS NULL OR active = n.branch THEN 'active' ELSE 'other' END AS state, strftime(max(last_promoted_at), '%Y-%m-%d') AS last
FROM nodes n LEFT JOIN r ON r.repo_id = n.repo_id GROUP BY 1, 2, 3""",
    "cross_repo_expansion": _STUBS.replace("WITH", "WITH RECURSIVE", 1) + f""", {_BASE.replace(SQL + ', ', '')}, mv AS (SELECT dst AS at_, src AS to_ FROM me UNION ALL SELECT src, dst FROM me),
wk(node, k) AS (SELECT node, 0 FROM seed UNION SELECT mv.to_, k + 1 FROM wk JOIN mv ON mv.at_ = wk.node WHERE k < 2), sn AS (SELECT DISTINCT node FROM wk)
SELECT DISTINCT e.src_node_id AS src, o.node_id AS dst, e.kind FROM out o JOIN ce e ON e.edge_id = o.edge_id AND e.branch = 'main' WHERE e.src_node_id IN (SELECT node FROM sn) OR o.node_id IN (SELECT node FROM sn)""",
    "fix_verify": f"""WITH {SQL}, {_CF}, {_CAND}, {_TESTED}, {_UNT}, {_DRIFT}, em AS (SELECT 'dead-code' AS rule, node_id, branch FROM dead UNION SELECT 'untested-symbol', node_id, branch FROM unt UNION SELECT 'contract-drift', node_id, branch FROM dr),
o AS (SELECT * FROM cf WHERE state = 'open' AND node_id IS NOT NULL AND rule IN ('dead-code', 'untested-symbol', 'contract-drift'))
SELECT finding_id, branch, rule, NOT EXISTS (SELECT 1 FROM em WHERE em.rule = o.rule AND em.node_id = o.node_id AND em.branch = o.branch) AS resolved, (SELECT count(*) FROM o x WHERE x.created_at > TIMESTAMP '2026-03-01' AND x.repo_id = o.repo_id AND x.branch = o.branch AND x.file_path = o.file_path) AS fresh FROM o""",
    "vendored_modules": f"""WITH {SQL}, v AS (SELECT *, regexp_extract(file_path, '^.*(?:^|/)(?:vendor|node_modules|third_party|thirdparty|bower_components)/(.*)$', 1) AS tail FROM cn WHERE coalesce({_VEND}, false) AND kind NOT IN ('package', 'module'))
SELECT repo_id, regexp_extract(CASE WHEN contains(tail, '/') THEN regexp_replace(tail, '/[^/]*$', '') ELSE '' END, '^([^/]+(?:/[^/]+)?)', 1) AS module, count(DISTINCT file_path) AS files, count(*) FILTER (kind NOT IN {_CONT}) AS symbols FROM v GROUP BY 1, 2 HAVING module <> ''""",
    "external_nodes": f"WITH {SQL}, x AS (SELECT node_id, branch FROM nodes GROUP BY 1, 2 HAVING bool_or(coalesce(external, false) OR coalesce({_VEND}, false))) SELECT node_id, branch, file_path FROM cn WHERE EXISTS (SELECT 1 FROM x WHERE x.node_id = cn.node_id AND x.branch = cn.branch)",
    "touched_scope": f"""WITH {_STATES}, {_CHANGED}, g AS (SELECT a.repo_id, split_part(a.file_path, '/', 1) AS folder, count(*) AS changed FROM aft a JOIN ch ON ch.node_id = a.node_id AND ch.branch = a.branch WHERE a.branch = 'main' AND ch.change <> 'removed' AND a.file_path IS NOT NULL
 AND a.repo_id IN (SELECT repo_id FROM repos WHERE kind = 'tracked') GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY changed DESC, folder) = 1""",
}
