"""Composed answers: context packs, change reports, test selection, candidate lists, index health, repo identity, close rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from codelattice.functions.text import canonical_url, directory, truncate_bytes
from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_nodes, latest
from codelattice.operators.gates import _CHANGED, _STATES as _SQL_STATES, _states, changed_nodes
from codelattice.operators.graph import ORACLE as _GRAPH, _BASE, _main_edges, _seeds, blast_radius, file_reach, recent_changes, tests_covering
from codelattice.operators.lookup import _open
from codelattice.operators.search import FAN, _docs, _queries, lexical, nearest, top_k
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

SNIPPET_BYTES, BUDGET_TOKENS = 1_500, 8_192


def clip_to_budget(rows: DataFrame, order: list, size: str, budget: int) -> DataFrame:
    """The first rows, in order, whose sizes together stay within the budget.

    The rows are the nodes of one walk, which its own cap bounds, so one window holds them.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("sum_", F.sum(size).over(w)).where(F.col("sum_") <= budget).drop("sum_")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhood of the open high findings: nearest first, with findings and snippets, within a token budget."""
    seen = blast_radius(_main_edges(spark, d).select("src", "dst"), _seeds(spark, d), "both", depth=1, cap=200)
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    bad = _open(spark, d).where("state = 'open' AND branch = 'main'").groupBy("node_id").agg(F.count(F.lit(1)).alias("findings"))
    r = seen.select(F.col("node").alias("node_id"), "distance").join(n, "node_id").join(bad, "node_id", "left")
    r = r.select("node_id", "distance", "symbol_path", F.coalesce("findings", F.lit(0)).alias("findings"), truncate_bytes(F.coalesce("snippet", F.lit("")), SNIPPET_BYTES).alias("snippet"))
    tokens = F.floor((F.octet_length("snippet") + F.octet_length(F.coalesce("symbol_path", F.lit(""))) + 40) / 4).cast("long")
    r = clip_to_budget(r.withColumn("tokens", tokens), [F.col("distance"), F.col("node_id")], "tokens", BUDGET_TOKENS)
    return r.select("node_id", "distance", "findings", "tokens")


#: Sections of a context pack in the order in which they are kept; what the last ones hold is dropped first.
SECTIONS = ("nodes", "commits", "findings")
HISTORY_FILES = 25


def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """The whole context pack: nodes near the open high findings, recent changes of their first 25 files, open findings on them, within one token budget."""
    work = Workspace(spark, "context")
    seen = blast_radius(_main_edges(spark, d).select("src", "dst"), _seeds(spark, d), "both", depth=1, cap=200)
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'")
    near = seen.select(F.col("node").alias("node_id"), "distance").join(n, "node_id")
    near = work.write(near.select("node_id", "distance", "repo_id", "file_path", "symbol_path", truncate_bytes(F.coalesce("snippet", F.lit("")), SNIPPET_BYTES).alias("snippet")), "near")
    size = lambda *texts: F.floor((sum((F.octet_length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(40))) / 4).cast("long").alias("tokens")
    place = lambda *by: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)).alias("place")
    nodes = near.select(F.lit(0).alias("s"), place("distance", "node_id"), F.col("node_id").alias("id"), size("snippet", "symbol_path"))
    files = near.where("file_path IS NOT NULL").groupBy("repo_id", "file_path").agg(F.min(F.struct("distance", "node_id")).alias("first"))
    files = files.orderBy("first").limit(HISTORY_FILES)
    changes = recent_changes(table(spark, d, "nodes").where("branch = 'main'"))
    commits = files.join(changes, ["repo_id", "file_path"]).select(F.lit(1).alias("s"), place("first"), F.concat_ws(":", "repo_id", "file_path").alias("id"), size("file_path"))
    bad = _open(spark, d).where("state = 'open' AND branch = 'main'").join(near.select("node_id", "distance"), "node_id")
    bad = bad.orderBy("distance", "node_id", "finding_id").limit(BUDGET_TOKENS // 10 + 1)  # a row takes ten tokens at least: no more can fit
    findings = bad.select(F.lit(2).alias("s"), place("distance", "node_id", "finding_id"), F.col("finding_id").alias("id"), size("message"))
    rows = clip_to_budget(nodes.unionByName(commits).unionByName(findings), [F.col("s"), F.col("place")], "tokens", BUDGET_TOKENS)
    return rows.select(F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("s") + 1).alias("section"), "place", "id", "tokens")


def summary_of(answer: Column) -> Column:
    """The summary in a model's answer: the text of its first object's ``summary``, at most 280 characters; null if there is none."""
    return F.nullif(F.substring(F.trim(F.get_json_object(first_json(answer), "$.summary")), 1, 280), F.lit(""))


def change_report(spark: SparkSession, d: str) -> DataFrame:
    """For each changed file: changed symbols, what else its symbols reach as callers, open findings, and a risk from them.

    As in hot zones the reach starts from all symbols of the file and goes over edges of every
    kind; packages, modules, files and chunks are walked through but not counted.
    """
    base, after = _states(spark, d)
    changed = changed_nodes(base, after).where("branch = 'main' AND change <> 'removed'")
    n = after.where("branch = 'main'").select("node_id", "kind", "repo_id", "file_path")
    origin = F.concat_ws(":", "repo_id", "file_path")
    symbol = ~F.coalesce(F.col("kind").isin(*P.CONTAINER_KINDS), F.lit(False))
    files = n.where("file_path IS NOT NULL").join(changed.select("node_id"), "node_id").groupBy(origin.alias("origin")).agg(F.count_if(symbol).alias("symbols"))
    seen = file_reach(_main_edges(spark, d), n.withColumn("origin", origin).join(files.select("origin"), "origin", "left_semi"))
    kinds = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select(F.col("node_id").alias("node"), "kind")
    callers = seen.where("distance > 0").join(kinds, "node").where(symbol).groupBy("origin").agg(F.count(F.lit(1)).alias("callers"))
    reach = files.join(callers, "origin", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    bad = _open(spark, d).where("state = 'open' AND branch = 'main'").groupBy(origin.alias("origin")).agg(F.count(F.lit(1)).alias("findings"))
    j = reach.join(bad, "origin", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return j.select(F.substring_index("origin", ":", 1).alias("repo_id"), F.expr("substring(origin, instr(origin, ':') + 1)").alias("file_path"), "symbols", "callers", "findings", (F.col("symbols") + F.col("callers") + 5 * F.col("findings")).alias("risk"))


def test_selection(spark: SparkSession, d: str) -> DataFrame:
    """Tests that reach a seed, grouped by directory."""
    n = current_nodes(table(spark, d, "nodes")).where("branch = 'main'").select(F.col("node_id").alias("node"), "repo_id", "file_path")
    t = tests_covering(spark, d).join(n, "node")
    return t.groupBy("repo_id", directory(F.col("file_path")).alias("dir")).agg(F.count(F.lit(1)).alias("tests"), F.min("distance").alias("nearest"))


def candidates(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Ranks of both lists side by side, unfused: (query_id, doc_id, vector_rank, lexical_rank, vector_score)."""
    v = vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    x = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    return v.join(x, ["query_id", "doc_id"], "full")


def cross_repo_score(c: DataFrame, base: int = 60) -> DataFrame:
    """One order over all repos: by vector score (a little more if found both ways), else by rank alone.

    Where no candidate of a query has a positive vector score, ranks are fused instead.
    """
    some = F.max(F.coalesce("vector_score", F.lit(0.0))).over(Window.partitionBy("query_id")) > 0
    by_rank = F.coalesce(F.lit(1.0) / (base + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(F.lit(1.0) / (base + F.col("lexical_rank")), F.lit(0.0))
    both = F.col("vector_score") * F.when(F.col("lexical_rank").isNotNull(), 1.05).otherwise(1.0)
    return c.withColumn("score", F.round(F.when(some, F.coalesce(both, F.lit(1.0) / (base + F.col("lexical_rank")))).otherwise(by_rank), 9))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Vector and lexical candidates of each finding's message over all nodes, one order, ten a query."""
    docs, queries = _docs(spark, d), _queries(spark, d)
    found = candidates(nearest(docs, queries, FAN), lexical(docs, queries))
    return top_k(cross_repo_score(found), 10).select("query_id", "doc_id", "score", "rank")


def index_health(spark: SparkSession, d: str) -> DataFrame:
    """Why search in a repo may be incomplete: vectors pending or failed, symbols without one."""
    n = current_nodes(table(spark, d, "nodes")).where(~F.col("kind").isin(*P.CONTAINER_KINDS)).select("node_id", "repo_id").distinct()
    v = latest(table(spark, d, "node_vectors").where("node_id IS NOT NULL"), ["node_id"], [F.col("embedded_at").desc_nulls_last(), F.col("vec_id").asc()]).select("node_id", "state")
    g = n.join(v, "node_id", "left").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state").isNull()).alias("missing"))
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(f"{c} embeddings")) for c in ("pending", "failed", "missing")]))), ", ")
    return g.withColumn("reasons", reasons)


def repo_identity(spark: SparkSession, d: str) -> DataFrame:
    """What identifies each repo: its URL, else its module path, else its folder; and how many share that."""
    url, module = canonical_url(F.col("canonical_url")), F.col("module_path")
    r = table(spark, d, "repos").select("repo_id", F.when(url.isNotNull(), "url").when(module.isNotNull(), "module").otherwise("path").alias("tier"), F.coalesce(url, module, "root_path").alias("identity")).distinct()
    return r.withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("identity")))


def close_audit(spark: SparkSession, d: str) -> DataFrame:
    """Closed findings by whether the rule for closing was kept: high and critical ones need a human."""
    f = _open(spark, d).where("state = 'closed'")
    heavy = F.coalesce(P.rank_of(F.col("severity"), P.SEVERITIES) >= 3, F.lit(False))
    human = F.coalesce(F.col("actor_kind") == "human", F.lit(False))
    return f.groupBy("severity", F.when(heavy & ~human, "needs a human").otherwise("kept").alias("verdict")).agg(F.count(F.lit(1)).alias("findings"))


def finding_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Findings after close and reopen events: the last one of a finding counts; high ones need a human to close.

    ``events`` (finding_id, branch, op, reason, at, actor_kind).
    """
    sev = findings.select("finding_id", "branch", P.rank_of(F.col("severity"), P.SEVERITIES).alias("sev_"))
    ok = events.join(sev, ["finding_id", "branch"]).where((F.col("op") != "close") | (F.coalesce("sev_", F.lit(0)) < 3) | (F.col("actor_kind") == "human"))
    last = latest(ok, ["finding_id", "branch"], [F.col("at").desc(), F.col("op").asc()]).select("finding_id", "branch", F.col("op").alias("op_"), F.col("reason").alias("reason_"), F.col("at").alias("at_"))
    j = findings.join(last, ["finding_id", "branch"], "left")
    new = {
        "state": F.when(F.col("op_") == "close", "closed").when(F.col("op_") == "reopen", "open").otherwise(F.col("state")),
        "closed_reason": F.when(F.col("op_") == "close", F.col("reason_")).when(F.col("op_") == "reopen", F.lit(None)).otherwise(F.col("closed_reason")),
        "closed_at": F.when(F.col("op_") == "close", F.col("at_")).when(F.col("op_") == "reopen", F.lit(None)).otherwise(F.col("closed_at")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in findings.columns])


def accepted_links(edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges after reviews: those whose auto-link finding was closed as accepted are definite.

    ``findings`` (edge_id, branch, rule, state, closed_reason); others change nothing.
    """
    ok = findings.where("rule = 'auto-link' AND state = 'closed' AND closed_reason = 'accept'").select("edge_id", "branch").distinct().withColumn("ok_", F.lit(True))
    j = edges.join(ok, ["edge_id", "branch"], "left")
    return j.select(*[F.when(F.col("ok_"), "definite").otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in edges.columns])


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first balanced {...} of a text, quotes and escapes minded; null if there is none."""

    def one(t: str | None) -> str | None:
        start = (t or "").find("{")
        depth, quoted, skip = 0, False, False
        for i, c in enumerate((t or "")[start:] if start >= 0 else ""):
            if skip:
                skip = False
            elif quoted:
                quoted, skip = c != '"', c == "\\"
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return t[start : start + i + 1]
        return None

    return text.map(one)


def frameworks(files: DataFrame) -> DataFrame:
    """Routes and commands that sources register: (repo_id, branch, file_path, kind, name)."""
    route = F.transform(F.regexp_extract_all("content", F.lit(r"\.(?:GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*[\"'`](/[^\"'`]*)[\"'`]"), 1), lambda x: F.struct(F.lit("route").alias("kind"), x.alias("name")))
    command = F.transform(F.regexp_extract_all("content", F.lit(r"(?s)\bCommand\{[^{}]*?\b(?:Use|Name):\s*\"([A-Za-z][\w-]*)"), 1), lambda x: F.struct(F.lit("command").alias("kind"), x.alias("name")))
    return files.where("content IS NOT NULL").select("repo_id", "branch", "file_path", F.inline(F.array_distinct(F.concat(route, command))))


_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
_CONT = ", ".join(f"'{x}'" for x in P.CONTAINER_KINDS)
QUERIES = {f.__name__: f for f in (context_pack, context_sections, change_report, test_selection, hybrid_search, index_health, repo_identity, close_audit)}
ORACLE = {
    "index_health": f"""WITH {SQL}, n AS (SELECT DISTINCT node_id, repo_id FROM cn WHERE kind NOT IN ({_CONT})), v AS (SELECT node_id, state FROM node_vectors WHERE node_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY embedded_at DESC NULLS LAST, vec_id) = 1),
g AS (SELECT n.repo_id, count(*) AS symbols, count(*) FILTER (v.state = 'pending') AS pending, count(*) FILTER (v.state = 'failed') AS failed, count(*) FILTER (v.state IS NULL) AS missing FROM n LEFT JOIN v ON v.node_id = n.node_id GROUP BY 1)
SELECT *, concat_ws(', ', CASE WHEN failed > 0 THEN 'failed embeddings' END, CASE WHEN missing > 0 THEN 'missing embeddings' END, CASE WHEN pending > 0 THEN 'pending embeddings' END) AS reasons FROM g""",
    "repo_identity": r"""WITH u AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(trim(canonical_url), '^(?:[a-z+]+://)?(?:[^@/]+@)?', ''), '^([^/:]+):(?:\d+/)?', '\1/'), '(?:\.git)?/*$', '')) AS url FROM repos),
i AS (SELECT DISTINCT repo_id, CASE WHEN url IS NOT NULL THEN 'url' WHEN module_path IS NOT NULL THEN 'module' ELSE 'path' END AS tier, coalesce(url, module_path, root_path) AS identity FROM u) SELECT *, count(*) OVER (PARTITION BY identity) AS sharing FROM i""",
    "close_audit": f"WITH {_CF} SELECT severity, CASE WHEN severity IN ('high', 'critical') AND coalesce(actor_kind, '') <> 'human' THEN 'needs a human' ELSE 'kept' END AS verdict, count(*) AS findings FROM cf WHERE state = 'closed' GROUP BY 1, 2",
    "context_pack": f"""WITH RECURSIVE {_BASE}, mv AS (SELECT dst AS at_, src AS to_ FROM me UNION ALL SELECT src, dst FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
s AS (SELECT node, 0 AS distance FROM seed UNION SELECT mv.to_, 1 FROM seed JOIN mv ON mv.at_ = seed.node WHERE seed.node NOT IN (SELECT at_ FROM hub)),
c AS (SELECT node, min(distance) AS distance FROM s GROUP BY 1 QUALIFY row_number() OVER (ORDER BY min(distance), node) <= 200),
b AS (SELECT node_id, count(*) AS findings FROM cf WHERE state = 'open' AND branch = 'main' GROUP BY 1),
r AS (SELECT n.node_id, c.distance, coalesce(b.findings, 0) AS findings, (strlen(substr(coalesce(n.snippet, ''), 1, {SNIPPET_BYTES})) + strlen(coalesce(n.symbol_path, '')) + 40) // 4 AS tokens FROM c JOIN cn n ON n.node_id = c.node AND n.branch = 'main' LEFT JOIN b ON b.node_id = n.node_id)
SELECT node_id, distance, findings, tokens FROM r QUALIFY sum(tokens) OVER (ORDER BY distance, node_id ROWS UNBOUNDED PRECEDING) <= {BUDGET_TOKENS}""",
    "context_sections": f"""WITH RECURSIVE {_BASE}, mv AS (SELECT dst AS at_, src AS to_ FROM me UNION ALL SELECT src, dst FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
s AS (SELECT node, 0 AS distance FROM seed UNION SELECT mv.to_, 1 FROM seed JOIN mv ON mv.at_ = seed.node WHERE seed.node NOT IN (SELECT at_ FROM hub)),
c AS (SELECT node, min(distance) AS distance FROM s GROUP BY 1 QUALIFY row_number() OVER (ORDER BY min(distance), node) <= 200), n AS (SELECT cn.*, c.distance FROM c JOIN cn ON cn.node_id = c.node AND cn.branch = 'main'),
f AS (SELECT repo_id, file_path, min((distance, node_id)) AS first FROM n WHERE file_path IS NOT NULL GROUP BY 1, 2 ORDER BY first LIMIT 25),
h AS (SELECT repo_id, file_path FROM nodes WHERE branch = 'main' AND last_promoted_at > TIMESTAMP '2026-06-01' AND last_promoted_at <= TIMESTAMP '2026-07-01' GROUP BY 1, 2),
r AS (SELECT 0 AS s, row_number() OVER (ORDER BY distance, node_id) AS place, node_id AS id, (strlen(substr(coalesce(snippet, ''), 1, 1500)) + strlen(coalesce(symbol_path, '')) + 40) // 4 AS tokens FROM n
 UNION ALL SELECT 1, row_number() OVER (ORDER BY first), repo_id || ':' || file_path, (strlen(file_path) + 40) // 4 FROM f JOIN h USING (repo_id, file_path)
 UNION ALL SELECT 2, row_number() OVER (ORDER BY n.distance, n.node_id, cf.finding_id), cf.finding_id, (strlen(coalesce(cf.message, '')) + 40) // 4 FROM cf JOIN n ON n.node_id = cf.node_id WHERE cf.state = 'open' AND cf.branch = 'main')
SELECT ['nodes', 'commits', 'findings'][s + 1] AS section, place::INTEGER AS place, id, tokens FROM r QUALIFY sum(tokens) OVER (ORDER BY s, place ROWS UNBOUNDED PRECEDING) <= 8192""",
    "change_report": f"""WITH RECURSIVE {_BASE}, {_SQL_STATES}, {_CHANGED}, mv AS (SELECT dst AS at_, src AS to_ FROM me), hub AS (SELECT at_ FROM mv GROUP BY 1 HAVING count(*) > 50),
n AS (SELECT node_id, kind, repo_id, file_path FROM aft WHERE branch = 'main' AND file_path IS NOT NULL),
f AS (SELECT n.repo_id, n.file_path, count(*) FILTER (n.kind NOT IN ({_CONT})) AS symbols FROM n JOIN ch ON ch.node_id = n.node_id AND ch.branch = 'main' AND ch.change <> 'removed' GROUP BY 1, 2),
r(repo_id, file_path, node, k) AS (SELECT DISTINCT n.repo_id, n.file_path, n.node_id, 0 FROM n JOIN f USING (repo_id, file_path) UNION SELECT r.repo_id, r.file_path, mv.to_, k + 1 FROM r JOIN mv ON mv.at_ = r.node WHERE k < 3 AND r.node NOT IN (SELECT at_ FROM hub)),
m AS (SELECT repo_id, file_path, node, min(k) AS k FROM r GROUP BY 1, 2, 3), g AS (SELECT m.repo_id, m.file_path, count(*) AS callers FROM m JOIN cn x ON x.node_id = m.node AND x.branch = 'main' WHERE m.k > 0 AND x.kind NOT IN ({_CONT}) GROUP BY 1, 2),
b AS (SELECT repo_id, file_path, count(*) AS findings FROM cf WHERE state = 'open' AND branch = 'main' GROUP BY 1, 2)
SELECT f.*, coalesce(g.callers, 0) AS callers, coalesce(b.findings, 0) AS findings, symbols + coalesce(g.callers, 0) + 5 * coalesce(b.findings, 0) AS risk FROM f LEFT JOIN g USING (repo_id, file_path) LEFT JOIN b USING (repo_id, file_path)""",
}
_TESTS = _GRAPH["tests_covering"].replace("\nSELECT node, distance FROM r WHERE", ", covering AS (SELECT node, distance FROM r WHERE") + ")" + """, n AS (SELECT * FROM cn WHERE branch = 'main') SELECT n.repo_id, CASE WHEN contains(n.file_path, '/') THEN regexp_replace(n.file_path, '/[^/]*$', '') ELSE '' END AS dir, count(*) AS tests, min(s.distance) AS nearest
FROM covering s JOIN n ON n.node_id = s.node GROUP BY 1, 2"""
ORACLE["test_selection"] = _TESTS
