"""Advisory checks: finding producers, revalidation, keep-lists, secrets, vulnerable dependencies."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelattice.functions.text import HIDDEN, SECRET_PREFIXES, redact, stable_id
from codelattice.operators import predicates as P
from codelattice.operators.clones import propagate_labels
from codelattice.operators.current import SQL, current_edges, current_nodes, latest, whole_numbers
from codelattice.operators.lookup import _open
from codelattice.operators.text import _FILES, _LINES, _files, source_lines
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table


def interface_methods(nodes: DataFrame) -> DataFrame:
    """(branch, name): last segments of methods that belong to an interface, by the symbol's prefix: an equi-join."""
    i = nodes.where("kind = 'interface'").select("branch", "repo_id", F.col("symbol_path").alias("owner"))
    m = nodes.where("kind = 'method'").select("branch", "repo_id", F.regexp_extract("symbol_path", r"^(.*)\.[^.]+$", 1).alias("owner"), P.last_segment(F.col("symbol_path")).alias("name"))
    return m.join(i, ["branch", "repo_id", "owner"], "left_semi").select("branch", "name").distinct()


def _candidates(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    path = F.col("file_path")
    n = nodes.where(F.col("kind").isin(*P.CODE_KINDS)).where(~P.is_test_file(path) & ~P.is_vendored(path))
    n = n.join(repos.where("kind = 'ephemeral'").select("repo_id").distinct(), "repo_id", "left_anti")
    names = interface_methods(nodes).withColumnRenamed("name", "last_")
    return n.withColumn("last_", P.last_segment(F.col("symbol_path"))).join(names, ["branch", "last_"], "left_anti").drop("last_")


def dead_code(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Functions, methods and classes that nothing calls on their branch and that nothing outside can reach."""
    called = edges.where("kind = 'calls' AND src_node_id <> dst_node_id").select(F.col("dst_node_id").alias("node_id"), "branch").distinct()
    return _candidates(nodes, repos).where(~P.is_external_entry(F.col("symbol_path"))).join(called, ["node_id", "branch"], "left_anti")


def untested(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """The same kinds without a caller in a test file; only main and init are let off."""
    tests = nodes.where(P.is_test_file(F.col("file_path"))).select(F.col("node_id").alias("src_node_id"), "branch")
    tested = edges.where("kind = 'calls'").join(tests, ["src_node_id", "branch"], "left_semi").select(F.col("dst_node_id").alias("node_id"), "branch").distinct()
    return _candidates(nodes, repos).where(~F.coalesce(F.col("symbol_path").isin("main", "init"), F.lit(False))).join(tested, ["node_id", "branch"], "left_anti")


def contract_drift(nodes: DataFrame) -> DataFrame:
    return nodes.where("signature <> prev_signature AND kind IN ('function', 'method', 'interface')")


def signature_history(nodes: DataFrame) -> DataFrame:
    """Each promotion that changed a key's signature: the one before and after."""
    w = Window.partitionBy("node_id", "branch").orderBy("last_promoted_at", "content_hash")
    rows = nodes.where("last_promoted_at IS NOT NULL").select("node_id", "branch", "last_promoted_at", "content_hash", "signature").distinct()
    rows = rows.withColumn("before", F.lag("signature").over(w))
    return rows.where("signature <> before").select("node_id", "branch", F.date_format("last_promoted_at", "yyyy-MM-dd").alias("day"), "before", "signature")


def anchored_as_of(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with the content hash their anchor had when they were made: an as-of join in one window over both tables."""
    a = nodes.select("node_id", "branch", F.col("last_promoted_at").alias("at"), F.lit(0).alias("side"), F.col("content_hash").alias("h"), F.lit(None).cast("string").alias("finding_id"), F.lit(None).cast("string").alias("rule"))
    b = findings.where("node_id IS NOT NULL").select("node_id", "branch", F.col("created_at").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("h"), "finding_id", "rule")
    w = Window.partitionBy("node_id", "branch").orderBy("at", "side", "h").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("anchor_hash", F.last("h", ignorenulls=True).over(w)).where("side = 1").select("finding_id", "branch", "node_id", "rule", "anchor_hash")


def _now(spark: SparkSession, d: str):
    n, e = current_nodes(table(spark, d, "nodes")), current_edges(table(spark, d, "edges"))
    return n, e, table(spark, d, "repos")


def check_dead_code(spark: SparkSession, d: str) -> DataFrame:
    return dead_code(*_now(spark, d)).select("node_id", "branch", stable_id(F.lit("dead-code"), F.col("node_id"), F.lit(""), length=32).alias("finding_id"))


def check_untested(spark: SparkSession, d: str) -> DataFrame:
    return untested(*_now(spark, d)).select("node_id", "branch", "symbol_path")


def check_contract_drift(spark: SparkSession, d: str) -> DataFrame:
    return contract_drift(current_nodes(table(spark, d, "nodes"))).select("node_id", "branch", "prev_signature", "signature")


def signature_drift(spark: SparkSession, d: str) -> DataFrame:
    return signature_history(table(spark, d, "nodes"))


def stale_findings(spark: SparkSession, d: str) -> DataFrame:
    """Open findings whose anchor has another content now than when they were made."""
    f = _open(spark, d).where("state = 'open'")
    now = current_nodes(table(spark, d, "nodes")).select("node_id", "branch", F.col("content_hash").alias("now_hash"))
    return anchored_as_of(f, table(spark, d, "nodes")).join(now, ["node_id", "branch"]).where("anchor_hash <> now_hash").select("finding_id", "branch", "rule")


def keep_list_close(spark: SparkSession, d: str) -> DataFrame:
    """Open dead-code findings that the check no longer emits: to be closed."""
    f = _open(spark, d).where("state = 'open' AND rule = 'dead-code' AND node_id IS NOT NULL")
    return f.join(dead_code(*_now(spark, d)).select("node_id", "branch"), ["node_id", "branch"], "left_anti").select("finding_id", "branch")


def revalidation(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each stale finding: refresh, close or keep, by its rule."""
    n, e, _ = _now(spark, d)
    stale = stale_findings(spark, d).join(_open(spark, d).select("finding_id", "branch", "node_id"), ["finding_id", "branch"])
    called = e.where("kind = 'calls'").select(F.col("dst_node_id").alias("node_id"), "branch").distinct().withColumn("called", F.lit(True))
    tests = n.where(P.is_test_file(F.col("file_path"))).select(F.col("node_id").alias("src_node_id"), "branch")
    tested = e.where("kind = 'calls'").join(tests, ["src_node_id", "branch"], "left_semi").select(F.col("dst_node_id").alias("node_id"), "branch").distinct().withColumn("tested", F.lit(True))
    drift = contract_drift(n).select("node_id", "branch").withColumn("drifted", F.lit(True))
    j = stale.join(called, ["node_id", "branch"], "left").join(tested, ["node_id", "branch"], "left").join(drift, ["node_id", "branch"], "left")
    keep = F.when(F.col("rule") == "dead-code", F.col("called").isNull()).when(F.col("rule") == "untested-symbol", F.col("tested").isNull()).when(F.col("rule") == "contract-drift", F.col("drifted").isNotNull()).otherwise(False)
    return j.select("finding_id", "branch", F.when(keep, "refresh").otherwise("close").alias("decision"))


def suppressed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Open findings under a live suppression of any scope; each with the least suppression id."""
    f = _open(spark, d).where("state = 'open'")
    as_of = F.lit("2026-07-01").cast("timestamp_ntz")
    s = table(spark, d, "suppressions").where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    scope = F.lower(F.trim("scope"))
    t = F.regexp_replace("target", r"^\s+|\s+$", "")
    s = s.select("suppression_id", "branch", "rule", scope.alias("scope"), F.when(scope == "file", F.regexp_replace(t, r"^(\./)+", "")).otherwise(F.lower(t)).alias("target"))
    keys = F.array(*[F.struct(F.lit(k).alias("scope"), F.col(c).alias("target")) for k, c in (("finding", "finding_id"), ("symbol", "node_id"), ("file", "file_path"), ("repo", "repo_id"))])
    anchors = f.select("finding_id", F.col("branch").alias("f_branch"), F.col("rule").alias("f_rule"), F.explode(keys).alias("a")).select("finding_id", "f_branch", "f_rule", "a.scope", "a.target")
    hit = anchors.join(s, ["scope", "target"]).where("(branch IS NULL OR branch = f_branch) AND (rule IS NULL OR rule = f_rule)")
    return hit.groupBy("finding_id", F.col("f_branch").alias("branch")).agg(F.min("suppression_id").alias("suppression_id"), F.count_distinct("suppression_id").alias("suppressions"))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


_ASSIGNED = re.compile(r"""(?i)(?:secret|token|passw(?:or)?d|api_?key|credential)\w*["']?\s*[:=]\s*["']([A-Za-z0-9+/_=-]{16,})["']""")


def secrets(lines: DataFrame, least_entropy: float = 3.5) -> DataFrame:
    """Lines with a known key prefix, or a quoted value of high entropy assigned to a secret's name; text redacted.

    Lines are filtered JVM-side first; entropy is worked out in batches on what is left.
    Dotted or dashed words at the end of a sentence don't fire: a value must be quoted.
    """
    maybe = lines.where(F.col("text").rlike(SECRET_PREFIXES) | F.col("text").rlike(r"(?i)(secret|token|passw|api_?key|credential)\w*[\"']?\s*[:=]\s*[\"'][A-Za-z0-9+/_=-]{16,}"))

    @F.pandas_udf("boolean")
    def fires(text: pd.Series) -> pd.Series:
        return text.map(lambda t: bool(re.search(SECRET_PREFIXES, t)) or any(entropy(v) >= least_entropy for v in _ASSIGNED.findall(t)))

    known = F.regexp_replace("text", SECRET_PREFIXES, HIDDEN)
    assigned = F.regexp_replace(known, r"""(?i)((?:secret|token|passw(?:or)?d|api_?key|credential)\w*["']?\s*[:=]\s*["'])[A-Za-z0-9+/_=-]{16,}""", "$1" + HIDDEN)
    rule = F.when(F.col("text").rlike(SECRET_PREFIXES), "known-prefix").otherwise("high-entropy")
    return maybe.where(fires("text")).withColumn("rule", rule).withColumn("text", redact(assigned))


def secret_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sources with a known key prefix."""
    return source_lines(_files(spark, d)).where(F.col("text").rlike(SECRET_PREFIXES)).select("repo_id", "branch", "file_path", "line")


def semver_key(version: Column) -> Column:
    """Sortable array of a version: numbers, then 1 for a release and 0 for a pre-release, then its parts.

    Build metadata and a leading v don't count; a null or malformed version gives null.
    """
    v = F.regexp_replace(F.trim(version), r"^v|\+.*$", "")
    ok = v.rlike(r"^\d+(\.\d+){0,2}(-[0-9A-Za-z.-]+)?$")
    core, pre = F.regexp_extract(v, r"^([\d.]+)", 1), F.regexp_extract(v, r"^[\d.]+-(.*)$", 1)
    nums = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.lpad(F.coalesce(F.get(F.split(core, r"\."), i), F.lit("0")), 12, "0"))
    parts = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 18, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.when(ok, F.concat(nums, F.when(pre == "", F.array(F.lit("1"))).otherwise(F.concat(F.array(F.lit("0")), parts))))


def affected(version: Column, events: Column) -> Column:
    """Ordered fold of range events (introduced, fixed, last_affected): is the version inside?"""
    key = semver_key(version)

    def step(state: Column, e: Column) -> Column:
        into = e["introduced"].isNotNull() & ((e["introduced"] == "0") | (key >= semver_key(e["introduced"])))
        out = (e["fixed"].isNotNull() & (key >= semver_key(e["fixed"]))) | (e["last_affected"].isNotNull() & (key > semver_key(e["last_affected"])))
        return F.when(F.coalesce(into, F.lit(False)), True).when(F.coalesce(out, F.lit(False)), False).otherwise(state)

    return F.coalesce(key.isNotNull() & F.aggregate(events, F.lit(False), step), F.lit(False))


def advisory_rank(i: Column) -> Column:
    """Which of several ids of one vulnerability is shown: GHSA, CVE, others, GO and PYSEC."""
    return F.when(i.startswith("GHSA-"), 0).when(i.startswith("CVE-"), 1).when(i.startswith("GO-") | i.startswith("PYSEC-"), 3).otherwise(2)


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """``(name, version, advisory, aliases, severity, fixed_in)``: dependencies inside an advisory's ranges, one row for each vulnerability.

    ``deps`` (name, version); ``advisories`` (id, aliases, severity, affected: array of
    (package, ranges: array of (type, events))).  Advisories found for one package and
    version of which one names another as an alias, directly or over others, are one
    vulnerability: shown is the one of the best rank, ties by id; an id that is no advisory
    of its own is never shown.  ``aliases`` are its own and the ids of those that name it;
    ``fixed_in`` is its least fixed version above.  A null severity is medium; a repeated
    advisory counts once; null versions and ids match nothing.
    """
    rows = advisories.where("id IS NOT NULL").select("id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.lower(F.coalesce("severity", F.lit("medium"))).alias("severity"), F.explode("affected").alias("a"))
    rows = rows.select("id", "aliases", "severity", F.col("a.package").alias("name"), F.explode("a.ranges").alias("r")).where("r.type IS NULL OR r.type = '' OR r.type = 'SEMVER'")
    hit = deps.select("name", "version").distinct().join(rows, "name").where(affected(F.col("version"), F.col("r.events")))
    fixes = F.filter(F.transform("r.events", lambda e: e["fixed"]), lambda f: f.isNotNull() & (semver_key(f) > semver_key(F.col("version"))))
    hit = hit.withColumn("fix", F.array_min(F.transform(fixes, lambda f: F.struct(semver_key(f).alias("k"), f.alias("v")))))
    keys = ["name", "version"]
    each = hit.groupBy(*keys, "id").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"), F.array_max(F.collect_set(F.struct(P.rank_of(F.col("severity"), P.SEVERITIES).alias("r"), "severity")))["severity"].alias("severity"), F.min("fix")["v"].alias("fixed_in"))
    each = Workspace(deps.sparkSession, "vulnerable").write(each, "found")
    named = each.select(*keys, F.col("id").alias("by"), F.explode("aliases").alias("id")).join(each.select(*keys, "id"), [*keys, "id"]).where("by <> id")
    at = lambda c: F.concat_ws("\0", "name", "version", c)
    groups = propagate_labels(named.select(at("by").alias("a"), at("id").alias("b")))
    grouped = each.join(groups.withColumnRenamed("node", "at_"), at("id") == F.col("at_"), "left").withColumn("group_", F.coalesce("component", at("id"))).drop("at_", "component")
    best = latest(grouped, ["group_"], [advisory_rank(F.col("id")), F.col("id")])
    by = named.groupBy(*keys, "id").agg(F.collect_set("by").alias("by"))
    also = F.array_sort(F.filter(F.array_distinct(F.concat("aliases", F.coalesce("by", F.array().cast("array<string>")))), lambda x: (x != "") & (x != F.col("id"))))
    return best.join(by, [*keys, "id"], "left").select(*keys, F.col("id").alias("advisory"), also.alias("aliases"), "severity", "fixed_in")


_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
_T = r"coalesce(regexp_matches(parse_filename({0}file_path), '_test\.go$|^test_.*\.py$|_test\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$'), false)"
_V = "coalesce(len(list_intersect(string_split(file_path, '/'), [" + ", ".join(f"'{x}'" for x in P.VENDORED_SEGMENTS) + "])) > 0, false)"
_CAND = f"""im AS (SELECT DISTINCT m.branch, split_part(m.symbol_path, '.', -1) AS name FROM cn m JOIN cn i ON i.kind = 'interface' AND m.kind = 'method' AND i.branch = m.branch AND i.repo_id = m.repo_id AND i.symbol_path = regexp_extract(m.symbol_path, '^(.*)\\.[^.]+$', 1)),
cand AS (SELECT * FROM cn WHERE kind IN ('function', 'method', 'class') AND NOT {_T.format('')} AND NOT {_V} AND repo_id NOT IN (SELECT repo_id FROM repos WHERE kind = 'ephemeral')
 AND NOT EXISTS (SELECT 1 FROM im WHERE im.branch = cn.branch AND im.name = split_part(cn.symbol_path, '.', -1))),
dead AS (SELECT * FROM cand n WHERE NOT (coalesce(symbol_path, '') = '' OR regexp_matches(symbol_path, '^(main|init)$|^(Test|Example|Benchmark)|^\\p{{Lu}}'))
 AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.kind = 'calls' AND ce.src_node_id <> ce.dst_node_id AND ce.dst_node_id = n.node_id AND ce.branch = n.branch))"""
_TESTED = f"tested AS (SELECT DISTINCT e.dst_node_id AS node_id, e.branch FROM ce e JOIN cn t ON t.node_id = e.src_node_id AND t.branch = e.branch WHERE e.kind = 'calls' AND {_T.format('t.')})"
_STALE = """as_made AS (SELECT f.finding_id, f.branch, f.rule, f.node_id, (SELECT arg_max(n.content_hash, (n.last_promoted_at, n.content_hash)) FROM nodes n WHERE n.node_id = f.node_id AND n.branch = f.branch AND n.last_promoted_at <= f.created_at) AS h FROM cf f WHERE f.state = 'open' AND f.node_id IS NOT NULL),
stale AS (SELECT a.* FROM as_made a JOIN cn n ON n.node_id = a.node_id AND n.branch = a.branch WHERE a.h <> n.content_hash)"""
QUERIES = {f.__name__: f for f in (check_dead_code, check_untested, check_contract_drift, signature_drift, stale_findings, keep_list_close, revalidation, suppressed_findings, secret_lines)}
ORACLE = {
    "check_dead_code": f"WITH {SQL}, {_CAND} SELECT node_id, branch, substr(sha256('dead-code' || chr(0) || node_id || chr(0)), 1, 32) AS finding_id FROM dead",
    "check_untested": f"WITH {SQL}, {_CAND}, {_TESTED} SELECT node_id, branch, symbol_path FROM cand c WHERE NOT coalesce(symbol_path IN ('main', 'init'), false) AND NOT EXISTS (SELECT 1 FROM tested t WHERE t.node_id = c.node_id AND t.branch = c.branch)",
    "check_contract_drift": f"WITH {SQL} SELECT node_id, branch, prev_signature, signature FROM cn WHERE signature <> prev_signature AND kind IN ('function', 'method', 'interface')",
    "signature_drift": """WITH p AS (SELECT DISTINCT node_id, branch, last_promoted_at, content_hash, signature FROM nodes WHERE last_promoted_at IS NOT NULL),
l AS (SELECT *, lag(signature) OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at, content_hash) AS before FROM p) SELECT node_id, branch, strftime(last_promoted_at, '%Y-%m-%d') AS day, before, signature FROM l WHERE signature <> before""",
    "stale_findings": f"WITH {SQL}, {_CF}, {_STALE} SELECT finding_id, branch, rule FROM stale",
    "keep_list_close": f"WITH {SQL}, {_CF}, {_CAND} SELECT finding_id, branch FROM cf f WHERE state = 'open' AND rule = 'dead-code' AND node_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dead WHERE dead.node_id = f.node_id AND dead.branch = f.branch)",
    "revalidation": f"""WITH {SQL}, {_CF}, {_STALE}, {_TESTED} SELECT finding_id, branch, CASE WHEN CASE rule WHEN 'dead-code' THEN NOT EXISTS (SELECT 1 FROM ce WHERE ce.kind = 'calls' AND ce.dst_node_id = s.node_id AND ce.branch = s.branch)
 WHEN 'untested-symbol' THEN NOT EXISTS (SELECT 1 FROM tested t WHERE t.node_id = s.node_id AND t.branch = s.branch)
 WHEN 'contract-drift' THEN EXISTS (SELECT 1 FROM cn n WHERE n.node_id = s.node_id AND n.branch = s.branch AND n.signature <> n.prev_signature AND n.kind IN ('function', 'method', 'interface')) ELSE false END THEN 'refresh' ELSE 'close' END AS decision FROM stale s""",
    "suppressed_findings": f"""WITH {_CF}, s AS (SELECT suppression_id, branch, rule, lower(trim(scope)) AS scope, CASE WHEN lower(trim(scope)) = 'file' THEN regexp_replace(regexp_replace(target, '^\\s+|\\s+$', '', 'g'), '^(\\./)+', '') ELSE lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')) END AS target
 FROM suppressions WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2026-07-01')
SELECT f.finding_id, f.branch, min(s.suppression_id) AS suppression_id, count(DISTINCT s.suppression_id) AS suppressions FROM cf f JOIN s ON
 ((s.scope = 'finding' AND s.target = f.finding_id) OR (s.scope = 'symbol' AND s.target = f.node_id) OR (s.scope = 'file' AND s.target = f.file_path) OR (s.scope = 'repo' AND s.target = f.repo_id))
 AND (s.branch IS NULL OR s.branch = f.branch) AND (s.rule IS NULL OR s.rule = f.rule) WHERE f.state = 'open' GROUP BY 1, 2""",
    "secret_lines": f"WITH {_FILES}, {_LINES} SELECT repo_id, branch, file_path, line FROM l WHERE regexp_matches(raw, '{SECRET_PREFIXES}')",
}
ORACLE["secret_lines"] = whole_numbers(ORACLE["secret_lines"], "line")
