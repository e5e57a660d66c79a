"""Reports: dependencies, owners, usage windows, retrieval quality, state counts, as-of and range statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelattice.functions.text import canonical_url
from codelattice.operators import predicates as P
from codelattice.operators.current import SQL, current_edges, current_nodes, latest, whole_numbers
from codelattice.operators.vectors import _KNN, exact_search
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

#: States an embedding can be in.
STATES = ("pending", "ready", "failed")


def dependency_usage(imports: DataFrame, top: int = 5) -> DataFrame:
    """For each (repo, dependency): import edges, distinct importers and the first distinct ones in order.

    The first ones are cut by rank before the shuffle; a hot dependency is never collected.
    """
    per = imports.groupBy("repo_id", "dependency", "importer").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("repo_id", "dependency").orderBy("importer")
    first = per.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top).groupBy("repo_id", "dependency").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "importer"))), lambda x: F.substring(x["importer"], 1, 8)), ",").alias("first_importers"))
    return per.groupBy("repo_id", "dependency").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("importers")).join(first, ["repo_id", "dependency"])


def glob_regex(pattern: Column) -> Column:
    """Owner pattern -> regular expression: a leading / anchors, a trailing / takes all below, * stays within a segment, ** does not."""
    p = F.regexp_replace(pattern, r"([.+^$(){}\[\]|\\])", r"\\$1")
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    anchored = p.startswith("/")
    p = F.regexp_replace(p, "^/", "")
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("(^|.*/)")), F.when(p.endswith("/"), F.concat(p, F.lit(".*"))).otherwise(F.concat(p, F.lit("(/.*)?"))), F.lit("$"))


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Owner of each path by the longest matching pattern; ties by pattern.

    ``rules`` (pattern, owner) is one CODEOWNERS file: its size is checked before it is sent to every task.
    """
    n = rules.count()
    if n > 5_000:
        raise ValueError(f"{n} owner patterns are more than a CODEOWNERS file has")
    r = F.broadcast(rules.withColumn("re_", glob_regex(F.col("pattern"))))
    hit = paths.select("path").distinct().join(r, F.expr("path RLIKE re_"))
    return hit.groupBy("path").agg(F.max_by("owner", F.struct(F.length("pattern"), F.col("pattern"))).alias("owner"))


def nearest_rank(values: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Nearest-rank quantile of each key: the ceil(q n)-th smallest, exact, from counts of distinct values."""
    c = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    total = c.groupBy(key).agg(F.sum("c").alias("n"))
    w = Window.partitionBy(key).orderBy(value)
    j = c.withColumn("upto", F.sum("c").over(w)).join(total, key).where(F.col("upto") >= F.ceil(F.lit(q) * F.col("n")))
    return j.groupBy(key).agg(F.min(value).alias("quantile"))


def retrieval_quality(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: recall at k (of min(k, true ones)) and reciprocal rank of the first true hit.

    ``hits`` (query_id, doc_id, rank), ``truth`` (query_id, doc_id).  Queries without true ones are left out.
    """
    t = truth.select("query_id", "doc_id").distinct()
    n = t.groupBy("query_id").agg(F.count(F.lit(1)).alias("true"))
    good = hits.where(F.col("rank") <= k).join(t, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_distinct("doc_id").alias("found"), F.min("rank").alias("first"))
    j = n.join(good, "query_id", "left")
    return j.select("query_id", (F.coalesce("found", F.lit(0)) / F.least(F.lit(k), F.col("true"))).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    e = current_edges(table(spark, d, "edges")).where("kind IN ('imports', 'dependson')")
    return dependency_usage(e.select("repo_id", F.col("dst_node_id").alias("dependency"), F.col("src_node_id").alias("importer")))


_RULES = [("*", "team-all"), ("*.ts", "team-web"), ("*.tsx", "team-ui"), ("vendor/", "team-deps"), ("auth/", "team-auth"), ("/auth/**/core*/", "team-core"), ("/billing/", "team-billing")]


def owner_of_path(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "nodes").where("kind NOT IN ('package', 'module') AND file_path IS NOT NULL").select(F.col("file_path").alias("path"))
    return owners(paths, spark.createDataFrame(_RULES, "pattern string, owner string"))


def usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events and values of each type on the day, in the last seven days and over all time."""
    e = table(spark, d, "events")
    day, week = F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"), F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(day).alias("today"), F.count_if(week).alias("week"), F.round(F.sum(F.when(week, F.col("value"))), 4).alias("week_value"), F.round(1 - F.sum(F.when(day, F.col("value"))) / F.sum("value"), 6).alias("saved"))


def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """Value used each day and what is left of a quota."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 4).alias("used"))
    return e.withColumn("left", F.round(F.greatest(F.lit(0.0), 20_000.0 - F.col("used")), 4))


def embedding_states(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in each state and model, zero where there are none."""
    v = latest(table(spark, d, "node_vectors"), ["vec_id"], [F.col("embedded_at").desc_nulls_last(), F.col("state").asc_nulls_first()])
    n = v.groupBy("model", "state").agg(F.count(F.lit(1)).alias("n"))
    every = v.select("model").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES))))
    return every.join(n, ["model", "state"], "left").select("model", "state", F.coalesce("n", F.lit(0)).alias("n"))


def _label_hits(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits (query_id, rank, good), how many others share each query's label): labels are counted, never paired."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0")
    label = v.select("vec_id", "label")
    of = Workspace(spark, "recall").write(exact_search(v, q, k).select("query_id", "vec_id", "rank"), "hits")
    hits = of.join(label.toDF("query_id", "own"), "query_id").join(label, "vec_id").select("query_id", "rank", (F.col("own") == F.col("label")).alias("good"))
    n = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others"))
    return hits, q.select(F.col("vec_id").alias("query_id"), "label").join(n, "label").where("others > 0").select("query_id", "others")


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits, n = _label_hits(spark, d, 10)
    g = hits.where("good").groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"))
    j = n.join(g, "query_id", "left")
    return j.select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.least(F.lit(10), F.col("others")), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def recall_levels(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 1, 5 and 10 and mean reciprocal rank over all queries, raw and of what k results can hold at most."""
    hits, n = _label_hits(spark, d, 10)
    g = hits.where("good").groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in (1, 5, 10)], F.min("rank").alias("first"))
    j = n.join(g, "query_id", "left")
    raw = lambda k: F.round(F.avg(F.coalesce(f"f{k}", F.lit(0)) / F.col("others")), 6).alias(f"raw_{k}")
    fair = lambda k: F.round(F.avg(F.coalesce(f"f{k}", F.lit(0)) / F.least(F.lit(k), F.col("others"))), 6).alias(f"fair_{k}")
    return j.agg(*map(raw, (1, 5, 10)), *map(fair, (1, 5, 10)), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def alias_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Names for each repo: the last part of its URL, else of its folder; where that is taken, with the owner before it."""
    url = canonical_url(F.col("canonical_url"))
    parts = F.split(url, "/")
    name, owner = F.get(parts, F.size(parts) - 1), F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 2)).otherwise("")
    r = table(spark, d, "repos").groupBy("repo_id").agg(F.max("canonical_url").alias("canonical_url"), F.max("root_path").alias("root_path"))
    some = F.coalesce(url, F.lit("")) != ""
    r = r.select("repo_id", F.when(some, name).otherwise(F.substring_index(F.regexp_replace(F.coalesce("root_path", F.lit("")), "/+$", ""), "/", -1)).alias("primary"), F.when(some & (owner != ""), F.concat_ws("-", owner, name)).otherwise("").alias("fallback"))
    return r.withColumn("taken", F.row_number().over(Window.partitionBy("primary").orderBy("repo_id")) > 1)


def hydrated_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of open findings with what is known of them; those that the graph lacks are pending, not dropped."""
    f = latest(table(spark, d, "findings"), ["finding_id", "branch"], [F.col("created_at").desc_nulls_last(), F.col("state").asc_nulls_first(), F.col("severity").asc_nulls_first()])
    a = f.where("state = 'open' AND node_id IS NOT NULL").select("node_id", "branch").distinct()
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "branch", "symbol_path", "kind", F.lit(True).alias("there"))
    return a.join(n, ["node_id", "branch"], "left").select("node_id", "branch", F.coalesce("symbol_path", F.lit("")).alias("symbol_path"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("there").isNull().alias("pending"))


def findings_page(spark: SparkSession, d: str, size: int = 20, page: int = 2) -> DataFrame:
    """One page of each branch's open findings, worst and newest first, with the total and whether there is more."""
    f = latest(table(spark, d, "findings"), ["finding_id", "branch"], [F.col("created_at").desc_nulls_last(), F.col("state").asc_nulls_first(), F.col("severity").asc_nulls_first()]).where("state = 'open'")
    w = Window.partitionBy("branch")
    rank = F.coalesce(P.rank_of(F.col("severity"), P.SEVERITIES), F.lit(-1))
    total = f.groupBy("branch").agg(F.count(F.lit(1)).alias("total"))
    r = f.withColumn("place", F.row_number().over(w.orderBy(rank.desc(), F.col("created_at").desc_nulls_last(), "finding_id"))).where((F.col("place") > size * (page - 1)) & (F.col("place") <= size * page))
    return r.join(total, "branch").select("branch", "finding_id", "place", "total", (F.col("total") > size * page).alias("more"))


def scoped_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols within a scope: some repos, one branch and a path prefix (here: repos of tracked kind, main, folders that begin with a or s)."""
    n = in_scope(current_nodes(table(spark, d, "nodes")), table(spark, d, "repos").where("kind = 'tracked'").select("repo_id"), "main", ["a", "s"])
    return n.where(~F.col("kind").isin(*P.CONTAINER_KINDS)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols"))


def in_scope(nodes: DataFrame, repos: DataFrame | None = None, branch: str | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Rows of the repos, of the branch, and of paths below one of the prefixes; what is not given does not restrict.  Null paths are below none."""
    if repos is not None:
        nodes = nodes.join(repos.select("repo_id").distinct(), "repo_id", "left_semi")
    if branch is not None:
        nodes = nodes.where(F.col("branch") == branch)
    if prefixes is not None:
        below = F.lit(False)
        for x in prefixes:
            below = below | F.coalesce(F.startswith("file_path", F.lit(x)), F.lit(False))
        nodes = nodes.where(below)
    return nodes


def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95).withColumnRenamed("quantile", "p95")


def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Spread of similarity scores by confidence."""
    e = current_edges(table(spark, d, "edges")).where("kind = 'similarto' AND score IS NOT NULL")
    p = lambda x: F.round(F.percentile(F.col("score").cast("double"), x), 5)
    return e.groupBy("confidence").agg(F.count(F.lit(1)).alias("edges"), F.round(F.min("score").cast("double"), 5).alias("least"), p(0.1).alias("p10"), p(0.5).alias("median"), p(0.9).alias("p90"), F.round(F.max("score").cast("double"), 5).alias("most"))


def link_false_positives(spark: SparkSession, d: str) -> DataFrame:
    """Share of judged links that were turned down, by month."""
    f = latest(table(spark, d, "findings"), ["finding_id", "branch"], [F.col("created_at").desc_nulls_last(), F.col("state").asc_nulls_first(), F.col("severity").asc_nulls_first()])
    f = f.where("state = 'closed' AND closed_reason IS NOT NULL")
    return f.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("judged"), F.round(F.avg((F.col("closed_reason") != "accept").cast("double")), 6).alias("turned_down"))


def repo_status(spark: SparkSession, d: str) -> DataFrame:
    """Each repo's live numbers, zero where it has no rows."""
    r = table(spark, d, "repos").select("repo_id", "kind").distinct()
    n = current_nodes(table(spark, d, "nodes")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"), F.count_distinct("branch").alias("branches"))
    e = current_edges(table(spark, d, "edges")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    z = F.lit(0)
    return r.join(n, "repo_id", "left").join(e, "repo_id", "left").select("repo_id", "kind", *[F.coalesce(c, z).alias(c) for c in ("nodes", "files", "branches", "edges")])


_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
QUERIES = {f.__name__: f for f in (dependencies, owner_of_path, usage_windows, daily_quota, embedding_states, recall_at_k, p95_nearest_rank, score_quantiles, link_false_positives, repo_status, recall_levels, alias_suggestions, hydrated_anchors, findings_page, scoped_symbols)}
ORACLE = {
    "dependencies": f"""WITH {SQL}, p AS (SELECT repo_id, dst_node_id AS dependency, src_node_id AS importer, count(*) AS n FROM ce WHERE kind IN ('imports', 'dependson') GROUP BY 1, 2, 3)
SELECT repo_id, dependency, sum(n)::BIGINT AS edges, count(*) AS importers, array_to_string(list_transform(list(importer ORDER BY importer)[1:5], lambda x: substr(x, 1, 8)), ',') AS first_importers FROM p GROUP BY 1, 2""",
    "owner_of_path": """WITH r(pattern, owner, re) AS (VALUES ('*', 'team-all', '^.*$'), ('*.ts', 'team-web', '(^|/)[^/]*\\.ts(/.*)?$'), ('*.tsx', 'team-ui', '(^|/)[^/]*\\.tsx(/.*)?$'), ('vendor/', 'team-deps', '(^|/)vendor/'),
('auth/', 'team-auth', '(^|/)auth/'), ('/auth/**/core*/', 'team-core', '^auth/.*/core[^/]*/'), ('/billing/', 'team-billing', '^billing/')),
p AS (SELECT DISTINCT file_path AS path FROM nodes WHERE kind NOT IN ('package', 'module') AND file_path IS NOT NULL)
SELECT path, arg_max(owner, (length(pattern), pattern)) AS owner FROM p JOIN r ON regexp_matches(path, re) GROUP BY 1""",
    "usage_windows": """SELECT event_type, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS week,
round(sum(value) FILTER (ts >= TIMESTAMP '2024-01-24'), 4) AS week_value, round(1 - sum(value) FILTER (ts >= TIMESTAMP '2024-01-30') / sum(value), 6) AS saved FROM events GROUP BY 1""",
    "daily_quota": "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 4) AS used, round(greatest(0.0, 20000.0 - round(sum(value), 4)), 4) AS left FROM events GROUP BY 1",
    "embedding_states": """WITH v AS (SELECT * FROM node_vectors QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC NULLS LAST, state ASC NULLS FIRST) = 1), s(state) AS (VALUES ('pending'), ('ready'), ('failed'))
SELECT m.model, s.state, count(v.vec_id) AS n FROM (SELECT DISTINCT model FROM v) m CROSS JOIN s LEFT JOIN v ON v.model = m.model AND v.state = s.state GROUP BY 1, 2""",
    "recall_levels": f"""WITH h AS ({_KNN} QUALIFY rank <= 10), q AS (SELECT e.vec_id AS query_id, e.label, (SELECT count(*) FROM embeddings x WHERE x.label = e.label) - 1 AS t FROM embeddings e WHERE e.vec_id % 20 = 0),
g AS (SELECT q.query_id, q.t, count(*) FILTER (e.label = q.label AND h.rank <= 1) AS f1, count(*) FILTER (e.label = q.label AND h.rank <= 5) AS f5, count(*) FILTER (e.label = q.label) AS f10, min(h.rank) FILTER (e.label = q.label) AS r FROM q JOIN h ON h.query_id = q.query_id JOIN embeddings e ON e.vec_id = h.vec_id WHERE q.t > 0 GROUP BY 1, 2)
SELECT round(avg(f1 / t), 6) AS raw_1, round(avg(f5 / t), 6) AS raw_5, round(avg(f10 / t), 6) AS raw_10, round(avg(f1 / least(1, t)), 6) AS fair_1, round(avg(f5 / least(5, t)), 6) AS fair_5, round(avg(f10 / least(10, t)), 6) AS fair_10, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM g""",
    "alias_suggestions": r"""WITH u AS (SELECT repo_id, max(root_path) AS root_path, max(canonical_url) AS c FROM repos GROUP BY 1), w AS (SELECT *, string_split(lower(regexp_replace(regexp_replace(regexp_replace(trim(c), '^(?:[a-z+]+://)?(?:[^@/]+@)?', ''), '^([^/:]+):(?:\d+/)?', '\1/'), '(?:\.git)?/*$', '')), '/') AS p FROM u),
a AS (SELECT repo_id, CASE WHEN coalesce(c, '') <> '' THEN p[-1] ELSE split_part(rtrim(coalesce(root_path, ''), '/'), '/', -1) END AS "primary", CASE WHEN coalesce(c, '') <> '' AND len(p) >= 3 THEN p[-2] || '-' || p[-1] ELSE '' END AS fallback FROM w)
SELECT *, row_number() OVER (PARTITION BY "primary" ORDER BY repo_id) > 1 AS taken FROM a""",
    "hydrated_anchors": f"""WITH {SQL}, {_CF}, a AS (SELECT DISTINCT node_id, branch FROM cf WHERE state = 'open' AND node_id IS NOT NULL) SELECT a.node_id, a.branch, coalesce(n.symbol_path, '') AS symbol_path, coalesce(n.kind, '') AS kind, n.node_id IS NULL AS pending FROM a LEFT JOIN cn n ON n.node_id = a.node_id AND n.branch = a.branch""",
    "findings_page": whole_numbers(f"""WITH {_CF} SELECT branch, finding_id, row_number() OVER (PARTITION BY branch ORDER BY coalesce(list_position(['info', 'low', 'medium', 'high', 'critical'], severity), 0) DESC, created_at DESC NULLS LAST, finding_id) AS place, count(*) OVER (PARTITION BY branch) AS total,
 count(*) OVER (PARTITION BY branch) > 40 AS more FROM cf WHERE state = 'open' QUALIFY place BETWEEN 21 AND 40""", "place"),
    "scoped_symbols": f"WITH {SQL} SELECT repo_id, count(*) AS symbols FROM cn WHERE branch = 'main' AND repo_id IN (SELECT repo_id FROM repos WHERE kind = 'tracked') AND (starts_with(file_path, 'a') OR starts_with(file_path, 's')) AND kind NOT IN ('package', 'file', 'module', 'chunk') GROUP BY 1",
    "recall_at_k": """WITH h AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS good, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 / (1 + pow(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2)), 9) DESC, v.vec_id) AS rank
 FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0), t AS (SELECT query_id, count(*) FILTER (good) AS true FROM h GROUP BY 1)
SELECT query_id, round(count(*) FILTER (good AND rank <= 10) / least(10, any_value(t.true)), 6) AS recall, round(coalesce(1 / min(rank) FILTER (good AND rank <= 10), 0), 6) AS rr FROM h JOIN t USING (query_id) WHERE t.true > 0 GROUP BY 1""",
    "p95_nearest_rank": "SELECT event_type, list_sort(list(value))[ceil(0.95 * count(value))::BIGINT] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "score_quantiles": f"""WITH {SQL} SELECT confidence, count(*) AS edges, round(min(score)::DOUBLE, 5) AS least, round(quantile_cont(score::DOUBLE, 0.1), 5) AS p10, round(quantile_cont(score::DOUBLE, 0.5), 5) AS median,
round(quantile_cont(score::DOUBLE, 0.9), 5) AS p90, round(max(score)::DOUBLE, 5) AS most FROM ce WHERE kind = 'similarto' AND score IS NOT NULL GROUP BY 1""",
    "link_false_positives": f"WITH {_CF} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS judged, round(avg(CASE WHEN closed_reason <> 'accept' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS turned_down FROM cf WHERE state = 'closed' AND closed_reason IS NOT NULL GROUP BY 1",
    "repo_status": f"""WITH {SQL} SELECT r.repo_id, r.kind, coalesce(n.nodes, 0) AS nodes, coalesce(n.files, 0) AS files, coalesce(n.branches, 0) AS branches, coalesce(e.edges, 0) AS edges FROM (SELECT DISTINCT repo_id, kind FROM repos) r
LEFT JOIN (SELECT repo_id, count(*) AS nodes, count(DISTINCT file_path) AS files, count(DISTINCT branch) AS branches FROM cn GROUP BY 1) n ON n.repo_id = r.repo_id LEFT JOIN (SELECT repo_id, count(*) AS edges FROM ce GROUP BY 1) e ON e.repo_id = r.repo_id""",
}
