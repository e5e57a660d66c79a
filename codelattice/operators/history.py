"""Commit history, work lanes, repo resolution and the upkeep of links and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelattice.operators.current import SQL, current_nodes, latest, whole_numbers
from codelattice.operators.lookup import _open
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table

AS_OF, BASE_TIME = "2026-07-01", "2026-03-01"
#: What is queued for each promoted file, and how often a piece of work is tried.
WORK_KINDS, ATTEMPTS = ("embed", "auto-link", "revalidate", "fts", "wiki"), 3
RECORD, FIELD = "\x1e", "\x1f"


def commit_log(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of raw logs (repo_id, log).

    A record starts with RS and has hash, parents, author, author time, commit time and
    subject parted by US; the file names follow, one a line.  Malformed records are skipped.
    """
    r = logs.select("repo_id", F.explode(F.split("log", RECORD)).alias("r")).where(F.trim("r") != "")
    head, rest = F.split(F.substring_index("r", "\n", 1), FIELD), F.split("r", "\n")
    c = r.where(F.size(head) == 6).select("repo_id", head[0].alias("hash"), F.filter(F.split(head[1], " "), lambda x: x != "").alias("parents"), head[2].alias("author"), F.try_to_timestamp(head[3]).alias("authored_at"), F.try_to_timestamp(head[4]).alias("committed_at"), head[5].alias("subject"), F.slice(rest, 2, F.size(rest)).alias("files"))
    files = c.select("repo_id", "hash", F.explode(F.filter("files", lambda x: F.trim(x) != "")).alias("file_path")).distinct()
    return c.drop("files"), files


def file_history(commits: DataFrame, files: DataFrame, paths: DataFrame, limit: int = 20) -> DataFrame:
    """The last commits of each wanted path, by author time, then hash."""
    j = files.join(paths.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi").join(commits, ["repo_id", "hash"])
    w = Window.partitionBy("repo_id", "file_path").orderBy(F.col("authored_at").desc_nulls_last(), F.col("hash"))
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def change_counts(commits: DataFrame, files: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Commits that touched each file within the window, by committer time."""
    t = F.lit(as_of).cast("timestamp")
    inside = commits.where((F.col("committed_at") > t - F.expr(f"INTERVAL {days} DAYS")) & (F.col("committed_at") <= t))
    return files.join(inside.select("repo_id", "hash"), ["repo_id", "hash"], "left_semi").groupBy("repo_id", "file_path").agg(F.count_distinct("hash").alias("changes"))


def last_authors(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Who touched each file last: the owner where no rule names one."""
    j = files.join(commits.select("repo_id", "hash", "author", "committed_at"), ["repo_id", "hash"])
    return latest(j, ["repo_id", "file_path"], [F.col("committed_at").desc_nulls_last(), F.col("hash").asc()]).select("repo_id", "file_path", "author")


def ancestors(commits: DataFrame, heads: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(repo_id, hash) of all commits that the heads descend from, themselves included.

    Along first parents the reach doubles (a commit has one such step of each length, so the
    tables stay as long as the history); a round then follows the other parents of what is
    new, so the rounds are as many as merges lie within merges.
    """
    work = Workspace(commits.sparkSession, "ancestors")
    keys = ["repo_id", "hash"]
    known = work.write(commits.select(*keys, "parents").dropDuplicates(keys), "commits")
    ids = known.select(*keys)
    up = known.select("repo_id", "hash", F.posexplode("parents").alias("nth", "up")).join(ids.withColumnRenamed("hash", "up"), ["repo_id", "up"], "left_semi")
    others = work.write(up.where("nth > 0").select("repo_id", "hash", "up"), "others")
    jumps = [work.write(up.where("nth = 0").select("repo_id", "hash", "up"), "first")]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(work.write(last.join(last.select("repo_id", F.col("hash").alias("up"), F.col("up").alias("upper")), ["repo_id", "up"]).select("repo_id", "hash", F.col("upper").alias("up")), "jump"))
    step = lambda rows, by: rows.join(by, keys).select("repo_id", F.col("up").alias("hash"))
    front = heads.select(*keys).distinct().join(ids, keys, "left_semi")
    reached = None
    for _ in range(max_rounds):
        front = work.write(front, "front")
        if front.isEmpty():
            return front if reached is None else reached
        for jump in jumps[:-1]:
            grown = work.write(front.unionByName(step(front, jump)).distinct(), "front")
            work.drop(front)
            front = grown
        new = front if reached is None else front.join(reached, keys, "left_anti")
        reached = work.write(new if reached is None else reached.unionByName(new), "reached")
        front = step(front, others).distinct().join(reached, keys, "left_anti")
    raise RuntimeError("merges are nested deeper than the rounds reach")


def replay_plan(commits: DataFrame, heads: DataFrame, promoted: DataFrame) -> DataFrame:
    """What start-up does in each repo: nothing, a full scan, or the missed commits.

    ``heads`` and ``promoted`` (repo_id, hash); a head whose history lacks the promoted
    commit, or a repo without one, is scanned in full.
    """
    seen = ancestors(commits, heads)
    p = heads.select("repo_id", F.col("hash").alias("head")).join(promoted.select("repo_id", F.col("hash").alias("base")), "repo_id", "left")
    known = seen.select("repo_id", F.col("hash").alias("base"), F.lit(True).alias("is_"))
    done = ancestors(commits, promoted).withColumn("old", F.lit(True))
    missed = seen.join(done, ["repo_id", "hash"], "left_anti").groupBy("repo_id").agg(F.count(F.lit(1)).alias("missed"))
    plan = F.when(F.col("base") == F.col("head"), "nothing").when(F.col("base").isNull() | F.col("is_").isNull(), "full scan").otherwise("replay")
    return p.join(known, ["repo_id", "base"], "left").join(missed, "repo_id", "left").select("repo_id", plan.alias("plan"), F.when(plan == "replay", F.col("missed")).otherwise(F.lit(0)).alias("missed"))


def claim(queue: DataFrame, per_lane: int, now) -> DataFrame:
    """The next rows of each lane: pending, due, tried less than three times; oldest first.

    ``queue`` (id, kind, state, attempts, available_at, created_at).
    """
    ready = queue.where((F.col("state") == "pending") & (F.col("attempts") < ATTEMPTS) & (F.col("available_at").isNull() | (F.col("available_at") <= now)))
    w = Window.partitionBy("kind").orderBy("created_at", "id")
    return ready.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_lane)


def settle(queue: DataFrame, results: DataFrame, now) -> DataFrame:
    """The queue after work: done; deferred (the try doesn't count, one second later); failed for good at the third try.

    ``results`` (id, outcome): done, defer or error.
    """
    j = queue.join(results.select("id", "outcome"), "id", "left")
    tried = F.col("attempts") + F.when(F.col("outcome") == "error", 1).otherwise(0)
    state = F.when(F.col("outcome") == "done", "done").when((F.col("outcome") == "error") & (tried >= ATTEMPTS), "failed").otherwise(F.col("state"))
    later = F.when(F.col("outcome") == "defer", now + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("available_at"))
    new = {"state": state, "attempts": tried, "available_at": later}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])


def switch_model(refs: DataFrame, model: str) -> DataFrame:
    """Embedding references after a change of model: all of another model's are pending again."""
    other = ~F.col("model").eqNullSafe(F.lit(model))
    return refs.withColumn("state", F.when(other, "pending").otherwise(F.col("state"))).withColumn("attempts", F.when(other, 0).otherwise(F.col("attempts"))).withColumn("model", F.lit(model))


def promotion_log(nodes: DataFrame) -> DataFrame:
    """Raw logs (repo_id, log), one record each: every promotion of a repo's main branch as a commit on the one before."""
    n = nodes.where("branch = 'main' AND file_path IS NOT NULL AND last_promoted_at IS NOT NULL")
    c = n.groupBy("repo_id", "last_promoted_at").agg(F.min("actor_id").alias("author"), F.array_sort(F.collect_set("file_path")).alias("files"))
    at = F.date_format("last_promoted_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    c = c.withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "repo_id", at), 256), 1, 16)).withColumn("parent", F.lag("hash").over(Window.partitionBy("repo_id").orderBy("last_promoted_at")))
    head = F.concat_ws(FIELD, "hash", F.coalesce("parent", F.lit("")), F.coalesce("author", F.lit("")), at, at, F.lit("promotion"))
    return c.select("repo_id", F.concat(F.lit(RECORD), head, F.lit("\n"), F.array_join("files", "\n"), F.lit("\n")).alias("log"))


def _commits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    work = Workspace(spark, "log")
    commits, files = commit_log(promotion_log(table(spark, d, "nodes")))
    return work.write(commits, "commits"), work.write(files, "files")


def commit_list(spark: SparkSession, d: str) -> DataFrame:
    commits, _ = _commits(spark, d)
    return commits.select("repo_id", "hash", F.coalesce(F.get("parents", F.lit(0)), F.lit("")).alias("parent"), "author", F.date_format("committed_at", "yyyy-MM-dd HH:mm").alias("committed"), "subject")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d)[1]


def file_commits(spark: SparkSession, d: str) -> DataFrame:
    """The last three commits of every file."""
    commits, files = _commits(spark, d)
    return file_history(commits, files, files, 3).select("repo_id", "file_path", "hash", "place")


def file_authors(spark: SparkSession, d: str) -> DataFrame:
    return last_authors(*_commits(spark, d))


def month_changes(spark: SparkSession, d: str) -> DataFrame:
    return change_counts(*_commits(spark, d), AS_OF)


def _head(commits: DataFrame, until: str | None = None) -> DataFrame:
    c = commits if until is None else commits.where(F.col("committed_at") <= F.lit(until).cast("timestamp"))
    return latest(c, ["repo_id"], [F.col("committed_at").desc(), F.col("hash").asc()]).select("repo_id", "hash")


def commit_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Every commit that the heads of the base time descend from."""
    commits, _ = _commits(spark, d)
    return ancestors(commits, _head(commits, BASE_TIME))


def replay_plans(spark: SparkSession, d: str) -> DataFrame:
    """What start-up does where the graph was last promoted at the base time."""
    commits, _ = _commits(spark, d)
    return replay_plan(commits, _head(commits), _head(commits, BASE_TIME))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """Work of promoted files as a queue; how often a piece was tried follows from its path's length."""
    p = table(spark, d, "nodes").where("file_path IS NOT NULL AND last_promoted_at IS NOT NULL").select("repo_id", "branch", "file_path", "last_promoted_at").distinct()
    k = p.select("*", F.explode(F.array(*map(F.lit, WORK_KINDS))).alias("kind"))
    name = F.concat_ws("|", "repo_id", "branch", "file_path", "kind", F.date_format("last_promoted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return k.select(F.sha2(name, 256).alias("id"), "kind", F.lit("pending").alias("state"), (F.length("file_path") % 4).alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("available_at"), F.col("last_promoted_at").alias("created_at"))


def work_claims(spark: SparkSession, d: str) -> DataFrame:
    """The next twenty pieces of each lane."""
    return claim(_queue(spark, d), 20, F.lit(AS_OF).cast("timestamp_ntz")).select("kind", "id", "place")


def work_settled(spark: SparkSession, d: str) -> DataFrame:
    """The queue after every piece was worked on: ids that begin with a digit under 5 fail, with 5 to 9 wait, others are done."""
    work = Workspace(spark, "queue")
    q = work.write(_queue(spark, d), "queue")
    outcome = F.when(F.col("id") < "5", "error").when(F.col("id") < "a", "defer").otherwise("done")
    return settle(q, q.select("id", outcome.alias("outcome")), F.lit(AS_OF).cast("timestamp_ntz")).groupBy("kind", "state", "attempts").agg(F.count(F.lit(1)).alias("rows"), F.count("available_at").alias("waiting"))


def model_switch(spark: SparkSession, d: str) -> DataFrame:
    """References by state after a change to the second model: those of the first are pending again."""
    refs = latest(table(spark, d, "node_vectors"), ["vec_id"], [F.col("embedded_at").desc_nulls_last(), F.col("content_hash").asc(), F.col("state").asc()]).select("vec_id", "state", F.lit(1).alias("attempts"), "model")
    return switch_model(refs, "static-hash-v2").groupBy("model", "state").agg(F.count(F.lit(1)).alias("refs"), F.sum("attempts").alias("attempts"))


def promotions_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Promotions of each file in the last 90 days: the graph's own change counts."""
    n = table(spark, d, "nodes").where(f"file_path IS NOT NULL AND last_promoted_at > TIMESTAMP_NTZ '{AS_OF}' - INTERVAL 90 DAYS AND last_promoted_at <= TIMESTAMP_NTZ '{AS_OF}'")
    return n.groupBy("repo_id", "branch", "file_path").agg(F.count_distinct("last_promoted_at").alias("changes"))


def superseded_links(spark: SparkSession, d: str) -> DataFrame:
    """Open auto-link findings whose source was promoted again since: to be closed."""
    f = _open(spark, d).where("state = 'open' AND rule = 'auto-link' AND node_id IS NOT NULL")
    n = current_nodes(table(spark, d, "nodes")).select("node_id", "branch", "last_promoted_at")
    return f.join(n, ["node_id", "branch"]).where("last_promoted_at > created_at").select("finding_id", "branch", "node_id")


def repo_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Hand-typed repo ids: found exactly, by a unique prefix of four or more characters, or not."""
    t = table(spark, d, "suppressions").where(F.lower(F.trim("scope")) == "repo").select(F.lower(F.regexp_replace("target", r"^\s+|\s+$", "")).alias("asked")).where("asked IS NOT NULL").distinct()
    r = table(spark, d, "repos").select(F.lower("repo_id").alias("repo_id")).distinct()
    j = t.join(r.select("repo_id", F.substring("repo_id", 1, 4).alias("p_")), (F.substring("asked", 1, 4) == F.col("p_")) & F.col("repo_id").startswith(F.col("asked")) & (F.length("asked") >= 4), "left")
    g = j.groupBy("asked").agg(F.count("repo_id").alias("hits"), F.max((F.col("repo_id") == F.col("asked")).cast("int")).alias("exact"))
    return g.select("asked", F.when(F.col("exact") == 1, "exact").when(F.col("hits") == 1, "prefix").when(F.col("hits") > 1, "ambiguous").otherwise("unknown").alias("how"))


def work_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Work that promotions queue: every promoted file once for each kind, counted by lane and month."""
    p = table(spark, d, "nodes").where("file_path IS NOT NULL AND last_promoted_at IS NOT NULL").select("repo_id", "branch", "file_path", "last_promoted_at").distinct()
    return p.select(F.date_format("last_promoted_at", "yyyy-MM").alias("month"), F.explode(F.array(*map(F.lit, WORK_KINDS))).alias("kind")).groupBy("month", "kind").agg(F.count(F.lit(1)).alias("rows"))


_CF = "cf AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY finding_id, branch ORDER BY created_at DESC NULLS LAST, state ASC NULLS FIRST, severity ASC NULLS FIRST) = 1)"
_LOG = """cm AS (SELECT repo_id, last_promoted_at AS ts, min(actor_id) AS author, substr(sha256(repo_id || '|' || strftime(last_promoted_at, '%Y-%m-%dT%H:%M:%S.%fZ')), 1, 16) AS hash FROM nodes WHERE branch = 'main' AND file_path IS NOT NULL AND last_promoted_at IS NOT NULL GROUP BY 1, 2),
cf AS (SELECT DISTINCT n.repo_id, c.hash, c.ts, c.author, n.file_path FROM nodes n JOIN cm c ON c.repo_id = n.repo_id AND c.ts = n.last_promoted_at WHERE n.branch = 'main' AND n.file_path IS NOT NULL)"""
_QUEUE = """p AS (SELECT DISTINCT repo_id, branch, file_path, last_promoted_at FROM nodes WHERE file_path IS NOT NULL AND last_promoted_at IS NOT NULL),
qu AS (SELECT sha256(concat_ws('|', repo_id, branch, file_path, kind, strftime(last_promoted_at, '%Y-%m-%d %H:%M:%S.%f'))) AS id, kind, length(file_path) % 4 AS attempts, last_promoted_at AS created_at FROM p, (VALUES ('embed'), ('auto-link'), ('revalidate'), ('fts'), ('wiki')) k(kind))"""
QUERIES = {f.__name__: f for f in (promotions_per_file, superseded_links, repo_resolution, work_lanes, commit_list, commit_files, file_commits, file_authors, month_changes, commit_ancestry, replay_plans, work_claims, work_settled, model_switch)}
ORACLE = {
    "commit_list": f"WITH {_LOG} SELECT repo_id, hash, coalesce(lag(hash) OVER (PARTITION BY repo_id ORDER BY ts), '') AS parent, coalesce(author, '') AS author, strftime(ts, '%Y-%m-%d %H:%M') AS committed, 'promotion' AS subject FROM cm",
    "commit_files": f"WITH {_LOG} SELECT repo_id, hash, file_path FROM cf",
    "file_commits": whole_numbers(f"WITH {_LOG} SELECT repo_id, file_path, hash, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY ts DESC, hash) AS place FROM cf QUALIFY place <= 3", "place"),
    "file_authors": f"WITH {_LOG} SELECT repo_id, file_path, coalesce(arg_max(author, ts), '') AS author FROM cf GROUP BY 1, 2",
    "month_changes": f"WITH {_LOG} SELECT repo_id, file_path, count(DISTINCT hash) AS changes FROM cf WHERE ts > TIMESTAMP '2026-06-01' AND ts <= TIMESTAMP '2026-07-01' GROUP BY 1, 2",
    "commit_ancestry": f"WITH {_LOG} SELECT repo_id, hash FROM cm WHERE ts <= TIMESTAMP '2026-03-01'",
    "replay_plans": f"""WITH {_LOG} SELECT repo_id, CASE WHEN max(ts) <= TIMESTAMP '2026-03-01' THEN 'nothing' WHEN min(ts) > TIMESTAMP '2026-03-01' THEN 'full scan' ELSE 'replay' END AS plan,
 CASE WHEN min(ts) > TIMESTAMP '2026-03-01' THEN 0 ELSE count(*) FILTER (ts > TIMESTAMP '2026-03-01') END AS missed FROM cm GROUP BY 1""",
    "work_claims": whole_numbers(f"WITH {_QUEUE} SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY created_at, id) AS place FROM qu WHERE attempts < 3 QUALIFY place <= 20", "place"),
    "work_settled": f"""WITH {_QUEUE}, o AS (SELECT *, CASE WHEN id < '5' THEN 'error' WHEN id < 'a' THEN 'defer' ELSE 'done' END AS outcome, attempts + CASE WHEN id < '5' THEN 1 ELSE 0 END AS tried FROM qu)
SELECT kind, CASE WHEN outcome = 'done' THEN 'done' WHEN outcome = 'error' AND tried >= 3 THEN 'failed' ELSE 'pending' END AS state, tried::INTEGER AS attempts, count(*) AS rows, count(*) FILTER (outcome = 'defer') AS waiting FROM o GROUP BY 1, 2, 3""",
    "model_switch": """WITH r AS (SELECT * FROM node_vectors QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY embedded_at DESC NULLS LAST, content_hash NULLS FIRST, state NULLS FIRST) = 1)
SELECT 'static-hash-v2' AS model, CASE WHEN model IS DISTINCT FROM 'static-hash-v2' THEN 'pending' ELSE state END AS state, count(*) AS refs, (count(*) FILTER (model = 'static-hash-v2'))::BIGINT AS attempts FROM r GROUP BY 1, 2""",
    "promotions_per_file": f"SELECT repo_id, branch, file_path, count(DISTINCT last_promoted_at) AS changes FROM nodes WHERE file_path IS NOT NULL AND last_promoted_at > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AND last_promoted_at <= TIMESTAMP '{AS_OF}' GROUP BY 1, 2, 3",
    "superseded_links": f"WITH {SQL}, {_CF} SELECT f.finding_id, f.branch, f.node_id FROM cf f JOIN cn n ON n.node_id = f.node_id AND n.branch = f.branch WHERE f.state = 'open' AND f.rule = 'auto-link' AND n.last_promoted_at > f.created_at",
    "repo_resolution": r"""WITH t AS (SELECT DISTINCT lower(regexp_replace(target, '^\s+|\s+$', '', 'g')) AS asked FROM suppressions WHERE lower(trim(scope)) = 'repo' AND target IS NOT NULL), r AS (SELECT DISTINCT lower(repo_id) AS repo_id FROM repos)
SELECT asked, CASE WHEN count(*) FILTER (r.repo_id = asked) > 0 THEN 'exact' WHEN count(r.repo_id) = 1 THEN 'prefix' WHEN count(r.repo_id) > 1 THEN 'ambiguous' ELSE 'unknown' END AS how FROM t LEFT JOIN r ON starts_with(r.repo_id, asked) AND length(asked) >= 4 GROUP BY 1""",
    "work_lanes": "WITH p AS (SELECT DISTINCT repo_id, branch, file_path, last_promoted_at FROM nodes WHERE file_path IS NOT NULL AND last_promoted_at IS NOT NULL) SELECT strftime(last_promoted_at, '%Y-%m') AS month, kind, count(*) AS rows FROM p CROSS JOIN (VALUES " + ", ".join(f"('{k}')" for k in WORK_KINDS) + ") k(kind) GROUP BY 1, 2",
}
