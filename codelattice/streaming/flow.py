"""Saves, staging and promotion as Structured Streaming, with the batch forms the streams must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from codelattice.operators.current import latest
from codelattice.operators.gates import BASE_TIME, as_of
from codelattice.plans.materialize import Workspace
from codelattice.sources.tables import table


def debounce(events: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """One row for each burst of events of a key: bursts end after ``gap`` without another.

    Works on streams (set a watermark on ``time`` first) and on tables alike.
    """
    return events.groupBy(*keys, F.session_window(time, gap).alias("burst")).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last")).select(*keys, F.col("burst.start").alias("started"), "last", "events")


def overlay(base: DataFrame, staged: DataFrame, tombstone: str = "deleted") -> DataFrame:
    """Base rows under staged files: a staged file replaces all of its base rows; a tombstone removes them.

    ``staged`` has the base columns, ``staged_at`` and the boolean ``deleted``; the last
    staging of a file counts, with all of its rows.
    """
    keys = ["repo_id", "branch", "file_path"]
    w = Window.partitionBy(*keys)
    newest = staged.withColumn("newest_", F.max("staged_at").over(w)).where("staged_at = newest_")
    rows = newest.where(~F.col(tombstone)).select(*base.columns)
    return base.join(staged.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def same_generation(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Writes whose generation is the repo's current one; late writes of an older branch state are dropped."""
    return writes.join(current.select("repo_id", F.col("generation").alias("now_")), "repo_id").where("generation = now_").drop("now_")


def promote(target: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: replaces whole files in a node table partitioned by repo_id and branch.

    Only the touched partitions are read and overwritten, so a batch that is run again
    gives the same table.  A file's last rows in the batch win.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        work = Workspace(spark, f"promote-{batch_id}")
        keys = ["repo_id", "branch", "file_path"]
        w = Window.partitionBy(*keys)
        new = batch.withColumn("newest_", F.max("last_promoted_at").over(w)).where("last_promoted_at = newest_").drop("newest_")
        new = work.write(latest(new, ["node_id", "branch"], [F.col("last_promoted_at").desc_nulls_last(), F.col("content_hash").asc()]), "new")
        try:
            old = spark.read.schema(batch.schema).parquet(target)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            old = spark.createDataFrame([], batch.schema)
        touched = new.select("repo_id", "branch").distinct()
        kept = old.join(touched, ["repo_id", "branch"], "left_semi").join(new.select(*keys).distinct(), keys, "left_anti")
        merged = work.write(kept.select(*batch.columns).unionByName(new.select(*batch.columns)), "merged")
        merged.repartition("repo_id", "branch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id", "branch").parquet(target)
        work.drop(merged)
        work.drop(new)

    return run


def start_promotion(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str):
    """Promote all files of a folder that have not been promoted yet, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(source)
    return stream.writeStream.foreachBatch(promote(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resync(snapshot: DataFrame, known: DataFrame, unknown_too: bool) -> DataFrame:
    """Files to look at again after missed events: (path, op), by modification time and size against what is known."""
    s = snapshot.select("path", F.col("mtime").alias("m2"), F.col("size").alias("s2"), F.lit(True).alias("is_"))
    j = known.select("path", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("was")).join(s, "path", "full")
    same = F.col("m1").eqNullSafe(F.col("m2")) & F.col("s1").eqNullSafe(F.col("s2"))
    op = F.when(F.col("is_").isNull(), "remove").when(F.col("was").isNull(), F.lit("write") if unknown_too else F.lit(None)).when(~same, "write")
    return j.select("path", op.alias("op")).where("op IS NOT NULL")


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of each user's events: 30 minutes without another end one."""
    s = debounce(table(spark, d, "events"), ["user_id"], "ts", "30 minutes")
    return s.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "events")


def overlay_latest(spark: SparkSession, d: str) -> DataFrame:
    """The graph at the base time under everything promoted or deleted since, staged file by file."""
    n, x = table(spark, d, "nodes"), table(spark, d, "deleted_files")
    t = F.lit(BASE_TIME).cast("timestamp_ntz")
    base = as_of(n, x, BASE_TIME)
    late = latest(n.where(F.col("last_promoted_at") > t), ["node_id", "branch", "last_promoted_at"], [F.col("content_hash").asc()])
    gone = x.where(F.col("deleted_at") > t)
    staged = late.where("file_path IS NOT NULL").withColumn("staged_at", F.col("last_promoted_at")).withColumn("deleted", F.lit(False))
    dead = gone.select(*[F.col(c) if c in gone.columns else F.lit(None).cast(n.schema[c].dataType).alias(c) for c in n.columns], F.col("deleted_at").alias("staged_at"), F.lit(True).alias("deleted"))
    return overlay(base, staged.unionByName(dead)).select("node_id", "branch", "file_path")


def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events counted by hour and type by a stream that reads all files there are and stops."""
    work = Workspace(spark, "rollup")
    events = table(spark, d, "events")
    out, marks = f"{work.root}/out", f"{work.root}/marks"
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("hour"), "event_type", "n", "v").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    parts = spark.read.parquet(out)
    return parts.groupBy(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.sum("n").alias("events"), F.round(F.sum("v"), 4).alias("value"))


_LATEST = "QUALIFY row_number() OVER (PARTITION BY node_id, branch ORDER BY last_promoted_at DESC NULLS LAST, content_hash ASC NULLS FIRST) = 1"
QUERIES = {f.__name__: f for f in (debounce_sessions, overlay_latest, stream_rollup)}
ORACLE = {
    "debounce_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS events FROM b GROUP BY user_id, k""",
    "overlay_latest": f"""WITH base AS (SELECT * FROM (SELECT * FROM nodes WHERE last_promoted_at <= TIMESTAMP '{BASE_TIME}' {_LATEST}) n WHERE NOT EXISTS (SELECT 1 FROM deleted_files x WHERE x.repo_id = n.repo_id AND x.branch = n.branch AND x.file_path = n.file_path AND x.deleted_at >= n.last_promoted_at AND x.deleted_at <= TIMESTAMP '{BASE_TIME}')),
st AS (SELECT repo_id, branch, file_path, node_id, last_promoted_at AS ts_, false AS gone FROM nodes WHERE last_promoted_at > TIMESTAMP '{BASE_TIME}' AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node_id, branch, last_promoted_at ORDER BY content_hash) = 1
 UNION ALL SELECT repo_id, branch, file_path, NULL, deleted_at, true FROM deleted_files WHERE deleted_at > TIMESTAMP '{BASE_TIME}'),
top AS (SELECT * FROM st QUALIFY ts_ = max(ts_) OVER (PARTITION BY repo_id, branch, file_path))
SELECT node_id, branch, file_path FROM base b WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.repo_id = b.repo_id AND st.branch = b.branch AND st.file_path = b.file_path) UNION ALL SELECT node_id, branch, file_path FROM top WHERE NOT gone""",
    "stream_rollup": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
