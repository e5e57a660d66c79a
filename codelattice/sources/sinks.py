"""Sinks: upserts by rewrite of the touched partitions, findings, logs, pages, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from codelattice.functions.text import redact


def upsert_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same (finding_id, branch) but keep the first ``created_at``."""
    keys = ["finding_id", "branch"]
    w = Window.partitionBy(*keys)
    rows = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    rows = rows.withColumn("first_", F.min("created_at").over(w)).withColumn("rn_", F.row_number().over(w.orderBy(F.col("new_").desc(), F.col("created_at").desc())))
    return rows.where("rn_ = 1").withColumn("created_at", F.col("first_")).select(*old.columns)


def delete_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the files that are gone, and edges without their nodes."""
    keys = ["repo_id", "branch", "file_path"]
    kept = nodes.join(gone.select(*keys).distinct(), keys, "left_anti")
    lost = nodes.join(gone.select(*keys).distinct(), keys, "left_semi").select("node_id", "branch").distinct()
    for end in ("src_node_id", "dst_node_id"):
        edges = edges.join(lost.withColumnRenamed("node_id", end), [end, "branch"], "left_anti")
    return kept, edges


def append_audit(log: DataFrame, column: str, path: str, day: str | None = None, keep_days: int | None = None) -> None:
    """Append log rows as JSON lines, secrets redacted; with a ``day`` (``2026-01-31``) into that day's folder, and of those only the last ``keep_days`` stay."""
    where = path if day is None else f"{path}/day={day}"
    log.withColumn(column, redact(F.col(column))).write.mode("append").json(where)
    if day is not None and keep_days is not None:
        _prune(log.sparkSession, path, "day=", keep_days)


def _prune(spark: SparkSession, path: str, prefix: str, keep: int) -> list[str]:
    """Delete all but the last ``keep`` folders by name; returns the names that stay, newest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(prefix)), reverse=True)
    for old in names[keep:]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return names[:keep]


def add_vectors(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert vectors whose hash the store lacks."""
    return store.unionByName(fresh.dropDuplicates(["embed_hash"]).join(store.select("embed_hash").distinct(), "embed_hash", "left_anti").select(*store.columns))


def postings(nodes: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Lexical postings (term, node_id, tf), of the touched files only where given."""
    from codelattice.functions.text import symbol_tokens

    keys = ["repo_id", "branch", "file_path"]
    n = nodes if touched is None else nodes.join(touched.select(*keys).distinct(), keys, "left_semi")
    return n.select("node_id", F.explode(symbol_tokens(F.concat_ws(" ", "kind", "symbol_path"))).alias("term")).groupBy("term", "node_id").agg(F.count(F.lit(1)).alias("tf"))


def wiki_page(rows: DataFrame, title: str, limit: int = 20) -> str:
    """A Markdown table of the first rows of a report, which is small by its own limit."""
    cut = rows.limit(limit).collect()
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in cut]) + "\n"


def save_vectors(store: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """References after embedding: ready with their vector, else tried once more and, at the third try, failed.

    ``store`` (embed_hash, state, attempts, embedding), ``results`` (embed_hash, embedding: null where it went
    wrong).  References that are no longer pending keep what they have; repeated results count once, a vector before none.
    """
    r = results.groupBy("embed_hash").agg(F.max_by("embedding", F.col("embedding").isNotNull()).alias("new_"), F.lit(True).alias("came_"))
    j = store.join(r, "embed_hash", "left")
    open_ = F.col("came_").isNotNull() & (F.col("state") == "pending")
    good, bad = open_ & F.col("new_").isNotNull(), open_ & F.col("new_").isNull()
    new = {
        "state": F.when(good, "ready").when(bad & (F.col("attempts") + 1 >= attempts), "failed").otherwise(F.col("state")),
        "attempts": F.col("attempts") + bad.cast("int"),
        "embedding": F.when(good, F.col("new_")).otherwise(F.col("embedding")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in store.columns])


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Copy tables into a folder; each copy's rows are counted as it is written and again as it is read."""
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{folder}/{name}.parquet").count()
        if counts[name] != seen.get["n"]:
            raise OSError(f"{name}: the copy has {counts[name]} rows")
    return counts


def backup(spark: SparkSession, tables: dict[str, DataFrame], folder: str, stamp: str, keep: int = 7) -> list[str]:
    """A snapshot under its time stamp; all but the last ``keep`` are deleted once it is complete.  Returns the stamps that stay, newest first."""
    snapshot(spark, tables, f"{folder}/at={stamp}")
    return [x.removeprefix("at=") for x in _prune(spark, folder, "at=", keep)]


def verify(spark: SparkSession, folder: str, stamp: str, tables: dict[str, DataFrame]) -> dict[str, bool]:
    """Whether each table of a backup holds the same rows as now, in whatever order: counts and checksums."""
    def mark(df: DataFrame) -> tuple:
        r = df.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)]).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s")).first()
        return r["n"], r["s"]

    return {name: mark(df) == mark(spark.read.parquet(f"{folder}/at={stamp}/{name}.parquet")) for name, df in tables.items()}


def restore(spark: SparkSession, folder: str, stamp: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a backup."""
    return {name: spark.read.parquet(f"{folder}/at={stamp}/{name}.parquet") for name in names}


def save_index(store: DataFrame, path: str) -> None:
    """Write ready vectors, one folder for each model, so that one is loaded without the others."""
    store.where("state = 'ready' AND embedding IS NOT NULL").write.mode("overwrite").partitionBy("model").parquet(path)


def load_index(spark: SparkSession, path: str, model: str, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors of the model that references still name, references without a vector: to be embedded anew)."""
    have = spark.read.parquet(path).where(F.col("model") == model)
    return have.join(refs.select("embed_hash").distinct(), "embed_hash", "left_semi"), refs.join(have.select("embed_hash"), "embed_hash", "left_anti")
