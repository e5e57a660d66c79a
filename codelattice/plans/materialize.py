"""Cutting lineage: tables written to the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset (tests, a
single machine) one is made under the system's temporary folder for this session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, or one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        here = tempfile.mkdtemp(prefix="codelattice-")
        atexit.register(shutil.rmtree, here, True)
        _LOCAL[app] = "file://" + here
    return _LOCAL[app]


def _path(spark: SparkSession, where: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)


class Workspace:
    """A folder of written tables that belong to one operator call.

    Every ``write`` is a committed Parquet table, so a lost executor costs at most the
    stage that is running.  Tables that nothing reads any more are dropped at once;
    those that the returned DataFrame reads go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = _path(spark, self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.count = 0

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self.count += 1
        where = f"{self.root}/{self.count:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(where)
        back = self.spark.read.schema(df.schema).parquet(where)
        back._written_at = where
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table written here."""
        if df is not None and getattr(df, "_written_at", None):
            self.fs.delete(_path(self.spark, df._written_at), True)
