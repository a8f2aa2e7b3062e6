"""Tables between the phases of a job, in a folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
#: While a scratch table is written: shuffle files go when it is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir. On one machine a temporary folder will do where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed for tables between phases")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="terraloom-")
            atexit.register(shutil.rmtree, _own_dirs[app], True)
        root = _own_dirs[app]
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation of what came before.

    Those that a result is read from stay until the application's folder is cleared; the others are dropped when done with.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and gives it back as read from there, with the same columns. Shuffle files of the write are deleted."""
        path = f"{self.base}/{name}"
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(hadoop).delete(path, True)
            self.names.remove(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.names if n not in names])
