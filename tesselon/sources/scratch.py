"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own and any other an error,
    as no executor could read what another has written."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(sc, "_tesselon_scratch", None)
        if root is None:
            sc._tesselon_scratch_dir = own = tempfile.TemporaryDirectory(prefix="tesselon-")
            root = sc._tesselon_scratch = f"file://{own.name}"
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared folder and read from there, so a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes the named tables, or all."""
        for path in [self.path(n) for n in names] or [self.root]:
            try:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session has ended; the folder goes with it
                return
