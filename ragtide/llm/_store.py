"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the largest table that narrowed() sends to all tasks.
BUCKETS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local master gets a folder made once for the session; on
    a cluster executors could not see such a folder, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='ragtide-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def narrowed(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df without most of the rows whose key isn't in wanted (one column), before they are shuffled. Keys are dealt into
    BUCKETS buckets, so that what is sent to all tasks has a fixed size; where wanted fills all of them, every row passes.
    A join on the key itself has to follow."""

    def bucket(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    used = wanted.select(bucket(F.col(wanted.columns[0])).alias("__bucket")).distinct()
    return df.join(F.broadcast(used), bucket(key) == F.col("__bucket"), "left_semi")


class Store:
    """Writes tables under one fresh folder; drop() deletes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets Spark's cleaner delete shuffle files of finished steps: it does so once the driver's garbage is collected."""
        for _ in range(2):  # what the first round frees holds on to more
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
