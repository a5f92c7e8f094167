"""Tables written to the shared folder, to cut lineage between steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a fresh one if all runs in one local process (tests), else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.recurra.scratch", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recurra-")
        spark.conf.set("spark.recurra.scratch", root)
    return root.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df as a written table: a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*dfs: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in dfs:
        if df is not None and (path := getattr(df, "_saved_at", None)):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
