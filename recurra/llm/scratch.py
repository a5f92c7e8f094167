"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, so that long texts don't fill a Python worker.
BATCH_BYTES = 4 << 20
#: Bytes of a row group of a written table, which its writer holds.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a fresh one if all runs in one local process (tests); on a cluster a machine's own folder would lose tables, so there it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.recurra.scratch", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recurra-")
        spark.conf.set("spark.recurra.scratch", root)
    return root.rstrip("/")


class Scratch:
    """Writes tables under one fresh folder of the shared directory and deletes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.left: set[str] = set()

    def save(self, df: DataFrame, name: str | None = None, **options) -> DataFrame:
        """df as a written table: a lost executor costs a read, not a recomputation. name: of its folder; options: of the writer."""
        self.n += 1
        path = f"{self.root}/{name or f't{self.n}'}"
        df.write.options(**{"parquet.block.size": ROW_GROUP} | options).parquet(path)
        self.left.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(getattr(df, "_scratch_path", None))

    def drop_all_but(self, df: DataFrame) -> None:
        for path in self.left - {df._scratch_path}:
            self._delete(path)

    def _delete(self, path: str | None) -> None:
        if path in self.left:
            self.left.remove(path)
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tasks(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches to BATCH_BYTES in this session, unless it has a smaller bound already. Plans are lazy, so the setting has to outlive this call."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdecimal() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
