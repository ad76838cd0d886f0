"""Tables written to the folder that a cluster shares: how iterative plans cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task holds of a column while it writes and, whole, while it reads.
ROW_GROUP_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a session in one process takes a temporary folder of its
    machine; a cluster's executors would each see another one, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/quern-checkpoints"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/quern/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """Write a DataFrame to the shared folder; its path, and the table read from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
