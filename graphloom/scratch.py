"""Tables in the shared scratch folder: iterative operators cut their lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder in spark.checkpoint.dir. Without one a single machine uses a folder of its own; a cluster
    may not, as its executors would write to disks that others do not see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp()}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/t-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the scratch folder and read again."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that stored() returned; nothing may read them any more. Other frames and None are passed over."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
