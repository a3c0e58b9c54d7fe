"""Tables staged in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. Where that is unset, a temporary folder of its own, in local mode alone: on a cluster executors would write to their own disks."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="parley-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table in the shared folder."""
    return f"{shared_folder(spark)}/parley/{re.sub('[^a-z0-9]+', '-', name.lower())}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once as Parquet and read again."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table's files when nothing later reads them."""
    spark = df.sparkSession
    if files := df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
