"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of our own, which only local runs have a use for."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-sedimenta-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Whether Spark removes a query's shuffle files when it has run; else they stay until the driver collects garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    A lost executor later costs a reread of some files and no recomputation, and several readers share one pass.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sedimenta/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def tidied(df: DataFrame) -> DataFrame:
    """:func:`written`, the shuffle files of the write removed with it: for steps of which each is as large as the input."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        return written(df)
    finally:
        spark.conf.set(_CLEANED, before)


def discarded(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` gave, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
