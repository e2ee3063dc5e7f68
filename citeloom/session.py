"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """Where tables between steps are written: the folder of this application below spark.checkpoint.dir.

    All executors share it, so a lost executor costs nothing. Only where none is named
    (tests on one machine) a folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="citeloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{sc.applicationId}"


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df as a table of the shared folder and go on from there, with a short plan and its true size.

    done: results of earlier cuts that nothing needs any more; their files are removed.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # noqa: SLF001
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a DataFrame that cut() gave; others are left alone."""
    if path := getattr(df, "_cut_path", None):
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001


def keep(df: DataFrame) -> DataFrame:
    """Hold df for several uses; what is lost with an executor is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
