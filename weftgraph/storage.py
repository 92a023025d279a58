"""The folder that all machines share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on one machine (tests) where it is not set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    return (named or f"{tempfile.gettempdir()}/weftgraph-shared").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at a copy that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wg_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing lazy reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._wg_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_blocks(df: DataFrame, name: str, n: int) -> str:
    """Write df, whose column block goes from 0 to n - 1, to the shared folder by block; the folder as a URI."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition(n, "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()


def block_files(spark: SparkSession, uri: str) -> dict[int, list[str]]:
    """Of every block that has rows the names of its files below uri: as many as there are blocks, each a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for folder in fs.listStatus(path):
        name = folder.getPath().getName()
        if name.startswith("block="):
            out[int(name[6:])] = [f"{name}/{f.getPath().getName()}" for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
    return out


def open_blocks(uri: str, files: list[str], read: Callable) -> list:
    """read(file, filesystem) of each, in a task: by pyarrow's file systems."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(uri)
    return [read(f"{root}/{f}", filesystem=system, partitioning=None) for f in files]
