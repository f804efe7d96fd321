"""Scratch folders in the place all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or "/tmp/atlasforge-scratch").rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name; removed when the program ends."""
    path = f"{shared_dir(spark)}/atlasforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def file_identity(spark: SparkSession, *paths: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of change of every file at the paths (tables or folders), in order: what a kept copy of them depends on."""
    jvm, conf, found = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf).listFiles(target, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, through the file system that holds it; None where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: readers see the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = target.getFileSystem(conf).create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, how)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back, with the columns in their order."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
