"""The folder that driver and executors share, for files that outlive a task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a folder of this machine, but never on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="recollect-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path there that nothing has."""
    return f"{shared_dir(spark)}/recollect/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of a frame, computed now and kept in the shared folder."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that isn't there yet; False where another writer came first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception.getMessage()):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, by name; nothing where it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []
