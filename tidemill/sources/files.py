"""Files of any store that Spark reaches, through Hadoop's file systems: existence, folders, copies, local staging, writes in the
background. Spark reads and writes remote paths itself; these are for what must be a local file, and for drivers."""

from __future__ import annotations

import hashlib
import os
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_WRITERS = ThreadPoolExecutor(max_workers=4, thread_name_prefix="tidemill-writer")


def _located(spark: SparkSession, path: str):
    """The file system of a path, and the path, on the JVM."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _located(spark, path)
    return fs.exists(found)


def make_dirs(spark: SparkSession, path: str) -> bool:
    fs, found = _located(spark, path)
    return fs.mkdirs(found)


def copy(spark: SparkSession, source: str, target: str, *, overwrite: bool = True) -> bool:
    """Copy a file or folder between any two stores."""
    (a, p), (b, q) = _located(spark, source), _located(spark, target)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, overwrite, spark._jsparkSession.sessionState().newHadoopConf())


def local_copy(spark: SparkSession, source: str, cache_dir: str) -> str:
    """A local path with the content of ``source``: itself where that is a local path, else a copy under the MD5 of its address, made
    once. A copy that broke off isn't taken for one."""
    if "://" not in source and not source.startswith("file:"):
        return source
    folder = os.path.join(cache_dir, hashlib.md5(source.encode()).hexdigest())
    target, done = os.path.join(folder, os.path.basename(source.rstrip("/"))), os.path.join(folder, ".done")
    if not os.path.exists(done):
        os.makedirs(folder, exist_ok=True)
        copy(spark, source, "file://" + os.path.abspath(target))
        with open(done, "w"):
            pass
    return target


def write_in_background(df: DataFrame, path: str, *, format: str = "parquet", mode: str = "errorifexists") -> Future:
    """Write a table from a thread of the driver; the future's ``result`` waits and raises what went wrong."""
    return _WRITERS.submit(lambda: df.write.format(format).mode(mode).save(path))
