"""Tables in the shared folder of the cluster, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Paths of stored tables with what deletes them, which a stopped session still can.
_STORED: list[tuple[str, object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    return _OWN_DIR[0]


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Unlike an executor-local cache the table survives the loss of any executor. It is deleted by ``drop_stored`` or
    ``drop_stored_since``, else when the driver ends.
    """
    path = work_path(df.sparkSession, tag)
    if not _STORED:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    _STORED.append((path, df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(path: str, jvm, conf) -> None:
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(conf).delete(found, True)


def _at_exit() -> None:
    try:
        drop_stored_since(0)
    except (Py4JError, OSError):  # the JVM ended first
        _STORED.clear()


def drop_stored(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more; other tables are left alone."""
    for k, entry in enumerate(_STORED):
        if entry[0] == getattr(df, "stored_path", None):
            del _STORED[k]
            _delete(*entry)
            return


def stored_tables() -> int:
    """How many stored tables there are: a mark for ``drop_stored_since``."""
    return len(_STORED)


def drop_stored_since(mark: int, keep: DataFrame | None = None) -> None:
    """Delete the tables stored since ``mark``, but for ``keep``."""
    kept = getattr(keep, "stored_path", None)
    for entry in _STORED[mark:]:
        if entry[0] != kept:
            _delete(*entry)
    _STORED[mark:] = [x for x in _STORED[mark:] if x[0] == kept]
