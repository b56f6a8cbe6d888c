"""Reading tables and cutting lineage through tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that cut() wrote: session, path, and a weak reference to what a plan needs to read the table.
_made: list[tuple[SparkSession, str, object]] = []
#: Bytes of a side that is broadcast, at most, by default.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor reaches, as spark.checkpoint.dir names it. Where it is unset, a session in one process
    (as in tests) gets a temporary one; on a cluster that is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: a reliable cut of the lineage that survives lost executors.

    The table is deleted once no plan reads it any more (looked at with each further cut), at the end of a scope() around
    it, or at the end of the JVM, whichever comes first.
    """
    sweep()
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    files = back._jdf.queryExecution().analyzed().relation().location()
    _made.append((spark, path, spark._jvm.java.lang.ref.WeakReference(files)))
    return back


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder for files that a query writes and reads; deleted at the end of the JVM."""
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


def sweep() -> None:
    """Deletes the tables that no plan reads any more. Tables of a stopped session go with its JVM."""
    kept = []
    for spark, path, files in _made:
        if spark._jsc.sc().isStopped():
            continue
        if files.refersTo(None):
            _delete(spark, path)
        else:
            kept.append((spark, path, files))
    _made[:] = kept


@contextmanager
def scope():
    """Tables that are cut inside are deleted at the end, so results must have been written by then."""
    known = {path for _, path, _ in _made}
    try:
        yield
    finally:
        for spark, path, files in [m for m in _made if m[1] not in known]:
            if not spark._jsc.sc().isStopped():
                _delete(spark, path)
        _made[:] = [m for m in _made if m[1] in known]


def checked_broadcast(df: DataFrame, most_rows: int, row_bytes: int = 64, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if it has at most most_rows rows, and at most most_bytes at row_bytes a row as a task holds
    it, else df as it is, to be merged; the flag says which."""
    most = min(most_rows, most_bytes // row_bytes)
    small = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if small else df.hint("merge")), small
