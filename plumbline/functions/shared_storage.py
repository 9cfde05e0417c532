"""Places that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where a local session names none (tests).

    On a cluster every machine has its own temporary folders, so there the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not current.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._written_at = path
    return written


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more; other tables are left alone."""
    if path := getattr(df, "_written_at", None):
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def version_of(spark: SparkSession, source: str) -> tuple:
    """What tells one state of the tables under ``source`` from another: times, sizes and numbers of files of each table.

    A few calls for each table, however many files it has.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for table in store.listStatus(place):
        whole = store.getContentSummary(table.getPath())
        found.append((table.getPath().getName(), table.getModificationTime(), whole.getLength(), whole.getFileCount()))
    return tuple(sorted(found))


_WRITTEN: dict[tuple[str, str, str], tuple[tuple, DataFrame]] = {}


def written_once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written at the first call for ``source`` and ``name`` and read from then on, until the tables at ``source`` change.

    For measures that many queries over the same tables share. Tables that were written before a
    change stay, since results may still read them.
    """
    key, version = (spark.sparkContext.applicationId, source, name), version_of(spark, source)
    if _WRITTEN.get(key, (None,))[0] != version:
        _WRITTEN[key] = (version, materialize(build(), name))
    return _WRITTEN[key][1]
