"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.marketloom.scratchDir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that has none gets a local folder, and one on a cluster is refused."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not told:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="spark-marketloom-", dir="/tmp")
        spark.conf.set(_OWN, told)
    return told.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/marketloom-{what}-{uuid.uuid4().hex}"
    for made in _open:
        made.add(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs only its running tasks.

    Shuffle files of the job that writes it are deleted when it is done, since nothing else reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and ``df`` reads; nothing may read them any more."""
    spark = df.sparkSession
    mine = _qualified(spark, f"{shared_dir(spark)}/marketloom-x").getParent()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = _qualified(spark, folder)
        if path.getParent().equals(mine) and path.getName().startswith("marketloom-"):
            _delete(spark, path)


@contextmanager
def only_results(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that ``written`` makes inside go at the end, after a failure too, but for those that the DataFrames put into the list read."""
    made: set[str] = set()
    keep: list[DataFrame] = []
    _open.append(made)
    done = False
    try:
        yield keep
        done = True
    finally:
        _open[:] = [x for x in _open if x is not made]  # by identity: two of them may hold the same paths
        stay = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()} if done else set()
        for path in made:
            if path.rpartition("/")[2] not in stay:
                _delete(spark, _qualified(spark, path))


def _qualified(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
