"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, a local master (as in tests) gets a folder of its own; on a
    cluster that would be another folder on each machine, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: The paths that each open ``scratch`` has to delete.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within. What is made of them must have been written by then, to a
    path that was taken before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder of this application, which is deleted when its driver ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    made = f"{folder}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: later stages start from files, not from lost tasks."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
