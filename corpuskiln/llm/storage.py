"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The tables that this driver has written, in order.
_written: list[str] = []


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, and only in local mode, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/corpuskiln/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, compression: str = "snappy", **options: object) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage is cut, and lost executors lose nothing.

    The folders stay until they are dropped, or the shared folder is emptied; they may go once the results are written.
    """
    path = new_path(df.sparkSession, label)
    _written.append(path)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of the tables that this driver writes."""
    return len(_written)


def last() -> str:
    """The table written last."""
    return _written[-1]


def drop_since(spark: SparkSession, point: int, keep: str = "") -> None:
    """Removes the tables written since a `mark`, but one; they must not be read any more."""
    for path in _written[point:]:
        if path != keep:
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    _written[point:] = [path for path in _written[point:] if path == keep]
