"""Session helpers: requests as local relations, and tables staged in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A request (a short list of tuples) as a local relation, whose size the planner knows."""
    schema = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], names=schema.names)
    return spark.createDataFrame(table, schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Where it is unset, a session that runs within one process may use a folder of that machine. On a cluster every
    executor would write to its own disk, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.gettempdir()


_STAGED: list[str] = []
_CLEARED = 0


def staged_generation() -> int:
    """How often staged folders were deleted; what was staged under an earlier number is gone."""
    return _CLEARED


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder; `clear_staged` deletes it."""
    path = f"{shared_folder(spark)}/panelgrid-{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def clear_staged(spark: SparkSession) -> int:
    """Delete the folders that this session staged, once no result built on them is needed. Returns their number."""
    global _CLEARED
    jvm, count = spark.sparkContext._jvm, len(_STAGED)
    _CLEARED += 1
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def staged_paths() -> list[str]:
    """The folders that this session staged and has not deleted."""
    return list(_STAGED)


def drop_staged(spark: SparkSession, paths: list[str], unless: DataFrame | None = None) -> int:
    """Delete some staged folders that nothing will read any more, but for those that `unless` still reads. Returns their number."""
    read = unless.inputFiles() if unless is not None and paths else []
    gone = [p for p in paths if p in _STAGED and not any(p.rsplit("/", 1)[1] in f for f in read)]
    for name in gone:
        _STAGED.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a reused intermediate table to the shared folder and read it back.

    Used where several branches read the same derived rows: the rows are computed once, survive
    the loss of executors, keep later plans short, and have a known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
