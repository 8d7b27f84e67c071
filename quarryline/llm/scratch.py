"""Where intermediate tables go.

Lineage is cut by writing Parquet under the folder named in ``spark.checkpoint.dir``, which every
executor and the driver share, so a lost executor costs only the tasks that were running.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.gettempdir()}/quarryline-checkpoints"
    return at.rstrip("/")


#: Tables of this process that are still there.
_written: dict[str, SparkSession] = {}


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read back; the table holds exactly the rows of ``df``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarryline/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no result to come reads any more."""
    for t in tables:
        path = t.stored_at
        spark = _written.pop(path, None)
        if spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear() -> None:
    """Delete all tables of this process; results that were not yet evaluated are lost."""
    for path, spark in list(_written.items()):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; whoever owns the folder cleans it
            return
        _written.pop(path, None)


atexit.register(clear)
