"""Shared storage for intermediate tables: survives lost executors and cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a thin table, about.
ROWS_A_FILE = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share (``spark.checkpoint.dir``).

    Where none is named, one below ``/tmp/checkpoints`` is set for this session
    if all runs on this machine; else that is an error, as executors do not see
    each other's folders.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        place = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold few rows, as texts are long: an executor keeps some batches a task outside its heap, and its worker a copy.

    Only where the session leaves Spark's own number (10000 rows); a smaller or
    otherwise chosen one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/graphloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into shared storage and read it back; returns the table and its path.

    ``rows``, where about so many are known to come, gathers thin tables into
    few files (and tasks), instead of one a shuffle partition.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    few = df if rows is None else df.coalesce(max(8, -(-rows // ROWS_A_FILE)))
    few.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
