"""Readers of the corpus tables and small helpers on physical layout."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blank at the ends of ids and labels.
BLANKS = " \t\r\n\f\x0b "


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy_id(col: Column) -> Column:
    """Trimmed lower-case id; null where nothing remains."""
    return F.nullif(F.lower(F.btrim(col, F.lit(BLANKS))), F.lit(""))


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Rows dealt round robin if the scan has fewer partitions than cores.

    For narrow, CPU-heavy stages over few files. A large scan has more splits
    than cores already and passes unchanged, without a shuffle.
    """
    try:
        parts = df._jdf.queryExecution().toRdd().getNumPartitions()
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # a remote session has neither
        return df
    return df.repartition(cores * per_core) if parts < cores else df


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names; a local one only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        import tempfile

        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cardmill-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back.

    Cuts the lineage like ``checkpoint()`` but runs the plan once and keeps the
    columns compressed; survives the loss of executors. Files go when the
    session's process ends.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{folder.rstrip('/')}/cardmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone
        pass
