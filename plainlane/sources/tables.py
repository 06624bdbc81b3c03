"""Tables on shared storage: reading them, spreading small ones over all cores, and staging results."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Files of less than this may hold fewer row groups than there are cores; their rows are dealt out once.
SMALL_BYTES = 48 << 20


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size: for files, their size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """df, dealt to all cores if its files are small: Spark reads a row group in one task, and scanning texts costs more than
    moving so few. Larger inputs have row groups enough and stay where they are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size_of(df) < small else df


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share (spark.checkpoint.dir), None if none is set."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else None


@lru_cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"plainlane-{application}-")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which the session deletes when it ends: a lost executor costs nothing of it.

    Where no folder is set the table goes into a temporary folder of this machine if Spark is local (tests), else it is an error,
    for other machines would not see it.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
