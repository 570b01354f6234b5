"""Results that several later steps read: written once, read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that crosses to Python.
BATCH = 4 << 20
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}
#: Shuffle files would stay until the driver happens to collect its garbage.
_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; where none is set, a local session has its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("distloom.store", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="distloom-")
        spark.conf.set("distloom.store", folder)
    return f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """While an action runs inside, settings hold; the session's own hold again afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """A batch of an action inside ends at BATCH bytes, whatever the size of the rows."""
    return _set(spark, _BATCH)


def writing(spark: SparkSession) -> AbstractContextManager[None]:
    """As small_batches; the shuffle files of an action inside go as it ends."""
    return _set(spark, _BATCH | _CLEANUP)


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = shared_folder(df.sparkSession)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, *columns: str) -> DataFrame:
    """As stored, in buckets of the columns, by which df.repartition(buckets(spark), *columns) has dealt the rows: later joins on the columns leave these rows where they are."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    name = f"stored_{uuid.uuid4().hex}"
    with writing(spark):
        df.write.format("parquet").option("path", path).bucketBy(buckets(spark), *columns).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: what is read lies in the folder
    return found


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
