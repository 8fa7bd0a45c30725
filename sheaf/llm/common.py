"""Session helpers of the operators."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 2000


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Parts of about ``each`` bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def send(spark: SparkSession, value) -> Broadcast:
    """A broadcast that executors without the package can read: the package's classes travel inside it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    """The value that ``send`` sent."""
    return pickle.loads(shared.value)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that a step's own columns cannot clash with them; ``rest.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rest")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
