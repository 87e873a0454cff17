"""Arriving documents as a stream: the row-wise cleaning of the batch path, and appends of every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.profiles import ZH, Profile
from ..operators import filters


def read(spark: SparkSession, folder: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """Parquet files that arrive in a folder, at most max_files in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def clean(docs: DataFrame, profile: Profile = ZH, text_col: str = "text", least: int = filters.LEAST_DOCUMENT) -> DataFrame:
    """Cleaned documents that are long enough and not of low quality. No state is kept."""
    text = T.clean_text(F.col(text_col))
    rows = docs.withColumn(text_col, text)
    return filters.long_enough(rows, text_col, least).where(~filters.is_low_quality(F.col(text_col), profile))


def once(docs: DataFrame, key: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """The first of the rows that share a key within the delay; state older than the watermark is dropped."""
    return docs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def write(docs: DataFrame, folder: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append every micro-batch to a Parquet folder, once for all that has arrived. step: a batch operator applied to each micro-batch."""
    if step is None:
        return docs.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def append(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces its own folder
        step(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
