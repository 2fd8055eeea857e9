"""Preprocessing is stateless per record, so the batch plan runs on a stream as it is, behind the reader of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.records import preprocess
from ..sources.readers import text_reader, without_missing

COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def read_stream(spark: SparkSession, folder: str, sep: str = "\t", files_per_trigger: int = 100, multiline: bool = True) -> DataFrame:
    """New files of a folder as they come; missing values as in a batch. Each file is one task with multiline."""
    return without_missing(text_reader(spark.readStream, COLUMNS, sep, multiline).option("maxFilesPerTrigger", files_per_trigger).csv(folder))


def preprocess_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True):
    """Start a query that appends preprocessed records of new files to Parquet; each file is taken exactly once."""
    w = preprocess(read_stream(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
