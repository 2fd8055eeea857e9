"""Readers: explicit schemas, tabular quoting rules, missing-value spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import MISSING
from ..operators.blocking import true_pairs
from ..operators.records import check_columns

SOURCE_FILES = {"S1": "train_source1.tsv", "S2": "train_source2.tsv", "S3": "train_source3.tsv"}
TRUTH_FILE = "train_ground_truth.tsv"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def text_reader(reader, columns: list[str], sep: str, multiline: bool):
    """The options of delimited text with a header, for a batch or a stream: quotes are doubled inside quotes."""
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "multiLine": multiline, "enforceSchema": True}
    return reader.schema(text_schema(columns)).options(**options)


def without_missing(df: DataFrame) -> DataFrame:
    """The usual spellings of a missing value as null."""
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some field holds a line break: then, and only then, a line has an odd number of quotes."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def read_text_table(spark: SparkSession, path: str, sep: str = "\t", missing: bool = True, multiline: bool | None = None, first: int | None = None) -> DataFrame:
    """A delimited file with a header, every column a string; quotes are doubled inside quotes, fields may hold line
    breaks. With missing=True the usual spellings of a missing value become null; first: that many rows from the top.

    A file whose fields hold line breaks can't be split, so each such file is one task. multiline=None looks for them in
    a split pass over the lines; multiline=False takes their absence as given, multiline=True their presence."""
    header = spark.read.text(path).first()
    names = [c.strip('"') for c in header[0].lstrip("\ufeff").split(sep)] if header else []
    if multiline is None:
        multiline = has_line_breaks(spark, path)
    df = text_reader(spark.read, names, sep, multiline).csv(path)
    if first:
        order = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
        df = df.select("*", *order).orderBy("_file", "_block", "_line").limit(first).drop("_file", "_block", "_line")
    return without_missing(df) if missing else df


def read_source(spark: SparkSession, path: str, sample: int | None = None, multiline: bool | None = None) -> DataFrame:
    """One record source, or its first `sample` rows; missing files and missing required columns raise."""
    return check_columns(read_text_table(spark, path, multiline=multiline, first=sample))


def read_sources(spark: SparkSession, folder: str, sample: int | None = None) -> dict[str, DataFrame]:
    return {k: read_source(spark, f"{folder}/{f}", sample) for k, f in SOURCE_FILES.items()}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(S1_id, S2_id) by position, without nulls and repeats."""
    return true_pairs(read_text_table(spark, path))


def read_training_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read_sources(spark, folder) | {"ground_truth": read_truth(spark, f"{folder}/{TRUTH_FILE}")}


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a stored Parquet table, repeats dropped; only these are read."""
    return spark.read.parquet(path).select(*dict.fromkeys(columns))
