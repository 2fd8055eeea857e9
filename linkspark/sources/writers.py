"""Writers: Parquet between stages, delimited text on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.country import encode_country
from .readers import read_text_table


def write_records(df: DataFrame, path: str) -> DataFrame:
    """Parquet, split by source where there is such a column; read back."""
    w = df.write.mode("overwrite")
    (w.partitionBy("source") if "source" in df.columns else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spill(df: DataFrame, path: str) -> DataFrame:
    """Write a candidate set and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Lists as text such as ['a', 'b'], for text formats."""
    lists = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return df.select(*(shown(F.col(c)).alias(c) if c in lists else F.col(c) for c in df.columns))


def write_text_table(df: DataFrame, path: str, sep: str = ",") -> None:
    flat(df).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """The audit has one row per rule, so it is one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def recode_countries(spark: SparkSession, paths: list[str], out: str) -> list[str]:
    """Rewrite each comma-separated file that has a country column with coded countries, under `out`; returns those
    that were skipped. A file is never overwritten while it is read."""
    skipped = []
    for p in paths:
        df = read_text_table(spark, p, ",", missing=False)
        if "country" not in df.columns:
            skipped.append(p)
            continue
        write_text_table(df.withColumn("country", encode_country(F.col("country"))), f"{out}/{p.rstrip('/').rpartition('/')[2]}")
    return skipped


def save_combined(records: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """All records as one comma-separated table under folder; the summary and the most frequent legal suffixes."""
    from ..operators.records import feature_summary, suffix_top

    write_text_table(records, f"{folder}/all_sources_preprocessed")
    return feature_summary(records), suffix_top(records)
