"""Shared pieces: shared working folder, stored tables, distributed running totals, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to be a column of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a folder of this machine will do if the
    session runs in one process (tests), and only then."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="linkspark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


HOT = 1000  # a key of more than one in so many rows is hot, so there are fewer hot keys than that


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row per key (nulls are a key too) that has the number n of rows with it,
    `total` in all. Hot keys, fewer than HOT, are broadcast, so that their rows stay where they are; the others are shuffled.
    Both are read twice, so they should be stored. n goes."""
    hot = F.col(n) * HOT >= F.lit(total)
    names = [f"_key{k}" for k in range(len(keys))]
    told = table.select(*(F.col(k).alias(x) for k, x in zip(keys, names, strict=True)), *(c for c in table.columns if c not in keys))
    same = lambda: reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(x)) for k, x in zip(keys, names, strict=True)))
    few, many = told.where(hot).drop(n), told.where(~hot).drop(n)
    one = rows.join(F.broadcast(few), same()).drop(*names)
    two = rows.join(F.broadcast(few.select(*names)), same(), "left_anti").join(many, same()).drop(*names)
    return one.unionByName(two)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(column: str | Column, n: int, among: int) -> Column:
    """crc32 of the column as text, modulo n, equals among (false for null)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string")) % n == among, F.lit(False))


def running_totals(df: DataFrame, keys: list[Column], sums: list[str], name: str) -> DataFrame:
    """Add row_no (from 0) and cum_<s> (inclusive) for each of sums (non-negative longs, no nulls), in the order of keys.

    Rows are range-partitioned and each task totals its own run; only one row per partition is then gathered, to be
    summed into offsets, so no task sees more than its range. keys should tell rows apart, else a range can't be split.
    """
    spark = df.sparkSession
    fields = df.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += ", _pid int, _row bigint" + "".join(f", _cum_{s} bigint" for s in sums)

    def total(batches):
        pid, row, cum = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            cols = [*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.arange(row, row + n))]
            for s in sums:
                v = np.cumsum(b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)) + cum[s]
                cum[s] = int(v[-1]) if n else cum[s]
                cols.append(pa.array(v))
            row += n
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "_pid", "_row", *(f"_cum_{s}" for s in sums)])

    ranged = df.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    stored = store(ranged.mapInArrow(total, ddl), name)
    parts = stored.groupBy("_pid").agg(F.count("*").alias("_n"), *(F.max(f"_cum_{s}").alias(f"_t_{s}") for s in sums))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        *(F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums),
    )  # one row per partition: bounded by the number of partitions
    joined = stored.join(F.broadcast(parts), "_pid")
    out = joined.select(
        *(F.col(f"`{f.name}`") for f in fields), (F.col("_row") + F.col("_o")).alias("row_no"),
        *((F.col(f"_cum_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums),
    )
    out._stored_at = stored._stored_at  # so that discard() deletes it
    return out


def text_blocks(texts: list[str], limit: int):
    """Yield (first, last) so that texts[first:last] hold about limit characters at most, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, column: str, limit: int = 8_000_000):
    """Cut a batch into runs of rows of about limit bytes of the text column, one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    yield batch.slice(start, len(col) - start)
