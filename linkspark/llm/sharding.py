"""Sharding along a Hilbert curve over language, source and size.

Law `bytes`: the curve order is cut into shards of near equal bytes (text bytes plus one per row). Languages and sources
are each spread evenly over the steps of their dimension, so the fewer values one has, the further they stand apart: a
filter on language meets the fewest shards (most hold one or two), one on source or size some of them.

Rows with equal texts take the least language and source of their group, so they stand together. Each row counts as
standing nearer to the middle of its group by up to 1/PULL of a shard: smaller groups go into one shard as a whole, of larger
ones what a cut would take off the ends. Null and empty texts are one group of size 1 rows. Null languages and sources
come last. Repeated rows are each placed; reruns agree. Empty tables give empty results; only the text, the key, lang and
source are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_join, running_totals, store

BITS = 5  # per dimension
PULL = 20  # rows are pulled to the middle of their group by up to 1/PULL of a shard


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each column of axes (dimensions x points, below 2**bits) on the Hilbert curve.

    The corner of the cube is tracked by Gray code: each level of bits is turned by what the levels above it chose, then
    the bits of all dimensions are read off in turn and the Gray code is undone by a running exclusive or."""
    x = axes.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= swap
    gray = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            gray = gray << 1 | (x[d] >> level & 1)
    # reading bits in turn gives the curve's Gray code; its running parity is the index
    index, shift = gray, 1
    while shift < dims * bits:
        index = index ^ (index >> shift)
        shift *= 2
    return index


def ranked(values: DataFrame, column: str, bits: int) -> DataFrame:
    """(column, column_q): the different values in order, spread evenly over 2**bits steps."""
    kinds = running_totals(values.groupBy(column).agg(F.count("*").alias("n")), [F.col(column).asc_nulls_last()], [], f"shard-{column}")
    return kinds.select(column, "n", F.floor(F.col("row_no") * (1 << bits) / max(1, kinds.count())).cast("int").alias(f"{column}_q"))


def curve(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, text_key, curve (its place on the curve), group_size and group_start (bytes)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = store(rows, "shard-rows")
    kinds = rows.groupBy("text_key", "size").agg(
        F.min("lang").alias("lang"), F.min("source").alias("source"), F.sum("size").alias("group_size"), F.count("*").alias("n_rows"))
    kinds = first = store(kinds, "shard-kinds")
    n_kinds = kinds.count()
    for name in ("lang", "source"):  # counted among the groups, which are what is joined
        kinds = keyed_join(kinds, store(ranked(kinds, name, bits), f"shard-{name}"), [name], "n", n_kinds)
    steps = F.least(F.floor(F.log2(F.col("size")) * 1.5), F.lit((1 << bits) - 1)).cast("int")
    kinds = kinds.select("text_key", "size", "group_size", "n_rows", "lang_q", "source_q", steps.alias("size_q"))

    def place(batches):
        for b in batches:
            axes = np.stack([b.column(k).to_numpy() for k in (4, 5, 6)])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(hilbert_index(axes, bits))], names=["text_key", "size", "group_size", "n_rows", "curve"])

    placed = kinds.mapInArrow(place, "text_key bigint, size bigint, group_size bigint, n_rows bigint, curve bigint")
    ordered = running_totals(placed, [F.col("curve"), F.col("size"), F.col("text_key")], ["group_size"], "shard-groups")
    starts = store(ordered.select("text_key", "size", "group_size", "n_rows", "curve", (F.col("cum_group_size") - F.col("group_size")).alias("group_start")), "shard-starts")
    discard(first, ordered)
    total = starts.agg(F.sum("n_rows")).first()[0] or 0
    return keyed_join(rows.select("doc_id", "size", "text_crc32", "text_key"), starts, ["text_key", "size"], "n_rows", total)


def assign(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, curve, shard, slot."""
    rows = curve(docs, text, key, bits)
    order = [F.col("curve"), F.col("size"), F.col("text_key"), F.xxhash64("doc_id"), F.col("doc_id")]
    run = running_totals(rows, order, ["size"], "shard-order")
    total = run.agg(F.sum("size")).first()[0] or 1
    own, middle, most = F.col("cum_size") - F.col("size") / 2, F.col("group_start") + F.col("group_size") / 2, F.lit(total / shards / PULL)
    place = own + F.greatest(-most, F.least(most, middle - own))  # never out of order: the pull grows no faster than the distance
    cut = store(run.withColumn("shard", F.least(F.floor(place * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int")), "shard-cut")
    discard(run)
    first = cut.groupBy("shard").agg(F.min("row_no").alias("first"))  # one row per shard
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("row_no") - F.col("first")).alias("slot"))


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The op7 contract."""
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """docs as Parquet under path, one folder per shard, in curve order within it. doc ids must be unique and not null."""
    own = docs.join(assign(docs, shards, key=key).select(F.col("doc_id").alias("_id"), "shard", "slot"), F.col(key) == F.col("_id")).drop("_id")
    own.repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
