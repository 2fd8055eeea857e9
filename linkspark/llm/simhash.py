"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures.

Words are runs without ASCII white space, A-Z lower-cased. Null and blank texts have fingerprint 0 and are linked like any
other; texts of fewer words than a shingle are one shingle. Rows with equal fingerprints form a class, and only classes
are linked, so copies and repeated rows cost one row each. Rows without doc_id are grouped but never name a group.
Empty tables give empty results. Only the text and the key are read; other columns may have any name.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, slices, store

SHINGLE, SEED = 4, 42
SHORT_KEYS = 1 << 24  # fingerprints; past this a key of some 20 bits is shared by many that are unlike


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; words are runs without ASCII white space, A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [xxhash.xxh64_intdigest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = sum(bits[i:i + 65536].sum(axis=0, dtype=np.int64) for i in range(0, len(bits), 65536))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


# Linking -----------------------------------------------------------------------------------------------------------

def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit when distance bits differ."""
    n = distance // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut(bits: list[int], parts: int) -> list[int]:
    """Masks of runs of near equal length of the bits."""
    edges = [round(len(bits) * k / parts) for k in range(parts + 1)]
    return [signed(sum(1 << b for b in bits[x:y])) for x, y in zip(edges, edges[1:])]


def links(prints: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """Pairs a < b of different values of prints.fp at `distance` or fewer differing bits, each once.

    Every fingerprint is indexed under 64 keys: a segment with one of its bits struck out. Two fingerprints whose
    segment differs in one bit meet under that bit; if the segment is equal, they meet under all of its bits. The pair
    is taken from one such key only: of the first segment that differs in one bit at most, its differing or lowest bit.

    With `blocks` = distance + 1 the bits outside the segment are cut into so many blocks, one of which is equal too, and
    each key is joined by one of them: `blocks` keys for one, of some nine more bits, and the pair is taken from its first
    equal block. Pairs are the same; fewer unlike ones meet. By default the fingerprints are counted, and the longer keys
    are taken where the others would be shared by too many.

    The join is a merge join by a hint: the planner takes the exploded keys for no larger than the fingerprints, and would
    send all of them through the driver to every executor."""
    if blocks is None:
        blocks = 1 if prints.count() <= SHORT_KEYS else distance + 1
    segs = segments(distance)
    masks = [sum(1 << (a + i) for i in range(w)) for a, w in segs]
    of_bit = [next(k for k, (a, w) in enumerate(segs) if a <= bit < a + w) for bit in range(64)]
    rest = [cut([b for b in range(64) if not m >> b & 1], blocks) if blocks > 1 else [0] for m in masks]
    kept = F.array(*[F.lit(signed(masks[of_bit[b]] & ~(1 << b)) | rest[of_bit[b]][k]) for b in range(64) for k in range(blocks)])
    keys = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64 * blocks - 1))).alias("slot")).select(
        "fp", "slot", F.col("fp").bitwiseAND(kept[F.col("slot")]).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    diff = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    parts = [diff.bitwiseAND(F.lit(signed(m))) for m in masks]
    first = F.lit(None).cast("bigint")
    for part, (low, _) in reversed(list(zip(parts, segs, strict=True))):
        n = F.bit_count(part)
        first = F.when(n == 0, F.lit(signed(1 << low))).when(n == 1, part).otherwise(first)
    slot = F.col("a.slot")
    bits = F.array(*[F.lit(signed(1 << i)) for i in range(64) for _ in range(blocks)])
    on = (slot == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(diff) <= distance) & (first == bits[slot])
    for k in range(blocks - 1):  # no earlier block may be equal
        earlier = F.array(*[F.lit(rest[of_bit[b]][k]) for b in range(64) for _ in range(blocks)])
        on &= (slot % blocks <= k) | (diff.bitwiseAND(earlier[slot]) != 0)
    return a.join(b.hint("merge"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of the edges (a, b) reaches, by alternating large and small stars.

    Each round is a table in the shared folder, deleted when the next is there; hubs meet only in partial minima and
    joins that can be split."""
    def least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        lows = store(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "simhash-min")
        return pairs.join(lows, "u"), lows

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = store(edges.select("a", "b").where("a != b"), "simhash-edges")
    before, after = None, mark(now)
    while after[0] and before != after:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        stars, lows = least(both)
        large = store(stars.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "simhash-large")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        stars, lower = least(down)
        small = stars.select(F.col("m").alias("a"), F.col("v").alias("b")).union(stars.select(F.col("m"), F.col("u")))
        last, now = now, store(small.where("a != b").distinct(), "simhash-small")
        discard(last, lows, large, lower)
        before, after = after, mark(now)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; null and blank texts get 0. Whole texts, in Arrow batches."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for big in batches:
            for b in slices(big, "text"):
                got = [signed(fingerprint(t, shingle)) for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (least doc_id of its group, itself included).

    Texts with one fingerprint form a class first; only classes are linked. Rows without doc_id are grouped too but
    never name a group (component_id is null where no row of the group has a doc_id)."""
    stored = store(fingerprints(docs, text, key), "simhash-docs")
    classes = store(stored.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes, distance))
    named = store(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = store(named.join(ids, "root").select("fp", "component_id"), "simhash-labels")
    discard(classes, named)
    return stored.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = 4) -> DataFrame:
    """docs with one document of each group, the one of least doc_id; rows without doc_id all stay. Of rows that repeat
    a kept doc_id one stays. The columns are those of docs."""
    found = store(groups(docs, text, key, distance), "simhash-groups")
    (gone,) = fresh(docs, "_gone")
    others = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    out = docs.join(others, docs[key] == F.col(gone), "left_anti")
    if found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    known = out.where(F.col(key).isNotNull()).dropDuplicates([key])
    return known.unionByName(out.where(F.col(key).isNull()))


def digest(docs: DataFrame) -> DataFrame:
    """The op6 contract: doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
