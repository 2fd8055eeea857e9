"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text, steered by shared random bits, stays on a character or moves on: texts at a small
edit distance fall into step again, so the walks' outputs differ at few steps. Long texts are walked in runs of RUN
characters, each a new walk. The fingerprint samples SAMPLES steps from each of the step ranges [0, 128), [128, 256),
[256, 512) and so on up to the text's own length, one hexadecimal digit of a hash of the character each ('.' past its
end). Likeness is the share of sampled steps that agree, each range weighted by its length.

Null counts as empty; an empty text has an empty fingerprint, and two empty ones have likeness 1. Characters are code
points, whole texts of any length are used. The order of documents is that of doc_id in its own type (any that Spark
sorts; null is the least), then of a hash of the text; repeated rows follow each other. An empty table gives an empty
result, a single row is its own next. Only the text and the key are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import shuffle_partitions, slices, store

RUN, PHASES, FIRST, SAMPLES = 16384, 256, 128, 64
SPAN = 2 * RUN + 2048  # steps counted of each run: a walk takes two a character on average, and 181 more or fewer by standard deviation
PROBES = 16  # rows looked at to set the bounds of a range of documents
BANDED, CROWD, LEADERS = 3, 64, 8  # ranges that are cut into bands; members of a band beyond which they meet its leaders only
BLOCK = 3_000_000  # characters walked at once
LOWEST = -(1 << 63)


def stays() -> np.ndarray:
    """Steps that a walk spends on a character of class c (its code modulo 256) if it reaches it at phase p: at c * 256 + p."""
    bits = np.random.default_rng(20240607).integers(0, 2, (256, PHASES))
    bits[:, -1] |= bits.sum(axis=1) == 0
    two = np.concatenate([bits, bits], axis=1)
    next_one = np.full((256, 2 * PHASES + 1), 4 * PHASES)
    for p in range(2 * PHASES - 1, -1, -1):
        next_one[:, p] = np.where(two[:, p] == 1, p, next_one[:, p + 1])
    return (next_one[:, :PHASES] - np.arange(PHASES) + 1).astype(np.int32).ravel()


STAYS = stays()
_steps: list[np.ndarray] = []


def sampled(ranges: int) -> np.ndarray:
    """The sampled steps of the first so many ranges."""
    while len(_steps) < ranges:
        k = len(_steps)
        low, high = (0, FIRST) if k == 0 else (FIRST << (k - 1), FIRST << k)
        cut = np.linspace(low, high, SAMPLES + 1).astype(np.int64)
        _steps.append(cut[:-1] + (np.random.default_rng(k).random(SAMPLES) * np.diff(cut)).astype(np.int64))
    return np.concatenate(_steps[:ranges]) if ranges else np.zeros(0, np.int64)


def n_ranges(chars: int) -> int:
    """Ranges up to the steps that nearly all walks over so many characters end by."""
    if not chars:
        return 0
    last = 2 * (chars % RUN)
    steps = chars // RUN * SPAN + min(SPAN, last + 3 * isqrt(last))
    return 1 + max(0, (steps - 1).bit_length() - FIRST.bit_length() + 1)


HEX = np.frombuffer(b"0123456789abcdef.", np.uint8)


def prints(texts: list[str]) -> list[str]:
    out: list[str] = []
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            out += walked(texts[start:i])
            start, size = i, 0
        size += len(t)
    return out + walked(texts[start:])


def walked(texts: list[str]) -> list[str]:
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return [""] * len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    classes = (codes & 255).astype(np.int32) << 8
    first_run = np.cumsum(-(-lengths // RUN)) - -(-lengths // RUN)
    text_at = np.cumsum(lengths) - lengths
    starts = np.concatenate([np.arange(a, a + n, RUN) for a, n in zip(text_at, lengths, strict=True)])
    ends = np.append(starts[1:], len(codes))
    order = np.argsort(starts - ends, kind="stable")  # long runs first, so that those still walking are a prefix
    at, sizes = starts[order].copy(), (ends - starts)[order]
    step, reached = np.zeros(len(at), np.int32), np.zeros(len(codes), np.int32)
    walking = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for n in walking.tolist():
        here, s = at[:n], step[:n]
        reached[here] = s
        s += STAYS.take(classes.take(here) | (s & (PHASES - 1)))
        here += 1
    final = np.zeros(len(at), np.int64)
    final[order] = step
    line = reached.astype(np.int64)
    wide = np.int64(1 << 32)
    line += np.repeat(np.arange(len(starts)) * wide, ends - starts)
    ranges = [n_ranges(n) for n in lengths.tolist()]
    steps = np.concatenate([sampled(k) for k in ranges])
    owner = np.repeat(np.arange(len(texts)), [k * SAMPLES for k in ranges])
    run = steps // SPAN
    within = steps - run * SPAN
    runs_of = -(-lengths // RUN)
    real = run < runs_of[owner]
    run = np.where(real, run + first_run[owner], 0)
    real &= within < final[run]
    char = np.searchsorted(line, run * wide + within, side="right") - 1
    mixed = codes[char].astype(np.uint32) * np.uint32(2654435761) ^ (steps & 0xFFFFFFFF).astype(np.uint32) * np.uint32(2246822519)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(3266489917)
    digits = HEX[np.where(real, mixed >> np.uint32(28), 16)].tobytes().decode()
    cuts = np.cumsum([0, *(k * SAMPLES for k in ranges)]).tolist()
    return [digits[a:b] for a, b in zip(cuts, cuts[1:])]


def likeness(a: str, b: str) -> float:
    """0 to 1; steps past the end of both count for neither."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode(), np.uint8).reshape(-1, SAMPLES) for s in (a, b))
    weight = np.array([FIRST, *(FIRST << k for k in range(len(x) - 1))], float)
    past = (x == 46) & (y == 46)
    counted = ((~past).sum(axis=1) * weight).sum()
    return float((((x == y) & ~past).sum(axis=1) * weight).sum() / counted) if counted else 1.0


def place(doc_id, tie: int) -> tuple:
    """Sorts like doc_id and tie do, null first."""
    return doc_id is not None, doc_id, tie


def bounds(rows: DataFrame, n: int) -> list[tuple]:
    """Places that cut rows (doc_id, tie) into up to n ranges of about as many rows each. They come from a sample of about
    PROBES rows a range, of ids only unless one id fills whole ranges; all rows are dealt by them."""
    ids = rows.select("doc_id")
    share = min(1.0, PROBES * n / max(1, ids.count()))
    probe = lambda df: df if share == 1 else df.sample(share, seed=5)
    seen = sorted(place(r[0], LOWEST) for r in probe(ids).collect())
    picked = [seen[len(seen) * k // n] for k in range(1, n)] if seen else []
    cuts = set(picked)
    if hot := {p[1] for p in cuts if picked.count(p) > 1}:
        known = [i for i in hot if i is not None]
        own = F.col("doc_id").isin(known) if known else F.lit(False)
        ties: dict = {}
        for r in probe(rows.where(own | F.col("doc_id").isNull() if None in hot else own).select("doc_id", "tie")).collect():
            ties.setdefault(r["doc_id"], []).append(r["tie"])
        for i, of in ties.items():
            of.sort()
            m = picked.count(place(i, LOWEST))
            cuts |= {place(i, of[len(of) * k // (m + 1)]) for k in range(1, m + 1)}
    return sorted(cuts)


def in_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of docs (doc_id, text, to, extra) dealt so that within a value of `to`, sorted by extra, then downwards by
    doc_id, each row but the extra one is followed by the next document; after the least doc_id comes the greatest.

    The first row of each range is dealt to the range above it as well."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    id_type = rows.schema["doc_id"].dataType
    cuts = bounds(rows.select("doc_id", "tie"), 8 * shuffle_partitions(spark))

    @F.arrow_udf(IntegerType())
    def range_of(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array([bisect_left(cuts, place(i, t)) for i, t in zip(doc_id.to_pylist(), tie.to_pylist(), strict=True)], pa.int32())

    def ranged(df):
        return df.withColumn("of", range_of("doc_id", "tie"))

    most = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head")
    heads = ranged(rows.select("doc_id", "tie")).groupBy("of").agg(most).select("of", "head.doc_id", "head.tie").collect()  # a row per range
    heads.sort(key=lambda r: r["of"])
    above = [(r["of"], r["doc_id"], r["tie"], heads[(i + 1) % len(heads)]["of"], True) for i, r in enumerate(heads)]
    fields = (("h_of", IntegerType()), ("h_id", id_type), ("h_tie", LongType()), ("up", IntegerType()), ("is_head", BooleanType()))
    above = spark.createDataFrame(above, StructType([StructField(*f) for f in fields]))
    same = (F.col("of") == F.col("h_of")) & F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))
    own = ranged(rows).join(F.broadcast(above), same, "left")
    once = F.struct(F.col("of").alias("to"), F.lit(False).alias("extra"))
    again = F.struct(F.col("up").alias("to"), F.lit(True).alias("extra"))
    dealt = own.select("doc_id", "text", "tie", F.explode(F.when(F.col("is_head"), F.array(once, again)).otherwise(F.array(once))).alias("d"))
    both = dealt.select("doc_id", "text", "tie", "d.to", "d.extra").repartition(shuffle_partitions(spark), "to")
    return both.sortWithinPartitions("to", "extra", F.col("doc_id").desc(), F.col("tie").desc())


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The op5 contract: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    dealt = in_pairs(docs, text, key)
    names = dealt.columns
    id_at, text_at, to_at, extra_at = (names.index(c) for c in ("doc_id", "text", "to", "extra"))
    fields = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        left: tuple | None = None  # the last row, whose next is not known yet
        for big in batches:
            id_type = big.schema.field("doc_id").type
            for b in slices(big, "text", 8_000_000):
                cols = [b.column(k).to_pylist() for k in (id_at, text_at, to_at, extra_at)]
                rows = ([left] if left else []) + [(i, t or "", to, x) for i, t, to, x in zip(*cols, strict=True)]
                left = rows[-1]
                pairs = [(p, q) for p, q in zip(rows, rows[1:]) if not p[3] and p[2] == q[2]]
                if not pairs:
                    continue
                plain = prints([r[1] for r in rows])
                at = [k for k, (p, q) in enumerate(zip(rows, rows[1:])) if not p[3] and p[2] == q[2]]
                edited = []
                for p, q in pairs:
                    cut = len(p[1]) // 3
                    edited.append(p[1][:len(p[1]) - cut] + q[1][:cut])
                changed = prints(edited)
                yield pa.RecordBatch.from_arrays([
                    pa.array([p[0] for p, _ in pairs], id_type), pa.array([len(p[1]) for p, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([plain[k] for k in at]), pa.array(changed),
                    pa.array([likeness(plain[k], c) for k, c in zip(at, changed, strict=True)]), pa.array([likeness(plain[k], plain[k + 1]) for k in at])], names=fields)

    return dealt.mapInArrow(run, f"doc_id {dealt.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(rows: DataFrame, threshold: float = 0.8, digits: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of rows (doc_id, fingerprint): pairs a < b of different fingerprints of likeness >= threshold
    that agree in a band of `digits` sampled steps of one of their BANDED last ranges, and members (doc_id, fingerprint).
    Equal fingerprints are one class; bands wholly past the end of a text are left out.

    Of a band with more than CROWD classes not all pairs are looked at: its members meet LEADERS of them, least by as many
    hashes, so a group of many near copies comes as links to its leaders instead of links between all."""
    classes = store(rows.select("fingerprint").where("fingerprint != ''").distinct(), "print-classes")
    n = F.length("fingerprint")
    at = F.explode(F.sequence(F.greatest(n - BANDED * SAMPLES, F.lit(0)), n - digits, F.lit(digits)))
    bands = classes.select("fingerprint", at.alias("at")).select("fingerprint", "at", F.substr("fingerprint", F.col("at") + 1, F.lit(digits)).alias("band"))
    bands = store(bands.where(F.col("band") != "." * digits), "print-bands")
    leaders = [F.min_by("fingerprint", F.xxhash64(F.lit(k), "fingerprint")) for k in range(LEADERS)]
    sizes = store(bands.groupBy("at", "band").agg(F.count("*").alias("n"), F.array_distinct(F.array(*leaders)).alias("leaders")).where("n > 1"), "print-sizes")
    few, many = sizes.where(f"n <= {CROWD}").select("at", "band"), sizes.where(f"n > {CROWD}")
    some = bands.join(few, ["at", "band"], "left_semi")
    a, b = some.alias("a"), some.alias("b")
    met = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.fingerprint") < F.col("b.fingerprint")))
    led = bands.join(many, ["at", "band"]).select("fingerprint", F.explode("leaders").alias("leader")).where("fingerprint != leader")

    @F.pandas_udf(DoubleType())
    def like(x, y):
        import pandas as pd

        return pd.Series([likeness(p, q) for p, q in zip(x, y, strict=True)])

    found = met.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")) \
        .union(led.select(F.least("fingerprint", "leader"), F.greatest("fingerprint", "leader"))).distinct()
    pairs = found.withColumn("likeness", like("a", "b")).where(F.col("likeness") >= threshold)
    return pairs, rows.select("doc_id", "fingerprint")
