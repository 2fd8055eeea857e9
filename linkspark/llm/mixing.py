"""Mixing sources to target weights by weighted fair queueing.

Sizes are runs without ASCII white space (null text: 0). Sources sort by code point, null last, and weigh 3, 1, 2 in
turn. They share `share` times all sizes by weight; a target stops at `most` times its source's size and the excess is
shared again. Documents of a source queue in the order of a hash of their id, once per pass; the virtual finish time of
an entry is the running size of its source divided by its target. Entries are taken in the order of finish times until
the next would exceed the total. Ties: source, then pass, then hash order. Reruns give the same result, as the hashes do
not depend on partitions. Empty tables give empty results; documents of size 0 are taken 0 words. Only the text, the key and
the source are read by the plan, and the mix hands all columns on, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, keyed_join, running_totals, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
UNITS = 1_000_000  # of a weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, rank, source_size, offset, n, target) from (source, size); one row per source throughout. offset: the sizes
    of the sources before it; n: its rows. No step gathers all sources in one task.

    With the sources in the order of cap / weight, the first k are capped and the rest share what is left by weight,
    for the least k at which the share of the next stays within its cap; for greater k the share would be lower."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = running_totals(per, [F.col("source").asc_nulls_last()], ["source_size"], "mix-sources")
    ranked = ranked.select("source", "n", "source_size", F.col("row_no").alias("rank"), (F.col("cum_source_size") - F.col("source_size")).alias("offset"))
    ranked = ranked.withColumn("w", cycle[(F.col("rank") % len(weights)).cast("int")]).withColumn("cap", F.col("source_size") * most)
    units = F.round(F.col("w") * UNITS).cast("bigint")
    by_ratio = running_totals(ranked.withColumn("units", units), [F.col("cap") / F.col("w"), F.col("rank")], ["cap", "units"], "mix-ratios")
    whole = by_ratio.agg(F.sum("source_size").alias("size"), F.sum("units").alias("units")).first()
    rest = F.lit((whole["size"] or 0) * share) - (F.col("cum_cap") - F.col("cap"))
    w_rest = (F.lit(whole["units"] or 0) - (F.col("cum_units") - F.col("units"))) / UNITS
    each = rest / w_rest
    level = by_ratio.agg(F.max(F.when(each * F.col("w") <= F.col("cap"), each))).first()[0]
    aim = F.col("cap").cast("double") if level is None else F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w"))
    return by_ratio.select("source", "rank", "source_size", "offset", "n", aim.alias("target"))


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row of docs: doc_id, text_key, size, source_size, target, copies, taken."""
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("text_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sized = store(sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    aims = store(targets(sized), "mix-targets")
    run = running_totals(sized, [F.col("source").asc_nulls_last(), F.col("turn"), F.col("doc_id"), F.col("text_key")], ["size"], "mix-queue")
    total = aims.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("size")).first()
    queue = keyed_join(run, aims, ["source"], "n", total["n"])
    queue = queue.withColumn("served", F.col("cum_size") - F.col("offset"))
    queue = store(queue.select("doc_id", "text_key", "size", "rank", "source_size", "target", "row_no", "served"), "mix-queued")
    discard(sized, aims, run)
    passes = queue.select("row_no", "size", "rank", "source_size", "target", "served", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("pass"))
    finish = (F.col("served") + F.col("pass") * F.col("source_size")) / F.col("target")
    entries = passes.where("size > 0").select("row_no", "size", finish.alias("finish"), "rank", "pass").withColumnRenamed("row_no", "entry")
    taken = running_totals(entries, [F.col("finish"), F.col("rank"), F.col("pass"), F.col("entry")], ["size"], "mix-entries")
    copies = taken.where(F.col("cum_size") <= F.lit(total["size"] * SHARE)).groupBy("entry").agg(F.count("*").alias("copies"))
    out = queue.join(copies, F.col("row_no") == F.col("entry"), "left")
    n = F.coalesce("copies", F.lit(0))
    return out.select("doc_id", "text_key", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    """The op4 contract."""
    return plan(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it. Rows that repeat id and text are taken equally often (their
    copies in the mix over their number, rounded up)."""
    took = plan(docs, text, key, source).groupBy("doc_id", "text_key").agg(F.ceil(F.sum("copies") / F.count("*")).cast("int").alias("_copies"))
    id_, text_, copy_ = fresh(docs, "_mix_id", "_mix_text", "_mix_copy")
    took = store(took.where("_copies > 0"), "mix-taken").select(F.col("doc_id").alias(id_), F.col("text_key").alias(text_), F.expr("explode(sequence(1, _copies))").alias(copy_))
    same = docs[key].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text]) == F.col(text_))
    return docs.join(took, same).select(*[docs[c] for c in docs.columns])
