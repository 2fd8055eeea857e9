"""Blocking rules, candidate pairs and their audit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_grams
from ..sources.shared import stored

CAP = 1000


@dataclass(frozen=True)
class BlockingRule:
    name: str
    keys: tuple[str, ...]
    explode: str | None = None


RULES = (
    BlockingRule("rare_name_token", ("name_tokens",), "name_tokens"),
    BlockingRule("name_country", ("name_tokens", "country"), "name_tokens"),
    BlockingRule("street_name_token", ("street_number", "name_tokens"), "name_tokens"),
    BlockingRule("domain_core", ("domain_core",)),
)
# Further rules, not among the four above: words of the address, postal code with a word of the city, runs of characters.
EXTRA_RULES = (
    BlockingRule("address_token", ("city_tokens",), "city_tokens"),
    BlockingRule("postal_city", ("postal_code", "city_tokens"), "city_tokens"),
    BlockingRule("name_gram", ("name_grams",), "name_grams"),
)


def with_grams(df: DataFrame, n: int = 4) -> DataFrame:
    """Adds name_grams, the runs of n characters of the name core."""
    return df.withColumn("name_grams", char_grams(F.col("name_core"), n))


def key_rows(df: DataFrame, rule: BlockingRule, compat_empty_token: bool = False, once: bool = False) -> DataFrame:
    """(entity_id, keys): rows without nulls in the keys, blank text keys counting as null, lists exploded.

    A token twice in one name gives two rows, or one with `once`. compat_empty_token turns an empty list into one blank
    token."""
    cols = [F.col("entity_id")]
    for k in rule.keys:
        c = F.col(k)
        if k == rule.explode:
            c = F.array_distinct(c) if once else c
            c = F.explode(F.when(F.size(c) == 0, F.array(F.lit(""))).otherwise(c) if compat_empty_token else c)
        elif dict(df.dtypes)[k] == "string" and k != "country":
            c = F.when(c != "", c)
        cols.append(c.alias(k))
    out = df.select(*cols).dropna(subset=list(rule.keys))
    return out if compat_empty_token or not rule.explode else out.where(F.col(rule.explode) != "")


def key_counts(rows: DataFrame, rule: BlockingRule) -> DataFrame:
    return rows.groupBy(*rule.keys).agg(F.count("*").alias("key_count"))


def valid_keys(rows: DataFrame, rule: BlockingRule, cap: int = CAP) -> DataFrame:
    return key_counts(rows, rule).where(F.col("key_count") <= cap)


def candidates(s1: DataFrame, s2: DataFrame, rule: BlockingRule, cap: int = CAP, compat_empty_token: bool = False) -> DataFrame:
    """Distinct (S1_id, S2_id) that share a key with at most cap rows in s2.

    Key counts are combined before they are shuffled. Frequent keys go before the join (a semi join on the other side), so
    no key fans out to more than cap rows of s2. Both sides are read twice: store those that are costly to compute."""
    keys = list(rule.keys)
    left = key_rows(s1, rule, compat_empty_token, once=True)
    right = key_rows(s2, rule, compat_empty_token, once=True)
    wanted = valid_keys(key_rows(s2, rule, compat_empty_token), rule, cap).select(*keys).join(left.select(*keys).distinct(), keys, "left_semi")
    pruned = right.join(wanted, keys, "left_semi")
    return left.withColumnRenamed("entity_id", "S1_id").join(pruned.withColumnRenamed("entity_id", "S2_id"), keys).select("S1_id", "S2_id").distinct()


def true_pairs(df: DataFrame) -> DataFrame:
    """Ground truth by position: the first two columns are S1_id and S2_id; no nulls, no repeats."""
    if len(df.columns) < 2:
        raise ValueError("Ground truth must have at least two columns")
    a, b = df.columns[:2]
    return df.select(F.col(a).alias("S1_id"), F.col(b).alias("S2_id")).dropna().distinct()


def union_candidates(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found).distinct()


def recall(caught: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(caught / total)


def metrics(tagged: DataFrame, truth: DataFrame) -> DataFrame:
    """RULE, CANDIDATES, TRUE_PAIRS_CAUGHT, RECALL from (RULE, S1_id, S2_id) without repeats."""
    marked = tagged.join(truth.withColumn("_true", F.lit(1)), ["S1_id", "S2_id"], "left")
    total = truth.agg(F.count("*").alias("_total"))
    out = marked.groupBy("RULE").agg(F.count("*").alias("CANDIDATES"), F.count("_true").alias("TRUE_PAIRS_CAUGHT"))
    return out.join(F.broadcast(total)).select(  # total: one row
        "RULE", "CANDIDATES", "TRUE_PAIRS_CAUGHT", recall(F.col("TRUE_PAIRS_CAUGHT"), F.col("_total")).alias("RECALL"))


def needed(df: DataFrame, rules: Sequence[BlockingRule]) -> DataFrame:
    """The columns of df that the rules read; rules of columns that aren't there are left to fail on their own."""
    keys = dict.fromkeys(k for r in rules for k in r.keys if k in df.columns)
    return df.select("entity_id", *(k for k in keys if k != "entity_id"))


def rule_bits(s1: DataFrame, s2: DataFrame, rules: Sequence[BlockingRule], cap: int = CAP, on_error: str = "raise", compat_empty_token: bool = False) -> tuple[DataFrame | None, list[str]]:
    """(S1_id, S2_id, bits) of the candidates of all rules, once each, and the names of the rules by bit. Both sides are
    stored once, and so are the candidates of each rule; with on_error="skip" rules that fail are left out."""
    s1, s2 = stored(needed(s1, rules), "blocking-s1"), stored(needed(s2, rules), "blocking-s2")
    names: list[str] = []
    found: list[DataFrame] = []
    for rule in rules:
        try:
            pairs = stored(candidates(s1, s2, rule, cap, compat_empty_token), f"candidates-{rule.name}")
        except (PySparkException, Py4JJavaError, KeyError):
            if on_error != "skip":
                raise
            continue
        found.append(pairs.withColumn("bit", F.lit(1 << len(names)).cast("bigint")))
        names.append(rule.name)
    return (reduce(DataFrame.unionByName, found).groupBy("S1_id", "S2_id").agg(F.bit_or("bit").alias("bits")) if found else None), names


def audit(s1: DataFrame, s2: DataFrame, truth: DataFrame, rules: Sequence[BlockingRule] = RULES, cap: int = CAP, on_error: str = "raise", compat_empty_token: bool = False) -> DataFrame:
    """One row per rule and one for UNION_ALL; with on_error="skip" rules that can't be analysed are left out. A rule
    without candidates has a row of zeros; no rule, no rows. All rules are counted in one pass over the tagged pairs."""
    spark = s1.sparkSession
    bits, names = rule_bits(s1, s2, rules, cap, on_error, compat_empty_token)
    if bits is None:
        return spark.createDataFrame([], "RULE string, CANDIDATES bigint, TRUE_PAIRS_CAUGHT bigint, RECALL double")
    truth = truth.withColumn("_true", F.lit(1))
    marked = bits.join(truth, ["S1_id", "S2_id"], "full").select("bits", "_true")
    of = [*((k, F.col("bits").bitwiseAND(F.lit(1 << i)) != 0) for i, k in enumerate(names)), ("UNION_ALL", F.col("bits").isNotNull())]
    counted = marked.agg(F.count("_true").alias("_total"), *(x for i, (_, has) in enumerate(of) for x in (F.count_if(has).alias(f"n{i}"), F.count_if(has & F.col("_true").isNotNull()).alias(f"t{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("RULE"), F.col(f"n{i}").alias("CANDIDATES"), F.col(f"t{i}").alias("TRUE_PAIRS_CAUGHT")) for i, (k, _) in enumerate(of))))
    return counted.select("_total", rows.alias("r")).select("r.*", recall(F.col("r.TRUE_PAIRS_CAUGHT"), F.col("_total")).alias("RECALL"))
