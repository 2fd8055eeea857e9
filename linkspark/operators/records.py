"""Record preprocessing: representations, features, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import address, name
from ..functions.address import address_features, city_text
from ..functions.country import encode_country
from ..functions.name import name_features
from ..functions.text import blank, has_nonlatin, norm_text, parse_list
from ..functions.translit import transliterated

REQUIRED = ("entity_id", "business_name", "business_address")
NAME_ORDER, ADDRESS_ORDER = name.FIELDS, address.FIELDS
LISTS = ("name_tokens", "name_numbers", "address_numbers", "city_tokens")


@dataclass(frozen=True)
class PreprocessingConfig:
    normalize_text: bool = True
    preserve_original: bool = True
    extract_address_components: bool = True


def check_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def record_features(df: DataFrame, config: PreprocessingConfig = PreprocessingConfig()) -> DataFrame:
    """The plain record: input columns (all, or the four base ones) and name and address features."""
    for c in (*REQUIRED, "country"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    base = df if config.preserve_original else df.select(*REQUIRED, "country")
    kept = base.columns
    raw_name, raw_address = F.col("business_name"), F.col("business_address")
    ready = base.select("*", norm_text(raw_name).alias("_n"), norm_text(raw_address).alias("_a"), city_text(raw_address).alias("_c"))
    named = name_features(raw_name, F.col("_n"))
    placed = address_features(raw_address, F.col("_a"), F.col("_c"))
    if not config.extract_address_components:
        placed |= {k: F.array().cast("array<string>") if k in ("address_numbers", "city_tokens") else F.lit("") for k in placed if k != "address_clean"}
    if not config.normalize_text:
        placed["address_clean"] = raw_address
    return ready.select(*kept, *(named[k].alias(k) for k in NAME_ORDER), *(placed[k].alias(k) for k in ADDRESS_ORDER))


def represented(df: DataFrame) -> DataFrame:
    """Adds script flags and transliterations, and codes the country."""
    check_columns(df)
    out = df.select(
        "*", has_nonlatin(F.col("business_name")).alias("name_has_nonlatin"), has_nonlatin(F.col("business_address")).alias("address_has_nonlatin"),
        transliterated(F.col("business_name")).alias("business_name_translit"), transliterated(F.col("business_address")).alias("business_address_translit"))
    return out.withColumn("country", encode_country(F.col("country"))) if "country" in df.columns else out


def uses_translit(flag: str, translit: str) -> Column:
    return (F.col(flag) == 1) & (F.trim(F.col(translit)) != "")


def preprocess(df: DataFrame) -> DataFrame:
    """The wide record: representations, features of the selected text, of the native text, of the transliteration.

    Where no transliteration is used its text features are '', its name lists null and its address lists empty."""
    base = represented(df)
    kept = base.columns
    by_name, by_address = uses_translit("name_has_nonlatin", "business_name_translit"), uses_translit("address_has_nonlatin", "business_address_translit")
    base = base.select("*", by_name.alias("_tn"), by_address.alias("_ta")).select(
        "*", F.when(F.col("_tn"), F.col("business_name_translit")).otherwise(blank(F.col("business_name"))).alias("_name"),
        F.when(F.col("_ta"), F.col("business_address_translit")).otherwise(blank(F.col("business_address"))).alias("_address"))
    ready = base.select(
        "*", norm_text(F.col("_name")).alias("_n"), norm_text(F.col("business_name")).alias("_n0"), norm_text(F.col("_address")).alias("_a"),
        norm_text(F.col("business_address")).alias("_a0"), city_text(F.col("_address")).alias("_c"), city_text(F.col("business_address")).alias("_c0"))
    main = name_features(F.col("_name"), F.col("_n")) | address_features(F.col("_address"), F.col("_a"), F.col("_c"))
    native = name_features(F.col("business_name"), F.col("_n0")) | address_features(F.col("business_address"), F.col("_a0"), F.col("_c0"))
    first = ready.select(*kept, "_tn", "_ta", *(main[k].alias(k) for k in (*NAME_ORDER, *ADDRESS_ORDER)), *(native[k].alias(f"{k}_native") for k in (*name.VARIANT_FIELDS, *address.FIELDS)))

    def variant(k: str) -> Column:
        on = F.col("_tn") if k in name.FIELDS else F.col("_ta")
        none = F.lit(None) if k in ("name_tokens", "name_numbers") else F.array().cast("array<string>") if k in ("address_numbers", "city_tokens") else F.lit("")
        return F.when(on, F.col(k)).otherwise(none).alias(f"{k}_translit")

    wide = [c for c in first.columns if c not in ("_tn", "_ta")]
    return first.select(*wide, *map(variant, (*name.VARIANT_FIELDS, *address.FIELDS)))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources one under another, with their name in `source`."""
    frames = [df.withColumn("source", F.lit(k)) for k, df in sources.items()]
    if not frames:
        raise ValueError("No sources to combine")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sample_rows(df: DataFrame, n: int, key: str = "entity_id") -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)


def head_rows(df: DataFrame, columns: tuple[str, ...] = ("name_clean", "legal_suffix", "domain"), n: int = 3, key: str = "entity_id") -> DataFrame:
    """Some columns of the first n rows by key, to look at."""
    return sample_rows(df, n, key).select(*columns)


def parse_lists(df: DataFrame) -> DataFrame:
    """Lists that a text format has written out, as lists again; columns that are lists stay."""
    kinds = dict(df.dtypes)
    named = [c for c in df.columns if c.removesuffix("_native").removesuffix("_translit") in LISTS and kinds[c] == "string"]
    return df.select(*(parse_list(F.col(c)).alias(c) if c in named else F.col(c) for c in df.columns))


def preprocess_all(sources: dict[str, DataFrame], config: PreprocessingConfig = PreprocessingConfig()) -> DataFrame:
    """The plain records of all sources, with their name in `source`."""
    return union_sources({k: record_features(df, config) for k, df in sources.items()})


def source_stats(df: DataFrame, by: str = "source") -> DataFrame:
    """Rows, non-Latin names and addresses, and changed transliterations per source."""
    changed = lambda c: F.sum((F.col(f"{c}_translit") != blank(F.col(c))).cast("int")).cast("bigint")
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.sum("name_has_nonlatin").cast("bigint").alias("nonlatin_names"), F.sum("address_has_nonlatin").cast("bigint").alias("nonlatin_addresses"),
        changed("business_name").alias("names_transliterated"), changed("business_address").alias("addresses_transliterated"))


def stats_total(stats: DataFrame, by: str = "source") -> DataFrame:
    return stats.agg(*(F.sum(c).cast("bigint").alias(c) for c in stats.columns if c != by))


def suffix_top(df: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent legal suffixes; '' counts, null doesn't; ties by name."""
    return df.where("legal_suffix IS NOT NULL").groupBy("legal_suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "legal_suffix").limit(n)


def feature_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.count("domain").alias("domains"), F.count_if(F.col("domain") != "").alias("domains_filled"),
        F.sum("has_fka").cast("bigint").alias("fka"), F.sum("has_dba").cast("bigint").alias("dba"), F.sum("has_aka").cast("bigint").alias("aka"))


def evaluate_distinct(df: DataFrame, column: str, out: str, expression) -> DataFrame:
    """Evaluate a costly Column function once per different value and join the result back; null stays null."""
    values = df.select(F.col(column).alias("_v")).where("_v IS NOT NULL").distinct()
    return df.join(values.select("_v", expression(F.col("_v")).alias(out)), F.col(column) == F.col("_v"), "left").drop("_v")
