"""Business records and blocking inputs from the test tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread

FORMS = ("Inc", "LLC", "Co", "Ltd.", "Corp", "Pvt. Limited", "Clinic", "O.D.")
REGIONS = ("CA", "NY", "TX", "KA", "IL", "WA")
LANDS = ("India", "US", "usa", "France", "Atlantis", None)
# Indic words and their transliterations, for records in Indic scripts.
INDIC = ("नगर", "निगम", "राम", "श्री", "ગુજરાત", "দিল্লি", "அமுதா", "ABC नगर निगम", "नગ")
LATIN = ("nagara", "nigama", "rama", "shri", "gujarata", "dilli", "amuta", "ABC nagara nigama", "naga")


def _pick(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, F.concat(F.lit("shop"), k, F.lit(".example.com"))).otherwise(F.concat("c_name", F.lit(" "), _pick(FORMS, k % 8)))
    address = F.concat((k % 997 + 1), F.lit(" Main St, Unit "), (k % 37 + 1), F.lit(", Springfield, "), _pick(REGIONS, k % 6), F.lit(" "), F.lpad((10000 + k % 80000).cast("string"), 5, "0"))
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("S1_"), k).alias("entity_id"), name.alias("business_name"), address.alias("business_address"), _pick(LANDS, k % 6).alias("country"), k.alias("k"))


def copies(spark: SparkSession, sf_dir: str, source: str = "S2", shift: int = 0) -> DataFrame:
    """(k + shift) % 4 noisy copies of each S1 record."""
    n = (F.col("k") + shift) % 4
    rows = s1(spark, sf_dir).where(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    name = F.when(F.col("i") == 1, F.upper("business_name")).when(F.col("i") == 2, F.concat("business_name", F.lit(" d/b/a X"))).otherwise(F.col("business_name"))
    address = F.when(F.col("k") % 30 == 0, "").otherwise(F.col("business_address")) if source == "S3" else F.col("business_address")
    return rows.select(F.concat(F.lit(f"{source}_"), "k", F.lit("_"), "i").alias("entity_id"), name.alias("business_name"), address.alias("business_address"), "country", "k")


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir)


def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir, "S3", 2)


def indic(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """S1 with an Indic word in every third name and every fifth address (counted from k + shift)."""
    k = F.col("k") + shift
    name = F.when(k % 3 == 0, F.concat(_pick(INDIC, k % len(INDIC)), F.lit(" "), _pick(FORMS, k % 8))).otherwise(F.col("business_name"))
    parts = (k % 997 + 1, F.lit(" "), _pick(INDIC, (k + 4) % len(INDIC)), F.lit(" Road, Springfield, "), _pick(REGIONS, k % 6), F.lit(" 10101"))
    address = F.when(k % 5 == 0, F.concat(*parts)).otherwise(F.col("business_address"))
    return s1(spark, sf_dir).select("entity_id", name.alias("business_name"), address.alias("business_address"), "country", "k")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s2(spark, sf_dir).select(F.concat(F.lit("S1_"), "k").alias("S1_id"), F.col("entity_id").alias("S2_id"))


def bench_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """benchmark as S1 and documents as S2: entity_id, business_name, country."""
    a = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("entity_id"), F.col("text").alias("business_name"), F.lit(None).cast("string").alias("country"))
    b = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), F.col("text").alias("business_name"), F.col("lang").alias("country"))
    return a, b


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


SQL_S1 = f"""s1 AS (
    SELECT 'S1_' || c_custkey AS entity_id,
        CASE WHEN c_custkey % 11 = 0 THEN 'shop' || c_custkey || '.example.com' ELSE c_name || ' ' || ({_list(FORMS)})[c_custkey % 8 + 1] END AS business_name,
        (c_custkey % 997 + 1) || ' Main St, Unit ' || (c_custkey % 37 + 1) || ', Springfield, ' || ({_list(REGIONS)})[c_custkey % 6 + 1] || ' ' || lpad(CAST(10000 + c_custkey % 80000 AS VARCHAR), 5, '0') AS business_address,
        ({_list(LANDS)})[c_custkey % 6 + 1] AS country, c_custkey AS k FROM customer)"""


def _sql_copies(source: str, shift: int) -> str:
    address = "CASE WHEN k % 30 = 0 THEN '' ELSE business_address END" if source == "S3" else "business_address"
    return f"""{source.lower()} AS (
    SELECT '{source}_' || k || '_' || i AS entity_id, CASE WHEN i = 1 THEN upper(business_name) WHEN i = 2 THEN business_name || ' d/b/a X' ELSE business_name END AS business_name,
        {address} AS business_address, country, k FROM s1, (VALUES (0), (1), (2)) AS c(i) WHERE i < (k + {shift}) % 4)"""


def sql_indic(name: str, shift: int) -> str:
    """A view like indic(), with the transliterated texts beside the native ones."""
    def said(words):
        return (
            f"CASE WHEN (k + {shift}) % 3 = 0 THEN ({_list(words)})[(k + {shift}) % {len(INDIC)} + 1] || ' ' || ({_list(FORMS)})[(k + {shift}) % 8 + 1] ELSE business_name END",
            f"CASE WHEN (k + {shift}) % 5 = 0 THEN ((k + {shift}) % 997 + 1) || ' ' || ({_list(words)})[(k + {shift + 4}) % {len(INDIC)} + 1] || ' Road, Springfield, ' || ({_list(REGIONS)})[(k + {shift}) % 6 + 1] || ' 10101' ELSE business_address END")

    (n, a), (tn, ta) = said(INDIC), said(LATIN)
    return f"""{name} AS (
    SELECT entity_id, {n} AS business_name, {a} AS business_address, country, CAST((k + {shift}) % 3 = 0 AS INT) AS name_has_nonlatin, CAST((k + {shift}) % 5 = 0 AS INT) AS address_has_nonlatin,
        {tn} AS business_name_translit, {ta} AS business_address_translit FROM s1)"""


SQL_S2, SQL_S3 = _sql_copies("S2", 0), _sql_copies("S3", 2)
SQL_TRUTH = "truth AS (SELECT 'S1_' || k AS S1_id, entity_id AS S2_id FROM s2)"
