"""Extensions past blocking: pair features, a matcher, scoring of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

FLAGS = ("postal_code", "state_code", "street_number", "unit_number", "legal_suffix", "domain_core")
FEATURES = ("name_edit", "name_jaccard", "city_jaccard", *(f"same_{c}" for c in FLAGS))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def pair_features(pairs: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """S1_id, S2_id and FEATURES of each pair; a flag is 1 where both sides agree on a filled value."""
    need = ("name_core", "name_tokens", "city_tokens", *FLAGS)
    a = s1.select(F.col("entity_id").alias("S1_id"), F.struct(*dict.fromkeys(need)).alias("a"))
    b = s2.select(F.col("entity_id").alias("S2_id"), F.struct(*dict.fromkeys(need)).alias("b"))
    both = pairs.join(a, "S1_id").join(b, "S2_id")
    same = lambda c: ((F.col(f"a.{c}") == F.col(f"b.{c}")) & (F.col(f"a.{c}") != "")).cast("double").alias(f"same_{c}")
    return both.select(
        "S1_id", "S2_id", edit_similarity(F.col("a.name_core"), F.col("b.name_core")).alias("name_edit"),
        jaccard(F.col("a.name_tokens"), F.col("b.name_tokens")).alias("name_jaccard"), jaccard(F.col("a.city_tokens"), F.col("b.city_tokens")).alias("city_jaccard"), *map(same, FLAGS))


def tfidf_cosine(pairs: DataFrame, s1: DataFrame, s2: DataFrame) -> DataFrame:
    """S1_id, S2_id, cosine of the TF-IDF vectors of the name tokens (document frequencies over both sides), with
    idf = log((records + 1) / (records with the token + 1)). Tokens are joined as rows; 0 where none is shared."""
    names = s1.select(F.lit(1).alias("side"), "entity_id", "name_tokens").union(s2.select(F.lit(2), "entity_id", "name_tokens"))
    counts = names.select("side", "entity_id", F.explode("name_tokens").alias("token")).groupBy("side", "entity_id", "token").agg(F.count("*").alias("tf"))
    total = names.count()
    idf = counts.groupBy("token").agg(F.log(F.lit(total + 1.0) / (F.count("*") + 1)).alias("idf"))
    weights = stored(counts.join(idf, "token").select("side", "entity_id", "token", (F.col("tf") * F.col("idf")).alias("w")), "tfidf-weights")
    norms = weights.groupBy("side", "entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    of = lambda df, side, name: df.where(F.col("side") == side).drop("side").withColumnRenamed("entity_id", name)
    a, b = of(weights, 1, "S1_id"), of(weights, 2, "S2_id").withColumnRenamed("w", "v")
    dots = pairs.join(a, "S1_id").join(b, ["S2_id", "token"]).groupBy("S1_id", "S2_id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    both = dots.join(of(norms, 1, "S1_id"), "S1_id").join(of(norms, 2, "S2_id").withColumnRenamed("norm", "other"), "S2_id")
    cosine = both.select("S1_id", "S2_id", F.try_divide("dot", F.col("norm") * F.col("other")).alias("cosine"))
    return pairs.select("S1_id", "S2_id").join(cosine, ["S1_id", "S2_id"], "left").fillna(0.0, ["cosine"])


def train(features: DataFrame, truth: DataFrame, kind: str = "logistic"):
    """A fitted pipeline model on labelled pairs: kind is "logistic" or "trees" (gradient-boosted)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    labelled = features.join(truth.withColumn("label", F.lit(1.0)), ["S1_id", "S2_id"], "left").fillna(0.0, ["label"])
    model = LogisticRegression(maxIter=50) if kind == "logistic" else GBTClassifier(maxIter=20, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model]).fit(labelled)


def scored(features: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).select("S1_id", "S2_id", vector_to_array("probability")[1].alias("score"))


def f_half(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def threshold_sweep(scores: DataFrame, truth: DataFrame, steps: int = 1000) -> DataFrame:
    """threshold, n_pairs, precision, recall, f_half for pairs with a score at or above each multiple of 1 / steps."""
    marked = scores.join(truth.withColumn("_t", F.lit(1)), ["S1_id", "S2_id"], "left")
    bins = marked.groupBy(F.floor(F.col("score") * steps).alias("bin")).agg(F.count("*").alias("n"), F.count("_t").alias("hit"))
    down = Window.orderBy(F.desc("bin"))  # at most steps + 1 rows
    run = bins.select((F.col("bin") / steps).alias("threshold"), F.sum("n").over(down).alias("n_pairs"), F.sum("hit").over(down).alias("hits"))
    total = truth.count()
    p, r = F.col("hits") / F.col("n_pairs"), (F.col("hits") / total if total else F.lit(0.0))
    return run.select("threshold", "n_pairs", p.alias("precision"), r.alias("recall"), f_half(p, r).alias("f_half"))


def check_subset(matches: DataFrame, pairs: DataFrame) -> None:
    """Matches must be candidate pairs."""
    if not matches.join(pairs, ["S1_id", "S2_id"], "left_anti").isEmpty():
        raise ValueError("Some matches are not candidate pairs")


def write_submission(matches: DataFrame, pairs: DataFrame, folder: str) -> None:
    check_subset(matches, pairs)
    for df, name in ((matches, "matching_results.tsv"), (pairs, "candidate_pairs.tsv")):
        df.select("S1_id", "S2_id").write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{folder}/{name}")
