"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A window is `width` consecutive words of an item;
an item of fewer words, but not none, is one window. The index stores postings (term, document, position) with a few
words of context. A window is looked up by its rarest term; the posting list is intersected, shifted by their offsets,
with that of its second rarest term, and what is left is compared word by word.

Null and blank texts have no words. Items without words have no window; null item ids are left out of the id list
but their windows count as hits. Repeated rows are each reported. Empty tables give empty results or no hits. Documents are
told apart by their id and a hash of id and text together. Only keys and texts are read; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, store

WIDTH = 13
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words, before A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_TERMS = 200_000  # more query terms than this are joined by a shuffle


def raw_words(text: str | Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows(items: DataFrame, text: str = "text", key: str = "item_id", width: int = WIDTH) -> DataFrame:
    """(item_id, window_id, words): window_id tells windows of different words apart."""
    rows = items.select(F.col(key).alias("item_id"), raw_words(lowered(F.col(text))).alias("w")).where("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))))
    return rows.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s") + 1, width).alias("words")) \
        .select("item_id", "words", F.sha2(F.concat_ws(" ", "words"), 256).alias("window_id"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has been counted to be small."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def doc_key(text: str | Column, key: str | Column) -> Column:
    text, key = (F.col(c) if isinstance(c, str) else c for c in (text, key))
    return F.struct(key.alias("id"), F.xxhash64(key, text).alias("hash"))


def token_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per document with its row key (doc_id and text may repeat), words as written and their number."""
    return docs.select(F.col(key).alias("doc_id"), raw_words(text).alias("w"), doc_key(text, key).alias("doc_key"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, n): how often each of terms stands in docs, case folded; terms that don't occur have n = 0."""
    words = docs.select(F.explode(raw_words(text)).alias("word")).select(F.lower("word").alias("folded"))
    folded = small(terms.select(F.lower("term").alias("folded")).distinct(), n_terms)
    seen = words.join(folded, "folded").groupBy("folded").agg(F.count("*").alias("n"))
    return terms.join(seen, F.lower("term") == F.col("folded"), "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 0, text: str = "text", key: str = "doc_id", context: int = WIDTH) -> DataFrame:
    """Store the postings of docs, of all terms or of `terms` only, and one row of the length of each document.

    term (null for the length row), doc_key, doc_id, pos, n_words, context (the words from pos - context + 1 to
    pos + context - 1, lower-cased) and context_at (the place of pos within it, from 0). term is lower-cased A-Z only.
    """
    rows = token_rows(docs, text, key).withColumn("n_words", F.size("w"))
    each = rows.select("doc_id", "doc_key", "n_words", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    if terms is not None:
        folded = terms.select(F.lower("term").alias("folded")).union(docs.sparkSession.createDataFrame([("",)], "folded string")).distinct()
        each = each.join(small(folded, n_terms), F.lower("word") == F.col("folded"))
    pos = F.col("at") - 1
    low = F.greatest(pos - (context - 1), F.lit(0))
    own = F.slice("w", low + 1, F.least(pos + context, F.col("n_words")) - low)
    held = F.col("at") > 0
    out = each.select(
        F.when(held, lowered(F.col("word"))).alias("term"), "doc_key", "doc_id", F.when(held, pos).alias("pos"), "n_words",
        F.when(held, F.split(lowered(F.array_join(own, " ")), " ")).alias("context"), F.when(held, pos - low).alias("context_at"))
    return store(out, "postings")


def lookup_terms(win: DataFrame, counts: DataFrame) -> DataFrame:
    """(window_id, words, t1, o1, t2, o2): the two rarest terms of each different window and their offsets (ties: the
    first by name, then by offset); a window of one word has its only term twice."""
    each = win.select("window_id", "words").dropDuplicates(["window_id"]).select("window_id", "words", F.posexplode("words").alias("o", "term"))
    ranked = each.join(counts, "term").groupBy("window_id").agg(
        F.first("words").alias("words"), F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "o"))), 1, 2).alias("r"))
    last = F.col("r")[F.size("r") - 1]
    return ranked.select("window_id", "words", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), last["term"].alias("t2"), last["o"].alias("o2"))


def phrase_matches(index: DataFrame, looked: DataFrame) -> DataFrame:
    """(window_id, doc_key, start, len): every occurrence of every window, exactly."""
    posted = index.where("term IS NOT NULL")
    one = posted.join(looked, F.col("term") == F.col("t1")).select(
        "window_id", "words", "doc_key", (F.col("pos") - F.col("o1")).alias("start"), "context", (F.col("context_at") - F.col("o1")).alias("from"), "n_words") \
        .where("start >= 0 AND start + size(words) <= n_words")
    two = posted.join(looked, F.col("term") == F.col("t2")).select("window_id", "doc_key", (F.col("pos") - F.col("o2")).alias("start"))
    both = one.join(two, ["window_id", "doc_key", "start"], "left_semi")
    exact = both.where(F.col("words") == F.slice("context", F.col("from") + 1, F.size("words")))
    return exact.select("window_id", "doc_key", "start", F.size("words").alias("len")).distinct()


def proximity_matches(index: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(query_id, doc_key): documents in which all different terms of a query (query_id, terms) stand within `slop`
    positions of one occurrence of its rarest term. The index must hold all terms of the queries."""
    posted = index.where("term IS NOT NULL").select("term", "doc_key", "pos")
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    counts = posted.groupBy("term").agg(F.count("*").alias("n"))
    ranked = asked.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("query_id").agg(F.min(F.struct("n", "term")).getField("term").alias("term"), F.count("*").alias("need"))
    block = slop + 1  # equality on blocks of positions instead of a range join
    around = posted.join(rarest, "term").select("query_id", "need", "doc_key", F.col("pos").alias("at"), F.explode(F.array(*[F.floor(F.col("pos") / block) + k for k in (-1, 0, 1)])).alias("block"))
    others = posted.join(asked, "term").withColumn("block", F.floor(F.col("pos") / block))
    near = around.join(others, ["query_id", "doc_key", "block"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
    full = near.groupBy("query_id", "need", "doc_key", "at").agg(F.countDistinct("term").alias("got")).where("got = need")
    return full.select("query_id", "doc_key").distinct()


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row of docs: doc_id, doc_key, n_words, n_hit, items (ids of items with occurring windows, sorted as strings)."""
    win = store(windows(items, item_text, item_key, width), "windows")
    terms = win.select(F.explode("words").alias("term")).distinct()
    counts = store(term_counts(docs, terms, n_terms := terms.count(), text, key), "terms")
    looked = store(lookup_terms(win, counts), "lookups")
    wanted = looked.select(F.col("t1").alias("term")).union(looked.select("t2")).distinct()
    index = build_index(docs, wanted, n_terms, text, key, width)
    found = store(phrase_matches(index, looked), "matches")
    prior = Window.partitionBy("doc_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(prior), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("doc_key").agg(F.sum("fresh").alias("n_hit"))
    named = found.select("window_id", "doc_key").distinct().join(win.select("window_id", F.col("item_id").cast("string").alias("item")).distinct(), "window_id") \
        .groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = store(hits.join(named, "doc_key", "left"), "hits")
    discard(win, counts, looked, found)
    lengths = index.where("term IS NULL").select("doc_id", "doc_key", F.col("n_words").cast("bigint").alias("n_words"))
    return lengths.join(told, "doc_key", "left").select("doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def flagged(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The op3 contract."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), flagged().alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the contaminated ones."""
    (bad_,) = fresh(docs, "_bad")
    bad = contamination(docs, items, text, key).where(flagged()).select(F.col("doc_key").alias(bad_)).distinct()
    return docs.join(store(bad, "contaminated"), doc_key(docs[text], docs[key]) == F.col(bad_), "left_anti")
