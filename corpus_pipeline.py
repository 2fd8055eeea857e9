"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes any table with the columns of documents and more: all but the last hand all of its columns on as they
are, whatever their names. Empty tables go through all stages. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkspark.llm import decontaminate, langid, mixing, simhash, tokens
from linkspark.llm.common import bucket_of, discard, fresh, store, table

CACHE = 150_000  # chunks that a worker of the last stage remembers; the executors still hold the memory of the stages before
LEAST_SCORE = 0.5  # a text is rejected as of no known language below this


def language_id(spark, docs, sf_dir):
    """Learns from labelled rows as op1 does; rejects texts without letters (null and empty ones too) and those with a
    score under LEAST_SCORE. Repeated rows are judged alike; without any label all texts are rejected."""
    model = langid.fit(docs.where(~bucket_of("doc_id", 4, 2)))
    names = lang, score = fresh(docs, "_lang_pred", "_lang_score")
    told = langid.predict(docs, model, names=tuple(names))
    return told.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Keeps the document of least doc_id of each SimHash group, one of its repeated rows; rows without doc_id stay."""
    return simhash.near_dedup(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents that op3 calls contaminated; null texts have no words and stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it (0, 1 or 2 times); documents without words are not taken."""
    return mixing.mixed(docs)


def token_files(spark, docs, sf_dir):
    """Writes the token files and returns the digest read back from them; null and empty texts have the end id alone."""
    return tokens.digest(docs, cache=CACHE)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token files", token_files),
]

ORACLE_SQL = None  # SQL can't express the model of the first stage or the tokenizer of the last


def run(spark, sf_dir):
    """All stages, each stored; a stage's table goes when the next is there, so that at most two are held."""
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if held is not None:
            discard(held)
        held = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # has written its files and reads only those
    discard(held)
    return out
