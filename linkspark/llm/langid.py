"""Language ID: multinomial naive Bayes over hashed character n-grams.

Null text, or text without a letter: `und`, score 0. Without any labelled row every text is `und`. Ties go to the
language that sorts first. Empty tables give empty results; repeated rows are scored alike, and a text gets the same
score whatever stands beside it; extra columns are kept, but for those that have the names of the two new ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_blocks

LETTER = re.compile(r"[^\W\d_]")
BLOCK = 500_000  # code points scored at once
MULTIPLIERS = (2654435761, 2246822519, 3266489917)


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    matrix: np.ndarray  # buckets x langs, log-probabilities
    prior: np.ndarray
    bits: int


def has_letter(text: str) -> bool:
    m = LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(map(str.isalpha, text)))


def gram_buckets(codes: np.ndarray, bits: int):
    """For n = 1..3 the bucket of the n-gram that starts at each code point; codes end with two zeros."""
    c = codes.astype(np.uint32)
    n, h = len(c) - 2, np.zeros(len(c) - 2, np.uint32)
    for k, m in enumerate(MULTIPLIERS):
        h = (h ^ (c[k:k + n] + np.uint32(k + 1))) * np.uint32(m)
        h ^= h >> np.uint32(15)
        yield (h >> np.uint32(32 - bits)).astype(np.int64)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each ended by two zeros, and start and end (before the zeros) of each in turn."""
    parts = [t.lower() for t in texts]
    codes = np.frombuffer("".join(p + "\0\0" for p in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array(list(map(len, parts)), np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    return codes, np.stack([starts, starts + sizes], axis=1).ravel()


def pieces(text: str):
    """A text in runs of BLOCK code points."""
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)] or [""]


def score(model: LangModel, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not model.langs:
        return out
    known = [i for i, t in enumerate(texts) if t and has_letter(t)]
    runs = [(i, p) for i in known for p in pieces(texts[i])]
    totals = np.zeros((len(texts), len(model.langs)))
    for a, b in text_blocks([p for _, p in runs], BLOCK):
        codes, bounds = packed([p for _, p in runs[a:b]])
        for h in gram_buckets(codes, model.bits):  # the last end is the end of h
            sums = np.add.reduceat(model.matrix.take(h, axis=0), bounds[:-1], axis=0)[::2]
            np.add.at(totals, [i for i, _ in runs[a:b]], sums)
    for i in known:
        z = model.prior + totals[i] / len(MULTIPLIERS)
        k = int(z.argmax())
        out[i] = (model.langs[k], float(1 / np.exp(z - z[k]).sum()))
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 2000, bits: int = 16, alpha: float = 0.5, most_langs: int = 128) -> LangModel:
    """Learn from rows with a text and a label; of a label with more rows than per_lang, a hash of key (of the text where
    the key is null) picks about per_lang (the documented bound of the training sample).

    Counts per bucket come to the driver and the matrix is broadcast: both are labels x 2**bits. Labels are counted
    before; more than most_langs different ones raise ValueError, as no column of languages has so many."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("key")).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(totals) > most_langs:
        raise ValueError(f"More than {most_langs} different labels")
    langs = tuple(sorted(totals))
    if not langs:
        return LangModel((), np.zeros((1 << bits, 0)), np.zeros(0), bits)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / totals[k]))])
    rows = rows.where((F.pmod(F.xxhash64("key", F.when(F.col("key").isNull(), F.col("text"))), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for big in batches:
            for b in slices(big, "text"):
                for lang_, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for p in pieces(text_):
                        codes, _ = packed([p])
                        for h in gram_buckets(codes, bits):
                            sums.setdefault(lang_, np.zeros(1 << bits, np.int64))
                            sums[lang_] += np.bincount(h, minlength=1 << bits)
        for lang_, v in sums.items():
            (at,) = v.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at)), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((1 << bits, len(langs)), alpha)
    np.add.at(counts, (got["bucket"].to_numpy(int), [langs.index(x) for x in got["lang"]]), got["n"].to_numpy(float))
    n = np.array([totals[k] for k in langs], float)
    return LangModel(langs, np.log(counts / counts.sum(axis=0)), np.log(n / n.sum()), bits)


def predict(docs: DataFrame, model: LangModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, with the language and its score under names (existing columns of these names are replaced)."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{names[0]}` string, `{names[1]}` double"
    at = docs.columns.index(text)

    def run(batches):
        for big in batches:
            for b in slices(big, text):
                got = score(shared.value, b.column(at).to_pylist())
                new = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, ddl)
