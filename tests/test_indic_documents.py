"""The queries of Indic scripts over a whole table, against plain Python."""

import re

import __spark_entry__
import pytest

from linkspark.functions.translit import transliterate
from linkspark.plans.queries import SAMPLES, SPELLED

COUNTED = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every sample within text, many times over, and rows without text or Indic characters."""
    rows = [(i, f"Text {i} {SAMPLES[i % len(SAMPLES)]} end") for i in range(COUNTED)] + [(1000, None), (1001, ""), (1002, "plain"), (None, SAMPLES[0])]
    path = tmp_path_factory.mktemp("indic")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), dict(rows)


def ran(spark, folder, name):
    got = [r.asDict() for r in __spark_entry__.queries()[name](spark, folder[0]).collect()]
    assert len(got) == len(folder[1])
    return {r["doc_id"]: r for r in got}


def test_script_flag(spark, folder):
    got = ran(spark, folder, "script_flag_documents")
    assert {k: r["has_nonlatin"] for k, r in got.items()} == {k: int(any("\u0900" <= ch <= "\u0d7f" for ch in t or "")) for k, t in folder[1].items()}


def test_translit(spark, folder):
    got = {k: r["translit"] for k, r in ran(spark, folder, "translit_documents").items()}
    assert got == {k: transliterate(t) for k, t in folder[1].items()}
    assert [got[i] for i in range(COUNTED)] == [f"Text {i} {SPELLED[i % len(SPELLED)]} end" for i in range(COUNTED)]


def test_select_representation(spark, folder):
    got = ran(spark, folder, "select_representation_documents")
    for k, t in folder[1].items():
        said = " ".join(transliterate(t).casefold().split())
        words = " ".join(re.findall(r"\w+", said))
        indic = any("\u0900" <= ch <= "\u0d7f" for ch in t or "")
        assert (got[k]["name_clean"], got[k]["name_tokens"], got[k]["name_tokens_translit"]) == (said, words, words if indic else None)
