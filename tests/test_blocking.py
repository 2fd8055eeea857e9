import pytest

from linkspark.operators import blocking, matching
from linkspark.operators.blocking import BlockingRule
from linkspark.operators.records import record_features

TOKEN = BlockingRule("token", ("name_tokens",), "name_tokens")
SCHEMA = "entity_id string, name_tokens array<string>, country string, street_number string, domain_core string"


def side(spark, rows):
    return spark.createDataFrame([(i, t, None, "", "") for i, t in rows], SCHEMA)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_cap_is_inclusive_and_counts_rows(spark):
    s1 = side(spark, [("a", ["x", "y"])])
    s2 = side(spark, [("1", ["x", "x"]), ("2", ["x"]), ("3", ["y"]), ("4", ["y"])])
    assert pairs(blocking.candidates(s1, s2, TOKEN, cap=3)) == [("a", "1"), ("a", "2"), ("a", "3"), ("a", "4")]
    assert pairs(blocking.candidates(s1, s2, TOKEN, cap=2)) == [("a", "3"), ("a", "4")]


def test_empty_tokens_and_blank_keys(spark):
    s1, s2 = side(spark, [("a", [])]), side(spark, [("1", [])])
    assert pairs(blocking.candidates(s1, s2, TOKEN)) == []
    assert pairs(blocking.candidates(s1, s2, TOKEN, compat_empty_token=True)) == [("a", "1")]
    assert pairs(blocking.candidates(s1, s2, BlockingRule("d", ("domain_core",)))) == []


def test_audit(spark):
    s1, s2 = side(spark, [("a", ["x"]), ("b", ["z"])]), side(spark, [("1", ["x"]), ("2", ["q"])])
    truth = blocking.true_pairs(spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "2")], "p string, q string"))
    got = {r["RULE"]: tuple(r)[1:] for r in blocking.audit(s1, s2, truth, [TOKEN, BlockingRule("bad", ("nope",))], on_error="skip").collect()}
    assert got == {"token": (1, 1, 0.5), "UNION_ALL": (1, 1, 0.5)}
    assert blocking.audit(s1, s2, truth, [BlockingRule("bad", ("nope",))], on_error="skip").count() == 0
    with pytest.raises(Exception):
        blocking.audit(s1, s2, truth, [BlockingRule("bad", ("nope",))])
    none = blocking.audit(s1, s2, truth.limit(0), [TOKEN]).where("RULE = 'token'").first()
    assert none["RECALL"] == 0.0
    with pytest.raises(ValueError):
        blocking.true_pairs(truth.select("S1_id"))


def test_matching(spark):
    names = [("1", "Acme Inc"), ("2", "Bolt Ltd"), ("3", "Zed Clinic")]
    make = lambda p: record_features(spark.createDataFrame([(p + i, n, f"{i} Main St, IL 6270{i}") for i, n in names], "entity_id string, business_name string, business_address string"))
    s1, s2 = make("a"), make("b")
    all_pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in "123" for j in "123"], "S1_id string, S2_id string")
    truth = spark.createDataFrame([(f"a{i}", f"b{i}") for i in "123"], "S1_id string, S2_id string")
    f = matching.pair_features(all_pairs, s1, s2)
    assert f.where("S1_id = 'a1' AND S2_id = 'b1'").first()["name_edit"] == 1.0
    scores = matching.scored(f, matching.train(f, truth))
    best = matching.threshold_sweep(scores, truth).orderBy("f_half", ascending=False).first()
    assert best["f_half"] == 1.0
    cosine = {(r[0], r[1]): r[2] for r in matching.tfidf_cosine(all_pairs, s1, s2).collect()}
    assert cosine["a1", "b1"] == pytest.approx(1) and cosine["a1", "b2"] < 0.5
    with pytest.raises(ValueError):
        matching.check_subset(truth, all_pairs.where("S1_id <> 'a1'"))
