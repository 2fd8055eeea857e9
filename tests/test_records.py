import pytest
from pyspark.sql import functions as F

from linkspark.functions.country import encode_country
from linkspark.functions.translit import transliterate
from linkspark.operators import records
from linkspark.operators.records import PreprocessingConfig, preprocess, record_features

ADDRESSES = [
    # address, numbers, street, unit, postal, state, city tokens
    ("88 OLIVE CIR, LEBANON, TN", "88", "88", "", "", "TN", "olive cir lebanon"),
    ("4038 Talmadge Road, Unit 102", "4038 102", "4038", "102", "", "", "talmadge road unit"),
    ("APT 5B13 FL 1 H.NO 204", "1 204", "1", "5B13", "", "FL", "h.no"),
    ("123 Main St, Springfield, IL 62701", "123 62701", "123", "", "62701", "IL", "main st springfield"),
    ("1056-1060 Some Road", "1056 1060", "1056", "", "", "", "some road"),
    ("Rue de la Paix, 75002 Paris", "75002", "75002", "", "75002", "DE", "rue paix paris"),
    ("12 Stewart Rd, Florida", "12", "12", "wart", "", "", "rd"),
    ("LA, CA", "", "", "", "", "CA", ""),
    ("Bangalore KA 560001", "560001", "560001", "", "", "KA", "bangalore"),
    ("Ottawa K1A 0B1", "", "", "", "K1A0B1", "", "ottawa"),
    ("Suite #200", "200", "200", "", "", "", "suite"),
    ("Suite#200", "200", "200", "200", "", "", "suite"),
    ("Flat 4, Building 5", "4 5", "4", "4", "", "", "building"),
    ("Unit 102 Springfield", "102", "102", "102", "", "", ""),
    ("Flat", "", "", "", "", "", ""),
    ("12-3A Oak", "12", "12", "", "", "", "3a oak"),
    ("9 Elm, 62701-1234", "9 62701 1234", "9", "", "627011234", "", "elm"),
    (None, "", "", "", "", "", ""),
    ("", "", "", "", "", "", ""),
    ("789 Main Rd, Bangalore, KA", "789", "789", "", "", "KA", "main rd bangalore"),
    ("H.NO 204", "204", "204", "204", "", "", "h.no"),
]
NAMES = [
    # name, clean, suffix, core, domain, domain core, numbers
    ("Acme Co.", "acme co.", "", "acme co.", "", "", ""),
    ("Acme Co", "acme co", "company", "acme", "", "", ""),
    ("Jane Roe O.D.", "jane roe o.d.", "o.d", "jane roe", "", "", ""),
    ("A&B Ltd.", "aandb ltd.", "limited", "aandb", "", "", ""),
    ("  FH BUSINESS  Pvt. LIMITED  ", "fh business pvt. limited", "limited", "fh business pvt.", "", "", ""),
    ("Foo Co Ltd", "foo co ltd", "limited", "foo co", "", "", ""),
    ("shop.acme.co.uk", "shop.acme.co.uk", "", "shop.acme.co.uk", "shop.acme.co", "shop.acme", ""),
    ("Pvt.Ltd", "pvt.ltd", "limited", "pvt.", "pvt.ltd", "pvt", ""),
    ("St.Mary Clinic", "st.mary clinic", "", "st.mary clinic", "st.mary", "st", ""),
    ("24/7 Fitness Inc", "24/7 fitness inc", "incorporated", "24/7 fitness", "", "", "24/7"),
    ("info@acme.com", "info@acme.com", "", "info@acme.com", "acme.com", "acme", ""),
    ("Inc", "inc", "incorporated", "", "", "", ""),
    ("Acme LLC.", "acme llc.", "", "acme llc.", "", "", ""),
    ("Acme l.l.c", "acme l.l.c", "llc", "acme", "", "", ""),
    ("Straße GmbH", "strasse gmbh", "", "strasse gmbh", "", "", ""),
    ("Ａ＆B ﬁ", "aandb fi", "", "aandb fi", "", "", ""),
    (None, "", "", "", "", "", ""),
    ("Acme, Inc", "acme, inc", "incorporated", "acme,", "", "", ""),
    ("cardiologymetrocare.com", "cardiologymetrocare.com", "", "cardiologymetrocare.com", "cardiologymetrocare.com", "cardiologymetrocare", ""),
]


def test_addresses(spark):
    df = spark.createDataFrame([(str(i), "x", a[0]) for i, a in enumerate(ADDRESSES)], "entity_id string, business_name string, business_address string")
    got = {int(r["entity_id"]): r for r in record_features(df).collect()}
    for i, (_, numbers, street, unit, postal, state, city) in enumerate(ADDRESSES):
        r = got[i]
        assert (" ".join(r["address_numbers"]), r["street_number"], r["unit_number"], r["postal_code"], r["state_code"], " ".join(r["city_tokens"])) == (numbers, street, unit, postal, state, city), ADDRESSES[i]


def test_names(spark):
    df = spark.createDataFrame([(str(i), n[0], "") for i, n in enumerate(NAMES)], "entity_id string, business_name string, business_address string")
    got = {int(r["entity_id"]): r for r in record_features(df).collect()}
    for i, (_, clean, suffix, core, domain, domain_core, numbers) in enumerate(NAMES):
        r = got[i]
        assert (r["name_clean"], r["legal_suffix"], r["name_core"], r["domain"], r["domain_core"], " ".join(r["name_numbers"]), r["is_domain_like"]) == (clean, suffix, core, domain, domain_core, numbers, domain != ""), NAMES[i]


def test_flags_and_tokens(spark):
    rows = [("1", "Deltaquo F/K/A Pao"), ("2", "A d/b/a B"), ("3", "X also known as Y"), ("4", "xd/b/a"), ("5", "unformerly known as"), ("6", "VIDYALAYA VIDYALAYA"), ("7", "निगम")]
    df = spark.createDataFrame([(*r, None) for r in rows], "entity_id string, business_name string, business_address string")
    got = {r["entity_id"]: r for r in record_features(df).collect()}
    assert [(got[k]["has_dba"], got[k]["has_fka"], got[k]["has_aka"]) for k in "12345"] == [(0, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0), (0, 1, 0)]
    assert got["6"]["name_tokens"] == ["vidyalaya", "vidyalaya"]
    assert got["7"]["name_tokens"] == ["न", "गम"]


def test_config_and_missing_columns(spark):
    df = spark.createDataFrame([("1", "A Inc", " 5 Elm ", "extra")], "entity_id string, business_name string, business_address string, note string")
    r = record_features(df, PreprocessingConfig(normalize_text=False, preserve_original=False, extract_address_components=False)).first()
    assert "note" not in r and r["address_clean"] == " 5 Elm " and r["address_numbers"] == [] and r["street_number"] == "" and r["country"] == ""
    with pytest.raises(ValueError, match="business_address"):
        preprocess(df.drop("business_address"))


def test_country(spark):
    values = ["India", " USA ", "united states", "France", "1", "Atlantis", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").select("i", encode_country(F.col("c")).alias("c"))
    assert [r["c"] for r in df.orderBy("i").collect()] == ["0", "1", "1", "2", "1", "Atlantis", None]


@pytest.mark.parametrize("text, latin", [
    ("नगर", "nagara"), ("श्री", "shri"), ("ગુજરાત", "gujarata"), ("দিল্লি", "dilli"), ("அமுதா", "amuta"), ("ABC नगर निगम", "ABC nagara nigama"),
    ("नગ", "naga"), ("१२", "12"), ("Café", "Café"), ("Москва", "Москва"), (None, ""), ("", ""),
])
def test_transliterate(text, latin):
    assert transliterate(text) == latin


def test_wide_record(spark):
    df = spark.createDataFrame([("1", "नगर Ltd", "5 नगर", "India"), ("2", "Acme Inc", None, None)], "entity_id string, business_name string, business_address string, country string")
    out = preprocess(df)
    assert len(out.columns) == 54
    a, b = out.orderBy("entity_id").collect()
    assert (a["name_core"], a["name_core_translit"], a["legal_suffix_native"], a["country"], a["address_clean"]) == ("nagara", "nagara", "limited", "0", "5 nagara")
    assert (b["name_core"], b["name_core_translit"], b["name_tokens_translit"], b["address_numbers_translit"], b["city_tokens_native"]) == ("acme", "", None, [], [])
    assert preprocess(df.limit(0)).count() == 0


def test_distinct_evaluation(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert sorted(records.evaluate_distinct(df, "v", "u", F.upper).select("u").toPandas()["u"].fillna("-")) == ["-", "A", "A"]


def test_lists_as_text(spark):
    from linkspark.functions.text import char_grams, parse_list

    df = spark.createDataFrame([("['shree', 'infra con']",), ("[]",), (' [ "a" ] ',), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(parse_list(F.col("t"))).collect()] == [["shree", "infra con"], [""], ["a"], None, ["x"]]
    grams = spark.createDataFrame([("abcab",), ("ab",), ("",), (None,)], "t string").select(char_grams(F.col("t"), 2))
    assert [r[0] for r in grams.collect()] == [["ab", "bc", "ca"], ["ab"], [], []]
    parsed = records.parse_lists(spark.createDataFrame([("1", "['a']", "['a']")], "entity_id string, name_tokens string, note string")).first()
    assert (parsed["name_tokens"], parsed["note"]) == (["a"], "['a']")


@pytest.mark.parametrize("text, script", [("नगर", "DEVANAGARI"), ("ൻ", "MALAYALAM"), ("ক", "BENGALI"), ("a", None), ("Ж", None), ("", None), (None, None), ("඀", None)])
def test_script_of(spark, text, script):
    from linkspark.functions.translit import script_of

    got = spark.createDataFrame([(text,)], "t string").select(script_of(F.col("t")).alias("s")).first()["s"]
    assert (got["script"], got["scheme"]) == (script, script and script.lower())


def test_features_as_structs(spark):
    """Each struct has the values of the record's own columns."""
    from linkspark.functions import api

    rows = [(str(i), n[0], a[0]) for i, (n, a) in enumerate(zip(NAMES * 2, ADDRESSES, strict=False))]
    df = record_features(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string"))
    for f, c in ((api.normalize_name, "business_name"), (api.extract_name_features, "business_name"), (api.normalize_address, "business_address"), (api.extract_address_features, "business_address")):
        for r in df.select("*", f(F.col(c)).alias("got")).collect():
            assert r["got"].asDict() == {k: r[k] for k in r["got"].asDict()}
    assert len(api.NORMALIZED_NAME) == 3 and len(api.COMPONENTS) == 6
