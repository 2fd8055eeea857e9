import pytest
from pyspark.errors import AnalysisException

from linkspark.plans.pipeline import RunConfig, run
from linkspark.sources import readers, writers
from linkspark.streaming.records import preprocess_stream

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reader(spark, tmp_path):
    p = put(tmp_path / "a.tsv", HEAD + '1\t"q ""x"" y"\tNA\t00123\n2\tnull\t"a\nb"\t\n')
    a, b = readers.read_source(spark, p).orderBy("entity_id").collect()
    assert tuple(a) == ("1", 'q "x" y', None, "00123")
    assert tuple(b) == ("2", None, "a\nb", None)
    with pytest.raises(ValueError):
        readers.read_source(spark, put(tmp_path / "b.tsv", "entity_id\tx\n1\t2\n"))
    with pytest.raises(AnalysisException):
        readers.read_source(spark, str(tmp_path / "none.tsv"))
    assert readers.read_source(spark, put(tmp_path / "c.tsv", HEAD)).count() == 0


def test_run_and_csv(spark, tmp_path):
    for f, p in zip(readers.SOURCE_FILES.values(), ("a", "b", "c"), strict=True):
        put(tmp_path / f, HEAD + f"{p}1\tAcme Inc\t5 Elm St\tIndia\n{p}2\tनगर\t\tUS\n")
    put(tmp_path / readers.TRUTH_FILE, "l\tr\na1\tb1\na1\tb1\n\tb2\n")
    out = run(spark, RunConfig(str(tmp_path), str(tmp_path / "out"), csv=True, audit=True))
    assert out["records"].count() == 6 and len(out["records"].columns) == 55
    assert out["stats"].where("source = 'S1'").first()["nonlatin_names"] == 1
    assert out["audit"].where("RULE = 'UNION_ALL'").first()["RECALL"] == 1.0
    text = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/preprocessed_csv"))
    assert text.where("entity_id = 'a1'").first()["name_tokens"] == "['acme', 'inc']"


def test_recode(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "entity_id,country\n1,India\n2,Mars\n"), put(tmp_path / "b.csv", "entity_id\n1\n")
    assert writers.recode_countries(spark, [a, b], str(tmp_path / "coded")) == [b]
    assert [r["country"] for r in readers.read_text_table(spark, str(tmp_path / "coded/a.csv"), ",").orderBy("entity_id").collect()] == ["0", "Mars"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in/a.tsv", HEAD + "1\tAcme Inc\t5 Elm St\tIndia\n")
    for _ in range(2):  # a second run finds nothing new
        preprocess_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [(r["name_core"], r["country"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("acme", "0")]


def test_first_rows_are_those_of_the_top(spark, tmp_path):
    p = put(tmp_path / "a.tsv", HEAD + "".join(f"{(i * 7919) % 5000}\tn{i}\ta\tUS\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert readers.read_text_table(spark, p).rdd.getNumPartitions() > 4  # no line break in a field: split
        got = [r["business_name"] for r in readers.read_source(spark, p, 7).collect()]
        assert got == [f"n{i}" for i in range(7)]
        assert [r["business_name"] for r in readers.read_source(spark, p, 700).collect()] == [f"n{i}" for i in range(700)]
        assert readers.read_source(spark, p, multiline=False).count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_breaks_are_looked_for(spark, tmp_path):
    plain, broken = put(tmp_path / "a.tsv", HEAD + '1\t"q ""x"" y"\ta\tUS\n'), put(tmp_path / "b.tsv", HEAD + '1\t"q\n""x"" y"\ta\tUS\n')
    assert (readers.has_line_breaks(spark, plain), readers.has_line_breaks(spark, broken)) == (False, True)
    assert readers.read_source(spark, broken).first()["business_name"] == 'q\n"x" y'


def test_stream_equals_batch(spark, tmp_path):
    """Missing values, quotes and line breaks are read alike."""
    from linkspark.operators.records import preprocess

    (tmp_path / "in").mkdir()
    text = HEAD + '1\t"Acme ""Inc"" Co"\tNA\tIndia\n2\tnull\t"5 Elm\nSt"\t\n3\tनगर Ltd\tn/a\tUS\n'
    p = put(tmp_path / "in/a.tsv", text)
    preprocess_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    batch = preprocess(readers.read_source(spark, p))
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(*batch.columns).collect())) == sorted(map(repr, batch.collect()))


def test_command_line(spark, tmp_path, capsys):
    from linkspark.plans.pipeline import main

    for f, p in zip(readers.SOURCE_FILES.values(), ("a", "b", "c"), strict=True):
        put(tmp_path / f, HEAD + f"{p}1\tAcme Inc\t5 Elm St\tIndia\n{p}2\tBolt\t\tUS\n")
    main(["--data-dir", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--sample-rows", "1"])
    assert "suffixes" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out/preprocessed")).count() == 3
    with pytest.raises(SystemExit):
        main(["--data-dir", "x", "--output-dir", "y", "--cap", "0"])


def test_submission_must_be_candidates(spark, tmp_path):
    from linkspark.operators import matching

    pairs = spark.createDataFrame([("a", "b"), ("c", "d")], "S1_id string, S2_id string")
    matching.write_submission(pairs.limit(1), pairs, str(tmp_path))
    assert readers.read_text_table(spark, str(tmp_path / "candidate_pairs.tsv")).count() == 2
    with pytest.raises(ValueError):
        matching.write_submission(pairs, pairs.where("S1_id = 'a'"), str(tmp_path))
