"""The registered queries of the record engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import api, name
from ..functions.address import address_features, city_text
from ..functions.country import encode_country
from ..functions.name import name_features
from ..functions.rules import COUNTRIES, LEGAL_SUFFIXES, STATES, UNIT_LABELS
from ..functions.text import has_nonlatin, norm_text, tokens
from ..functions.translit import script_of, transliterated
from ..operators import blocking, matching, records
from ..sources import readers, writers
from ..sources.shared import new_path, spread, stored
from . import adapters as A
from . import pipeline

SAMPLES = ("नगर", "निगम", "राम", "श्री", "ગુજરાત", "দিল্লি", "அமுதா", "ABC नगर निगम", "नગ", "१२", "Café", "Москва")
SPELLED = ("nagara", "nigama", "rama", "shri", "gujarata", "dilli", "amuta", "ABC nagara nigama", "naga", "12", "Café", "Москва")



def _documents(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _list_text(df, columns):
    return df.select(*(F.array_join(c, " ").alias(c) if c in columns else c for c in df.columns))


LISTS = ("name_tokens", "name_numbers", "address_numbers", "city_tokens")


def _names(spark, sf_dir, fields):
    rows = A.s2(spark, sf_dir).select("entity_id", "business_name", norm_text(F.col("business_name")).alias("_n"))
    f = name_features(F.col("business_name"), F.col("_n"))
    return _list_text(rows.select("entity_id", *(f[k].alias(k) for k in fields)), LISTS)


def _addresses(spark, sf_dir, fields):
    rows = A.s3(spark, sf_dir).select("entity_id", "business_address", norm_text(F.col("business_address")).alias("_a"), city_text(F.col("business_address")).alias("_c"))
    f = address_features(F.col("business_address"), F.col("_a"), F.col("_c"))
    return _list_text(rows.select("entity_id", *(f[k].alias(k) for k in fields)), LISTS)


def norm_text_query(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", norm_text(F.col("text")).alias("text_norm"))


def name_tokens(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(norm_text(F.col("text")).alias("n"))
    return docs.select(F.explode(tokens(F.col("n"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def domain_features(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.domain(F.col("url")).alias("domain"))
    return pages.select("page_id", "domain", name.domain_core(F.col("domain")).alias("domain_core"), (F.col("domain") != "").alias("is_domain_like"))


def country_code(spark, sf_dir):
    return A.s1(spark, sf_dir).select("entity_id", encode_country(F.col("country")).alias("country"))


def _samples(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, business_name string")


def script_flag(spark, sf_dir):
    return _samples(spark).select("id", has_nonlatin(F.col("business_name")).alias("has_nonlatin"))


def translit_names(spark, sf_dir):
    return _samples(spark).select("id", transliterated(F.col("business_name")).alias("translit"))


def select_representation(spark, sf_dir):
    df = _samples(spark).select(F.col("id").cast("string").alias("entity_id"), "business_name", F.lit("").alias("business_address"))
    return records.preprocess(df).select(F.col("entity_id").cast("int").alias("id"), "name_clean", F.array_join("name_tokens", " ").alias("name_tokens"), F.array_join("name_tokens_translit", " ").alias("name_tokens_translit"))


def _texts(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", "text")


def script_flag_documents(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", has_nonlatin(F.col("text")).alias("has_nonlatin"))


def translit_documents(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", transliterated(F.col("text")).alias("translit"))


def select_representation_documents(spark, sf_dir):
    df = _texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("entity_id"), F.col("text").alias("business_name"), F.lit("").alias("business_address"))
    return records.preprocess(df).select(F.col("entity_id").cast("bigint").alias("doc_id"), "name_clean", F.array_join("name_tokens", " ").alias("name_tokens"), F.array_join("name_tokens_translit", " ").alias("name_tokens_translit"))


def preprocess_record(spark, sf_dir):
    out = records.record_features(A.s1(spark, sf_dir).drop("k"))
    return _list_text(out, LISTS)


def preprocess_wide(spark, sf_dir):
    wide = records.preprocess(records.union_sources({"S1": A.s1(spark, sf_dir).drop("k")}))
    return wide.select(
        "entity_id", "country", "name_has_nonlatin", "business_name_translit", "name_core", "name_core_native", "name_core_translit",
        F.array_join("address_numbers_native", " ").alias("address_numbers_native"), F.size("address_numbers_translit").alias("n_translit"), F.col("name_tokens_translit").isNull().alias("no_tokens_translit"))


def _wide_union(spark, sf_dir):
    return records.preprocess(records.union_sources({k: f(spark, sf_dir).drop("k") for k, f in (("S1", A.s1), ("S2", A.s2), ("S3", A.s3))}))


def source_stats(spark, sf_dir):
    return records.source_stats(_wide_union(spark, sf_dir))


def stats_total(spark, sf_dir):
    return records.stats_total(records.source_stats(_wide_union(spark, sf_dir)))


def _plain_union(spark, sf_dir):
    return records.record_features(records.union_sources({k: f(spark, sf_dir).drop("k") for k, f in (("S1", A.s1), ("S2", A.s2), ("S3", A.s3))}))


def feature_summary(spark, sf_dir):
    return records.feature_summary(_plain_union(spark, sf_dir))


def suffix_top10(spark, sf_dir):
    return records.suffix_top(_plain_union(spark, sf_dir))


def union_sources(spark, sf_dir):
    return records.union_sources({k: f(spark, sf_dir).drop("k") for k, f in (("S1", A.s1), ("S2", A.s2), ("S3", A.s3))})


def sample_rows(spark, sf_dir):
    """The operator's own limit of rows per source."""
    return records.union_sources({k: records.sample_rows(f(spark, sf_dir).drop("k"), 100) for k, f in (("S1", A.s1), ("S2", A.s2))})


def ground_truth_pairs(spark, sf_dir):
    return blocking.true_pairs(A.truth(spark, sf_dir))


def _sides(spark, sf_dir):
    """Features of S1 and S2 that blocking needs."""
    return tuple(records.record_features(f(spark, sf_dir).drop("k")).select("entity_id", "name_tokens", "country", "street_number", "domain_core") for f in (A.s1, A.s2))


def _bench_sides(spark, sf_dir):
    """Tokens of both sides, stored, as they are read twice."""
    cleaned = [d.select("entity_id", "country", norm_text(F.col("business_name")).alias("n")) for d in A.bench_records(spark, sf_dir)]
    return tuple(stored(df.select("entity_id", "country", tokens(F.col("n")).alias("name_tokens")), "tokens") for df in cleaned)


RULE = {r.name: r for r in blocking.RULES}


def key_counts(spark, sf_dir):
    rule = RULE["name_country"]
    return blocking.key_counts(blocking.key_rows(_sides(spark, sf_dir)[1], rule), rule)


def freq_cap_keys(spark, sf_dir):
    rule = RULE["rare_name_token"]
    return blocking.valid_keys(blocking.key_rows(_bench_sides(spark, sf_dir)[1], rule), rule)


def block_rare_name_token(spark, sf_dir):
    return blocking.candidates(*_bench_sides(spark, sf_dir), RULE["rare_name_token"])


def _block(rule):
    return lambda spark, sf_dir: blocking.candidates(*(stored(df, "side") for df in _sides(spark, sf_dir)), RULE[rule])


def _block_extra(rule):
    def query(spark, sf_dir):
        sides = [blocking.with_grams(records.record_features(f(spark, sf_dir).drop("k"))) for f in (A.s1, A.s2)]
        return blocking.candidates(*(stored(blocking.needed(df, blocking.EXTRA_RULES), "side") for df in sides), rule)

    return query


def block_union(spark, sf_dir):
    return blocking.rule_bits(*_sides(spark, sf_dir), blocking.RULES)[0].select("S1_id", "S2_id")


def blocking_audit(spark, sf_dir):
    return blocking.audit(*_sides(spark, sf_dir), A.truth(spark, sf_dir)).withColumn("RECALL", F.round("RECALL", 9))


def true_pair_hits(spark, sf_dir):
    return block_union(spark, sf_dir).intersect(blocking.true_pairs(A.truth(spark, sf_dir)))


def parquet_roundtrip(spark, sf_dir):
    sides = (stored(df, "side") for df in _sides(spark, sf_dir))
    return writers.spill(blocking.candidates(*sides, RULE["street_name_token"]), new_path(spark, "candidates"))


def _indic_union(spark, sf_dir):
    return records.preprocess(records.union_sources({k: A.indic(spark, sf_dir, shift).drop("k") for k, shift in (("S2", 0), ("S3", 1))}))


def indic_wide(spark, sf_dir):
    """All 54 columns of records in Latin and Indic scripts, lists joined."""
    wide = records.preprocess(A.indic(spark, sf_dir).drop("k"))
    return wide.select(*(F.array_join(c, " ").alias(c) if kind.startswith("array") else F.col(c) for c, kind in wide.dtypes))


def indic_source_stats(spark, sf_dir):
    return records.source_stats(_indic_union(spark, sf_dir))


def indic_stats_total(spark, sf_dir):
    return records.stats_total(records.source_stats(_indic_union(spark, sf_dir)))


def script_names(spark, sf_dir):
    return A.indic(spark, sf_dir).select("entity_id", script_of(F.col("business_name")).alias("s")).select("entity_id", "s.script", "s.scheme")


def distinct_evaluation(spark, sf_dir):
    """Each different name and address is transliterated once."""
    rows = A.indic(spark, sf_dir).select("entity_id", "business_name", "business_address")
    for c in ("business_name", "business_address"):
        rows = records.evaluate_distinct(rows, c, f"{c}_translit", transliterated)
    return rows.select("entity_id", "business_name_translit", "business_address_translit")


def api_name(spark, sf_dir):
    both = A.s2(spark, sf_dir).select("entity_id", api.normalize_name(F.col("business_name")).alias("a"), api.extract_name_features(F.col("business_name")).alias("b"))
    return _list_text(both.select("entity_id", "a.*", *(f"b.{k}" for k in ("name_tokens", "domain", "has_dba", "name_numbers"))), LISTS)


def api_address(spark, sf_dir):
    both = A.s3(spark, sf_dir).select("entity_id", api.normalize_address(F.col("business_address")).alias("a"), api.extract_address_features(F.col("business_address")).alias("b"))
    return _list_text(both.select("entity_id", "a.*", F.col("b.state_code").alias("state")), LISTS)


def plain_config(spark, sf_dir):
    """Records without the extra column, without address components and with the address as it is."""
    config = records.PreprocessingConfig(normalize_text=False, preserve_original=False, extract_address_components=False)
    out = records.preprocess_all({"S1": A.s1(spark, sf_dir)}, config)
    return out.select("source", "entity_id", "name_core", "address_clean", "street_number", F.size("city_tokens").alias("n_city"))


def head_sample(spark, sf_dir):
    """The operator's own limit: the first three records, three columns."""
    return records.head_rows(records.record_features(A.s1(spark, sf_dir)))


def truth_preview(spark, sf_dir):
    """The operator's own limit: the first five pairs."""
    return records.head_rows(blocking.true_pairs(A.truth(spark, sf_dir)), ("S1_id", "S2_id"), 5, "S2_id")


def _source_folder(spark, sf_dir):
    """The three sources and the ground truth as tab-separated files."""
    folder = new_path(spark, "sources")
    for key, df in (("S1", A.s1(spark, sf_dir)), ("S2", A.s2(spark, sf_dir)), ("S3", A.s3(spark, sf_dir))):
        writers.write_text_table(df.drop("k"), f"{folder}/{readers.SOURCE_FILES[key]}", "\t")
    writers.write_text_table(A.truth(spark, sf_dir), f"{folder}/{readers.TRUTH_FILE}", "\t")
    return folder


def tsv_sources(spark, sf_dir):
    """Written as tab-separated text and read back: blank values have become null."""
    return records.union_sources(readers.read_sources(spark, _source_folder(spark, sf_dir)))


def training_counts(spark, sf_dir):
    got = readers.read_training_data(spark, _source_folder(spark, sf_dir))
    return records.union_sources({k: df.agg(F.count("*").alias("n_rows"), F.countDistinct(df.columns[0]).alias("n_ids")) for k, df in got.items()})


def csv_lists(spark, sf_dir):
    """Plain records written as comma-separated text, lists as text, read back and parsed."""
    path = new_path(spark, "records-csv")
    writers.write_text_table(records.record_features(A.s2(spark, sf_dir).drop("k")), path)
    back = records.parse_lists(readers.read_text_table(spark, path, ",", missing=False))
    return _list_text(back.select("entity_id", "name_core", "name_tokens", "city_tokens"), LISTS)


def recoded_files(spark, sf_dir):
    folder = new_path(spark, "recode")
    writers.write_text_table(A.s1(spark, sf_dir).select("entity_id", "country"), f"{folder}/a.csv")
    writers.write_text_table(A.s1(spark, sf_dir).select("entity_id"), f"{folder}/b.csv")
    skipped = writers.recode_countries(spark, [f"{folder}/a.csv", f"{folder}/b.csv"], f"{folder}/coded")
    return readers.read_text_table(spark, f"{folder}/coded/a.csv", ",").withColumn("n_skipped", F.lit(len(skipped)))


def projected_scan(spark, sf_dir):
    path = new_path(spark, "records")
    writers.write_records(records.union_sources({k: f(spark, sf_dir).drop("k") for k, f in (("S1", A.s1), ("S2", A.s2))}), path)
    return readers.read_columns(spark, path, ["source", "entity_id", "country", "entity_id"])


def _run(spark, sf_dir, **more):
    """A whole run over files; the output folder and its tables."""
    out = new_path(spark, "run")
    return out, pipeline.run(spark, pipeline.RunConfig(_source_folder(spark, sf_dir), out, **more))


def run_stats(spark, sf_dir):
    return _run(spark, sf_dir)[1]["stats"]


def run_audit_file(spark, sf_dir):
    """The audit of a whole run, read from the file that it leaves."""
    back = readers.read_text_table(spark, f"{_run(spark, sf_dir, audit=True)[0]}/blocking_audit_results", ",")
    return back.select("RULE", F.col("CANDIDATES").cast("bigint").alias("CANDIDATES"), F.col("TRUE_PAIRS_CAUGHT").cast("bigint").alias("TRUE_PAIRS_CAUGHT"))


def run_source_stats(spark, sf_dir):
    return pipeline.run_source(spark, f"{_source_folder(spark, sf_dir)}/{readers.SOURCE_FILES['S2']}", "S2")[1]


def combined_summary(spark, sf_dir):
    return pipeline.preprocess_files(spark, _source_folder(spark, sf_dir), new_path(spark, "plain"))[0]


def submission_files(spark, sf_dir):
    """Matches and candidates written as submission files and read back."""
    folder = new_path(spark, "submission")
    pairs = stored(blocking.candidates(*(stored(df, "side") for df in _sides(spark, sf_dir)), RULE["street_name_token"]), "pairs")
    matching.write_submission(pairs.join(A.truth(spark, sf_dir), ["S1_id", "S2_id"], "left_semi"), pairs, folder)
    return records.union_sources({k: readers.read_text_table(spark, f"{folder}/{k}.tsv") for k in ("matching_results", "candidate_pairs")})


def tfidf_cosine(spark, sf_dir):
    sides = [records.record_features(f(spark, sf_dir).drop("k")).select("entity_id", "name_tokens") for f in (A.s1, A.s2)]
    return matching.tfidf_cosine(A.truth(spark, sf_dir), *sides).withColumn("cosine", F.round("cosine", 6))


def pair_features(spark, sf_dir):
    full = [records.record_features(f(spark, sf_dir).drop("k")) for f in (A.s1, A.s2)]
    f = matching.pair_features(A.truth(spark, sf_dir), *full)
    return f.select("S1_id", "S2_id", F.round("name_edit", 9).alias("name_edit"), F.round("name_jaccard", 9).alias("name_jaccard"), "same_postal_code", "same_street_number", "same_legal_suffix")


QUERIES = {
    "norm_text": norm_text_query,
    "name_tokens": name_tokens,
    "legal_suffix": lambda s, d: _names(s, d, ("name_clean", "legal_suffix", "name_core")),
    "domain_features": domain_features,
    "name_domain": lambda s, d: _names(s, d, ("domain", "domain_core", "is_domain_like")),
    "dba_flags": lambda s, d: _names(s, d, ("has_dba", "has_fka", "has_aka")),
    "name_numbers": lambda s, d: _names(s, d, ("name_numbers",)),
    "address_numbers": lambda s, d: _addresses(s, d, ("address_numbers",)),
    "street_number": lambda s, d: _addresses(s, d, ("street_number",)),
    "postal_code": lambda s, d: _addresses(s, d, ("postal_code",)),
    "unit_number": lambda s, d: _addresses(s, d, ("unit_number",)),
    "state_code": lambda s, d: _addresses(s, d, ("state_code",)),
    "city_tokens": lambda s, d: _addresses(s, d, ("city_tokens",)),
    "country_code": country_code,
    "script_flag": script_flag,
    "script_flag_documents": script_flag_documents,
    "translit_names": translit_names,
    "select_representation": select_representation,
    "preprocess_record": preprocess_record,
    "preprocess_wide": preprocess_wide,
    "source_stats": source_stats,
    "stats_total": stats_total,
    "feature_summary": feature_summary,
    "suffix_top10": suffix_top10,
    "union_sources": union_sources,
    "sample_rows": sample_rows,
    "ground_truth_pairs": ground_truth_pairs,
    "key_counts": key_counts,
    "freq_cap_keys": freq_cap_keys,
    "block_rare_name_token": block_rare_name_token,
    "block_name_country": _block("name_country"),
    "block_street_name_token": _block("street_name_token"),
    "block_domain_core": _block("domain_core"),
    "block_union": block_union,
    "blocking_audit": blocking_audit,
    "true_pair_hits": true_pair_hits,
    "parquet_roundtrip": parquet_roundtrip,
    "pair_features": pair_features,
    "indic_wide": indic_wide,
    "indic_source_stats": indic_source_stats,
    "indic_stats_total": indic_stats_total,
    "script_names": script_names,
    "distinct_evaluation": distinct_evaluation,
    "api_name": api_name,
    "api_address": api_address,
    "plain_config": plain_config,
    "head_sample": head_sample,
    "truth_preview": truth_preview,
    "tsv_sources": tsv_sources,
    "training_counts": training_counts,
    "csv_lists": csv_lists,
    "recoded_files": recoded_files,
    "projected_scan": projected_scan,
    "run_stats": run_stats,
    "run_audit_file": run_audit_file,
    "run_source_stats": run_source_stats,
    "combined_summary": combined_summary,
    "submission_files": submission_files,
    "tfidf_cosine": tfidf_cosine,
    **{f"block_{r.name}": _block_extra(r) for r in blocking.EXTRA_RULES},
}

# SQL can't express the transliteration of any text; tests compare these with brute force on a table of their own.
WITHOUT_SQL = {
    "translit_documents": translit_documents,
    "select_representation_documents": select_representation_documents,
}

# SQL ------------------------------------------------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
SUFFIXES = "|".join(k.replace(".", "[.]") for k in LEGAL_SUFFIXES)
LABELS = "(?:" + "|".join(UNIT_LABELS) + ")"
NUM = r"\b\d+(?:[-/]\d+)*\b"
POST = r"(?i)\b\d{5}(?:[-\s]\d{4})?\b|\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"
UNITS = rf"(?i)\b{LABELS}\s*[\w-]+\b"
STATE = rf"(?i)\b(?:{'|'.join(STATES)})\b"


def clean(c: str) -> str:
    return rf"trim(regexp_replace(replace(lower(replace(coalesce({c}, ''), '&', 'and')), 'ß', 'ss'), '\s+', ' ', 'g'))"


def name_sql(rows: str) -> str:
    """Name features of a table of records with ASCII names, lists joined."""
    bare = rf"regexp_replace(regexp_extract(c, '(?:^|{NOT_W})({SUFFIXES})\s*$', 1), '^\.+|\.+$', '', 'g')"
    forms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEGAL_SUFFIXES.items())
    dom = r"regexp_extract(lower(n), '\b[\w-]+\.[a-z]{2,}(?:\.[a-z]{2,})?\b', 0)"
    return rf"""SELECT *, array_to_string(regexp_extract_all(c, '{W}+'), ' ') AS name_tokens,
        trim(regexp_replace(regexp_replace(c, '(^|{NOT_W})(?:{SUFFIXES})\s*$', '\1'), '\s+', ' ', 'g')) AS name_core,
        CASE {bare} {forms} ELSE {bare} END AS legal_suffix, {dom} AS domain, regexp_replace({dom}, '\.[^.]*$', '') AS domain_core,
        CAST(regexp_matches(lower(n), '\b(?:d/b/a|doing business as)\b') AS INT) AS has_dba, CAST(regexp_matches(lower(n), '\bf/k/a\b|formerly known as') AS INT) AS has_fka,
        CAST(regexp_matches(lower(n), '\ba/k/a\b|also known as') AS INT) AS has_aka, array_to_string(regexp_extract_all(n, '{NUM}'), ' ') AS name_numbers, {dom} <> '' AS is_domain_like
    FROM (SELECT *, coalesce(business_name, '') AS n, {clean('business_name')} AS c FROM {rows})"""


def address_sql(rows: str) -> str:
    keys = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
    nums = rf"array_to_string(regexp_extract_all(a, '{NUM}'), ' ')"
    split = rf"regexp_replace({nums}, '[-/]', ' ', 'g')"
    return rf"""SELECT *, {clean('business_address')} AS address_clean, {split} AS address_numbers,
        coalesce(list_filter(string_split({split}, ' '), lambda x: len(x) BETWEEN 1 AND 4)[1], string_split({split}, ' ')[1], '') AS street_number,
        regexp_replace(regexp_extract(a, '{UNITS}', 0), '(?i)^{LABELS}\s*', '') AS unit_number,
        upper(regexp_replace(regexp_extract(a, '{POST}', 0), '[-\s]', '', 'g')) AS postal_code,
        upper(coalesce(list_filter({keys}, lambda s: list_contains(regexp_extract_all(lower(a), '{STATE}'), s))[1], '')) AS state_code,
        array_to_string(list_filter(list_transform(string_split({clean("regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '" + NUM + "', '', 'g'), '" + POST + "', '', 'g'), '" + STATE + "', '', 'g'), '" + UNITS + "', '', 'g')")}, ' '),
            lambda x: regexp_replace(x, '^{NOT_W}+|{NOT_W}+$', '', 'g')), lambda x: len(x) > 1), ' ') AS city_tokens
    FROM (SELECT *, coalesce(business_address, '') AS a FROM {rows})"""


ALL = f"WITH {A.SQL_S1}, {A.SQL_S2}, {A.SQL_S3}, {A.SQL_TRUTH}"
UNION = "u AS (SELECT 'S1' AS source, * FROM s1 UNION ALL SELECT 'S2', * FROM s2 UNION ALL SELECT 'S3', * FROM s3)"
CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items())
CODED = f"CASE lower(trim(country)) {CODES} ELSE country END"


def _name_query(fields: str) -> str:
    return f"{ALL}, f AS ({name_sql('s2')}) SELECT entity_id, {fields} FROM f"


def _address_query(field: str) -> str:
    return f"{ALL}, f AS ({address_sql('s3')}) SELECT entity_id, {field} FROM f"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


SIDES = f"""{ALL}, n1 AS ({name_sql('s1')}), n2 AS ({name_sql('s2')}), a1 AS ({address_sql('s1')}), a2 AS ({address_sql('s2')}),
r1 AS (SELECT n1.*, nullif(street_number, '') AS street FROM n1 JOIN (SELECT entity_id, street_number FROM a1) USING (entity_id)),
r2 AS (SELECT n2.*, nullif(street_number, '') AS street FROM n2 JOIN (SELECT entity_id, street_number FROM a2) USING (entity_id)),
e1 AS (SELECT entity_id, country, street, unnest(string_split(name_tokens, ' ')) AS t FROM r1 WHERE name_tokens <> ''),
e2 AS (SELECT entity_id, country, street, unnest(string_split(name_tokens, ' ')) AS t FROM r2 WHERE name_tokens <> ''),
d1 AS (SELECT entity_id, nullif(domain_core, '') AS d FROM r1), d2 AS (SELECT entity_id, nullif(domain_core, '') AS d FROM r2)"""


def _pairs(left: str, right: str, keys: str) -> str:
    return f"""SELECT DISTINCT l.entity_id AS S1_id, r.entity_id AS S2_id FROM {left} l JOIN {right} r USING ({keys})
        JOIN (SELECT {keys} FROM {right} GROUP BY {keys} HAVING count(*) <= 1000) v USING ({keys})"""


PAIRS = {
    "rare_name_token": _pairs("e1", "e2", "t"), "name_country": _pairs("e1", "e2", "t, country"),
    "street_name_token": _pairs("e1", "e2", "street, t"), "domain_core": _pairs("d1", "d2", "d"),
}
UNION_PAIRS = " UNION ".join(PAIRS.values())
BENCH = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS entity_id, unnest(regexp_extract_all({clean('text')}, '{W}+')) AS t FROM benchmark),
d AS (SELECT CAST(doc_id AS VARCHAR) AS entity_id, unnest(regexp_extract_all({clean('text')}, '{W}+')) AS t FROM documents)"""
RECORD = f"""r AS (SELECT f.* EXCLUDE (n, c), c AS name_clean, address_clean, address_numbers, street_number, unit_number, postal_code, state_code, city_tokens
    FROM ({name_sql('u')}) f JOIN (SELECT entity_id, address_clean, address_numbers, street_number, unit_number, postal_code, state_code, city_tokens FROM ({address_sql('u')})) USING (entity_id))"""

SQL = {
    "norm_text": f"SELECT doc_id, {clean('text')} AS text_norm FROM documents",
    "name_tokens": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({clean('text')}, '{W}+')) AS token FROM documents) GROUP BY token",
    "legal_suffix": _name_query("c AS name_clean, legal_suffix, name_core"),
    "domain_features": r"SELECT page_id, domain, regexp_replace(domain, '\.[^.]*$', '') AS domain_core, domain <> '' AS is_domain_like FROM (SELECT page_id, regexp_extract(lower(coalesce(url, '')), '\b[\w-]+\.[a-z]{2,}(?:\.[a-z]{2,})?\b', 0) AS domain FROM pages)",
    "name_domain": _name_query("domain, domain_core, is_domain_like"),
    "dba_flags": _name_query("has_dba, has_fka, has_aka"),
    "name_numbers": _name_query("name_numbers"),
    **{k: _address_query(k) for k in ("address_numbers", "street_number", "postal_code", "unit_number", "state_code", "city_tokens")},
    "country_code": f"{ALL} SELECT entity_id, {CODED} AS country FROM s1",
    "script_flag": f"SELECT id, CAST(regexp_matches(s, '[\\x{{0900}}-\\x{{0D7F}}]') AS INT) AS has_nonlatin FROM (VALUES {_values(enumerate(SAMPLES))}) AS v(id, s)",
    "script_flag_documents": r"SELECT doc_id, CAST(regexp_matches(coalesce(text, ''), '[\x{0900}-\x{0D7F}]') AS INT) AS has_nonlatin FROM documents",
    "translit_names": f"SELECT id, s AS translit FROM (VALUES {_values(enumerate(SPELLED))}) AS v(id, s)",
    "select_representation": f"SELECT id, lower(s) AS name_clean, array_to_string(regexp_extract_all(lower(s), '{W}+'), ' ') AS name_tokens, CASE WHEN id < 10 THEN array_to_string(regexp_extract_all(lower(s), '{W}+'), ' ') END AS name_tokens_translit FROM (VALUES {_values(enumerate(SPELLED))}) AS v(id, s)",
    "preprocess_record": f"{ALL}, u AS (SELECT * FROM s1), {RECORD} SELECT * EXCLUDE (k) FROM r",
    "preprocess_wide": f"{ALL}, u AS (SELECT * FROM s1), {RECORD} SELECT entity_id, {CODED} AS country, 0 AS name_has_nonlatin, business_name AS business_name_translit, name_core, name_core AS name_core_native, '' AS name_core_translit, address_numbers AS address_numbers_native, 0 AS n_translit, TRUE AS no_tokens_translit FROM r",
    "source_stats": f"{ALL}, {UNION} SELECT source, count(*) AS n_rows, CAST(0 AS BIGINT) AS nonlatin_names, CAST(0 AS BIGINT) AS nonlatin_addresses, CAST(0 AS BIGINT) AS names_transliterated, CAST(0 AS BIGINT) AS addresses_transliterated FROM u GROUP BY source",
    "stats_total": f"{ALL}, {UNION} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS nonlatin_names, CAST(0 AS BIGINT) AS nonlatin_addresses, CAST(0 AS BIGINT) AS names_transliterated, CAST(0 AS BIGINT) AS addresses_transliterated FROM u",
    "feature_summary": f"{ALL}, {UNION}, f AS ({name_sql('u')}) SELECT count(*) AS n_rows, count(domain) AS domains, count(*) FILTER (domain <> '') AS domains_filled, CAST(sum(has_fka) AS BIGINT) AS fka, CAST(sum(has_dba) AS BIGINT) AS dba, CAST(sum(has_aka) AS BIGINT) AS aka FROM f",
    "suffix_top10": f"{ALL}, {UNION}, f AS ({name_sql('u')}) SELECT legal_suffix, count(*) AS n FROM f GROUP BY legal_suffix ORDER BY n DESC, legal_suffix LIMIT 10",
    "union_sources": f"{ALL}, {UNION} SELECT source, entity_id, business_name, business_address, country FROM u",
    "sample_rows": f"{ALL} SELECT * EXCLUDE (k) FROM (SELECT 'S1' AS source, * FROM s1 ORDER BY entity_id LIMIT 100) UNION ALL SELECT * EXCLUDE (k) FROM (SELECT 'S2' AS source, * FROM s2 ORDER BY entity_id LIMIT 100)",
    "ground_truth_pairs": f"{ALL} SELECT DISTINCT S1_id, S2_id FROM truth",
    "key_counts": f"{SIDES} SELECT t AS name_tokens, country, count(*) AS key_count FROM e2 WHERE country IS NOT NULL GROUP BY t, country",
    "freq_cap_keys": f"{BENCH} SELECT t AS name_tokens, count(*) AS key_count FROM d GROUP BY t HAVING count(*) <= 1000",
    "block_rare_name_token": f"{BENCH} {_pairs('b', 'd', 't')}",
    "block_name_country": f"{SIDES} {PAIRS['name_country']}",
    "block_street_name_token": f"{SIDES} {PAIRS['street_name_token']}",
    "block_domain_core": f"{SIDES} {PAIRS['domain_core']}",
    "block_union": f"{SIDES} {UNION_PAIRS}",
    "blocking_audit": f"""{SIDES}, p AS ({' UNION ALL '.join(f"SELECT '{k}' AS RULE, * FROM ({q})" for k, q in PAIRS.items())} UNION ALL SELECT 'UNION_ALL', * FROM ({UNION_PAIRS}))
SELECT RULE, count(*) AS CANDIDATES, count(y) AS TRUE_PAIRS_CAUGHT, round(count(y) / (SELECT count(*) FROM truth), 9) AS RECALL FROM p LEFT JOIN (SELECT *, 1 AS y FROM truth) USING (S1_id, S2_id) GROUP BY RULE""",
    "true_pair_hits": f"{SIDES} SELECT * FROM ({UNION_PAIRS}) INTERSECT SELECT S1_id, S2_id FROM truth",
    "parquet_roundtrip": f"{SIDES} {PAIRS['street_name_token']}",
    "pair_features": f"""{ALL}, u AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), {RECORD},
p AS (SELECT S1_id, S2_id, a.name_core AS x, b.name_core AS y, list_distinct(list_filter(string_split(a.name_tokens, ' '), lambda t: t <> '')) AS s, list_distinct(list_filter(string_split(b.name_tokens, ' '), lambda t: t <> '')) AS t,
    a.postal_code AS pa, b.postal_code AS pb, a.street_number AS na, b.street_number AS nb, a.legal_suffix AS la, b.legal_suffix AS lb FROM truth JOIN r a ON a.entity_id = S1_id JOIN r b ON b.entity_id = S2_id)
SELECT S1_id, S2_id, round(CASE WHEN greatest(len(x), len(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y)::DOUBLE / greatest(len(x), len(y)) END, 9) AS name_edit,
    round(CASE WHEN len(list_distinct(s || t)) = 0 THEN 0.0 ELSE len(list_intersect(s, t))::DOUBLE / len(list_distinct(s || t)) END, 9) AS name_jaccard,
    CAST(pa = pb AND pa <> '' AS DOUBLE) AS same_postal_code, CAST(na = nb AND na <> '' AS DOUBLE) AS same_street_number, CAST(la = lb AND la <> '' AS DOUBLE) AS same_legal_suffix FROM p""",
}

# Records with Indic words, the files and runs, and the further rules.
STATS = "source, count(*) AS n_rows, CAST({n} AS BIGINT) AS nonlatin_names, CAST({a} AS BIGINT) AS nonlatin_addresses, CAST({tn} AS BIGINT) AS names_transliterated, CAST({ta} AS BIGINT) AS addresses_transliterated"
COUNTED = STATS.format(n="sum(name_has_nonlatin)", a="sum(address_has_nonlatin)", tn="count(*) FILTER (business_name_translit <> business_name)", ta="count(*) FILTER (business_address_translit <> business_address)")
NO_INDIC = STATS.format(n="0", a="0", tn="0", ta="0")
INDIC = f"WITH {A.SQL_S1}, {A.sql_indic('i2', 0)}, {A.sql_indic('i3', 1)}, iu AS (SELECT 'S2' AS source, * FROM i2 UNION ALL SELECT 'S3', * FROM i3)"
NAMED = "name_clean name_tokens name_core legal_suffix domain domain_core name_numbers".split()
PLACED = "address_clean address_numbers street_number unit_number postal_code state_code city_tokens".split()
FLAGGED = "has_dba has_fka has_aka is_domain_like".split()
SCRIPT_OF = " ".join(f"WHEN unicode(business_name) BETWEEN {0x900 + 0x80 * k} AND {0x97F + 0x80 * k} THEN '{x}'" for k, x in enumerate("DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM".split()))


def _indic_wide() -> str:
    """Features of the native texts and of the selected ones, which are the transliterated ones throughout, as these are
    the texts themselves where nothing is Indic."""
    used = lambda k: "name_has_nonlatin" if k in NAMED else "address_has_nonlatin"
    none = lambda k: "NULL" if k in ("name_tokens", "name_numbers") else "''"
    main = ", ".join(f"s.{k}" for k in (*NAMED, *FLAGGED)) + ", " + ", ".join(f"t.{k}" for k in PLACED)
    native = ", ".join(f"n.{k} AS {k}_native" for k in NAMED) + ", " + ", ".join(f"m.{k} AS {k}_native" for k in PLACED)
    translit = ", ".join(f"CASE WHEN {used(k)} = 1 THEN {'s' if k in NAMED else 't'}.{k} ELSE {none(k)} END AS {k}_translit" for k in (*NAMED, *PLACED))
    named = lambda rows: f"(SELECT * EXCLUDE (c), c AS name_clean FROM ({name_sql(rows)}))"
    return f"""{INDIC}, said AS (SELECT entity_id, business_name_translit AS business_name, business_address_translit AS business_address FROM i2),
own AS (SELECT entity_id, business_name, business_address FROM i2)
SELECT i2.entity_id, i2.business_name, i2.business_address, {CODED.replace('country', 'i2.country')} AS country, name_has_nonlatin, address_has_nonlatin,
    business_name_translit, business_address_translit, {main}, {native}, {translit}
FROM i2 JOIN {named('said')} s USING (entity_id) JOIN ({address_sql('said')}) t USING (entity_id) JOIN {named('own')} n USING (entity_id) JOIN ({address_sql('own')}) m USING (entity_id)"""


# Blank texts come back from a file as nulls.
FILES = f"{ALL}, u AS (SELECT 'S1' AS source, * FROM s1 UNION ALL SELECT 'S2', * FROM s2 UNION ALL SELECT 'S3', * FROM s3)"
E_CITY = "SELECT entity_id, unnest(string_split(city_tokens, ' ')) AS t, nullif(postal_code, '') AS p FROM ({a}) WHERE city_tokens <> ''"
E_GRAM = "SELECT entity_id, unnest(list_distinct(list_transform(generate_series(1, greatest(len(name_core) - 3, 1)), lambda i: substr(name_core, i, 4)))) AS t FROM ({n}) WHERE name_core <> ''"
CITY = f"{ALL}, e1 AS ({E_CITY.format(a=address_sql('s1'))}), e2 AS ({E_CITY.format(a=address_sql('s2'))})"
GRAM = f"{ALL}, e1 AS ({E_GRAM.format(n=name_sql('s1'))}), e2 AS ({E_GRAM.format(n=name_sql('s2'))})"

SQL |= {
    "indic_wide": _indic_wide(),
    "indic_source_stats": f"{INDIC} SELECT {COUNTED} FROM iu GROUP BY source",
    "indic_stats_total": f"{INDIC} SELECT {COUNTED.removeprefix('source, ')} FROM iu",
    "script_names": f"{INDIC} SELECT entity_id, CASE {SCRIPT_OF} END AS script, lower(CASE {SCRIPT_OF} END) AS scheme FROM i2",
    "distinct_evaluation": f"{INDIC} SELECT entity_id, business_name_translit, business_address_translit FROM i2",
    "api_name": _name_query("c AS name_clean, legal_suffix, name_core, name_tokens, domain, has_dba, name_numbers"),
    "api_address": f"{ALL}, f AS ({address_sql('s3')}) SELECT entity_id, address_numbers, street_number, unit_number, postal_code, state_code, city_tokens, address_clean, state_code AS state FROM f",
    "plain_config": f"{ALL}, f AS ({name_sql('s1')}) SELECT 'S1' AS source, entity_id, name_core, business_address AS address_clean, '' AS street_number, 0 AS n_city FROM f",
    "head_sample": f"{ALL}, f AS ({name_sql('s1')}) SELECT c AS name_clean, legal_suffix, domain FROM f ORDER BY entity_id LIMIT 3",
    "truth_preview": f"{ALL} SELECT DISTINCT S1_id, S2_id FROM truth ORDER BY S2_id LIMIT 5",
    "tsv_sources": f"{FILES} SELECT source, entity_id, business_name, nullif(business_address, '') AS business_address, country FROM u",
    "training_counts": f"{FILES} SELECT source, count(*) AS n_rows, count(DISTINCT entity_id) AS n_ids FROM u GROUP BY source UNION ALL SELECT 'ground_truth', count(*), count(DISTINCT S1_id) FROM truth",
    "csv_lists": f"{ALL}, n AS ({name_sql('s2')}), a AS ({address_sql('s2')}) SELECT entity_id, name_core, name_tokens, a.city_tokens FROM n JOIN a USING (entity_id)",
    "recoded_files": f"{ALL} SELECT entity_id, {CODED} AS country, 1 AS n_skipped FROM s1",
    "projected_scan": f"{ALL} SELECT 'S1' AS source, entity_id, country FROM s1 UNION ALL SELECT 'S2', entity_id, country FROM s2",
    "run_stats": f"{FILES} SELECT {NO_INDIC} FROM u GROUP BY source",
    "run_source_stats": f"{FILES} SELECT {NO_INDIC} FROM u WHERE source = 'S2' GROUP BY source",
    "combined_summary": SQL["feature_summary"],
    "submission_files": f"{SIDES}, p AS ({PAIRS['street_name_token']}) SELECT 'candidate_pairs' AS source, * FROM p UNION ALL SELECT 'matching_results', p.* FROM p JOIN truth USING (S1_id, S2_id)",
    "block_address_token": f"{CITY} {_pairs('e1', 'e2', 't')}",
    "block_postal_city": f"{CITY} {_pairs('e1', 'e2', 'p, t')}",
    "block_name_gram": f"{GRAM} {_pairs('e1', 'e2', 't')}",
    "tfidf_cosine": f"""{ALL}, n AS (SELECT 1 AS side, * FROM ({name_sql('s1')}) UNION ALL SELECT 2, * FROM ({name_sql('s2')})),
c AS (SELECT side, entity_id, t, count(*) AS tf FROM (SELECT side, entity_id, unnest(string_split(name_tokens, ' ')) AS t FROM n WHERE name_tokens <> '') GROUP BY ALL),
i AS (SELECT t, ln(((SELECT count(*) FROM n) + 1.0)::DOUBLE / (count(*) + 1)) AS idf FROM c GROUP BY t),
w AS (SELECT side, entity_id, t, tf * idf AS w FROM c JOIN i USING (t)),
z AS (SELECT side, entity_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
d AS (SELECT S1_id, S2_id, sum(a.w * b.w) AS dot FROM truth JOIN w a ON a.side = 1 AND a.entity_id = S1_id JOIN w b ON b.side = 2 AND b.entity_id = S2_id AND b.t = a.t GROUP BY ALL)
SELECT S1_id, S2_id, round(coalesce(dot / (x.norm * y.norm), 0.0), 6) AS cosine FROM truth LEFT JOIN d USING (S1_id, S2_id)
LEFT JOIN z x ON x.side = 1 AND x.entity_id = S1_id LEFT JOIN z y ON y.side = 2 AND y.entity_id = S2_id""",
}
CODED_SIDES = SQL["blocking_audit"].replace("SELECT entity_id, country, street", f"SELECT entity_id, {CODED} AS country, street")
SQL["run_audit_file"] = f"SELECT RULE, CANDIDATES, TRUE_PAIRS_CAUGHT FROM ({CODED_SIDES})"

assert set(SQL) == set(QUERIES)
