"""From source files to preprocessed records and an audit of the blocking rules."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.blocking import CAP, RULES, BlockingRule, audit
from ..operators.records import PreprocessingConfig, feature_summary, preprocess, preprocess_all, source_stats, suffix_top, union_sources
from ..sources.readers import SOURCE_FILES, TRUTH_FILE, read_source, read_sources, read_truth
from ..sources.writers import save_combined, write_audit, write_records, write_text_table


@dataclass(frozen=True)
class RunConfig:
    data_dir: str
    output_dir: str
    sample_rows: int | None = None
    csv: bool = False
    audit: bool = False
    cap: int = CAP
    rules: Sequence[BlockingRule] = RULES


def run_source(spark: SparkSession, path: str, name: str, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Preprocessed records of one source with its name, and their statistics."""
    df = union_sources({name: preprocess(read_source(spark, path, sample))})
    return df, source_stats(df)


def preprocess_files(spark: SparkSession, data_dir: str, out: str, config: PreprocessingConfig = PreprocessingConfig()) -> tuple[DataFrame, DataFrame]:
    """The plain run: the three sources of data_dir under `config`, combined and written as text under out; the summary
    and the most frequent legal suffixes."""
    return save_combined(preprocess_all(read_sources(spark, data_dir), config), out)


def run(spark: SparkSession, config: RunConfig) -> dict[str, DataFrame]:
    """Preprocess all sources in one plan, write them, and report; the audit covers S1 and S2."""
    frames = {k: preprocess(read_source(spark, f"{config.data_dir}/{f}", config.sample_rows)) for k, f in SOURCE_FILES.items()}
    records = write_records(union_sources(frames), f"{config.output_dir}/preprocessed")
    if config.csv:
        write_text_table(records.drop("source"), f"{config.output_dir}/preprocessed_csv")
    out = {"records": records, "stats": source_stats(records), "suffixes": suffix_top(records), "summary": feature_summary(records)}
    if config.audit:
        of = {k: records.where(records["source"] == k) for k in ("S1", "S2")}
        out["audit"] = audit(of["S1"], of["S2"], read_truth(spark, f"{config.data_dir}/{TRUTH_FILE}"), config.rules, config.cap)
        write_audit(out["audit"], f"{config.output_dir}/blocking_audit_results")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="linkspark")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--sample-rows", type=int)
    p.add_argument("--csv", action="store_true", help="also write comma-separated text")
    p.add_argument("--audit", action="store_true", help="audit the blocking rules against the ground truth")
    p.add_argument("--cap", type=int, default=CAP, help="rows of S2 that a key may have at most")
    a = p.parse_args(argv)
    if a.sample_rows is not None and a.sample_rows <= 0 or a.cap <= 0:
        p.error("--sample-rows and --cap must be positive")
    spark = SparkSession.builder.appName("linkspark").getOrCreate()
    for name, df in run(spark, RunConfig(a.data_dir, a.output_dir, a.sample_rows, a.csv, a.audit, a.cap)).items():
        if name != "records":
            print(name)
            df.show(truncate=False)


if __name__ == "__main__":
    main()
