"""Command line: run catalogue queries and write their results.

    python -m shiftloom.plans.jobs list
    python -m shiftloom.plans.jobs info [--family NAME]
    python -m shiftloom.plans.jobs run shift_sft_dpo --data DIR --output PATH [--format parquet|csv|json]
    python -m shiftloom.plans.jobs battery|generations|logit-lens|step-analysis|taxonomy|reports --data DIR --output DIR
        [--format ..] [--category PREFIX] [--lexicon PARQUET]

The last form writes each of the command's tables to a folder of its name below the output.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import taxonomy
from ..sources import registry
from ..sources.tables import json_rows, write_csv, write_parquet
from . import catalog
from .catalog import QUERIES

#: The tables that a command writes.
COMMANDS = {
    "battery": ("battery_summary", "shift_sft_dpo", "id_scores", "metrics_wide"),
    "generations": ("missing_passages", "first_words", "prompt_words", "generation_metrics", "concept_shift", "embedded_passages"),
    "logit-lens": ("lens_rows", "lens_frequent", "lens_peak", "lens_words"),
    "step-analysis": ("step_metrics", "step_words", "onset_curve", "lag_pair", "curve_legend"),
    "taxonomy": ("taxonomy_pairs", "taxonomy_pct", "taxonomy_crosstab"),
    "reports": ("formation_report", "shift_report", "metrics_report", "pairs_report"),
}


def written(result: DataFrame, path: str, kind: str) -> None:
    if kind == "csv":
        write_csv(result, path)
    elif kind == "json":
        json_rows(result).write.mode("overwrite").text(path)
    else:
        write_parquet(result, path)


def info(family: str | None = None) -> list[str]:
    """Lines about the families that come with the library."""
    out = []
    for name, stages in registry.FAMILIES.items():
        if family in (None, name):
            out.append(f"{name}{' (default)' if name == registry.DEFAULT_FAMILY else ''}: {len(stages)} stages")
            out += [f"  {stage:<6} {model}" for stage, model in stages.items()]
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shiftloom")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    commands.add_parser("info", help="families of checkpoints").add_argument("--family", choices=sorted(registry.FAMILIES))
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query", choices=sorted(QUERIES))
    for name, tables in COMMANDS.items():
        each = commands.add_parser(name, help=", ".join(tables))
        each.add_argument("--category", help="only rows whose label begins so")
        each.add_argument("--lexicon", help="Parquet of word, pos, zipf (taxonomy)")
    for each in (run, *(commands.choices[name] for name in COMMANDS)):
        each.add_argument("--data", required=True)
        each.add_argument("--output", required=True)
        each.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.command == "info":
        print("\n".join(info(args.family)))
        return 0
    spark = SparkSession.builder.appName(f"shiftloom {args.command}").getOrCreate()
    if args.command == "run":
        written(QUERIES[args.query](spark, args.data), args.output, args.format)
        return 0
    for name in COMMANDS[args.command]:
        if name == "taxonomy_pairs" and args.lexicon:
            result = catalog.taxonomy_rows(spark, args.data, spark.read.parquet(args.lexicon))
        elif name == "taxonomy_pct" and args.lexicon:
            result = taxonomy.shares(catalog.taxonomy_rows(spark, args.data, spark.read.parquet(args.lexicon)), ["axis"], "displacement_type")
        else:
            result = QUERIES[name](spark, args.data)
        if args.category and "label" in result.columns:
            result = registry.with_prefix(result.withColumn("label", F.col("label").cast("string")), args.category)
        written(result, f"{args.output.rstrip('/')}/{name}", args.format)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
