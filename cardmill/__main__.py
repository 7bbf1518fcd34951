"""Console commands: ``python -m cardmill COMMAND ...``. Each prints one JSON report."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators import card_rules, cards, knowledge, reports, units
from cardmill.sources import documents, facts, sinks


def _planned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    chunks = documents.read_documents(spark, path)
    docs = chunks.select(F.concat_ws(":", "doc_id", "chunk_pos").alias("doc_id"), "text", F.col("source").alias("source_name"))
    return knowledge.plan_knowledge(docs, cards.classify_units(units.parse_units(docs)), F.col("source_name"))


def read(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Documents to chunks as Parquet."""
    documents.read_documents(spark, args.path, args.ocr).write.mode("errorifexists").parquet(args.out)
    return {"chunks": spark.read.parquet(args.out).count()}


def generate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Study texts to a deck in the card CSV format."""
    objectives, planned = _planned(spark, args.path)
    made = cards.build_cards(planned)
    sinks.write_card_csv(made, args.out)
    return {"objectives": objectives.count(), "units": planned.count(), "cards": made.count()}


def audit(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The summary of a deck and all violations by code."""
    rows = sinks.read_card_csv(spark, args.path)
    deck = rows.where("coalesce(row_error, '') <> 'CSV_FIELDS'")
    files = rows.where("row_error is not null").select(F.col("row_error").alias("code"), F.lit("error").alias("level"))
    rules = card_rules.deck_violations(spark, card_rules.Scheduler(), deck.count(), False)
    found = reports.all_violations(deck, rules, files).groupBy("rank", "code", "level").agg(F.count("*").alias("n")).orderBy("rank", F.desc("n"), "code")
    return {"summary": card_rules.audit_summary(deck).first().asDict(), "violations": [r.asDict() for r in found.collect()]}  # a row per code


def calibrate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Approval and retention of logs in CSV."""
    log = lambda path: spark.read.csv(path, header=True) if path else None
    if not (args.approvals or args.reviews):
        raise SystemExit("give --approvals, --reviews or both")
    return reports.calibration_report(log(args.approvals), log(args.reviews)).first().asDict(recursive=True)


def check_facts(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Faults of a JSONL file of facts."""
    found = facts.read_facts(spark, args.path, args.deck, strict=False).select(F.explode_outer("faults").alias("fault"))
    return {r.fault or "sound": r.n for r in found.groupBy("fault").agg(F.count("*").alias("n")).orderBy("fault").collect()}  # a row per fault


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="cardmill")
    commands = made.add_subparsers(dest="command", required=True)
    for name, run, needs_out in (("read", read, True), ("generate", generate, True), ("audit", audit, False), ("facts", check_facts, False)):
        own = commands.add_parser(name, help=run.__doc__)
        own.add_argument("path")
        own.set_defaults(run=run)
        if needs_out:
            own.add_argument("--out", required=True)
        if name == "read":
            own.add_argument("--ocr", action="store_true")
        if name == "facts":
            own.add_argument("--deck", default="")
    own = commands.add_parser("calibrate", help=calibrate.__doc__)
    own.add_argument("--approvals")
    own.add_argument("--reviews")
    own.set_defaults(run=calibrate)
    return made


def main(argv: Sequence[str] | None = None) -> int:
    """0, or 1 where an audit fails."""
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cardmill").getOrCreate()
    report = args.run(spark, args)
    print(json.dumps(report, ensure_ascii=False, indent=2, default=str))
    return int(report.get("summary", {}).get("verdict") == "FAIL")


if __name__ == "__main__":
    sys.exit(main())
