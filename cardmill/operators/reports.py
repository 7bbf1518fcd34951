"""Reports that put aggregates side by side: checks, remedies, calibration, readiness, import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.operators import card_rules as R
from cardmill.operators import review_logs as L

#: check -> rules that must not be broken
CHECKS = {
    "atomicity": ("ATOMICITY_REVIEW", "COGNITIVE_LOAD"), "reading_time": ("FRONT_TOO_LONG",), "format_appropriateness": ("CLOZE_FORMAT", "TYPE_FORMAT_MISMATCH", "REVERSE_FORMAT"),
    "pre_understanding": ("MISSING_EXPLANATION",), "explanation_substance": ("THIN_EXPLANATION",), "prompt_specificity": ("GENERIC_PROMPT",), "source_grounding": ("MISSING_SOURCE",), "enrichment_labeling": ("UNLABELED_ENRICHMENT",),
}


def audit_checks(cards: DataFrame) -> DataFrame:
    """(check, passed, n_cards): named checks and the cards that fail them. One pass."""
    bad = {code: F.coalesce(test, F.lit(False)) for code, _, test, _ in R.card_rules()}
    failing = [F.count_if(_any([bad[c] for c in codes])).alias(name) for name, codes in CHECKS.items()]
    row = R.measured(cards).agg(*failing)
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("passed"), F.col(n).alias("n_cards")) for n in CHECKS))
    return row.select(F.inline(pairs))


def _any(tests: list):
    made = tests[0]
    for test in tests[1:]:
        made = made | test
    return made


def remedies(cards: DataFrame) -> DataFrame:
    """(action, n): distinct remedies of all broken rules, most needed first."""
    return R.violations(cards).groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action")


def calibration_report(approvals: DataFrame | None, reviews: DataFrame | None) -> DataFrame:
    """One row: approval and retention, each ``not-provided`` without its log.

    approval_metrics with rejection_reasons and edit_hotspots (arrays of name and n,
    most first), retention_metrics with calibration_buckets (array, in order). Counts of
    invalid rows are told apart by the log's name. Logs without rows give zero counts,
    null rates and empty arrays.
    """
    spark = (approvals if approvals is not None else reviews).sparkSession
    status = lambda log: F.lit("ok" if log is not None else "not-provided")
    row = spark.range(1).select(status(approvals).alias("approval_status"), status(reviews).alias("retention_status"))
    parts = []
    if approvals is not None:
        parts.append(L.approval_metrics(approvals).withColumnRenamed("invalid_rows", "approval_invalid_rows"))
        parts.append(_most_first(L.rejection_reasons(approvals), "reason", "rejection_reasons"))
        parts.append(_most_first(L.edited_fields(approvals), "field", "edit_hotspots"))
    if reviews is not None:
        parts.append(L.retention_metrics(reviews).withColumnRenamed("invalid_rows", "retention_invalid_rows"))
        bucket = F.struct("predicted_range", "mean_predicted", "mean_actual", "n")
        parts.append(L.calibration_buckets(reviews).agg(F.array_sort(F.collect_list(bucket)).alias("calibration_buckets")))
    for part in parts:
        row = row.crossJoin(part)  # one row by one row
    return row


def _most_first(counts: DataFrame, name: str, alias: str) -> DataFrame:
    """One row: an array of (name, n) by n, most first, ties by name. Reasons and fields
    of a log are few kinds, ten calibration ranges at most."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(name).alias("name"))))
    return counts.agg(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"), (-x["m"]).alias("n"))).alias(alias))


def all_violations(cards: DataFrame, decks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(rank, card_id, code, level, action): everything an audit finds, in one form. The
    sources come in a fixed order: rules of cards (0), of the deck (1), of its settings,
    coverage and rows (2, ``files`` with code and level), cards of equal sides (3)."""
    none = F.lit(None).cast("string")
    made = R.violations(cards).select(F.lit(0).alias("rank"), "card_id", "code", "level", "action")
    made = made.unionByName(decks.select(F.lit(1).alias("rank"), none.alias("card_id"), "code", "level", none.alias("action")))
    if files is not None:
        made = made.unionByName(files.select(F.lit(2).alias("rank"), none.alias("card_id"), "code", "level", none.alias("action")))
    return made.unionByName(R.duplicate_violations(cards).select(F.lit(3).alias("rank"), "card_id", "code", "level", "action"))


def readiness(cards: DataFrame, n_deferred: int, n_unconverted: int) -> DataFrame:
    """One row: the audit's verdict and whether a deck may be imported."""
    row = R.audit_summary(cards).select("cards", "errors", "verdict")
    return row.withColumn("deferred_units", F.lit(n_deferred)).withColumn("unconverted_rows", F.lit(n_unconverted)).withColumn("ready", (F.col("verdict") == "PASS") & F.lit(n_deferred == 0 and n_unconverted == 0))


def import_report(notes: DataFrame, existing: DataFrame) -> DataFrame:
    """(deck, notes, known, pending): per deck the notes whose id the target has, and the rest."""
    known = existing.select("id").where("id is not null").distinct().withColumn("known", F.lit(True))
    joined = notes.join(known, "id", "left")
    return joined.groupBy("deck").agg(F.count("*").alias("notes"), F.count("known").alias("known"), F.count_if(F.col("known").isNull()).alias("pending"))


def field_references(template: str, fields: list[str]) -> list[str]:
    """Fields that a card template of a note layout uses, without the built-in ones."""
    import re

    built_in = {"FrontSide", "Tags", "Type", "Deck", "Subdeck", "Card", "CardFlag"}
    used = [m.split(":")[-1].strip() for m in re.findall(r"\{\{[#^/]?([^{}]+)\}\}", template)]
    return [f for f in dict.fromkeys(used) if f not in built_in and (not fields or f in fields)]
