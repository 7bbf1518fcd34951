"""Scores of approval and review logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import vocabulary as V
from cardmill.sources.tables import BLANKS

DECISIONS = ("approved", "edited", "rejected")


def _tidy(col: Column) -> Column:
    return F.btrim(F.coalesce(col, F.lit("")), F.lit(BLANKS))


def decision(col: Column) -> Column:
    """approved, edited or rejected; null for anything else."""
    low = F.lower(_tidy(col))
    return F.when(low.isin(*DECISIONS), low)


def approval_metrics(log: DataFrame) -> DataFrame:
    """One row: total, approved, edited, rejected, invalid_rows, the share approved
    at first (rounded to 4, null without decisions) and whether it meets the target.
    Every row counts; an unknown or null decision is invalid."""
    made = log.select(decision(F.col("decision")).alias("d"))
    sums = made.agg(
        F.count("d").alias("total"),
        *(F.count_if(F.col("d") == d).alias(d) for d in DECISIONS),
        F.count_if(F.col("d").isNull()).alias("invalid_rows"),
    )
    rate = F.round(F.try_divide(F.col("approved"), F.col("total")), 4)
    return sums.withColumn("first_pass_approval_rate", rate).withColumn("meets_target", rate >= V.APPROVAL_TARGET)


def rejection_reasons(log: DataFrame) -> DataFrame:
    """(reason, n) of rejected rows; a missing reason is the empty one."""
    rejected = log.where(decision(F.col("decision")) == "rejected")
    return rejected.groupBy(_tidy(F.col("reason")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def edited_fields(log: DataFrame) -> DataFrame:
    """(field, n) over the ``;``-joined fields of edited rows, blanks left out."""
    edited = log.where(decision(F.col("decision")) == "edited")
    fields = edited.select(F.explode(F.split(F.coalesce("edited_fields", F.lit("")), ";")).alias("field")).select(_tidy(F.col("field")).alias("field"))
    return fields.where("field <> ''").groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")


def decimal_number(col: Column) -> Column:
    """A decimal number, exponent allowed; null for anything else."""
    bare = F.btrim(col, F.lit(BLANKS))
    return F.when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), bare).try_cast("double")


def review_rows(log: DataFrame) -> DataFrame:
    """The log with its three numbers read, ``error`` where one can't be, and
    calibration_error (rounded to 4) for mature reviews, of more than 21 days.
    Only decimal numbers are read: no suffixes, infinities or NaN."""
    number = lambda name: decimal_number(F.col(name))
    parsed = log.select("card_id", number("interval_days").alias("interval_days"), number("predicted_retention").alias("predicted"), number("actual_recalled").alias("actual"))
    bad = F.col("interval_days").isNull() | F.col("predicted").isNull() | F.col("actual").isNull()
    mature = ~bad & (F.col("interval_days") > V.MATURE_DAYS)
    marked = parsed.withColumn("error", F.when(bad, "invalid numeric retention row")).withColumn("mature", mature)
    return marked.withColumn("calibration_error", F.when(F.col("mature"), F.round(F.col("actual") - F.col("predicted"), 4)))


def retention_metrics(log: DataFrame) -> DataFrame:
    """One row: mature and invalid rows, the mean of the rounded calibration errors
    and the Brier score, both rounded to 4 and null without mature rows."""
    rows = review_rows(log)
    square = F.when(F.col("mature"), F.pow(F.col("predicted") - F.col("actual"), 2))
    return rows.agg(
        F.count_if("mature").alias("mature_reviews"), F.count("error").alias("invalid_rows"),
        F.round(F.avg("calibration_error"), 4).alias("mean_calibration_error"), F.round(F.avg(square), 4).alias("brier_score"),
    )


def bucket(predicted: Column) -> Column:
    return F.least(F.greatest((predicted * 10).cast("int"), F.lit(0)), F.lit(9))


def bucket_label(number: Column) -> Column:
    return F.concat(F.format_string("%.1f", number / 10), F.lit("-"), F.format_string("%.1f", (number + 1) / 10))


def calibration_buckets(log: DataFrame) -> DataFrame:
    """Per tenth of predicted retention: mean predicted, mean actual, n. Empty ones are absent."""
    rows = review_rows(log).where("mature")
    sums = rows.groupBy(bucket(F.col("predicted")).alias("b")).agg(F.round(F.avg("predicted"), 4).alias("mean_predicted"), F.round(F.avg("actual"), 4).alias("mean_actual"), F.count("*").alias("n"))
    return sums.orderBy("b").select(bucket_label(F.col("b")).alias("predicted_range"), "mean_predicted", "mean_actual", "n")
