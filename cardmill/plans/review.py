"""Queries over approval and review logs."""

from __future__ import annotations

from cardmill.operators import review_logs as R
from cardmill.sources.tables import table

QUERIES = {
    "approval_metrics": lambda s, d: R.approval_metrics(table(s, d, "approval_log")),
    "rejection_reasons": lambda s, d: R.rejection_reasons(table(s, d, "approval_log")),
    "edited_fields": lambda s, d: R.edited_fields(table(s, d, "approval_log")),
    "review_rows": lambda s, d: R.review_rows(table(s, d, "review_log")),
    "retention_metrics": lambda s, d: R.retention_metrics(table(s, d, "review_log")),
    "calibration_buckets": lambda s, d: R.calibration_buckets(table(s, d, "review_log")),
}

_TRIM = "trim(coalesce({0}, ''), e' \\t\\r\\n\\f\\v ')"
_DECISION = "lower(" + _TRIM.format("decision") + ")"
_NUMBERS = "with n as (select card_id, " + ", ".join(f"case when regexp_full_match({_TRIM.format(c)}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast({_TRIM.format(c)} as double) end {a}" for c, a in (("interval_days", "interval_days"), ("predicted_retention", "predicted"), ("actual_recalled", "actual"))) + """ from review_log),
m as (select *, interval_days is null or predicted is null or actual is null bad from n),
r as (select card_id, interval_days, predicted, actual, case when bad then 'invalid numeric retention row' end error, not bad and interval_days > 21 mature,
  case when not bad and interval_days > 21 then round(actual - predicted, 4) end calibration_error from m)
"""

SQL = {
    "approval_metrics": f"""
with d as (select {_DECISION} d from approval_log),
a as (select count(*) filter (d in ('approved', 'edited', 'rejected')) total, count(*) filter (d = 'approved') approved, count(*) filter (d = 'edited') edited,
  count(*) filter (d = 'rejected') rejected, count(*) filter (d not in ('approved', 'edited', 'rejected')) invalid_rows from d)
select *, round(approved / nullif(total, 0), 4) first_pass_approval_rate, round(approved / nullif(total, 0), 4) >= 0.9 meets_target from a""",
    "rejection_reasons": f"select {_TRIM.format('reason')} reason, count(*) n from approval_log where {_DECISION} = 'rejected' group by 1",
    "edited_fields": f"""
with f as (select {_TRIM.format("unnest(string_split(coalesce(edited_fields, ''), ';'))")} field from approval_log where {_DECISION} = 'edited')
select field, count(*) n from f where field <> '' group by 1""",
    "review_rows": _NUMBERS + "select * from r",
    "retention_metrics": _NUMBERS + """
select count(*) filter (mature) mature_reviews, count(error) invalid_rows, round(avg(calibration_error), 4) mean_calibration_error,
  round(avg(case when mature then (predicted - actual) * (predicted - actual) end), 4) brier_score from r""",
    "calibration_buckets": _NUMBERS + """
, b as (select least(greatest(trunc(predicted * 10)::int, 0), 9) b, predicted, actual from r where mature)
select printf('%.1f-%.1f', b / 10, (b + 1) / 10) predicted_range, round(avg(predicted), 4) mean_predicted, round(avg(actual), 4) mean_actual, count(*) n from b group by b""",
}
