from cardmill.operators import review_logs as R


def approvals(spark, rows):
    return spark.createDataFrame(rows, "card_id string, decision string, edited_fields string, reason string")


def reviews(spark, rows):
    return spark.createDataFrame([("c", *map(str, r)) for r in rows], "card_id string, interval_days string, predicted_retention string, actual_recalled string")


def test_approval_rate(spark):
    row = R.approval_metrics(approvals(spark, [("a", "approved", "", "")] * 9 + [("b", "rejected", "", "r")])).first()
    assert (row.total, row.first_pass_approval_rate, row.meets_target, row.invalid_rows) == (10, 0.9, True, 0)
    row = R.approval_metrics(approvals(spark, [("a", "approved", "", "")] * 8 + [("b", "rejected", "", "r")] * 2)).first()
    assert (row.first_pass_approval_rate, row.meets_target) == (0.8, False)


def test_empty_and_invalid(spark):
    row = R.approval_metrics(approvals(spark, [])).first()
    assert (row.total, row.first_pass_approval_rate, row.meets_target) == (0, None, None)
    row = R.approval_metrics(approvals(spark, [("a", " APPROVED ", None, None), ("b", "deferred", "", ""), ("c", None, "", "")])).first()
    assert (row.total, row.approved, row.invalid_rows) == (1, 1, 2)


def test_counts_in_order(spark):
    log = approvals(spark, [("a", "rejected", "", "unsupported"), ("b", "rejected", "", "ambiguous"), ("c", "rejected", "", "unsupported"), ("d", "edited", "Front;Back", ""), ("e", "edited", " Front ; ", None), ("f", "edited", None, None)])
    assert [tuple(r) for r in R.rejection_reasons(log).collect()] == [("unsupported", 2), ("ambiguous", 1)]
    assert [tuple(r) for r in R.edited_fields(log).collect()] == [("Front", 2), ("Back", 1)]


def test_retention(spark):
    row = R.retention_metrics(reviews(spark, [(22, 0.8, 1), (30, 0.6, 0), (21, 0.9, 1)])).first()
    assert (row.mature_reviews, row.brier_score) == (2, 0.2)
    made = [tuple(r) for r in R.calibration_buckets(reviews(spark, [(22, 0.8, 1), (30, 0.6, 0), (21, 0.9, 1)])).collect()]
    assert made == [("0.6-0.7", 0.6, 0.0, 1), ("0.8-0.9", 0.8, 1.0, 1)]
    row = R.retention_metrics(reviews(spark, [(20, 0.9, 1), (30, 0.9, 1), (45, 0.9, 0), ("x", "", "nan")])).first()
    assert (row.mature_reviews, row.mean_calibration_error, row.invalid_rows) == (2, -0.4, 1)


def test_bucket_limits(spark):
    made = R.calibration_buckets(reviews(spark, [(30, 1.0, 1), (30, 1.7, 1), (30, -0.2, 0)])).collect()
    assert [(r.predicted_range, r.n) for r in made] == [("0.0-0.1", 1), ("0.9-1.0", 2)]
    row = R.retention_metrics(reviews(spark, [])).first()
    assert (row.mature_reviews, row.brier_score, row.mean_calibration_error) == (0, None, None)
