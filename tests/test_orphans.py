"""Orphan references against a plain search, with nulls, ties, repeats and empty tables."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cardmill.operators.orphans import Reference, find_orphans, orphan_report

DAY = dt.datetime(2024, 1, 1)
PARENT = "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, parent string, run int"
CHILD = "rid string, refs array<string>, loaded_at timestamp_ntz, ref_id string, record_id int"


def t(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(parents, children):
    states = {}
    for pid, loaded, gone in parents:
        key = (pid or "").strip().lower()
        if key:
            states.setdefault(key, []).append((loaded, gone))
    firsts = {}
    for rid, _, loaded in children:
        firsts[rid] = min(firsts.get(rid, loaded), loaded)
    out = set()
    for rid, refs, _ in children:
        for ref in refs or []:
            key = (ref or "").strip().lower()
            if not key:
                continue
            rows = states.get(key)
            first = firsts[rid]
            if rows is None:
                status = "missing"
            elif max(rows, key=lambda r: (r[0], r[1]))[1]:
                status = "deleted"
            elif min(r[0] for r in rows) > first:
                status = "late"
            else:
                continue
            out.add((rid, key, status, t(first).strftime("%Y-%m")))
    return out


def run(spark, parents, children):
    p = spark.createDataFrame([(i, t(a), t(0) if g else None, "x", 1) for i, a, g in parents], PARENT)
    c = spark.createDataFrame([(r, refs, t(a), "clash", 7) for r, refs, a in children], CHILD)
    return find_orphans({"unit": p}, [Reference("units", c, "rid", "refs", "unit", True)])


def rows(found):
    return {(r.record_id, r.ref_id, r.status, r.period) for r in found.collect()}


ids = st.sampled_from([f"unit-{n:012x}" for n in range(6)] + ["unit-00000001ffff", "unit-000000010000", " UNIT-000000000001 ", "odd id", "Odd ID", "", "  ", None])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(ids, st.integers(0, 5), st.booleans()), max_size=12),
    st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.lists(ids, max_size=4)), st.integers(0, 5)), max_size=10),
)
def test_equals_a_plain_search(spark, parents, children):
    assert rows(run(spark, parents, children)) == brute(parents, children)


def test_contiguous_runs_and_borders(spark):
    parents = [(f"unit-{n:012x}", 1, False) for n in range(65530, 65545) if n != 65540]
    children = [("r", [f"unit-{n:012x}" for n in range(65528, 65547)], 3)]
    assert {r[1] for r in rows(run(spark, parents, children))} == {f"unit-{n:012x}" for n in (65528, 65529, 65540, 65545, 65546)}


def test_hot_reference_repeats_and_report(spark):
    children = [(f"r{n}", ["unit-000000000001", "unit-000000000001"], 2) for n in range(200)] * 2
    found = run(spark, [("unit-000000000001", 1, True)], children)
    assert found.count() == 200
    assert orphan_report(found).first().n_references == 200


def test_empty_tables_and_null_record(spark):
    assert rows(run(spark, [], [])) == set()
    assert rows(run(spark, [("unit-000000000001", 1, False)], [])) == set()
    found = run(spark, [], [(None, ["unit-000000000002"], 2), (None, ["unit-000000000002"], 1)]).collect()
    assert [(r.record_id, r.status, r.period) for r in found] == [(None, "missing", "2024-01")]
