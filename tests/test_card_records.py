"""The record grammar against the csv module, its recovery, and the reasons."""

import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardmill.sources.card_records import COLUMNS, RecordParser, accepted, card_files, judge, parse_card_files, parse_card_records, rejected

HEAD = ",".join(COLUMNS)


def record(**cells):
    values = {c: "" for c in COLUMNS} | {"Front": "Q", "CardType": "qa", "Confidence": "0.5"} | cells
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([values[c] for c in COLUMNS])
    return out.getvalue()


cell = st.text(alphabet='ab",\n ;é', max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(cell, min_size=3, max_size=3), min_size=1, max_size=4))
def test_reads_what_csv_writes(table):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(table)
    assert [p.values for p in RecordParser(out.getvalue(), width=3).parse()] == table


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=12))
def test_a_broken_record_is_one_that_does_not_match_the_pattern(text):
    import re

    field = r'(?:"(?:[^"]|"")*"|[^",]*)'
    sound = re.fullmatch(f"{field}(?:,{field})*", text) is not None
    first = next(RecordParser(text, lines=False).parse())
    assert (first.error is None) == sound
    if first.error:
        assert 0 <= first.error_offset <= len(text)


def test_recovers_at_the_next_whole_record():
    broken = '"open field,' + ",".join(["x"] * 18)
    text = "\n".join([HEAD, broken, record(Front="after"), record(Front='two\nlines "quoted"')])
    parsed = list(RecordParser(text).parse())
    assert [p.error for p in parsed] == [None, "quoting", None, None]
    assert parsed[2].values[0] == "after" and parsed[3].values[0] == 'two\nlines "quoted"'


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        (record(), None), (record(CardType=" qa "), None), (record(Confidence=""), None), (record(Confidence=" 1e-3 "), None), (record(Confidence="1."), None),
        (record(CardType="QA"), "card_type"), (record(CardType=""), "card_type"), (record(Confidence="1.01"), "confidence"), (record(Confidence="-0.1"), "confidence"),
        (record(Confidence="nan"), "confidence"), (record(Confidence="0,5"), "confidence"), (record(Confidence="½"), "confidence"), ("", "column_count"), (record() + ",", "column_count"),
        ('"a"b,' + record(), "quoting"), ('a"b' + record(), "quoting"), (' "a",' + record(), "quoting"), ("\\" + record(Front='a"b'), "quoting"),
    ],
)
def test_reasons(raw, reason):
    assert judge(next(RecordParser(raw, lines=False).parse())) == reason


def test_rows_apart(spark):
    rows = [("d", 1, HEAD), ("d", 2, record(Front="x", Confidence="0.25")), ("d", 2, record(Front="x", Confidence="0.25")), ("d", 3, None), ("d", 4, '"a"b'), (None, None, record(CardType="no"))]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "deck_file string, row_no int, raw string, reason string")
    records = parse_card_records(data).cache()
    assert {tuple(r) for r in rejected(records).collect()} == {("d", 3, "column_count"), ("d", 4, "quoting"), (None, None, "card_type")}
    [card] = accepted(records).collect()
    assert (card.Front, card.Confidence, card.row_no) == ("x", 0.25, 2)
    located = records.where("row_no = 4").first()
    assert (located.error_line, located.error_column) == (1, 4)
    assert parse_card_records(data.limit(0)).count() == 0


def test_files(spark):
    text = "﻿" + "\n".join([HEAD, record(), 'x"y,z', record(CardType="zzz")])
    made = parse_card_files(spark.createDataFrame([("f.csv", text)], "deck_file string, text string")).orderBy("row_no").collect()
    assert [(r.line, r.reason) for r in made] == [(1, None), (2, None), (3, "quoting"), (4, "card_type")]


def test_files_put_together_from_rows(spark, tmp_path):
    from __spark_entry__ import queries

    rows = [("d", 4, record(CardType="zzz")), ("d", 1, "\ufeff" + HEAD), ("d", 3, '"open,' + ",".join(["x"] * 18)), ("d", 2, record(Front="two\nlines")), ("d", 5, record(Front="after")), ("e", 1, record())]
    data = spark.createDataFrame([*rows, *rows, ("d", None, record(Front="last"))], "deck_file string, row_no int, raw string")
    assert card_files(data.where("deck_file = 'e'")).first().text == record()
    data.write.parquet(str(tmp_path / "card_csv_rows.parquet"))
    made = [(r.deck_file, r.row_no, r.line, r.reason) for r in queries()["p6_files"](spark, str(tmp_path)).orderBy("deck_file", "row_no").collect()]
    assert made == [("d", 1, 1, None), ("d", 2, 2, None), ("d", 3, 4, "quoting"), ("d", 4, 5, "card_type"), ("d", 5, 6, None), ("d", 6, 7, None), ("e", 1, 1, None)]
