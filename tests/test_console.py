"""Console commands, study rows and marked formulas."""

import json

import pytest
from pyspark.sql import functions as F

from cardmill.__main__ import main
from cardmill.operators import drafts as D
from cardmill.sources.documents import with_math


def test_text_to_deck_to_audit(spark, tmp_path, capsys):
    (tmp_path / "n.md").write_text("# Rivers\n\nErosion is the wearing away of rock by water.\n\nQ: Who built the first loom?\nA: Nobody knows.\n")
    assert main(["generate", str(tmp_path / "n.md"), "--out", str(tmp_path / "deck")]) == 0
    assert json.loads(capsys.readouterr().out) == {"objectives": 1, "units": 2, "cards": 2}
    code = main(["audit", str(tmp_path / "deck")])
    report = json.loads(capsys.readouterr().out)
    assert report["summary"]["cards"] == 2 and code == int(report["summary"]["verdict"] == "FAIL")
    assert main(["read", str(tmp_path / "n.md"), "--out", str(tmp_path / "chunks")]) == 0 and json.loads(capsys.readouterr().out) == {"chunks": 1}
    (tmp_path / "log.csv").write_text("card_id,decision,edited_fields,reason\na,approved,,\nb,rejected,,vague\n")
    assert main(["calibrate", "--approvals", str(tmp_path / "log.csv")]) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["total"], report["retention_status"], report["rejection_reasons"]) == (2, "not-provided", [{"name": "vague", "n": 1}])
    with pytest.raises(SystemExit):
        main(["calibrate"])


def test_study_rows(spark):
    units = spark.createDataFrame([("u", "Water wears rock away.")], "unit_id string, text string")
    row = lambda text, unit="u", evidence="water wears rock": {"text": text, "source_unit_id": unit, "evidence": evidence}
    notes = [row("Water wears rock."), row(" "), row("x", "v"), row("a\nb"), row("# water"), row("water", evidence="no such"), row("fire")]
    payloads = spark.createDataFrame([(json.dumps({"notes": notes, "summary": row("rock")}),), ("no json",), (None,)], "payload string")
    made = [(r.section, r.fault) for r in D.judged_study_rows(D.read_study_rows(payloads), units).collect()]
    assert sorted(made, key=str) == sorted([("notes", f) for f in (None, "missing_field", "unknown_unit", "several_lines", "heading", "unsupported_evidence", "unsupported_text")] + [("summary", None), (None, "missing_field"), (None, "missing_field")], key=str)


def test_formulas_are_marked_once(spark):
    texts = [("E = m c^2\nplain words\n  E  =  m c^2",), ("plain",), (None,), ("",)]
    made = [r.text for r in with_math(spark.createDataFrame(texts, "text string")).collect()]
    assert made == ["E = m c^2\nplain words\n  E  =  m c^2\n[math: E = m c^2 | source text layer]", "plain", None, ""]
