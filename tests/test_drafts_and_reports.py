"""Drafts, prompts, reports and packages."""

import json
import sqlite3
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from cardmill.operators import drafts as D
from cardmill.operators import reports as P
from cardmill.sources.packages import stable_number, write_package

CARD = "front string, back string, extra string, context string, mnemonic string, card_type string, image_url string, image_alt string, topic string, source string, card_id string, knowledge_kind string, learning_purpose string, origin string, confidence double"


def units(spark):
    rows = [("d", n, f"u{n}", f"Unit {n} says  Water boils at {n} degrees.", "T & U", f"s:line-{n}") for n in range(5)]
    return spark.createDataFrame(rows, "doc_id string, unit_pos int, unit_id string, text string, topic string, source string")


def draft(**more):
    return {"front": "When <does> water boil?", "back": "at 3 degrees", "extra": "It is so.", "card_type": "qa", "source_unit_id": "u3", "evidence": " water BOILS at 3 "} | more


def payloads(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) or t is None else json.dumps(t),) for t in texts], "payload string")


def test_sound_draft(spark):
    [card] = D.drafted_cards(D.read_drafts(payloads(spark, {"cards": [draft(tags=["x", " "], confidence="0.5")]})), units(spark)).collect()
    assert card.front == "When &lt;does&gt; water boil?" and card.tags == ["x", "drafted", "auto"] and card.confidence == 0.5
    assert (card.topic, card.source, card.context, card.knowledge_unit_id) == ("T &amp; U", "s:line-3", "Topic: T &amp; U.", "u3")


@pytest.mark.parametrize(
    ("payload", "fault"),
    [
        ("no json", "not_json"), (None, "not_json"), ({"x": 1}, "no_cards"), ({"cards": []}, "no_cards"), ({"cards": [draft(back=" ")]}, "missing_field"), ({"cards": [draft(source_unit_id="zz")]}, "unknown_unit"),
        ({"cards": [draft(evidence="milk boils")]}, "unsupported_evidence"), ({"cards": [draft(card_type="quiz")]}, "card_type"), ({"cards": [draft(confidence="high")]}, "confidence"), ({"cards": [draft()]}, "none"),
    ],
)
def test_faults(spark, payload, fault):
    assert [r.fault for r in D.draft_faults(D.read_drafts(payloads(spark, payload)), units(spark)).collect()] == [fault]


def test_prompts_and_answers(spark):
    asked = D.prompts(units(spark), per_prompt=2)
    made = {r.part: json.loads(r.prompt) for r in asked.collect()}
    assert [len(made[p]["source_units"]) for p in sorted(made)] == [2, 2, 1] and made[0]["source_units"][0]["source_unit_id"] == "u0"
    echo = D.answered(asked, command=[sys.executable, "-c", "import json,sys; print(json.dumps({'cards': [{'front': str(len(json.load(sys.stdin)['source_units']))}]}))"])
    assert sorted(json.loads(r.payload)["cards"][0]["front"] for r in echo.collect()) == ["1", "2", "2"]
    assert D.answered(asked, complete=lambda p: "{}").first().payload == "{}"
    with pytest.raises(ValueError):
        D.answered(asked)


def cards(spark, *changes):
    base = dict(front="What is X?", back="Y", extra="Because of its colour and age.", context="c", mnemonic="", card_type="qa", image_url="", image_alt="", topic="T", source="s", card_id="id", knowledge_kind="fact", learning_purpose="recall", origin="source", confidence=1.0)
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], CARD)


def test_reports(spark):
    checks = {r.check: (r.passed, r.n_cards) for r in P.audit_checks(cards(spark, {}, {"front": "w " * 25}, {"extra": None})).collect()}
    assert checks["reading_time"] == (False, 1) and checks["pre_understanding"] == (False, 1) and checks["atomicity"] == (True, 0)
    assert P.remedies(cards(spark, {"front": "w " * 25}, {"front": "v " * 25})).first().n == 2
    assert P.readiness(cards(spark, {}), 0, 0).first().ready and not P.readiness(cards(spark, {}), 1, 0).first().ready and not P.readiness(cards(spark, {"back": ""}), 0, 0).first().ready
    log = spark.createDataFrame([("a", "approved", "", "")], "card_id string, decision string, edited_fields string, reason string")
    row = P.calibration_report(log, None).first()
    assert (row.approval_status, row.retention_status, row.first_pass_approval_rate) == ("ok", "not-provided", 1.0)
    notes = spark.createDataFrame([("a", "D"), ("b", "D"), (None, "E")], "id string, deck string")
    known = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert sorted(map(tuple, P.import_report(notes, known).collect())) == [("D", 2, 1, 1), ("E", 1, 0, 1)]
    assert P.field_references("{{Front}} {{#Extra}}{{text:Extra}}{{/Extra}} {{FrontSide}}", []) == ["Front", "Extra"]


def test_package(spark, tmp_path):
    rows = [("n1", "Basic", "Deck A", {"Front": "f", "Back": "b"}, ["t"]), ("n2", "Cloze", "Deck B", {"Text": "a {{c1::b}}"}, [])]
    notes = spark.createDataFrame(rows, "id string, layout string, deck string, fields map<string,string>, tags array<string>")
    path = tmp_path / "x.apkg"
    assert write_package(notes, path, {"a.png": b"1"}, {"Basic": ["Front", "Back"]}) == 2
    with zipfile.ZipFile(path) as package:
        assert json.loads(package.read("media")) == {"0": "a.png"} and package.read("0") == b"1"
        package.extract("collection.anki2", tmp_path)
    db = sqlite3.connect(tmp_path / "collection.anki2")
    assert sorted(db.execute("select guid, flds from notes")) == [("card-n1", "f\x1fb"), ("card-n2", "a {{c1::b}}")]
    models, decks = (json.loads(x) for x in db.execute("select models, decks from col").fetchone())
    assert models[str(stable_number("Cloze"))]["type"] == 1 and {d["name"] for d in decks.values()} == {"Default", "Deck A", "Deck B"}
    assert stable_number("Deck A") == spark.range(1).select((F.lit(1 << 30) + F.crc32(F.lit("Deck A")) % (1 << 30)).alias("x")).first().x
