"""Files in and out: texts, slides, facts, layouts, CSV, settings, streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cardmill.operators import layouts as L
from cardmill.sources import documents as D
from cardmill.sources import facts as S
from cardmill.sources import settings, sinks
from cardmill.streaming.reviews import review_stream, windowed_scores

GOOD = {
    "qa": {"front": "f", "back": "<b>"}, "cloze": {"text": "a {{c1::b}}"}, "list": {"title": "t", "items": ["x", "y"]}, "typed": {"prompt": "p", "answer": "a", "hints": ["h1", "h2"]},
    "image_occlusion": {"image": "i/a.png", "masks": [{"shape": "rect", "left": 0.1, "top": 0, "width": 0.25, "height": 1}, {"shape": "polygon", "left": 0, "top": 0, "points": [[0, 0], [1, 0.5], [0.333333333, 1]], "card": 7}]},
}


def fact(kind="qa", **more):
    return {"type": kind, "content": GOOD[kind], "deck": "D", "tags": ["t"]} | more


@pytest.mark.parametrize("kind", GOOD)
def test_sound_facts(kind):
    assert S.fact_faults(fact(kind)) == []


@pytest.mark.parametrize(
    ("broken", "fault"),
    [
        (fact(type="x"), "type"), (fact(deck=" "), "deck"), (fact(tags=["a b"]), "tags"), (fact(tags=[1]), "tags"), (fact(confidence=True), "confidence"), (fact(confidence=2), "confidence"), (fact(origin="source"), "source_of_origin"),
        (fact(knowledge_kind="x"), "knowledge_kind"), (fact(distractors=[{"text": "t", "grade": "x"}]), "distractors"), (fact("list", distractors=[{"text": "t", "grade": "far"}]), "distractors_of_type"), (fact(content={"front": "f"}), "content_back"),
        (fact("cloze", content={"text": "`{{c1::x}}`"}), "cloze_deletion"), (fact("list", content={"title": "t", "items": ["x"]}), "list_items"), (fact("typed", content={"prompt": "p", "answer": "a", "hints": list("abcd")}), "typed_hints"),
        (fact("image_occlusion", content={"image": "i", "masks": [{"shape": "rect", "left": 0, "top": 0, "width": 0, "height": 1}]}), "mask_size"), (fact(origin="generated-enrichment", source="s"), "enrichment_label"), ([], "not_an_object"),
    ],
)
def test_broken_facts(broken, fault):
    assert fault in S.fact_faults(broken)


def test_jsonl_and_notes(spark, tmp_path):
    path = tmp_path / "facts.jsonl"
    lines = [json.dumps(fact(k, id=k)) for k in GOOD] + ["", json.dumps(fact(id="n", deck="", distractors=[{"text": "far", "grade": "far"}, {"text": "<near>", "grade": "near"}])), json.dumps(fact(id="c", tags=["verbatim-code"]))]
    path.write_text("\n".join(lines))
    facts = S.read_facts(spark, str(path), default_deck="Default", tag="auto")
    made = {r.id: r for r in L.notes(facts).collect()}
    assert set(made) == {*GOOD, "n", "c"} and made["n"].deck == "Default" and made["n"].tags == ["t", "auto"]
    assert made["qa"].fields["Back"] == "&lt;b&gt;" and made["c"].layout == "Code" and made["c"].fields["Code"] == "&lt;b&gt;"
    assert made["n"].fields["Distractors"].index("&lt;near&gt;") < made["n"].fields["Distractors"].index('"far"')
    assert made["list"].fields["Text"] == '<ol class="list"><li>{{c1::x}}</li><li>{{c2::y}}</li></ol>' and made["typed"].fields["Hint 3"] == ""
    assert made["image_occlusion"].fields["Occlusion"] == "{{c1::image-occlusion:rect:left=0.1:top=0:width=0.25:height=1:oi=1}}<br>{{c7::image-occlusion:polygon:left=0:top=0:points=0,0 1,0.5 0.333333,1:oi=1}}<br>"
    again = S.parse_facts(S.fact_lines(facts))
    assert sorted(map(str, again.collect())) == sorted(map(str, facts.collect()))
    with pytest.raises(L.LayoutError):
        L.notes(facts, {"qa": {"A": {"x": "{front}"}, "B": {"x": "{front}"}}})
    with pytest.raises(L.LayoutError):
        L.notes(facts, {"qa": {"A": {"x": "{nope}"}}})
    mapped = {r.id: r.fields for r in L.notes(facts, {"qa": {"A": {"x": "{back} of {deck} {literal }"}}}).where("layout = 'A'").collect()}
    assert mapped["qa"] == {"x": "&lt;b&gt; of D {literal }"}
    path.write_text(json.dumps(fact(deck=3)))
    with pytest.raises(Exception, match="broken fact"):
        S.read_facts(spark, str(path)).collect()
    assert S.read_facts(spark, str(path), strict=False).first().faults == ["deck"]
    assert sinks.pending_notes(L.notes(facts.limit(0)), spark.createDataFrame([("x",)], "id string")).count() == 0


def test_texts_and_slides(spark, tmp_path):
    (tmp_path / "a.md").write_text("  # T\nbody \n\n")
    (tmp_path / "empty.md").write_text(" \n")
    assert [tuple(r) for r in D.read_documents(spark, str(tmp_path / "*.md")).collect()] == [("a.md", 0, "# T\nbody", "a.md")]
    with pytest.raises(ValueError):
        D.read_documents(spark, "x.docx")
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    p = lambda *ts: "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts)
    slide = lambda inner: f'<p:sld xmlns:p="urn:p" xmlns:a="{a}">{inner}</p:sld>'
    c = "http://schemas.openxmlformats.org/drawingml/2006/chart"
    pts = lambda vs: "".join(f'<c:pt idx="{n}"><c:v>{v}</c:v></c:pt>' for n, v in enumerate(vs))
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as package:
        package.writestr("ppt/slides/slide1.xml", slide(p("Title", "Line") + f"<a:tbl><a:tr><a:tc>{p('x')}</a:tc><a:tc>{p('y')}</a:tc></a:tr></a:tbl>"))
        package.writestr("ppt/slides/slide2.xml", slide(""))
        package.writestr("ppt/slides/slide10.xml", slide(p("Last")))
        package.writestr("ppt/slides/_rels/slide10.xml.rels", '<Relationships xmlns="urn:r"><Relationship Target="../charts/chart1.xml"/><Relationship Target="../notesSlides/n1.xml"/></Relationships>')
        package.writestr("ppt/charts/chart1.xml", f'<c:chartSpace xmlns:c="{c}" xmlns:a="{a}"><c:ser><c:tx><c:v>S</c:v></c:tx><c:cat>{pts(["k", "l"])}</c:cat><c:val>{pts(["1.0", "0.1"])}</c:val></c:ser></c:chartSpace>')
        package.writestr("ppt/notesSlides/n1.xml", slide(p("Say it")))
    (tmp_path / "broken.pptx").write_bytes(b"no package")
    made = sorted(tuple(r) for r in D.read_slides(spark, str(tmp_path / "*.pptx")).collect())
    assert made == [("s.pptx", 0, "Title\nLine\nTable:\nx | y", "s.pptx slide 1"), ("s.pptx", 1, "Last\nChart\nCategory | S\nk | 1\nl | 0.1\nNotes: Say it", "s.pptx slide 10")]


@pytest.mark.parametrize(("line", "is_math"), [("E = mc^2", True), ("a + b - c", True), ("x ∈ A", False), ("∑ x = 3", True), ("α + 1", True), ("plain text", False), ("= 3", False), ("well-known", False), ("a = b " * 50, False)])
def test_math_lines(spark, line, is_math):
    assert spark.createDataFrame([(line,)], "l string").select(D.looks_like_math(F.col("l"))).first()[0] is is_math


def test_card_csv_round_trip(spark, tmp_path):
    cards = spark.createDataFrame([("f,\"q\"\nx", "b", None, ["a", "a", "b"], 0.5, "id1", "qa"), ("g", "c", "", None, None, None, "typed")], "front string, back string, extra string, tags array<string>, confidence double, card_id string, card_type string")
    out = str(tmp_path / "out")
    sinks.write_card_csv(cards, out)
    made = {r.front: r for r in sinks.read_card_csv(spark, out).collect()}
    first = made['f,"q"\nx']
    assert (first.tags, first.confidence, first.card_id, first.topic, first.origin, first.row_error) == (["a", "b"], 0.5, "id1", "General", "source", None)
    assert made["g"].card_id.startswith("line-") and made["g"].confidence == 1.0
    (tmp_path / "bad.csv").write_text("Front,Back\nx,y\n")
    assert [(r.row_error, r.front) for r in sinks.read_card_csv(spark, str(tmp_path / "bad.csv")).collect()] == [("CSV_FIELDS", None)]


def test_records_are_numbered_in_each_file(spark, tmp_path):
    head = "Front,Back,Extra,Mnemonic,CardType,Tags,Confidence\n"
    for n in range(40):
        (tmp_path / f"f{n:02d}.csv").write_text("\ufeff" * (n % 2) + head + f'"two\nlines",b{n},e,,qa,x y,\n\ng,h,e,,qa,,high\nbroken "quote,b,e,,qa,,1\ni,j,e,,qa,,0.5\n', "utf-8")
    made = sinks.read_card_csv(spark, str(tmp_path)).collect()
    assert {(r.record, r.card_id, r.source == f"{r.file}:line-{r.record}", r.row_error) for r in made if r.front != "broken"} >= {(2, "line-2", True, None)}
    by_file: dict[str, list] = {}
    for r in made:
        by_file.setdefault(r.file, []).append((r.front, r.row_error, r.confidence))
    assert len(by_file) == 40 and all(rows[0] == ("two\nlines", None, 1.0) and ("g", "CSV_ROW") in {x[:2] for x in rows} and rows[-1] == ("i", None, 0.5) for rows in by_file.values())


def test_settings(spark, tmp_path):
    path = tmp_path / "c.toml"
    assert settings.read_config(path).deck == "Study"
    path.write_text('[service]\nurl = "http://localhost:1"\n[defaults]\ndeck = "X"\n[target_layouts]\nqa = "A"\n')
    made = settings.read_config(path)
    assert (made.deck, made.url, made.targets) == ("X", "http://localhost:1", {"qa": "A"})
    for wrong in ('[service]\nurl = "http://example.org"\n', '[defaults]\ntag = "a b"\n', '[service]\nsync = "yes"\n', '[target_layouts]\nnope = "A"\n'):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            settings.read_config(path)
    side = tmp_path / "s.json"
    assert settings.read_scheduler(side)[1] == [("SETTINGS_MISSING", "warning")]
    side.write_text('{"scheduler": "fsrs", "learning_steps": ["10m"], "note": "x"}')
    assert settings.read_scheduler(side)[0].scheduler == "fsrs"
    side.write_text('{"new_cards_per_day": "many"}')
    assert settings.read_scheduler(side)[1] == [("SETTINGS_INVALID", "error")]
    side.write_text('{"objectives": [{"id": "o", "status": "maybe"}], "knowledge_units": [{"id": "u", "status": "deferred"}]}')
    assert settings.read_coverage(spark, str(side))[1] == [("COVERAGE_INVALID", "error")] and settings.deferred_units(spark, str(side)) == 1


def test_service_is_local():
    with pytest.raises(ValueError):
        sinks.call_service("http://example.org", "version")


def test_study_notes(spark):
    cards = spark.createDataFrame([("d", n, "T", f"f|{n}", f"b{n}", f"e{n}", "s") for n in range(12)], "doc_id string, unit_pos int, topic string, front string, back string, extra string, source string")
    [note] = sinks.study_notes(cards, "2024-05-01").collect()
    assert note.text.count("\n| f\\|") == 8 and note.text.count("\n- e") == 4 and note.text.count("Q: ") == 12 and 'topic: "T"' in note.text


def test_review_stream(spark, tmp_path):
    rows = [("c", "30", "0.65", "1", "2024-01-01 00:00:00"), ("c", "30", "0.62", "0", "2024-01-02 00:00:00"), ("c", "5", "0.6", "0", "2024-01-02 00:00:00"), ("c", "x", "0.6", "0", "2024-01-02 00:00:00"), ("d", "40", "0.1", "0", "2024-06-01 00:00:00"), ("d", "40", "0.1", "0", "2024-12-01 00:00:00")]
    log = spark.createDataFrame(rows, "card_id string, interval_days string, predicted_retention string, actual_recalled string, at string").withColumn("reviewed_at", F.to_timestamp_ntz("at")).drop("at")
    for n, part in enumerate(log.orderBy("reviewed_at").collect()):
        spark.createDataFrame([part], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = windowed_scores(review_stream(spark, str(tmp_path / "in"), log.schema, 1)).writeStream.outputMode("append").format("memory").queryName("scores").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    closed = {(r.window_start, r.predicted_range): (r.n, round(r.brier, 4)) for r in spark.table("scores").collect()}
    whole = {(r.window_start, r.predicted_range): (r.n, round(r.brier, 4)) for r in windowed_scores(log).collect()}
    assert closed and set(closed.items()) <= set(whole.items()) and len(whole) == 3
