"""Image links, passed fields, matched notes and candidates."""

from pyspark.sql import functions as F

from cardmill.operators import refined as N


def test_image_links(spark):
    rows = [("", "none"), (None, "none"), ("https://a.org/x.png", "remote"), ("ftp://a/x.png", "bad_scheme"), ("http:///x.png", "bad_scheme"), ("//a.org/x.png", "bad_scheme"), ("/x.png", "absolute"), ("../x.png", "outside"), ("a/../../x.png", "outside"), ("a/../x.png", "local"), (" img/x.png ", "local")]
    made = spark.createDataFrame([(u,) for u, _ in rows], "image_url string").select(N.image_kind(F.col("image_url")).alias("k")).collect()
    assert [r.k for r in made] == [k for _, k in rows]
    names = N.media_names(spark.createDataFrame([(u,) for u, _ in rows] * 2, "image_url string")).collect()
    assert {tuple(r) for r in names} == {("a/../x.png", "x.png"), ("img/x.png", "x.png")}


def test_fields_are_passed_where_unset(spark):
    notes = spark.createDataFrame([("1", "Plain", {"Front": "f", "Back": "own"}), ("2", "Plain", {"Front": "f"}), ("3", "Other", {"Front": "f"}), ("4", "Plain", {})], "id string, layout string, fields map<string,string>")
    cards = spark.createDataFrame([("1", "qa", "p/x.png", None, "b", "clash"), ("2", "qa", None, "a<b", "b", "clash"), ("3", "qa", "", "", "b", "clash")], "card_id string, card_type string, image_url string, image_alt string, back string, fields string")
    made = {r["id"]: r["fields"] for r in N.passed_through(notes, cards, {"Plain": ("Front", "Back", "ImageURL", "ImageAlt")}).collect()}
    assert made == {"1": {"Front": "f", "Back": "own", "ImageURL": "x.png", "ImageAlt": ""}, "2": {"Front": "f", "Back": "b", "ImageURL": "", "ImageAlt": "a&lt;b"}, "3": {"Front": "f"}, "4": {}}


def test_notes_are_matched_by_position_and_verified(spark):
    notes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None)], "note_pos int, id string")
    infos = spark.createDataFrame([(0, 10, "a"), (1, 11, "x"), (3, None, None)], "note_pos int, note_id bigint, id string")
    assert {r.note_pos: r.verified for r in N.matched_infos(notes, infos).collect()} == {0: True, 1: False, 2: False, 3: False}


def test_evidence(spark):
    rows = [("Water wears rock.", "Here  water WEARS rock away", True), ("rock", "rock", False), ("", "x", False), (None, None, False), ("water makes rock", "water wears rock", False)]
    made = spark.createDataFrame([r[:2] for r in rows], "a string, e string").select(N.supports(F.col("a"), F.col("e")).alias("s")).collect()
    assert [r.s for r in made] == [r[2] for r in rows]


def test_candidates(spark):
    rows = [("ok", "Who built the first loom?", "Nobody in town", "It was never found out.", ["a"]), ("long", "w " * 25 + "?", "Nobody in town", "It was never found out.", None), ("none", "", "", "", None), (None, "Q?", "A", "E", None)]
    data = spark.createDataFrame(rows, "card_id string, front string, back string, extra string, tags array<string>")
    assert [tuple(r) for r in N.valid_candidates(data.withColumnRenamed("card_id", "candidate"), "candidate").collect()] == [("ok", 1)]
    assert N.valid_candidates(data.withColumnRenamed("card_id", "candidate").limit(0), "candidate").count() == 0
