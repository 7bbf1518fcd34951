"""From texts to cards: reading, classifying, planning, rendering, rules."""

import pytest
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions.steps import parse_steps, step_is_long
from cardmill.operators import card_rules as R
from cardmill.operators import cards as C
from cardmill.operators import knowledge as K
from cardmill.operators import ordering as O
from cardmill.operators import units as U

CARD = "front string, back string, extra string, context string, mnemonic string, card_type string, image_url string, image_alt string, topic string, source string, card_id string, knowledge_kind string, learning_purpose string, origin string, confidence double"


def value(spark, column, *args):
    schema = ", ".join(f"c{n} string" for n in range(len(args)))
    return spark.createDataFrame([args], schema).select(column(*(F.col(f"c{n}") for n in range(len(args)))).alias("v")).first().v


@pytest.mark.parametrize(("text", "n"), [("café", 1), ("naïve café", 2), ("well-known it's fine", 3), ("{{c1::two words}} `hidden code` <b>x</b>&nbsp;y", 4), ("", 0)])
def test_word_count(spark, text, n):
    assert value(spark, T.word_count, text) == n and U.word_count(text) == n


@pytest.mark.parametrize(
    ("text", "kind", "purpose"),
    [
        ("A differs from B because its scope is narrower.", "comparison", "discriminate"), ("First collect data, then clean it.", "ordered-process", "sequence"),
        ("The evidence supports the claim; therefore the policy should change.", "argument", "interpret"), ("After the treaty, the alliance collapsed.", "narrative", "sequence"),
        ("Expected value = probability * payoff", "formula", "apply"), ("This applies except when demand is perfectly inelastic.", "exception", "discriminate"),
        ("Water is wet.", "definition", "recall"), ("Cells have walls", "relation", "recall"), ("Hello", "fact", "recall"),
    ],
)
def test_classify(spark, text, kind, purpose):
    assert tuple(value(spark, T.classify, text)) == (kind, purpose)


@pytest.mark.parametrize(("text", "items"), [("insulin, glucagon, and somatostatin", 3), ("1,234,567,890,123", 0), ("a; b, c; d", 3), ("one", 0), ("", 0), ("x, " + "w " * 13, 0)])
def test_list_items(spark, text, items):
    assert len(value(spark, T.list_items, text)) == items == len(U.list_items(text))


def test_sentences(spark):
    text = "Use a base, e.g. NaOH, in the reaction. Water is wet. See Fig. 3 now! A. Smith came."
    expected = ["Use a base, e.g. NaOH, in the reaction.", "Water is wet.", "See Fig. 3 now!", "A. Smith came."]
    assert U.sentences(text) == expected and value(spark, T.split_sentences, text) == expected


def test_scalars(spark):
    assert value(spark, T.slug, "  Árbol & Tree ") == "rbol-tree" and value(spark, T.slug, "!!") == "general"
    assert value(spark, T.parse_tags, "A b, C-d") == ["a", "b", "c-d"]
    assert value(spark, T.semantic_tokens, "The Students explain supply, Supply and demand") == ["supply", "demand"]
    assert value(spark, T.delimited_pair, "a :: b :: c") == ("a", "b :: c") and value(spark, T.delimited_pair, "a\t ") is None
    assert value(spark, lambda c: T.mnemonic(T.list_items(c)), "Bacteria, Archaea, and Eukarya") == "BAE: Bacteria, Archaea, Eukarya"
    assert value(spark, T.escape_html, "<a href='x'>&") == "&lt;a href=&#x27;x&#x27;&gt;&amp;" and value(spark, lambda c: T.unescape_html(T.escape_html(c)), "<&'\">") == "<&'\">"
    assert value(spark, lambda a, b: T.stable_card_id(a, b), "f", "b") == __import__("hashlib").sha256(b"f\0b").hexdigest()[:16]
    assert value(spark, T.package_id, "Deck") == (1 << 30) + __import__("zlib").crc32(b"Deck") % (1 << 30)
    assert value(spark, T.definition_term, "What does osmosis mean?") == "osmosis" and value(spark, T.definition_term, "What is component 1 of 2 in x?") == ""
    assert value(spark, T.independent_clauses, "Cells store energy and membranes control transport well") == ["Cells store energy.", "membranes control transport well."]
    assert value(spark, T.independent_clauses, "Market share increased, but profit fell because costs rose.") == ["Market share increased, but profit fell because costs rose."]
    assert [step_is_long(s) for s in ("10m", "23h", "24h", "1d", "x")] == [False, False, True, True, True] and parse_steps("10m, 1d") == ("10m", "1d")


def units_of(text):
    return U.read_units(text)


def test_reading_blocks():
    text = "# Cells\nObjectives:\n- Define a cell\nYou can name parts\n\nYou can compute variance as a mean.\n```python\nx = 1\n# no heading\n```\n$$ E = mc^2 $$\n- one bullet\nQ: What is X?\nA: Y\nTags: a, B c\nterm :: meaning"
    made = units_of(text)
    assert [u.text for u in made] == ["You can compute variance as a mean.", "x = 1\n# no heading", "$$ E = mc^2 $$", "one bullet", "What is X? Y", "term meaning"]
    assert [u.verbatim_kind for u in made] == ["", "code", "math", "", "", ""] and made[1].verbatim_language == "python"
    assert {u.topic for u in made} == {"Cells"} and made[4].tags == ["a", "b", "c"] and [u.line for u in made] == [6, 7, 11, 12, 13, 16]


def test_lists_images_and_open_blocks():
    made = units_of("The primary colors include red, blue, and yellow.")
    assert [u.answer for u in made] == ["red", "blue", "yellow"] and made[0].question == "What is component 1 of 3 in The primary colors?"
    assert len(units_of("Q: How many?\nA: 300,000")) == 1
    made = units_of("![alt](a.png)\nFirst fact here. Second fact here.")
    assert [(u.image_url, u.image_alt) for u in made] == [("a.png", "alt"), ("", "")]
    made = units_of("```\nnever closed\n# x")
    assert len(made) == 1 and made[0].text == "never closed\n# x"
    assert units_of("Objectives:\nYou can identify cells") == [] and units_of("") == [] and units_of("You should be able to derive it") == []
    made = units_of("y = a + b\nThis applies except when b is zero.")
    assert [u.line for u in made] == [1, 2]


def build(spark, text):
    docs = spark.createDataFrame([(1, text, "n")], "doc_id bigint, text string, source_name string")
    return C.build_cards(C.classify_units(U.parse_units(docs))).orderBy("unit_pos").collect()


def test_cards(spark):
    [card] = build(spark, "Osmosis is the movement of water across a membrane.")
    assert (card.card_type, card.front, card.back) == ("reverse", "Which term means: the movement of water across a membrane?", "Osmosis")
    [card] = build(spark, "A differs from B because its scope is narrower.")
    assert (card.front, card.back) == ("How does A differ from B?", "its scope is narrower")
    cards = build(spark, "Q: What is haptics?\nA: Communication through touch.\n\nQ: Who invented the telegraph?\nA: Samuel Morse.")
    assert [(c.card_type, c.front, c.back) for c in cards] == [("reverse", "Which term means: Communication through touch?", "haptics"), ("qa", "Who invented the telegraph?", "Samuel Morse.")]
    cards = build(spark, "The three domains of life contain Bacteria, Archaea, and Eukarya.")
    assert {c.mnemonic for c in cards} == {"BAE: Bacteria, Archaea, Eukarya"}
    [card] = build(spark, "Alpha is <script>alert(1)</script>.")
    assert "<script>" not in card.front + card.back
    assert build(spark, "A contextless fragment") == [] and build(spark, None) == []


def test_reverse_cards_stay_in_balance(spark):
    text = "\n\n".join(f"Q: What is term{n}?\nA: meaning number {'abcdefghij'[n]}" for n in range(10))
    kinds = [c.card_type for c in build(spark, text)]
    reverse = qa = 0
    for kind in kinds:
        expected = "reverse" if reverse <= qa // 2 else "qa"
        assert kind == expected
        reverse, qa = reverse + (kind == "reverse"), qa + (kind == "qa")


def card_row(**cells):
    base = dict(front="What is X?", back="Y", extra="Because of its colour and age.", context="c", mnemonic="", card_type="qa", image_url="", image_alt="", topic="T", source="s", card_id="id", knowledge_kind="fact", learning_purpose="recall", origin="source", confidence=1.0)
    return tuple((base | cells).values())


@pytest.mark.parametrize(
    ("cells", "code"),
    [
        ({"front": " "}, "MISSING_CONTENT"), ({"source": None}, "MISSING_SOURCE"), ({"confidence": float("nan")}, "INVALID_CONFIDENCE"), ({"confidence": 1.5}, "INVALID_CONFIDENCE"),
        ({"knowledge_kind": "x"}, "INVALID_KNOWLEDGE_KIND"), ({"origin": "inferred"}, "UNLABELED_INFERENCE"), ({"front": "w " * 20}, "FRONT_TOO_LONG"), ({"extra": None}, "MISSING_EXPLANATION"),
        ({"front": "What is DNA?", "context": ""}, "MISSING_CONTEXT"), ({"card_type": "list", "back": "a; b; c; d; e; f; g; h; i."}, "LIST_SIZE"), ({"card_type": "list", "back": "alpha; beta; gamma.", "mnemonic": "BAD: x"}, "MNEMONIC_MISMATCH"),
        ({"card_type": "cloze"}, "CLOZE_FORMAT"), ({"front": "A {{c1::b}} c"}, "TYPE_FORMAT_MISMATCH"), ({"card_type": "reverse"}, "REVERSE_FORMAT"), ({"back": "a, b, c, d, e"}, "COGNITIVE_LOAD"),
        ({"back": "alpha, beta, gamma"}, "MISSING_MNEMONIC"), ({"extra": "X is Y."}, "THIN_EXPLANATION"), ({"front": "What claim or evidence is presented in Ethics?"}, "GENERIC_PROMPT"), ({"image_url": "a.png"}, "IMAGE_ALT"), ({"back": "cells store energy and membranes control it"}, "ATOMICITY_REVIEW"),
    ],
)
def test_rules(spark, cells, code):
    found = {r.code for r in R.violations(spark.createDataFrame([card_row(**cells)], CARD)).collect()}
    assert code in found
    assert not {r.code for r in R.violations(spark.createDataFrame([card_row()], CARD)).collect()}


def test_deck_rules_and_summary(spark):
    codes = lambda s, **k: {r.code for r in R.deck_violations(spark, s, k.get("n", 1), k.get("runs", False)).collect()}
    assert codes(R.Scheduler()) == set() and codes(R.Scheduler(scheduler="fsrs")) == {"FSRS_LONG_STEP"} and codes(R.Scheduler(), n=0, runs=True) == {"EMPTY_DECK", "INTERLEAVING"}
    assert codes(R.Scheduler(max_ease_percent=260, starting_ease_percent=270, new_cards_per_day=30, easy_button_policy="use", graduating_interval_days=1, easy_interval_days=1)) == {"EASE_CAP", "STARTING_EASE", "DAILY_LIMIT", "EASY_POLICY", "GRADUATING_INTERVAL", "EASY_INTERVAL"}
    cards = spark.createDataFrame([card_row(), card_row(front="WHAT IS x?", back="y"), card_row(front=None)], CARD)
    row = R.audit_summary(cards).first()
    assert (row.cards, row.errors, row.qa, row.topics, row.verdict) == (3, 1, 3, 1, "FAIL")
    assert [tuple(r) for r in R.duplicates(cards).collect()] == [("what is x?", "y", 2)]
    assert R.audit_summary(cards.limit(0)).first().verdict == "FAIL"


def test_objectives_and_prerequisites(spark):
    units = spark.createDataFrame([("d", 0, "u0", "Elasticity is the response of demand.", "T", "definition"), ("d", 1, "u1", "High elasticity changes revenue.", "T", "fact"), ("d", 2, "u2", "Inelasticity differs.", "T", "fact"), ("e", 0, "u3", None, "X", "fact")], "doc_id string, unit_pos int, id string, text string, topic string, kind string")
    assert {(r.id, r.prerequisite_id) for r in K.prerequisites(units).collect()} == {("u1", "u0")}
    objectives = spark.createDataFrame([("d", "o1", "Define elasticity", "T"), ("d", "o2", "Compare revenue", "T"), ("e", "o3", "General things", "General")], "doc_id string, id string, label string, topic string")
    made = {r.id: r.objective_ids for r in K.assign_objectives(units, objectives).collect()}
    assert made == {"u0": ["o1"], "u1": ["o1", "o2"], "u2": [], "u3": ["o3"]}
    docs = spark.createDataFrame([(1, "# A\nObjectives:\n- Define x.\nYou can see y\nplain\n- no objective\n\nStudents should be able to derive z.\nObjective: Know q")], "doc_id bigint, text string")
    found = K.explicit_objectives(docs, F.lit("n")).orderBy("line_no").collect()
    assert [(r.line_no, r.label, r.topic) for r in found] == [(3, "Define x", "A"), (4, "see y", "A"), (8, "derive z", "A"), (9, "Know q", "A")]


def test_coverage(spark):
    objectives = spark.createDataFrame([("o1", "a", "T", True), ("o2", "b", "T", True), ("o3", "c", "T", False)], "id string, label string, topic string, explicit boolean")
    units = spark.createDataFrame([(["o1", "o1"], "represented"), (["o1", "o2"], "deferred"), (["o2"], "deferred"), (None, "omitted")], "objective_ids array<string>, status string")
    made = {r.id: (r.status, r.knowledge_units, r.represented_units) for r in K.objective_coverage(objectives, units).collect()}
    assert made == {"o1": ("covered", 2, 1), "o2": ("deferred", 2, 0), "o3": ("unsupported", 0, 0)}
    row = K.coverage_summary(K.objective_coverage(objectives, units), units).first()
    assert (row.covered_objectives, row.objective_coverage, row.deferred, row.omitted) == (1, 0.3333, 2, 1)


def test_interleaving(spark):
    rows = [("d", n, "ABC"[n // 6]) for n in range(18)]
    cards = spark.createDataFrame(rows, "deck string, card_pos int, topic string")
    made = O.interleave(cards, "deck", "card_pos")
    assert sorted(r.card_pos for r in made.collect()) == list(range(18))
    assert O.avoidable_runs(made, "deck", "place").first().avoidable_runs == 0
    assert O.avoidable_runs(cards, "deck", "card_pos").first().avoidable_runs == 10
    again = O.interleave(cards.repartition(5), "deck", "card_pos")
    assert [r.card_pos for r in made.orderBy("place").collect()] == [r.card_pos for r in again.orderBy("place").collect()]


def test_sections():
    text = "# A\none\n## B\ntwo\n# C\nthree"
    assert U.markdown_section(text, "a") == "one\n## B\ntwo" and U.markdown_section(text, "B") == "two" and U.markdown_section(text, "zzz") == ""
