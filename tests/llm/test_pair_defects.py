"""Defects on cards spoiled here, which the fit never saw."""

import random

import pytest

from cardmill.llm import pair_defects as D

FIELDS = "card_id string, front string, back string, extra string, card_type string, defect string"
NOUNS = "lamp river valve market colony ledger sample membrane harbour signal charter vessel orbit clause matrix kiln".split()
COINED = "zurbanol marquith deltonex porvane kelmoride".split()
GERMAN = ["Die Lampe misst den Fluss, sobald der Markt unter die Schwelle fällt.", "Nach der Probe ordnet das Ventil auch die Kammer der Stadt.", "Unter einem Hafen versteht man eine Grenze, die eine Quelle verbindet."]
SPANISH = ["La lámpara mide el río cuando el mercado baja del valle.", "Tras la prueba, la válvula ordena también la cámara de la ciudad."]


def sound(rng):
    a, b, c = rng.sample(NOUNS, 3)
    z = rng.choice(COINED)
    front = rng.choice([f"What role does the {a} play in the {z} of the {b}?", f"Why does a {z} lose its {a} before the {b}?", f"How does the {z} differ from the {b} with regard to {a}?"])
    back = rng.choice([f"The {a} of a {z} holds the {b} and slowly guides the {c}.", f"Because the {a} restores the {b}, the {z} weakly balances the {c}", f"Unlike the {b}, the {z} moves a {c} whenever the {a} is steady.", f"steady {a} of the {z}"])
    if rng.random() < 0.15:
        return f"Which term means: a {a} that holds the {b}?", rng.choice([z, f"{z} {a}", f"steady {c}"]), None, "typed"
    return front, back, rng.choice([None, "", f"A {z} is a {a} that hides the {c} of a {b}."]), "qa"


@pytest.fixture(scope="module")
def cards():
    rng = random.Random(5)
    rows = [sound(rng) for _ in range(1500)]
    rows += [(f"Was misst die Lampe der {rng.choice(COINED)} nach dem Fluss?", rng.choice(GERMAN), None, "qa") for _ in range(150)]
    return rows + [(f"¿Qué mide la {rng.choice(COINED)} de la ciudad?", rng.choice(SPANISH), None, "qa") for _ in range(150)]


@pytest.fixture(scope="module")
def model(cards):
    return D.fit(cards[::2])


def judge(model, *card):
    return D.pair_defect(*model, *card)


def test_sound_cards_pass(cards, model):
    wrong = [c for c in cards[1::2] if judge(model, *c)]
    assert len(wrong) <= 0.01 * len(cards)


@pytest.mark.parametrize("back", [None, "", " \n", "…", "n/a", "(blank)", "<br>", "&nbsp;", "TBD", "to do", "?"])
def test_empty(model, back):
    assert judge(model, "What is a lamp?", back, None, "qa") == "empty"
    assert judge(model, back, "A lamp.", None, "qa") == "empty"


def test_an_empty_extra_is_sound(model):
    assert judge(model, "Why does a zurbanol lose its lamp before the river?", "The lamp of a zurbanol holds the river and slowly guides the kiln.", " ", "qa") is None


def test_spoiled_cards(cards, model):
    rng = random.Random(9)
    hits = {"truncated": 0, "refusal": 0, "copy": 0, "language": 0}
    tried = 60
    for k in range(tried):
        front, _, extra, kind = sound(rng)
        a, b, c = rng.sample(NOUNS, 3)
        back = f"The {a} of a zurbanol holds the {b} and slowly guides the {c}."
        cut = " ".join(back.split()[: rng.choice([3, 6, 7, 9])])
        hits["truncated"] += judge(model, front, cut + rng.choice(["", ",", " …", " be-"]), extra, kind) == "truncated"
        hits["refusal"] += judge(model, front, rng.choice(["I can't help with this question.", "Sorry, as an assistant I won't answer that.", "Unfortunately I am unable to respond here.", "I must decline to answer; ask an expert."]), extra, kind) == "refusal"
        hits["copy"] += judge(model, front, rng.choice([front, front.upper(), f"Question: {front}", f'"{front}"', front.rstrip("?")]), extra, kind) == "copy"
        hits["language"] += judge(model, front, rng.choice(GERMAN + SPANISH), extra, kind) == "language"
    assert all(n >= 0.9 * tried for n in hits.values()), hits


def test_asked_for_language(model):
    assert judge(model, "What is the German word for 'steady lamp' in a zurbanol report?", "ruhige Lampe", None, "typed") is None


def test_rows(spark, cards):
    rows = [(f"c{k}", *c, "clash") for k, c in enumerate(cards[:300])] + [("x", "Why?", None, None, None, "clash")] * 2 + [(None, None, None, None, None, "clash")]
    data = spark.createDataFrame(rows, FIELDS)
    found = {r.card_id: r.defect for r in D.find_defects(data, sample=200).collect()}
    assert found["x"] == "empty" and found[None] == "empty" and len(found) < 12
    assert D.find_defects(data.limit(0)).count() == 0


def test_endings_are_counted_over_all_cards(spark, cards):
    rows = [(f"c{k}", *c, "clash") for k, c in enumerate(cards[:600])]
    data = spark.createDataFrame(rows + rows[:50], FIELDS)
    whole = D.Endings()
    for front, back, extra, kind in cards[:600]:
        whole.learn_field(back, front, kind)
        whole.learn_field(extra, front, kind)
    got = D.all_endings(data)
    assert got.last == whole.last and got.inner == whole.inner and got.tail_last == whole.tail_last and got.tail_inner == whole.tail_inner
    seen = {p for p in {*whole.whole, *whole.part} if whole.whole[p] + whole.part[p] >= 3}
    assert set(got.whole) | set(got.part) == seen and all(got.whole[p] == whole.whole[p] and got.part[p] == whole.part[p] for p in seen)


def test_the_sample_is_the_rows_of_least_hash(spark, cards):
    rows = [(f"c{k}", *c) for k, c in enumerate(cards[:400])]
    fields = "card_id string, front string, back string, extra string, card_type string"
    one, other = (D.drawn(spark.createDataFrame(r, fields).repartition(n), 100) for r, n in ((rows, 1), (rows[::-1] + rows[:9], 5)))
    assert one == other and len(one) == 100
