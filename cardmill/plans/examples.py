"""Queries over small literal tables in which every rule fires, and over unit invariants."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import vocabulary as V
from cardmill.operators import card_rules as R
from cardmill.operators import cards as C
from cardmill.operators import knowledge as K
from cardmill.operators import layouts as L
from cardmill.operators import units as U
from cardmill.plans.decks import card_rule_sql
from cardmill.plans.knowledge import _U
from cardmill.sources import facts as S
from cardmill.sources.tables import table

_SOUND = dict(front="What is X?", back="Y", extra="Because of its colour and age.", context="c", mnemonic="", card_type="qa", image_url="", image_alt="", source="s", knowledge_kind="fact", learning_purpose="recall", origin="source", topic="T", confidence=1.0)
#: What each example card has instead of the sound one's fields.
CARDS: list[dict] = [
    {}, {"front": " "}, {"source": None}, {"origin": "generated-enrichment"}, {"origin": "generated-enrichment", "extra": "Enrichment: its colour fades."}, {"origin": "inferred"}, {"confidence": 1.5}, {"confidence": -0.1}, {"confidence": None},
    {"knowledge_kind": "rumour"}, {"learning_purpose": "win"}, {"origin": "hearsay"}, {"front": "w " * 20}, {"front": "w " * 19}, {"extra": None}, {"front": "What is DNA?", "context": ""}, {"card_type": "essay"}, {"card_type": "cloze"},
    {"front": "A {{c1::b}} c"}, {"front": "A {{c1::b}} c", "card_type": "cloze"}, {"front": "Code `{{c1::b}}` here", "card_type": "cloze"}, {"card_type": "reverse"}, {"card_type": "reverse", "front": "Which term means: y?"},
    {"card_type": "list", "back": "a; b; c; d; e; f; g; h; i."}, {"card_type": "list", "back": "alpha; beta; gamma.", "mnemonic": "BAD: x"}, {"card_type": "list", "back": "alpha; beta; gamma.", "mnemonic": "abg: x"},
    {"back": "a, b, c, d, e"}, {"back": "1,234,567"}, {"back": "alpha, beta, gamma"}, {"back": "cells store energy and membranes control it"}, {"extra": "X is Y."}, {"front": "What claim or evidence is presented in Ethics?"},
    {"image_url": "a.png", "image_alt": "map"}, {"image_url": "a.png", "image_alt": "A map whose coast helps recall the spatial order", "card_type": "image-supported"},
]
_CARD_SCHEMA = "front string, back string, extra string, context string, mnemonic string, card_type string, image_url string, image_alt string, source string, knowledge_kind string, learning_purpose string, origin string, topic string, confidence double, card_id string"


def _cards() -> list[tuple]:
    return [(*(_SOUND | other).values(), f"c{n:02d}") for n, other in enumerate(CARDS)]


def card_rule_examples(spark: SparkSession, folder: str) -> DataFrame:
    return R.violations(spark.createDataFrame(_cards(), _CARD_SCHEMA)).select("card_id", "code", "level")


#: Settings that differ from the defaults, with the number of cards and whether topics run on.
DECKS: list[tuple[dict, int, bool]] = [
    ({}, 1, False), ({}, 0, False), ({"new_cards_per_day": 21}, 1, False), ({"graduating_interval_days": 4}, 1, False), ({"easy_interval_days": 1}, 1, False), ({"max_ease_percent": 251}, 1, False), ({"starting_ease_percent": 251}, 1, False),
    ({"easy_button_policy": "use"}, 1, False), ({"scheduler": "fsrs"}, 1, False), ({"scheduler": "fsrs", "learning_steps": ("10m", "23h")}, 1, False), ({"scheduler": "fsrs", "learning_steps": ("24h",)}, 1, False), ({}, 1, True), ({"interleave_topics": False}, 1, True),
]


def deck_rule_examples(spark: SparkSession, folder: str) -> DataFrame:
    made = [R.deck_violations(spark, R.Scheduler(**other), n, runs).select(F.lit(f"d{k:02d}").alias("deck"), "code", "level") for k, (other, n, runs) in enumerate(DECKS)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _fact(kind: str = "qa", content: dict | None = None, **other: object) -> dict:
    own = {"qa": {"front": "f", "back": "b"}, "cloze": {"text": "a {{c1::b}}"}, "list": {"title": "t", "items": ["a", "b"]}, "typed": {"prompt": "p", "answer": "a"}, "image_occlusion": {"image": "i.png", "masks": [{"shape": "rect", "left": 0.1, "top": 0.1, "width": 0.2, "height": 0.2}]}}[kind]
    return {"type": kind, "deck": "D", "content": own | (content or {})} | other


#: Facts, each with the faults it must have.
FACTS: list[tuple[object, tuple[str, ...]]] = [
    (_fact(), ()), (_fact("cloze"), ()), (_fact("list"), ()), (_fact("typed"), ()), (_fact("image_occlusion"), ()), ([], ("not_an_object",)), (_fact() | {"type": "essay"}, ("type",)), (_fact(deck=" "), ("deck",)), (_fact(tags=["a b"]), ("tags",)), (_fact(source=3), ("source",)),
    (_fact(id=" "), ("id",)), (_fact(knowledge_unit_id=""), ("knowledge_unit_id",)), (_fact(knowledge_kind="rumour"), ("knowledge_kind",)), (_fact(origin="hearsay", source="s"), ("origin",)), (_fact(objective_ids=[""]), ("objective_ids",)), (_fact(prerequisite_ids="x"), ("prerequisite_ids",)),
    (_fact(confidence=1.5), ("confidence",)), (_fact(origin="source"), ("source_of_origin",)), (_fact(distractors=[{"text": "x", "grade": "close"}]), ("distractors",)), (_fact("typed", distractors=[{"text": "x", "grade": "near"}]), ("distractors_of_type",)), (_fact() | {"content": "x"}, ("content",)),
    (_fact(content={"front": " "}), ("content_front",)), (_fact(content={"back": None}), ("content_back",)), (_fact(content={"extra": 1}), ("content_extra",)), (_fact(origin="generated-enrichment", source="s"), ("enrichment_label",)), (_fact("cloze", {"text": "plain"}), ("cloze_deletion",)),
    (_fact("cloze", {"text": "`{{c1::b}}`"}), ("cloze_deletion",)), (_fact("list", {"items": ["a"]}), ("list_items",)), (_fact("list", {"title": ""}), ("content_title",)), (_fact("typed", {"hints": ["a", "b", "c", "d"]}), ("typed_hints",)), (_fact("typed", {"prompt": "", "answer": ""}), ("content_prompt", "content_answer")),
    (_fact("image_occlusion", {"image": ""}), ("content_image",)), (_fact("image_occlusion", {"masks": []}), ("masks",)), (_fact("image_occlusion", {"masks": [{"shape": "star"}]}), ("mask_shape",)), (_fact("image_occlusion", {"masks": [{"shape": "rect", "left": 2, "top": 0, "width": 0, "height": 1, "card": 0}]}), ("mask_card", "mask_place", "mask_size")),
    (_fact("image_occlusion", {"masks": [{"shape": "polygon", "left": 0, "top": 0, "points": [[0, 0], [1, 1]]}]}), ("mask_points",)), (_fact("image_occlusion", {"occlude_inactive": "no"}), ("occlude_inactive",)),
]


def fact_fault_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Position of the example and each of its faults; ``none`` where it has none."""
    rows = spark.createDataFrame([(json.dumps(fact),) for fact, _ in FACTS] + [("{broken",)], "value string").coalesce(1)
    read = S.parse_facts(rows).withColumn("at", F.monotonically_increasing_id())
    return read.select("at", F.explode(F.when(F.size("faults") > 0, F.col("faults")).otherwise(F.array(F.lit("none")))).alias("fault"))


#: What ``layout_examples`` gives.
LAYOUTS = [
    ("q", "Basic", "D", "Back, Distractors, Front, Source", "a &lt; b?"), ("code", "Code", "D", "Code, Extra, Front, Source", "run"), ("cloze", "Cloze", "D", "Distractors, Extra, Source, Text", "a {{c1::b}}"),
    ("list", "List", "D", "Source, Text, Title", '<ol class="list"><li>{{c1::a}}</li><li>{{c2::b}}</li></ol>'), ("typed", "Typed", "D", "Answer, Extra, Hint 1, Hint 2, Hint 3, Prompt, Source", "p"),
    ("image_occlusion", "Image Occlusion", "D", "Back Extra, Comments, Header, Image, Occlusion", '<img src="i.png">'),
]


def layout_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Layout and fields of one sound fact of each type, and of one with code."""
    facts = [_fact(id="q", source="s.md:line-1", content={"front": "a < b?", "back": "yes"}), _fact(id="code", tags=[L.CODE_TAG], content={"front": "run", "back": "x = 1"})] + [_fact(kind, id=kind) for kind in V.FACT_TYPES[1:]]
    made = L.notes(S.parse_facts(spark.createDataFrame([(json.dumps(f),) for f in facts], "value string")))
    return made.select("id", "layout", "deck", F.array_join(F.array_sort(F.map_keys("fields")), ", ").alias("names"), F.coalesce(F.col("fields")["Front"], F.col("fields")["Text"], F.col("fields")["Prompt"], F.col("fields")["Image"]).alias("shown"))


#: Study texts, one for each way a unit is cut or asked for.
TEXTS = [
    "Erosion is the wearing away of rock by water.", "The noble metals include gold, silver, and platinum.", "Q: How many seats has the hall?\nA: 12,500", "# Rivers\nObjectives:\n- Define a delta\nYou can name its parts\n\nA delta is a fan of silt at a mouth. The delta of the Nile has two arms.",
    "```python\nx = 1\n```", "$$ F = m a $$", "Call `g(x, y)` to halve. Use an acid, e.g. HCl, with care. Iron is heavy.", "Speed = distance / time\nThis applies except when the road is closed.", "A canal differs from a river because its bed is dug.",
    "Q: What is radar?\nA: Detection by radio echoes.\n\nQ: Who built the first loom?\nA: Nobody knows.", "The three states of matter contain Solid, Liquid, and Gas.", "Beta is <b>bold & new</b>.", "A lone fragment", "After the flood, the village moved uphill.", "Because salt lowers the freezing point, roads stay wet.",
    "The valve is open only when the pump runs.", "![A dam seen from above](dam.png)\nThe dam stores water for the town.", "Glass stores heat and walls reduce noise in every room.", "levee :: a bank that holds a river", "~~~\nnever closed\n# x", "", "Topic: Soil\nClay requires drainage.\nQ: Which layer is dark?\nA: The top\nExtra: It holds humus.\nTags: soil, Top layer",
]


#: The units of TEXTS, as ``unit_examples`` gives them.
UNITS = [
    (0, 0, 1, 'General', 'Erosion is the wearing away of rock by water.', '', '', 'definition', '', ''),
    (1, 0, 1, 'General', 'The noble metals include gold.', 'What is component 1 of 3 in The noble metals?', 'gold', 'taxonomy', '', 'gold|silver|platinum'),
    (1, 1, 1, 'General', 'The noble metals include silver.', 'What is component 2 of 3 in The noble metals?', 'silver', 'taxonomy', '', 'gold|silver|platinum'),
    (1, 2, 1, 'General', 'The noble metals include platinum.', 'What is component 3 of 3 in The noble metals?', 'platinum', 'taxonomy', '', 'gold|silver|platinum'),
    (2, 0, 1, 'General', 'How many seats has the hall? 12,500', 'How many seats has the hall?', '12,500', 'relation', '', ''),
    (3, 0, 6, 'Rivers', 'A delta is a fan of silt at a mouth.', '', '', 'definition', '', ''),
    (3, 1, 6, 'Rivers', 'The delta of the Nile has two arms.', '', '', 'relation', '', ''),
    (4, 0, 1, 'General', 'x = 1', '', '', 'fact', 'code', ''),
    (5, 0, 1, 'General', '$$ F = m a $$', '', '', 'fact', 'math', ''),
    (6, 0, 1, 'General', 'Call `g(x, y)` to halve.', '', '', 'fact', '', ''),
    (6, 1, 1, 'General', 'Use an acid, e.g. HCl, with care.', '', '', 'relation', '', ''),
    (6, 2, 1, 'General', 'Iron is heavy.', '', '', 'definition', '', ''),
    (7, 0, 1, 'General', 'Speed = distance / time', '', '', 'formula', '', ''),
    (7, 1, 2, 'General', 'This applies except when the road is closed.', '', '', 'exception', '', ''),
    (8, 0, 1, 'General', 'A canal differs from a river because its bed is dug.', '', '', 'comparison', '', ''),
    (9, 0, 1, 'General', 'What is radar? Detection by radio echoes.', 'What is radar?', 'Detection by radio echoes.', 'definition', '', ''),
    (9, 1, 4, 'General', 'Who built the first loom? Nobody knows.', 'Who built the first loom?', 'Nobody knows.', 'ordered-process', '', ''),
    (10, 0, 1, 'General', 'The three states of matter contain Solid.', 'What is component 1 of 3 in The three states of matter?', 'Solid', 'taxonomy', '', 'Solid|Liquid|Gas'),
    (10, 1, 1, 'General', 'The three states of matter contain Liquid.', 'What is component 2 of 3 in The three states of matter?', 'Liquid', 'taxonomy', '', 'Solid|Liquid|Gas'),
    (10, 2, 1, 'General', 'The three states of matter contain Gas.', 'What is component 3 of 3 in The three states of matter?', 'Gas', 'taxonomy', '', 'Solid|Liquid|Gas'),
    (11, 0, 1, 'General', 'Beta is <b>bold & new</b>.', '', '', 'definition', '', ''),
    (12, 0, 1, 'General', 'A lone fragment', '', '', 'fact', '', ''),
    (13, 0, 1, 'General', 'After the flood, the village moved uphill.', '', '', 'narrative', '', ''),
    (14, 0, 1, 'General', 'Because salt lowers the freezing point, roads stay wet.', '', '', 'mechanism', '', ''),
    (15, 0, 1, 'General', 'The valve is open only when the pump runs.', '', '', 'exception', '', ''),
    (16, 0, 2, 'General', 'The dam stores water for the town.', '', '', 'fact', '', ''),
    (17, 0, 1, 'General', 'Glass stores heat.', '', '', 'fact', '', ''),
    (17, 1, 1, 'General', 'walls reduce noise in every room.', '', '', 'fact', '', ''),
    (18, 0, 1, 'General', 'levee a bank that holds a river', 'levee', 'a bank that holds a river', 'fact', '', ''),
    (19, 0, 1, 'General', 'never closed\n# x', '', '', 'fact', 'code', ''),
    (21, 0, 2, 'Soil', 'Clay requires drainage.', '', '', 'relation', '', ''),
    (21, 1, 3, 'Soil', 'Which layer is dark? The top', 'Which layer is dark?', 'The top', 'relation', '', ''),
]
#: The cards of TEXTS, as ``card_examples`` gives them.
BUILT = [
    (0, 0, 'reverse', 'Which term means: the wearing away of rock by water?', 'Erosion', '', 'general auto', 1, 0),
    (1, 0, 'qa', 'What is component 1 of 3 in The noble metals?', 'gold', 'GSP: gold, silver, platinum', 'general auto', 1, 0),
    (1, 1, 'qa', 'What is component 2 of 3 in The noble metals?', 'silver', 'GSP: gold, silver, platinum', 'general auto', 1, 0),
    (1, 2, 'qa', 'What is component 3 of 3 in The noble metals?', 'platinum', 'GSP: gold, silver, platinum', 'general auto', 1, 0),
    (2, 0, 'typed', 'How many seats has the hall?', '12,500', '', 'general auto', 1, 0),
    (3, 0, 'reverse', 'Which term means: a fan of silt at a mouth?', 'A delta', '', 'rivers auto', 1, 0),
    (3, 1, 'cloze', 'The delta of the Nile has {{c1::two arms}}.', 'two arms', '', 'rivers auto', 1, 0),
    (4, 0, 'qa', 'What is the formula for x?', '1', '', 'verbatim-code general auto', 1, 0),
    (5, 0, 'qa', 'What expression is displayed?', '$$ F = m a $$', '', 'general auto', 1, 0),
    (6, 2, 'reverse', 'Which term means: heavy?', 'Iron', '', 'general auto', 1, 0),
    (7, 0, 'typed', 'What is the formula for Speed?', 'distance / time', '', 'general auto', 1, 0),
    (7, 1, 'qa', 'What is This applies except when the road?', 'closed', '', 'general auto', 1, 0),
    (8, 0, 'qa', 'How does A canal differ from a river?', 'its bed is dug', '', 'general auto', 1, 0),
    (9, 0, 'reverse', 'Which term means: Detection by radio echoes?', 'radar', '', 'general auto', 1, 0),
    (9, 1, 'qa', 'Who built the first loom?', 'Nobody knows.', '', 'general auto', 1, 0),
    (10, 0, 'qa', 'What is component 1 of 3 in The three states of matter?', 'Solid', 'SLG: Solid, Liquid, Gas', 'general auto', 1, 0),
    (10, 1, 'qa', 'What is component 2 of 3 in The three states of matter?', 'Liquid', 'SLG: Solid, Liquid, Gas', 'general auto', 1, 0),
    (10, 2, 'qa', 'What is component 3 of 3 in The three states of matter?', 'Gas', 'SLG: Solid, Liquid, Gas', 'general auto', 1, 0),
    (11, 0, 'reverse', 'Which term means: &lt;b&gt;bold &amp; new&lt;/b&gt;?', 'Beta', '', 'general auto', 1, 0),
    (13, 0, 'qa', 'What happens after the flood?', 'the village moved uphill', '', 'general auto', 1, 0),
    (14, 0, 'qa', 'What causes this outcome: roads stay wet?', 'salt lowers the freezing point', '', 'general auto', 1, 0),
    (15, 0, 'qa', 'Under what condition is this rule true: The valve is open?', 'the pump runs', '', 'general auto', 1, 0),
    (16, 0, 'image-supported', 'Complete: The dam stores ___.', 'water for the town<br><img src="dam.png" alt="A dam seen from above; this visual cue anchors the relationship tested by the card.">', '', 'general auto', 1, 0),
    (17, 0, 'cloze', 'Glass stores {{c1::heat}}.', 'heat', '', 'general auto', 1, 0),
    (17, 1, 'cloze', 'walls reduce {{c1::noise in every room}}.', 'noise in every room', '', 'general auto', 1, 0),
    (18, 0, 'qa', 'levee', 'a bank that holds a river', '', 'general auto', 1, 0),
    (21, 0, 'cloze', 'Clay requires {{c1::drainage}}.', 'drainage', '', 'soil auto', 1, 0),
    (21, 1, 'qa', 'Which layer is dark?', 'The top', '', 'soil top layer auto', 1, 0),
]


def _texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, text, f"t{n:02d}") for n, text in enumerate(TEXTS)], "doc_id bigint, text string, source_name string").repartition(2, "doc_id")


def unit_examples(spark: SparkSession, folder: str) -> DataFrame:
    units = C.classify_units(U.parse_units(_texts(spark)))
    return units.select("doc_id", "unit_pos", "line_no", "topic", "text", "question", "answer", "kind", "verbatim_kind", F.array_join("group_components", "|").alias("components"))


def card_examples(spark: SparkSession, folder: str) -> DataFrame:
    docs = _texts(spark)
    objectives, units = K.plan_knowledge(docs, C.classify_units(U.parse_units(docs)), F.col("source_name"))
    cards = C.build_cards(units)
    return cards.select("doc_id", "unit_pos", "card_type", "front", "back", "mnemonic", F.array_join("tags", " ").alias("tags"), F.size("objective_ids").alias("objectives"), F.size("prerequisite_ids").alias("prerequisites"))


def unit_faults(spark: SparkSession, folder: str) -> DataFrame:
    units = K.unit_faults(K.current_rows(table(spark, folder, "knowledge_units"), "doc_id", "id"))
    return units.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (card_rule_examples, deck_rule_examples, fact_fault_examples, layout_examples, unit_examples, card_examples, unit_faults)}


def _value(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return "(select * from (values " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + f") t({names}))"


_DECK_NAMES = ("learning_steps", "graduating_interval_days", "easy_interval_days", "starting_ease_percent", "max_ease_percent", "new_cards_per_day", "scheduler", "easy_button_policy", "interleave_topics")


def _decks() -> list[tuple]:
    out = []
    for k, (other, n, runs) in enumerate(DECKS):
        own = vars(R.Scheduler(**other))
        out.append((f"d{k:02d}", " ".join(own["learning_steps"]), *(own[c] for c in _DECK_NAMES[1:]), n, runs))
    return out


_DECK_TESTS = {
    "EMPTY_DECK": ("error", "n = 0"), "DAILY_LIMIT": ("error", "new_cards_per_day > 20"), "GRADUATING_INTERVAL": ("warning", "graduating_interval_days <> 3"), "EASY_INTERVAL": ("warning", "easy_interval_days <> 7"), "EASE_CAP": ("error", "max_ease_percent > 250"),
    "STARTING_EASE": ("error", "starting_ease_percent > max_ease_percent"), "EASY_POLICY": ("error", "easy_button_policy <> 'avoid'"), "INTERLEAVING": ("warning", "interleave_topics and runs"),
    "FSRS_LONG_STEP": ("error", r"scheduler = 'fsrs' and len(list_filter(string_split(learning_steps, ' '), lambda x: not regexp_full_match(x, '\d+[mhd]') or ends_with(x, 'd') or (ends_with(x, 'h') and try_cast(rtrim(x, 'h') as int) >= 24))) > 0"),
}
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_blank = lambda c: f"trim(coalesce({c}, ''), e' \\t\\r\\n') = ''"
_UNIT_TESTS = {
    **{c: _blank(c) for c in ("id", "text", "source")}, "confidence": "not coalesce(confidence between 0 and 1, false)",
    **{c: f"coalesce({c}, '') not in ({_in(known)})" for c, known in (("kind", V.KNOWLEDGE_KINDS), ("purpose", V.LEARNING_PURPOSES), ("origin", V.ORIGINS), ("status", V.UNIT_STATUSES))},
}
SQL = {
    "card_rule_examples": card_rule_sql(_values(_cards(), ", ".join(f.split()[0] for f in _CARD_SCHEMA.split(", ")))) + "select card_id, split_part(v, '|', 1) code, split_part(v, '|', 2) as level from b",
    "deck_rule_examples": f"with s as {_values(_decks(), 'deck, ' + ', '.join(_DECK_NAMES) + ', n, runs')} " + " union all ".join(f"select deck, '{code}' code, '{level}' as level from s where {test}" for code, (level, test) in _DECK_TESTS.items()),
    "fact_fault_examples": "select \"at\"::bigint as \"at\", fault from " + _values([(k, f) for k, (_, faults) in enumerate([*FACTS, (None, ("not_json",))]) for f in faults or ("none",)], '"at", fault'),
    "unit_examples": "select doc_id::bigint doc_id, * exclude (doc_id) from " + _values(UNITS, "doc_id, unit_pos, line_no, topic, text, question, answer, kind, verbatim_kind, components"),
    "card_examples": "select doc_id::bigint doc_id, * exclude (doc_id) from " + _values(BUILT, "doc_id, unit_pos, card_type, front, back, mnemonic, tags, objectives, prerequisites"),
    "layout_examples": "select * from " + _values(LAYOUTS, "id, layout, deck, names, shown"),
    "unit_faults": f"with u as {_U}, f as (select unnest(list_filter([{', '.join(f'case when {t} then {chr(39)}{n}{chr(39)} end' for n, t in _UNIT_TESTS.items())}], lambda v: v is not null)) fault from u) select fault, count(*) n from f group by 1",
}
