"""Quality rules of cards and decks, each a Column; reports as aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V


@dataclass(frozen=True)
class Scheduler:
    """Settings of the review scheduler that deck rules look at."""

    learning_steps: tuple[str, ...] = ("10m", "1d")
    graduating_interval_days: int = 3
    easy_interval_days: int = 7
    starting_ease_percent: int = 250
    max_ease_percent: int = 250
    new_cards_per_day: int = 20
    scheduler: str = "legacy-sm2"
    easy_button_policy: str = "avoid"
    interleave_topics: bool = True


#: What to do about each broken rule of a card.
REMEDIES = {
    "MISSING_CONTENT": "Add one clear prompt and its answer.",
    "MISSING_SOURCE": "Name the page, slide or line it comes from.",
    "UNLABELED_ENRICHMENT": "Mark added material with 'Enrichment:'.",
    "UNLABELED_INFERENCE": "Mark it with 'Inference:' or as from the source.",
    "INVALID_CONFIDENCE": "Give a confidence from 0 to 1.",
    "INVALID_KNOWLEDGE_KIND": "Use a known kind of knowledge.",
    "INVALID_LEARNING_PURPOSE": "Use a known purpose.",
    "INVALID_ORIGIN": "Use a known origin.",
    "FRONT_TOO_LONG": "Shorten or split the prompt.",
    "MISSING_EXPLANATION": "Explain the answer in the extra.",
    "MISSING_CONTEXT": "Give the background it takes for granted.",
    "INVALID_CARD_TYPE": "Use a known card type.",
    "CLOZE_FORMAT": "Mark a deletion or change the type.",
    "TYPE_FORMAT_MISMATCH": "Ask directly or make it a cloze card.",
    "REVERSE_FORMAT": "Ask for the term of a definition or change the type.",
    "LIST_SIZE": "Give three to eight items.",
    "MNEMONIC_MISMATCH": "Start the mnemonic with the initials of the items.",
    "COGNITIVE_LOAD": "Split it into cards of at most four parts.",
    "ATOMICITY_REVIEW": "Split clauses that stand alone.",
    "MISSING_MNEMONIC": "Add a mnemonic for the set.",
    "GENERIC_PROMPT": "Ask for one fact.",
    "THIN_EXPLANATION": "Say why the fact holds.",
    "IMAGE_TYPE": "Make it an image-supported card.",
    "IMAGE_ALT": "Say what the image cues.",
}


_TEXTS = ("front", "back", "extra", "context", "mnemonic", "card_type", "image_url", "image_alt", "source", "knowledge_kind", "learning_purpose", "origin")


def measured(cards: DataFrame) -> DataFrame:
    """Cards with all that the rules look at, each computed once: ``c`` the texts, nulls
    as empty, ``p`` front and back without marks, ``m`` what is counted in them."""
    c = {n: T.text_or_empty(F.col(n)) for n in _TEXTS}
    rows = T.once(cards, c=F.struct(*(v.alias(n) for n, v in c.items()), F.coalesce(F.col("confidence"), F.lit(1.0)).alias("confidence")))
    rows = T.once(rows, p=F.struct(T.plain(F.col("c.front")).alias("front"), T.plain(F.col("c.back")).alias("back")))
    answers = F.when(F.col("c.card_type") == "list", T.answer_items(F.col("p.back")))
    return T.once(rows, m=F.struct(
        F.size(T.words(F.col("p.front"))).alias("front_words"), answers.alias("answers"), F.size(T.members_of(F.col("p.back"))).alias("members"), T.components_of(F.col("p.back")).alias("components"),
        T.compound_of(F.col("p.back")).alias("compound"), T.has_cloze(F.col("c.front")).alias("cloze"), T.needs_context(F.col("c.front"), F.col("c.back")).alias("needs_context"),
        T.semantic_tokens(F.col("c.extra")).alias("said"), T.semantic_tokens(F.concat_ws(" ", "c.front", "c.back")).alias("asked"),
    ))


def card_rules() -> list[tuple[str, str, Column, str]]:
    """(code, level, condition of violation, remedy) over ``measured`` cards.
    A null confidence is the default, 1."""
    c, m = {n: F.col(f"c.{n}") for n in (*_TEXTS, "confidence")}, {n: F.col(f"m.{n}") for n in ("front_words", "answers", "members", "components", "compound", "cloze", "needs_context", "said", "asked")}
    blank = lambda x: F.btrim(x) == ""
    is_list = c["card_type"] == "list"
    sized = F.size(m["answers"]).between(3, V.MAX_LIST_ITEMS)
    prefix = F.upper(F.btrim(F.substring_index(c["mnemonic"], ":", 1)))
    image = c["image_url"] != ""
    rules = [
        ("MISSING_CONTENT", "error", blank(c["front"]) | blank(c["back"])),
        ("MISSING_SOURCE", "error", blank(c["source"])),
        ("UNLABELED_ENRICHMENT", "error", (c["origin"] == "generated-enrichment") & ~c["extra"].contains("Enrichment:")),
        ("UNLABELED_INFERENCE", "warning", (c["origin"] == "inferred") & ~c["extra"].contains("Inference:")),
        ("INVALID_CONFIDENCE", "error", F.isnan(c["confidence"]) | ~c["confidence"].between(0, 1)),
        ("INVALID_KNOWLEDGE_KIND", "error", ~c["knowledge_kind"].isin(*V.KNOWLEDGE_KINDS)),
        ("INVALID_LEARNING_PURPOSE", "error", ~c["learning_purpose"].isin(*V.LEARNING_PURPOSES)),
        ("INVALID_ORIGIN", "error", ~c["origin"].isin(*V.ORIGINS)),
        ("FRONT_TOO_LONG", "error", m["front_words"] > V.MAX_FRONT_WORDS),
        ("MISSING_EXPLANATION", "error", blank(c["extra"])),
        ("MISSING_CONTEXT", "error", m["needs_context"] & blank(c["context"])),
        ("INVALID_CARD_TYPE", "error", ~c["card_type"].isin(*V.CARD_TYPES)),
        ("CLOZE_FORMAT", "error", (c["card_type"] == "cloze") & ~m["cloze"]),
        ("TYPE_FORMAT_MISMATCH", "error", (c["card_type"] != "cloze") & m["cloze"]),
        ("REVERSE_FORMAT", "error", (c["card_type"] == "reverse") & ~c["front"].startswith("Which term means:")),
        ("LIST_SIZE", "error", is_list & ~sized),
        ("MNEMONIC_MISMATCH", "error", is_list & sized & (prefix != T.initials(m["answers"]))),
        ("COGNITIVE_LOAD", "error", ~is_list & (m["components"] > V.MAX_COMPONENTS)),
        ("ATOMICITY_REVIEW", "warning", ~is_list & m["compound"]),
        ("MISSING_MNEMONIC", "error", (m["members"] >= 3) & blank(c["mnemonic"])),
        ("GENERIC_PROMPT", "warning", T.generic_of(F.col("p.front"))),
        ("THIN_EXPLANATION", "warning", F.size(F.array_except(m["said"], m["asked"])) == 0),
        ("IMAGE_TYPE", "error", image & (c["card_type"] != "image-supported")),
        ("IMAGE_ALT", "error", image & ~T.alt_explains(c["image_alt"])),
    ]
    return [(code, level, bad, REMEDIES[code]) for code, level, bad in rules]


def violations(cards: DataFrame) -> DataFrame:
    """(card_id, code, level, action), one row per broken rule. Rules are evaluated
    in one projection; nothing is shuffled."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(action).alias("action"))) for code, level, bad, action in card_rules()]
    return measured(cards).select("card_id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def deck_violations(spark: SparkSession, settings: Scheduler, n_cards: int, has_runs: bool) -> DataFrame:
    """Rules on the deck as a whole: (code, level)."""
    from cardmill.functions.steps import step_is_long

    s = settings
    rules = [
        ("EMPTY_DECK", "error", n_cards == 0), ("DAILY_LIMIT", "error", s.new_cards_per_day > 20),
        ("GRADUATING_INTERVAL", "warning", s.graduating_interval_days != 3), ("EASY_INTERVAL", "warning", s.easy_interval_days != 7),
        ("EASE_CAP", "error", s.max_ease_percent > 250), ("STARTING_EASE", "error", s.starting_ease_percent > s.max_ease_percent),
        ("EASY_POLICY", "error", s.easy_button_policy != "avoid"), ("FSRS_LONG_STEP", "error", s.scheduler == "fsrs" and any(map(step_is_long, s.learning_steps))),
        ("INTERLEAVING", "warning", s.interleave_topics and has_runs),
    ]
    return spark.createDataFrame([(code, level) for code, level, bad in rules if bad], "code string, level string")


def rule_counts(cards: DataFrame) -> DataFrame:
    return violations(cards).groupBy("code", "level").agg(F.count("*").alias("n"))


def duplicates(cards: DataFrame) -> DataFrame:
    """(front, back, n) of pairs that several cards have, case aside."""
    low = lambda c: F.lower(T.text_or_empty(F.col(c)))
    return cards.groupBy(low("front").alias("front"), low("back").alias("back")).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_violations(cards: DataFrame) -> DataFrame:
    """DUPLICATE_CARD, one row per pair that several cards have, named by its least card_id."""
    low = lambda c: F.lower(T.text_or_empty(F.col(c)))
    groups = cards.groupBy(low("front").alias("front"), low("back").alias("back")).agg(F.min("card_id").alias("card_id"), F.count("*").alias("n")).where("n > 1")
    return groups.select("card_id", F.lit("DUPLICATE_CARD").alias("code"), F.lit("warning").alias("level"), F.lit("Keep one of the equal cards.").alias("action"))


def audit_summary(cards: DataFrame) -> DataFrame:
    """One row: cards, errors, warnings, fronts over the limit, image cards, distinct
    topics, cards of each type, and the verdict. One pass over the cards."""
    rules = card_rules()
    count = lambda level: F.size(F.filter(F.array(*(F.coalesce(bad, F.lit(False)) for _, lv, bad, _ in rules if lv == level)), lambda x: x))
    kinds = [F.count_if(F.col("card_type") == t).alias(t.replace("-", "_")) for t in V.CARD_TYPES]
    judged = T.once(measured(cards), e=count("error").cast("bigint"), w=count("warning").cast("bigint")).select("card_type", "topic", "c.image_url", "e", "w", (F.col("m.front_words") > V.MAX_FRONT_WORDS).alias("long"))
    sums = judged.agg(F.count("*").alias("cards"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.count_if("long").alias("fronts_over_limit"), F.count_if(F.col("image_url") != "").alias("image_cards"), F.count_distinct("topic").alias("topics"), *kinds)
    return sums.withColumn("verdict", F.when((F.col("errors") == 0) & (F.col("cards") > 0), "PASS").otherwise("FAIL"))
