"""Facts: layout-free units of knowledge as JSON lines, with their contract.

The contract depends on JSON's own types (a bool is no number, a tag must be a
string), so lines are judged on the parsed JSON in Python on Arrow batches, and
the typed columns are given beside the violations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V

_CLOZE_MARK = re.compile(r"\{\{c\d+::")
_NOTES = ("extra", "context", "mnemonic", "topic")
#: Content of each type: members that must have text, and those that may be strings.
CONTENT = {
    "qa": (("front", "back"), _NOTES),
    "cloze": (("text",), _NOTES),
    "list": (("title",), _NOTES),
    "typed": (("prompt", "answer"), _NOTES),
    "image_occlusion": (("image",), ("header", "back_extra", "comments")),
}
PROMPT = {"qa": "front", "cloze": "text", "list": "title", "typed": "prompt", "image_occlusion": "header"}
MASK_SIZES = {"rect": ("width", "height"), "ellipse": ("rx", "ry"), "polygon": ()}


def _has_text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _unit(value: Any) -> bool:
    return _number(value) and 0 <= value <= 1


def _mask_faults(mask: Any) -> Iterator[str]:
    if not isinstance(mask, dict) or mask.get("shape") not in MASK_SIZES:
        yield "mask_shape"
        return
    card = mask.get("card")
    if card is not None and (isinstance(card, bool) or not isinstance(card, int) or card < 1):
        yield "mask_card"
    if not (_unit(mask.get("left")) and _unit(mask.get("top"))):
        yield "mask_place"
    if not all(_unit(mask.get(k)) and mask[k] > 0 for k in MASK_SIZES[mask["shape"]]):
        yield "mask_size"
    if mask["shape"] == "polygon":
        points = mask.get("points")
        sound = isinstance(points, list) and len(points) > 2 and all(isinstance(p, list) and len(p) == 2 and all(map(_unit, p)) for p in points)
        if not sound:
            yield "mask_points"


def fact_faults(fact: Any) -> list[str]:
    """Codes of every broken clause of the contract, in order."""
    if not isinstance(fact, dict):
        return ["not_an_object"]
    out: list[str] = []
    check = lambda ok, code: out.append(code) if not ok else None
    kind, content = fact.get("type", ""), fact.get("content") or {}
    check(kind in CONTENT, "type")
    check(_has_text(fact.get("deck", "")), "deck")
    tags = fact.get("tags") or []
    check(isinstance(tags, list) and all(_has_text(t) and not re.search(r"\s", t) for t in tags), "tags")
    source = fact.get("source")
    check(source is None or isinstance(source, str), "source")
    for name in ("id", "knowledge_unit_id"):
        check(fact.get(name) is None or _has_text(fact[name]), name)
    for name, known in (("knowledge_kind", V.KNOWLEDGE_KINDS), ("origin", V.ORIGINS)):
        check(fact.get(name) is None or fact[name] in known, name)
    for name in ("objective_ids", "prerequisite_ids"):
        ids = fact.get(name) or []
        check(isinstance(ids, list) and all(map(_has_text, ids)), name)
    check(fact.get("confidence") is None or _unit(fact["confidence"]), "confidence")
    check(fact.get("origin") is None or _has_text(source), "source_of_origin")
    distractors = fact.get("distractors") or []
    sound = isinstance(distractors, list) and all(isinstance(d, dict) and _has_text(d.get("text")) and d.get("grade") in V.DISTRACTOR_GRADES for d in distractors)
    check(sound, "distractors")
    check(not distractors or kind in ("qa", "cloze"), "distractors_of_type")
    if not isinstance(content, dict):
        return [*out, "content"]
    if kind not in CONTENT:
        return out
    must, may = CONTENT[kind]
    for name in must:
        check(_has_text(content.get(name)), f"content_{name}")
    for name in may:
        check(name not in content or isinstance(content[name], str), f"content_{name}")
    if fact.get("origin") == "generated-enrichment":
        shown = content.get(PROMPT[kind], "")
        check(isinstance(shown, str) and "Enrichment:" in shown, "enrichment_label")
    if kind == "cloze" and _has_text(content.get("text")):
        check(bool(_CLOZE_MARK.search(re.sub(V.VERBATIM, " ", content["text"]))), "cloze_deletion")
    if kind == "list":
        items = content.get("items")
        check(isinstance(items, list) and len(items) > 1 and all(map(_has_text, items)), "list_items")
    if kind == "typed":
        hints = content.get("hints", [])
        check(isinstance(hints, list) and len(hints) <= 3 and all(map(_has_text, hints)), "typed_hints")
    if kind == "image_occlusion":
        masks = content.get("masks")
        check(isinstance(masks, list) and bool(masks), "masks")
        for mask in masks if isinstance(masks, list) else []:
            out.extend(_mask_faults(mask))
        check(isinstance(content.get("occlude_inactive", True), bool), "occlude_inactive")
    return out


FACT_FIELDS = (
    "type string, deck string, tags array<string>, source string, id string, knowledge_unit_id string, knowledge_kind string, objective_ids array<string>, "
    "prerequisite_ids array<string>, origin string, confidence double, content string, distractors array<struct<text:string,grade:string>>, faults array<string>"
)


def _fact_rows(default_deck: str, tag: str | None):
    names = re.findall(r"(?:^|, )(\w+) (?=string|array|double)", FACT_FIELDS)

    def row(text: str) -> list | None:
        if not (text or "").strip():
            return None
        try:
            fact = json.loads(text)
        except ValueError:
            return [None] * (len(names) - 1) + [["not_json"]]
        if isinstance(fact, dict):
            if not _has_text(fact.get("deck", "")) and default_deck and isinstance(fact.get("deck", ""), str):
                fact["deck"] = default_deck
            if tag and isinstance(fact.get("tags") or [], list) and tag not in (fact.get("tags") or []):
                fact["tags"] = [*(fact.get("tags") or []), tag]
        faults = fact_faults(fact)
        if not isinstance(fact, dict) or faults:
            return [None] * (len(names) - 1) + [faults]
        flat = {**fact, "content": json.dumps(fact["content"], ensure_ascii=False, separators=(",", ":")), "faults": [], "confidence": None if fact.get("confidence") is None else float(fact["confidence"])}
        return [flat.get(n) if n not in ("tags", "objective_ids", "prerequisite_ids", "distractors") else flat.get(n) or [] for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for r in map(row, batch["value"]) if r is not None], columns=names)

    return run


def parse_facts(lines: DataFrame, default_deck: str = "", tag: str | None = None) -> DataFrame:
    """JSON lines (``value``) as FACT_FIELDS. Blank lines are skipped; a line that
    breaks the contract has its faults and null columns; a missing deck and tag are
    filled in first."""
    return lines.select("value").mapInPandas(_fact_rows(default_deck, tag), FACT_FIELDS)


def read_facts(spark: SparkSession, path: str, default_deck: str = "", tag: str | None = None, strict: bool = True) -> DataFrame:
    """Facts of a JSONL file or folder. ``strict``: a broken line fails the read."""
    facts = parse_facts(spark.read.text(path), default_deck, tag)
    if not strict:
        return facts
    broken = F.concat(F.lit("broken fact: "), F.array_join("faults", ", "))
    return facts.withColumn("faults", F.when(F.size("faults") > 0, F.raise_error(broken).cast("array<string>")).otherwise(F.col("faults")))


def fact_lines(facts: DataFrame) -> DataFrame:
    """One compact JSON object per fact; what is null or empty is left out."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    body = F.to_json(F.struct("type", F.lit("\x00").alias("content"), "deck", "tags", "source", some("distractors"), "id", "knowledge_unit_id", "knowledge_kind", "origin", "confidence", some("objective_ids"), some("prerequisite_ids")))
    return facts.select(F.replace(body, F.lit('"\\u0000"'), F.col("content")).alias("value"))


def card_facts(cards: DataFrame, deck: str = "Study", mark: str = "refined") -> DataFrame:
    """Cards as facts, as JSON lines with their card_id: cloze and typed cards keep
    their type, all others ask and answer. Rows without an id are left out."""
    c = {n: unescaped(n) for n in ("front", "back", "extra", "context", "mnemonic", "topic", "source")}
    notes = [c[n].alias(n) for n in _NOTES]
    kind = F.when(F.btrim("card_type").isin("cloze", "typed"), F.btrim("card_type")).otherwise("qa")
    content = (
        F.when(kind == "cloze", F.to_json(F.struct(c["front"].alias("text"), *notes)))
        .when(kind == "typed", F.to_json(F.struct(c["front"].alias("prompt"), c["back"].alias("answer"), *notes)))
        .otherwise(F.to_json(F.struct(c["front"].alias("front"), c["back"].alias("back"), *notes)))
    )
    none = F.array().cast("array<string>")
    tagged = lambda prefix, col: F.when(T.text_or_empty(F.col(col)) != "", F.array(F.concat(F.lit(prefix), F.col(col)))).otherwise(none)
    ids = lambda col: F.filter(F.transform(F.coalesce(col, none), lambda x: F.btrim(x)), lambda x: x.isNotNull() & (x != ""))
    tags = F.array_distinct(F.concat(F.coalesce("tags", none), F.array(F.lit(mark), F.concat(F.lit("id-"), F.col("card_id"))), tagged("kind-", "knowledge_kind"), tagged("origin-", "origin"), F.transform(ids("objective_ids"), lambda x: F.concat(F.lit("objective-"), x))))
    text = lambda col: F.nullif(F.btrim(F.col(col)), F.lit(""))
    rows = cards.where(text("card_id").isNotNull()).select(
        "card_id", kind.alias("type"), content.alias("content"), F.lit(deck).alias("deck"), tags.alias("tags"), F.nullif(c["source"], F.lit("")).alias("source"),
        F.col("card_id").alias("id"), text("knowledge_unit_id").alias("knowledge_unit_id"), text("knowledge_kind").alias("knowledge_kind"), text("origin").alias("origin"), "confidence",
        ids("objective_ids").alias("objective_ids"), ids("prerequisite_ids").alias("prerequisite_ids"), F.array().cast("array<struct<text:string,grade:string>>").alias("distractors"),
    )
    some = lambda col: F.when(F.size(col) > 0, F.col(col)).alias(col)
    body = F.to_json(F.struct("type", F.lit("\x00").alias("content"), "deck", "tags", "source", "id", "knowledge_unit_id", "knowledge_kind", "origin", "confidence", some("objective_ids"), some("prerequisite_ids")))
    return rows.select("card_id", F.replace(body, F.lit('"\\u0000"'), F.col("content")).alias("value"))


def unescaped(name: str):
    return T.unescape_html(T.text_or_empty(F.col(name)))
