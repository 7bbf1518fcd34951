"""Cards drafted elsewhere (by a person or a program), grounded in their units.

Units go out as JSON prompts; drafts come back as JSON and become cards only if
they name a unit and cite evidence that stands in it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.sources.tables import BLANKS

DRAFT = "struct<front:string,back:string,extra:string,context:string,mnemonic:string,card_type:string,source_unit_id:string,evidence:string,tags:array<string>,topic:string,source:string,confidence:string>"
_TASK = "Write study cards that rest on the units. Answer with JSON only."
_SHAPE = '{"cards":[{"front":"","back":"","extra":"","context":"","card_type":"qa|cloze|reverse|typed|list","source_unit_id":"","evidence":"","tags":[],"confidence":0.0}]}'
_UNIT = ("unit_id", "text", "question", "answer", "extra", "topic", "source", "kind", "purpose")


def prompts(units: DataFrame, key: str = "doc_id", per_prompt: int = 50) -> DataFrame:
    """(key, part, prompt): JSON prompts with the units of a document, in order, at
    most ``per_prompt`` in one, so no prompt grows with a document."""
    own = [F.col(c) if c in units.columns else F.lit("").alias(c) for c in _UNIT]
    item = F.struct("unit_pos", F.struct(own[0].alias("source_unit_id"), *own[1:]).alias("unit"))
    rows = units.groupBy(key, F.floor(F.col("unit_pos") / per_prompt).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    listed = F.to_json(F.transform("items", lambda x: x["unit"]))
    return rows.select(key, "part", F.concat(F.lit(f'{{"task":"{_TASK}","schema":{_SHAPE},"source_units":'), listed, F.lit("}")).alias("prompt"))


def answered(asked: DataFrame, command: list[str] | None = None, complete: Callable[[str], str] | None = None, timeout: float = 120.0) -> DataFrame:
    """Prompts with ``payload``, from a command that reads a prompt and writes JSON, or
    from a function. Opt-in: it runs a process on the workers."""
    if (command is None) == (complete is None):
        raise ValueError("give a command or a function")

    def ask(prompt: str) -> str:
        if complete is not None:
            return complete(prompt)
        done = subprocess.run(command, input=prompt, capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"the command ended with {done.returncode}: {done.stderr[-300:]}")
        return done.stdout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(payload=[ask(p) for p in batch["prompt"]])

    schema = ", ".join([*(f"`{n}` {k}" for n, k in asked.dtypes), "payload string"])
    return asked.mapInPandas(run, schema)


def read_drafts(payloads: DataFrame) -> DataFrame:
    """Drafts in the ``payload`` JSON, one row each; ``draft`` is null and ``fault``
    ``not_json`` or ``no_cards`` where there are none."""
    made = payloads.select(F.from_json("payload", f"cards array<{DRAFT}>").alias("p"), F.expr("try_parse_json(payload)").isNull().alias("bad"))
    fault = F.when(F.col("bad"), "not_json").when(F.coalesce(F.size("p.cards"), F.lit(0)) <= 0, "no_cards")
    return made.select(fault.alias("fault"), F.explode_outer("p.cards").alias("draft"))


def _has(name: str) -> Column:
    return F.btrim(T.text_or_empty(F.col(f"draft.{name}"))) != ""


def judged(drafts: DataFrame, units: DataFrame) -> DataFrame:
    """Drafts with their unit and the first fault: missing_field, unknown_unit,
    unsupported_evidence, card_type, confidence; null for a sound one.

    A hash join on the unit's id; the evidence is a substring test on joined rows.
    """
    own = {c: T.text_or_empty(F.col(c)) if c in units.columns else F.lit("") for c in (*_UNIT[1:], "origin")}
    hay = T.compact(F.concat_ws(" ", *(F.nullif(own[c], F.lit("")) for c in ("text", "question", "answer", "extra"))))
    known = units.select(F.col("unit_id").alias("uid"), F.struct(hay.alias("hay"), *(c.alias(n) for n, c in own.items())).alias("unit"))
    joined = drafts.withColumn("uid", F.btrim("draft.source_unit_id")).join(known, "uid", "left")
    complete = _has("front") & _has("back") & _has("extra") & _has("card_type") & _has("source_unit_id") & _has("evidence")
    number = F.col("draft.confidence")
    sound = number.isNull() | number.try_cast("double").isNotNull()
    fault = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~complete, "missing_field")
        .when(F.col("unit").isNull(), "unknown_unit")
        .when(~F.contains("unit.hay", T.compact(F.btrim("draft.evidence"))), "unsupported_evidence")
        .when(~F.btrim("draft.card_type").isin(*V.CARD_TYPES), "card_type")
        .when(~sound, "confidence")
    )
    return joined.withColumn("fault", fault)


def drafted_cards(drafts: DataFrame, units: DataFrame) -> DataFrame:
    """Cards of the sound drafts, with HTML escaped and ids from front, back and source."""
    rows = judged(drafts, units).where("fault is null")
    field = lambda name: T.escape_html(T.text_or_empty(F.col(f"draft.{name}")))
    front, back = field("front"), field("back")
    background = F.concat(T.escape_html("unit.topic"), F.lit(" background is assumed; review "), T.escape_html("unit.source"), F.lit(" if unfamiliar."))
    default = F.when(T.needs_context(front, back), background).otherwise(F.concat(F.lit("Topic: "), T.escape_html("unit.topic"), F.lit(".")))
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(F.filter(F.coalesce("draft.tags", none), lambda t: F.btrim(t) != ""), F.array(F.lit("drafted"), F.lit("auto"))))
    or_unit = lambda name: F.coalesce(F.nullif(field(name), F.lit("")), T.escape_html(f"unit.{name}"))
    return rows.select(
        front.alias("front"), back.alias("back"), field("extra").alias("extra"), F.when(_has("context"), field("context")).otherwise(default).alias("context"), field("mnemonic").alias("mnemonic"),
        F.btrim("draft.card_type").alias("card_type"), tags.alias("tags"), or_unit("topic").alias("topic"), or_unit("source").alias("source"), T.stable_card_id(front, back, F.col("unit.source")).alias("card_id"),
        F.col("uid").alias("knowledge_unit_id"), F.col("unit.kind").alias("knowledge_kind"), F.col("unit.purpose").alias("learning_purpose"), F.col("unit.origin").alias("origin"), F.coalesce(F.col("draft.confidence").try_cast("double"), F.lit(1.0)).alias("confidence"),
    )


def draft_faults(drafts: DataFrame, units: DataFrame) -> DataFrame:
    made = judged(drafts, units)
    return made.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


STUDY_ROW = "struct<text:string,source_unit_id:string,evidence:string>"


def read_study_rows(payloads: DataFrame) -> DataFrame:
    """(section, text, source_unit_id, evidence): notes and the summary of study notes in
    the ``payload`` JSON; text that isn't JSON gives one row of nulls."""
    made = payloads.select(F.from_json("payload", f"notes array<{STUDY_ROW}>, summary {STUDY_ROW}").alias("p"))
    notes = F.transform(F.coalesce("p.notes", F.array().cast(f"array<{STUDY_ROW}>")), lambda r: F.struct(F.lit("notes").alias("section"), r["text"].alias("text"), r["source_unit_id"].alias("source_unit_id"), r["evidence"].alias("evidence")))
    summary = F.when(F.col("p.summary").isNotNull(), F.array(F.struct(F.lit("summary").alias("section"), "p.summary.text", "p.summary.source_unit_id", "p.summary.evidence")))
    return made.select(F.inline_outer(F.concat(notes, F.coalesce(summary, F.array().cast("array<struct<section:string,text:string,source_unit_id:string,evidence:string>>")))))


def judged_study_rows(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Study rows with their first fault: missing_field, unknown_unit, several_lines,
    heading, unsupported_evidence (it isn't in the unit), unsupported_text (it isn't in
    the evidence); null for a sound row. Spaces and case don't count."""
    hay = F.concat_ws(" ", *(F.nullif(T.text_or_empty(F.col(c)), F.lit("")) for c in ("text", "question", "answer", "extra") if c in units.columns))
    known = units.select(F.col("unit_id").alias("source_unit"), T.compact(hay).alias("hay"))
    bare = lambda c: F.btrim(T.text_or_empty(F.col(c)), F.lit(BLANKS))
    joined = rows.withColumn("source_unit", bare("source_unit_id")).join(known, "source_unit", "left")
    text, evidence = bare("text"), T.compact(bare("evidence"))
    fault = (
        F.when((text == "") | (bare("evidence") == "") | (F.col("source_unit") == ""), "missing_field").when(F.col("hay").isNull(), "unknown_unit").when(text.rlike(r"[\r\n\t]"), "several_lines")
        .when(text.rlike(r"(^|\s)#{1,6}\s+"), "heading").when(~F.contains("hay", evidence), "unsupported_evidence").when(~F.contains(evidence, F.rtrim(T.compact(text), F.lit("."))), "unsupported_text")
    )
    return joined.select("section", "text", "source_unit_id", fault.alias("fault"))
