"""Sinks: card CSV, JSON sidecars, note lines, study notes in Markdown, a local note service."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.sources.card_records import COLUMNS, RecordParser
from cardmill.sources.settings import local_url

_FROM = dict(zip(COLUMNS, ("front", "back", "extra", "context", "mnemonic", "card_type", "tags", "image_url", "image_alt", "topic", "source", "card_id", "knowledge_unit_id", "knowledge_kind", "learning_purpose", "objective_ids", "prerequisite_ids", "origin", "confidence")))


def csv_cards(cards: DataFrame) -> DataFrame:
    """Cards as the 19 text columns of the card CSV."""
    kinds = dict(cards.dtypes)

    def cell(name: str) -> Column:
        own = _FROM[name]
        if own not in kinds:
            return F.lit("1.0000" if name == "Confidence" else "source" if name == "Origin" else "")
        if kinds[own].startswith("array"):
            return F.array_join(F.array_distinct(F.coalesce(own, F.array().cast("array<string>"))), " ")
        if name == "Confidence":
            return F.format_string("%.4f", F.coalesce(own, F.lit(1.0)))
        return T.text_or_empty(F.col(own).cast("string"))

    return cards.select(*(cell(n).alias(n) for n in COLUMNS))


def write_card_csv(cards: DataFrame, path: str) -> None:
    csv_cards(cards).write.mode("error").csv(path, header=True, escape='"', quote='"', emptyValue="")


#: Columns that a card CSV must have.
REQUIRED = ("Front", "Back", "Extra", "Mnemonic", "CardType", "Tags")
_READ = ", ".join(f"{_FROM[n]} {'array<string>' if n in ('Tags', 'ObjectiveIDs', 'PrerequisiteIDs') else 'double' if n == 'Confidence' else 'string'}" for n in COLUMNS) + ", file string, record int, row_error string"
_DEFAULTS = {"Topic": "General", "KnowledgeKind": "fact", "LearningPurpose": "recall", "Origin": "source"}


def _card_file(name: str, text: str) -> Iterator[list]:
    """Rows of _READ of one file. Records count from 1, the header's number."""
    text = text.removeprefix("\ufeff")
    header = next(RecordParser(text).parse()).values
    records = RecordParser(text, max(1, len(header))).parse()
    next(records)
    if any(c not in header for c in REQUIRED):
        yield [None] * len(COLUMNS) + [name, 1, "CSV_FIELDS"]
        return
    for number, record in enumerate(records, 2):
        cells = {} if record.error else dict(zip(header, record.values))
        if not record.error and not any(cells.values()) and len(record.values) == 1:
            continue  # a blank line
        own = {n: (cells.get(n) or "").strip() for n in COLUMNS}
        own = own | {n: own[n] or d for n, d in (_DEFAULTS | {"Source": f"{name}:line-{number}", "CardID": f"line-{number}"}).items()}
        try:
            confidence = float(own["Confidence"] or 1.0)
        except ValueError:
            confidence = None
        lists = {n: own[n].split() for n in ("Tags", "ObjectiveIDs", "PrerequisiteIDs")}
        yield [*((own | lists | {"Confidence": confidence})[n] for n in COLUMNS), name, number, "CSV_ROW" if confidence is None or record.error else None]


def read_card_csv(spark, path: str) -> DataFrame:
    """Card CSV files with defaults for what is blank. ``record`` counts the records of
    each file, the header being 1; a blank source or id names it. ``row_error``: CSV_ROW
    for a bad confidence or broken quotes, CSV_FIELDS (one row, no card) for a file that
    lacks a column it must have. Each file is read in one task."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _READ.split(", ")]
        for batch in batches:
            rows = [row for name, text in zip(batch["file"], batch["value"]) for row in _card_file(name, text)]
            yield pd.DataFrame(rows, columns=names).astype({"record": "Int32", "confidence": "float64"})

    return files.mapInPandas(run, _READ)


def write_json(row: DataFrame, path: str) -> None:
    """A report of one row as an indented JSON sidecar."""
    Path(path).write_text(json.dumps(json.loads(row.toJSON().first() or "{}"), indent=2, ensure_ascii=False) + "\n", "utf-8")


def study_notes(cards: DataFrame, note_date: str, cues: int = 8, notes: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, text): one Markdown note per document: front matter, cues, notes,
    summary, candidate cards. The date is given, so notes don't change by themselves."""
    item = F.struct("unit_pos", "topic", "front", "back", "extra", "source")
    rows = cards.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("cards"))
    lines = lambda made: F.array_join(made, "\n")
    cell = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\s+", " ")
    head = F.concat(F.lit(f"---\nnoteDate: {note_date}\ntopic: "), F.to_json(F.struct(F.get("cards", F.lit(0))["topic"].alias("t"))).substr(6, 1 << 20), F.lit("\n---\n"))
    cue = lines(F.transform(F.slice("cards", 1, cues), lambda c: F.concat(F.lit("| "), cell(c["front"]), F.lit(" | "), cell(c["source"]), F.lit(" |"))))
    note = lines(F.transform(F.slice("cards", 1, notes), lambda c: F.concat(F.lit("- "), c["extra"])))
    summary = F.array_join(F.transform(F.slice("cards", 1, 3), lambda c: c["extra"]), " ")
    candidates = F.array_join(F.transform("cards", lambda c: F.concat(F.lit("Q: "), c["front"], F.lit("\nA: "), c["back"])), "\n\n")
    text = F.concat(head, F.lit("# Cues\n| Cue | Source |\n|---|---|\n"), cue, F.lit("\n\n# Notes\n"), note, F.lit("\n\n# Summary\n"), summary, F.lit("\n\n# Candidate Cards\n"), candidates, F.lit("\n"))
    return rows.select(key, text.alias("text"))


def call_service(url: str, action: str, timeout: float = 10.0, **params) -> object:
    """One call of a local note service that speaks JSON with action and params."""
    body = json.dumps({"action": action, "version": 6, "params": params}).encode()
    with urllib.request.urlopen(urllib.request.Request(local_url(url), body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
        said = json.load(answer)
    if not isinstance(said, dict) or set(said) != {"result", "error"}:
        raise RuntimeError("the note service gave no result")
    if said["error"] is not None:
        raise RuntimeError(f"the note service refused {action}: {said['error']}")
    return said["result"]


def send_notes(made: DataFrame, url: str, batch: int = 500) -> DataFrame:
    """Notes sent in batches from one task, the service being on one machine:
    (id, note_id, added); a refused note has no note_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                notes = [{"deckName": r.deck, "modelName": r.layout, "fields": dict(r.fields), "tags": list(r.tags), "options": {"allowDuplicate": False}} for r in part.itertuples()]
                ids = call_service(url, "addNotes", notes=notes)
                if not isinstance(ids, list) or len(ids) != len(part):
                    raise RuntimeError("the note service answered for other notes")
                yield pd.DataFrame({"id": list(part["id"]), "note_id": pd.array(ids, "Int64"), "added": [i is not None for i in ids]})

    local_url(url)
    return made.coalesce(1).mapInPandas(run, "id string, note_id bigint, added boolean")


def pending_notes(made: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """Notes whose id the target doesn't have yet."""
    return made.join(existing_ids.select("id").distinct(), "id", "left_anti")
