"""Card records as text: a recursive-descent grammar with error recovery.

    file    := record (EOL record)*
    record  := field ("," field)*
    field   := quoted | bare
    quoted  := '"' (any character but '"' | '""')* '"'
    bare    := (any character but '"' , EOL)*

After a broken quote the parser records where it broke and goes on at the next
anchor: a line start from which a whole record of the expected width parses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column names of the card CSV, in order.
COLUMNS = (
    "Front", "Back", "Extra", "Context", "Mnemonic", "CardType", "Tags", "ImageURL", "ImageAlt", "Topic",
    "Source", "CardID", "KnowledgeUnitID", "KnowledgeKind", "LearningPurpose", "ObjectiveIDs",
    "PrerequisiteIDs", "Origin", "Confidence",
)
#: The card types.
CARD_TYPES = ("qa", "cloze", "reverse", "typed", "list", "image-supported")
_LINE_END = re.compile(r"\r\n|\r|\n")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")


@dataclass
class Parsed:
    """A record or, where ``error`` is set, the place where its grammar broke."""

    offset: int
    values: list[str] = field(default_factory=list)
    error: str | None = None
    error_offset: int | None = None


class _Broken(Exception):
    def __init__(self, at: int) -> None:
        self.at = at


class RecordParser:
    """Parses ``text``. ``lines``: whether a bare line break ends a record, as in
    a file; a text that holds one record keeps it as a character."""

    def __init__(self, text: str, width: int = len(COLUMNS), lines: bool = True) -> None:
        self.text, self.width, self.lines = text, width, lines
        self.bare_end = re.compile(r'[",\r\n]' if lines else r'[",]')
        self.last_quote = text.rfind('"')  # no field can be closed behind it

    def field(self, at: int) -> tuple[str, int]:
        text = self.text
        if text.startswith('"', at):
            return self.quoted(at)
        stop = self.bare_end.search(text, at)
        end = stop.start() if stop else len(text)
        if stop and stop.group() == '"':
            raise _Broken(end)
        return text[at:end], end

    def quoted(self, at: int) -> tuple[str, int]:
        text, here = self.text, at + 1
        while True:
            close = text.find('"', here) if here <= self.last_quote else -1
            if close < 0:
                raise _Broken(at)
            if text.startswith('"', close + 1):
                here = close + 2
                continue
            after = close + 1
            if after < len(text) and text[after] != "," and not (self.lines and text[after] in "\r\n"):
                raise _Broken(after)
            return text[at + 1 : close].replace('""', '"'), after

    def record(self, at: int) -> tuple[list[str], int]:
        value, at = self.field(at)
        values = [value]
        while self.text.startswith(",", at):
            value, at = self.field(at + 1)
            values.append(value)
        return values, at

    def line_start(self, at: int) -> int | None:
        found = _LINE_END.search(self.text, at)
        return found.end() if found else None

    def anchor(self, at: int) -> int | None:
        """The next line start from which a record of the right width parses. A try ends
        at the first quote that is out of place, or the end of the record."""
        start = self.line_start(at)
        while start is not None and start < len(self.text):
            try:
                values, _ = self.record(start)
            except _Broken:
                values = []
            if len(values) == self.width:
                return start
            start = self.line_start(start)
        return None

    def parse(self) -> Iterator[Parsed]:
        at = 0
        while at < len(self.text) or at == 0:
            try:
                values, end = self.record(at)
                yield Parsed(at, values)
                nxt = self.line_start(end) if end < len(self.text) else None
            except _Broken as broken:
                yield Parsed(at, [], "quoting", broken.at)
                nxt = self.anchor(at)
            if nxt is None or nxt >= len(self.text):
                return
            at = nxt


def judge(record: Parsed) -> str | None:
    """Why a record is no card: the first of quoting, column_count, card_type,
    confidence; None for a valid card."""
    if record.error:
        return record.error
    if len(record.values) != len(COLUMNS):
        return "column_count"
    if record.values[COLUMNS.index("CardType")].strip() not in CARD_TYPES:
        return "card_type"
    confidence = record.values[COLUMNS.index("Confidence")].strip()
    if confidence and not (_NUMBER.match(confidence) and 0 <= float(confidence) <= 1):
        return "confidence"
    return None


_CARD_SCHEMA = ", ".join(f"{name} string" for name in COLUMNS if name != "Confidence")
RECORD_SCHEMA = f"deck_file string, row_no int, reason string, error_line int, error_column int, {_CARD_SCHEMA}, Confidence double"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.partition(" ")[0] for c in RECORD_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for deck, row, raw in zip(batch.deck_file, batch.row_no, batch.raw):
            text = raw if isinstance(raw, str) else ""
            first = next(RecordParser(text, lines=False).parse())
            reason = judge(first)
            if reason is None:
                cells = dict(zip(COLUMNS, first.values))
                shown = cells["Confidence"].strip()
                out.append([deck, row, None, None, None, *(cells[c] for c in COLUMNS[:-1]), float(shown) if shown else None])
            else:
                place = first.error_offset if first.error_offset is not None else 0
                line = text.count("\n", 0, place) + 1
                column = place - (text.rfind("\n", 0, place) + 1) + 1
                out.append([deck, row, reason, line, column, *[None] * len(COLUMNS)])
        made = pd.DataFrame(out, columns=names)
        for whole in ("row_no", "error_line", "error_column"):
            made[whole] = made[whole].astype("Int32")
        made["Confidence"] = made["Confidence"].astype("float64")
        yield made


def parse_card_records(rows: DataFrame) -> DataFrame:
    """Rows of (deck_file, row_no, raw), one record each, parsed and judged.

    Output per distinct row: ``reason`` null and the typed card columns, or a
    reason with line and column of the error inside the record. Row 1 of a file
    is its header and is left out; rows without a number are records. A null or
    empty record has one field and thus the reason column_count. Repeated rows
    with the same record count once. Other input columns are ignored.
    """
    data = rows.where("row_no is null or row_no <> 1").select("deck_file", F.col("row_no").cast("int").alias("row_no"), "raw")
    return data.mapInPandas(_rows, RECORD_SCHEMA)


def rejected(records: DataFrame) -> DataFrame:
    return records.where("reason is not null").select("deck_file", "row_no", "reason").distinct()


def accepted(records: DataFrame) -> DataFrame:
    """Valid rows as typed cards, once per deck_file and row_no and content."""
    return records.where("reason is null").drop("reason", "error_line", "error_column").distinct()


def _file_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for deck, text in zip(batch.deck_file, batch.text):
            text = (text or "").removeprefix("\ufeff")
            for n, record in enumerate(RecordParser(text).parse(), 1):
                reason = None if n == 1 and record.values[:2] == list(COLUMNS[:2]) else judge(record)
                line = None if record.error_offset is None else text.count("\n", 0, record.error_offset) + 1
                out.append((deck, n, text.count("\n", 0, record.offset) + 1, record.values or None, reason, line))
        yield pd.DataFrame(out, columns=["deck_file", "row_no", "line", "fields", "reason", "error_line"]).astype({"row_no": "Int32", "line": "Int32", "error_line": "Int32"})


def parse_card_files(files: DataFrame) -> DataFrame:
    """Whole files of (deck_file, text): every record with the line it starts on,
    its fields or the reason and line of the error. Parsing goes on after errors."""
    return files.select("deck_file", "text").mapInPandas(_file_rows, "deck_file string, row_no int, line int, fields array<string>, reason string, error_line int")


def card_files(rows: DataFrame) -> DataFrame:
    """Whole files of (deck_file, text) put together from rows of (deck_file, row_no,
    raw): a record and a line end each, by number, those without a number last.
    Repeated rows with the same record stand once. A file is one value, in one task."""
    own = rows.select("deck_file", "row_no", F.coalesce("raw", F.lit("")).alias("raw")).distinct()
    records = F.array_sort(F.collect_list(F.struct(F.col("row_no").isNull().alias("last"), "row_no", "raw")))
    return own.groupBy("deck_file").agg(F.array_join(F.transform(records, lambda r: r["raw"]), "\n").alias("text"))
