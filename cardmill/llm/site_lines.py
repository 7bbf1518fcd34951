"""Lines repeated across the files of one site.

Every line becomes an identifier of its letters; a file is the sequence of its
line identifiers over all its chunks, each at its first place. PrefixSpan grows frequent sequences per site,
with support in distinct files: lines with enough files are the frequent sequences of
length one, and a sequence is extended by every frequent line of its projections until
none is left. Of sequences that begin with one line, only those are kept that no longer
one with the same files contains; every frequent line still stands in one of them, a
single line as a sequence of its own where nothing goes with it. Occurrences of their
lines are deleted from each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize, table

#: English month names.
MONTHS = "january february march april may june july august september october november december".split()
MIN_FILES = 3
MIN_SHARE = 0.04
#: Keys that the occurrences of one line are dealt to.
SALTS = 8
_PDF_PAGE = r"\sp\.\d+(?:\s*\(OCR\))?\s*$"


def line_letters(line: Column) -> Column:
    """Letters of a line in lower case, without month names as whole words."""
    months = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(MONTHS)})(?![\p{{L}}\p{{N}}_])"
    return F.regexp_replace(F.regexp_replace(F.lower(line), months, ""), r"[^\p{L}]+", "")


def _sound(chunks: DataFrame) -> DataFrame:
    rows = chunks.where(F.col("text").isNotNull() & F.col("source").isNotNull() & ~F.col("source").rlike(_PDF_PAGE))
    return rows.select(F.substring_index("source", "/", 1).alias("site"), "doc_id", "chunk_pos", "text")


def site_lines(chunks: DataFrame) -> DataFrame:
    """Lines of all chunks with text and source that are no PDF pages: site,
    doc_id, chunk_pos, line_no from 1, line_id (null without letters)."""
    lines = _sound(chunks).select("site", "doc_id", "chunk_pos", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    letters = line_letters(F.col("line"))
    return lines.select("site", "doc_id", "chunk_pos", (F.col("at") + 1).alias("line_no"), F.when(letters != "", F.xxhash64(letters)).alias("line_id"))


def site_files(chunks: DataFrame) -> DataFrame:
    return _sound(chunks).groupBy("site").agg(F.count_distinct("doc_id").alias("n_files"))


def prepared_lines(chunks: DataFrame) -> DataFrame:
    """``site_lines`` with letters, each once, written once for all that read them."""
    return materialize(site_lines(chunks).where("line_id is not null").distinct(), "lines")


def frequent_lines(lines: DataFrame, files: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE) -> DataFrame:
    """Sequences of length one: (site, line_id, support) with support in distinct
    files. Repeats inside a file are combined before the shuffle."""
    per_file = lines.where("line_id is not null").select("site", "line_id", "doc_id").distinct()
    support = per_file.groupBy("site", "line_id").agg(F.count("doc_id").alias("support")).where(F.col("support") >= min_files)
    return support.join(files, "site").where(F.col("support") >= F.lit(min_share) * F.col("n_files"))


def occurrences(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose (site, line_id) is wanted. A line may stand in most files
    of a large site, so its occurrences are dealt to ``SALTS`` keys."""
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk_pos"), F.lit(SALTS)).cast("int"))
    each = wanted.select("site", "line_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(each, ["site", "line_id", "salt"], "left_semi").drop("salt")


def repeated_lines(chunks: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, chunk_pos, line_no) of every line to delete: occurrences of lines of
    frequent sequences.

    Null texts and sources and PDF pages have none; lines without letters never
    count; repeated chunks count once; a null doc_id counts for no support.
    """
    lines = prepared_lines(chunks)
    sequences = frequent_sequences(lines, site_files(chunks), min_files, min_share)
    wanted = sequences.select("site", F.explode("sequence").alias("line_id")).distinct()
    return occurrences(lines, materialize(wanted, "wanted")).select("doc_id", "chunk_pos", "line_no").distinct()


class Projection:
    """The files of a site from a first line on: what follows it, and how many files.
    No file has a line twice, so a sequence has one instance in a file."""

    def __init__(self, first: int, rests: list[tuple[int, ...]], files: list[int]) -> None:
        self.rows, self.files = [(first, *rest) for rest in rests], files
        bits = {line: 1 << k for k, line in enumerate({line for row in self.rows for line in row})}
        #: per file and place the lines before it, as bits
        self.before = [list(accumulate((bits[line] for line in row), or_, initial=0)) for row in self.rows]

    def support(self, places: list[tuple[int, tuple[int, ...]]]) -> int:
        return sum(self.files[i] for i, _ in places)

    def following(self, places: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
        """Lines after a sequence, with the places of the longer one. ``places``: file and
        where the lines of the sequence stand in it."""
        out: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for i, at in places:
            row = self.rows[i]
            for k in range(at[-1] + 1, len(row)):
                out.setdefault(row[k], []).append((i, (*at, k)))
        return out

    def inserted(self, length: int, places: list[tuple[int, tuple[int, ...]]]) -> bool:
        """Whether some line stands in every file between the same two lines of the
        sequence. Then no sequence grown from this one can be closed."""
        for k in range(1, length):
            common = -1
            for i, at in places:
                before = self.before[i]
                common &= before[at[k]] & ~before[at[k - 1] + 1]
                if not common:
                    break
            if common:
                return True
        return False

    def grow(self, need: float) -> Iterator[tuple[list[int], int]]:
        """(sequence, support), depth first: closed frequent sequences from the first line on."""
        stack = [([self.rows[0][0]], [(i, (0,)) for i in range(len(self.rows))])]
        while stack:
            sequence, places = stack.pop()
            if self.inserted(len(sequence), places):
                continue  # the same files are reached with that line, and further
            support, following = self.support(places), self.following(places)
            longer = {line: self.support(own) for line, own in following.items()}
            if support not in longer.values():
                yield sequence, support
            for line, own in following.items():
                if longer[line] >= need:
                    stack.append(([*sequence, line], own))


def frequent_sequences(lines: DataFrame, files: DataFrame, min_files: int = MIN_FILES, min_share: float = MIN_SHARE) -> DataFrame:
    """PrefixSpan: (site, sequence array<long>, support), of any length, closed among
    those with the same first line.

    A file is the sequence of its frequent lines over all its chunks, each at its first
    place, and a sequence may leave out lines between its own. Files with equal sequences are combined
    before they are projected on each first line; a projection, with equal rests
    combined again, is grown in one task.
    """
    frequent = frequent_lines(lines, files, min_files, min_share)
    kept = occurrences(lines.where("doc_id is not null"), materialize(frequent.select("site", "line_id"), "frequent"))
    in_order = F.array_sort(F.collect_list(F.struct("chunk_pos", "line_no", "line_id")))
    whole = kept.groupBy("site", "doc_id").agg(F.array_distinct(F.transform(in_order, lambda x: x["line_id"])).alias("whole")).groupBy("site", "whole").agg(F.count("*").alias("files"))
    firsts = whole.select("site", "whole", "files", F.explode("whole").alias("first"))
    rest = F.expr("slice(whole, cast(array_position(whole, first) as int) + 1, size(whole))")
    projected = firsts.select("site", "first", rest.alias("rest"), "files").groupBy("site", "first", "rest").agg(F.sum("files").alias("files"))

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        need = max(min_files, min_share * int(batch.n_files.iloc[0]))
        found = list(Projection(int(key[1]), [tuple(r) for r in batch["rest"]], [int(n) for n in batch["files"]]).grow(need))
        return pd.DataFrame({"site": key[0], "sequence": [s for s, _ in found], "support": [n for _, n in found]})

    return projected.join(files, "site").groupBy("site", "first").applyInPandas(run, "site string, sequence array<bigint>, support bigint")


def without_repeated_lines(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk's text without its repeated lines; other texts as they are."""
    found = repeated_lines(chunks).groupBy("doc_id", "chunk_pos").agg(F.collect_set("line_no").alias("cut"))
    texts = chunks.select("doc_id", "chunk_pos", "source", "text").distinct()
    at = F.split("text", "\n", -1)
    rest = F.filter(F.transform(at, lambda line, i: F.struct((i + 1).alias("no"), line.alias("line"))), lambda x: ~F.array_contains(F.col("cut"), x["no"]))
    clean = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(rest, lambda x: x["line"]), "\n"))
    same = (texts.doc_id.eqNullSafe(found.doc_id)) & (texts.chunk_pos.eqNullSafe(found.chunk_pos))
    return texts.join(found, same, "left").select(texts.doc_id, texts.chunk_pos, "source", clean.alias("text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "chunks"))


def p4_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent sequences; lines are named by the hash of their letters."""
    chunks = table(spark, folder, "chunks")
    return frequent_sequences(prepared_lines(chunks), site_files(chunks)).select("site", F.size("sequence").alias("length"), "support", "sequence")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(table(spark, folder, "chunks"))


_LINES = rf"""
with c as (select distinct doc_id, chunk_pos, source, text from chunks where text is not null and source is not null
  and not regexp_matches(source, '\sp\.\d+(\s*\(OCR\))?\s*$')),
l as (select split_part(source, '/', 1) site, doc_id, chunk_pos, unnest(range(1, len(string_split(text, chr(10))) + 1))::int line_no,
  unnest(string_split(text, chr(10))) line from c),
m as (select *, regexp_replace(regexp_replace(lower(line), '(^|[^\p{{L}}\p{{N}}_])(({'|'.join(MONTHS)})([^\p{{L}}\p{{N}}_]+|$))+', '\1', 'g'), '[^\p{{L}}]+', '', 'g') k from l),
f as (select site, count(distinct doc_id) n from l group by 1),
s as (select site, k, count(distinct doc_id) n from m where k <> '' group by 1, 2),
r as (select s.site, s.k, s.n from s join f using (site) where s.n >= {MIN_FILES} and s.n >= {MIN_SHARE} * f.n)
"""

QUERIES = {"p4_found": p4_found, "p4_sequences": p4_sequences, "p4_clean": p4_clean}
SQL = {
    "p4_found": _LINES + "select distinct doc_id, chunk_pos, line_no from m join r using (site, k)",
    "p4_clean": _LINES + """, k as (select m.doc_id, m.chunk_pos, string_agg(line, chr(10) order by line_no) filter (r.k is null) kept, count(r.k) cut from m left join r using (site, k) group by 1, 2)
select d.doc_id, d.chunk_pos, d.source, case when k.cut > 0 then coalesce(k.kept, '') else d.text end as text
from (select distinct doc_id, chunk_pos, source, text from chunks) d left join k on k.doc_id = d.doc_id and k.chunk_pos = d.chunk_pos""",
}
