"""Queries of the general data-quality operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators.orphans import Reference, find_orphans, orphan_report
from cardmill.sources.card_records import COLUMNS, accepted, card_files, parse_card_files, parse_card_records, rejected
from cardmill.sources.tables import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    units, cards = table(spark, folder, "knowledge_units"), table(spark, folder, "cards")
    objectives = table(spark, folder, "learning_objectives")
    refs = [
        Reference("knowledge_units", units, "id", "objective_ids", "objective", True),
        Reference("knowledge_units", units, "id", "prerequisite_ids", "unit", True),
        Reference("cards", cards, "card_id", "knowledge_unit_id", "unit"),
    ]
    return find_orphans({"objective": objectives, "unit": units}, refs)


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(p1_found(spark, folder))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return parse_card_records(spread(table(spark, folder, "card_csv_rows")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(_records(spark, folder))


def p6_cards(spark: SparkSession, folder: str) -> DataFrame:
    return accepted(_records(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(_records(spark, folder)).groupBy("reason").agg(F.count("*").alias("n_rows"))


def p6_files(spark: SparkSession, folder: str) -> DataFrame:
    return parse_card_files(card_files(table(spark, folder, "card_csv_rows")))


_ORPHANS = r"""
with p as (
  select 'unit' parent, lower(trim(id, e' \t\r\n\f\v ')) ref, loaded_at, deleted_at from knowledge_units
  union all select 'objective', lower(trim(id, e' \t\r\n\f\v ')), loaded_at, deleted_at from learning_objectives),
ps as (select parent, ref, min(loaded_at) first_loaded, arg_max(deleted_at is not null, (loaded_at, deleted_at is not null)) gone
  from p where ref <> '' group by 1, 2),
rows_ as (
  select 'knowledge_units' table_name, 'objective_ids' field, 'objective' parent, id record_id, unnest(objective_ids) ref, loaded_at from knowledge_units
  union all select 'knowledge_units', 'prerequisite_ids', 'unit', id, unnest(prerequisite_ids), loaded_at from knowledge_units
  union all select 'cards', 'knowledge_unit_id', 'unit', card_id, knowledge_unit_id, loaded_at from cards),
firsts as (select 'knowledge_units' table_name, id record_id, min(loaded_at) loaded from knowledge_units group by 2
  union all select 'cards', card_id, min(loaded_at) from cards group by 2),
d as (select distinct table_name, field, parent, record_id, lower(trim(ref, e' \t\r\n\f\v ')) ref_id from rows_ where trim(ref, e' \t\r\n\f\v ') <> ''),
found as (select d.table_name, d.field, d.record_id, d.ref_id,
  case when ps.ref is null then 'missing' when gone then 'deleted' when first_loaded > f.loaded then 'late' end status,
  strftime(f.loaded, '%Y-%m') period
  from d join firsts f on f.table_name = d.table_name and f.record_id = d.record_id
  left join ps on ps.parent = d.parent and ps.ref = d.ref_id)
"""

# A record is sound when fields without quotes and fully quoted fields alternate
# with commas. Whole quoted fields are taken out first, so what remains has a
# quote only where a field is broken, and one comma fewer than fields.
_RECORDS = r"""
with r as (select distinct deck_file, row_no, coalesce(raw, '') raw from card_csv_rows where row_no is distinct from 1),
s as (select *, regexp_full_match(raw, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') sound from r),
f as (select *, case when sound then list_transform(regexp_extract_all(',' || raw, '(?s),(?:"(?:[^"]|"")*"|[^",]*)'), lambda x: x[2:]) end fields from s),
v as (select *, list_transform(fields, lambda x: trim(trim(case when x like '"%' then replace(x[2:-2], '""', '"') else x end, e' \t\r\n'))) vals from f),
t as (select *, vals[6] card_type, vals[19] confidence from v),
j as (select deck_file, row_no, fields, case when not sound then 'quoting' when len(vals) <> 19 then 'column_count'
  when card_type not in ('qa','cloze','reverse','typed','list','image-supported') then 'card_type'
  when confidence <> '' and not coalesce(regexp_full_match(confidence, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') and try_cast(confidence as double) between 0 and 1, false) then 'confidence' end reason from t)
"""

_CELL = "case when fields[{n}] like '\"%' then replace(fields[{n}][2:-2], '\"\"', '\"') else fields[{n}] end"
_CELLS = ", ".join(f'{_CELL.format(n=n)} "{name}"' for n, name in enumerate(COLUMNS[:-1], 1))
_CARDS = _RECORDS + f", k as (select distinct deck_file, row_no, {_CELLS}, try_cast(nullif(trim({_CELL.format(n=len(COLUMNS))}), '') as double) \"Confidence\" from j where reason is null)\n"

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p6_found": p6_found, "p6_cards": p6_cards, "p6_report": p6_report, "p6_files": p6_files}
SQL = {
    "p1_found": _ORPHANS + "select * from found where status is not null",
    "p1_report": _ORPHANS + "select table_name, field, status, period, count(*) n_references, count(distinct ref_id) n_keys from found where status is not null group by 1, 2, 3, 4",
    "p6_found": _RECORDS + "select distinct deck_file, row_no, reason from j where reason is not null",
    "p6_cards": _CARDS + "select * from k",
    "p6_report": _RECORDS + "select reason, count(*) n_rows from (select distinct deck_file, row_no, reason from j where reason is not null) group by 1",
}
