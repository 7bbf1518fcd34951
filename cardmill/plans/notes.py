"""Queries from cards to facts and notes, and over review windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.operators import drafts as D
from cardmill.operators import knowledge as K
from cardmill.operators import layouts as L
from cardmill.operators import refined as N
from cardmill.operators import reports as P
from cardmill.plans.knowledge import _C, _U, _V, sql_current
from cardmill.plans.review import SQL as REVIEW
from cardmill.sources import facts as S
from cardmill.sources import sinks
from cardmill.sources.documents import looks_like_math
from cardmill.sources.documents import math_marks as marked_math
from cardmill.sources.tables import table
from cardmill.streaming.reviews import windowed_scores

#: An example of configured fields.
EXAMPLE = {"typed": {"Spelling": {"Ask": "{prompt}", "Say": "{answer}", "About": "{topic} ({source})", "Key": "{fact_id}"}}}


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return S.parse_facts(S.card_facts(K.current_rows(table(spark, folder, "cards"), "card_id")))


def fact_types(spark: SparkSession, folder: str) -> DataFrame:
    facts = _facts(spark, folder).where("size(faults) = 0")
    return facts.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("source").isNotNull()).alias("with_source"))


def fact_faults(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def card_notes(spark: SparkSession, folder: str) -> DataFrame:
    return L.notes(_facts(spark, folder), EXAMPLE).select("id", "layout", "deck", F.to_json("fields").alias("fields"))


def note_layouts(spark: SparkSession, folder: str) -> DataFrame:
    return L.notes(_facts(spark, folder)).groupBy("layout", "deck").agg(F.count("*").alias("n"))


def card_csv(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.csv_cards(K.current_rows(table(spark, folder, "cards"), "card_id"))


def package_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cards").where("topic is not null").select("topic").distinct().select("topic", T.package_id(F.col("topic")).alias("deck_id"))


def math_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = K.text_lines(table(spark, folder, "chunks"), "doc_id").where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count_if(looks_like_math(F.col("line"))).alias("math_lines"), F.count("*").alias("lines"))


def review_windows(spark: SparkSession, folder: str) -> DataFrame:
    made = windowed_scores(table(spark, folder, "review_log"))
    return made.select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "predicted_range", "n", F.round("brier", 4).alias("brier"))


def _drafts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cards as drafts of their units, their back being the evidence."""
    units = K.current_rows(table(spark, folder, "knowledge_units"), "id").withColumnRenamed("id", "unit_id")
    cards = K.current_rows(table(spark, folder, "cards"), "card_id")
    draft = F.struct("front", "back", "extra", "context", "card_type", F.col("knowledge_unit_id").alias("source_unit_id"), F.col("back").alias("evidence"), "tags", F.col("confidence").cast("string").alias("confidence"))
    payloads = cards.select(F.to_json(F.struct(F.array(draft).alias("cards"))).alias("payload"))
    return D.read_drafts(payloads), units


def draft_faults(spark: SparkSession, folder: str) -> DataFrame:
    return D.draft_faults(*_drafts(spark, folder))


def drafted_cards(spark: SparkSession, folder: str) -> DataFrame:
    return D.drafted_cards(*_drafts(spark, folder)).select("card_id", "knowledge_unit_id", "card_type", "front", "back", "topic")


def authoring_prompts(spark: SparkSession, folder: str) -> DataFrame:
    units = K.current_rows(table(spark, folder, "knowledge_units"), "doc_id", "id").withColumnRenamed("id", "unit_id")
    return D.prompts(units).select("doc_id", "part", F.size(F.from_json("prompt", "source_units array<struct<text:string>>")["source_units"]).alias("units"))


def audit_checks(spark: SparkSession, folder: str) -> DataFrame:
    return P.audit_checks(K.current_rows(table(spark, folder, "cards"), "card_id"))


def remedies(spark: SparkSession, folder: str) -> DataFrame:
    return P.remedies(K.current_rows(table(spark, folder, "cards"), "card_id"))


def calibration_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.calibration_report(table(spark, folder, "approval_log"), table(spark, folder, "review_log"))


def import_report(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed cards stand for the notes the target has."""
    notes = K.current_rows(table(spark, folder, "cards"), "card_id").select(F.col("card_id").alias("id"), F.coalesce("topic", F.lit("General")).alias("deck"))
    return P.import_report(notes, table(spark, folder, "review_log").select(F.col("card_id").alias("id")))


def math_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Marked formulas per chunk of a PDF page, repeated chunks once."""
    pages = table(spark, folder, "chunks").where(F.col("text").isNotNull() & F.col("source").rlike(r"\sp\.\d+")).select("doc_id", "chunk_pos", "text").distinct()
    return pages.select("doc_id", "chunk_pos", F.size(marked_math(F.col("text"))).alias("formulas"), F.sha2(F.array_join(marked_math(F.col("text")), "\n"), 256).alias("digest")).where("formulas > 0")


def study_row_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Cards as study rows: the extra is the text, the back the evidence of its unit."""
    units = K.current_rows(table(spark, folder, "knowledge_units"), "id").withColumnRenamed("id", "unit_id")
    cards = K.current_rows(table(spark, folder, "cards"), "card_id")
    row = F.struct(F.col("back").alias("text"), F.col("knowledge_unit_id").alias("source_unit_id"), F.concat_ws(" ", "back", F.when(F.col("card_type") == "qa", F.lit("x"))).alias("evidence"))
    payloads = cards.select(F.to_json(F.struct(F.array(row).alias("notes"), row.alias("summary"))).alias("payload"))
    made = D.judged_study_rows(D.read_study_rows(payloads), units)
    return made.groupBy("section", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def image_links(spark: SparkSession, folder: str) -> DataFrame:
    cards = K.current_rows(table(spark, folder, "cards"), "card_id")
    return cards.groupBy(N.image_kind(F.col("image_url")).alias("link")).agg(F.count("*").alias("n"), F.count_distinct("image_url").alias("urls"))


def supported_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Cards whose back their unit supports as evidence, by card type."""
    units = K.current_rows(table(spark, folder, "knowledge_units"), "id").select(F.col("id").alias("knowledge_unit_id"), F.col("text").alias("evidence"))
    cards = K.current_rows(table(spark, folder, "cards"), "card_id").join(units, "knowledge_unit_id", "left")
    return cards.groupBy("card_type").agg(F.count_if(N.supports(F.col("back"), F.col("evidence"))).alias("supported"), F.count("*").alias("n"))


def candidate_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Cards that stand as candidates of study notes."""
    cards = K.current_rows(table(spark, folder, "cards"), "card_id").withColumnRenamed("card_id", "candidate")
    return N.valid_candidates(cards.select("candidate", "front", "back", "extra", "tags"))


QUERIES = {f.__name__: f for f in (draft_faults, drafted_cards, authoring_prompts, audit_checks, remedies, calibration_report, import_report, math_marks, study_row_faults, image_links, supported_answers, candidate_cards, fact_types, fact_faults, card_notes, note_layouts, card_csv, package_ids, math_lines, review_windows)}
_num = lambda c: f"case when regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim({c}) as double) end"
_DRAFTS = rf"""
with u as (select id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) hay, topic from {sql_current('knowledge_units', 'id')}),
c as (select *, coalesce(trim(back), '') ev, trim(knowledge_unit_id) uid from {_C}),
j as (select c.*, u.id known, u.topic unit_topic, case
  when trim(coalesce(front, '')) = '' or ev = '' or trim(coalesce(extra, '')) = '' or trim(coalesce(card_type, '')) = '' or coalesce(uid, '') = '' then 'missing_field'
  when u.id is null then 'unknown_unit' when not contains(hay, trim(regexp_replace(lower(ev), '\s+', ' ', 'g'))) then 'unsupported_evidence'
  when trim(card_type) not in ('qa', 'cloze', 'reverse', 'typed', 'list', 'image-supported') then 'card_type' end fault from c left join u on u.id = c.uid)
"""
_ESC = "replace(replace(replace(replace(replace(replace(replace(coalesce({0}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FACTS = rf"""
with c as (select *, case when trim(card_type) in ('cloze', 'typed') then trim(card_type) else 'qa' end kind, {_ESC.format('front')} f, {_ESC.format('back')} b, nullif({_ESC.format('source')}, '') src, nullif(trim(origin), '') org, nullif(trim(knowledge_kind), '') kk from {_C} where trim(coalesce(card_id, '')) <> ''),
x as (select card_id, kind, src, list_filter([
  case when kk not in ({_in(V.KNOWLEDGE_KINDS)}) then 'knowledge_kind' end, case when org not in ({_in(V.ORIGINS)}) then 'origin' end, case when not (confidence between 0 and 1) then 'confidence' end,
  case when org is not null and trim(coalesce(src, ''), e' \t\r\n') = '' then 'source_of_origin' end,
  case when trim(f, e' \t\r\n ') = '' then case kind when 'cloze' then 'content_text' when 'typed' then 'content_prompt' else 'content_front' end end,
  case when trim(b, e' \t\r\n ') = '' and kind <> 'cloze' then case kind when 'typed' then 'content_answer' else 'content_back' end end,
  case when org = 'generated-enrichment' and not contains(f, 'Enrichment:') then 'enrichment_label' end,
  case when kind = 'cloze' and trim(f, e' \t\r\n ') <> '' and not regexp_matches({_V.format('f')}, '\{{\{{c\d+::') then 'cloze_deletion' end], lambda v: v is not null) faults from c)
"""
SQL = {
    "fact_faults": _FACTS + "select fault, count(*) n from (select unnest(faults) fault from x) group by 1",
    "fact_types": _FACTS + "select kind as type, count(*) n, count(src) with_source from x where len(faults) = 0 group by 1",
    "note_layouts": _FACTS + "select case kind when 'qa' then 'Basic' when 'cloze' then 'Cloze' else 'Typed' end layout, 'Study' deck, count(*) n from x where len(faults) = 0 group by 1",
    "draft_faults": _DRAFTS + "select coalesce(fault, 'none') fault, count(*) n from j group by 1",
    "authoring_prompts": f"select doc_id, cast(floor(unit_pos / 50) as bigint) part, count(*) units from {_U} group by 1, 2",
    "import_report": f"with n as (select card_id id, coalesce(topic, 'General') deck from {_C}), k as (select distinct card_id id from review_log where card_id is not null) select deck, count(*) notes, count(k.id) known, count(*) - count(k.id) pending from n left join k using (id) group by 1",
    "calibration_report": f"""
select 'ok' approval_status, 'ok' retention_status, a.* rename (invalid_rows as approval_invalid_rows), r.* rename (invalid_rows as retention_invalid_rows),
  (select coalesce(list({{'name': reason, 'n': n}} order by n desc, reason), []) from ({REVIEW['rejection_reasons']})) rejection_reasons,
  (select coalesce(list({{'name': field, 'n': n}} order by n desc, field), []) from ({REVIEW['edited_fields']})) edit_hotspots,
  (select coalesce(list({{'predicted_range': predicted_range, 'mean_predicted': mean_predicted, 'mean_actual': mean_actual, 'n': n}} order by predicted_range), []) from ({REVIEW['calibration_buckets']})) calibration_buckets
from ({REVIEW['approval_metrics']}) a, ({REVIEW['retention_metrics']}) r""",
    "math_marks": r"""
with t as (select distinct doc_id, chunk_pos, text from chunks where text is not null and regexp_matches(source, '\sp\.\d+')),
l as (select doc_id, chunk_pos, text, list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) ls from t),
m as (select *, list_filter(ls, lambda x: x <> '' and len(x) <= 240 and len(regexp_extract_all(x, '[=+\-−*/×÷^<>≤≥≈≠∑∏∫√∂∇]')) > 0 and (regexp_matches(x, '[∑∏∫√∂∇≤≥≈≠∞±]') or regexp_matches(x, '[Α-Ωα-ω]')
  or (contains(x, '=') and regexp_matches(x, '[A-Za-z0-9]') and trim(split_part(x, '=', 1)) <> '' and trim(regexp_extract(x, '=(.*)$', 1)) <> '') or (not contains(x, '=') and len(regexp_extract_all(x, '[=+\-−*/×÷^<>≤≥≈≠∑∏∫√∂∇]')) >= 2 and regexp_matches(x, '[A-Za-z0-9]')))) f from l),
d as (select doc_id, chunk_pos, list_transform(list_filter(f, lambda x, i: list_position(f, x) = i), lambda x: '[math: ' || x || ' | source text layer]') f from m)
select doc_id, chunk_pos, len(f)::int formulas, sha256(array_to_string(f, chr(10))) digest from d where len(f) > 0""",
    "study_row_faults": rf"""
with u as (select id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) hay from {sql_current('knowledge_units', 'id')}),
c as (select trim(coalesce(back, ''), e' \t\r\n') said, trim(coalesce(knowledge_unit_id, ''), e' \t\r\n') uid, trim(concat_ws(' ', back, case when card_type = 'qa' then 'x' end), e' \t\r\n') ev from {_C}),
j as (select said, uid, hay, ev, trim(regexp_replace(lower(ev), '\s+', ' ', 'g')) e, rtrim(trim(regexp_replace(lower(said), '\s+', ' ', 'g')), '.') t from c left join u on u.id = c.uid),
f as (select case when said = '' or ev = '' or uid = '' then 'missing_field' when hay is null then 'unknown_unit' when regexp_matches(said, '[\r\n\t]') then 'several_lines' when regexp_matches(said, '(^|\s)#{{1,6}}\s+') then 'heading'
  when not contains(hay, e) then 'unsupported_evidence' when not contains(e, t) then 'unsupported_text' else 'none' end fault from j)
select section, fault, count(*) n from f, (values ('notes'), ('summary')) s(section) group by all""",
    "image_links": rf"""
with u as (select image_url, trim(coalesce(image_url, ''), e' \t\r\n') b from {_C}),
s as (select *, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) scheme, regexp_extract(b, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) host,
  list_transform(list_filter(string_split(b, '/'), lambda x: x not in ('', '.')), lambda x: case when x = '..' then -1 else 1 end) d from u)
select case when b = '' then 'none' when scheme <> '' or host <> '' then case when scheme in ('http', 'https') and host <> '' then 'remote' else 'bad_scheme' end when starts_with(b, '/') then 'absolute'
  when list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))) < 0 then 'outside' else 'local' end link, count(*) n, count(distinct image_url) urls from s group by 1""",
    "supported_answers": rf"""
with u as (select id, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) hay from {sql_current('knowledge_units', 'id')}), c as (select card_type, knowledge_unit_id, rtrim(trim(regexp_replace(lower(coalesce(back, '')), '\s+', ' ', 'g')), '.') said from {_C})
select card_type, count(*) filter (contains(coalesce(hay, ''), said) and len(list_filter(regexp_extract_all(said, '[A-Za-z0-9]+'), lambda w: len(w) > 2)) >= 2) supported, count(*) n from c left join u on u.id = c.knowledge_unit_id group by 1""",
    "math_lines": r"""
with t as (select distinct doc_id, chunk_pos, source, text, row_number() over () rn from chunks where text is not null), l as (select doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]')) raw from t),
s as (select doc_id, trim(regexp_replace(regexp_replace(raw, '^[\s\x{a0}\x0b]+|[\s\x{a0}\x0b]+$', '', 'g'), '\s+', ' ', 'g')) t from l), w as (select *, len(regexp_extract_all(t, '[=+\-−*/×÷^<>≤≥≈≠∑∏∫√∂∇]')) ops, regexp_matches(t, '[A-Za-z0-9]') named from s where t <> '')
select doc_id, count(*) filter (len(t) <= 240 and ops > 0 and (regexp_matches(t, '[∑∏∫√∂∇≤≥≈≠∞±]') or regexp_matches(t, '[Α-Ωα-ω]') or (contains(t, '=') and named and trim(split_part(t, '=', 1)) <> '' and trim(regexp_extract(t, '=(.*)$', 1)) <> '') or (not contains(t, '=') and ops >= 2 and named))) math_lines, count(*) lines from w group by 1""",
    "card_csv": f"""select coalesce(front, '') "Front", coalesce(back, '') "Back", coalesce(extra, '') "Extra", coalesce(context, '') "Context", coalesce(mnemonic, '') "Mnemonic", coalesce(card_type, '') "CardType",
  array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i), ' ') "Tags", coalesce(image_url, '') "ImageURL", coalesce(image_alt, '') "ImageAlt", coalesce(topic, '') "Topic", coalesce(source, '') "Source", coalesce(card_id, '') "CardID", coalesce(knowledge_unit_id, '') "KnowledgeUnitID",
  coalesce(knowledge_kind, '') "KnowledgeKind", coalesce(learning_purpose, '') "LearningPurpose", coalesce(array_to_string(list_filter(objective_ids, lambda x, i: list_position(objective_ids, x) = i), ' '), '') "ObjectiveIDs",
  coalesce(array_to_string(list_filter(prerequisite_ids, lambda x, i: list_position(prerequisite_ids, x) = i), ' '), '') "PrerequisiteIDs", coalesce(origin, '') "Origin", printf('%.4f', coalesce(confidence, 1.0)) "Confidence" from {_C}""",
    "review_windows": f"""
with n as (select reviewed_at at_, {_num('interval_days')} d, {_num('predicted_retention')} p, {_num('actual_recalled')} a from review_log),
m as (select timestamp '1970-01-01' + to_days(cast(floor(epoch(at_) / 604800) * 7 as int)) w, least(greatest(trunc(p * 10)::int, 0), 9) b, p, a from n where d > 21 and p is not null and a is not null and at_ is not null)
select strftime(w, '%Y-%m-%d') as week, printf('%.1f-%.1f', b / 10, (b + 1) / 10) predicted_range, count(*) n, round(avg((p - a) * (p - a)), 4) brier from m group by w, b""",
}
