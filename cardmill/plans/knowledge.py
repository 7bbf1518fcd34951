"""Queries over objectives, knowledge units and their cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.operators import knowledge as K
from cardmill.sources.tables import table


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return K.current_rows(table(spark, folder, "knowledge_units"), "doc_id", "id")


def _objectives(spark: SparkSession, folder: str) -> DataFrame:
    return K.current_rows(table(spark, folder, "learning_objectives"), "doc_id", "id")


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return K.current_rows(table(spark, folder, "cards"), "card_id")


def classified_units(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "knowledge_units").select("doc_id", "unit_pos", "id", T.classify(F.col("text")).alias("c")).select("doc_id", "unit_pos", "id", "c.*")


def unit_measures(spark: SparkSession, folder: str) -> DataFrame:
    text = T.text_or_empty(F.col("text"))
    return table(spark, folder, "knowledge_units").select(
        "doc_id", "unit_pos", "id", T.word_count(text).alias("words"), F.size(T.semantic_tokens(text)).alias("tokens"), T.slug(F.col("topic")).alias("topic_slug"),
        T.component_estimate(text).alias("components"), T.looks_compound(text).alias("compound"), T.needs_context(text).alias("needs_context"), T.stable_id("unit", text, F.col("source")).alias("stable_id"),
    )


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines, non-blank lines, headings, bullets, question lines."""
    line = F.col("line")
    return K.text_lines(table(spark, folder, "documents")).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(line != "").alias("written"), F.count_if(line.rlike(r"^#{1,6}\s+.+")).alias("headings"),
        F.count_if(F.col("raw").rlike(r"^\s*(?:[-*+] |\d+[.)]\s+).+")).alias("bullets"), F.count_if(line.rlike(r"(?i)^Q(?:uestion)?:\s*.+")).alias("questions"),
    )


def line_topics(spark: SparkSession, folder: str) -> DataFrame:
    lines = K.with_topics(K.text_lines(table(spark, folder, "documents")))
    return lines.where("line <> ''").groupBy("doc_id", "topic").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def heading_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return K.heading_blocks(table(spark, folder, "documents"))


def explicit_objectives(spark: SparkSession, folder: str) -> DataFrame:
    return K.explicit_objectives(table(spark, folder, "documents"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))


def inferred_objectives(spark: SparkSession, folder: str) -> DataFrame:
    """Objectives for the topics of units that no explicit objective covers."""
    stated = _objectives(spark, folder).where("explicit")
    return K.inferred_objectives(_units(spark, folder), stated, F.col("doc_id"))


def assigned_objectives(spark: SparkSession, folder: str) -> DataFrame:
    return K.assign_objectives(_units(spark, folder), _objectives(spark, folder))


def prerequisite_links(spark: SparkSession, folder: str) -> DataFrame:
    return K.prerequisites(_units(spark, folder))


def represented_units(spark: SparkSession, folder: str) -> DataFrame:
    units = K.represented_units(_units(spark, folder).select("id", "topic"), _cards(spark, folder))
    return units.groupBy("topic", "status").agg(F.count("*").alias("n"))


def objective_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return K.objective_coverage(_objectives(spark, folder), _units(spark, folder))


def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    units = _units(spark, folder)
    return K.coverage_summary(K.objective_coverage(_objectives(spark, folder), units), units)


def evidence_support(spark: SparkSession, folder: str) -> DataFrame:
    supported = K.evidence_support(_cards(spark, folder), _units(spark, folder))
    return supported.groupBy("supported").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (classified_units, unit_measures, text_lines, line_topics, heading_blocks, explicit_objectives, inferred_objectives, assigned_objectives, prerequisite_links, represented_units, objective_coverage, coverage_summary, evidence_support)}

_V = r"regexp_replace({0}, '`[^`\n]*`|\"[^\"\n]*\"|\\\([^\n]*?\\\)|\$[^$\n]+\$', ' ', 'g')"
_PLAIN = r"replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(" + _V + r", '\{{\{{c\d+::(.*?)(?:::[^}}]*)?\}}\}}', '\1', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+(?:[-''][\p{{L}}\p{{N}}]+)*')"
_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)


def sql_tokens(text: str) -> str:
    return f"list_distinct(list_filter(list_transform({_WORDS.format(text)}, lambda w: lower(w)), lambda w: len(w) > 2 and w not in ({_STOP})))"


def sql_current(name: str, keys: str) -> str:
    """The row of each key loaded last, ties by the other columns."""
    return f"(select * exclude (rn) from (select *, row_number() over (partition by {keys} order by loaded_at desc nulls last) rn from {name}) where rn = 1)"


def _alt(words) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def _kind_cases() -> str:
    out = []
    for kind, purpose in V.KIND_ORDER:
        test = f"regexp_matches(low, '{_alt(V.KIND_CUES[kind])}')"
        if kind == "formula":
            test += rf" or regexp_matches(val, '{V.FORMULA_PATTERN}')"
        if kind == "definition":
            test += rf" or regexp_matches(val, '{V.DEFINITION_SHAPE}')"
        out.append((test, kind, purpose))
    return "case " + " ".join(f"when {t} then '{k}|{p}'" for t, k, p in out) + " else 'fact|recall' end"


_U, _O = sql_current("knowledge_units", "doc_id, id"), sql_current("learning_objectives", "doc_id, id")
_C = sql_current("cards", "card_id")
_LINES = r"""
with t as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]') ls from documents where text is not null),
l as (select doc_id, unnest(range(1, len(ls) + 1)) line_no, unnest(ls) raw from t),
s as (select *, regexp_replace(raw, '^[\s\x{a0}\x0b]+|[\s\x{a0}\x0b]+$', '', 'g') line from l)
"""
_COVER = f"""
with u as {_U}, o as {_O},
k as (select unnest(list_distinct(objective_ids)) id, status from u),
a as (select id, count(*) n, count(*) filter (status = 'represented') r, min(status) lo, max(status) hi from k group by 1),
c as (select o.id, o.label, o.topic, o.explicit, coalesce(n, 0) knowledge_units, coalesce(r, 0) represented_units,
  case when r > 0 then 'covered' when lo = hi then lo else 'unsupported' end status from o left join a using (id))
"""

SQL = {
    "classified_units": f"with v as (select doc_id, unit_pos, id, trim(coalesce(text, '')) val, lower(trim(coalesce(text, ''))) low from knowledge_units), c as (select *, {_kind_cases()} k from v) select doc_id, unit_pos, id, split_part(k, '|', 1) kind, split_part(k, '|', 2) purpose from c",
    "unit_measures": f"""
with t as (select doc_id, unit_pos, id, topic, source, coalesce(text, '') t from knowledge_units), p as (select *, {_PLAIN.format('t')} pl from t)
select doc_id, unit_pos, id, len({_WORDS.format('pl')}) words, len({sql_tokens('t')}) tokens, coalesce(nullif(trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'general') topic_slug,
  greatest(len(list_filter(regexp_split_to_array(regexp_replace(pl, '(\\d),(\\d{{3}})\\b', '\\1\\2', 'g'), '[,;]'), lambda x: trim(x) <> '')), 1) components,
  len(regexp_split_to_array(pl, '(?i);|\\s+(?:and|but|whereas|while)\\s+')) > 1 and len(list_filter(regexp_split_to_array(pl, '(?i);|\\s+(?:and|but|whereas|while)\\s+'), lambda x: regexp_matches(x, '(?i){_alt(V.RELATION_VERBS)}'))) > 1 compound,
  regexp_matches(t, '{V.ACRONYM}') or regexp_matches(t, '(?i){_alt(V.TECHNICAL_WORDS)}') or regexp_matches(t, '{V.LETTERS_DIGITS}') needs_context,
  'unit-' || sha256(t || chr(0) || coalesce(source, ''))[:12] stable_id from p""",
    "text_lines": _LINES + r"""select doc_id, count(*) lines, count(*) filter (line <> '') written, count(*) filter (regexp_matches(line, '^#{1,6}\s+.+')) headings,
  count(*) filter (regexp_matches(raw, '^\s*(?:[-*+] |\d+[.)]\s+).+')) bullets, count(*) filter (regexp_matches(line, '(?i)^Q(?:uestion)?:\s*.+')) questions from s group by 1""",
    "line_topics": _LINES + r""", h as (select *, coalesce(last_value(case when regexp_matches(line, '^#{1,6}\s+(.+?)\s*$') then regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1) end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 'General') topic from s)
select doc_id, topic, count(*) lines, min(line_no) first_line from h where line <> '' group by 1, 2""",
    "heading_blocks": _LINES + r""", h as (select *, regexp_matches(line, '^#{1,6}\s+(.+?)\s*$') mark from s), b as (select *, cast(sum(mark::int) over (partition by doc_id order by line_no rows unbounded preceding) as bigint) block from h)
select doc_id, block, max(case when mark then regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1) end) heading, max(case when mark then len(regexp_extract(line, '^(#{1,6})\s', 1)) end) as level, min(line_no) first_line, count(*) filter (line <> '' and not mark) as lines from b group by 1, 2""",
    "explicit_objectives": _LINES + r""", e as (select *, regexp_matches(line, '(?i)^(?:learning\s+)?objectives?\s*:\s*$') head, regexp_matches(line, '^#{1,6}\s+(.+?)\s*$') heading,
  coalesce(nullif(regexp_extract(line, '(?i)^(?:learning\s+)?objectives?\s*:\s*(.+)$', 1), ''), nullif(regexp_extract(line, '(?i)^(?:by the end of (?:this )?(?:lesson|lecture|chapter),?\s*(?:students?|learners?|you) (?:should be able to|will be able to|can)|(?:students?|learners?|you) (?:should be able to|will be able to))\s+(.+)$', 1), '')) strong,
  coalesce(nullif(regexp_extract(raw, '^\s*(?:[-*+] |\d+[.)]\s+)(.+)$', 1), ''), nullif(regexp_extract(line, '(?i)^(?:students?|learners?|you) can\s+(.+)$', 1), '')) weak,
  coalesce(last_value(case when regexp_matches(line, '^#{1,6}\s+(.+?)\s*$') then regexp_extract(line, '^#{1,6}\s+(.+?)\s*$', 1) end ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 'General') topic from s),
v as (select *, case when head then 1 when line = '' or heading then 0 when strong is null and weak is null then 0 end ev from e),
o as (select *, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) = 1 open_ from v),
b as (select doc_id, line_no, trim(coalesce(strong, case when open_ then weak end), ' .') as label, topic, 'doc-' || doc_id || ':line-' || line_no source from o where not head and line <> '' and not heading and coalesce(strong, case when open_ then weak end) is not null)
select doc_id, line_no, 'objective-' || sha256(label || chr(0) || source)[:12] id, label, topic, source, true explicit from b""",
    "inferred_objectives": f"""
with u as {_U}, o as {_O}, t as (select distinct doc_id, coalesce(nullif(trim(topic), ''), 'General') topic from u)
select t.doc_id, 'objective-' || sha256(t.topic || chr(0) || t.doc_id)[:12] id, 'Understand and recall the major concepts in ' || t.topic as label, t.topic, t.doc_id as source, false as explicit
from t where not exists (select 1 from o where o.explicit and o.doc_id = t.doc_id and o.topic = t.topic)""",
    "assigned_objectives": f"""
with u as (select doc_id, id, topic, {sql_tokens("coalesce(text, '')")} tok from {_U}), o as (select distinct doc_id, topic, id oid, {sql_tokens("coalesce(label, '')")} lab from {_O}),
v as (select u.*, case when exists (select 1 from o where o.doc_id = u.doc_id and o.topic = u.topic) then topic else 'General' end look from u),
p as (select v.doc_id, v.id, oid, len(list_intersect(tok, lab)) score from v left join o on o.doc_id = v.doc_id and o.topic = v.look),
b as (select doc_id, id, count(oid) n, max(case when oid is not null then score end) best from p group by 1, 2)
select p.doc_id, p.id, coalesce(list(oid order by oid) filter (oid is not null and (n = 1 or (score = best and score > 0))), []) objective_ids from p join b using (doc_id, id) group by 1, 2""",
    "prerequisite_links": rf"""
with u as {_U}, d as (select doc_id, topic, unit_pos definition_pos, id prerequisite_id, trim(regexp_extract(coalesce(text, ''), '(?i)^(.+?)\s+(?:is|means|refers to)\s+(.+?)[.!?]?$', 1)) term from u where kind = 'definition')
select u.doc_id, u.unit_pos, u.id, d.prerequisite_id, d.definition_pos from u join d on d.doc_id = u.doc_id and d.topic = u.topic and d.definition_pos < u.unit_pos
where term <> '' and contains(lower(text), lower(term)) and regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(term) || '([^\p{{L}}\p{{N}}_]|$)')""",
    "represented_units": f"with u as {_U}, c as (select distinct knowledge_unit_id id from {_C} where knowledge_unit_id is not null) select u.topic, case when c.id is null then 'deferred' else 'represented' end status, count(*) n from u left join c using (id) group by 1, 2",
    "objective_coverage": _COVER + "select * from c",
    "coverage_summary": _COVER + ", x as (select count(*) objectives, count(*) filter (status = 'covered') covered_objectives from c), y as (select count(*) knowledge_units, " + ", ".join(f"count(*) filter (status = '{s}') {s}" for s in V.UNIT_STATUSES) + " from u) select *, coalesce(round(covered_objectives / nullif(objectives, 0), 4), 0.0) objective_coverage from x, y",
    "evidence_support": rf"""
with u as (select id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) hay from {_U}), c as (select knowledge_unit_id, trim(regexp_replace(lower(trim(coalesce(back, ''), ' .')), '\s+', ' ', 'g')) needle from {_C}),
j as (select case when needle <> '' then contains(hay, needle) when hay is not null then false end supported from c left join u on u.id = c.knowledge_unit_id)
select supported, count(*) n from j group by 1""",
}
