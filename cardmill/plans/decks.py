"""Queries over card decks: rules, duplicates, audit, order, import; and from texts to cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.operators import card_rules as R
from cardmill.operators import cards as C
from cardmill.operators import knowledge as K
from cardmill.operators import ordering as O
from cardmill.operators import units as U
from cardmill.operators import reports as P
from cardmill.operators.reports import CHECKS
from cardmill.plans.data_quality import _CARDS, _records
from cardmill.plans.knowledge import _C, _PLAIN, _V, _WORDS, _alt, sql_tokens
from cardmill.sources.card_records import accepted
from cardmill.sources.tables import table


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return K.current_rows(table(spark, folder, "cards"), "card_id")


def _decks(spark: SparkSession, folder: str) -> DataFrame:
    return accepted(_records(spark, folder))


def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.rule_counts(_cards(spark, folder))


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    return R.audit_summary(_cards(spark, folder))


def duplicate_cards(spark: SparkSession, folder: str) -> DataFrame:
    return R.duplicates(_cards(spark, folder))


def card_types(spark: SparkSession, folder: str) -> DataFrame:
    return _cards(spark, folder).groupBy("card_type").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"))


def deck_runs(spark: SparkSession, folder: str) -> DataFrame:
    return O.avoidable_runs(_decks(spark, folder), "deck_file", "row_no", "Topic")


def topic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs in the cards of each source file, in the order of their ids."""
    decks = _cards(spark, folder).select(F.substring_index("source", "/", 1).alias("deck"), "card_id", "card_type")
    return O.avoidable_runs(decks, "deck", "card_id", "card_type")


def interleaved(spark: SparkSession, folder: str) -> DataFrame:
    decks = _cards(spark, folder).select(F.substring_index("source", "/", 1).alias("deck"), "card_id", "topic")
    return O.interleave(decks, "deck", "card_id", "topic")


def deck_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "card_csv_rows")
    return O.first_seen(rows, "deck_file", "loaded_at")


def pending_import(spark: SparkSession, folder: str) -> DataFrame:
    """Valid card rows whose CardID no card has yet: an anti-join."""
    known = table(spark, folder, "cards").select(F.col("card_id").alias("CardID")).where("CardID is not null").distinct()
    return _decks(spark, folder).join(known, "CardID", "left_anti").groupBy("deck_file").agg(F.count("*").alias("pending"))


def card_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = _cards(spark, folder).select(F.explode("tags").alias("tag"))
    return tags.groupBy(T.slug(F.col("tag")).alias("tag")).agg(F.count("*").alias("n"))


def split_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "knowledge_units").select("doc_id", "unit_pos", T.split_sentences(T.text_or_empty(F.col("text"))).alias("s"))
    return rows.select("doc_id", "unit_pos", F.posexplode("s").alias("pos", "sentence"))


def parsed_units(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("source_name", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return U.parse_units(docs)


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return K.plan_knowledge(docs, C.classify_units(parsed_units(spark, folder)), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))


def planned_objectives(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)[0]


def planned_units(spark: SparkSession, folder: str) -> DataFrame:
    planned = _plan(spark, folder)[1]
    return planned.select("doc_id", "unit_pos", "unit_id", "kind", "purpose", "topic", "source", "objective_ids", "prerequisite_ids", "origin", "confidence")


def built_cards(spark: SparkSession, folder: str) -> DataFrame:
    return C.build_cards(_plan(spark, folder)[1])


def audit_violations(spark: SparkSession, folder: str) -> DataFrame:
    """All that an audit of the cards finds, per source, code and level."""
    cards = _cards(spark, folder)
    decks = R.deck_violations(spark, R.Scheduler(), 1, False)
    return P.all_violations(cards, decks).groupBy("rank", "code", "level").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (rule_counts, audit_summary, duplicate_cards, card_types, deck_runs, topic_runs, interleaved, deck_order, pending_import, card_tags, split_sentences, parsed_units, planned_objectives, planned_units, built_cards, audit_violations)}

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_SPLIT = r"regexp_split_to_array(pb, '(?i);|\s+(?:and|but|whereas|while)\s+')"
_RULES = {
    "MISSING_CONTENT": ("error", "trim(front) = '' or trim(back) = ''"),
    "MISSING_SOURCE": ("error", "trim(source) = ''"),
    "UNLABELED_ENRICHMENT": ("error", "origin = 'generated-enrichment' and not contains(extra, 'Enrichment:')"),
    "UNLABELED_INFERENCE": ("warning", "origin = 'inferred' and not contains(extra, 'Inference:')"),
    "INVALID_CONFIDENCE": ("error", "not (confidence between 0 and 1)"),
    "INVALID_KNOWLEDGE_KIND": ("error", f"knowledge_kind not in ({_in(V.KNOWLEDGE_KINDS)})"),
    "INVALID_LEARNING_PURPOSE": ("error", f"learning_purpose not in ({_in(V.LEARNING_PURPOSES)})"),
    "INVALID_ORIGIN": ("error", f"origin not in ({_in(V.ORIGINS)})"),
    "FRONT_TOO_LONG": ("error", f"len({_WORDS.format('pf')}) > 19"),
    "MISSING_EXPLANATION": ("error", "trim(extra) = ''"),
    "MISSING_CONTEXT": ("error", f"trim(context) = '' and (regexp_matches(fb, '{V.ACRONYM}') or regexp_matches(fb, '(?i){_alt(V.TECHNICAL_WORDS)}') or regexp_matches(fb, '{V.LETTERS_DIGITS}'))"),
    "INVALID_CARD_TYPE": ("error", f"card_type not in ({_in(V.CARD_TYPES)})"),
    "CLOZE_FORMAT": ("error", r"card_type = 'cloze' and not regexp_matches(vf, '\{\{c\d+::(.*?)(?:::[^}]*)?\}\}')"),
    "TYPE_FORMAT_MISMATCH": ("error", r"card_type <> 'cloze' and regexp_matches(vf, '\{\{c\d+::(.*?)(?:::[^}]*)?\}\}')"),
    "REVERSE_FORMAT": ("error", "card_type = 'reverse' and not starts_with(front, 'Which term means:')"),
    "COGNITIVE_LOAD": ("error", r"card_type <> 'list' and greatest(len(list_filter(regexp_split_to_array(regexp_replace(pb, '(\d),(\d{3})\b', '\1\2', 'g'), '[,;]'), lambda x: trim(x) <> '')), 1) > 4"),
    "ATOMICITY_REVIEW": ("warning", f"card_type <> 'list' and len({_SPLIT}) > 1 and len(list_filter({_SPLIT}, lambda x: regexp_matches(x, '(?i){_alt(V.RELATION_VERBS)}'))) > 1"),
    "GENERIC_PROMPT": ("warning", f"regexp_matches(trim(pf), '^(?:{'|'.join(V.GENERIC_STEMS)})')"),
    "THIN_EXPLANATION": ("warning", f"len(list_filter({sql_tokens('extra')}, lambda x: not list_contains({sql_tokens('fb')}, x))) = 0"),
    "IMAGE_TYPE": ("error", "image_url <> '' and card_type <> 'image-supported'"),
    "IMAGE_ALT": ("error", f"image_url <> '' and not (len({_WORDS.format(_PLAIN.format('image_alt'))}) >= 6 and regexp_matches(image_alt, '(?i){_alt((*V.RECALL_WORDS, 'relationship', 'spatial'))}'))"),
}
_TEXTS = ("front", "back", "extra", "context", "mnemonic", "card_type", "image_url", "image_alt", "source", "knowledge_kind", "learning_purpose", "origin")
def _ruled(cards: str) -> str:
    """Cards with what the rules look at, from any table of cards."""
    return f"with c as (select {', '.join(f'coalesce({t}, {chr(39)}{chr(39)}) {t}' for t in _TEXTS)}, coalesce(confidence, 1.0) confidence, card_id, topic from {cards}), p as (select *, {_PLAIN.format('front')} pf, {_PLAIN.format('back')} pb, {_V.format('front')} vf, front || ' ' || back fb from c)\n"


_RULED = _ruled(_C)
_LISTED = """
, s as (select *, regexp_replace(pb, '(\\d),(\\d{3})\\b', '\\1' || chr(1) || '\\2', 'g') safe from p),
i as (select *, list_filter(list_transform(case when contains(safe, ';') then string_split(safe, ';') else string_split(regexp_replace(safe, '(?i),?\\s+(?:and|or)\\s+', ', ', 'g'), ',') end,
  lambda x: replace(trim(x, ' .'), chr(1), ',')), lambda x: x <> '') parts from s),
l as (select *, case when regexp_matches(pb, '[,;]') and len(parts) >= 2 and len(list_filter(parts, lambda x: len(WORDS) > 12)) = 0 then parts else [] end items from i),
m as (select *, case when len(items) between 3 and 8 and len(list_filter(items, lambda x: rtrim(lower(regexp_extract(x, '^\\s*(\\S+)', 1)), ',') in (SUBS) or regexp_matches(x, '[a-z]{3,}\\.\\s+["'']?[A-Z]')
  or regexp_matches(x, '(?i)MARKS') or regexp_matches(trim(x), '^(?:[A-Z][A-Za-z-]+|[a-z]+s|[Tt]he\\s+\\w+|[Aa]n?\\s+\\w+)\\s+(?:\\w+\\s+){0,3}(?:\\w+ed|laid|made|became|appeared)\\b'))) < 2 then items else [] end answers,
  case when regexp_matches(trim(pb, ' .'), '(?i)NOENUM') or len(list_filter(items, lambda x: regexp_matches(x, '(?i)VERBS'))) > 0 then [] else items end members from l),
z as (select *, upper(array_to_string(list_transform(answers, lambda x: coalesce(nullif(regexp_extract(x, '[A-Za-z0-9]', 0), ''), 'X')), '')) initials from m)
""".replace("WORDS", _WORDS.format("x")).replace("SUBS", _in(V.SUBORDINATORS)).replace("MARKS", _alt(V.CLAUSE_MARKERS)).replace("NOENUM", _alt(V.NO_ENUMERATION_WORDS)).replace("VERBS", _alt(V.RELATION_VERBS))
_ALL = _RULES | {
    "LIST_SIZE": ("error", "card_type = 'list' and len(answers) not between 3 and 8"),
    "MNEMONIC_MISMATCH": ("error", "card_type = 'list' and len(answers) between 3 and 8 and upper(trim(split_part(mnemonic, ':', 1))) <> initials"),
    "MISSING_MNEMONIC": ("error", "len(members) >= 3 and trim(mnemonic) = ''"),
}
_BROKEN = ", b as (select card_id, unnest(list_filter([" + ", ".join(f"case when {test} then '{code}|{level}' end" for code, (level, test) in _ALL.items()) + "], lambda v: v is not null)) v from z)\n"


def card_rule_sql(cards: str) -> str:
    """``b`` (card_id, v): code and level of each broken rule of any table of cards."""
    return _ruled(cards) + _LISTED + _BROKEN


_EACH = card_rule_sql(_C)
_ACTIONS = "(values " + ", ".join(f"('{code}', '{action.replace(chr(39), chr(39) * 2)}')" for code, action in R.REMEDIES.items()) + ") a(code, action)"
_count = lambda level: " + ".join(f"(coalesce({test}, false))::int" for lv, test in _ALL.values() if lv == level)
_check = lambda codes: " or ".join(f"coalesce({_ALL[c][1]}, false)" for c in codes)

SQL = {
    "rule_counts": _EACH + "select split_part(v, '|', 1) code, split_part(v, '|', 2) as level, count(*) n from b group by 1, 2",
    "remedies": _EACH + f"select action, count(*) n from b join {_ACTIONS} on a.code = split_part(v, '|', 1) group by 1",
    "audit_checks": _RULED + _LISTED + " union all ".join(f"select '{name}' as check, count(*) filter ({_check(codes)}) = 0 passed, count(*) filter ({_check(codes)}) n_cards from z" for name, codes in CHECKS.items()),
    "audit_summary": _RULED + _LISTED + f", t as (select *, {_count('error')} e, {_count('warning')} w from z) select count(*) cards, coalesce(sum(e), 0)::bigint errors, coalesce(sum(w), 0)::bigint warnings, count(*) filter (len({_WORDS.format('pf')}) > 19) fronts_over_limit, count(*) filter (image_url <> '') image_cards, count(distinct topic) topics, "
    + ", ".join(f"count(*) filter (card_type = '{t}') \"{t.replace('-', '_')}\"" for t in V.CARD_TYPES) + ", case when coalesce(sum(e), 0) = 0 and count(*) > 0 then 'PASS' else 'FAIL' end verdict from t",
    "audit_violations": _EACH + f", g as (select 1 from {_C} group by lower(coalesce(front, '')), lower(coalesce(back, '')) having count(*) > 1) select 0 as rank, split_part(v, '|', 1) code, split_part(v, '|', 2) as level, count(*) n from b group by all union all select 3, 'DUPLICATE_CARD', 'warning', count(*) from g having count(*) > 0",
    "duplicate_cards": f"select lower(coalesce(front, '')) front, lower(coalesce(back, '')) back, count(*) n from {_C} group by 1, 2 having count(*) > 1",
    "card_types": f"select card_type, count(*) n, count(distinct topic) topics from {_C} group by 1",
    "topic_runs": f"""
with d as (select split_part(source, '/', 1) deck, card_id, card_type from {_C}),
r as (select deck, lag(card_type) over w = card_type again, count(*) over (partition by deck order by card_id rows between current row and unbounded following) - count(*) over (partition by deck, card_type order by card_id rows between current row and unbounded following) others from d window w as (partition by deck order by card_id))
select deck, count(*) filter (again and others > 0) avoidable_runs from r group by 1""",
    "deck_runs": _CARDS + """, runs as (select deck_file, lag("Topic") over w = "Topic" again, count(*) over (partition by deck_file order by row_no rows between current row and unbounded following)
  - count(*) over (partition by deck_file, "Topic" order by row_no rows between current row and unbounded following) others from k window w as (partition by deck_file order by row_no))
select deck_file, count(*) filter (again and others > 0) avoidable_runs from runs group by 1""",
    "pending_import": _CARDS + """select deck_file, count(*) pending from k where not exists (select 1 from cards c where c.card_id = k."CardID") group by 1""",
    "deck_order": "select deck_file, min(loaded_at) first_at from card_csv_rows where deck_file <> '' group by 1",
    "card_tags": f"with t as (select unnest(tags) t from {_C}) select coalesce(nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'general') tag, count(*) n from t group by 1",
}
