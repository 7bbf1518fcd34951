"""Learning objectives, knowledge units, prerequisites and coverage as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.sources.tables import BLANKS, materialize

_HEADING = r"^#{1,6}\s+(.+?)\s*$"
_OBJECTIVES_HEAD = r"(?i)^(?:learning\s+)?objectives?\s*:\s*$"
_OBJECTIVE = r"(?i)^(?:learning\s+)?objectives?\s*:\s*(.+)$"
_OUTCOME = r"(?i)^(?:by the end of (?:this )?(?:lesson|lecture|chapter),?\s*(?:students?|learners?|you) (?:should be able to|will be able to|can)|(?:students?|learners?|you) (?:should be able to|will be able to))\s+(.+)$"
_BULLET = r"^\s*(?:[-*+] |\d+[.)]\s+)(.+)$"
_WEAK = r"(?i)^(?:students?|learners?|you) can\s+(.+)$"


def current_rows(rows: DataFrame, *key: str) -> DataFrame:
    """Of the rows of a key the one loaded last; ties by all other columns that sort."""
    others = [c for c, kind in rows.dtypes if c not in key and c != "loaded_at" and not kind.startswith("map")]
    dropped = [c for c, kind in rows.dtypes if kind.startswith("map")]
    last = F.max(F.struct("loaded_at", *others)).alias("last")
    return rows.drop(*dropped).groupBy(*key).agg(last).select(*key, "last.*")


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 1, raw, line): lines of each text, stripped in ``line``."""
    split = F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0b\x0c\x85  ]"))
    rows = docs.where(F.col(text).isNotNull()).select(key, split.alias("at", "raw"))
    return rows.select(key, (F.col("at") + 1).alias("line_no"), "raw", F.regexp_replace("raw", r"^[\s ]+|[\s ]+$", "").alias("line"))


def with_topics(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with the topic in force: the last heading up to here, else General."""
    heading = F.when(F.col("line").rlike(_HEADING), F.regexp_extract("line", _HEADING, 1))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("topic", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit("General")))


def heading_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, heading, level, first_line, lines): the text under each heading up
    to the next one; block 0, without heading, is what stands before the first."""
    mark = F.col("line").rlike(_HEADING)
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = text_lines(docs, key).withColumn("block", F.sum(mark.cast("int")).over(so_far))
    heading = F.max(F.when(mark, F.regexp_extract("line", _HEADING, 1)))
    level = F.max(F.when(mark, F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))))
    written = F.count_if((F.col("line") != "") & ~mark)
    return lines.groupBy(key, "block").agg(heading.alias("heading"), level.alias("level"), F.min("line_no").alias("first_line"), written.alias("lines"))


def explicit_objectives(docs: DataFrame, source: Column, key: str = "doc_id") -> DataFrame:
    """Objectives that the texts state: key, line_no, id, label, topic, source, explicit.

    Strong outcomes count anywhere; bullets and a bare "you can" only inside a
    block that a header opened. Blank lines, headings and lines that state no
    objective close the block for the lines after them.
    """
    lines = with_topics(text_lines(docs.withColumn("source_name", source), key), key)
    names = docs.select(key, source.alias("source_name"))
    line, raw = F.col("line"), F.col("raw")
    nz = lambda c: F.nullif(c, F.lit(""))
    is_head, is_heading, blank = line.rlike(_OBJECTIVES_HEAD), line.rlike(_HEADING), line == ""
    strong = F.coalesce(nz(F.regexp_extract(line, _OBJECTIVE, 1)), nz(F.regexp_extract(line, _OUTCOME, 1)))
    weak = F.coalesce(nz(F.regexp_extract(raw, _BULLET, 1)), nz(F.regexp_extract(line, _WEAK, 1)))
    # what a line does to the block: 1 opens, 0 closes, null leaves it
    event = F.when(is_head, 1).when(blank | is_heading, 0).when(strong.isNull() & weak.isNull(), 0)
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(0)) == 1
    # a strong outcome keeps a closed block closed and an open one open; a weak line outside a block closes nothing more
    label = F.when(~is_head & ~blank & ~is_heading, F.coalesce(strong, F.when(open_, weak)))
    found = lines.withColumn("label", F.btrim(label, F.lit(" ."))).where("label is not null").join(names, key)
    at = F.concat("source_name", F.lit(":line-"), F.col("line_no").cast("string"))
    return found.select(key, "line_no", T.stable_id("objective", F.col("label"), at).alias("id"), "label", "topic", at.alias("source"), F.lit(True).alias("explicit"))


def inferred_objectives(units: DataFrame, explicit: DataFrame, source: Column, key: str = "doc_id") -> DataFrame:
    """One objective per topic of a document that has no explicit one."""
    topics = units.select(key, F.coalesce(F.nullif(F.btrim("topic"), F.lit("")), F.lit("General")).alias("topic"), source.alias("source"))
    open_ = topics.groupBy(key, "topic").agg(F.min("source").alias("source")).join(explicit.select(key, "topic").distinct(), [key, "topic"], "left_anti")
    label = F.concat(F.lit("Understand and recall the major concepts in "), F.col("topic"))
    return open_.select(key, T.stable_id("objective", F.col("topic"), F.col("source")).alias("id"), label.alias("label"), "topic", "source", F.lit(False).alias("explicit"))


def said(units: DataFrame) -> Column:
    """Question, answer and text of units, as far as they have them."""
    return F.concat_ws(" ", *(F.col(c) for c in ("question", "answer", "text") if c in units.columns))


def assign_objectives(units: DataFrame, objectives: DataFrame, key: str = "id") -> DataFrame:
    """(doc_id, key, objective_ids): objectives of the unit's topic, or of General if
    the topic has none. A single candidate is taken; of several, those that share
    the most words with the unit, if they share any.

    Two equi-joins on (doc_id, topic) and one aggregate per unit; objectives of a
    document and topic are few, so the join is not a product.
    """
    mine = units.select("doc_id", key, "topic", T.semantic_tokens(said(units)).alias("tokens"))
    theirs = objectives.select("doc_id", "topic", F.col("id").alias("objective_id"), T.semantic_tokens(T.text_or_empty(F.col("label"))).alias("label_tokens")).distinct()
    has_own = theirs.select("doc_id", "topic").distinct().withColumn("own", F.lit(True))
    looked = mine.join(has_own, ["doc_id", "topic"], "left").withColumn("topic", F.when(F.col("own"), F.col("topic")).otherwise("General")).drop("own")
    pairs = looked.join(theirs, ["doc_id", "topic"], "left").withColumn("score", F.size(F.array_intersect("tokens", "label_tokens")))
    scored = pairs.groupBy("doc_id", key).agg(
        F.count("objective_id").alias("n"), F.max(F.when(F.col("objective_id").isNotNull(), F.col("score"))).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("objective_id").isNotNull(), F.struct("objective_id", "score")))).alias("all"),
    )
    best = F.filter("all", lambda x: (F.col("n") == 1) | ((x["score"] == F.col("best")) & (x["score"] > 0)))
    return scored.select("doc_id", key, F.transform(best, lambda x: x["objective_id"]).alias("objective_ids"))


def definition_terms(units: DataFrame) -> DataFrame:
    """(doc_id, topic, unit_pos, id, term) of the units that define a term: the one their
    question asks for, or else the subject of their text."""
    subject = F.btrim(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?i)^(.+?)\s+(?:is|means|refers to)\s+(.+?)[.!?]?$", 1))
    if "question" in units.columns:
        subject = F.coalesce(F.nullif(T.definition_term(T.text_or_empty(F.col("question"))), F.lit("")), subject)
    return units.where("kind = 'definition'").select("doc_id", "topic", "unit_pos", "id", subject.alias("term")).where("term <> ''")


def prerequisites(units: DataFrame) -> DataFrame:
    """(doc_id, unit_pos, id, prerequisite_id, definition_pos): earlier definitions of
    the topic whose term occurs in the unit as a whole word, case aside.

    An equi-join on (doc_id, topic) with the order and a plain substring test
    before the regular expression, which only few pairs reach.
    """
    terms = definition_terms(units).select("doc_id", "topic", F.col("unit_pos").alias("definition_pos"), F.col("id").alias("prerequisite_id"), "term")
    pairs = units.select("doc_id", "topic", "unit_pos", "id", "text").join(terms, ["doc_id", "topic"]).where("definition_pos < unit_pos")
    near = pairs.where(F.contains(F.lower("text"), F.lower("term")))
    whole = F.expr(r"text rlike concat('(?i)(?<![\\p{L}\\p{N}_])\\Q', term, '\\E(?![\\p{L}\\p{N}_])')")
    return near.where(whole).select("doc_id", "unit_pos", "id", "prerequisite_id", "definition_pos")


def plan_knowledge(docs: DataFrame, units: DataFrame, source: Column) -> tuple[DataFrame, DataFrame]:
    """(objectives, units) of documents and their classified units.

    Objectives are those the texts state and, for topics without any, inferred ones.
    Units get ``objective_ids``, ``prerequisite_ids`` (in the order of the definitions),
    origin ``source`` and confidence 1. Units without a link have empty arrays; they are
    written once, since four joins read them.
    """
    units = materialize(units, "units")
    explicit = explicit_objectives(docs, source)
    names = docs.select("doc_id", source.alias("source_name"))
    inferred = inferred_objectives(units.select("doc_id", "topic").distinct().join(names, "doc_id"), explicit, F.col("source_name"))
    objectives = materialize(explicit.drop("line_no").unionByName(inferred), "objectives")
    assigned = assign_objectives(units, objectives, "unit_pos")
    links = prerequisites(units.withColumn("id", F.col("unit_id")))
    before = links.groupBy("doc_id", "unit_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("definition_pos", "prerequisite_id"))), lambda x: x["prerequisite_id"]).alias("prerequisite_ids"))
    planned = units.join(assigned, ["doc_id", "unit_pos"], "left").join(before, ["doc_id", "unit_pos"], "left")
    none = F.array().cast("array<string>")
    return objectives, planned.withColumns({"objective_ids": F.coalesce("objective_ids", none), "prerequisite_ids": F.coalesce("prerequisite_ids", none), "origin": F.lit("source"), "confidence": F.lit(1.0)})


#: Invariants of units, by the name of what is wrong.
UNIT_FAULTS = ("id", "text", "source", "kind", "purpose", "origin", "status", "confidence")


def unit_faults(units: DataFrame) -> DataFrame:
    """Units with ``faults``: what of UNIT_FAULTS doesn't hold. Ids, texts and sources
    must not be blank, kinds, purposes, origins and statuses known (nulls are not), and
    confidences from 0 to 1."""
    blank = lambda c: F.btrim(T.text_or_empty(F.col(c)), F.lit(BLANKS)) == ""
    unknown = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    wrong = (
        blank("id"), blank("text"), blank("source"), unknown("kind", V.KNOWLEDGE_KINDS), unknown("purpose", V.LEARNING_PURPOSES), unknown("origin", V.ORIGINS), unknown("status", V.UNIT_STATUSES),
        ~F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)),
    )
    return units.withColumn("faults", F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in zip(UNIT_FAULTS, wrong)))))


def represented_units(units: DataFrame, cards: DataFrame) -> DataFrame:
    """Units with the status their cards give them: represented, or else deferred."""
    carded = cards.select(F.col("knowledge_unit_id").alias("id")).where("id is not null").distinct().withColumn("carded", F.lit(True))
    joined = units.join(carded, "id", "left")
    return joined.withColumn("status", F.when(F.col("carded"), "represented").otherwise("deferred")).drop("carded")


def objective_coverage(objectives: DataFrame, units: DataFrame) -> DataFrame:
    """Per objective: units that name it, those represented, and its status: covered
    if any is represented, else the only status there is, else unsupported."""
    links = units.select(F.explode(F.array_distinct("objective_ids")).alias("id"), "status")
    sums = links.groupBy("id").agg(F.count("*").alias("knowledge_units"), F.count_if(F.col("status") == "represented").alias("represented_units"), F.min("status").alias("low"), F.max("status").alias("high"))
    joined = objectives.join(sums, "id", "left").fillna(0, ["knowledge_units", "represented_units"])
    status = F.when(F.col("represented_units") > 0, "covered").when(F.col("low") == F.col("high"), F.col("low")).otherwise("unsupported")
    return joined.select("id", "label", "topic", "explicit", "knowledge_units", "represented_units", status.alias("status"))


def coverage_summary(coverage: DataFrame, units: DataFrame) -> DataFrame:
    """One row: objectives, covered, their share rounded to 4, units per status."""
    of_objectives = coverage.agg(F.count("*").alias("objectives"), F.count_if(F.col("status") == "covered").alias("covered_objectives"))
    of_units = units.agg(F.count("*").alias("knowledge_units"), *(F.count_if(F.col("status") == s).alias(s) for s in V.UNIT_STATUSES))
    share = F.coalesce(F.round(F.try_divide("covered_objectives", "objectives"), 4), F.lit(0.0))
    return of_objectives.join(of_units).withColumn("objective_coverage", share)  # one row by one row


def evidence_support(cards: DataFrame, units: DataFrame) -> DataFrame:
    """(card_id, supported): whether the card's back stands in the text of its unit,
    spaces and case aside; null for a card without such a unit."""
    texts = units.select(F.col("id").alias("knowledge_unit_id"), T.compact(F.col("text")).alias("haystack"))
    joined = cards.join(texts, "knowledge_unit_id", "left")
    needle = T.compact(F.btrim(T.text_or_empty(F.col("back")), F.lit(" .")))
    return joined.select("card_id", F.when(needle != "", F.contains("haystack", needle)).otherwise(F.when(F.col("haystack").isNotNull(), False)).alias("supported"))
