"""From units to cards: type, prompt, mnemonic, explanation, stable id.

Everything is Column expressions over the units but the balance of reverse and
plain cards, which depends on the cards before in the same document: one pass over
the document's units in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V
from cardmill.operators.layouts import CODE_TAG

CANDIDATES = "Candidate Cards"
_DEFINITION = r"(?i)^(.+?)\s+(?:is|means|refers to)\s+(.+?)[.!?]?$"
_RELATION = r"(?i)^(.+?)\s+(" + "|".join(V.RELATION_VERBS) + r")\s+(.+?)[.!?]?$"
_FORMULA = r"^([^=]{1,60}?)\s*=\s*(.+?)\.?$"
#: Prompts by kind: the shape of a statement, the prompt, the group of the answer.
KIND_PROMPTS = {
    "comparison": (r"(?i)^(.+?) differs? from (.+?) (?:because|by) (.+)$", "How does {1} differ from {2}?", 3),
    "mechanism": (r"(?i)^Because (.+?), (.+)$", "What causes this outcome: {2}?", 1),
    "narrative": (r"(?i)^After (.+?), (.+)$", "What happens after {1}?", 2),
    "exception": (r"(?i)^(.+?) only when (.+)$", "Under what condition is this rule true: {1}?", 2),
}


def _bare(c: Column) -> Column:
    return F.btrim(c, F.lit(" ."))


def has_verbatim(c: Column) -> Column:
    return c.rlike(V.VERBATIM)


def exact_answer(answer: Column) -> Column:
    value = F.regexp_replace(F.btrim(answer), r"\.+$", "")
    return (answer != "") & (value.rlike(r"^[A-Za-z]\w*\s*=\s*.+$") | ((T.word_count(value) <= 3) & value.rlike(r"\d")) | value.rlike("^[A-Z]{2,}$"))


def parts_of(u: dict[str, Column]) -> dict[str, Column]:
    """What routing and prompts both look at: the sides of a definition and of a
    relation, the items of an authored answer, the term a question asks for."""
    text, asked = u["text"], u["question"] != ""
    none = F.array().cast("array<string>")
    return {
        "subject": F.btrim(F.regexp_extract(text, _DEFINITION, 1)), "object": _bare(F.regexp_extract(text, _DEFINITION, 2)),
        "left": F.btrim(F.regexp_extract(text, _RELATION, 1)), "verb": F.lower(F.regexp_extract(text, _RELATION, 2)), "right": _bare(F.regexp_extract(text, _RELATION, 3)),
        "items": F.when(asked & (u["answer"] != ""), T.answer_items(u["answer"])).otherwise(none), "term": F.when(asked, T.definition_term(u["question"])).otherwise(""),
    }


def cloze_text(u: dict[str, Column]) -> Column:
    """A statement with its object, its end after the verb or its last words hidden."""
    hide = lambda before, answer: F.concat(before, F.lit(" {{c1::"), answer, F.lit("}}."))
    text, subject, object_ = u["text"], u["subject"], u["object"]
    head = F.regexp_extract(text, T.VERB.replace("(?i)", "(?i)^(.*?") + ")(.*)$", 1)
    tail = _bare(F.regexp_extract(text, T.VERB.replace("(?i)", "(?i)^(.*?") + ")(.*)$", 2))
    parts = F.split(_bare(text), r"\s+")
    n = F.least(F.lit(4), F.size(parts) - 1)
    by_words = hide(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(1))), " "), F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), " "))
    return F.when(T.has_cloze(text), text).when(subject != "", hide(F.concat(subject, F.lit(" is")), object_)).when(tail != "", hide(head, tail)).when(F.size(parts) >= 3, by_words).otherwise(text)


def cloze_answer(cloze: Column) -> Column:
    hidden = F.regexp_extract_all(T.without_verbatim(cloze), F.lit(V.CLOZE), F.lit(1))
    return F.when(F.size(hidden) > 0, F.array_join(hidden, "; ")).otherwise(cloze)


def list_answer(answer: Column, items: Column) -> Column:
    ordered = T.sequence_items(answer)
    prefix = F.regexp_extract(_bare(answer), r"(?i)^(.+?\bfrom )", 1)
    return F.when(F.size(ordered) > 0, F.concat(prefix, F.array_join(ordered, " -> "), F.lit("."))).otherwise(F.concat(F.array_join(items, "; "), F.lit(".")))


def must_defer(answer: Column, items: Column) -> Column:
    """An authored answer that is no list a card could ask for: more items than a list
    may have, or three and more that aren't parallel."""
    return (F.size(items) == 0) & (F.size(T.list_items(answer)) >= 3)


def reversible(u: dict[str, Column]) -> Column:
    asked = (u["term"] != "") & (T.word_count(u["answer"]) <= 12)
    return F.when((u["question"] != "") & (u["answer"] != ""), asked).otherwise(u["subject"] != "")


def route(u: dict[str, Column]) -> Column:
    """The card type by the unit alone; ``reverse?`` where the balance decides
    between reverse and qa."""
    question = u["question"] != ""
    opaque = (u["verbatim_kind"] != "") | has_verbatim(u["text"]) | has_verbatim(u["answer"]) | F.concat_ws(" ", u["text"], u["answer"]).rlike(r"\\[A-Za-z]+")
    return (
        F.when(u["image_url"] != "", "image-supported")
        .when(opaque, "qa")
        .when((u["kind"] == "formula") | exact_answer(u["answer"]), "typed")
        .when(F.size(u["items"]) > 0, "list")
        .when(question & (u["topic"] == CANDIDATES), "qa")
        .when((question | (u["kind"] == "definition")) & reversible(u), "reverse?")
        .when(question | u["kind"].isin("definition", "comparison", "mechanism", "argument", "narrative", "exception"), "qa")
        .when((u["left"] != "") & T.word_count(u["right"]).between(1, 8), "cloze")
        .otherwise("qa")
    )


def prompt(u: dict[str, Column], card_type: Column) -> Column:
    """struct(front, back); both empty where nothing specific can be asked."""
    pair = lambda f, b: F.struct(f.alias("front"), b.alias("back"))
    text, question, answer = u["text"], u["question"], u["answer"]
    authored = (question != "") & (answer != "")
    subject, object_ = u["subject"], u["object"]
    means = lambda x: F.concat(F.lit("Which term means: "), x, F.lit("?"))
    term, cloze = u["term"], cloze_text(u)
    made = (
        F.when(u["verbatim_kind"] == "math", pair(F.lit("What expression is displayed?"), text))
        .when((card_type == "reverse") & authored & (term != ""), pair(means(F.regexp_replace(answer, r"\.+$", "")), term))
        .when((card_type == "reverse") & (question == "") & (subject != ""), pair(means(object_), subject))
        .when(card_type == "cloze", pair(cloze, cloze_answer(cloze)))
        .when((card_type == "list") & authored, pair(question, list_answer(answer, u["items"])))
        .when(authored, pair(question, answer))
        .when(text.rlike(_FORMULA), pair(F.concat(F.lit("What is the formula for "), F.btrim(F.regexp_extract(text, _FORMULA, 1)), F.lit("?")), F.btrim(F.regexp_extract(text, _FORMULA, 2))))
    )
    bare = _bare(text)
    for kind, (shape, template, group) in KIND_PROMPTS.items():
        before, _, rest = template.partition("{")
        front = F.concat(F.lit(before), F.regexp_extract(bare, shape, int(rest[0])), *_rest(rest[2:], bare, shape))
        made = made.when((u["kind"] == kind) & bare.rlike(shape), pair(front, F.regexp_extract(bare, shape, group)))
    relation = F.concat(F.lit("Complete: "), u["left"], F.lit(" "), u["verb"], F.lit(" ___."))
    return (
        made.when(subject != "", pair(F.concat(F.lit("What is "), subject, F.lit("?")), object_))
        .when(u["left"] != "", pair(relation, u["right"]))
        .otherwise(pair(F.lit(""), F.lit("")))
    )


def _rest(template: str, text: Column, shape: str) -> list[Column]:
    out = []
    while template:
        before, mark, rest = template.partition("{")
        out.append(F.lit(before))
        if mark:
            out.append(F.regexp_extract(text, shape, int(rest[0])))
        template = rest[2:] if mark else ""
    return out


def balanced_types(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units with ``card_type`` settled: a unit that could be reversed is, while the
    document has at most half as many reverse cards as plain ones so far.

    One shuffle by document and one pass over its units in order, which adds a flag to
    each row; the other columns pass through as they are. The units of a document come
    from one text, so a document is never larger than what one task read before.
    """
    made = F.col("makes_card") & (F.col("image_url") == "")
    flags = {"_may": F.col("routed") == "reverse?", "_plain": (F.col("routed") == "qa") & made, "_makes": made}
    rows = units.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}).repartition(key).sortWithinPartitions(key, "unit_pos")

    read = (key, *flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reverse, plain_ones = object(), 0, 0
        for batch in batches:
            turned = []
            for doc, *own in zip(*(batch.column(c).to_pylist() for c in read)):
                may, plain, makes = own
                if doc != at:
                    at, reverse, plain_ones = doc, 0, 0
                turned.append(may and reverse <= plain_ones // 2)
                reverse += turned[-1] and makes
                plain_ones += plain or (may and not turned[-1] and makes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turned, pa.bool_())], names=[*batch.schema.names, "_turned"])

    schema = StructType([*rows.schema.fields, StructField("_turned", BooleanType())])
    settled = F.when(F.col("routed") != "reverse?", F.col("routed")).when(F.col("_turned"), "reverse").otherwise("qa")
    return rows.mapInArrow(run, schema).withColumn("card_type", settled).drop("routed", "_turned", *flags)


def build_cards(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cards of classified units (``kind``, ``purpose``, ``unit_id``); units for which
    nothing can be asked give none. Fields of text are HTML-escaped. Planned units hand
    on their objectives, prerequisites, origin and confidence; others have no links,
    origin ``source`` and confidence 1. Code blocks are tagged for the code layout."""
    u = {c: T.text_or_empty(F.col(c)) for c in ("text", "question", "answer", "extra", "topic", "source", "kind", "image_url", "image_alt", "verbatim_kind")}
    full = lambda p: (F.btrim(p["front"]) != "") & (F.btrim(p["back"]) != "")
    units = T.once(units.withColumn("image_url", u["image_url"]), parts=F.struct(*(c.alias(n) for n, c in parts_of(u).items())))
    u |= {n: F.col(f"parts.{n}") for n in ("subject", "object", "left", "verb", "right", "items", "term")}
    deferred = (u["question"] != "") & (u["answer"] != "") & must_defer(u["answer"], u["items"])
    routed = T.once(units, routed=route(u), deferred=deferred).where("not deferred").drop("deferred")
    may = F.col("routed") == "reverse?"
    asked = T.once(routed, plain=prompt(u, F.when(may, F.lit("qa")).otherwise(F.col("routed"))), turned=F.when(may, prompt(u, F.lit("reverse"))))
    makes = full(F.col("plain")) | F.coalesce(full(F.col("turned")), F.lit(False))
    settled = balanced_types(asked.withColumn("makes_card", makes), key)
    chosen = F.when((F.col("card_type") == "reverse") & F.col("turned").isNotNull(), F.col("turned")).otherwise(F.col("plain"))
    asked = T.once(settled.drop("makes_card"), asked=chosen).where(full(F.col("asked")))
    front, back = T.escape_html(F.col("asked.front")), T.escape_html(F.col("asked.back"))
    alt = F.when(u["image_url"] != "", T.normal_alt(u["image_alt"])).otherwise("")
    image = F.concat(F.lit('<br><img src="'), T.escape_html(u["image_url"]), F.lit('" alt="'), T.escape_html(alt), F.lit('">'))
    items = F.when(F.size("group_components") > 0, F.col("group_components")).when(F.col("card_type") == "list", u["items"]).otherwise(T.enumerated_items(F.col("asked.back")))
    stated = F.when((u["question"] != "") & (u["answer"] != ""), F.when(F.btrim(u["answer"]).rlike("[.!?]$"), F.btrim(u["answer"])).otherwise(F.concat(F.btrim(u["answer"]), F.lit(".")))).otherwise(F.btrim(u["text"]))
    own = F.regexp_replace(F.btrim(u["extra"]), r"(?i)^Explanation:\s*", "")
    links = {n: F.coalesce(n, F.array().cast("array<string>")) if n in asked.columns else F.array().cast("array<string>") for n in ("objective_ids", "prerequisite_ids")}
    code = F.when(u["verbatim_kind"] == "code", F.array(F.lit(CODE_TAG))).otherwise(F.array().cast("array<string>"))
    cards = asked.select(
        key, "unit_pos", front.alias("front"), F.when(u["image_url"] != "", F.concat(back, image)).otherwise(back).alias("back"),
        T.escape_html(F.when(own != "", own).otherwise(stated)).alias("extra"), T.escape_html(T.mnemonic(items)).alias("mnemonic"), "card_type",
        F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), code, F.array(T.slug(u["topic"]), F.lit("auto")))).alias("tags"),
        u["image_url"].alias("image_url"), alt.alias("image_alt"), "topic", "source", F.col("unit_id").alias("knowledge_unit_id"), F.col("kind").alias("knowledge_kind"), F.col("purpose").alias("learning_purpose"),
        *(c.alias(n) for n, c in links.items()), (F.col("origin") if "origin" in asked.columns else F.lit("source")).alias("origin"), (F.col("confidence") if "confidence" in asked.columns else F.lit(1.0)).alias("confidence"),
    )
    background = F.concat(T.escape_html("topic"), F.lit(" background is assumed; review "), T.escape_html("source"), F.lit(" if unfamiliar."))
    context = F.when(T.needs_context(F.col("front"), F.col("back")), background).otherwise(F.concat(F.lit("Topic: "), T.escape_html("topic"), F.lit(".")))
    return cards.withColumn("context", context).withColumn("card_id", T.stable_card_id(F.col("front"), F.col("back"), F.col("source")))


def classify_units(units: DataFrame) -> DataFrame:
    """Parsed units with kind, purpose and a stable unit_id; verbatim ones are facts."""
    made = T.classify(F.col("text"), F.col("question"))
    fact = F.struct(F.lit("fact").alias("kind"), F.lit("recall").alias("purpose"))
    label = F.when(F.col("verbatim_kind") != "", fact).otherwise(made)
    return units.withColumn("label", label).withColumn("kind", F.col("label.kind")).withColumn("purpose", F.col("label.purpose")).drop("label").withColumn("unit_id", T.stable_id("unit", F.col("text"), F.col("question"), F.col("answer"), F.col("source")))
