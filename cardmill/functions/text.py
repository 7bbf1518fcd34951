"""Scalar functions on card text as Column expressions; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import vocabulary as V


def any_word(words: tuple[str, ...] | list[str]) -> str:
    """A pattern for any of the words, whole."""
    return r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b"


VERB = f"(?i){any_word(V.RELATION_VERBS)}"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(f"({V.WORD})"), F.lit(1))


def unescape_html(col: Column) -> Column:
    """The five characters of ``escape_html`` and the hard space; ``&amp;`` last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def escape_html(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def without_verbatim(col: Column) -> Column:
    return F.regexp_replace(col, V.VERBATIM, " ")


def plain(col: Column) -> Column:
    """Without inline code and formulas, cloze marks and tags; entities decoded."""
    bare = F.regexp_replace(without_verbatim(col), V.CLOZE, "$1")
    return unescape_html(F.regexp_replace(bare, "<[^>]+>", " "))


def word_count(col: Column) -> Column:
    return F.size(words(plain(col)))


def has_cloze(col: Column) -> Column:
    return without_verbatim(col).rlike(V.CLOZE)


def slug(col: Column, default: str = "general") -> Column:
    made = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def parse_tags(col: Column) -> Column:
    parts = F.filter(F.split(col, r"[,\s]+"), lambda t: t != "")
    return F.transform(parts, lambda t: slug(t))


def semantic_tokens(col: Column) -> Column:
    """Distinct lower-case words over two characters without stopwords."""
    kept = F.filter(F.transform(words(col), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*V.STOPWORDS))
    return F.array_distinct(kept)


def delimited_pair(col: Column) -> Column:
    """struct(left, right) around `` :: `` or else a tab; null unless both have text."""

    def around(separator: str) -> Column:
        parts = F.split(col, separator, 2)
        left, right = F.btrim(parts[0]), F.btrim(F.element_at(parts, -1))
        return F.when(F.size(parts) == 2, F.when((left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right"))))

    return F.coalesce(around(" :: "), around("\t"))


def hide_verbatim(col: Column) -> Column:
    """A text whose verbatim spans have stand-ins for the signs that part lists."""
    runs = F.regexp_extract_all(col, F.lit(f"({V.VERBATIM}|[^`\"$\\\\]+|[`\"$\\\\])"), F.lit(1))
    hidden = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^(?:{V.VERBATIM})$"), F.translate(r, ",; ", "\x01\x02\x03")).otherwise(r)), "")
    return F.when(col.rlike(V.VERBATIM), hidden).otherwise(col)


def list_items(col: Column) -> Column:
    """Items of an enumeration; an empty array unless there are two or more and none is
    longer than the limit. Commas in numbers and signs in verbatim spans part nothing."""
    safe = F.regexp_replace(hide_verbatim(col), r"(?<=\d),(?=\d{3}\b)", "\x01")
    by_comma = F.split(F.regexp_replace(safe, r"(?i),?\s+(?:and|or)\s+", ", "), ",")
    parts = F.when(safe.contains(";"), F.split(safe, ";")).otherwise(by_comma)
    items = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")
    items = F.transform(items, lambda p: F.translate(p, "\x01\x02\x03", ",; "))
    sound = col.rlike("[,;]") & (F.size(items) >= 2) & ~F.exists(items, lambda p: word_count(p) > V.MAX_LIST_ITEM_WORDS)
    return F.when(sound, items).otherwise(F.array().cast("array<string>"))


def sequence_items(col: Column) -> Column:
    """Items of an ordered sequence such as ``shifted from a to b, c``."""
    bare = F.btrim(col, F.lit(" ."))
    prefix = F.regexp_extract(bare, r"(?i)^(.+?\bfrom )(.+)$", 1)
    body = F.regexp_extract(bare, r"(?i)^(.+?\bfrom )(.+)$", 2)
    cue = prefix.rlike(r"(?i)\b(?:" + "|".join(V.SEQUENCE_CUES) + r")(?:ed|s|es|ing)?\b")
    first_to = F.regexp_replace(body, r"(?i)^(.*?)\s+to\s+(.*)$", "$1, $2")
    arrows = F.filter(F.transform(F.split(first_to, "->"), lambda p: F.btrim(p, F.lit(" ."))), lambda p: p != "")
    items = F.when(first_to.contains("->"), arrows).otherwise(list_items(first_to))
    return F.when(cue & F.size(items).between(3, V.MAX_LIST_ITEMS), items).otherwise(F.array().cast("array<string>"))


#: A subject and, up to three words on, a verb in the past.
PAST_CLAUSE = r"^(?:[A-Z][A-Za-z-]+|[a-z]+s|[Tt]he\s+\w+|[Aa]n?\s+\w+)\s+(?:\w+\s+){0,3}(?:\w+ed|laid|made|became|appeared)\b"


def looks_like_clause(col: Column) -> Column:
    first = F.rtrim(F.lower(F.regexp_extract(col, r"^\s*(\S+)", 1)), F.lit(","))
    return (
        first.isin(*V.SUBORDINATORS)
        | col.rlike(r"[a-z]{3,}\.\s+[\"']?[A-Z]")
        | col.rlike(f"(?i){any_word(V.CLAUSE_MARKERS)}")
        | F.btrim(col).rlike(PAST_CLAUSE)
    )


def answer_items(col: Column) -> Column:
    """Three to eight parallel items of an authored answer, or an empty array."""
    items = list_items(col)
    parallel = F.size(items).between(3, V.MAX_LIST_ITEMS) & (F.size(F.filter(items, looks_like_clause)) < 2)
    ordered = sequence_items(col)
    return F.when(F.size(ordered) > 0, ordered).when(parallel, items).otherwise(F.array().cast("array<string>"))


def enumerated_items(col: Column) -> Column:
    """Members of a short enumeration without clauses or verbs."""
    return members_of(plain(col))


def members_of(text: Column) -> Column:
    """``enumerated_items`` of a text that is plain already."""
    bare = F.btrim(text, F.lit(" ."))
    items = list_items(bare)
    clausal = bare.rlike(f"(?i){any_word(V.NO_ENUMERATION_WORDS)}") | F.exists(items, lambda p: p.rlike(VERB))
    return F.when(~clausal, items).otherwise(F.array().cast("array<string>"))


def initials(items: Column) -> Column:
    def first(item: Column) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(item, "[A-Za-z0-9]", 0), F.lit("")), F.lit("X"))

    return F.upper(F.array_join(F.transform(items, first), ""))


def mnemonic(items: Column) -> Column:
    return F.when(F.size(items) >= 3, F.concat(initials(items), F.lit(": "), F.array_join(items, ", "))).otherwise("")


def component_estimate(col: Column) -> Column:
    return components_of(plain(col))


def components_of(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", "\x01")
    parts = F.filter(F.split(bare, "[,;]"), lambda p: F.btrim(p) != "")
    return F.greatest(F.size(parts), F.lit(1))


def looks_compound(col: Column) -> Column:
    return compound_of(plain(col))


def compound_of(text: Column) -> Column:
    parts = F.split(text, r"(?i);|\s+(?:and|but|whereas|while)\s+")
    return (F.size(parts) > 1) & (F.size(F.filter(parts, lambda p: p.rlike(VERB))) > 1)


def alt_explains(col: Column) -> Column:
    return (word_count(col) >= 6) & col.rlike(f"(?i){any_word((*V.RECALL_WORDS, 'relationship', 'spatial'))}")


def normal_alt(col: Column) -> Column:
    """Image text with the fixed clause on recall appended, unless it speaks of recall."""
    bare = F.btrim(col)
    speaks = bare.rlike(f"(?i){any_word((*V.RECALL_WORDS, 'shows why'))}")
    added = F.concat(bare, F.lit("; this visual cue anchors the relationship tested by the card."))
    return F.when((bare == "") | speaks, bare).otherwise(added)


def is_generic(col: Column) -> Column:
    return generic_of(plain(col))


def generic_of(text: Column) -> Column:
    return F.btrim(text).rlike("^(?:" + "|".join(V.GENERIC_STEMS) + ")")


def needs_context(*cols: Column) -> Column:
    text = F.concat_ws(" ", *cols)
    return text.rlike(V.ACRONYM) | text.rlike(f"(?i){any_word(V.TECHNICAL_WORDS)}") | text.rlike(V.LETTERS_DIGITS)


def step_is_long(step: Column) -> Column:
    """Whether a learning step lasts a day or more, or can't be read."""
    low = F.lower(F.btrim(step))
    amount, unit = F.regexp_extract(low, r"^(\d+)([mhd])$", 1), F.regexp_extract(low, r"^(\d+)([mhd])$", 2)
    return (unit == "") | (unit == "d") | ((unit == "h") & (F.coalesce(amount.try_cast("bigint"), F.lit(0)) >= 24))


def stable_id(prefix: str, *cols: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x00", *(text_or_empty(c) for c in cols)), 256), 1, 12))


def stable_card_id(*cols: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *(text_or_empty(c) for c in cols)), 256), 1, 16)


def package_id(name: Column) -> Column:
    """A stable 31-bit id of a deck or layout name."""
    return F.lit(1 << 30) + F.crc32(name) % F.lit(1 << 30)


def compact(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col), r"\s+", " "))


def definition_term(question: Column) -> Column:
    """The term a question asks to define; empty if it asks for none."""
    asked = F.btrim(question)
    shapes = (r"(?i)^What is\s+(.+?)\??$", r"(?i)^Define\s+(.+?)\.?$", r"(?i)^What does\s+(.+?)\s+mean\??$")
    term = F.coalesce(*(F.nullif(F.btrim(F.regexp_extract(asked, s, 1), F.lit(" .?")), F.lit("")) for s in shapes), F.lit(""))
    return F.when(term.rlike(r"(?i)^(?:answer\s+)?component\b"), "").otherwise(term)


def split_sentences(col: Column) -> Column:
    """Sentences: blanks between ``.!?`` and an upper-case letter or digit, but not
    after an abbreviation or a single letter."""
    kept = "|".join(a.replace(".", r"\.") for a in V.ABBREVIATIONS)
    boundary = rf"(?<=[.!?])(?<!(?<!\S)(?i:{kept}|[a-z])[.!?])\s+(?=[A-Z0-9])"
    return F.filter(F.transform(F.split(col, boundary), lambda s: F.btrim(s)), lambda s: s != "")


def independent_clauses(col: Column) -> Column:
    """Clauses that stand alone: around ``;`` or one ``and``, each with a verb."""
    whole = F.array(F.btrim(col))
    tidy = lambda p: F.btrim(p, F.lit(" ."))
    semis = F.filter(F.transform(F.split(col, ";"), tidy), lambda p: p != "")
    ands = F.split(col, r"(?i)\s+and\s+")
    by_semi = (F.size(semis) > 1) & F.forall(semis, lambda p: p.rlike(VERB))
    by_and = (F.size(ands) == 2) & F.forall(ands, lambda p: p.rlike(VERB) & (word_count(p) >= 3))
    closed = lambda p: F.concat(tidy(p), F.lit("."))
    return (
        F.when(col.rlike(f"(?i){any_word(V.NO_SPLIT_WORDS)}"), whole)
        .when(by_semi, F.transform(semis, closed))
        .when(by_and, F.transform(ands, closed))
        .otherwise(whole)
    )


def classify(text: Column, question: Column | None = None) -> Column:
    """struct(kind, purpose): the first kind whose cues or shape hold."""
    value = F.btrim(F.concat_ws(" ", question if question is not None else F.lit(""), text_or_empty(text)))
    low = F.lower(value)
    found = None
    for kind, purpose in V.KIND_ORDER:
        test = low.rlike(any_word(V.KIND_CUES[kind]))
        if kind == "formula":
            test = test | value.rlike(V.FORMULA_PATTERN)
        elif kind == "definition":
            test = test | value.rlike(V.DEFINITION_SHAPE)
        label = F.struct(F.lit(kind).alias("kind"), F.lit(purpose).alias("purpose"))
        found = F.when(test, label) if found is None else found.when(test, label)
    return found.otherwise(F.struct(F.lit("fact").alias("kind"), F.lit("recall").alias("purpose")))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once. Filters on a generated column
    stay behind it, so long expressions aren't repeated in them."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.inline(F.array(made)))
