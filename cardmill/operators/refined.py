"""Refined cards on their way to notes: links of images, fields passed through, notes
matched with what a service says of them, and candidates that stand the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.operators import card_rules as R
from cardmill.operators import cards as C
from cardmill.operators import units as U
from cardmill.sources.tables import BLANKS

#: Card columns that may be copied into fields of the same meaning as they are.
PASSED = {"CardType": "card_type", "ImageURL": "image_url", "ImageAlt": "image_alt", "Back": "back"}


def image_kind(url: Column) -> Column:
    """none, remote, bad_scheme (another scheme than http or https, or no host), absolute,
    outside (leaves its folder) or local; null and blank links are none."""
    bare = F.btrim(T.text_or_empty(url), F.lit(BLANKS))
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    steps = F.filter(F.split(bare, "/"), lambda s: (s != "") & (s != "."))
    # the least depth on the way: a step up takes one away
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: _deeper(a, F.when(s == "..", -1).otherwise(1)))
    return (
        F.when(bare == "", "none").when((scheme != "") | (host != ""), F.when(scheme.isin("http", "https") & (host != ""), "remote").otherwise("bad_scheme"))
        .when(bare.startswith("/"), "absolute").when(depth["least"] < 0, "outside").otherwise("local")
    )


def _deeper(acc: Column, step: Column) -> Column:
    at = acc["at"] + step
    return F.struct(at.alias("at"), F.least(acc["least"], at).alias("least"))


def media_names(cards: DataFrame) -> DataFrame:
    """(path, name) of local images, each once; the name is the last part of the path."""
    path = F.btrim(F.col("image_url"), F.lit(BLANKS))
    return cards.where(image_kind(F.col("image_url")) == "local").select(path.alias("path"), F.regexp_extract(path, r"([^/]+)/?$", 1).alias("name")).distinct()


def passed_through(notes: DataFrame, cards: DataFrame, layout_fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Notes (id, layout, fields map) with card columns of PASSED copied, HTML-escaped,
    into fields that the layout has and the note hasn't set. Notes without a card stay as
    they are; of several cards of one id the greatest values count. Local images go by name."""
    name = F.when(image_kind(F.col("image_url")) == "local", F.regexp_extract(F.btrim("image_url"), r"([^/]+)/?$", 1)).otherwise(F.btrim(T.text_or_empty(F.col("image_url"))))
    own = cards.withColumn("image_url", name).groupBy(F.col("card_id").alias("id")).agg(*(F.max(T.text_or_empty(F.col(c))).alias(c) for c in PASSED.values()))
    known = F.create_map(*(x for layout, fields in layout_fields.items() for x in (F.lit(layout), F.array(*map(F.lit, fields)))))
    may = F.coalesce(F.try_element_at(known, F.col("layout")), F.array().cast("array<string>"))
    given = F.create_map(*(x for field, column in PASSED.items() for x in (F.lit(field), T.escape_html(F.col(column)))))
    new = F.map_filter(given, lambda k, v: v.isNotNull() & F.array_contains(may, k) & ~F.map_contains_key("fields", k))
    joined = notes.join(own, "id", "left")
    return joined.select(*(F.when(F.col("card_type").isNull(), F.col("fields")).otherwise(F.map_concat("fields", new)).alias("fields") if c == "fields" else F.col(c) for c in notes.columns))


def matched_infos(notes: DataFrame, infos: DataFrame) -> DataFrame:
    """(note_pos, id, note_id, verified): notes with what a service said of them at the
    same position. ``verified`` is false where the answer is missing or names another note."""
    said = infos.select("note_pos", "note_id", F.col("id").alias("said"))
    return notes.join(said, "note_pos", "left").select("note_pos", "id", "note_id", (F.col("said").eqNullSafe(F.col("id")) & F.col("note_id").isNotNull()).alias("verified"))


def supports(answer: Column, evidence: Column) -> Column:
    """Whether an answer stands in the evidence, spaces and case aside, and has at least
    two words of three and more characters. Null counts as empty."""
    said, hay = F.rtrim(T.compact(T.text_or_empty(answer)), F.lit(".")), T.compact(T.text_or_empty(evidence))
    words = F.filter(F.regexp_extract_all(said, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    return F.contains(hay, said) & (F.size(words) >= 2)


def valid_candidates(rows: DataFrame, key: str = "candidate") -> DataFrame:
    """(key, n_cards): candidates (front, back, extra, tags) that give at least one card
    when read again as study text, and no card that breaks a rule of level error. Nulls
    count as empty; null keys are left out. The key must not be ``card_id``, which cards have."""
    one_line = lambda c: F.regexp_replace(T.text_or_empty(F.col(c)), r"\s+", " ")
    block = F.concat(F.lit(f"## {C.CANDIDATES}\n\nQ: "), one_line("front"), F.lit("\nA: "), one_line("back"), F.lit("\nExtra: "), one_line("extra"), F.lit("\nTags: "), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))
    texts = rows.where(F.col(key).isNotNull()).select(key, block.alias("text"), F.lit("candidate").alias("source_name"))
    made = C.build_cards(C.classify_units(U.parse_units(texts, key)), key)
    found = [F.coalesce(bad, F.lit(False)) for _, level, bad, _ in R.card_rules() if level == "error"]
    wrong = T.once(R.measured(made), wrong=F.exists(F.array(*found), lambda x: x))
    return wrong.groupBy(key).agg(F.count("*").alias("n_cards"), F.bool_or("wrong").alias("any_wrong")).where("not any_wrong").drop("any_wrong")
