"""Facts to notes: fields of a target layout from templates or default builders.

Templates are compiled on the driver to one concatenation of literals and
columns, so a value is never searched for placeholders itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardmill.functions import text as T
from cardmill.functions import vocabulary as V

#: layout of each fact type where none is configured
DEFAULT_LAYOUTS = {"qa": "Basic", "cloze": "Cloze", "list": "List", "typed": "Typed", "image_occlusion": "Image Occlusion"}
CODE_LAYOUT, CODE_TAG = "Code", "verbatim-code"
CONTENT_SCHEMA = (
    "front string, back string, text string, title string, items array<string>, prompt string, answer string, hints array<string>, image string, "
    "masks array<struct<shape:string,left:double,top:double,width:double,height:double,rx:double,ry:double,points:array<array<double>>,card:int>>, "
    "header string, back_extra string, comments string, occlude_inactive boolean, extra string, context string, mnemonic string, topic string"
)
_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


class LayoutError(ValueError):
    """A configured layout can't be filled."""


def check_mappings(mappings: dict) -> dict:
    """``{type: {layout: {field: template}}}`` or LayoutError."""
    for kind, layouts in mappings.items():
        if kind not in V.FACT_TYPES:
            raise LayoutError(f"unknown fact type {kind!r}")
        if not isinstance(layouts, dict) or not layouts:
            raise LayoutError(f"{kind!r} names no layout")
        for name, fields in layouts.items():
            if not str(name).strip() or not isinstance(fields, dict) or not fields or not all(isinstance(t, str) for t in fields.values()):
                raise LayoutError(f"layout {name!r} of {kind!r} needs fields with text templates")
    return mappings


def chosen_layout(kind: str, mappings: dict, targets: dict[str, str]) -> str:
    """The configured target, else the only mapped layout, else the default."""
    mapped = mappings.get(kind, {})
    if kind in targets:
        return targets[kind]
    if len(mapped) > 1:
        raise LayoutError(f"{kind!r} has several layouts and no target: {', '.join(sorted(mapped))}")
    return next(iter(mapped), DEFAULT_LAYOUTS[kind])


def _escaped(name: str) -> Column:
    return T.escape_html(T.text_or_empty(F.col(name)))


def list_html() -> Column:
    item = lambda x, i: F.concat(F.lit("<li>{{c"), (i + 1).cast("string"), F.lit("::"), T.escape_html(x), F.lit("}}</li>"))
    return F.concat(F.lit('<ol class="list">'), F.array_join(F.transform("c.items", item), ""), F.lit("</ol>"))


def confusions_html() -> Column:
    """Wrong answers, the nearest first."""
    def of(grade: str) -> Column:
        own = F.filter("distractors", lambda d: d["grade"] == grade)
        return F.transform(own, lambda d: F.concat(F.lit(f'<li class="{grade}">'), T.escape_html(d["text"]), F.lit("</li>")))

    by_grade = [of(grade) for grade in reversed(V.DISTRACTOR_GRADES)]
    items = F.array_join(F.concat(*by_grade), "")
    return F.when(F.size("distractors") > 0, F.concat(F.lit('<div class="confusions"><div class="label">Common confusions</div><ul>'), items, F.lit("</ul></div>"))).otherwise("")


def _short(number: Column) -> Column:
    """Six significant digits without trailing zeros, for numbers from 0 to 1."""
    fixed = F.format_string("%.6f", number)
    return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def occlusion_html() -> Column:
    suffix = F.when(F.coalesce("c.occlude_inactive", F.lit(True)), ":oi=1").otherwise("")

    def mask(m: Column, i: Column) -> Column:
        part = lambda name: F.concat(F.lit(f":{name}="), _short(m[name]))
        points = F.array_join(F.transform(m["points"], lambda p: F.concat(_short(p[0]), F.lit(","), _short(p[1]))), " ")
        shape = (
            F.when(m["shape"] == "polygon", F.concat(part("left"), part("top"), F.lit(":points="), points))
            .when(m["shape"] == "rect", F.concat(*map(part, ("left", "top", "width", "height"))))
            .otherwise(F.concat(*map(part, ("left", "top", "rx", "ry"))))
        )
        return F.concat(F.lit("{{c"), F.coalesce(m["card"], i + 1).cast("string"), F.lit("::image-occlusion:"), m["shape"], shape, suffix, F.lit("}}<br>"))

    return F.array_join(F.transform("c.masks", mask), "")


def _hint(n: int) -> Column:
    return T.escape_html(F.coalesce(F.get("c.hints", F.lit(n)), F.lit("")))


def default_fields(kind: str, code: bool = False) -> dict[str, Column]:
    source = {"Source": _escaped("source")}
    if code:
        return {"Front": _escaped("c.front"), "Code": _escaped("c.back"), "Extra": _escaped("c.extra")} | source
    return {
        "qa": {"Front": _escaped("c.front"), "Back": _escaped("c.back"), "Distractors": confusions_html()} | source,
        "cloze": {"Text": _escaped("c.text"), "Extra": _escaped("c.extra"), "Distractors": confusions_html()} | source,
        "list": {"Title": _escaped("c.title"), "Text": list_html()} | source,
        "typed": {"Prompt": _escaped("c.prompt"), "Answer": _escaped("c.answer"), "Hint 1": _hint(0), "Hint 2": _hint(1), "Hint 3": _hint(2), "Extra": _escaped("c.extra")} | source,
        "image_occlusion": {"Occlusion": occlusion_html(), "Image": F.concat(F.lit('<img src="'), T.escape_html(F.regexp_extract("c.image", r"[^/]*$", 0)), F.lit('">')), "Header": _escaped("c.header"), "Back Extra": _escaped("c.back_extra"), "Comments": _escaped("c.comments")},
    }[kind]


def placeholders(kind: str) -> dict[str, Column]:
    common = {n: _escaped(n) for n in ("source", "deck", "knowledge_unit_id", "knowledge_kind", "origin")}
    common |= {"fact_id": _escaped("id"), "tags": T.escape_html(F.array_join("tags", " ")), "objective_ids": T.escape_html(F.array_join("objective_ids", " ")), "prerequisite_ids": T.escape_html(F.array_join("prerequisite_ids", " ")), "confidence": T.text_or_empty(F.col("confidence").cast("string"))}
    own = {"qa": ("front", "back"), "cloze": ("text",), "list": ("title",), "typed": ("prompt", "answer"), "image_occlusion": ("header", "back_extra", "comments")}[kind]
    common |= {n: _escaped(f"c.{n}") for n in own}
    if kind == "image_occlusion":
        return common | {"image": default_fields(kind)["Image"], "occlusion": occlusion_html()}
    common |= {n: _escaped(f"c.{n}") for n in ("extra", "context", "mnemonic", "topic")}
    if kind in ("qa", "cloze"):
        common["distractors"] = confusions_html()
    if kind == "list":
        common["items"] = list_html()
    if kind == "typed":
        common["hints"] = F.array_join(F.transform(F.coalesce("c.hints", F.array().cast("array<string>")), T.escape_html), "<br>")
    return common


def compile_template(template: str, values: dict[str, Column]) -> Column:
    unknown = sorted(set(_PLACEHOLDER.findall(template)) - set(values))
    if unknown:
        raise LayoutError(f"unknown placeholders: {', '.join(unknown)}")
    parts = [values[p] if n % 2 else F.lit(p) for n, p in enumerate(_PLACEHOLDER.split(template))]
    return F.concat(*parts)


def notes(facts: DataFrame, mappings: dict | None = None, targets: dict[str, str] | None = None) -> DataFrame:
    """(id, layout, deck, fields map, tags) of sound facts. Facts with faults are left out."""
    mappings, targets = check_mappings(mappings or {}), targets or {}
    ready = facts.where("size(faults) = 0").withColumn("c", F.from_json("content", CONTENT_SCHEMA))
    layout = fields = None
    as_map = lambda made: F.create_map(*(x for name, col in made.items() for x in (F.lit(name), col)))
    for kind in V.FACT_TYPES:
        name = chosen_layout(kind, mappings, targets)
        if name == DEFAULT_LAYOUTS[kind]:
            own = as_map(default_fields(kind))
        elif kind == "qa" and name == CODE_LAYOUT:
            own = as_map(default_fields(kind, code=True))
        elif name in mappings.get(kind, {}):
            values = placeholders(kind)
            own = as_map({f: compile_template(t, values) for f, t in mappings[kind][name].items()})
        else:
            raise LayoutError(f"no fields for layout {name!r} of {kind!r}")
        shown = F.lit(name)
        if kind == "qa" and name == DEFAULT_LAYOUTS["qa"]:
            code = F.array_contains("tags", CODE_TAG)
            shown, own = F.when(code, CODE_LAYOUT).otherwise(name), F.when(code, as_map(default_fields("qa", code=True))).otherwise(own)
        is_kind = F.col("type") == kind
        layout = F.when(is_kind, shown) if layout is None else layout.when(is_kind, shown)
        fields = F.when(is_kind, own) if fields is None else fields.when(is_kind, own)
    return ready.select("id", layout.alias("layout"), "deck", fields.alias("fields"), "tags")


def missing_layouts(made: DataFrame, installed: list[str]) -> list[str]:
    """Layouts that notes need and the target lacks, sorted; a few names."""
    return sorted(r.layout for r in made.select("layout").distinct().collect() if r.layout not in set(installed))


def name_clashes(media: DataFrame) -> DataFrame:
    """Media names that stand for several paths: (name, n_paths)."""
    return media.groupBy("name").agg(F.count_distinct("path").alias("n_paths")).where("n_paths > 1")
