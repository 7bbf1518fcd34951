"""From study texts to ordered atomic units, one document at a time.

Reading a text is a fold over its lines (open fences, objective blocks, waiting
images, look-ahead after a question) that no expression states well, so each
document is read in Python on Arrow batches. Documents are independent: the
stage is narrow, and no text is shuffled.

A text is first cut into blocks, and each block then gives units. Unit positions
are the order in the text; every unit cites the line its block starts on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.functions import vocabulary as V
from cardmill.sources.tables import spread

_words = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_verbatim, _cloze = re.compile(V.VERBATIM), re.compile(V.CLOZE)
_any = lambda words: r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"
VERB = re.compile(_any(V.RELATION_VERBS), re.I)
_NO_SPLIT = re.compile(_any(V.NO_SPLIT_WORDS), re.I)

#: Shapes of lines, in the order they are tried after fences and formulas.
LINE_SHAPES = {
    "heading": re.compile(r"^#{1,6}\s+(.+?)\s*$"),
    "topic": re.compile(r"^Topic:\s*(.+)$", re.I),
    "objectives": re.compile(r"^(?:learning\s+)?objectives?\s*:\s*$", re.I),
    "objective": re.compile(r"^(?:learning\s+)?objectives?\s*:\s*(.+)$", re.I),
    "outcome": re.compile(r"^(?:by the end of (?:this )?(?:lesson|lecture|chapter),?\s*(?:students?|learners?|you) (?:should be able to|will be able to|can)|(?:students?|learners?|you) (?:should be able to|will be able to))\s+(.+)$", re.I),
    "image": re.compile(r"^\[image:\s*([^|\]]+)\|\s*alt:\s*([^\]]+)\]$", re.I),
    "picture": re.compile(r"^!\[([^]]*)\]\(([^)\s]+)(?:\s+['\"][^'\"]*['\"])?\)$"),
    "question": re.compile(r"^Q(?:uestion)?:\s*(.+)$", re.I),
}
#: Shapes of lines beside them, and of statements and questions.
_ATTRIBUTES = {"answer": re.compile(r"^A(?:nswer)?:\s*(.+)$", re.I), "extra": re.compile(r"^Extra:\s*(.+)$", re.I), "tags": re.compile(r"^Tags?:\s*(.+)$", re.I)}
_BULLET = re.compile(r"^\s*(?:[-*+] |\d+[.)]\s+)(.+)$")
_CAN = re.compile(r"^(?:students?|learners?|you) can\s+(.+)$", re.I)
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})(?:\s*([^\s`~]+))?\s*$")
_STARTER = re.compile("^(?:" + "|".join(V.PARAGRAPH_STARTERS) + r")\b", re.I)
_ENDS_FORMULA = re.compile(r"(?:[A-Za-z][A-Za-z0-9_]*|\d+)\s*=\s*[^=]+$")
_LIST_STATEMENT = re.compile(r"^(?P<whole>.+?)\s+(?P<verb>includes?|contains?|consists of|has|has three|has four)\s+(?P<members>.+?)[.!?]?$", re.I)
_ASKED = re.compile(r"(?:(?:What are the components of|Which items make up)\s+)?(?:What are (?:the )?)?(?P<whole>.*?)(?:\s+named in the handout)?[ ?]*\Z", re.I | re.S)


@dataclass
class Unit:
    text: str
    topic: str
    line: int
    question: str = ""
    answer: str = ""
    extra: str = ""
    tags: list[str] = field(default_factory=list)
    image_url: str = ""
    image_alt: str = ""
    components: list[str] = field(default_factory=list)
    verbatim_kind: str = ""
    verbatim_language: str = ""


@dataclass
class Block:
    kind: str
    line: int
    first: str = ""
    second: str = ""
    extra: str = ""
    tags: list[str] = field(default_factory=list)


#: What may part a text, by name. Commas in numbers are no signs.
SIGNS = {"stop": r"(?<=[.!?])\s+(?=[A-Z0-9])", "semicolon": ";", "joint": r",?\s+(?i:and|or)\s+", "comma": r",(?!(?<=\d,)\d{3}\b)", "and": r"\s+(?i:and)\s+"}


@lru_cache
def _signs(*names: str) -> re.Pattern:
    return re.compile(f"{V.VERBATIM}|" + "|".join(f"(?P<{n}>{SIGNS[n]})" for n in names))


def parted(text: str, *names: str, unless: Callable[[str], bool] = lambda before: False) -> list[str]:
    """The texts between the named signs. Signs in verbatim spans, and those after a
    text that ``unless`` holds for, part nothing."""
    out, start = [], 0
    for sign in _signs(*names).finditer(text):
        if sign.lastgroup and not unless(text[: sign.start()]):
            out.append(text[start : sign.start()])
            start = sign.end()
    return [*out, text[start:]]


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "general"


def word_count(text: str) -> int:
    import html

    bare = _cloze.sub(r"\1", _verbatim.sub(" ", text))
    return len(_words.findall(html.unescape(re.sub(r"<[^>]+>", " ", bare))))


def _abbreviated(before: str) -> bool:
    """Whether a text ends in an abbreviation or a single letter, with its full stop."""
    last = before.rsplit(None, 1)[-1].rstrip(".!?").lower()
    return last in V.ABBREVIATIONS or (len(last) == 1 and "a" <= last <= "z")


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, parted(text, "stop", unless=_abbreviated)) if s]


def list_items(text: str) -> list[str]:
    """Items around semicolons, else around commas and conjunctions: at least two, all short."""
    if "," not in text and ";" not in text:
        return []
    found = parted(text, "semicolon")
    if len(found) == 1:
        found = parted(text, "joint", "comma")
    items = [item for item in (part.strip(" .") for part in found) if item]
    short = all(word_count(item) <= V.MAX_LIST_ITEM_WORDS for item in items)
    return items if short and len(items) > 1 else []


def clauses(text: str) -> list[str]:
    """Clauses that stand alone: around semicolons, else around the only "and", where
    each has a verb; the whole text otherwise."""
    told = lambda part: VERB.search(_verbatim.sub(" ", part)) is not None
    found: list[str] = []
    if not _NO_SPLIT.search(_verbatim.sub(" ", text)):
        found = [part for part in parted(text, "semicolon") if part.strip(" .")]
        if len(found) < 2 or not all(map(told, found)):
            found = parted(text, "and")
            if len(found) != 2 or not all(told(part) and word_count(part) > 2 for part in found):
                found = []
    return [part.strip(" .") + "." for part in found] or [text.strip()]


#: A paragraph ends between two lines if the first ends and the second begins like one of these pairs.
_BREAKS = ((_ENDS_FORMULA, re.compile("")), (re.compile(r"[.!?]\s*\Z"), re.compile("[A-Z0-9]")), (re.compile(""), _STARTER))


def breaks_paragraph(before: str, line: str) -> bool:
    return any(end.search(before) and begin.match(line) for end, begin in _BREAKS)


def blocks(text: str) -> Iterator[Block]:
    """Blocks of a text in order. A prose block holds the lines of one paragraph."""
    lines = text.splitlines()
    prose: list[str] = []
    prose_at, at, in_objectives = 0, 0, False

    def paragraph() -> Iterator[Block]:
        nonlocal prose
        if prose:
            yield Block("prose", prose_at, " ".join(prose))
        prose = []

    def closing(test, start: int) -> int | None:
        return next((k for k in range(start, len(lines)) if test(lines[k])), None)

    while at < len(lines):
        raw, line, number = lines[at], lines[at].strip(), at + 1
        fence = _FENCE.match(raw)
        one_line = len(line) > 4 and line.startswith("$$") and line.endswith("$$")
        if fence or one_line or line == "$$":
            yield from paragraph()
            if one_line:
                yield Block("math", number, line)
                at += 1
                continue
            mark = fence[1] if fence else ""
            shut = re.compile(rf"\s*{re.escape(mark[0])}{{{len(mark)},}}\s*\Z").match if fence else (lambda x: x.strip() == "$$")
            end = closing(shut, at + 1)
            stop = len(lines) if end is None else end
            body = lines[at + 1 : stop] if fence else lines[at : stop + 1]
            kind = ("code" if fence else "math") + ("" if end is not None else "-open")
            yield Block(kind, number, "\n".join(body), (fence[2] or "") if fence else "")
            at = stop + 1
            continue
        if not line:
            yield from paragraph()
            in_objectives = False
            at += 1
            continue
        shape, found = next(((name, m) for name, pattern in LINE_SHAPES.items() if (m := pattern.match(line))), ("", None))
        stated = shape in ("objective", "outcome") or (shape in ("", "image", "picture", "question") and in_objectives and (_BULLET.match(raw) or _CAN.match(line)))
        if stated or shape in ("heading", "topic", "objectives"):
            yield from paragraph()
            if shape in ("heading", "topic"):
                yield Block("topic", number, found[1].strip())
            in_objectives = shape == "objectives" or (in_objectives and shape != "heading")
            at += 1
            continue
        in_objectives = False
        if shape in ("image", "picture"):
            yield from paragraph()
            url, alt = (found[1], found[2]) if shape == "image" else (found[2], found[1])
            yield Block("image", number, url.strip(), alt.strip())
            at += 1
            continue
        if shape == "question":
            yield from paragraph()
            got: dict[str, str] = {}
            ahead = at + 1
            while ahead < len(lines) and lines[ahead].strip():
                named = next(((n, m[1].strip()) for n, p in _ATTRIBUTES.items() if (m := p.match(lines[ahead].strip()))), None)
                if named is None:
                    break
                got[named[0]] = named[1]
                ahead += 1
            if got.get("answer"):
                tags = [slug(t) for t in re.split(r"[,\s]+", got.get("tags", "")) if t]
                yield Block("question", number, found[1].strip(), got["answer"], got.get("extra", ""), tags)
                at = ahead
                continue
        pair = next(((a.strip(), b.strip()) for sep in (" :: ", "\t") if sep in line for a, b in [line.split(sep, 1)] if a.strip() and b.strip()), None)
        bullet = _BULLET.match(raw)
        if pair or bullet:
            yield from paragraph()
            yield Block("pair", number, *pair) if pair else Block("bullet", number, bullet[1].strip())
            at += 1
            continue
        if prose and breaks_paragraph(prose[-1], line):
            yield from paragraph()
        if not prose:
            prose_at = number
        prose.append(line)
        at += 1
    yield from paragraph()


@dataclass
class Enumeration:
    """Items, what they belong to, and the text of one item."""

    whole: str
    items: list[str]
    lead: str
    close: str = ""

    @classmethod
    def of(cls, unit: Unit) -> Enumeration | None:
        """The enumeration a unit states, or else the one its answer is."""
        stated = _LIST_STATEMENT.match(unit.answer or unit.text)
        items = list_items(stated["members"]) if stated else []
        if items:
            whole = stated["whole"].strip()
            return cls(whole, items, f"{whole} {stated['verb'].strip()} ", ".")
        items = list_items(unit.answer)
        return cls(_ASKED.match(unit.question)["whole"], items, f"{unit.question} ") if items else None

    def units(self, unit: Unit) -> Iterator[Unit]:
        for n, item in enumerate(self.items, 1):
            asked = f"What is component {n} of {len(self.items)} in {self.whole}?"
            yield replace(unit, text=self.lead + item + self.close, question=asked, answer=item, components=self.items)


def atoms(unit: Unit) -> list[Unit]:
    """A unit cut into its list components or, if it asks nothing, its clauses."""
    enumeration = Enumeration.of(unit)
    if enumeration:
        return list(enumeration.units(unit))
    parts = [] if unit.question else clauses(unit.text)
    return [replace(unit, text=part) for part in parts] if len(parts) > 1 else [unit]


def read_units(text: str) -> list[Unit]:
    """Units of a text in order. An image waits for the next unit."""
    out: list[Unit] = []
    topic, image = "General", ("", "")
    for block in blocks(text):
        if block.kind == "topic":
            topic = block.first
            continue
        if block.kind == "image":
            image = (block.first, block.second)
            continue
        base = Unit(block.first, topic, block.line, image_url=image[0], image_alt=image[1])
        if block.kind.startswith(("code", "math")):
            made = [replace(base, verbatim_kind=block.kind[:4], verbatim_language=block.second if block.kind.startswith("code") else "")]
            if block.kind.endswith("-open"):
                made = [replace(made[0], image_url="", image_alt="")]
        elif block.kind == "prose":
            made, said = [], sentences(block.first)
            for n, sentence in enumerate(said):
                made += atoms(replace(base, text=sentence) if n == 0 else replace(base, text=sentence, image_url="", image_alt=""))
        elif block.kind == "question":
            made = [replace(base, text=f"{block.first} {block.second}", question=block.first, answer=block.second, extra=block.extra, tags=block.tags)]
        elif block.kind == "pair":
            made = atoms(replace(base, text=f"{block.first} {block.second}", question=block.first, answer=block.second))
        else:
            made = atoms(base)
        if made and not block.kind.endswith("-open"):
            image = ("", "")
        out += made
    return [u for u in out if u.text.strip() or u.answer.strip()]


UNIT_FIELDS = "unit_pos int, line_no int, text string, topic string, source string, question string, answer string, extra string, tags array<string>, image_url string, image_alt string, group_components array<string>, verbatim_kind string, verbatim_language string"


def parse_units(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source_name") -> DataFrame:
    """Units of every text: the key, UNIT_FIELDS. Null, empty and blank texts give
    none; repeated rows give repeated units; a null source name reads as ``input``."""
    names = [key, *(f.split(" ")[0] for f in UNIT_FIELDS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, body, name in zip(batch[key], batch[text], batch[source]):
                for pos, u in enumerate(read_units(body) if isinstance(body, str) else []):
                    cite = f"{name if isinstance(name, str) else 'input'}:line-{u.line}"
                    rows.append((own, pos, u.line, u.text, u.topic, cite, u.question, u.answer, u.extra, u.tags, u.image_url, u.image_alt, u.components, u.verbatim_kind, u.verbatim_language))
            yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)[key]
    return spread(docs.select(key, text, source)).mapInPandas(run, f"`{key}` {kind}, {UNIT_FIELDS}")


def markdown_section(text: str, title: str) -> str:
    """The lines under a heading, up to the next of the same or a higher level."""
    lines, start, level = text.splitlines(), None, 0
    for at, line in enumerate(lines):
        found = re.match(r"^(#{1,6})\s+(.+?)\s*$", line.strip())
        if not found:
            continue
        if start is not None and len(found[1]) <= level:
            return "\n".join(lines[start:at]).strip()
        if start is None and found[2].casefold() == title.strip().casefold():
            start, level = at + 1, len(found[1])
    return "" if start is None else "\n".join(lines[start:]).strip()


def section_texts(docs: DataFrame, title: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of the named section of each text that has it."""
    cut = F.udf(lambda body: markdown_section(body, title) or None if body else None, "string", useArrow=True)
    return docs.select(key, cut(text).alias(text)).where(F.col(text).isNotNull())
