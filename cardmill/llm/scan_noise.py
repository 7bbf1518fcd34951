"""Repair of text from scanned pages.

A page's lines are told apart first: page numbers and running titles at the top
or foot, body lines in between. The body is one stream of characters, in which blanks
and line ends are signs like others. Its words are those of least total cost: a word
costs the more the rarer it is, confused characters, blanks inside words, missing
blanks and hyphens kept at line ends cost extra, and what no known word accounts for
costs most. Known words between blanks that can't be part of a longer word cost least
as they stand; the stretches between them are decoded, with the neighbours into which
a word may reach. Findings and repaired text both come from the decoded words. The
words come from the whole collection. Paragraph boundaries are those of least total
cost over the lines of a page.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize, spread, table

#: So often a word must stand on scanned pages to be in the lexicon without clean text.
LEAST_SCANNED = 3
#: Prices of a confusion, of a blank too many or missing, and of a hyphen that stays at a line end.
EDIT, BLANK, KEPT = 5.0, 6.0, 8.0
#: Tokens and stretches a worker remembers.
HELD = 500_000
PDF_PAGE = r"\sp\.\d+(?:\s*\(OCR\))?\s*$"

#: What a scanner reads, and what may have stood there.
CONFUSIONS = {
    "f": "t", "c": "e", "b": "h", "l": "i", "1": "li", "|": "li", "!": "il", "0": "o", "5": "s", "(": "c", "9": "g", "6": "b", "u": "n", "o": "a", "v": "y",
    "8": "b", "3": "e", "$": "s", "2": "z", "4": "a", "@": "a", "7": "t", "q": "g", "]": "l", "[": "l", "{": "c", "é": "e", "è": "e", "ê": "e", "ë": "e",
    "á": "a", "à": "a", "â": "a", "ä": "a", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "í": "i", "ì": "i", "î": "i", "ï": "i", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ñ": "n", "ç": "c",
    "rn": "m", "cl": "d", "c1": "d", "c|": "d", "c!": "d", "(l": "d", "vv": "w", "ii": "u", "!i": "u", "i!": "u", "il": "u", "li": "hu", "nn": "m", "ru": "m", "ri": "n", "r!": "n", "rl": "n", "tl": "d", "m": ("rn", "in"), "d": ("cl",),
}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_HYPHENS = "-\u00ad¬‐‑"
_SOFT = "\u00ad¬"
_BETWEEN = " \n" + _HYPHENS
_RUN = re.compile(rf"[^{_HYPHENS}\s]+")
_INNER = re.compile(r"[^\W\d_][0-9|!()\[\]{}$@]+|[0-9|!()\[\]{}$@]+[^\W\d_]")
_NUMBER = r"[0-9lIiOoSBbZz|!]{1,5}"
_ROMAN = r"[ivxlc]{1,8}"
_PAGE = re.compile(rf"(?:(?:[Pp][aoà@4][gq9][ecé3]|[Pp]\.|[Pp][gq]\.)\s*(?:{_NUMBER}|{_ROMAN})(?:\s*(?:of|oi|0f|/)\s*{_NUMBER})?|\[\s*(?:{_NUMBER}|{_ROMAN})\s*\]|\(\s*(?:{_NUMBER}|{_ROMAN})\s*\)|[-–—]\s*(?:{_NUMBER}|{_ROMAN})\s*[-–—]|(?=\S*[0-9]){_NUMBER}|[lIO|]{{2,4}}|{_ROMAN})\Z")
_WIDE = re.compile(r"\s{4,}")
_ROMAN_VALID = re.compile(r"(?:x{0,3}|xl|lx{0,3}|xc|c{1,3})?(?:ix|iv|v?i{0,3})\Z")


def is_page_number(line: str) -> bool:
    text = line.strip()
    if not text or not _PAGE.match(text):
        return False
    bare = text.strip("[]()-–— ")
    return bool(_ROMAN_VALID.match(bare)) if re.fullmatch(_ROMAN, bare) and not any(c.isdigit() for c in bare) else True


_ALIKE = {ord(c): group[0] for group in ("i1|!l[]", "o0aâàáäôóö", "s5$", "g9q", "b6h8", "e(cèéêë{", "tf7", "un", "vy", "z2") for c in group}
_ALIKE |= {ord(c): "o" for c in "e(cèéêë{"}  # an o may be read as c, and c stands for e


def title_key(line: str) -> str:
    """Letters of a running title, without page numbers, alike under confusions."""
    parts = _WIDE.split(line.strip())
    if len(parts) > 1:
        line = " ".join(p for p in parts if not is_page_number(p))
    words = [w for w in line.split() if not re.fullmatch(rf"[\[(]?(?:{_NUMBER}|{_ROMAN})[\])]?", w)]
    text = "".join(words).lower().translate(_ALIKE)
    for several, one in (("ru", "m"), ("uu", "m"), ("iu", "m"), ("oi", "d"), ("vv", "w"), ("ri", "u"), ("ii", "u")):
        text = text.replace(several, one)
    return "".join(c for c in text if c.isalpha())


class Reading(NamedTuple):
    """A word read in a stretch of the stream; ``word`` is None where it isn't known."""

    start: int
    end: int
    word: str | None
    edits: int = 0
    wrong: int = -1  # place of the first wrong character
    hyphen: int = -1  # place of the hyphen at which a line end divides the word


class Lexicon:
    """Known words with counts, and the decoding of streams of characters."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.total = max(1, sum(counts.values()))
        self.unit = math.log(self.total)
        self.least = self.unit - math.log(max(counts.values(), default=1))
        self.prefixes = {w[:k] for w in counts for k in range(1, len(w) + 1)}
        self.longest = max(map(len, counts), default=0)
        self.first_parts = {w.partition("-")[0] for w in counts if "-" in w}
        self.memory: dict[str, tuple[float, list[Reading]]] = {}
        self.tokens: dict[str, Token] = {}

    def cost(self, word: str) -> float:
        return self.unit - math.log(self.counts[word])

    def unknown_cost(self, length: int) -> float:
        return self.unit + 2.0 + EDIT * length / 3

    def plausible(self, form: str, word: str, edits: int) -> bool:
        """Whether a form of this length may be so misread: one character in three, two
        of a frequent word, and short forms only if the word isn't rare."""
        n = self.counts[word]
        most = max(2 if n > self.total / 500 else 1, (len(form) + 1) // 3)
        return edits <= most and (len(form) > 3 or n > self.total / 20_000 or bool(_INNER.search(form)))

    def words_from(self, stream: str, start: int, most: int) -> list[tuple[Reading, int]]:
        """Known words that may begin at ``start``, with at most ``most`` confusions, and
        the blanks left out inside them. The search follows beginnings of known words."""
        counts, prefixes, n = self.counts, self.prefixes, len(stream)
        out = []
        stack = [(start, "", 0, 0, -1, -1)]
        while stack:
            at, prefix, edits, blanks, wrong, hyphen = stack.pop()
            if prefix in counts and stream[at - 1] not in " \n":
                if not edits or self.plausible(stream[start:at].replace(" ", "").replace("\n", ""), prefix, edits):
                    out.append((Reading(start, at, prefix, edits, wrong, hyphen), blanks))
            if at >= n:
                continue
            c = stream[at]
            if prefix and c in _HYPHENS and stream[at + 1 : at + 2] == "\n":
                stack.append((at + 2, prefix, edits, blanks, wrong, at))
                if c not in _SOFT and prefix + "-" in prefixes:
                    stack.append((at + 2, prefix + "-", edits, blanks, wrong, hyphen))
                continue
            if c in " \n":
                if prefix:
                    stack.append((at + 1, prefix, edits, blanks + 1, wrong, hyphen))
                continue
            if prefix + c in prefixes:
                stack.append((at + 1, prefix + c, edits, blanks, wrong, hyphen))
            if edits < most:
                for width in (1, 2):
                    for right in CONFUSIONS.get(stream[at : at + width], ()) if at + width <= n else ():
                        if prefix + right in prefixes:
                            stack.append((at + width, prefix + right, edits + 1, blanks, at if wrong < 0 else wrong, hyphen))
        return out

    def decode(self, stream: str) -> tuple[float, list[Reading]]:
        """The words of least cost of a stretch of the stream, and the cost. Blanks may
        stand inside words or be missing between them, line ends (``\\n``) may divide
        words, with or without a hyphen, and characters may be confused. What no known
        word accounts for stands as it is, at any length. Confusions are allowed one by
        one, until one more can't pay."""
        if stream in self.memory:
            return self.memory[stream]
        result: tuple[float, list[Reading]] = (math.inf, [])
        for most in range(max(2, (min(len(stream), self.longest) + 2) // 3) + 1):
            result = min(result, self._least(stream, most, result[0]), key=lambda r: r[0])
            if result[0] <= EDIT * (most + 1) + self.least:
                break
        if len(self.memory) > HELD:
            self.memory.clear()
        self.memory[stream] = result
        return result

    def _least(self, stream: str, most: int, bound: float) -> tuple[float, list[Reading]]:
        n = len(stream)
        best: list[tuple[float, Reading | int] | None] = [None] * (n + 1)
        best[0] = (0.0, 0)

        def offer(end: int, price: float, step: Reading | int) -> None:
            old = best[end]
            if price <= bound and (old is None or price < old[0]):
                best[end] = (price, step)

        for at in range(n):
            if best[at] is None:
                continue
            so_far, c = best[at][0], stream[at]
            if c in _BETWEEN and at:
                divided = stream[at + 1 : at + 2] == "\n" and c in _HYPHENS
                if divided:
                    left, right = _last_run(stream, at), _first_run(stream, at + 2)
                    offer(at + 2, so_far + (KEPT if min(len(left), len(right)) > 2 and left in self.counts and right in self.counts else 3 * KEPT), at)
                else:
                    offer(at + 1, so_far, at)
                continue
            begins = at == 0 or stream[at - 1] in _BETWEEN
            if begins:
                stop = at + len(_first_run(stream, at))
                if stop > at:
                    offer(stop, so_far + self.unknown_cost(stop - at), Reading(at, stop, None))
                    if stream[stop : stop + 1] and stream[stop] in _HYPHENS and stream[stop + 1 : stop + 2] == "\n":
                        end = stop + 2 + len(_first_run(stream, stop + 2))
                        offer(end, so_far + self.unknown_cost(end - at - 2), Reading(at, end, None, hyphen=stop))
                else:
                    offer(at + 1, so_far, at)  # a sign that belongs to no word
            for reading, blanks in self.words_from(stream, at, most):
                price = self.cost(reading.word) + EDIT * reading.edits + BLANK * (blanks + (not begins)) + (1e-6 if "-" in reading.word else 0.0)
                offer(reading.end, so_far + price, reading)
        if best[n] is None:
            return math.inf, []
        words, at = [], n
        while at:
            step = best[at][1]
            if isinstance(step, Reading):
                words.append(step)
                at = step.start
            else:
                at = step
        return best[n][0], words[::-1]

    def token(self, raw: str) -> Token:
        """What stands between two blanks; remembered."""
        found = self.tokens.get(raw)
        if found is None:
            if len(self.tokens) > HELD:
                self.tokens.clear()
            found = self.tokens[raw] = self._token(raw)
        return found

    def _token(self, raw: str) -> Token:
        parts = body_tokens(raw)
        if not parts:
            return Token("", raw, "", True)
        place, form = parts[0]
        low = form.lower()
        if len(low) != len(form):
            return Token("", raw, "", True)
        if low not in self.counts and len(low) > 2:
            if low[0] in "([{|" and low[1:] in self.counts:
                place, form = place + 1, form[1:]
            elif low[-1] in "!|)]" and low[:-1] in self.counts:
                form = form[:-1]
        low = form.lower()
        stands = low in self.counts or all(p in self.counts or len(p) < 2 for p in low.split("-"))
        return Token(form, raw[:place], raw[place + len(form) :], stands)

    def crosses(self, left: str, right: str) -> bool:
        """Whether a known word may go on from ``left`` into ``right``, over the blank
        between them: judged by the first three characters, one of them confused or none."""
        head = right[:3]
        if left + head in self.prefixes:
            return True
        for at in range(len(head)):
            for width in (1, 2):
                for sound in CONFUSIONS.get(head[at : at + width], ()):
                    if left + head[:at] + sound + head[at + width :] in self.prefixes:
                        return True
        return False


class Token(NamedTuple):
    form: str  # without the signs around it; empty if there is no word
    lead: str
    tail: str
    stands: bool  # a known word, or none at all


def _first_run(stream: str, at: int) -> str:
    """The characters from ``at`` to the next blank or hyphen."""
    found = _RUN.match(stream, at)
    return found.group() if found else ""


def _last_run(stream: str, at: int) -> str:
    start = at
    while start and stream[start - 1] not in _BETWEEN:
        start -= 1
    return stream[start:at]


def odd_place(form: str) -> int | None:
    """The place of a character that no word of the collection has: a digit or sign
    among letters, or a letter that isn't plain."""
    inner = _INNER.search(form)
    if inner and sum(c.isalpha() for c in form) >= 3:
        return inner.start()
    return next((i for i, c in enumerate(form) if not c.isascii() and c.isalpha()), None)


def body_tokens(line: str) -> list[tuple[int, str]]:
    """(place, form) of the words of a line, without the signs around them. Signs
    that stand inside a word or for its first or last letter stay."""
    out = []
    for found in re.finditer(r"\S+", line):
        start, text = found.start(), found.group()
        cut = len(text) - len(text.lstrip("\"'“”‘’«»*_#>.,;:?-–—"))
        text = text[cut:].rstrip("\"'“”‘’«»*_.,;:?-–—\u00ad¬‐‑")
        if text.endswith(")") and "(" not in text:
            text = text.rstrip(")")
        if text.startswith("(") and (")" in text or not text[1:2].islower() or len(text) < 3):
            cut, text = cut + 1, text[1:].rstrip(")")
        if sum(c.isalpha() for c in text) >= 2:
            out.append((start + cut, text))
    return out


class Stretch(NamedTuple):
    """A part of the stream that was decoded: tokens ``first`` to ``last`` of the page."""

    first: int
    last: int
    stream: str
    words: list[Reading]


class Page:
    """Lines of a page with what was found in them; line numbers count from 1."""

    def __init__(self, text: str, lexicon: Lexicon, topic: str = "") -> None:
        self.lines = text.split("\n")
        self.lexicon = lexicon
        written = [i for i, line in enumerate(self.lines) if line.strip()]
        self.edge = sorted({*written[:2], *written[-2:]})
        self.numbers = {i for i in self.edge if is_page_number(self.lines[i])}
        self.titles = {}
        for i in self.edge:
            line = self.lines[i].strip()
            key = title_key(line)
            if i in self.numbers or len(key) < 5 or line[-1] in _HYPHENS + ".,;?!:" and not re.match(r"Chapter", line):
                continue
            if line[0].isupper() or line[0] in "[(0123456789":
                self.titles[i] = key
        #: running titles that tell themselves, by a page number beside them, the topic of the file, a chapter number or capitals
        topic_key = title_key(topic)
        self.sure = {i for i, key in self.titles.items() if self.numbered(i) or (topic_key and len(topic_key) > 4 and key.startswith(topic_key)) or re.match(r"\s*Ch[ao]pt[ecé]r\s+\d+", self.lines[i]) or self.capitals(i)}
        self.body = [i for i in written if i not in self.numbers and i not in self.sure]

    def capitals(self, i: int) -> bool:
        letters = [c for c in self.lines[i] if c.isalpha()]
        return len(letters) > 7 and len(self.lines[i].split()) > 1 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)

    def numbered(self, i: int) -> bool:
        parts = _WIDE.split(self.lines[i].strip())
        return len(parts) == 2 and is_page_number(parts[0]) != is_page_number(parts[1])

    def divided_at_foot(self, line: str) -> bool:
        """Whether the last body line of a page ends in a divided word, whose rest isn't here."""
        if len(line) < 2 or line[-1] not in _HYPHENS or not line[-2].isalnum():
            return False
        left = line[:-1].split()[-1].lower().lstrip("\"'“(«")
        return line[-1] != "-" or (left not in self.lexicon.first_parts and left.rpartition("-")[2] not in self.lexicon.first_parts)

    def decoded(self, lines: list[int]) -> tuple[list[tuple[int, str]], list[Stretch]]:
        """Tokens (line, text) of these lines, and the stretches of their stream that
        aren't made of known words between blanks, decoded. A stretch takes in its
        neighbours, over blanks and line ends, as far as a known word may reach."""
        lexicon = self.lexicon
        tokens = [(i, raw) for i in lines for raw in self.lines[i].split()]
        looks = [lexicon.token(raw) for _, raw in tokens]
        last = len(tokens) - 1

        def ends_divided(at: int) -> bool:
            raw = tokens[at][1]
            return raw[-1] in _HYPHENS and at < last and tokens[at + 1][0] != tokens[at][0] and raw[-2:-1].isalnum() and tokens[at + 1][1][0].isalnum()

        def reaches(at: int) -> bool:
            """Whether a word may go on from token ``at`` to the next."""
            a, b = looks[at], looks[at + 1]
            return bool(a.form and b.form) and not a.tail and not b.lead and lexicon.crosses(a.form.lower(), b.form.lower())

        out: list[Stretch] = []
        at, free = 0, 0  # no stretch may begin before token ``free``
        while at <= last:
            look = looks[at]
            if look.stands and tokens[at][1][-1] not in _HYPHENS:
                if at < last and look.form and not look.tail and looks[at + 1].stands:
                    low = look.form.lower()
                    joined = low + looks[at + 1].form.lower()
                    if not (joined in lexicon.counts and joined != low and not looks[at + 1].lead and low in lexicon.counts and looks[at + 1].form.lower() in lexicon.counts and lexicon.cost(joined) + BLANK < lexicon.cost(low) + lexicon.cost(joined[len(low) :])):
                        at += 1
                        continue
                    first, end = at, at + 1
                else:
                    at += 1
                    continue
            elif ends_divided(at):
                first, end = at, at + 1
            elif look.stands or (tokens[at][1][-1] in _HYPHENS and (at == last or tokens[at + 1][0] != tokens[at][0])):
                at += 1  # the hyphen of a dash, or of a word whose rest isn't here
                continue
            else:
                first = end = at
            if first > free and not looks[first].stands and reaches(first - 1) and not ends_divided(first - 1):
                first -= 1
            while end < last and (ends_divided(end) or ((not looks[end].stands or not looks[end + 1].stands) and reaches(end))):
                end += 1
            forms = []
            for k in range(first, end + 1):
                forms.append(looks[k].form or tokens[k][1].strip(_HYPHENS))
                if k < end:
                    forms.append((tokens[k][1][-1] if ends_divided(k) else "") + ("\n" if tokens[k + 1][0] != tokens[k][0] else " "))
            stream = "".join(forms)
            low = stream.lower()
            if len(low) == len(stream):
                out.append(Stretch(first, end, stream, lexicon.decode(low)[1]))
            at = free = end + 1
        return tokens, out

    def edges(self) -> Iterator[tuple[int, str, str | None, bool]]:
        """Page numbers and possible running titles: as ``findings``."""
        for i in sorted(self.numbers):
            yield i + 1, "page_number", None, True
        for i, key in self.titles.items():
            yield i + 1, "header", key, i in self.sure

    def findings(self) -> Iterator[tuple[int, str, str | None, bool]]:
        """(line_no, kind, key of a possible running title, sure)."""
        yield from self.edges()
        tokens, stretches = self.decoded(self.body)
        found = set()
        for first, _, stream, words in stretches:
            lines = [tokens[first][0]]  # of each line of the stretch
            at = first
            for c in stream:
                if c in " \n":
                    at += 1
                    if c == "\n":
                        lines.append(tokens[at][0])
            for word in words:
                place = word.wrong
                if word.word is None:
                    form = stream[word.start : word.end]
                    odd = odd_place(form if word.hyphen < 0 else stream[word.start : word.hyphen] + stream[word.hyphen + 2 : word.end])
                    if odd is not None:
                        place = word.start + odd + (2 if 0 <= word.hyphen <= word.start + odd else 0)
                if place >= 0:
                    found.add((lines[stream.count("\n", 0, place)], "misread"))
                if word.hyphen >= 0:
                    found.add((lines[stream.count("\n", 0, word.hyphen)], "hyphen"))
        if self.body and self.divided_at_foot(self.lines[self.body[-1]].rstrip()):
            found.add((self.body[-1], "hyphen"))
        for i, kind in sorted(found):
            yield i + 1, kind, self.titles.get(i), False

    def paragraphs(self, headers: set[int]) -> list[str]:
        """Continuous text: body lines without ``headers`` (line numbers), divided
        words joined, misread ones put right, broken where that costs least."""
        body = [i for i in range(len(self.lines)) if self.lines[i].strip() and i not in self.numbers and i + 1 not in headers]
        if not body:
            return []
        width = max(len(self.lines[i].rstrip()) for i in body)
        # cost of joining line a with the next one b in a paragraph, against breaking there
        starts, best = [0] * (len(body) + 1), [0.0] + [math.inf] * len(body)
        joins = [0.0]
        for a, b in zip(body, body[1:]):
            line, following = self.lines[a].rstrip(), self.lines[b].lstrip()
            cost = 8.0 * any(not self.lines[k].strip() for k in range(a + 1, b))
            cost += 3.0 * (len(line) + len(following.split()[0]) + 1 <= width * 0.8) + 2.0 * bool(re.match(r"(?:[-*+•]|\d+[.)]|\|)\s", following)) + 1.5 * (line[-1] in ".!?:")
            cost -= 4.0 * (following[0].islower() or line[-1] in ",;" + _HYPHENS) + 1.0 * (line[-1] not in ".!?:")
            joins.append(cost)
        total = [0.0]
        for cost in joins[1:]:
            total.append(total[-1] + cost)
        for end in range(1, len(body) + 1):
            for start in range(end):
                price = best[start] + 3.0 + total[end - 1] - total[start]
                if price < best[end]:
                    best[end], starts[end] = price, start
        cuts, at = [], len(body)
        while at:
            cuts.append((starts[at], at))
            at = starts[at]
        return [self.joined(body[a:b]) for a, b in reversed(cuts)]

    def joined(self, lines: list[int]) -> str:
        """The text of these lines, decoded, on one line."""
        tokens, stretches = self.decoded(lines)
        out, at = [], 0
        for first, last, stream, words in stretches:
            out += [raw for _, raw in tokens[at:first]]
            text, end = "", 0
            for word in words:
                gap = stream[end : word.start]
                if end:
                    text += "-" if any(c in _HYPHENS for c in gap) else " "
                else:
                    text += gap
                text += self._written(stream, word)
                end = word.end
            head, tail = self.lexicon.token(tokens[first][1]), self.lexicon.token(tokens[last][1])
            out.append((head.lead if head.form else "") + text + stream[end:] + (tail.tail if tail.form else ""))
            at = last + 1
        return " ".join(out + [raw for _, raw in tokens[at:]])

    @staticmethod
    def _written(stream: str, word: Reading) -> str:
        form = stream[word.start : word.end]
        if word.word is None:
            return form if word.hyphen < 0 else stream[word.start : word.hyphen] + stream[word.hyphen + 2 : word.end]
        if form.lower() == word.word:
            return form
        letters = [c for c in form if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return word.word.upper()
        return word.word[:1].upper() + word.word[1:] if form[:1].isupper() else word.word


def page_words(chunks: DataFrame) -> DataFrame:
    """(w, n, clean): words of letters, with hyphens and apostrophes inside, their
    counts in all texts and in those that aren't scanned. Words divided at a line
    end are left out, and parts of words with foreign signs or digits in them.
    What stands between blanks is counted first, words are sought in each distinct one."""
    whole = F.regexp_replace(F.lower("text"), rf"(?<!\S)\S++(?<=[{_HYPHENS}])\s*\n\s*\S+", " ")
    scanned = F.coalesce(F.col("source").rlike(PDF_PAGE), F.lit(False))
    runs = chunks.where("text is not null").select(scanned.alias("scanned"), F.explode(F.split(whole, r"[ \n\t\r\f\x0B]+")).alias("run"))
    runs = runs.groupBy("run").agg(F.count("*").alias("n"), F.count_if(~F.col("scanned")).alias("clean"))
    text = F.regexp_extract_all("run", F.lit(r"(?<![\p{L}\p{N}|!(\[{$@'’-])(\p{L}+(?:['’-]\p{L}+)*)(?![\p{L}\p{N}|!(\[{$@])"), F.lit(1))
    words = runs.select("n", "clean", F.explode(text).alias("w"))
    return words.groupBy("w").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))


def lexicon_counts(chunks: DataFrame) -> dict[str, int]:
    """The lexicon: every word of clean text, and words of scanned text that are no
    confusion of a word five times as frequent. The clean words alone decide what is
    a confusion, so the others are judged in the tasks, and only those kept are collected.
    Without any clean text, the words of ASCII letters stand in for its words."""
    words = materialize(page_words(chunks), "words")
    known = _counts(words.where("clean > 0")) or {w: n for w, n in _counts(words.where(F.col("n") >= 2)).items() if w.isascii()}
    if not known:
        return {}
    shared, name = chunks.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = worker_lexicon(name, shared.value)
        for batch in batches:
            yield batch[[w not in base.counts and belongs(base, w, n) for w, n in zip(batch.w, batch.n)]]

    others = words.where((F.col("clean") == 0) & (F.col("n") >= LEAST_SCANNED)).select("w", "n")
    return known | _counts(others.mapInPandas(run, "w string, n bigint"))


def _counts(words: DataFrame) -> dict[str, int]:
    rows = words.select("w", "n").toPandas()
    return dict(zip(rows.w, rows.n.astype(int)))


def belongs(base: Lexicon, word: str, n: int) -> bool:
    """Whether a word that only scanned text has, ``n`` times, is a word and no confusion."""
    if not word.isascii():
        return False
    read = [r for r, blanks in base.words_from(word, 0, (len(word) + 1) // 3 + 1) if r.end == len(word)]
    return not read or base.counts[min(read, key=lambda r: (r.edits, -base.counts[r.word])).word] < 5 * n


_WORKER: dict[str, Lexicon] = {}


def worker_lexicon(name: str, counts: dict[str, int]) -> Lexicon:
    """The lexicon of this Python worker; the last one is kept with what it has decoded."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Lexicon(counts)
    return _WORKER[name]


def _topic(source: str) -> str:
    name = source.rpartition("/")[2]
    name = re.sub(r"\.\w+\s+p\.\d+.*$", "", name)
    words = name.split("-")
    return " ".join(words[:2]) if len(words) > 2 else ""


FOUND = "doc_id string, chunk_pos int, line_no int, kind string, title string, sure boolean"


def scan_findings(chunks: DataFrame) -> DataFrame:
    """Findings of the single page: FOUND. A line whose ``title`` is set stands
    where running titles stand; ``header`` rows are only possible ones until
    ``settled`` has compared the pages of a document."""
    return _page_findings(chunks, lexicon_counts(chunks), Page.findings)


def possible_titles(chunks: DataFrame) -> DataFrame:
    """Possible running titles alone: FOUND. Nothing is decoded for them."""
    return _page_findings(chunks, {}, Page.edges)


def _page_findings(chunks: DataFrame, counts: dict[str, int], find: Callable[[Page], Iterator]) -> DataFrame:
    shared, name = chunks.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = worker_lexicon(name, shared.value)
        for batch in batches:
            rows = []
            for doc, pos, source, text in zip(batch.doc_id, batch.chunk_pos, batch.source, batch.text):
                for line, kind, key, sure in find(Page(text, lexicon, _topic(source))):
                    rows.append((doc, pos, line, kind, key, sure))
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_pos", "line_no", "kind", "title", "sure"])
            out["chunk_pos"] = out["chunk_pos"].astype("Int32")
            yield out.astype({"line_no": "int32", "sure": "bool"})

    return spread(scanned_pages(chunks)).mapInPandas(run, FOUND)


def scanned_pages(chunks: DataFrame) -> DataFrame:
    rows = chunks.where(F.col("source").rlike(PDF_PAGE) & F.col("text").isNotNull() & (F.length("text") > 0))
    return rows.select("doc_id", F.col("chunk_pos").cast("int").alias("chunk_pos"), "source", "text")


def settled(findings: DataFrame) -> DataFrame:
    """Line findings with running titles decided: a title on at least two pages of
    a document, or one that is sure by itself. Such lines have no other kind.

    The keys of titles are grouped, never the pages of a document, so a document
    with a third of all pages is spread like any other."""
    distinct = materialize(findings.distinct(), "findings")
    titles = distinct.where("kind = 'header'").groupBy("doc_id", "title").agg(F.count_distinct("chunk_pos").alias("pages"), F.bool_or("sure").alias("any_sure"))
    running = titles.where("pages >= 2 or any_sure").select("doc_id", "title", F.lit(True).alias("running"))
    plain = distinct.where("title is null")
    marked = distinct.where("title is not null").join(running, ["doc_id", "title"], "left").withColumn("running", F.coalesce("running", F.lit(False)))
    kept = marked.where((F.col("kind") == "header") == F.col("running"))
    return plain.select("doc_id", "chunk_pos", "line_no", "kind").unionByName(kept.select("doc_id", "chunk_pos", "line_no", "kind")).distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_pos, paragraph_no, text) of scanned pages, continuous and
    without running titles and page numbers. Other chunks, null and empty texts
    give no rows; repeated chunks count once."""
    spark = chunks.sparkSession
    headers = settled(possible_titles(chunks)).where("kind = 'header'").groupBy("doc_id", "chunk_pos").agg(F.collect_set("line_no").alias("headers"))
    pages = scanned_pages(chunks).distinct().join(headers, ["doc_id", "chunk_pos"], "left")
    shared, name = spark.sparkContext.broadcast(lexicon_counts(chunks)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = worker_lexicon(name, shared.value)
        for batch in batches:
            rows = []
            for doc, pos, text, own in zip(batch.doc_id, batch.chunk_pos, batch.text, batch.headers):
                for n, paragraph in enumerate(Page(text, lexicon).paragraphs(set() if own is None else set(own)), 1):
                    rows.append((doc, pos, n, paragraph))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_pos", "paragraph_no", "text"]).astype({"chunk_pos": "Int32", "paragraph_no": "int32"})

    return pages.select("doc_id", "chunk_pos", "text", "headers").mapInPandas(run, "doc_id string, chunk_pos int, paragraph_no int, text string")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return settled(scan_findings(table(spark, folder, "chunks")))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(table(spark, folder, "chunks"))


QUERIES = {"p3_found": p3_found, "p3_text": p3_text}
SQL: dict[str, str] = {}
