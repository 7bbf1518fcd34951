"""Defects of prompt and response pairs, by a conditional random field over clauses.

The back and the extra of a card are cut into clauses. A linear-chain CRF tags
each clause as answer, refusal, echo, foreign or unfinished from features of the
clause and of the front. The defect of the pair follows from how much of a field
the tags cover. A field with nothing in it but a placeholder has no clauses and
is empty.

The CRF has no labelled cards to learn from. It is fitted on a bounded sample of
the cards (``SAMPLE``), taken by hash over all of them: their clauses as they are
stand for answers, and copies of them are spoiled in each of the four ways. What
all cards tell of endings (which words end a clause, which patterns of function
words go on) is counted over the whole table and becomes features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize, spread, table

SAMPLE = 12_000
#: Patterns a task holds before it hands its counts on.
HELD_PATTERNS = 300_000
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Spoiled clauses are far more frequent in the fit than among cards; their log
#: odds are lowered by so much afterwards.
PRIOR = np.array([0.0, 1.0, 1.0, 1.0, 2.2])

#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the a an of is are was were be been that which who whose and or but if then than not no to in on at by for with from as into about between only each every this these those it its they their there when while where because unless except although after before during until how what why does do did can could may might must should would will has have had more most less yet so also near within across against over under through left once whenever wherever whether both either one means first unlike since now given called name",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber wenn dann als nicht kein keine zu in im an am auf bei mit von vom für aus über unter nach vor zwischen sich ist sind war waren wird werden wurde hat haben es sie er wir man auch noch nur schon sehr mehr jede jeder jedes dieser diese dieses welche welcher welches was warum wie sobald weil dass gilt außer im zum zur danach zuerst laut sonst durch gegen ohne ihre ihr sein seine",
    "fr": "le la les l un une des du de d et ou mais si alors que qui quoi dont où ne pas plus moins à au aux en dans sur sous par pour avec sans est sont était ce cette ces cet il elle on nous se s son sa ses leur leurs comme lorsque quand puis ensuite aussi après avant contrairement quelle quel quels quelles pourquoi t n selon première tombe dure longtemps toute appelle",
    "es": "el la los las un una unos unas de del y o pero si no que quien cual qué cuál cuándo a al en con por para sin sobre entre es son era se su sus lo le como cuando tras después antes también más menos que cualquier este esta estos estas ese esa luego primero primera diferencia porque ya muy toda todo según dura llama baja falta",
}
#: Words by which a question asks for another language.
LANGUAGE_NAMES = r"\b(?:french|german|spanish|english|italian|latin|französisch\w*|deutsch\w*|spanisch\w*|englisch\w*|français\w*|allemand\w*|espagnol\w*|anglais\w*|francés|alemán|inglés|español|translat\w+|übersetz\w+|tradu\w+)\b"
#: Fields with nothing in them.
PLACEHOLDERS = set("n/a na n.a. none null nil tbd tba todo blank empty missing placeholder xxx nan undefined void leer keine nichts vide aucun vacío ninguno nada".split()) | {"to do", "to be done", "to be added", "fill in", "no answer", "not available"}
#: What refusals are made of: who speaks, what can't be, and what of.
SPEAKER = """i | i'm | im | i'll | i've | me | my | assistant | language model | as an ai | as a model | unfortunately | apologies | sorry
    | ich | mir | mich | mein | meine | meiner | meinen | sprachmodell | assistent | leider | je | j'ai | moi | mes | assistante | modèle | malheureusement | désolé | désolée | yo | mi | mis | asistente | modelo | puedo | siento | lamento"""
CANNOT = """cannot | can't | cant | can not | won't | wont | will not | unable | not able | not allowed | not permitted | not going to | do not let | don't let | don't have | do not have | have no | do not feel | don't feel | rather not | prefer not | not comfortable | uncomfortable | beyond what | decline | refuse | no answer | instead | something else
    | kann nicht | kann ich nicht | kann das nicht | kann dazu nicht | kann ich dazu nichts | darf | nicht beantworten | nicht helfen | nichts sagen | ablehnen | ne peux pas | ne puis | refuser | impossible | ne suis pas | no puedo | no me es | no es posible | no tengo | debo rechazar | rechazar"""
HELP = """help | assist | answer | answers | answered | answering | respond | reply | request | question | questions | prompt | guideline | guidelines | policy | policies | continue | provide that | do that | do this | guess | access to | information to | discuss | discussing | comment on | talk about | comfortable | consult | teacher | produced
    | beantworten | helfen | frage | anfrage | dazu | auskunft | répondre | aider | demande | question | ayudar | responder | pregunta | solicitud"""
#: Refusals that the fit learns from are made of these, besides the features.
OPENERS = ("", "", "Sorry,", "I'm sorry, but", "Unfortunately", "Apologies,", "As an AI language model,", "As an assistant,")
INABILITY = ("I can't", "I cannot", "I cant", "I can not", "I am unable to", "I'm not able to", "I won't", "I will not", "I must decline to", "I would rather not", "I am not allowed to", "I don't feel comfortable to", "my guidelines don't let me", "I have no way to")
ACTS = ("help with that", "answer", "answer this question", "answer questions about this", "do that", "do this", "discuss that", "talk about it", "respond to this request", "provide that", "provide that information", "continue", "assist you here", "give an answer", "say anything on this prompt")
#: ... or of these, where nobody speaks.
NOTHING = ("No answer", "No reply", "No response", "Nothing", "No explanation", "No statement")
SAID = ("can be given", "can be provided", "can be offered", "may be given", "is possible", "is available", "will be given", "can be produced")
WHERE = ("for this question", "to this prompt", "on this request", "here", "for that", "to your question")
TAILS = ("", "", "", "", "Is there something more?", "Please ask somebody else.", "Let me know if you need more.", ":-)", "(generated message)", "Let us change the topic.")
REFUSALS = (
    "I do not have the information to answer.", "No answer can be given for this question.", "Ask your teacher instead, I will not answer this.", "That goes beyond what I may help with.", "I have no access to what is needed and don't want to guess.",
    "Es tut mir leid, das kann ich nicht beantworten.", "Als Sprachmodell darf ich dazu nichts sagen.", "Dazu kann ich leider nichts sagen.", "Je suis désolé, je ne peux pas répondre.", "En tant qu'assistant, je ne peux pas aider.", "Lo siento, no puedo responder.", "Como modelo no puedo ayudar con esto.",
)
_ASKS = re.compile(LANGUAGE_NAMES, re.I)


class Cue:
    """Words and phrases, one of which a clause has or hasn't."""

    def __init__(self, block: str) -> None:
        entries = [" ".join(e.split()) for e in block.split("|")]
        self.words = frozenset(e for e in entries if " " not in e)
        self.phrases = [f" {e} " for e in entries if " " in e]
        self.heads = frozenset(e.split()[0] for e in self.phrases)

    def found(self, own: set[str], line: str) -> bool:
        return not own.isdisjoint(self.words) or (not own.isdisjoint(self.heads) and any(e in line for e in self.phrases))


_SPEAKER, _CANNOT, _HELP = Cue(SPEAKER), Cue(CANNOT), Cue(HELP)


def made_refusal(rng: np.random.Generator) -> str:
    said, kind = str(rng.choice(REFUSALS)), rng.random()
    if kind < 0.15:
        said = f"{rng.choice(NOTHING)} {rng.choice(SAID)} {rng.choice(WHERE)}."
    elif kind < 0.8:
        said = " ".join(p for p in (str(rng.choice(OPENERS)), str(rng.choice(INABILITY)), str(rng.choice(ACTS))) if p)
        said = said[:1].upper() + said[1:] + "."
    shape = rng.integers(6)
    if shape == 0:
        said = said.rstrip(".").lower()
    elif shape == 1:
        said = said.rstrip(".").lower().replace("'", "") + str(rng.choice([", sorry", " sorry", ""]))
    elif shape == 2:
        said = said.upper()
    return f"{said} {rng.choice(TAILS)}".strip()


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CLAUSE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\n+")
_CLOZE = re.compile(r"\{\{c\d+::(.*?)(?:::[^}]*)?\}\}")
_TAGS = re.compile(r"<[^<>]*>|&\w+;|&#\d+;")
_LANGUAGES = tuple(FUNCTION_WORDS)
#: word -> its vote for each of the languages that have it
_SPOKEN: dict[str, tuple[tuple[int, float], ...]] = {}
for _w in {w for words in FUNCTION_WORDS.values() for w in words.split()}:
    _in = [k for k, lang in enumerate(_LANGUAGES) if _w in FUNCTION_WORDS[lang].split()]
    _SPOKEN[_w] = tuple((k, 1 / len(_in)) for k in _in)
_ACCENTS = {"ä": 1, "ö": 1, "ü": 1, "ß": 1, "é": 2, "è": 2, "ê": 2, "à": 2, "ç": 2, "û": 2, "î": 2, "œ": 2, "ñ": 3, "í": 3, "ó": 3, "á": 3, "ú": 3, "¿": 3, "¡": 3}
N_FEATURES = 22


def is_empty(text: str | None) -> bool:
    """Null, blank, without a letter or digit, or only a placeholder."""
    if text is None:
        return True
    bare = _TAGS.sub(" ", text).strip().lower()
    if not any(c.isalnum() for c in bare):
        return True
    return bare.strip("()[]{}<>*_-–—.:!? ") in PLACEHOLDERS or bare in PLACEHOLDERS


def clauses(text: str) -> list[str]:
    parts = [p for p in _CLAUSE.split(text.strip()) if p and p.strip()]
    return parts


def language_votes(words: list[str], text: str) -> list[float]:
    votes = [0.0] * len(_LANGUAGES)
    for w in words:
        for k, vote in _SPOKEN.get(w, ()):
            votes[k] += vote
    if not text.isascii():
        for c in set(text.lower()):
            if c in _ACCENTS:
                votes[_ACCENTS[c]] += 1.0
    return votes


def skeleton(words: list[str]) -> list[str]:
    """For each word, the pattern of function words up to it; runs of others are one star."""
    out, pattern, star = [], "", False
    for w in words:
        if w in _SPOKEN:
            pattern += f" {w}"
            star = False
        elif not star:
            pattern += " #" if w.isdigit() else " *"
            star = True
        out.append(pattern)
    return out


COUNTERS = ("last", "inner", "tail_last", "tail_inner", "whole", "part")


class Endings:
    """How clauses end: by last word, by its ending, by pattern of function words."""

    def __init__(self) -> None:
        self.last, self.inner, self.tail_last, self.tail_inner = Counter(), Counter(), Counter(), Counter()
        self.whole, self.part = Counter(), Counter()
        self.beginnings: set[str] = set()

    def settle(self) -> Endings:
        """Beginnings of known words, to tell a word that broke off from a new one."""
        self.beginnings = {w[:k] for w, n in self.inner.items() if n >= 2 for k in range(1, len(w))}
        return self

    @classmethod
    def of_counts(cls, counts: Iterable[tuple[str, str, int]]) -> Endings:
        """Endings from (counter, key, count)."""
        made = cls()
        for counter, key, n in counts:
            getattr(made, counter)[key] = int(n)
        return made.settle()

    def counts(self) -> Iterator[tuple[str, str, int]]:
        for counter in COUNTERS:
            for key, n in getattr(self, counter).items():
                yield counter, key, n

    def learn_field(self, text: str | None, front: str | None, card_type: str | None) -> None:
        """The clauses of a field that stand for whole ones."""
        if card_type == "cloze" or is_empty(text) or is_empty(front):
            return
        for part in clauses(text):
            words = _WORD.findall(part.lower())
            if words and part.rstrip()[-1] not in ",-–(;:…":
                self.learn(words)

    def learn(self, words: list[str]) -> None:
        patterns = skeleton(words)
        self.last[words[-1]] += 1
        self.tail_last[words[-1][-3:]] += 1
        for w in words[:-1]:
            self.inner[w] += 1
            self.tail_inner[w[-3:]] += 1
        self.whole[patterns[-1]] += 1
        for p in set(patterns[:-1]) - {patterns[-1]}:
            self.part[p] += 1

    def rates(self, words: list[str]) -> tuple[float, float, float]:
        """Log odds of an end after the last word and after the pattern; whether the last word may be whole."""
        w = words[-1]
        known = self.last[w] + self.inner[w]
        if known >= 3:
            word = math.log((self.last[w] + 0.5) / (self.inner[w] + 0.5))
        else:
            word = math.log((self.tail_last[w[-3:]] + 0.5) / (self.tail_inner[w[-3:]] + 0.5))
        pattern = skeleton(words)[-1]
        whole, part = self.whole[pattern], self.part[pattern]
        seen = whole + part >= 3
        return word, math.log((whole + 0.5) / (part + 0.5)) if seen else min(0.0, word), float(self.inner[w] > 0 or w.isdigit() or w not in self.beginnings)


class Front:
    """What is asked, prepared once for the clauses of a card."""

    def __init__(self, text: str | None, card_type: str | None) -> None:
        text = _CLOZE.sub(r"\1", text or "")
        self.words = _WORD.findall(text.lower())
        self.set = frozenset(self.words)
        self.votes = language_votes(self.words, text)
        self.lang = self.votes.index(max(self.votes)) if max(self.votes) >= 2 else -1
        self.asks = bool(_ASKS.search(text))
        self.cloze = card_type == "cloze"


def features(clause: str, front: Front, endings: Endings, first: bool, final: bool, extra: bool) -> list[float]:
    words = _WORD.findall(clause.lower())
    n = max(len(words), 1)
    own = set(words)
    shared = own & front.set
    inside = len(shared) / max(len(own), 1)
    covers = len(shared) / max(len(front.set), 1)
    votes = language_votes(words, clause)
    foreign, most = 0.0, max(votes)
    if front.lang >= 0 and most > 0:
        foreign = (most - votes[front.lang]) / n if votes.index(most) != front.lang else -votes[front.lang] / n
    line = f" {' '.join(words)} "
    speaker, cannot, helps = (cue.found(own, line) for cue in (_SPEAKER, _CANNOT, _HELP))
    bare = clause.rstrip().rstrip("\"'”»")
    end = bare[-1:] if bare else ""
    word_end, pattern_end, known = endings.rates(words) if words and final else (0.0, 0.0, 1.0)
    closed = end in ".!?" or (end == ")" and clause.count("(") <= clause.count(")"))
    listed = ";" in clause
    function_last = bool(words) and words[-1] in _SPOKEN
    return [
        1.0,
        inside if covers > 0.5 else 0.0, covers, float(inside > 0.8 and covers > 0.7), float(inside > 0.95 and covers > 0.85),
        max(foreign, 0.0) * 5, max(-foreign, 0.0) * 5, float(foreign > 0.12) * (0.0 if front.asks and n <= 4 else 1.0), float(front.asks and n <= 4),
        float(speaker), float(cannot), float(helps), float(speaker + cannot + helps >= 2), float(speaker and cannot and helps),
        float(final and (end in ",-–(;:" or clause.count("(") > clause.count(")"))) * (0.0 if n <= 1 else 1.0), float(final and (clause.rstrip().endswith("…") or clause.rstrip().endswith("..."))) * (0.0 if listed else 1.0),
        float(final and not closed and function_last and n > 1), float(final and not closed) * max(-3.0, min(3.0, word_end)) * (0.0 if listed or n <= 2 else 1.0),
        float(final and not closed) * max(-4.0, min(4.0, pattern_end)) * (0.0 if listed or n <= 2 else 1.0), float(final and not closed and not known and n > 1),
        float(final and closed), float(front.cloze or listed or n <= 2),
    ]


class Crf:
    """A linear-chain conditional random field on dense features."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def decode(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tags of the clauses of many fields, one after the other; fields of equal
        length are decoded at once."""
        scores = rows @ self.emit.T
        tags = scores.argmax(1)
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[lengths > 1]):
            own = starts[lengths == length]
            best, back = scores[own], []
            for step in range(1, length):
                ways = best[:, :, None] + self.move
                back.append(ways.argmax(1))
                best = ways.max(1) + scores[own + step]
            tags[own + length - 1] = path = best.argmax(1)
            for step in range(length - 2, -1, -1):
                tags[own + step] = path = back[step][np.arange(len(own)), path]
        return tags

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, list[int]]], rounds: int = 120, decay: float = 1e-4) -> Crf:
        """Maximum conditional likelihood by Adam, sequences of equal length at once."""
        k = len(TAGS)
        groups: dict[int, list] = {}
        for rows, tags in sequences:
            groups.setdefault(len(tags), []).append((rows, tags))
        batches = [(np.stack([r for r, _ in g]), np.array([t for _, t in g])) for g in groups.values()]
        total = sum(len(t) for _, t in batches)
        theta = np.zeros(k * N_FEATURES + k * k)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            emit, move = theta[: k * N_FEATURES].reshape(k, -1), theta[k * N_FEATURES :].reshape(k, k)
            g_emit, g_move = np.zeros_like(emit), np.zeros_like(move)
            for x, y in batches:
                s = x @ emit.T
                n, length = y.shape
                fwd, bwd = np.zeros_like(s), np.zeros_like(s)
                fwd[:, 0] = s[:, 0]
                for t in range(1, length):
                    z = fwd[:, t - 1][:, :, None] + move
                    top = z.max(1)
                    fwd[:, t] = s[:, t] + top + np.log(np.exp(z - top[:, None]).sum(1))
                for t in range(length - 2, -1, -1):
                    z = move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :]
                    top = z.max(2)
                    bwd[:, t] = top + np.log(np.exp(z - top[:, :, None]).sum(2))
                top = fwd[:, -1].max(1)
                norm = top + np.log(np.exp(fwd[:, -1] - top[:, None]).sum(1))
                p = np.exp(fwd + bwd - norm[:, None, None])
                hit = np.eye(k)[y]
                g_emit += np.einsum("ntk,ntf->kf", hit - p, x)
                for t in range(1, length):
                    both = np.exp(fwd[:, t - 1][:, :, None] + move + (s[:, t] + bwd[:, t])[:, None, :] - norm[:, None, None])
                    g_move += np.einsum("ni,nj->ij", hit[:, t - 1], hit[:, t]) - both.sum(0)
            grad = np.concatenate([g_emit.ravel(), g_move.ravel()]) / total - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return Crf(theta[: k * N_FEATURES].reshape(k, -1).copy(), theta[k * N_FEATURES :].reshape(k, k).copy())


def _spoiled(rng: np.random.Generator, front: str, parts: list[str], others: list[str], card_type: str) -> Iterator[tuple[list[str], list[int]]]:
    """Copies of a field, spoiled in each way, with the tags of their clauses."""
    words = parts[-1].split()
    if len(words) > 4 and ";" not in parts[-1]:
        cut = int(rng.integers(2, len(words)))
        kept = " ".join(words[:cut])
        end = rng.integers(6)
        if end == 0:
            kept = kept.rstrip(".,") + ","
        elif end == 1 and len(words[cut]) > 4:
            kept += " " + words[cut][: int(rng.integers(2, 4))] + "-"
        elif end == 2:
            kept = kept.rstrip(".,") + " …"
        elif end == 3 and len(words[cut]) > 4:
            kept += " " + words[cut][: int(rng.integers(2, 4))]
        elif end == 4:
            kept = kept.rstrip(".,") + " " + str(rng.choice(["because the", "and the", "of a", "which", "and"]))
        kept = kept.rstrip(".")
        yield [*parts[:-1], kept], [0] * (len(parts) - 1) + [4]
    refusal = clauses(made_refusal(rng))
    yield refusal, [1] * len(refusal)
    question = _CLOZE.sub(r"\1", front).strip()
    if len(question.split()) > 4:
        shape = rng.integers(5)
        lead = str(rng.choice(["Answer:", "A:", "Your question was:", "You are asking:", "So the question is"]))
        echo = (question, question.rstrip("?."), f"{lead} {question}", question.upper(), f'"{question}"')[shape]
        made = clauses(echo)
        yield made, [2] * len(made)
    if others:
        other = clauses(others[int(rng.integers(len(others)))])
        if other:
            yield other, [3] * len(other)


def fit(sample: list[tuple[str | None, str | None, str | None, str | None]], seed: int = 7, endings: Endings | None = None) -> tuple[Crf, Endings]:
    """CRF and endings from (front, back, extra, card_type) of a sample of cards;
    ``endings`` of more cards than the sample are used if given."""
    rng = np.random.default_rng(seed)
    known, endings = endings, endings or Endings()
    fields: list[tuple[str, str, list[str], bool, str]] = []
    by_lang: dict[int, list[str]] = {}
    for front, back, extra, kind in sample:
        lang = Front(front, kind).lang
        for text, is_extra in ((back, False), (extra, True)):
            if is_empty(text) or is_empty(front):
                continue
            parts = clauses(text)
            if not parts:
                continue
            if known is None:
                endings.learn_field(text, front, kind)
            fields.append((front, text, parts, is_extra, kind or ""))
            if lang >= 0 and len(text.split()) > 5:
                votes = language_votes(_WORD.findall(text.lower()), text)
                if votes.index(max(votes)) == lang:
                    by_lang.setdefault(lang, []).append(text)
    if known is None:
        endings.settle()
    foreign = {own: [t for lang, texts in by_lang.items() if lang != own for t in texts] for own in by_lang}
    sequences = []
    for front, _, parts, is_extra, kind in fields:
        asked = Front(front, kind)

        def rows(made: list[str]) -> np.ndarray:
            return np.array([features(c, asked, endings, i == 0, i == len(made) - 1, is_extra) for i, c in enumerate(made)])

        sequences.append((rows(parts), [0] * len(parts)))
        if rng.random() < 0.5:
            others = foreign.get(asked.lang, [])
            for made, tags in _spoiled(rng, front, parts, others, kind):
                sequences.append((rows(made), tags))
    if not sequences:
        return Crf(np.zeros((len(TAGS), N_FEATURES)), np.zeros((len(TAGS),) * 2)), endings
    crf = Crf.fit(sequences)
    crf.emit[:, 0] -= PRIOR
    return crf, endings


def judged(crf: Crf, endings: Endings, cards: Iterable[tuple[str | None, str | None, str | None, str | None]]) -> list[str | None]:
    """The defect of each (front, back, extra, card_type), or None. The first that holds:
    empty, refusal, copy, language, truncated. A tag holds for a field if its clauses
    cover enough of it."""
    out: list[str | None] = []
    fields: list[tuple[int, bool, list[str]]] = []
    rows: list[list[float]] = []
    for at, (front, back, extra, card_type) in enumerate(cards):
        out.append("empty" if is_empty(front) or is_empty(back) else None)
        if out[-1]:
            continue
        asked = Front(front, card_type)
        for text, is_extra in ((back, False), (extra, True)):
            parts = [] if is_empty(text) else clauses(text)
            if parts:
                fields.append((at, is_extra, parts))
                rows += [features(c, asked, endings, i == 0, i == len(parts) - 1, is_extra) for i, c in enumerate(parts)]
    if not rows:
        return out
    lengths = np.array([len(parts) for _, _, parts in fields])
    tags = crf.decode(np.array(rows), lengths)
    found: dict[int, set[str]] = {}
    for (at, is_extra, parts), start in zip(fields, np.cumsum(lengths) - lengths):
        own = tags[start : start + len(parts)]
        if not own.any():
            continue
        cover = np.bincount(own, [len(c) for c in parts], len(TAGS)) / sum(map(len, parts))
        holds = {"refusal": cover[1] >= 0.4, "copy": cover[2] >= 0.8 and not is_extra, "language": cover[3] >= 0.5, "truncated": own[-1] == 4}
        found.setdefault(at, set()).update(d for d, h in holds.items() if h)
    for at, kinds in found.items():
        out[at] = next((d for d in ("refusal", "copy", "language", "truncated") if d in kinds), None)
    return out


def pair_defect(crf: Crf, endings: Endings, front: str | None, back: str | None, extra: str | None, card_type: str | None) -> str | None:
    return judged(crf, endings, [(front, back, extra, card_type)])[0]


def all_endings(cards: DataFrame) -> Endings:
    """Endings of all distinct cards. Each task adds up its own counts first. Words
    and patterns are looked up only from three occurrences on and beginnings from
    two, so patterns that come up less than three times stay out of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Endings()
        for batch in batches:
            for front, back, extra, kind in zip(batch.front, batch.back, batch.extra, batch.card_type):
                for text in (back, extra):
                    own.learn_field(*(t if isinstance(t, str) else None for t in (text, front, kind)))
            if len(own.part) > HELD_PATTERNS:
                yield pd.DataFrame(own.counts(), columns=["counter", "key", "n"])
                own = Endings()
        yield pd.DataFrame(own.counts(), columns=["counter", "key", "n"])

    rows = cards.select("card_id", "front", "back", "extra", "card_type").distinct()
    counts = rows.mapInPandas(run, "counter string, key string, n bigint").groupBy("counter", "key").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "endings")
    pattern = F.col("counter").isin("whole", "part")
    both = counts.where(pattern).groupBy("key").agg(*(F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("whole", "part"))).where(F.col("whole") + F.col("part") >= 3)
    seen = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), "key", F.col(c).alias("n")) for c in ("whole", "part")))).alias("x")).select("x.*").where("n > 0")
    table_ = counts.where(~pattern).unionByName(seen).toPandas()
    return Endings.of_counts(table_.itertuples(index=False))


def drawn(rows: DataFrame, sample: int) -> list:
    """The ``sample`` distinct rows of least hash, in that order."""
    # Only rows whose hash falls below a bar go to the driver, about a fifth more than
    # wanted; sorting all rows would send ``sample`` rows of every task.
    rows = rows.distinct().withColumn("at", F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)))
    total = rows.count()
    bar = min(1.0, (1.2 * sample + 100) / max(total, 1))
    low = rows.where(F.col("at") < int(bar * (1 << 40))).collect()
    return sorted(low, key=lambda r: (r["at"], str(r)))[:sample]


def find_defects(cards: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(card_id, defect), one row per defective card.

    Every card is judged, and every card counts for the endings; only the fit of the
    CRF uses the sample. Null and blank fronts and backs are ``empty``; a null or
    blank extra is no defect; null ids come out as null; repeated rows count once; an
    empty table gives no rows. Should rows of one id differ, the first defect in
    alphabetical order is given.
    """
    spark = cards.sparkSession
    rows = cards.select("card_id", "front", "back", "extra", "card_type")
    crf, endings = fit([(r.front, r.back, r.extra, r.card_type) for r in drawn(rows, sample)], endings=all_endings(rows))
    shared = spark.sparkContext.broadcast((crf, endings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_crf, own_endings = shared.value
        for batch in batches:
            texts = [[t if isinstance(t, str) else None for t in batch[c]] for c in ("front", "back", "extra", "card_type")]
            made = batch[["card_id"]].assign(defect=judged(own_crf, own_endings, zip(*texts)))
            yield made[made.defect.notna()]

    return spread(rows).mapInPandas(run, "card_id string, defect string").groupBy("card_id").agg(F.min("defect").alias("defect"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_defects(table(spark, folder, "cards"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return p2_found(spark, folder).groupBy("defect").agg(F.count("*").alias("n_cards"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL: dict[str, str] = {}
