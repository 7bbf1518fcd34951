"""Scores of abusive, hateful and sexually explicit language.

A text is folded letter by letter: accents fall, look-alike letters of other
alphabets and digits or signs used as letters become the letters they stand for,
``i``, ``l``, ``1`` and ``|`` become one letter, and words written with spaces
or stars between their letters are put together again. An Aho-Corasick automaton
then finds all entries of a weighted lexicon at once. The lexicon is made by rule from
tables of words: insults with their endings, contempt and address that count together,
acts of violence with their victims, what groups are called and what is wished on them,
explicit words and words that are so only together. Exception phrases, in which the
words are used factually, are entries of the same automaton; each takes back the hits
inside it, or next to it where it speaks of a word, and no others. Weights are summed
per sentence and normalised by its length; a sentence counts from ``THRESHOLD`` on.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.llm.mixing import tidy_source
from cardmill.sources.tables import spread, table

THRESHOLD = 1.0
#: Sentences up to this many words are not normalised down.
USUAL_WORDS = 22

#: Words of the lexicon by kind, language and weight. ``PATTERNS`` makes
#: entries of them: ``*`` stands for the endings of the language.
INSULTS = {
    "en": "idiot* moron* imbecile* cretin* halfwit* dimwit* numbskull* numskull* nitwit* dunce* dolt* simpleton* blockhead* fool* loser* clown* creep* scumbag* sleazebag* dirtbag* lowlife* deadbeat* coward* weasel* wretch crybaby pig* swine rat* cockroach* maggot* leech* parasite* worm* snake* freak* psycho* retard* degenerate* pervert*",
    "de": "idiot* trottel* vollidiot* dummkopf* schwachkopf* blödmann* spinner* versager* penner* drecksack* mistkerl* schwein* ratte* abschaum missgeburt* depp* volltrottel* hohlkopf* lügner*",
    "fr": "idiot* imbécile* crétin* abruti* débile* minable* ordure* raclure* pourriture* bouffon* demeuré* cafard* porc* menteur* lâche*",
    "es": "idiota* imbécil* estúpido* estúpida* cretino* inútil* payaso* basura escoria cerdo* rata* cucaracha* mentiroso* cobarde* tarado* subnormal* asqueroso* asquerosa*",
}
CONTEMPT = {
    "en": "stupid useless worthless pathetic disgusting revolting filthy brainless braindead spineless gutless ugly dumb dumbest lousy vile repulsive miserable lying trash garbage scum filth dirt vomit puke scumbags",
    "de": "dumm* wertlos* erbärmlich* widerlich* ekelhaft* nutzlos* hirnlos* dreckig* verlogen* dreck müll scheisse",
    "fr": "stupide* inutile* minable* répugnant* dégoûtant* lamentable* sale* pathétique* cervelle merde",
    "es": "estúpido* inútil* asqueroso* repugnante* patético* despreciable* sucio* mierda basura",
}
#: Words and phrases that are abuse wherever they stand.
VULGAR = """asshole* | arsehole* | motherfucker* | cocksucker* | cunt* | dumbass* | dipshit* | shithead* | bastard* | son of a bitch | piece of shit | piece of trash | piece of garbage | piece of filth | bitch* | slut* | whore* | wanker* | prick* | douchebag* | fuckface*
    | fuck you | fuck off | go fuck | screw you | eat shit | shut the fuck up | shut your mouth | shut your face | shut your trap | drop dead | go to hell | rot in hell | burn in hell | kill yourself | kill yourselves | hang yourself | go hang | off yourself | end your life | waste of skin | waste of oxygen | waste of space | waste of air
    | wichser* | arschloch | arschlöcher | hurensohn | hurensöhne | fotze* | schlampe* | fick dich | verpiss dich | leck mich | halt die klappe | halt die fresse | halts maul | halt s maul | halt dein maul | halt deine fresse | stück dreck | stück scheisse | stück müll | bring dich um | verrecke*
    | connard* | connasse* | salope* | salaud* | enculé* | fils de pute | pute* | va te faire | ferme la | ferme ta gueule | ta gueule | sac à merde | va mourir | crève
    | hijo de puta | hijos de puta | puta* | cabrón | cabrones | gilipollas | pendejo* | maricón | vete a la mierda | cállate | cierra la boca | pedazo de basura | pedazo de mierda | púdrete | muérete | mátate"""
ADDRESS = """you are | you re | you were | you look | you sound | you smell | you write | you people | people like you | like you | as you | you and your | your kind | your face | your mother | your family | your stupid | your notes | your work | your ugly | yourself | you little | you stupid | you useless | you dumb | shut up | get lost | go away | go cry | go back | get out | crawl back | nobody wants | nobody likes | nobody would miss | nobody needs | nobody cares | no one wants | no one likes | no one would miss | everyone hates | who wrote | whoever wrote | written by | the author is | the editor is | makes me want to | make me want to | makes me sick | make me sick | what a waste | i hate | i despise | hope you | learn what | do us all a favour | do us all a favor
    | du bist | ihr seid | du dumm* | so dumm | wie du | dein gesicht | deine mutter | niemand braucht | niemand will | keiner braucht | keiner mag | hau ab | wer das geschrieben
    | tu es | vous êtes | espèce de | espèce d | pauvre | comme toi | ta mère | ta tête | personne ne veut | personne n aime | personne ne t | dégage | qui a écrit
    | eres un | eres una | sois unos | como tú | tu cara | tu madre | nadie quiere | nadie te | lárgate | quien escribió | maldito* | pedazo de"""
#: What threats are made of: acts of violence, whom they hit, and how they are announced.
VIOLENCE = "kill* murder* stab* shoot* strangle* choke* beat* hurt* punch* slap* kick* smash* crush* cut* gut* hang* burn* rape* torture* skin* bury* break* destroy* slit* bash* whip* batter* behead* poison* drown* hunt* shot beaten broken"
VICTIMS = "you | your | him | her | them | their | every bone | all of you | you all"
HARM = """every bone in | your bones | your skull | your throat | your teeth | your neck | your head | your legs | your hand | your hands | your fingers | your back | in your sleep | while you sleep | where you sleep | where you live | where you work | your children | your kids | your house | watch your back | a beating | until you bleed | you bleed | you bleeding | you will regret | you ll regret | you will pay | you are dead | you re dead | chokes on | choke on | beat you up | deserve to die | deserves to die | hope you die | hope you rot | wish you were dead | going to find you | will find you
    | schlage dir | schlag dir | brech dir | breche dir | ich töte | ich bringe dich um | die zähne ein | ich weiss wo du | du wirst bluten | ich mache dich fertig | ich stech*
    | casser la gueule | casser la figure | te casser | te tuer | vais te | te crever | te frapper | je sais où tu
    | romper la cara | partir la cara | romper los huesos | te voy a | voy a matar* | te mataré | sé dónde vives"""
ANNOUNCED = "i will | i ll | i am going to | i m going to | i am gonna | i m gonna | gonna | we will | we ll | someone should | somebody should | if you | or else | i swear | i hope | ich werde | wenn du | je vais | si tu | voy a | si vuelves"
#: What hatred of groups is made of.
BEASTS = "vermin rats animals beasts dogs pigs swine insects cockroaches parasites leeches maggots monkeys apes savages subhuman subhumans scum filth trash dirt garbage plague pest cancer disease thieves criminals liars rapists murderers terrorists degenerates"
DEHUMANISED = "subhuman* | untermensch* | inferior race | inferior breed | master race | exterminate them | gas them all"
BEAST_WORDS = "born thieves | born criminals | born liars | born killers | breed like | breeding like | multiply like | like rats | like cockroaches | like animals | inferior people | not human | not a human | not fully human | not a full human | not real people | less than human | less than animals | kein mensch | keine menschen | kein richtiger mensch | keine richtigen menschen | ungeziefer | abschaum | pas humain* | pas un être humain | pas des êtres humains | sous hommes | vermine | racaille | no son humanos | no son personas | una persona de verdad | personas de verdad | una plaga | una peste | escoria | alimañas"
REMOVED = "exterminated exterminate eradicated eradicate wiped shot hanged killed gassed burned burnt drowned deported expelled banned driven chased thrown kicked castrated sterilised sterilized enslaved locked caged removed"
REMOVAL = """gas the | death to | kill all | kill the | burn their | burn down their | wipe them out | wipe out the | get rid of the | got rid of the | rid of these | rid of all | send them back | deport them | throw them out | drive them out | kick them out | lynch* | ethnic cleansing is | do not deserve to live | don t deserve to live | deserve to be shot | no right to exist | no right to live | no right to be here | has no right to | have no right to | have no business | has no business | belong in the kitchen | do not belong here | don t belong here | keep them out | never let a | never trust a | never hire a | too stupid to | heads are too small | brains are too small | i despise all | i hate all
    | aus dem land | raus mit den | raus mit allen | vergasen | weg mit den | gehören ins lager | gehören aus | gejagt | vertrieben gehören | sie stehlen | hors du pays | chasser du pays | les chasser | il faut les | à mort les | ils volent | rentrez chez | fuera los | hay que echarlos | hay que matarlos | echarlos | muerte a los | roban tod*"""
GROUPED = "all of them | every one of them | every single one | these people | those people | people who | their kind | their houses | their homes | their children | everyone knows | for good | every last one | they touch | they are all | are all | they breed | they only | leave our | our country | our land | women | ningún | ningun* | kein | un pais | du pays | del país | alle raus | tous les | todos los"
#: Explicit words, and words that are explicit only beside others.
EXPLICIT = """porn* | porno* | pornographic | hardcore porn | blowjob* | handjob* | orgasm* | cumshot* | cum on | horny | masturbat* | jerk off | jerking off | gangbang* | threesome* | dildo* | deepthroat | creampie | milf* | sex tape* | sex video* | have sex | had sex | having sex | has sex | nude pics | nude photos | naked pics | naked photos | naked pictures | nudes | bare breasts | his cock | his dick | her pussy | her tits | her nipples | big tits | dick pic* | tight pussy | wet pussy | suck my | suck his | spread her legs | rode him | thrust into | inside her wet | moaned as | made her moan
    | nacktfoto* | nacktbild* | pornofilm* | geile* | sex hatten | hatten sex | hatte sex | ficken | gefickt | muschi | schwanz lutschen | titten
    | femmes nues | photos nues | photos de nus | baiser | sucer | bite dure | chatte | seins nus | faire l amour | fait l amour | jouir | coucher avec
    | mujeres desnudas | fotos desnudas | desnudas | tuvieron sexo | tener sexo | follar | follando | polla | tetas | coño | correrse | sexo oral"""
SUGGESTIVE = """naked | nude | sex | sexy | breasts | tits | moan* | panting | pant* | undress* | unzip* | unbutton* | stripped | strip naked | tore off | ripped off | took off their | their clothes | her clothes | his clothes | his trousers | her trousers | her dress | her bra | her panties | his belt | her thighs | her skin | kissed | came twice | came hard | climax* | aroused | erect | erection | lust | to bed | in bed | adults only | strictly adults | over eighteen | grown women | wet | hot | clips | until morning | all night
    | nackt* | sex auf | brüste | kleider vom leib | rissen sich | stöhn* | ab achtzehn | nu | nus | nue | nues | déshabill* | sexe | gémi* | excité* | sous les draps | pour adultes | desnud* | sexo | gemí* | adultos | se arrancaron | la ropa | excitad* | video* porno"""

#: Phrases of factual use. A phrase takes back the hits inside it and no others.
EXCEPTIONS = """naked eye | naked singularity | naked mole rat* | naked seed* | naked ape | sex ratio* | sex determination | sex chromosome* | sex linked | sex education | sex difference* | sex hormone* | sex cell* | same sex | breast muscle* | breast cancer | breast feeding | breast milk | breast tissue | blue tits | great tits | coal tits
    | kill the process | kill the stuck process | kill signal | kill command | kill switch | kill ratio | shoot apex | rats and other vermin | rats and mice | lab rats | laboratory rats | rat race | wet sand | bare rock | hot ash | wet season | wet bulb | clown fish | clownfish | guinea pigs | pig iron | worm gear | leech therapy | the parasite | parasite and | a parasite is | parasite of | host and parasite | cut them in | cut them into | beat them until | beat them with | break them into | break them down | burn them in | crush them | bury them | cut her | shot her | hunt them
    | prickly pear | prick the | death to life | whip them | skin them | drown them | poison them | destroy them | kill them"""
#: Words that speak of a word. ``BEFORE`` takes back a hit that follows within
#: ``REACH`` words, ``AFTER`` one that precedes it.
BEFORE = "the word | the words | the term | the terms | the insult | the insults | the slur | the slurs | the label | the expression | words like | words such as | insults like | insults such as | slurs like | slurs such as | called him | called her | called them | calls him | calls her | calls the | das wort | der ausdruck | die beleidigung | le mot | l insulte | le terme | la palabra | el término | el insulto"
AFTER = "is an insult | are insults | was an insult | as an insult | as insults | is a slur | are slurs | was a slur | as a slur | is an offensive word | is a word | is the word | is a term | are words | are terms | ist eine beleidigung | ist ein schimpfwort | est une insulte | es un insulto"
REACH = 3

#: Endings that ``*`` stands for.
ENDINGS = {
    "en": ("", "s", "es", "ed", "d", "ing", "ly"),
    "de": ("", "e", "en", "er", "es", "em", "n", "s"),
    "fr": ("", "e", "s", "es"),
    "es": ("", "s", "es"),
    "any": ("", "s", "es", "e", "en", "er", "ed", "d", "ing", "ion", "ions", "o", "a", "os", "as"),
}


def _endings(entry: str, language: str) -> Iterator[str]:
    """An entry with each ending; English verbs also double or drop their last letter."""
    if not entry.endswith("*"):
        yield entry
        return
    stem = entry[:-1]
    yield from (stem + e for e in ENDINGS[language])
    if language == "en" and stem[-1] == "e":
        yield from (stem[:-1] + e for e in ("ing", "ed"))
    elif language == "en" and stem[-1] in "bgnpt" and stem[-2] in "aeiou":
        yield from (stem + stem[-1] + e for e in ("ing", "ed"))


def _listed(block: str) -> list[str]:
    return [" ".join(e.split()) for e in block.split("|")]


def lexicon() -> Iterator[tuple[str, float, str]]:
    """(entry, weight, kind), made of the tables by rule."""
    for language, words in INSULTS.items():
        for word in words.split():
            yield from ((e, 0.7, "abuse") for e in _endings(word, language))
    for language, words in CONTEMPT.items():
        for word in words.split():
            yield from ((e, 0.45, "abuse") for e in _endings(word, language))
    for block, weight, kind in ((VULGAR, 1.2, "abuse"), (ADDRESS, 0.45, "abuse"), (HARM, 0.7, "abuse"), (ANNOUNCED, 0.3, "abuse"), (DEHUMANISED, 1.2, "hate"), (BEAST_WORDS, 0.8, "hate"), (REMOVAL, 0.7, "hate"), (GROUPED, 0.3, "hate"), (EXPLICIT, 1.2, "sexual"), (SUGGESTIVE, 0.45, "sexual")):
        for entry in _listed(block):
            yield from ((e, weight, kind) for e in _endings(entry, "any"))
    for act in VIOLENCE.split():
        for form in _endings(act, "en"):
            yield from ((f"{form} {victim}", 0.7, "abuse") for victim in _listed(VICTIMS))
    for beast in BEASTS.split():
        yield from ((f"{verb} {beast}", 0.8, "hate") for verb in ("are", "is", "are all", "are just", "are nothing but", "are a", "is a", "are subhuman", "as"))
    for fate in REMOVED.split():
        yield from ((f"{must} {fate}", 0.8, "hate") for must in ("should be", "must be", "ought to be", "should all be", "need to be", "have to be", "we should", "we must"))


#: Letters of other alphabets and signs that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "n", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i", "г": "r",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ɴ": "n", "ʀ": "r",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l", "|": "i",
}
_MARKED_INSIDE = re.compile(r"(?<=\w)[!|*](?=\w)")
_STARRED = re.compile(r"(?<!\w)\w\*+\w*(?:\*+\w*)*")
_SPACED = re.compile(r"(?<!\w)[^\W_](?:[ .\-_·][^\W_]){2,}(?![\w@$!|*])")


class _Fold(dict):
    """A table for ``str.translate``: one folded letter, a line end for what ends
    a sentence, else a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        made = self[code] = self.fold(char)
        return made

    @staticmethod
    def fold(char: str) -> str:
        if char in ".!?\n\r;¡¿":
            return "\n"
        out = []
        for c in unicodedata.normalize("NFKD", char).casefold():
            c = LOOKALIKES.get(c, c)
            if c.isascii() and c.isalpha():
                out.append(c.replace("l", "i"))
            elif not unicodedata.combining(c[0]) and unicodedata.category(c[0]) not in ("Cf", "Mn"):
                out.append(" ")
        return "".join(out)


_FOLD = _Fold()
_SPACES = re.compile(" {2,}")


def fold(text: str) -> str:
    return _SPACES.sub(" ", text.translate(_FOLD))


class Scorer:
    """The automaton and the table of starred words, built once per worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.by_shape: dict[tuple[str, str, int], str] = {}
        entries: dict[str, tuple[float, str]] = {}
        for entry, weight, kind in lexicon():
            key = fold(entry).strip()
            if weight > entries.get(key, (0.0, ""))[0]:
                entries[key] = (weight, kind)
            if weight >= 0.45 and " " not in entry:
                self.by_shape.setdefault((fold(entry[0]), fold(entry[-1]), len(entry)), entry)
            for word in entry.split():
                if len(word) > 3:
                    self.by_shape.setdefault((fold(word[0]), fold(word[-1]), len(word)), word)
        found: dict[str, list[tuple[float, str]]] = {entry: [(weight, kind)] for entry, (weight, kind) in entries.items()}
        for block, kind in ((EXCEPTIONS, "inside"), (BEFORE, "before"), (AFTER, "after")):
            for entry in _listed(block):
                for form in _endings(entry, "any"):
                    found.setdefault(fold(form).strip(), []).append((0.0, kind))
        for entry, marks in found.items():
            self.automaton.add_word(f" {entry} ", (entry, marks))
        self.automaton.make_automaton()
        #: single words sought inside letters written apart, where borders are unsure
        self.apart = ahocorasick.Automaton()
        for word in {e for e, (w, _) in entries.items() if w >= 0.45 and " " not in e and len(e) > 2} | {w for e, (weight, _) in entries.items() if weight >= 0.7 for w in e.split() if len(w) > 4}:
            self.apart.add_word(word, word)
        self.apart.make_automaton()

    def unstar(self, found: re.Match) -> str:
        word = found.group()
        last = word[-1]
        if last == "*":
            return word
        return self.by_shape.get((fold(word[0]), fold(last), len(word)), word)

    def join(self, found: re.Match) -> str:
        return " ".join(self._parted(re.sub(r"[ .\-_·]", "", found.group())))

    def _parted(self, letters: str) -> list[str]:
        """Letters written apart, cut where known words are, the longest first."""
        folded = fold(letters)
        if len(folded) != len(letters):
            return [letters]
        hits = sorted(((end + 1 - len(word), end + 1) for end, word in self.apart.iter(folded)), key=lambda h: (h[0] - h[1], h[0]))
        free, kept = bytearray(b"\x01" * len(folded)), []
        for start, end in hits:
            if all(free[start:end]):
                free[start:end] = bytes(end - start)
                kept.append((start, end))
        out, at = [], 0
        for start, end in sorted(kept):
            out += [letters[at:start], f" {folded[start:end]} "]
            at = end
        return [p for p in [*out, letters[at:]] if p]

    def sentences(self, text: str) -> list[tuple[float, float, set[str]]]:
        """(score, weight, kinds) of the sentences in which an entry was found. Each
        entry counts once a sentence; a hit that an exception covers doesn't count."""
        if "*" in text:
            text = _STARRED.sub(self.unstar, text)
        text = _SPACED.sub(self.join, text)
        text = _MARKED_INSIDE.sub("i", text)
        folded = f" {fold(text)} ".replace("\n", " \n ").replace("  ", " ")
        by_sentence: dict[int, list[tuple[int, int, str, list[tuple[float, str]]]]] = {}
        begin, after = -1, folded.find("\n")  # of the sentence that holds the hit
        for end, (entry, marks) in self.automaton.iter(folded):
            while -1 < after < end:
                begin, after = after, folded.find("\n", after + 1)
            by_sentence.setdefault(begin, []).append((end - len(entry), end, entry, marks))
        out = []
        for begin, hits in by_sentence.items():
            if sum(w for h in hits for w, _ in h[3]) < 0.05:
                continue
            spans = sorted(self.covered(folded, hits))
            begins, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
            counted = {}
            for start, end, entry, marks in hits:
                before = bisect_right(begins, start)
                if before and reach[before - 1] >= end:
                    continue  # inside a span that takes it back
                for weight, kind in marks:
                    if weight:
                        counted[entry] = (weight, kind)
            # an entry inside a longer one is the same hit
            whole = {e: v for e, v in counted.items() if not any(e != o and f" {e} " in f" {o} " and v[0] <= counted[o][0] for o in counted)}
            weight = sum(w for w, _ in whole.values())
            if weight > 0:
                stop = folded.find("\n", begin + 1)
                n_words = folded.count(" ", begin + 1, stop if stop >= 0 else len(folded))
                out.append((weight / max(1.0, n_words / USUAL_WORDS), weight, {k for _, k in whole.values()}))
        return out

    @staticmethod
    def covered(folded: str, hits: list[tuple[int, int, str, list[tuple[float, str]]]]) -> list[tuple[int, int]]:
        """Spans whose hits are taken back: exception phrases, and ``REACH`` words after
        or before words that speak of a word."""
        spans = []
        for start, end, _, marks in hits:
            for _, kind in marks:
                if kind == "inside":
                    spans.append((start, end))
                elif kind == "before":
                    stop = end
                    for _ in range(REACH):
                        stop = folded.find(" ", stop + 1) if stop >= 0 else stop
                    spans.append((start, stop if stop >= 0 else len(folded)))
                elif kind == "after":
                    begin = start
                    for _ in range(REACH):
                        begin = folded.rfind(" ", 0, begin) if begin > 0 else begin
                    spans.append((max(begin, 0) - 1, end))
        return spans


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    return Scorer()


SCORES = "doc_id bigint, source string, n_words int, score double, peak double, flagged boolean, abuse boolean, hate boolean, sexual boolean"


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scorer()
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            if not text:
                rows.append((0, 0.0, 0.0, False, False, False, False))
                continue
            found = own.sentences(text)
            n_words = text.count(" ") + 1
            peak = max((s for s, _, _ in found), default=0.0)
            strong = [f for f in found if f[0] >= THRESHOLD]
            kinds = set().union(*(k for _, _, k in strong)) if strong else set()
            total = sum(w for _, w, _ in strong)
            rows.append((n_words, 100.0 * total / max(n_words, 100), peak, bool(strong), "abuse" in kinds, "hate" in kinds, "sexual" in kinds))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int32(), pa.float64(), pa.float64(), *[pa.bool_()] * 4]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[c.split(" ")[0] for c in SCORES.split(", ")])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, tidy source, n_words, score (weight of the sentences at or above the
    threshold per 100 words, of at least 100), peak (best sentence), flagged, and
    the kinds found. Empty and null texts score 0; null sources stay null; rows
    are scored one by one, so repeats repeat; whole texts are read."""
    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tidy_source(F.col("source")).alias("source"), "text")).mapInArrow(_score, SCORES)


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).where("flagged").select("doc_id").distinct()


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return p9_scores(spark, folder).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"),
        F.count_if("abuse").alias("abuse"), F.count_if("hate").alias("hate"), F.count_if("sexual").alias("sexual"),
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
