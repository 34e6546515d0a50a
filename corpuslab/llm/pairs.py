"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.skew import join_unique
from corpuslab.session import cut_lineage

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"\d+(?:[.:,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?…]+|[,;:]|[\n\0]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_CLAUSE = re.compile(r"[.!?…,;:—–\n]+")
_QUOTED = re.compile(r"[“\"«„][^“”\"«»„]{0,80}[”\"»“]")
_CLOSERS, _ENDS = "\"'”’»)]", tuple(".!?")
_OPENED = re.compile(r"[“\"«„]")
_SAID = re.compile(r"[^\W_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

#: Answers that hold a place and say nothing, without outer punctuation and in lower case.
PLACEHOLDERS = frozenset(
    "|n/a|na|n.a|none|null|nil|tbc|tbd|tba|todo|to be added|to be confirmed|to be decided|to follow|pending|coming soon|"
    "placeholder|no answer|empty|blank|test|lorem ipsum|xxx|folgt|à compléter|por definir|a definir|por completar|volgt|k.a|s/o".split("|")
)

#: Words of greeting, thanks and talk about the question itself, which answer nothing.
ACKNOWLEDGING = frozenset(
    "re fw fwd thanks thank great good question questions query queries enquiry inquiry message q a hello hi dear regards please ok okay sure well "
    "asking asked asks ask pleased glad happy welcome appreciate appreciated receive received receiving noted reply replying contacting writing "
    "subject copy danke vielen frage anfrage merci bonne demande gracias pregunta consulta buena bedankt dank vraag goede obrigado obrigada pergunta boa".split()
)

#: Words that are an answer by themselves although they are frequent function words.
ANSWERING = frozenset("yes no ja nein oui non sí nee sim não never always".split())

#: Frequent function words of each language.
STOPWORDS = {
    "en": "the of and to in is are for on at by with from who what which when where how do does can may our we you your be must will not or an it its has have each after before this that their if than up until during most since yes no there need",
    "de": "der die das den dem des und ist sind für auf mit in von im am zum zur bei nicht wir ihr sich ein eine einen einer wird werden vom aus bis wo wie wann wer müssen noch dort hat haben um an zu ab so",
    "fr": "le la les de des du et est sont pour sur dans avec qui au aux un une ne pas où quand comment combien par se ce cette sa son ses leur il faut que chaque nous avons dès à avant en sera",
    "es": "el la los las de del y en es son para con por un una que quien quién cuándo cuánto dónde hay se su sus al no hemos antes más cada este esta como desde hasta a",
    "nl": "het de een van en is in zijn voor op met bij wie wat waar wanneer hoe we niet te naar om aan wordt worden dat die nog dit moeten hoeveel er als alle gaat komt uur onze deze zo hebben geen",
    "pt": "o a os as de do da dos das e em é são para com por um uma que quem quando quanto onde no na nos nas ao aos se sua não antes este esta como ainda temos têm qualquer até pelo pela",
}
_FUNCTION_WORDS = frozenset(w for words in STOPWORDS.values() for w in words.split()) - ANSWERING

#: Articles, possessives, conjunctions and prepositions after which a sentence of the language goes on.
CONNECTORS = {
    "en": "the a an and or but because if that which whose my your our their its of from at with into between during than per very",
    "de": "der die das den dem des ein eine einen einem einer und oder aber weil dass wenn mit von für bei zum zur vom im ins",
    "fr": "le la les un une des du de et ou mais que qui pour par avec dans sur aux au leur sa son ses ma mon sans chez",
    "es": "el la los las un una de del y o pero que para por con en al su sus sin",
    "nl": "de het een en of maar dat van met",
    "pt": "o a os as um uma de do da dos das e ou mas que para por com em no na ao à seu sua sem",
}
_CONNECTORS = {lang: frozenset(words.split()) for lang, words in CONNECTORS.items()}

#: How a text declines or says that it does not know, as sequences of word classes; `a|b` are alternatives.
REFUSAL_FORMS = (
    # English: somebody - cannot or will not - answers
    ("i|we", "can't|cannot|can not|could not|couldn't|am unable to|are unable to|am not able to|are not able to|won't|will not|would rather not|would prefer not to|prefer not to|must decline to|have to decline to|decline to|am not in a position to|are not in a position to|am not allowed to|don't want to",
     "answer|respond|reply|comment|say|tell|advise|assist|help with this|help with that|help with it|help you|help here|find that|find this|find it|find any|find anything|find the answer|find an answer|locate|give an answer|give you an answer|give that|provide an answer|provide that|provide this|provide details|provide information|share that|share this|discuss this|discuss that"),
    ("i'm unable to|we're unable to|i'm not able to|we're not able to|i'd rather not|we'd rather not|i'd prefer not to|we'd prefer not to|i'm not in a position to|i'm not allowed to",
     "answer|respond|reply|comment|say|tell|advise|assist|help with this|help with that|help with it|help you|help here|find that|find this|find it|find any|find anything|find the answer|locate|give an answer|give you an answer|give that|provide an answer|provide that|provide this|provide details|provide information|share that|share this|discuss this|discuss that"),
    ("i|we", "must decline|have to decline|don't know|do not know|have no idea|have no information|have no details|have no answer|have no knowledge|have no data|have no record"),
    ("i|we", "don't have|do not have|lack", "any details|any information|any data|that information|this information|information|the information|enough information|an answer|the answer|that answer|access to"),
    ("i'm not sure|i am not sure|i'm afraid i don't know|i'd rather leave|i would rather leave|we'd rather leave|we would rather leave|something i can't|something i cannot|not something i can|not something we can",),
    ("outside|beyond", "what", "i can|we can"),
    ("outside|beyond", "my|our", "remit|scope|knowledge|expertise|competence|reach|brief"),
    ("no way", "for me to tell|for us to tell|to tell|of knowing|for me to know|to know"),
    ("nothing in", "the|my|our|these", "handbook|documents|sources|pages|guide|notes|text"),
    ("handbook|documents|guide|pages|sources|text|manual|notes", "do not|does not|don't|doesn't", "say|mention|cover|tell|state|answer"),
    ("not covered|not mentioned|not stated|not answered|not addressed", "in|by", "the|my|our", "handbook|documents|guide|pages|sources|text|manual|notes"),
    ("the answer|that|this|it", "is not known|is unknown|isn't known"),
    ("no information available|no information on|no details available",),
    # German
    ("kann|können", "ich|wir", "ihnen|dir|euch|das|dies|diese frage|dazu|darauf|hierzu|dabei", "leider|", "nicht|keine|nichts", "beantworten|sagen|antworten|helfen|antwort|auskunft|angaben"),
    ("ich|wir", "kann|können", "das|dies|diese frage|dazu|darauf|hierzu|ihnen", "leider|", "nicht|keine|nichts", "beantworten|sagen|antworten|helfen|antwort|auskunft|angaben"),
    ("das|dies|diese frage|dazu|darauf|hierzu", "kann|können", "ich|wir", "leider|", "nicht|keine|nichts", "beantworten|sagen|antworten|helfen|antwort|auskunft|angaben"),
    ("liegen|liegt", "mir|uns", "dazu|darüber|", "leider|", "keine|nichts"),
    ("dazu|darüber|hierzu", "steht|finde ich|habe ich|haben wir", "leider|", "nichts|keine"),
    ("steht nichts im|steht nicht im|nicht im", "handbuch"),
    ("ich habe|wir haben", "dazu|darüber|hierzu|leider|", "keine", "information|informationen|angaben|auskunft|antwort|ahnung"),
    ("das weiß ich|ich weiß es|ich weiß das|weiß ich|ich weiß", "leider|", "nicht"),
    ("ist mir|ist uns", "leider|", "nicht bekannt"),
    # French
    ("je|nous", "ne", "peux|pouvons|suis|sommes|souhaite|préfère", "pas", "répondre|vous|y|en mesure|le|dire|commenter"),
    ("je ne sais pas|nous ne savons pas|je l'ignore|nous l'ignorons|impossible de répondre|impossible de vous répondre|je préfère ne pas|n'en parle pas|n'en disent rien",),
    ("je n'ai|nous n'avons|je ne dispose|nous ne disposons", "aucune|aucun|pas|pas d'|d'aucune", "information|renseignement|d'information|d'informations|cette information|l'information|de cette information|la réponse|réponse|idée"),
    ("ne dit rien|ne disent rien|ne précise rien", "à ce sujet|sur|là"),
    # Spanish
    ("no puedo|no podemos|no sé|no sabemos|no estoy en condiciones de|prefiero no|preferimos no", "responder|contestar|decirle|decirlo|decir|ayudarle|ayudar|comentar|opinar"),
    ("no dispongo de|no disponemos de|no tengo|no tenemos", "esa información|información|esos datos|datos|ese dato|la respuesta|detalles|ningún dato|ninguna información"),
    ("no lo sé|no lo sabemos|no me consta|lo desconozco|desconozco la respuesta",),
    ("el manual|la guía|el documento|los documentos", "no", "dice|dicen|menciona|mencionan", "nada|"),
    # Dutch
    ("daar|hier|dat|deze vraag|die vraag", "kan|kunnen", "ik|we|wij", "helaas|", "geen antwoord|niet beantwoorden|niets over zeggen|geen uitspraak|niet op antwoorden|niet mee helpen"),
    ("ik|we|wij", "kan|kunnen", "deze vraag|die vraag|dat|dit|hier|daar|u", "helaas|", "niet beantwoorden|geen antwoord|niet zeggen|niet helpen|niet mee helpen"),
    ("ik heb|we hebben|wij hebben", "daar|hier|er|daarover|hierover|", "helaas|", "geen", "gegevens|informatie|antwoord|idee"),
    ("zegt|zeggen|staat|vermeldt", "hier|daar|er|hierover|daarover", "niets"),
    ("ik weet het|dat weet ik|dat weet ik helaas|ik weet dat|weet ik", "niet"),
    ("staat niet in het handboek|zeg ik liever niet|geef ik liever geen antwoord",),
    # Portuguese
    ("não consigo|não posso|não podemos|não sei|não sabemos|prefiro não|preferimos não", "responder|ajudar|dizer|comentar|opinar"),
    ("não tenho|não temos|não disponho de|não dispomos de", "essa informação|informação|informações|esses dados|dados|a resposta|detalhes|nenhuma informação|dessa informação"),
    ("não sei|desconheço a resposta|não me compete responder",),
    ("o manual|o guia|o documento|os documentos", "não", "diz|dizem|menciona|mencionam", "nada|"),
    # Italian, Catalan, Danish, Swedish, Polish
    ("non", "posso|possiamo|sono in grado di|siamo in grado di|so|riesco a", "rispondere|dire|dirlo|aiutare|aiutarla|commentare|trovare"),
    ("non lo so|non lo sappiamo|non saprei|non ho informazioni|non ho questa informazione|non ho dati|non dispongo di|preferisco non rispondere|il manuale non dice",),
    ("no ho sé|no puc respondre|no tinc aquesta informació|jeg ved det ikke|det ved jeg ikke|kan jeg ikke svare|jag vet inte|det vet jag inte|kan jag inte svara|nie wiem|nie mogę odpowiedzieć",),
)

#: Words that put what follows under a condition or into the mouth of somebody else.
_REPORTED = frozenset(
    "if when whenever unless says say said sign reads asks whoever anyone who wenn sagt sagen wer si dit disent quand quiconque cuando dice dicen quien als zegt zeggen wie se quando diz dizem quem".split()
)
#: Words that turn a sentence.
_TURNS = frozenset("but however instead although aber jedoch mais toutefois pero maar mas porém ma però".split())
#: First words of sentences that send the reader elsewhere.
_REFERRING = frozenset(
    "please try contact ask see call check speak email write bitte fragen wenden veuillez contactez demandez contacte pregunte póngase por neem vraag contacteer pergunte contacte fale rivolgersi contatti".split()
)
#: Words that may stand anywhere in a refusal without changing it.
_FILLERS = frozenset("really simply just also currently sadly unfortunately definitely honestly actually sorry".split())


class SuffixAutomaton:
    """The suffix automaton of a sequence: it accepts exactly the stretches of it."""

    def __init__(self, symbols: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for x in symbols:
            cur = self._state(self.length[last] + 1, {}, -1)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][x]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = twin
                        p = self.link[p]
                    self.link[q] = self.link[cur] = twin
            last = cur

    def _state(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def match_lengths(self, symbols: list[str]) -> list[int]:
        """For each place the length of the longest stretch of the sequence that ends there."""
        out, state, size = [], 0, 0
        for x in symbols:
            while state and x not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if x in self.next[state]:
                state = self.next[state][x]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def covered_words(question: list[str], answer: list[str], least: int = 2) -> tuple[list[bool], float]:
    """Which words of the answer stand in copied stretches of `least` words or more, and the longest as a share of the question."""
    if not question or not answer:
        return [False] * len(answer), 0.0
    lengths = SuffixAutomaton(question).match_lengths(answer)
    covered = [False] * len(answer)
    longest, reach = 0, len(answer)
    for i in range(len(answer) - 1, -1, -1):  # from the right, so that overlapping stretches are walked once
        if lengths[i] >= min(least, len(answer)):
            longest = max(longest, lengths[i])
            reach = min(reach, i - lengths[i] + 1)
        covered[i] = reach <= i
    return covered, longest / len(question)


def copies(question: list[str], text: str, answer: list[str], share: float = 0.5) -> bool:
    """Whether an answer gives back the question and nothing of substance besides.

    At least `share` of the question must stand in it in one stretch. What is left of each of its clauses says nothing
    if it has no content word (no function word of any of the languages), or no more of them than words that greet,
    thank or speak of the question.
    """
    wanted = set(question)
    if not question or len(wanted.intersection(answer)) < share * len(question) - (len(question) - len(wanted)):
        return False  # too few words in common for such a stretch, whatever their order
    covered, longest = covered_words(question, answer)
    if longest < share:
        return False
    at = 0
    for clause in _CLAUSE.split(text):
        n = len(_WORD.findall(clause))
        left = [w for w, c in zip(answer[at : at + n], covered[at : at + n], strict=False) if not c]
        at += n
        kind = sum(w in ACKNOWLEDGING for w in left)
        content = sum(w not in ACKNOWLEDGING and w not in _FUNCTION_WORDS for w in left)
        if content > kind:
            return False
    return True


def phrases_of(forms: tuple[tuple[str, ...], ...]) -> Iterator[list[str]]:
    """The phrases of all forms, as words."""
    for form in forms:
        for parts in product(*[x.split("|") for x in form]):
            yield _WORD.findall(" ".join(parts))


def phrase_automaton(forms: tuple[tuple[str, ...], ...]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Aho-Corasick automaton over the words of all forms: transitions, failure links and the length of the phrase that ends in a state."""
    steps: list[dict[str, int]] = [{}]
    fail, ends = [0], [0]
    for words in phrases_of(forms):
        state = 0
        for w in words:
            if w not in steps[state]:
                steps[state][w] = len(steps)
                steps.append({})
                fail.append(0)
                ends.append(0)
            state = steps[state][w]
        ends[state] = len(words)
    queue = list(steps[0].values())
    for state in queue:
        for w, to in steps[state].items():
            back = fail[state]
            while back and w not in steps[back]:
                back = fail[back]
            fail[to] = steps[back].get(w, 0)
            ends[to] = max(ends[to], ends[fail[to]])
            queue.append(to)
    return steps, fail, ends


REFUSAL_AUTOMATON = phrase_automaton(REFUSAL_FORMS)
#: The longest word of every phrase of the automaton that is no function word; a text without any of them is no refusal.
_ANCHORS = frozenset(max(words, key=lambda w: (w not in _FUNCTION_WORDS, len(w))) for words in phrases_of(REFUSAL_FORMS))


def _refusal_at(words: list[str]) -> tuple[int, int] | None:
    """Where the first phrase of the refusal automaton starts and ends among words, None if there is none."""
    steps, fail, ends = REFUSAL_AUTOMATON
    state = 0
    for i, w in enumerate(words):
        while state and w not in steps[state]:
            state = fail[state]
        state = steps[state].get(w, 0)
        if ends[state]:
            return i - ends[state] + 1, i + 1
    return None


def refuses(text: str, lead: int = 8) -> bool:
    """Whether a text declines to answer or says that it does not know.

    A phrase of the refusal automaton must open one of its sentences, after at most `lead` words, outside quotes and not
    under a condition or in reported speech, and no substance may follow: a turn with four or more words after it, or
    another sentence of four or more words that neither asks, thanks nor sends the reader elsewhere.
    """
    low = text.lower().replace("’", "'")
    if _ANCHORS.isdisjoint(_WORD.findall(low)):
        return False
    found, substance = False, False
    for sentence in _SENTENCE.split(_QUOTED.sub(" ", low)):
        words = [w for w in _WORD.findall(sentence) if w not in _FILLERS]
        if not words:
            continue
        at = _refusal_at(words)
        if at is not None and at[0] <= lead and not _REPORTED.intersection(words[: at[0]]):
            found = True
            rest = words[at[1] :]
            turn = next((i for i, w in enumerate(rest) if w in _TURNS), len(rest))
            tail = [w for w in rest[turn + 1 :] if w not in ACKNOWLEDGING]
            substance |= len(tail) >= 4 and tail[0] not in _REFERRING and rest[turn] != "instead"
        elif len(words) >= 4 and words[0] not in _REFERRING and not sentence.rstrip().endswith("?"):
            substance |= sum(w in ACKNOWLEDGING for w in words) * 2 < sum(w not in _FUNCTION_WORDS for w in words)
    return found and not substance


def open_delimiters(text: str) -> int:
    """Opening brackets and quotes without their closing one, by a stack."""
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    stack: list[str] = []
    for ch in text:
        if ch in "([{“«":
            stack.append(ch)
        elif ch in pairs and stack and stack[-1] == pairs[ch]:
            stack.pop()
    return len(stack)


#: Votes are kept as one whole number per word, a field for each language, in units of 1 / 60 (so that halves to sixths are whole).
_UNIT, _FIELD = 60, 40
_FULL = (1 << _FIELD) - 1


class _Packed(dict):
    """Votes by word; a word without any has 0."""

    def __missing__(self, word: str) -> int:
        return 0


class Votes:
    """Votes of words for languages: stopwords, split where languages share one, and words of labelled samples in one language only."""

    def __init__(self, samples: list[tuple[str | None, str | None]]) -> None:
        self.langs = list(STOPWORDS)
        seen: dict[str, set[str]] = {}
        for lang, words in STOPWORDS.items():
            for w in words.split():
                seen.setdefault(w, set()).add(lang)
        shared = set(seen)
        for lang, text in samples:
            for w in _WORD.findall((text or "").lower()):
                if lang in STOPWORDS and w not in shared and w.isalpha():
                    seen.setdefault(w, set()).add(lang)
        self.of = _Packed({w: sum(_UNIT // len(langs) << _FIELD * self.langs.index(x) for x in langs) for w, langs in seen.items() if w in shared or len(langs) == 1})

    def count(self, words: list[str]) -> list[float]:
        """The sum of the votes for each language."""
        of = self.of
        total = sum(map(of.__getitem__, words))
        for w in words:
            if "'" in w and w not in of:
                total += sum(map(of.__getitem__, w.split("'")))
        return [(total >> _FIELD * k & _FULL) / _UNIT for k in range(len(self.langs))]

    def winner(self, total: list[float]) -> tuple[int, float]:
        """The language with most votes and its lead over the next; -1 without a lead."""
        first, second = sorted(total, reverse=True)[:2]
        return (total.index(first) if first > second else -1), first - second


#: A whole answer of at most so many tokens may be a phrase ("The head coach") rather than a sentence.
BRIEF = 5
#: Tokens up to which contexts are looked up.
LONGEST = 4
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1 << 18)
def _token_hash(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _canonical(token: str) -> str:
    """The token that contexts hold: '#' for numbers, '^' for ends of sentences, lines and texts."""
    return "#" if token[0].isdigit() else "^" if token[0] in ".!?…\n\0" else token


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tail_contexts(text: str, longest: int = LONGEST) -> tuple[list[int], int]:
    """The contexts of an unfinished end and the number of tokens of the whole text.

    First that of the last token as the start of a longer word, after the token before it (0 for numbers and where there
    is none), then those of the last 1 to `longest` tokens of the sentence, with '^' for its start. Contexts are 64-bit
    hashes; two of them being the same by chance is out of the question at any corpus size.
    """
    tokens = [t for t in _TOKEN.findall(text.lower())]
    whole = sum(t[0] not in ".!?…\n\0" for t in tokens)
    names = ["^", *map(_canonical, tokens)]
    start = max(i for i, t in enumerate(names) if t == "^" and i < len(names) - 1)
    names = names[start:]
    if whole <= BRIEF:
        names = [t for t in names if t != "^"]
    half = 0
    if len(names) > 1 and names[-1].isalpha():
        half = (_token_hash(names[-1] + "*") + _STEP * _token_hash(names[-2])) & _MASK
    out, value, power = [_signed(half)], 0, 1
    for k in range(1, min(longest if whole > BRIEF else 2, len(names)) + 1):
        value = (value + power * _token_hash(names[-k])) & _MASK
        power = power * _STEP & _MASK
        out.append(_signed(value))
    return out, whole


def _closed(text: str) -> str:
    """A text, with a full stop if it is brief and has no end: brief answers tell where brief answers end."""
    if len(text) < 80 and (text := text.rstrip()) and text.rstrip(_CLOSERS)[-1:] not in _ENDS and 0 < len(_TOKEN.findall(text)) <= BRIEF:
        return text + "."
    return text


class Continuations:
    """Counts of how sentences go on after contexts, over batches of texts, in arrays."""

    def __init__(self, longest: int = LONGEST) -> None:
        self.longest = longest
        self.number: dict[str, int] = {}
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.starts: list[list[int]] = []

    def _new(self, token: str) -> int:
        name = _canonical(token)
        if name == "#" and "#" in self.number:
            return self.number["#"]
        n = len(self.hash)
        self.number["#" if name == "#" else token] = n
        self.hash.append(_token_hash(name))
        self.kind.append(0 if name != "^" else 1 if token[0] in ".!?…" else 2)
        self.starts.append([_token_hash(token[:i] + "*") for i in range(2, len(token))] if name.isalpha() else [])
        return n

    def counts(self, texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`(context, total, ended)`: how often a context stands before another token or the end of its sentence, and the latter.

        What an unclosed last sentence goes on with is not known and does not count. `wanted` is a table of bits, by the
        last bits of the context, outside of which nothing is counted.
        """
        number, new = self.number, self._new
        ids = np.array([number[t] if t in number else new(t) for t in _TOKEN.findall("\0" + "\0".join(texts).lower() + "\0")], np.int64)
        own, kind = np.array(self.hash, np.uint64)[ids], np.array(self.kind, np.int8)[ids]
        at = np.arange(len(ids))
        bound = np.maximum.accumulate(np.where(kind > 0, at, -1))
        following = np.append(kind[1:], 2)
        counted = (kind == 0) & (following < 2)
        keys, ended = [], []

        def keep(context: np.ndarray, end: np.ndarray) -> None:
            if wanted is not None:
                low = (context & np.uint64(len(wanted) * 8 - 1)).astype(np.int64)
                on = (wanted[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                context, end = context[on], end[on]
            keys.append(context)
            ended.append(end)

        value, power = np.zeros(len(ids), np.uint64), 1
        for k in range(1, self.longest + 1):
            value[k - 1 :] += own[: len(own) - k + 1] * np.uint64(power)
            power = power * _STEP & _MASK
            valid = counted & (at - k + 1 >= bound)
            keep(value[valid], following[valid] == 1)
        sizes = np.array([len(s) for s in self.starts], np.int64)
        firsts = np.append(0, np.cumsum(sizes))
        flat = np.array([x for s in self.starts for x in s], np.uint64)
        word = np.flatnonzero(kind == 0)
        word = word[sizes[ids[word]] > 0]
        n = sizes[ids[word]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        halves = flat[np.repeat(firsts[ids[word]], n) + inside] + np.repeat(own[word - 1], n) * np.uint64(_STEP)
        keep(halves, np.zeros(len(halves), bool))
        context, place, total = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        return context.view(np.int64), total, np.bincount(place, np.concatenate(ended), len(context)).astype(np.int64)


def judge_pair(question: str | None, answer: str | None, votes: Votes) -> tuple[str | None, str | None, float, list[int], int]:
    """`(defect, other, prior, contexts, tokens)` of a pair.

    `defect` is what the pair alone shows. Where only the missing end of the last sentence is in doubt, `contexts` holds
    the hashed ends of it, `prior` the chance that it is complete where nothing is known of them (0 after a word of the
    answer's language that never ends a sentence, else 1) and `other` the defect that is left if the answer is complete.
    """
    text = (answer or "").replace("\xa0", " ").strip()
    if not _SAID.search(text) or len(text) < 40 and _EDGES.sub("", text).lower() in PLACEHOLDERS:
        return "empty", None, 1.0, [], 0
    low = text.lower().replace("’", "'")
    words = _WORD.findall(low)
    asked = _asked(question or "")
    if copies(asked, low, words):
        return "copy", None, 1.0, [], 0
    if not _ANCHORS.isdisjoint(words) and refuses(text):
        return "refusal", None, 1.0, [], 0
    closed = text.rstrip(_CLOSERS)[-1:] in _ENDS
    if text[-1] in "…,;:-–—" or text.endswith("..."):
        return "truncated", None, 1.0, [], 0
    if not closed and open_delimiters(text):
        return "truncated", None, 1.0, [], 0
    q_lang, _ = votes.winner(votes.count(asked))
    given = votes.count(_WORD.findall(_QUOTED.sub(" ", low)) if _OPENED.search(low) else words)
    a_lang, lead = votes.winner(given)
    other = "other_language" if 0 <= q_lang != a_lang >= 0 and lead >= 1 and given[a_lang] >= 2 and given[q_lang] <= 0.67 * given[a_lang] else None
    if closed or text[-1] in ")”\"»'’]" or not any(map(str.isalpha, words)):  # figures alone are complete
        return other, None, 1.0, [], 0
    contexts, size = tail_contexts(text)
    connected = words[-1] in _CONNECTORS[votes.langs[a_lang if a_lang >= 0 else q_lang if q_lang >= 0 else 0]]
    return None, other, 0.0 if connected else 1.0, contexts, size


@lru_cache(maxsize=1 << 14)
def _asked(question: str) -> list[str]:
    return _WORD.findall(question.lower().replace("’", "'"))


def judged_pairs(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """`judge_pair` over all pairs in one pass, `(faq_id, defect, other, prior, contexts, brief, row_key)`; sound ones have no row.

    `row_key` is a hash of the whole row, so that two deliveries of one id are judged apart and equal ones together.
    """
    votes = Votes([(r.lang, r.text) for r in samples.select("lang", "text").collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, q, a, key in zip(batch["faq_id"], batch["question"], batch["answer"], batch["row_key"], strict=True):
                defect, other, prior, contexts, size = judge_pair(q, a, votes)
                if defect or contexts:
                    rows.append((f, defect, other, prior, contexts, size <= BRIEF, key))
            yield pd.DataFrame(rows, columns=["faq_id", "defect", "other", "prior", "contexts", "brief", "row_key"])

    wanted = pairs.select("faq_id", "question", "answer", F.xxhash64("faq_id", "question", "answer").alias("row_key"))
    return wanted.mapInPandas(run, "faq_id string, defect string, other string, prior double, contexts array<long>, brief boolean, row_key long")


def asked_contexts(contexts: DataFrame, bits: int) -> np.ndarray:
    """A table of `bits` bits with those of the contexts set; it has that size, 8 MB by default, however many contexts there are."""
    place = F.col("context").bitwiseAND(F.lit(bits - 1)) + 1  # bitmaps count from 1
    marked = contexts.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))
    table = np.zeros((bits // 32_768, 4096), np.uint8)
    for r in marked.collect():
        table[r["bucket"] - 1] = np.frombuffer(bytes(r["map"]), np.uint8)
    return table.ravel()


def continuation_counts(answers: DataFrame, wanted: np.ndarray | None = None, longest: int = LONGEST) -> DataFrame:
    """`(context, total, ended)` over all texts of the column `answer`, counted in the tasks before anything moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Continuations(longest)
        for batch in batches:
            context, total, ended = counter.counts([_closed(t.replace("\0", " ")) for t in batch["answer"]], wanted)
            yield pd.DataFrame({"context": context, "total": total, "ended": ended})

    counted = answers.select("answer").filter("answer is not null").mapInPandas(run, "context long, total long, ended long")
    return counted.groupBy("context").agg(F.sum("total").alias("total"), F.sum("ended").alias("ended"))


def broken_pairs(pairs: DataFrame, samples: DataFrame, floor: float = 0.12, brief_floor: float = 0.02, bits: int = 1 << 26) -> DataFrame:
    """`(faq_id, defect)` of every defective pair, one row each.

    Looked for in this order: 'empty' (no content or a placeholder), 'copy' (the question's suffix automaton covers the
    answer, and what is left says nothing), 'refusal' (a phrase of the refusal automaton opens a sentence and no
    substance follows), 'truncated' and 'other_language' (stopword votes outside short quotes). An answer is truncated if
    it ends in an ellipsis, comma, colon or the like, or, without a sentence end, with an open bracket or quote. If it
    lacks only the full stop, evidence must show that it breaks off: after a word that no sentence of the language ends
    with, or where the answers and the labelled sentences go on after its last tokens, or with a longer word in place of
    its last, and do not end there. The chance of an end, smoothed from short to long contexts, starts at 1 where nothing
    is known and must fall under `floor` (`brief_floor` for a whole answer of at most five tokens, which need not be a
    sentence), so that contexts never seen are no evidence and an answer is not judged by how many rows there are.

    Each pair is judged once; defects and doubts, a small part of the table, are written to the checkpoint folder. The
    contexts in doubt are marked in a table of `bits` bits, outside of which nothing is counted; the counts are then
    joined exactly. Null questions are the empty text, null answers are empty, equal rows give one row.
    """
    judged = cut_lineage(judged_pairs(pairs, samples))
    plain = judged.filter("defect is not null").select("faq_id", "defect")
    doubtful = judged.filter(F.size("contexts") > 0).dropDuplicates(["row_key"])
    each = doubtful.select("faq_id", "row_key", "other", "prior", "brief", F.posexplode("contexts").alias("k", "context"))
    wanted = asked_contexts(each, bits)
    texts = pairs.select("answer").unionByName(samples.select(F.col("text").alias("answer")))
    found = join_unique(each, continuation_counts(texts, wanted), "context", each.count(), "left")
    own = F.when(F.col("brief") & (F.col("k") > 0), 1).otherwise(0)  # a brief answer is no evidence for itself
    entry = F.struct("k", *[F.greatest(F.coalesce(x, F.lit(0)) - own, F.lit(0)).alias(x) for x in ("total", "ended")])
    tails = found.groupBy("faq_id", "row_key", "other", "prior", "brief").agg(F.sort_array(F.collect_list(entry)).alias("tail"))
    # a longer word in the place of one that is never seen whole weighs more
    longer = F.get("tail", F.lit(0))["total"] * F.when(F.get("tail", F.lit(1))["total"] == 0, 4).otherwise(1)

    def smoothed(p, x):  # noqa: ANN001, ANN202
        total = x["total"] + F.when(x["k"] == 2, longer).otherwise(0)
        return F.when(x["k"] == 0, p).otherwise((x["ended"] + p) / (total + 1))

    limit = F.when(F.col("brief"), brief_floor).otherwise(floor)
    chance = F.aggregate("tail", F.col("prior"), smoothed)
    decided = tails.select("faq_id", F.when(chance < limit, "truncated").otherwise(F.col("other")).alias("defect"))
    return plain.unionByName(decided.filter("defect is not null")).distinct()
