"""Text functions as Column expressions: tokenizers, normal forms, matchers, parsers and detectors.

Every function is null-safe in the sense that null gives null, unless its docstring says otherwise. The tokenizers and
stop lists differ on purpose: each belongs to one use, and results depend on keeping them apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.keys import WS

#: Stop lists of the tokenizers below.
STOP_RANK = "the a an and or of to in for is are be on at it this that with as by from".split()
STOP_DRAFT = [*STOP_RANK, *"do i my what how can if does will you".split()]
STOP_GUARD = (
    "a an the and or but if of to in on at for with from by is are was were be been being am do does did have has had you "
    "your yours our ours we they them their it its this that these those there here as not no nor yes can could will would "
    "shall should may might must please thank thanks about into over under than then so such other some any all more most us "
    "me my i also just which who whom what when where why how during while after before"
).split()
STOP_AUDIT = (
    "the a an and or of to in on at for with from by is are was were be you your our we they it this that there as not no "
    "can will would should may must please according documents club"
).split()
STOP_SWEEP = (
    "a about an and any anyone are as at be can do does for from get has have how i if in is it many me much my need of on "
    "or our should someone that the their there they this to we what when where which who whom why will with you your"
).split()

#: Fixed value: word characters of any alphabet, for use inside a character class.
WORD_CHARS = r"\p{L}\p{N}_"


@dataclass(frozen=True)
class Tokenizer:
    """A pattern, the stop list that is taken out and the least length that is kept."""

    pattern: str
    stop: tuple[str, ...] = ()
    least: int = 1
    lower: bool = True

    def __call__(self, text: Column) -> Column:
        text = F.lower(text) if self.lower else text
        run = re.fullmatch(r"(\[[^\]]+\])\+", self.pattern)
        if run and self.stop:  # maximal runs of one class: one pattern takes the stop words out, without a pass over the array
            c = run[1]
            pattern = rf"(?<!{c})(?!(?:{'|'.join(self.stop)})(?!{c})){c}{{{self.least},}}"
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        if self.stop:
            stop = F.array(*[F.lit(w) for w in self.stop])
            return F.filter(found, lambda t: (F.length(t) >= self.least) & ~F.array_contains(stop, t))
        return F.filter(found, lambda t: F.length(t) >= self.least) if self.least > 1 else found


#: The registry of tokenizers by use. Their patterns.
TOKENIZERS = {
    "rank": Tokenizer(r"[a-z0-9$£€.\-/]+", tuple(STOP_RANK)),
    "draft": Tokenizer(r"[a-z0-9$£€]+", tuple(STOP_DRAFT)),
    "guard": Tokenizer(r"[a-z0-9$]+", tuple(STOP_GUARD), 3),
    "audit": Tokenizer(r"[a-z0-9$]+", tuple(STOP_AUDIT), 3),
    "sweep": Tokenizer(r"[a-z0-9][a-z0-9'-]*", tuple(STOP_SWEEP), 3),
    "leak": Tokenizer(r"[A-Za-z0-9$][A-Za-z0-9$'/.-]*", lower=False),
    "word": Tokenizer(rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{WS}]", lower=False),
    "char": Tokenizer(r"(?s).", lower=False),
}


def tokens(text: Column, name: str) -> Column:
    """The tokens of a text under a registered tokenizer."""
    return TOKENIZERS[name](text)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def squash(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, f"[{WS}]+", ""))


def squash_alnum(text: Column) -> Column:
    """Only a-z and 0-9 of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def squash_offsets(text: Column) -> Column:
    """1-based positions of the characters that `squash` keeps; empty for the empty text."""
    places = F.sequence(F.lit(1), F.length(text))
    kept = F.filter(places, lambda i: ~F.rlike(F.substring(text, i, F.lit(1)), F.lit(f"[{WS}]")))
    return F.when(F.length(text) > 0, kept).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))


def contains_all(text: Column, keys: Column) -> Column:
    """Whether a text contains every key, without regard to case and white space; true for no keys."""
    hay = squash(text)
    return F.forall(keys, lambda k: F.contains(hay, squash(k)))


def stem(token: Column) -> Column:
    """A token longer than 4 without its final s."""
    return F.when((F.length(token) > 4) & F.endswith(token, F.lit("s")), F.regexp_replace(token, "s$", "")).otherwise(token)


#: Fixed value: a number with an optional dollar sign and am or pm.
NUMBER = r"(?i)\$?\d[\d,:]*(?:\.\d+)?\s*(?:am|pm)?"


def numbers(text: Column) -> Column:
    """The numbers of a text in normal form: trimmed, without outer punctuation and commas, lower case."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.lower(F.regexp_replace(F.trim(x), "^[.,;:]+|[.,;:]+$", "")), F.lit(","), F.lit("")))


def sentences(text: Column, lines: bool = True) -> Column:
    """A text cut after `.`, `!` or `?` before white space and, if `lines`, at line breaks; empty pieces are dropped."""
    pieces = F.split(text, r"(?<=[.!?])\s+|\n" if lines else r"(?<=[.!?])\s+")
    return F.filter(pieces, lambda s: F.length(F.trim(s)) > 0)


def bounded_sentences(text: Column) -> Column:
    """Sentences that also end at bullets, as structs of 0-based start, length and text."""
    marked = F.regexp_replace(text, r"(?<=[.!?])(\s+)|(\s+•\s*)", "$1$2\u0001")
    parts = F.split(marked, "\u0001")
    empty = F.array().cast("array<struct<start:int,size:int,sentence:string>>")

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        start = F.coalesce(last["start"] + last["size"], F.lit(0))
        return F.concat(done, F.array(F.struct(start.alias("start"), F.length(part).alias("size"), part.alias("sentence"))))

    return F.aggregate(parts, empty, add)


def whole_word_pattern(term: str, plural: bool = True) -> str:
    """A pattern for a term as a whole word; a word boundary is asked for only where the edge is a letter or digit.

    Alphabetic terms of more than three letters also match with a final s or es.
    """
    body = re.escape(term).replace(r"\ ", r"\s+")
    tail = "(?:e?s)?" if plural and term.isalpha() and len(term) > 3 else ""
    left = rf"(?<![{WORD_CHARS}])" if term[:1].isalnum() else ""
    right = rf"(?![{WORD_CHARS}])" if term[-1:].isalnum() else ""
    return f"(?i){left}{body}{tail}{right}"


def whole_word_count(text: Column, term: str, plural: bool = True) -> Column:
    """How often a term stands in a text as a whole word."""
    return F.regexp_count(text, F.lit(whole_word_pattern(term, plural)))


def substring_count(text: Column, term: Column) -> Column:
    """How often a term occurs in a text, without overlaps; null for an empty term."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def id_prefix(key: Column) -> Column:
    """An identifier up to its last hyphen."""
    return F.regexp_replace(key, "-[^-]*$", "")


def elide(text: Column, limit: int) -> Column:
    """The ends of a text over the limit with a note of what is left out between them."""
    half = limit // 2
    left, right = F.substring(text, 1, half), F.expr("''") if half == 0 else F.right(text, F.lit(half))
    note = F.concat(F.lit(" … ["), (F.length(text) - 2 * half).cast("string"), F.lit(" more] … "))
    return F.when(F.length(text) > limit, F.concat(left, note, right)).otherwise(text)


def char_windows(text: Column, width: int = 420, stride: int = 260, least: int = 80) -> Column:
    """Overlapping windows of characters as structs `(start, chunk)`, 0-based, of which those over `least` long are kept; none for null."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(1)) - 1, F.lit(stride))
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(text, i + 1, F.lit(width)).alias("chunk")))
    return F.filter(windows, lambda w: F.length(w["chunk"]) > least)


def key_verdict(hits: Column, key: Column, most: int = 15) -> Column:
    """Whether a key can serve: MISSING, too vague, too common or ok, in that order."""
    words = F.size(F.filter(F.split(key, r"\s+"), lambda w: w != ""))
    vague = (words < 2) & (F.length(key) < 6) & ~key.rlike(r"[\d$£€]")
    return F.when(hits == 0, "MISSING").when(vague, "too vague").when(hits > most, "too common").otherwise("ok")


#: Phrases and sentences by which the answering model refuses.
REFUSAL_PHRASES = (
    "not covered in the club documents", "do not contain", "not in the documents", "documents do not", "not provided in",
    "not specified", "not mentioned", "does not specify", "no information about",
)
REFUSAL_CORE = "covered in the club documents"
MONEY = r"[£$€]\s?\d"


def refused(text: Column) -> Column:
    """Whether a refusal phrase occurs in a text."""
    low = F.lower(text)
    out = F.contains(low, F.lit(REFUSAL_PHRASES[0]))
    for phrase in REFUSAL_PHRASES[1:]:
        out = out | F.contains(low, F.lit(phrase))
    return out


def refused_cleanly(text: Column) -> Column:
    """A refusal that names no amount of money."""
    return refused(text) & ~text.rlike(MONEY)


def refusal_kind(text: Column, most: int = 90) -> Column:
    """'clean' or 'corrupt' for a short text around the refusal core, else null."""
    flat = F.regexp_replace(F.lower(collapse(text)), r'^[ ."]+|[ ."]+$', "")
    near = F.contains(flat, F.lit(REFUSAL_CORE)) & (F.length(flat) <= most)
    return F.when(near, F.when(F.contains(flat, F.lit("not " + REFUSAL_CORE)), "clean").otherwise("corrupt"))


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the keywords, in the order given, that occurs in the upper-cased text, else UNPARSED; null gives UNPARSED."""
    up = F.upper(text)
    out = F.when(F.contains(up, F.lit(words[0])), words[0])
    for w in words[1:]:
        out = out.when(F.contains(up, F.lit(w)), w)
    return out.otherwise("UNPARSED")


def verdict_of(text: Column) -> Column:
    """UNSUPPORTED, SUPPORTED or REFUSED; the first contains the second, so order matters."""
    return first_keyword(text, ("UNSUPPORTED", "SUPPORTED", "REFUSED"))


def gate_of(text: Column) -> Column:
    """MISSING or COVERED."""
    return first_keyword(text, ("MISSING", "COVERED"))


def json_complies(text: Column, names: tuple[str, ...]) -> Column:
    """Whether a text, without a code fence, is a JSON object with exactly these keys; false for null."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```(?:json)?|```\s*$", ""))
    keys = F.json_object_keys(F.when(F.try_parse_json(bare).isNotNull(), bare))
    want = F.array(*[F.lit(x) for x in names])
    return F.coalesce((F.size(F.array_except(keys, want)) == 0) & (F.size(F.array_except(want, keys)) == 0), F.lit(False))


def label_complies(text: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a trimmed, lower-cased text without outer full stops is an allowed label; false for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(text)), r"^\.+|\.+$", "").isin(*allowed), F.lit(False))


def token_estimates(text: Column) -> dict[str, Column]:
    """Rough token counts: by words (two factors, half to even) and by characters."""
    words = F.size(F.filter(F.split(collapse(text), " "), lambda w: w != ""))
    return {
        "by_words": F.bround(words * F.lit(1.17)).cast("long"),
        "by_cost_factor": F.bround(words * F.lit(1.33)).cast("long"),
        "by_chars": F.floor(F.length(text) / 4).cast("long"),
    }


#: What must not be published, by kind.
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(com|org|net|edu|io)",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY",
    "token": r"(sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})",
}


def secret_flags(text: Column) -> dict[str, Column]:
    """Whether each kind of secret occurs in a text; false for null."""
    return {kind: F.coalesce(text.rlike(pattern), F.lit(False)) for kind, pattern in SECRETS.items()}
