"""Personal data, plain or disguised, with offsets in the source.

Plain identifiers are found in the text as it is. Then transducers rewrite the text step by step
and carry, for every character written, the span of source characters that it stands for:
homoglyphs and invisible characters, spelled digits, at and dot disguises, letters that pose as
digits. Identifiers found in the rewritten text are mapped back to source spans and added unless
they lie within a plain one of their kind; one that reaches beyond a plain one is added beside it.
Each transducer runs on the texts that hold what its pattern cannot match without.

What marks a disguise ("(at)", "[dot]", "arroba") is always read as one. Bare words are ordinary
prose as a rule: "at" needs a name before it and an address with a usual ending behind it, "dot" an
@ before it and such an ending behind it, "plus" a number with the digits of a phone.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import batched_texts, release_memory

KINDS = ("email", "ip", "card", "phone")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# Each pattern finds what its kind's rule finds, in time linear in the text: possessive runs, and
# an address is searched from its @ and then extended to the left.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the identifiers in text, by kind, then start."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Tape:
    """A text and, for each character, the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start: np.ndarray | None = None
        self.end: np.ndarray | None = None

    def rewrite(self, pattern: re.Pattern, written: Callable[[re.Match], str]) -> None:
        """Replaces each match; every character written stands for the whole match."""
        changes = [(*m.span(), new) for m in pattern.finditer(self.text) if (new := written(m)) != m[0]]
        if not changes:
            return
        if self.start is None:
            self.start, self.end = np.arange(len(self.text), dtype=np.int32), np.arange(1, len(self.text) + 1, dtype=np.int32)
        a, b = (np.array(x, np.int64) for x in list(zip(*changes, strict=True))[:2])
        size = np.array([len(new) for _, _, new in changes], np.int64)
        # Every character of the source is written as often as it is kept (once or not at all), a match's first as often as the new text is long.
        times = np.ones(len(self.text), np.int64)
        edges = np.zeros(len(self.text) + 1, np.int64)
        edges[a] += 1
        np.add.at(edges, b, -1)
        times[np.cumsum(edges[:-1]) > 0] = 0
        times[a] = size
        last = np.arange(len(self.text))
        last[a] = b - 1
        self.start, self.end = np.repeat(self.start, times), np.repeat(self.end[last], times)
        out, at = [], 0
        for x, y, new in changes:
            out += [self.text[at:x], new]
            at = y
        self.text = "".join([*out, self.text[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


# Letters of other scripts that look like a Latin letter or a sign.
_PAIRS = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ѴV "
    "οo αa νv ιi κk ρp τt υu χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
_LOOKALIKES = {pair[0]: pair[1] for pair in _PAIRS.split()}
_SIGN_LOOKALIKES = {0x2219: ".", 0x2024: ".", 0x2027: ".", 0x00B7: ".", 0x02D6: "+", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2212: "-"}
_LOOKALIKES |= {chr(code): sign for code, sign in _SIGN_LOOKALIKES.items()}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_FOREIGN = re.compile("[\u00ad\u00b2\u00b3\u00b7\u00b9\u0250-\U0010ffff]")


def _ascii_of(m: re.Match) -> str:
    return _plain(m[0])


@functools.lru_cache(maxsize=1 << 16)
def _plain(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if _INVISIBLE.match(c):
        return ""
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    flat = unicodedata.normalize("NFKC", c)
    if len(flat) == 1:
        return _LOOKALIKES.get(flat, flat) if flat.isascii() or flat in _LOOKALIKES else c
    return c


# The digits' names in four languages.
_NAMES = (
    "zero oh null nought zéro cero",
    "one eins un uno",
    "two zwei zwo deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf fuenf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
)
_DIGIT_OF = {name: str(d) for d, names in enumerate(_NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_TIMES = {"double": 2, "triple": 3}
_SEP = r"(?:\s++(?:[,\-]\s*+)?|[,\-]\s*+)"
_ITEM = rf"(?:(?:double|triple)(?:\s++|-))?{_NAME}"
#: Digits' names in a row, before digits or not: three or more, or two before digits; fewer are ordinary words.
_SPELLED = re.compile(rf"\b{_ITEM}\b(?:{_SEP}{_ITEM}\b)++(?P<post>{_SEP}(?=[0-9]))?", re.I)
#: Names after digits: two or more, or one that has digits on both sides.
_AFTER = re.compile(rf"(?<=[0-9]){_SEP}{_ITEM}\b(?:{_SEP}{_ITEM}\b)*+(?P<post>{_SEP}(?=[0-9]))?", re.I)
_ITEMS = re.compile(rf"(?:(double|triple)(?:\s++|-))?\b({_NAME})\b", re.I)
#: One or two names beside digits or a spelled dot, as in an address part.
_SHORT = re.compile(rf"(?<=[0-9]\.)[ ]?{_ITEM}(?: {_ITEM}){{0,2}}\b|\b{_ITEM}(?: {_ITEM}){{0,2}}(?=[ ]?(?:\.|dot|\(dot\)|\[dot\]|point)[ ]?(?:[0-9]|{_NAME}\b))", re.I)
#: Not in sums: no digit before it, and the digits of a phone behind it.
_PLUS = re.compile(r"(?<![0-9])(?<![0-9][ .,%])\bplus[ -]?(?=[0-9](?:[ ().-]{0,2}[0-9]){8,14}(?![0-9]))", re.I)
_DOT_WORDS = "dot|punkt|point|punto"
_OPEN, _CLOSE = r"[ \t]*[(\[{<][ \t]*", r"[ \t]*[)\]}>][ \t]*"
_AT_MARKED = re.compile(rf"(?<=[A-Za-z0-9._%+-]){_OPEN}(?:at|@|arroba|ät){_CLOSE}(?=[A-Za-z0-9])|(?:&#0*64;|&commat;|%40)", re.I)
_DOT_MARKED = re.compile(rf"(?<=[A-Za-z0-9-]){_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}(?=[A-Za-z0-9])|(?:&#0*46;|&period;)", re.I)
# Endings of addresses that are no words of the four languages; the others only count where a sign marks them.
_ENDINGS = "com|org|net|edu|gov|info|biz|co|uk|fr|eu|nl|ch|io|dev|app|pl|cz|ru|cn|jp|br|mx|ar|cl|ca|au"
_MORE_ENDINGS = f"{_ENDINGS}|de|es|it|at|be|us|se|no|pt|ie|me|tv"
# Words before "at" that are no one's name, in prose about a place, a time or an address on the web.
_NO_NAMES = frozenset(
    "a an the is are was were be been am it its he she they we you i me him her us them this that these those there here who what which where when how all any some none both each "
    "look looks looked looking see sees saw seen meet meets met meeting sell sells sold buy buys bought shop shops shopped order orders ordered find finds found read reads visit visits visited "
    "stay stays stayed stop stops stopped stand stands stood sit sits sat live lives lived work works worked arrive arrives arrived start starts started end ends ended begin began get got gets "
    "go goes went come comes came join joins joined listed hosted published posted available online home page site website web store market price prices time times point day night up out in on "
    "down over back not only just now then more less much many good well still even again also and or but if as so than too very once always never often offices shares traded works based".split()
)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_BARE_DOT = r"[ \t]+dot[ \t]+"
_NAMED_DOT = rf"[ \t]+(?:{_DOT_WORDS})[ \t]+"
_SIGNED_DOT = rf"[ \t]*[(\[{{<][ \t]*(?:{_DOT_WORDS}|\.)[ \t]*[)\]}}>][ \t]*"
#: A bracketed "a" is in code, statutes and markup as well: here an address with a usual ending is behind it, and no page of the web.
_A_MARKED = re.compile(
    rf"(?<=[A-Za-z0-9._%+-]){_OPEN}a{_CLOSE}(?!www\.)(?={_LABEL}(?:(?:{_BARE_DOT}|{_SIGNED_DOT}|\.){_LABEL})*(?:(?:{_BARE_DOT}|{_SIGNED_DOT}|\.)(?:{_MORE_ENDINGS}))(?![A-Za-z0-9_(\[-]))", re.I
)
#: "at" between a name and an address whose dots are spelled, marked or plain, up to a usual ending.
_AT_BARE = re.compile(rf"(?<=[A-Za-z0-9_%+-])[ \t]+at[ \t]+(?={_LABEL}(?:(?:{_BARE_DOT}|\.){_LABEL})*(?:(?:{_BARE_DOT}|\.)(?:{_ENDINGS})|{_SIGNED_DOT}(?:{_MORE_ENDINGS}))\b)", re.I)
_ARROBA = re.compile(rf"(?<=[A-Za-z0-9_%+-])[ \t]+(?:arroba|@)[ \t]+(?={_LABEL}(?:{_NAMED_DOT}|{_SIGNED_DOT}|\.)[A-Za-z0-9])", re.I)
_AT_DOTTED = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:[ \t]+@[ \t]*|[ \t]*@[ \t]+)(?=[A-Za-z0-9-]+\.[A-Za-z0-9])")
_DOT_BARE = re.compile(rf"(?<=[A-Za-z0-9-]){_NAMED_DOT}(?=[A-Za-z0-9])", re.I)
#: What stands before a spelled dot of an address, and behind it.
_TO_THE_AT = re.compile(rf"@{_LABEL}(?:(?:\.|{_NAMED_DOT}){_LABEL})*$", re.I)
_TO_THE_END = re.compile(rf"(?:{_LABEL}(?:\.|{_NAMED_DOT}))*?(?:{_MORE_ENDINGS})\b", re.I)
#: The longest address.
_REACH = 254
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+$")
_ASKED = re.compile(r"(?:e-?mails?|mail|contact|write(?: to)?|reach(?: me| us)?|address|adresse|correo|courriel|kontakt)(?: is| me| us| him| her| them| at| to| an| à| a)?[ \t:]+$|[:<(\"'][ \t]*$", re.I)
_DOT_DIGITS = re.compile(rf"(?<=[0-9])[ \t]*(?:{_DOT_WORDS})[ \t]*(?=[0-9]|{_NAME}\b)", re.I)
_POSING = re.compile(r"(?<=[0-9])[OolI]+(?=[0-9])")
#: Four parts, each with a digit: letters that pose as digits may stand at their edges.
_POSING_PARTS = re.compile(r"(?<![A-Za-z0-9.])(?=[0-9.]*+[OolI])(?:[OolI]*+[0-9][0-9OolI]*+\.){3}[OolI]*+[0-9][0-9OolI]*+(?![A-Za-z0-9])(?!\.[A-Za-z0-9])")
#: A number with a fraction, before a spelled dot and behind it: "1.5 point 2.3" is no address.
_FRACTION_BEFORE, _FRACTION_AFTER = re.compile(r"(?<![0-9.])[0-9]+\.[0-9]+$"), re.compile(r"[0-9]+\.[0-9]+(?![0-9.])")
#: What a transducer cannot match without; texts that lack it are not searched with the whole pattern.
_DOTS = tuple(_DOT_WORDS.split("|"))
_A_IN_MARKS = re.compile(r"[(\[{<][ \t]*a[ \t]*[)\]}>]", re.I)
_AT_IN_MARKS = re.compile(r"[(\[{<][ \t]*(?:at|@|arroba|ät)[ \t]*[)\]}>]|&#0*64;|&commat;|%40", re.I)
_DOT_IN_MARKS = re.compile(rf"[(\[{{<][ \t]*(?:{_DOT_WORDS}|\.)[ \t]*[)\]}}>]|&#0*46;|&period;", re.I)
_DOT_BY_NAME = re.compile(rf"\.[ ]?{_ITEM}\b|(?<=[a-z])\.[ ]?[0-9]|(?<=[a-z] )\.[ ]?[0-9]", re.I)
#: In lower case and without alternatives in front, so that the search is one for " at".
_AT_NEAR_DOT = re.compile(r" at[ \t]+[a-z0-9-]+(?:\.[a-z0-9]|[ \t]+dot\b|[ \t]*[(\[{<])")
#: A digit's name behind another one or a digit, which both patterns of spelled digits need.
_NAME_NEAR_NAME = re.compile(rf"(?:[0-9]|\b{_NAME}){_SEP}{_ITEM}\b")
_AT_SPACED = re.compile(r"@[ \t]|[ \t]@")


def _digits_of(names: str) -> str:
    return "".join(_DIGIT_OF[x[2].lower()] * _TIMES.get((x[1] or "").lower(), 1) for x in _ITEMS.finditer(names))


def _spelled(m: re.Match) -> str:
    return _digits_of(m[0])


def _run(m: re.Match) -> str:
    if m["post"] is None and sum(1 for _ in _ITEMS.finditer(m[0])) < 3:
        return m[0]
    return _digits_of(m[0]) + (" " if m["post"] else "")


def _after(m: re.Match) -> str:
    if m["post"] is None and sum(1 for _ in _ITEMS.finditer(m[0])) < 2:
        return m[0]
    return " " + _digits_of(m[0]) + (" " if m["post"] else "")


def _at(m: re.Match) -> str:
    """A bare "at" is a sign where a name stands before it.

    With a spelled or marked dot behind it any word that is no ordinary one is a name; before a
    plain address, which prose has behind "at" as well, it has a sign or a digit in it, or was asked for.
    """
    left = m.string[max(0, m.start() - 96) : m.start()]
    name = _NAME_BEFORE.search(left)[0]
    if any(c in "0123456789._%+-" for c in name):
        return "@"
    if name.lower() in _NO_NAMES:
        return m[0]
    plain = re.match(rf"{_LABEL}(?:\.{_LABEL})+", m.string[m.end() : m.end() + _REACH])
    return "@" if not plain or _ASKED.search(left[: len(left) - len(name)]) else m[0]


def _dot_of_digits(m: re.Match) -> str:
    """A dot word between two numbers with fractions is prose, but for "dot"."""
    if "dot" in m[0].lower():
        return "."
    prose = _FRACTION_BEFORE.search(m.string[max(0, m.start() - 32) : m.start()]) and _FRACTION_AFTER.match(m.string[m.end() : m.end() + 32])
    return m[0] if prose else "."


def _as_digits(m: re.Match) -> str:
    return "".join("0" if c in "Oo" else "1" if c in "lI" else c for c in m[0])


def _dot(m: re.Match) -> str:
    """A bare dot word is a dot within an address: behind an @, before a usual ending."""
    left, right = m.string[max(0, m.start() - _REACH) : m.start()], m.string[m.end() : m.end() + _REACH]
    return "." if "@" in left and _TO_THE_AT.search(left) and _TO_THE_END.match(right) else m[0]


def rewritten(text: str) -> Tape | None:
    """The text after all transducers; None if none of them changes it."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(_FOREIGN, _ascii_of)
    low = tape.text.lower()
    dots = any(w in low for w in _DOTS)
    marked = any(c in low for c in "([{<&")
    if _NAME_NEAR_NAME.search(low):
        tape.rewrite(_AFTER, _after)
        tape.rewrite(_SPELLED, _run)
    short = dots or _DOT_BY_NAME.search(tape.text)
    if short:
        tape.rewrite(_SHORT, _spelled)
    if dots:
        tape.rewrite(_DOT_DIGITS, _dot_of_digits)
    if short:
        tape.rewrite(_SHORT, _spelled)
    if "plus" in low:
        tape.rewrite(_PLUS, lambda m: "+")
    if (marked or "%40" in low) and _AT_IN_MARKS.search(tape.text):
        tape.rewrite(_AT_MARKED, lambda m: "@")
    if marked and _A_IN_MARKS.search(tape.text):
        tape.rewrite(_A_MARKED, lambda m: "@")
    dot_marked = marked and _DOT_IN_MARKS.search(tape.text)
    # Both look for the dot's disguise, so before that is rewritten.
    if _AT_NEAR_DOT.search(low) or "\tat" in low:
        tape.rewrite(_AT_BARE, _at)
    if "arroba" in low or "@" in low:
        tape.rewrite(_ARROBA, lambda m: "@")
    if dot_marked:
        tape.rewrite(_DOT_MARKED, lambda m: ".")
    if dots and "@" in tape.text:
        tape.rewrite(_DOT_BARE, _dot)
    if "@" in tape.text and _AT_SPACED.search(tape.text):
        tape.rewrite(_AT_DOTTED, lambda m: "@")
    tape.rewrite(_POSING, _as_digits)
    tape.rewrite(_POSING_PARTS, _as_digits)
    return tape if tape.text != text else None


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(plain spans, added spans), each (kind, start, end) in code points of text."""
    text = text or ""
    base = plain_spans(text)
    added: list[tuple[int, int, int]] = []
    if tape := rewritten(text):
        # Spans of a kind don't overlap and come in order, in the text as in what is written of it.
        known = [[s[1:] for s in base if s[0] == kind] for kind in range(len(KINDS))]
        place, last = [0] * len(KINDS), [(-1, -1)] * len(KINDS)
        for kind, a, b in plain_spans(tape.text):
            start, end = tape.source(a, b)
            own, at = known[kind], place[kind]
            while at < len(own) and own[at][1] < end:
                at += 1
            place[kind] = at
            within = at < len(own) and own[at][0] <= start
            if not within and not (last[kind][0] <= start and end <= last[kind][1]):
                added.append((kind, start, end))
                last[kind] = (start, end)
    return base, sorted(added)


_SPANS = "array<struct<kind:string,start:long,end:long,added:boolean>>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, added), ordered by kind as in KINDS, then start.

    Offsets are code points of the source text, the end exclusive. A null text counts as empty.
    Repeated rows and null ids get a row each; an empty table gives none. Other columns are not read.
    """
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = find(text)
                merged = sorted([(*s, False) for s in base] + [(*s, True) for s in added])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "added": new} for k, a, b, new in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kinds)], ["doc_id", "spans"])
            release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return batched_texts(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def _redacted(text: str | None) -> str | None:
    if not text:
        return text
    base, added = find(text)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
        if a >= at:
            out += [text[at:a], MARKS[KINDS[kind]]]
            at = b
        else:  # spans of two kinds may overlap: the rest of the second one goes, too
            at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with every span of the text replaced by its kind's mark; null stays null."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_redacted)

    return docs.withColumn(text_col, run(F.col(text_col)))
