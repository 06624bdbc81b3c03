"""The unit registry and the count groups that are found mechanically in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

# Unit symbols and names as the SI Brochure (9th edition) and NIST SP 811 list them, with their prefixes.
SYMBOLS = "s m kg A K mol cd rad sr Hz N Pa J W C V F Ω Ω S Wb T H °C lm lx Bq Gy Sv kat min h d ° ′ ″ ha L l t Np B dB eV Da u bar mmHg in ft yd mi psi °F °R rpm".split()
NAMES = (
    "second meter metre gram ampere kelvin mole candela radian steradian newton pascal joule watt coulomb volt farad ohm weber tesla "
    "lumen becquerel gray sievert katal minute hour day degree hectare liter litre tonne neper bel decibel electronvolt dalton bar yard mile pound"
).split()
IRREGULAR_NAMES = "hertz siemens henry henries lux inch inches foot feet".split()
MULTIWORD_NAMES = ["degree Celsius", "degree Fahrenheit", "degree Rankine", "nautical mile", "pound per square inch"]
PREFIX_SYMBOLS = "q r y z a f p n µ μ m c d da h k M G T P E Z Y R Q".split()
PREFIX_NAMES = "quecto ronto yocto zepto atto femto pico nano micro milli centi deci deca deka hecto kilo mega giga tera peta exa zetta yotta ronna quetta".split()
PREFIXABLE_SYMBOLS = "g m s A K mol cd rad sr Hz N Pa J W C V F Ω Ω S Wb T H °C lm lx Bq Gy Sv kat L l eV Da u".split()
PREFIXABLE_NAMES = "gram meter metre second ampere kelvin mole candela radian steradian hertz newton pascal joule watt coulomb volt farad ohm siemens weber tesla henry lumen lux becquerel gray sievert katal liter litre electronvolt dalton".split()

_NUMBER = re.compile(r"[-+−]?(?:\d[\d,  ]*(?:\.\d+)?|\.\d+)(?:\s?[-–—/]\s?\d[\d,]*(?:\.\d+)?)?(?:st|nd|rd|th)?")
_QUOTES = re.compile('["“”\n]')
_WORD = re.compile(r"\S+")
_OPEN, _CLOSE = "\"“'([{#*`‘", "\"”’')]},;:?!.`"
_CLOCK = re.compile(r"[ap]\.?m\.?", re.I)
_IDENTIFIER = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9\-_/.:]+")
_HYPHENATED = re.compile(r"(?<![^\W_])[^\W_]++(?:-[^\W_]++)+")


def quotations(text: str) -> Iterator[tuple[int, int]]:
    """From each opening mark to the next closing one of its kind on the same line, leftmost first; straight marks open and close."""
    marks = [(m.start(), m[0]) for m in _QUOTES.finditer(text)]
    close = [-1] * len(marks)
    later = {'"': -1, "”": -1}
    for k in range(len(marks) - 1, -1, -1):
        ch = marks[k][1]
        if ch == "\n":
            later = {'"': -1, "”": -1}
        elif ch == "“":
            close[k] = later["”"]
        else:
            if ch == '"':
                close[k] = later['"']
            later[ch] = k
    k = 0
    while k < len(marks):
        if close[k] >= 0:
            yield marks[k][0], marks[close[k]][0] + 1
            k = close[k]
        k += 1


@dataclass
class Registry:
    """Closed sets of unit symbols (exact) and names (any case)."""

    symbols: frozenset[str]
    names: frozenset[str]
    longest: int

    def is_unit(self, phrase: str) -> bool:
        if phrase in self.symbols or phrase.lower() in self.names:
            return True
        parts = re.split(r"[/·⋅*]", phrase)
        return len(parts) > 1 and all(re.sub(r"(?:\^?-?\d|[²³⁻¹])+$", "", p) in self.symbols for p in parts)

    def groups(self, text: str, headings: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """(kind, start, end) of headings, quotations, parentheses, hyphenated words, numbers, identifiers and clock marks."""
        for a, b in headings:
            yield "heading", a, b
        for a, b in quotations(text):
            yield "quoted", a, b
        stack: list[int] = []
        for m in re.finditer(r"[()]", text):
            if m[0] == "(":
                stack.append(m.start())
            elif stack:
                yield "parenthetical", stack.pop(), m.end()
        for m in _HYPHENATED.finditer(text) if "-" in text else ():
            yield "hyphenated", m.start(), m.end()
        if re.search(r"\d|[ap]\.?m\.", text):
            yield from self._mechanical(text)

    def _mechanical(self, text: str) -> Iterator[tuple[str, int, int]]:
        words = []
        for m in _WORD.finditer(text):
            w = m[0].lstrip(_OPEN)
            a = m.end() - len(w)
            bare = w.rstrip(_CLOSE)
            if w.lower() in ("a.m.", "p.m.", "no."):
                bare = w
            if bare:
                words.append((bare, a, a + len(bare)))
        k = 0
        while k < len(words):
            w, a, b = words[k]
            if w.isalpha():
                k += 1
                continue
            if w.lower() == "no." and k + 1 < len(words) and _NUMBER.fullmatch(words[k + 1][0]):
                yield "identifier", a, words[k + 1][2]
                k += 2
            elif _NUMBER.fullmatch(w):
                size = next((n for n in range(min(self.longest, len(words) - k - 1), 0, -1) if self.is_unit(" ".join(x[0] for x in words[k + 1 : k + 1 + n]))), 0)
                if size:
                    yield "number_with_unit", a, words[k + size][2]
                elif k + 1 < len(words) and _CLOCK.fullmatch(words[k + 1][0]) and "." in words[k + 1][0]:
                    size = 1
                    yield "abbreviation", a, words[k + 1][2]
                else:
                    yield "number", a, b
                k += 1 + size
            else:
                m = re.match(r"([-+−]?\d[\d,]*(?:\.\d+)?)(\S+)$", w)
                if m and self.is_unit(m[2]):
                    yield "number_with_unit", a, b
                elif _IDENTIFIER.fullmatch(w):
                    yield "identifier", a, b
                elif _CLOCK.fullmatch(w) and "." in w:
                    yield "abbreviation", a, b
                k += 1


@lru_cache(1)
def registry() -> Registry:
    symbols = {*SYMBOLS, *(p + s for p in PREFIX_SYMBOLS for s in PREFIXABLE_SYMBOLS)}
    base = {*NAMES, *(n + "s" for n in NAMES), *IRREGULAR_NAMES}
    prefixed = {p + n + e for p in PREFIX_NAMES for n in PREFIXABLE_NAMES for e in ("", "s")}
    many = {m.lower() for m in MULTIWORD_NAMES} | {m.lower().replace(m.split()[0], m.split()[0] + "s", 1) for m in MULTIWORD_NAMES} | {"nautical miles"}
    names = frozenset(base | prefixed | many)
    return Registry(frozenset(symbols), names, max(len(n.split()) for n in names))


#: Precedence of groups over the same span (the lower wins).
RANKS = {
    "document_numbering_excluded": 0, "heading": 1, "title": 1, "placard": 1, "label": 1, "quoted": 2, "parenthetical": 2,
    "proper_noun": 3, "number_with_unit": 4, "abbreviation": 4, "identifier": 5, "number": 5, "hyphenated": 6,
}
#: A unit that lies within one of these counts as one word.
WHOLE = ("quoted", "title", "heading", "placard", "label", "proper_noun")
