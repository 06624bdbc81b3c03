"""Document structure: one pass over each text that emits every span family as arrays, with UTF-8 byte offsets.

This is the engine's only per-document imperative step. Blocks (a CommonMark subset: headings, paragraphs, nested lists,
fenced and indented code, quotes, inline code), notes, safety statements, sentences, words and word counts need state
machines that Column expressions cannot fold in linear time. All rules above it are DataFrame transformations of its
arrays. Every construct takes time in proportion to the text (times the depth of nested parentheses): neighbours are found
by bisection of sorted spans, never by looking through all of them, and nothing is decided on a cut-off part of the text.
HTML blocks and link reference definitions are protected, not checked, in quotes and items too.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import RANKS, WHOLE

SPAN = "start long, end long, cs int, ce int"
#: The span families; scanned() computes those that are asked for. unit_words and item_words are the lower-case words of each
#: unit (its own ones, not those of units inside it) and item, at the same places as in units and items.
FAMILIES = {
    "protected": SPAN,
    "headings": SPAN,
    "paragraphs": f"id int, {SPAN}, sentences int",
    "lists": f"id int, depth int, {SPAN}, introduced boolean",
    "items": f"id int, list int, depth int, {SPAN}, text string",
    "notes": f"id int, {SPAN}, text string",
    "safety": f"id int, level string, {SPAN}, text string",
    "units": f"id int, kind string, parent int, {SPAN}, text string, words int",
    "unit_words": "words array<string>",
    "item_words": "words array<string>",
    "tokens": "start long, end long, text string, unit int, gap string",
    "lexical": "start long, end long, text string, machine boolean",
    "runs": f"{SPAN}, text string",
    "semicolons": SPAN,
    "groups": f"kind string, {SPAN}, text string",
}

#: Kinds of word-limit units but the parentheses in them.
KINDS = ("prose", "item", "note")

_ITEM = re.compile(r"(?P<indent>[ \t]*)(?P<mark>[-*+]|\d{1,9}[.)]|•|\([A-Za-z0-9]\)|[A-Za-z][.)])[ \t]+(?=\S)")
_BULLETS = frozenset("-*+•(")
_MARK_ENDS = frozenset(".)")
_HASHES = re.compile(r" {0,3}#{1,6}(?=[ \t]|$)")
_FENCE = re.compile(r" {0,3}(?P<mark>`{3,}+(?!.*`)|~{3,})")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*")
_QUOTE = re.compile(r"(?: {0,3}> ?)+")
_QUOTE_MARK = re.compile(r" {0,3}> ?")
#: What opens notes and safety statements, if only white space stands before it on its line.
_NOTE = re.compile("note:", re.I)
_SAFETY = re.compile(r"(?P<level>warning|caution)[^\S\n]*:", re.I)
_RUN = re.compile(r"(?:[^\W\d_]|['’-])+")
_SPACE = re.compile(r"\s")
_SPACES = re.compile(r"\s+")
_ALNUMS = re.compile(r"[^\W_]+")
_INK = re.compile(r"\S")
_TICKS = re.compile("`+")
_MARK = re.compile(r"[\"“”().?!:]")
_BRACKET = re.compile(r"[()]")
_LETTER = re.compile(r"[^\W_]")
#: A white-space word that holds a letter or a digit, from that character on.
_PLAIN = re.compile(r"[^\W_]\S*")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "_/\\-")
_MACHINE = re.compile(r"[_/\\.\-0-9]")
_OPENERS = "(\"'“‘["
# HTML blocks start with a comment, an instruction, a declaration, raw text, or a tag of these block names.
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol "
    "optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML_ENDED = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")),
]
_HTML_TAG = re.compile(r" {0,3}</?(?:" + "|".join(_BLOCK_TAGS) + r")(?:[\s>]|/>|$)", re.I)
_HTML_LONE = re.compile(r" {0,3}(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
#: Parts of a link reference definition may stand on lines of their own, but no blank line in them; a title fills its last line.
_LABEL = r"\[(?=[^\[\]]*[^\s\[\]])(?:[^\[\]\\\n]|\\.|\\(?=\n)|\n(?![ \t\r]*\n)){1,999}\]"
_GAP = r"[ \t]*(?:\r?\n[ \t]*(?=\S))?"
_TITLES = "|".join(rf"{p}(?:[^{p}{q}\\\n]|\\.|\\(?=\n)|\n(?![ \t\r]*\n))*{q}" for p, q in (('"', '"'), ("'", "'"), (r"\(", r"\)")))
_LINK_DEFINITION = re.compile(rf" {{0,3}}{_LABEL}:{_GAP}(?:<[^<>\n]*>|[^\s<]\S*)(?:(?=\s){_GAP}(?:{_TITLES}))?[ \t\r]*(?=\n|\Z)")


SPACE, ALNUM, ALPHA, EDGE, MACHINE, RUN = 1, 2, 4, 8, 16, 32


@lru_cache(1)
def _classes() -> np.ndarray:
    """What every code point is, as str and re have it: bits of SPACE (\\s), ALNUM ([^\\W_]), ALPHA, EDGE, MACHINE and RUN (_RUN)."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(len(every), np.uint8)
    for bit, pattern in ((SPACE, _SPACES), (ALNUM, _ALNUMS), (RUN, _RUN)):
        for m in pattern.finditer(every):
            out[m.start() : m.end()] |= bit
    known = np.flatnonzero(out & ALNUM)
    out[[c for c in known.tolist() if every[c].isalpha()]] |= ALPHA
    out[[ord(c) for c in _EDGE]] |= EDGE
    out[[c for c in range(128) if _MACHINE.match(chr(c))]] |= MACHINE
    return out


@dataclass
class Strings:
    """Strings as one run of UTF-8 bytes and their sizes."""

    data: np.ndarray
    sizes: np.ndarray


class Characters:
    """A text's characters as arrays; words come from them whole, not one by one."""

    def __init__(self, text: str):
        self.text = text
        self.ascii = text.isascii()
        if self.ascii:
            self.points = np.frombuffer(text.encode(), np.uint8)
        else:
            self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            cp = self.points
            self.at = np.concatenate(([0], np.cumsum(1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000))))

    @cached_property
    def kinds(self) -> np.ndarray:
        return _classes()[self.points]

    def bytes_of(self, places: np.ndarray) -> np.ndarray:
        """Byte offsets of places."""
        return places if self.ascii else self.at[places]

    @cached_property
    def lowered(self) -> str | None:
        """The text in lower case, character by character; None where a character's lower case hangs on others or is longer."""
        return None if not self.ascii and ("Σ" in self.text or "İ" in self.text) else self.text.lower()

    def low(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        """Words in lower case."""
        spans = zip(starts.tolist(), ends.tolist())
        return [self.text[a:b].lower() for a, b in spans] if self.lowered is None else [self.lowered[a:b] for a, b in spans]

    def apostrophe_runs(self) -> list[tuple[int, int]]:
        """Runs of letters, apostrophes and hyphens that hold an apostrophe."""
        if "'" not in self.text and "’" not in self.text:
            return []
        inside = np.zeros(len(self.points) + 2, bool)
        inside[1:-1] = self.kinds & RUN
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        held = np.unique(np.searchsorted(edges[::2], np.flatnonzero((self.points == 0x27) | (self.points == 0x2019)), "right") - 1)
        return list(zip(edges[::2][held].tolist(), edges[1::2][held].tolist()))

    def spaces(self) -> list[int]:
        return np.flatnonzero(self.kinds & SPACE).tolist()

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> Strings:
        """The texts of sorted spans that lie apart."""
        a, b = self.bytes_of(starts), self.bytes_of(ends)
        data = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[a] = 1
        edge[b] -= 1
        return Strings(data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], b - a)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of letters and digits, which single apostrophes between two of them do not part."""
        inside = np.zeros(len(self.points) + 2, bool)
        inside[1:-1] = self.kinds & ALNUM
        quotes = np.flatnonzero((self.points == 0x27) | (self.points == 0x2019)) + 1
        joined = quotes[inside[quotes - 1] & inside[quotes + 1]]
        inside[joined] = True
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def lexical(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """White-space words without ASCII punctuation at their ends (starts, ends, machine): alphabetic ones, and machine-like ones."""
        run = np.cumsum(self.kinds & SPACE, dtype=np.int32)
        core = np.flatnonzero(self.kinds & (SPACE | EDGE) == 0)
        if not len(core):
            return core, core, core.astype(bool)
        new = np.flatnonzero(np.diff(run[core])) + 1
        starts, ends = core[np.concatenate(([0], new))], core[np.concatenate((new - 1, [len(core) - 1]))] + 1
        n = lambda bit: np.concatenate(([0], np.cumsum((self.kinds & bit) != 0)))
        machines, letters = n(MACHINE), n(ALPHA)
        machine = machines[ends] > machines[starts]
        kept = machine | (letters[ends] - letters[starts] == ends - starts)
        return starts[kept], ends[kept], machine[kept]

    def plain(self) -> list[int]:
        """The first letter or digit of every white-space word that has one."""
        inked = np.flatnonzero(self.kinds & ALNUM)
        run = np.cumsum(self.kinds & SPACE, dtype=np.int32)[inked]
        return inked[np.flatnonzero(np.diff(run, prepend=-1))].tolist()

    def gaps(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What stands between each word and the one before it, by its number in GAPS."""
        out = np.zeros(len(starts), np.int8)
        if len(starts) > 1:
            a, b = ends[:-1], starts[1:]
            ink = np.concatenate(([0], np.cumsum((self.kinds & SPACE) == 0)))
            hyphen = (b - a == 1) & (self.points[a] == 0x2D)
            out[1:] = np.where(a == b, 0, np.where(ink[a] == ink[b], 1, np.where(hyphen, 2, 3)))
        return out


class Spans:
    """Sorted spans that lie apart: overlap and containment by bisection."""

    def __init__(self, spans: Sequence[tuple[int, int]]):
        self.spans = list(spans)
        self.starts = [a for a, _ in self.spans]
        self.ends = [b for _, b in self.spans]

    def between(self, a: int, b: int) -> list[tuple[int, int]]:
        """Those that share a place with [a, b)."""
        return self.spans[bisect_right(self.ends, a) : bisect_left(self.starts, b)]

    def touches(self, a: int, b: int) -> bool:
        return bisect_right(self.ends, a) < bisect_left(self.starts, b)

    def holds(self, a: int, b: int) -> bool:
        """Whether one of them contains [a, b)."""
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and b <= self.ends[k]


@dataclass
class Document:
    """Spans of one text, in characters."""

    text: str
    protected: list = field(default_factory=list)
    headings: list = field(default_factory=list)
    paragraphs: list = field(default_factory=list)
    lists: list = field(default_factory=list)  # [depth, start, end, introduced]
    items: list = field(default_factory=list)  # [list, depth, start, end]


def lines_of(text: str) -> Iterator[tuple[int, int]]:
    """(start, end without the newline) of every line; a text that ends in a newline has no line after it."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, end
        at = end + 1


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _heading(line: str, indent: int) -> tuple[int, int] | None:
    """The content of an ATX heading within its line (it may be empty), None if it is none."""
    m = _HASHES.match(line)
    if m is None or indent > 3:
        return None
    end = len(line.rstrip(" \t"))
    bare = len(line[:end].rstrip("#"))
    if bare < end and (bare <= m.end() or line[bare - 1] in " \t"):
        end = len(line[:bare].rstrip(" \t"))
    start = m.end() + len(line[m.end() :]) - len(line[m.end() :].lstrip(" \t"))
    return (start, end) if start < end else (m.end(), m.end())


def _html(line: str, in_paragraph: bool) -> re.Pattern | str | None:
    """What ends the HTML block that starts here: a pattern, "" for the next blank line, None if none starts."""
    if "<" not in line[:4]:
        return None
    for begin, end in _HTML_ENDED:
        if begin.match(line):
            return end
    if _HTML_TAG.match(line) or (not in_paragraph and _HTML_LONE.match(line)):
        return ""
    return None


def _unquoted(line: str, quotes: int) -> int:
    """Where a line goes on after so many quote marks, -1 if it has fewer."""
    at = 0
    for _ in range(quotes):
        m = _QUOTE_MARK.match(line, at)
        if m is None:
            return -1
        at = m.end()
    return at


def _wide(line: str) -> int:
    """Columns of white space before the line's text."""
    if "\t" not in line:
        return len(line) - len(line.lstrip(" "))
    return len(line[: len(line) - len(line.lstrip(" \t"))].expandtabs(4))


def _content(line: str, columns: int) -> int:
    """Characters of the line's white space that fill so many columns."""
    if not columns:
        return 0
    k, col = 0, 0
    while col < columns and k < len(line) and line[k] in " \t":
        col += 4 - col % 4 if line[k] == "\t" else 1
        k += 1
    return k


def blocks_of(text: str) -> Document:
    """Blocks by lines. Open containers are quotes (a number of marks) and items (a stack); a line with fewer marks or less indent
    closes them and the code or HTML within, unless it goes on with a paragraph of theirs (lazily)."""
    d = Document(text)
    para: list[int] | None = None  # start, end
    stack: list[list[int]] = []  # indent of content, list number, indent of the mark
    quotes = list_quotes = 0  # quote marks of the open paragraph or list
    fence = ""
    fence_at = last = 0
    html: re.Pattern | str | None = None
    inside = (0, 0)  # quote marks and indent of the open code or HTML
    skip = 0  # where a link reference definition ends
    after_blank = True  # no paragraph is open that a line could go on with
    ink = ""  # the last character before the line that is no white space

    def close_para():
        nonlocal para
        if para:
            if not stack:
                d.paragraphs.append((para[0], para[1]))
            para = None

    def grow(b: int):
        if stack:
            d.items[-1][3] = b
        for s in stack:
            d.lists[s[1]][2] = max(d.lists[s[1]][2], b)

    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()  # a text that ends in a newline has no line after it
    after_line = 0
    for line in lines:
        a, after_line = after_line, after_line + len(line) + 1
        if line[-1:] == "\r":
            line = line.rstrip("\r")
        b = a + len(line)
        if html is None and not fence and a >= skip:
            # most lines are empty, or start with a letter and open nothing
            if not line:
                if list_quotes:
                    stack.clear()  # the blank line closes the quote of a list
                if para:
                    close_para()
                after_blank = True
                continue
            if not stack and line[0].isalpha() and line[1:2] not in _MARK_ENDS:
                if para is None:
                    para, quotes = [a, b], 0
                para[1] = b
                ink, after_blank = line.rstrip()[-1], False
                continue
        body = line.strip()
        before, ink = ink, body[-1:] or ink
        if a < skip:
            continue
        if fence or html is not None:
            at = _unquoted(line, inside[0]) if inside[0] else 0
            held = line[at:].strip() if at >= 0 else ""
            if at < 0 or (held and _wide(line[at:]) < inside[1]):
                if fence:
                    d.protected.append((fence_at, last))
                fence, html, after_blank = "", None, True
            elif fence:
                last = b
                grow(b)
                if held.startswith(fence) and not held.strip(fence[0]):
                    d.protected.append((fence_at, b))
                    fence = ""
                continue
            elif html == "" and not held:
                html = None
            else:
                if held:
                    d.protected.append((a + at, b))
                    grow(b)
                if html and html.search(line):
                    html = None
                continue
        quoted = _QUOTE.match(line) if ">" in line[:4] else None
        marks = quoted[0].count(">") if quoted else 0
        if stack and (marks > list_quotes or (not body and marks < list_quotes)):
            # a quote closes the items that it is not indented into; a blank line closes the quote of a list
            room = _wide(line) if body else -1
            while stack and stack[-1][0] > room:
                stack.pop()
        if para and marks > quotes:
            close_para()
        if quoted:
            a, line = a + quoted.end(), line[quoted.end() :]
            body, before = line.strip(), ">"
        if not body:
            close_para()
            after_blank = True
            continue
        # every construct but a paragraph is told by the first character that is no blank
        bare = line.lstrip(" \t")
        first = bare[:1]
        # the first characters of a line rule most items out
        item = _ITEM.match(line) if first in _BULLETS or bare[1:2] in _MARK_ENDS or first.isdecimal() else None
        if stack and marks < list_quotes and (after_blank or item):
            stack.clear()
        indent = len(line) - len(bare)
        wide = _wide(line) if indent else 0
        if after_blank and stack and wide < stack[-1][0] and not item:
            while stack and wide < stack[-1][0]:
                stack.pop()
        floor = max((s[0] for s in stack if s[0] <= wide), default=0) if stack else 0  # of the innermost item that the line may belong to
        inner = _content(line, floor) if floor else 0
        heading = _heading(line, wide) if first == "#" else None
        after = False
        if first in ("`", "~") and (m := _FENCE.match(line, inner)):
            close_para()
            while stack and stack[-1][0] > floor:
                stack.pop()
            fence, fence_at, last, inside, after = m["mark"], a + inner, b, (marks, floor), True
            grow(b)
        elif wide >= 4 and not stack and not para:
            d.protected.append((a, b))
        elif heading is not None:
            close_para()
            stack.clear()
            if heading[0] < heading[1]:
                d.headings.append((a + heading[0], a + heading[1]))
        elif para and not stack and marks == quotes and first in ("=", "-") and _SETEXT.fullmatch(line):
            d.headings.append((para[0], para[1]))
            para = None
        elif first in ("-", "*", "_") and _RULE.match(line):
            close_para()
            stack.clear()
        elif first == "<" and (end := _html(line[inner:], para is not None or (bool(stack) and not after_blank))) is not None:
            close_para()
            while stack and stack[-1][0] > floor:
                stack.pop()
            d.protected.append((a + inner, b))
            html, inside, after = (None if end and end.search(line) else end), (marks, floor), True
            grow(b)
        elif first == "[" and not stack and not para and (m := _LINK_DEFINITION.match(text, a, b if marks else len(text))):
            skip = m.end()
            d.protected.append((a, skip))
        elif m := item:
            close_para()
            lead = len(m["indent"].expandtabs(4))
            while stack and lead < stack[-1][2]:
                stack.pop()
            list_quotes = marks
            if not stack or lead >= stack[-1][0]:
                d.lists.append([len(stack), a, b, before == ":"])
                stack.append([lead + len(m[0]) - len(m["indent"]), len(d.lists) - 1, lead])
            else:
                stack[-1][0] = lead + len(m[0]) - len(m["indent"])
            d.items.append([stack[-1][1], len(stack) - 1, a + m.end(), b])
            grow(b)
            if (end := _html(line[m.end() :], False)) is not None:
                d.protected.append((a + m.end(), b))
                html, inside, after = (None if end and end.search(line) else end), (marks, stack[-1][0]), True
        elif stack:
            grow(b)
        else:
            stack.clear()
            if para is None:
                para, quotes = [a + indent, b], marks
            para[1] = b
        after_blank = after
    if fence:
        d.protected.append((fence_at, len(text)))
    close_para()
    if "`" in text:
        for a, b in [*d.paragraphs, *d.headings, *((i[2], i[3]) for i in d.items)]:
            if text.find("`", a, b) >= 0:
                d.protected.extend(_code_spans(text, a, b))
    d.protected = union(d.protected)
    return d


def _code_spans(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """From each run of backticks to the next run of the same length."""
    ticks = [m.span() for m in _TICKS.finditer(text, a, b)]
    later: dict[int, int] = {}
    close = [-1] * len(ticks)
    for k in range(len(ticks) - 1, -1, -1):
        size = ticks[k][1] - ticks[k][0]
        close[k] = later.get(size, -1)
        later[size] = k
    k = 0
    while k < len(ticks):
        if close[k] < 0:
            k += 1
        else:
            yield ticks[k][0], ticks[close[k]][1]
            k = close[k] + 1


class Sentences:
    """Sentence spans of parts of one text. Quotes and parentheses hold boundaries back until they close."""

    def __init__(self, text: str, protected: Sequence[tuple[int, int]], spaces: list[int] | None = None):
        self.text = text
        self.protected = Spans(protected)
        self.spaces = [m.start() for m in _SPACE.finditer(text)] if spaces is None else spaces
        self.found: dict[tuple, list[tuple[int, int]]] = {}
        self.token = (-1, 0)  # where the last token looked at starts, with and without its opening marks

    def _word_before(self, i: int) -> str:
        """The token that ends at i without its opening marks; more than three characters of it say no more."""
        k = bisect_left(self.spaces, i)
        start = self.spaces[k - 1] + 1 if k else 0
        if self.token[0] != start:
            bare = start
            while bare < i and self.text[bare] in _OPENERS:
                bare += 1
            self.token = (start, bare)
        bare = min(self.token[1], i)
        return self.text[bare : min(i, bare + 4)]

    def _ends(self, i: int, b: int) -> bool:
        """Whether the period at i is a boundary: not within numbers or names, after short abbreviations, or in "no. 5"."""
        text = self.text
        nxt = text[i + 1] if i + 1 < b else " "
        if nxt.isalpha() or (nxt.isdigit() and i and text[i - 1].isdigit()):
            return False
        word = self._word_before(i)
        if len(word) > 3:
            return True
        ink = _INK.search(text, i + 1, b)
        rest = ink[0] if ink else ""
        if word.lower() == "no" and rest.isdigit():
            return False
        return not (len(word.encode()) <= 3 and word[:1].isalpha() and rest.islower())

    def spans(self, a: int, b: int, colon: bool = False) -> list[tuple[int, int]]:
        """Sentences of text[a:b]; units and paragraphs ask for the same parts, which are split once."""
        key = (a, b, colon)
        if key not in self.found:
            self.found[key] = self._split(a, b, colon)
        return self.found[key]

    def _split(self, a: int, b: int, colon: bool) -> list[tuple[int, int]]:
        text, out, start = self.text, [], a
        depth, quote = 0, ""
        code = iter(self.protected.between(a, b))
        nxt = next(code, None)

        def put(end: int):
            nonlocal start
            ink = _INK.search(text, start, end)
            if ink and _LETTER.search(text, ink.start(), end):
                out.append((ink.start(), end))
            start = end

        for m in _MARK.finditer(text, a, b):
            i, ch = m.start(), m[0]
            while nxt and i >= nxt[1]:
                nxt = next(code, None)
            if nxt and i >= nxt[0]:
                continue
            if ch == '"' and quote in ("", '"'):
                quote = "" if quote else '"'
            elif ch == "“" and not quote:
                quote = "”"
            elif ch == quote and ch == "”":
                quote = ""
            elif not quote and ch == "(":
                depth += 1
            elif not quote and ch == ")" and depth:
                depth -= 1
            elif not quote and not depth and (ch in "?!" or (ch == "." and self._ends(i, b)) or (colon and ch == ":" and not _INK.search(text, i + 1, b))):
                put(i + 1)
        put(b)
        return out


def sentences(text: str, a: int, b: int, protected: list[tuple[int, int]], colon: bool = False) -> list[tuple[int, int]]:
    """Sentence spans of text[a:b]."""
    return Sentences(text, protected).spans(a, b, colon)


def _parentheses(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Contents of the outermost parentheses."""
    depth, at = 0, 0
    for m in _BRACKET.finditer(text, a, b):
        if m[0] == "(":
            depth += 1
            at = m.end() if depth == 1 else at
        elif depth:
            depth -= 1
            if not depth:
                yield at, m.start()


def units_of(d: Document, split: Sentences, notes: list[tuple[int, int]], kinds=KINDS) -> list[tuple[str, int, int, int]]:
    """(kind, parent number or -1, start, end) of word-limit units: of those kinds and, in them, of parentheses."""
    text, out = d.text, []
    held = Spans(notes)
    marks = sorted(x[1] for x in d.lists if x[0] == 0)
    firsts = [x[1] for x in d.lists]

    def add(kind: str, a: int, b: int, colon: bool):
        # depth first without recursion: texts may nest parentheses as deep as they like
        stack = [(kind, -1, iter(split.spans(a, b, colon)))]
        while stack:
            kind_, parent, parts = stack[-1]
            span = next(parts, None)
            if span is None:
                stack.pop()
                continue
            out.append((kind_, parent, *span))
            inner = list(_parentheses(text, *span))
            if inner:
                stack.append(("parenthetical", len(out) - 1, (s for p in inner for s in split.spans(*p))))

    for a, b in d.paragraphs if "prose" in kinds else ():
        if not held.touches(a, b):
            ink = _INK.search(text, b)
            k = bisect_left(marks, b)
            add("prose", a, b, k < len(marks) and (ink is None or marks[k] <= ink.start()))
        else:
            at = a
            for s, e in held.between(a, b):
                if at < s:
                    add("prose", at, s, False)
                at = e
            if at < b:
                add("prose", at, b, False)
    for _, _, a, b in d.items if "item" in kinds else ():
        if not held.touches(a, b):
            k = bisect_right(firsts, a)
            inner = firsts[k] if k < len(firsts) and firsts[k] < b else b
            add("item", a, inner, inner < b)
    for s, e in notes if "note" in kinds else ():
        add("note", text.index(":", s) + 1, e, False)
    return out


def notes_of(text: str) -> list[tuple[int, int]]:
    """NOTE: lines with the following lines that are indented more."""
    out: list[tuple[int, int]] = []
    for at, a, _ in _openings(text, _NOTE):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        b = a + len(text[a:end].rstrip("\r"))
        while end + 1 < len(text):
            first, end = end + 1, text.find("\n", end + 1)
            end = len(text) if end < 0 else end
            if text[first] == "\n" or not text[first].isspace():
                break
            line = text[first:end].rstrip("\r")
            bare = line.lstrip()
            if not bare or len(line) - len(bare) <= at - a or _NOTE.match(bare):
                break
            b = first + len(line)
        out.append((at, b))
    return out


def _openings(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, re.Match]]:
    """(start, start of its line, match) of what the pattern finds with only white space before it on its line."""
    a, seen = 0, 0
    for m in pattern.finditer(text):
        new = text.rfind("\n", seen, m.start())
        # a second find on a line does not open it
        a, opens = (new + 1, True) if new >= 0 else (a, not seen)
        if opens and not text[a : m.start()].strip():
            yield m.start(), a, m
        seen = m.end()


def plain_words(text: str, a: int, b: int, plain: list[int] | None = None) -> int:
    """White-space words of text[a:b] that hold a letter or a digit; plain: Characters.plain() of the text, if it is known."""
    if plain is not None and (not a or text[a - 1].isspace()):
        return bisect_left(plain, b) - bisect_left(plain, a) if a < b else 0
    return sum(1 for _ in _PLAIN.finditer(text, a, b))


class Groups:
    """Canonical count groups (kind, start, end): by start, the longest first, then by rank; one of each span."""

    def __init__(self, groups, plain: list[int] | None = None):
        self.plain = plain
        self.spans, last = [], None
        for a, neg, _, kind in sorted((a, -b, RANKS.get(kind, 9), kind) for kind, a, b in groups if a < b):
            if (a, neg) != last:
                self.spans.append((a, -neg, kind))
            last = (a, neg)
        self.starts = [g[0] for g in self.spans]
        whole = [(a, b) for a, b, kind in self.spans if kind in WHOLE]
        self.whole_starts = [a for a, _ in whole]
        self.whole_ends = np.maximum.accumulate([b for _, b in whole]).tolist() if whole else []

    def words(self, text: str, a: int, b: int) -> int:
        """The word count of text[a:b]: 1 within a group that stands for one word, else each group inside it counts as one word
        (excluded numbering as none), taken from the left, and plain words between them."""
        k = bisect_right(self.whole_starts, a)
        if k and self.whole_ends[k - 1] >= b:
            return 1
        at, n = a, 0
        for k in range(bisect_left(self.starts, a), bisect_left(self.starts, b)):
            s, e, kind = self.spans[k]
            if s >= at and e <= b:
                n += plain_words(text, at, s, self.plain) + (kind != "document_numbering_excluded")
                at = e
        return n + plain_words(text, at, b, self.plain)


#: What stands between two words: nothing, white space only, a hyphen alone, anything else.
GAPS = ["", " ", "-", "x"]


#: Families whose rows are spans.
SPAN_FAMILIES = tuple(f for f in FAMILIES if f not in ("unit_words", "item_words"))
_UNITED = {"units", "unit_words", "tokens"}


def scan(text: str, registry, families=SPAN_FAMILIES) -> dict[str, list[tuple]]:
    """Span families of one text; spans are (start byte, end byte, start character, end character)."""
    out = _scan(text, registry, families)
    for f in ("tokens", "lexical"):
        if f in out:
            start, end, cs, ce, _, *rest = (c.tolist() if isinstance(c, np.ndarray) else c for c in out[f])
            if f == "tokens":
                rest[1] = [GAPS[k] for k in rest[1]]
            out[f] = list(zip(range(len(start)), start, end, cs, ce, [text[a:b] for a, b in zip(cs, ce)], *rest))
    return out


#: Columns of _scan()'s words that scanned() gives.
_GIVEN = (0, 1, 4, 5, 6)


def _scan(text: str, registry, families, kinds=KINDS, counted: bool = True) -> dict:
    """scan(), but the words, of which there are most, come column by column; kinds and counted as in scanned()."""
    d = blocks_of(text) if set(families) != {"lexical"} else Document(text)
    chars = Characters(text)
    sp = (lambda a, b: (a, b, a, b)) if chars.ascii else lambda a, b: (int(chars.at[a]), int(chars.at[b]), a, b)
    want = set(families)
    out: dict[str, list[tuple]] = {}
    protected = Spans(d.protected)
    notes = notes_of(text) if want & {"notes", *_UNITED} else []
    if want & {"paragraphs", *_UNITED}:
        split = Sentences(text, d.protected, chars.spaces())
    if "groups" in want or (counted and "units" in want):
        groups = list(registry.groups(text, d.headings))
    if want & _UNITED:
        units = units_of(d, split, notes, kinds)
    if "protected" in want:
        out["protected"] = [sp(*x) for x in d.protected]
    if "headings" in want:
        out["headings"] = [sp(*x) for x in d.headings]
    if "paragraphs" in want:
        items = Spans([(i[2], i[3]) for i in d.items])
        out["paragraphs"] = [(k, *sp(a, b), len(split.spans(a, b))) for k, (a, b) in enumerate(d.paragraphs) if not items.holds(a, b)]
    if "lists" in want:
        out["lists"] = [(k, x[0], *sp(x[1], x[2]), x[3]) for k, x in enumerate(d.lists)]
    if "items" in want:
        out["items"] = [(k, i[0], i[1], *sp(i[2], i[3]), text[i[2] : i[3]]) for k, i in enumerate(d.items)]
    if "notes" in want:
        out["notes"] = [(k, *sp(a, b), text[text.index(":", a) + 1 : b]) for k, (a, b) in enumerate(notes)]
    if "safety" in want:
        found = [(m["level"].lower(), m.end(), text.find("\n", m.end())) for _, _, m in _openings(text, _SAFETY)]
        found = [(level, a, b if b >= 0 else len(text)) for level, a, b in found]
        out["safety"] = [(k, level, *sp(a, b), text[a:b]) for k, (level, a, b) in enumerate(found)]
    if "units" in want:
        counts = Groups(groups, chars.plain()) if counted else None
        out["units"] = [(k, u[0], u[1], *sp(u[2], u[3]), text[u[2] : u[3]], counts and counts.words(text, u[2], u[3])) for k, u in enumerate(units)]
    if want & {"tokens", "unit_words", "item_words"}:
        starts, ends = chars.words()
        if d.protected:
            apart = np.searchsorted(protected.ends, starts, "right") >= np.searchsorted(protected.starts, ends, "left")
            starts, ends = starts[apart], ends[apart]
    if want & {"tokens", "unit_words"}:
        owner = np.full(len(starts), -1, np.int32)
        within = np.searchsorted(starts, np.array([u[2:] for u in units], np.int64).reshape(-1, 2)).tolist()
        for k in sorted(range(len(units)), key=lambda k: (units[k][2], -units[k][3])):  # inner units come later and win
            owner[within[k][0] : within[k][1]] = k
    if "unit_words" in want:
        own: list[list[str]] = [[] for _ in units]
        held = np.flatnonzero(owner >= 0)
        for k, w in zip(owner[held].tolist(), chars.low(starts[held], ends[held])):
            own[k].append(w)
        out["unit_words"] = [(w,) for w in own]
    if "item_words" in want:
        lo, hi = np.searchsorted(starts, [i[2] for i in d.items]), np.searchsorted(ends, [i[3] for i in d.items], "right")
        out["item_words"] = [(chars.low(starts[a:b], ends[a:b]),) for a, b in zip(lo.tolist(), hi.tolist())]
    if "tokens" in want:
        out["tokens"] = [chars.bytes_of(starts), chars.bytes_of(ends), starts, ends, chars.strings(starts, ends), owner, chars.gaps(starts, ends)]
    if "lexical" in want:
        a, b, machine = chars.lexical()
        out["lexical"] = [chars.bytes_of(a), chars.bytes_of(b), a, b, chars.strings(a, b), machine]
    if "runs" in want:
        out["runs"] = [(*sp(a, b), text[a:b]) for a, b in chars.apostrophe_runs()]
    if "semicolons" in want:
        out["semicolons"] = [sp(m.start(), m.end()) for m in re.finditer(";", text) if not protected.touches(*m.span())]
    if "groups" in want:
        out["groups"] = [(kind, *sp(a, b), text[a:b]) for kind, a, b in groups]
    return out


def schema_of(families=tuple(FAMILIES)) -> str:
    """The schema of scanned()'s rows for those families."""
    return "doc_id long, text string, mode string, " + ", ".join(f"{f} array<struct<{FAMILIES[f]}>>" for f in families)


SCANNED = schema_of()


def _word_column(parts: list):
    """An Arrow array of one column of words: numbers, strings, or what stands before them."""
    import pyarrow as pa

    if isinstance(parts[0], Strings):
        ends = np.concatenate(([0], np.cumsum(np.concatenate([p.sizes for p in parts])))).astype(np.int32)
        data = np.concatenate([p.data for p in parts])
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    whole = np.concatenate(parts)
    return pa.array(GAPS).take(pa.array(whole)) if whole.dtype == np.int8 else pa.array(whole)


def _list_array(rows: list[list], kind, by_column: bool):
    """An Arrow list array of structs, column by column; each row is a list of tuples, or, by_column, of _scan()'s columns of words."""
    import pyarrow as pa

    struct = kind.value_type
    if by_column:
        sizes = [len(r[0]) for r in rows]
        columns = [_word_column([r[k] for r in rows]) for k in _GIVEN[: struct.num_fields]]
    else:
        sizes = [len(r) for r in rows]
        columns = list(zip(*chain.from_iterable(rows))) or [()] * struct.num_fields
        columns = [pa.array(c, struct.field(k).type) for k, c in enumerate(columns)]
    values = pa.StructArray.from_arrays([c.cast(struct.field(k).type) for k, c in enumerate(columns)], fields=list(struct))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "descriptive", families=tuple(FAMILIES), carry=(), with_text: bool = True, kinds=KINDS, counted: bool = True) -> DataFrame:
    """One row of span arrays for each document (see FAMILIES), with the columns carry of docs as they are.

    unit_words are those of procedural documents only, for only their rules ask for them. mode is a column of docs if it has one, else the given mode; with_text=False leaves text null. kinds: the kinds
    of units that are asked for, each with the parentheses in it (tokens belong to these units); counted=False leaves their words null.
    Total: any text gives a result; null counts as empty. Narrow: no shuffle.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    from .units import registry

    families = tuple(families)
    kind: StructType = _parse_datatype_string(schema_of(families))
    for c in carry:
        kind = kind.add(docs.schema[c])
    arrow = to_arrow_schema(kind)
    lean = tuple(f for f in families if f != "unit_words")
    nothing: dict[str, list] = {"unit_words": []}

    def run(batches) -> Iterator:
        reg = registry()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            begin, size, found = 0, 0, []
            for k, (text, m) in enumerate(zip(texts, batch.column(2).to_pylist())):
                found.append(nothing | _scan(text, reg, families if m == "procedural" else lean, kinds, counted))
                size += len(text)
                if size > 1 << 19 or k + 1 == len(texts):
                    n = len(found)
                    own = [batch.column(0).slice(begin, n), pa.array(texts[begin : k + 1] if with_text else [None] * n, pa.string()), batch.column(2).slice(begin, n)]
                    own += [_list_array([f[name] for f in found], arrow.field(name).type, name in ("tokens", "lexical")) for name in families]
                    own += [batch.column(3 + j).slice(begin, n) for j in range(len(carry))]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(own, arrow)], schema=arrow)
                    begin, size, found = k + 1, 0, []

    own = F.col("mode") if "mode" in docs.columns else F.lit(mode)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(own, F.lit(mode)).alias("mode"), *carry)
    return rows.mapInArrow(run, kind)
