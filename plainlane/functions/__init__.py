"""Tokenizers and small text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation but _ / \\ and -, which tokens may start and end with.
_EDGE = "[!\"#$%&'()*+,.:;<=>?@\\[\\]^`{|}~]"
_OPENING, _CLOSING = "[\"“'(\\[{#*`]", "[\"”'\\])},;:?!.`]"
NUMBER_WORD = "^[-+]?(\\p{Nd}[\\p{Nd},]*(\\.\\p{Nd}+)?|\\.\\p{Nd}+)(st|nd|rd|th)?$"


def pieces(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, "[\\p{IsWhite_Space}]+"), lambda w: w != "")


def lexical_words(text: Column) -> Column:
    """Words with their outer punctuation off: array of struct(word, machine); others than alphabetic and machine-like are dropped."""
    bare = F.transform(pieces(text), lambda w: F.regexp_replace(F.regexp_replace(w, f"^{_EDGE}+", ""), f"{_EDGE}+$", ""))
    tagged = F.transform(bare, lambda w: F.struct(w.alias("word"), w.rlike("[_/\\\\.0-9-]").alias("machine")))
    return F.filter(tagged, lambda t: (t["word"] != "") & (t["machine"] | t["word"].rlike("^\\p{IsAlphabetic}+$")))


def count_lexemes(text: Column) -> Column:
    """Words as counting sees them: opening and closing marks off, but a.m., p.m. and no. keep their period."""
    opened = F.transform(pieces(text), lambda w: F.regexp_replace(w, f"^{_OPENING}+", ""))
    closed = F.transform(opened, lambda w: F.when(F.lower(w).isin("a.m.", "p.m.", "no."), w).otherwise(F.regexp_replace(w, f"{_CLOSING}+$", "")))
    return F.filter(closed, lambda w: w != "")


def apostrophe_words(text: Column) -> Column:
    """Runs of letters, apostrophes and hyphens."""
    return F.regexp_extract_all(text, F.lit("[\\p{IsAlphabetic}'’-]+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-case words, everything but letters a separator."""
    return F.filter(F.split(F.lower(text), "[^\\p{IsAlphabetic}]+"), lambda w: w != "")


def is_number(word: Column) -> Column:
    return word.rlike(NUMBER_WORD)


def is_identifier(word: Column) -> Column:
    return word.rlike("[A-Za-z]") & word.rlike("[0-9]") & word.rlike("^[A-Za-z0-9_/.:-]+$")


def simple_sentences(text: Column) -> Column:
    """Sentences by the simple model: ., ? or ! before white space or at the end."""
    return F.filter(F.split(text, "[.?!]+([\\s]+|$)"), lambda s: s.rlike("[\\p{L}\\p{N}]"))


def mark_offsets(text: Column, mark: str) -> Column:
    """Byte offsets of every occurrence of a one-byte mark, from running sums of the lengths of the parts between them."""
    from ..operators import arrays

    ends = arrays.running_sums(F.transform(F.split(text, f"[{mark}]"), lambda part: F.octet_length(part).cast("bigint") + 1))
    # the last part ends at the text's end, not at a mark
    return F.when(text.isNotNull(), F.transform(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda at: at - 1))
