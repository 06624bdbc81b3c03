"""Containers of blocks against spans written by hand: quotes, lazy lines, code and HTML in quotes and items, definitions."""

import time

import pytest

from plainlane.operators import structure
from plainlane.operators.units import registry


def parts(text):
    d = structure.blocks_of(text)
    take = lambda spans: [text[a:b] for a, b in spans]
    return {"p": take(d.paragraphs), "i": take((i[2], i[3]) for i in d.items), "h": take(d.headings), "x": take(d.protected), "depth": [i[1] for i in d.items]}


@pytest.mark.parametrize(
    "text, want",
    [
        # lazy lines go on with a quote's paragraph, and with that of an item in a quote
        ("> one\ntwo\n\nthree", {"p": ["one\ntwo", "three"]}),
        ("> - one\ntwo\n\nthree", {"i": ["one\ntwo"], "p": ["three"]}),
        ("> > one\n> two\nthree", {"p": ["one\n> two\nthree"]}),
        # a quote interrupts a paragraph and a list that it is not indented into; deeper quotes begin anew
        ("one\n> two\n> > three", {"p": ["one", "two", "three"]}),
        ("- one\n> two", {"i": ["one"], "p": ["two"]}),
        ("- one\n  > two\n\nthree", {"i": ["one\n  > two"], "p": ["three"]}),
        # a lazy line underlines no heading, but a rule ends the quote
        ("> one\n===", {"p": ["one\n==="], "h": []}),
        ("> one\n---\ntwo", {"p": ["one", "two"], "h": []}),
        ("> one\n> ===\ntwo", {"p": ["two"], "h": ["one"]}),
        # blank lines in a quote keep it, blank lines without its mark end it and its lists
        ("> - one\n>\n>   two\n\n  three", {"i": ["one\n>\n>   two"], "p": ["three"]}),
        ("> one\n>\n> two", {"p": ["one", "two"]}),
        # an item outside begins another list
        ("> - one\n- two", {"i": ["one", "two"], "depth": [0, 0]}),
        # fenced code in quotes ends at its mark or with the quote
        ("> ```\n> a; b\n> ```\n> one", {"p": ["one"], "x": ["```\n> a; b\n> ```"]}),
        ("> ```\n> a; b\none", {"p": ["one"], "x": ["```\n> a; b"]}),
        ("```\n> a\n```\none", {"p": ["one"], "x": ["```\n> a\n```"]}),
        # and in items, whatever their depth; less indent ends it
        ("- one\n  ```\n  a; b\n  ```\n  two\n\nthree", {"i": ["one\n  ```\n  a; b\n  ```\n  two"], "x": ["```\n  a; b\n  ```"], "p": ["three"]}),
        ("- one\n  - two\n    - three\n\n      ```\n      a; b\n      ```", {"depth": [0, 1, 2], "x": ["```\n      a; b\n      ```"]}),
        ("- one\n  ```\n  a; b\ntwo", {"x": ["```\n  a; b"], "p": ["two"]}),
        ("- one\n```\na; b\n```\ntwo", {"i": ["one"], "x": ["```\na; b\n```"], "p": ["two"]}),
        # three ticks with more ticks behind them open no code
        ("```one``` two\n\nthree", {"p": ["```one``` two", "three"], "x": ["```one```"]}),
        # HTML in quotes and items
        ("> <div>\n> a; b\n> </div>\n>\n> one", {"p": ["one"], "x": ["<div>", "a; b", "</div>"]}),
        ("> <!-- a;\n> b -->\n> one", {"p": ["one"], "x": ["<!-- a;", "b -->"]}),
        ("> <!-- a;\none", {"p": ["one"], "x": ["<!-- a;"]}),
        ("- one\n\n  <div>\n  a; b\n  </div>\n\n  two\n\nthree", {"i": ["one\n\n  <div>\n  a; b\n  </div>\n\n  two"], "x": ["<div>\n", "a; b\n", "</div>\n"], "p": ["three"]}),
        ("- <div>\n  a; b\n\n  one", {"x": ["<div>", "a; b"], "i": ["<div>\n  a; b\n\n  one"]}),
        ("- one\n<div>\na; b\n</div>\n\ntwo", {"i": ["one"], "p": ["two"]}),
        # link reference definitions on several lines; what only looks like one is a paragraph
        ("[a]:\n  http://x\n  'one\ntwo'\nthree", {"p": ["three"]}),
        ("[a b\nc]: <x y>\n[d]: z (t)\n\none", {"p": ["one"]}),
        ("[a]: x\n'one' two", {"p": ["'one' two"]}),
        ("[a]: x one", {"p": ["[a]: x one"]}),
        ("[a]: x \"one\n\ntwo\"", {"p": ["[a]: x \"one", "two\""]}),
        ("one\n[a]: x", {"p": ["one\n[a]: x"]}),
        ("> [a]: x 'y'\n> one", {"p": ["one"]}),
        ("- one\n\n[a]:\n  x\n  'y'\n\ntwo", {"i": ["one"], "p": ["two"]}),
        ("- one\n\n    two\n\n- three\n\nfour", {"i": ["one\n\n    two", "three"], "p": ["four"]}),
        ("- one\n  - two\n\n  three\n- four", {"depth": [0, 1, 0]}),
        # tabs are columns
        ("\ta; b\n\none", {"p": ["one"], "x": ["\ta; b"]}),
        ("- one\n\n\ttwo\n\nthree", {"i": ["one\n\n\ttwo"], "p": ["three"]}),
        ("", {"p": [], "i": [], "h": [], "x": []}),
        (">\n> \n>>", {"p": [], "i": [], "x": []}),
    ],
)
def test_containers(text, want):
    got = parts(text)
    same = {k: [x.strip() for x in v] if k == "x" else v for k, v in got.items()}
    want = {k: [x.strip() for x in v] if k == "x" else v for k, v in want.items()}
    assert {k: same[k] for k in want} == want
    for k in got["x"]:
        assert k in text
    assert structure.scan(text.replace("\n", "\r\n"), registry()) is not None


def test_containers_take_linear_time():
    makes = [
        lambda k: "> a\nb\n" * k, lambda k: "> - a\n> ```\n> x\n" * k, lambda k: "[a]: b \"c\n" * k, lambda k: "[a]: b 'c\\' (d\n" * k, lambda k: "[" * k + "a\n",
        lambda k: "`" * k + " `\n", lambda k: ">" * k + " a\nb\n", lambda k: "- <div>\n  a\n" * k, lambda k: "[a\n" * k, lambda k: "[a]:\n" * k,
    ]
    for make in makes:
        took = []
        for k in (4000, 16000):
            began = time.process_time()
            structure.blocks_of(make(k))
            took.append(time.process_time() - began)
        assert took[1] < 9 * took[0] + 0.3
