"""Diagnostics of some codes only: the same ones, from less of the scan."""

import random
import re

import pytest

from plainlane import registry
from plainlane.operators import rules, structure
from plainlane.operators.units import registry as unit_registry
from plainlane.plans import lint
from plainlane.sources import tables

TEXTS = [
    "NOTE: Remove the cap (open it). Do it.\n  more of it\n\nThe pipe; it's hot.\r\n- first item, \n- The tool;\n\nWARNING : The pressure is hot.\n caution: open",
    "  note: Open it.\n   note: Remove it\r\n    and close\n   it\nnote: a note: b\n x\n\n y", "Use this:\n\n- Turn the tool\n  NOTE: Remove it.\n- `a;b` don’t; and İt's\n> note: Open the cap", "", None, "NOTE:", "\n\nwarning:\n:",
    "- The pump \n- is closed. \x85\n- öl,\x0b\n1) Close the door and open it\n\nIf it is hot remove it. Open it and close it.",
]
KEYS = ("doc_id", "code", "severity", "start", "end", "message", "evidence")


@pytest.mark.parametrize("codes", [{"STE-NOTE-001"}, {"STE-LIST-002", "STE-SAFE-001"}, {"STE-LIST-001", "STE-NOTE-002"}, {"STE-LIST-004", "STE-SYN-001", "STE-SAFE-002"}, {"STE-PROC-002", "STE-PROC-003", "STE-LIST-003"}, {"STE-PUNC-001"}])
def test_some_codes_are_those_of_all(spark, codes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    families = [rules.punctuation, rules.contractions, rules.lists, rules.notes, rules.procedural]
    rows = lambda df: sorted(map(str, df.select(*KEYS).collect()))
    all_ = lint.lint(docs, mode="procedural", families=families)
    want = rows(all_.where(all_["code"].isin(*codes)))
    assert rows(lint.lint(docs, mode="procedural", families=families, codes=codes)) == want and want


def test_marked_rules_scans_no_more_than_its_codes_read(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "one two three four " * 12, "en", "s", 228)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(tables, "staged", lambda df, label: seen.append(df) or df)
    registry.queries()["marked_rules"](spark, str(tmp_path))
    (scan,) = seen
    assert not {"item_words", "tokens", "groups", "protected"} & set(scan.columns)
    units = scan.first()["units"]
    assert {u["kind"] for u in units} == {"note"} and all(u["words"] is None for u in units) and len(units) == 4


def _lines(text):
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end + 1


def _notes(text):
    out, indent = [], -1
    for a, whole in _lines(text):
        line = whole.rstrip("\r")
        if m := re.match(r"(\s*)note:", line, re.I):
            indent = len(m[1])
            out.append((a + indent, a + len(line)))
        elif indent >= 0 and line.strip() and len(line) - len(line.lstrip()) > indent:
            out[-1] = (out[-1][0], a + len(line))
        else:
            indent = -1
    return out


def _safety(text):
    return [(m[1].lower(), a + m.end(), a + len(line)) for a, line in _lines(text) if (m := re.match(r"\s*(warning|caution)\s*:", line, re.I))]


def test_openings_and_runs_line_by_line():
    rng, reg = random.Random(7), unit_registry()
    parts = ["note:", "NOTE:", "Note :", "warning", "Caution", ":", " :", "\n", "\n", "\r\n", "\r", " ", "  ", "\t", "\x0b", "\x85", " ", "a", "it's", "’", "-", "-x'", "_'", "1'", "²'a", "Σ", "İ'", "(b)", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        got = structure.scan(text, reg, ("notes", "safety", "runs"))
        assert [n[3:5] for n in got["notes"]] == _notes(text), text
        assert [(s[1], *s[4:6]) for s in got["safety"]] == _safety(text), text
        runs = [(m.start(), m.end(), m[0]) for m in re.finditer(r"(?:[^\W\d_]|['’-])+", text) if "'" in m[0] or "’" in m[0]]
        assert [r[2:] for r in got["runs"]] == runs, text


def test_lower_case_is_that_of_each_word():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert {c for c in every if len(c.lower()) != 1} == {"İ"}
    for text in ("ΑΣ.Β ΑΣ", "İki Kelime", "Straße ÖL É", every.replace("Σ", "").replace("İ", "")):
        chars = structure.Characters(text)
        starts, ends = chars.words()
        assert chars.low(starts, ends) == [text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]
