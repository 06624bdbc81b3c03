"""A Spark engine for controlled technical English: the functions that programs call.

>>> from plainlane import lint, check_rewrites, apply_fixes, lookup, effective_glossary
"""

from .operators.grammar import action_structures, noun_phrases, subject_predicates
from .operators.rewrite import check_rewrites
from .operators.structure import scanned
from .plans.fixes import apply_fixes, lint_fixed
from .plans.lint import exit_code, inputs, lint, outcomes, run_status
from .sources.lexicon import lookup
from .sources.profiles import choose_lexicon, effective_glossary
from .sources.texts import human_lines, json_documents, read_texts, write_json

__all__ = [
    "action_structures", "apply_fixes", "check_rewrites", "choose_lexicon", "effective_glossary", "exit_code", "human_lines", "inputs", "json_documents", "lint",
    "lint_fixed", "lookup", "noun_phrases", "outcomes", "read_texts", "run_status", "scanned", "subject_predicates", "write_json",
]
