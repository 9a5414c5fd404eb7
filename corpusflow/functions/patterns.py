"""Regular expressions: fixed patterns, and writing Python-style ones for Spark."""

from __future__ import annotations

import re

# Capitals that mark an initial ("M. Gandhi"), the sentence
# splitter and the word limit. Results depend on these exact patterns.
CAPITALS = "A-ZÀÈÌÒÙÁÉÍÓÚÝÂÊÎÔÛÄËÏÖÜÃÑÕÆÅÐÇØ"
SENTENCE_SPLIT = (
    r"(\s*\n+\s*"
    rf"|(?<!\s[{CAPITALS}])[\?\!？\!\.。！……]+\s+"
    r"|\s+\|\s+"
    r"|[？。！……]+)"
)
WORD_LIMIT = r"[^\w\/]+"

# The same splitter without look-behind, for SQL engines on RE2: first drop one
# closing mark after an initial, then count.
SQL_INITIAL = rf"(\s[{CAPITALS}])[?!.]"
SQL_SENTENCE_SPLIT = r"\s*\n+\s*|[?!？.。！…]+\s+|\s+\|\s+|[？。！…]+"


def spark_regex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A Python text pattern with Python's meaning of ``\\w \\s \\b`` and ``.`` in Spark.

    ``U`` makes the classes Unicode-aware and ``d`` makes the newline the only
    character that a dot does not match.
    """
    flags = "Ud" + ("i" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def spark_replacement(template: str) -> str:
    r"""A Python replacement template (``\1``, ``\g<1>``) in Spark's ``$1`` notation."""
    protected = template.replace("$", r"\$")
    protected = re.sub(r"\\g<(\d+)>", r"$\1", protected)
    protected = re.sub(r"\\(\d{1,2})", r"$\1", protected)
    return protected.replace(r"\n", "\n").replace(r"\t", "\t")


def never_empty(pattern: str) -> str:
    """Reject a pattern that matches the empty string: its matches have no text."""
    if not pattern or re.compile(pattern).match(""):
        raise ValueError(f"the pattern must not match the empty string: {pattern!r}")
    return pattern
