"""Small builders for the comparison SQL, so that patterns are written once."""

from __future__ import annotations

from collections.abc import Sequence


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {lit(pattern)}), false)"


def g(col: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {group}), '')"


def hits(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {lit(pattern)}))"


def rewrite(col: str, steps: Sequence[tuple[str, str]]) -> str:
    out = col
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement.replace('$', chr(92)))}, 'g')"
    return out


def strip(col: str) -> str:
    return f"trim({col}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def words(col: str, items: Sequence[str]) -> str:
    """Number of whole words of ``items`` that occur in ``col``."""
    return "(" + " + ".join(m(col, rf"\b{w}\b") + "::int" for w in items) + ")"


def any_contains(col: str, items: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({col}, {lit(w)})" for w in items) + ")"


def array(items: Sequence[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def fold(col: str) -> str:
    """Make letters beyond ASCII count as word characters for ``\\b``."""
    return f"regexp_replace({col}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{M}}]', 'q', 'g')"
