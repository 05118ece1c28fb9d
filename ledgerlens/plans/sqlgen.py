"""Small helpers that spell keyword rules as SQL text for the DuckDB oracle."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(col: str, words, lower: bool = True) -> str:
    c = f"lower({col})" if lower else col
    return "(" + " OR ".join(f"coalesce(contains({c}, {q(w)}), false)" for w in words) + ")"


def classify(col: str, rules, default) -> str:
    parts = " ".join(f"WHEN {contains_any(col, ws)} THEN {q(label)}" for label, ws in rules)
    d = "NULL" if default is None else q(default)
    return f"(CASE {parts} ELSE {d} END)"


def count_present(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(coalesce(contains({col}, {q(w)}), false) AS INT)"
                            for w in dict.fromkeys(words)) + ")"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double; ``+ 0.0`` turns a rounded negative zero into 0.0."""
    return f"(round({expr}, {digits}) + 0.0)"
