"""Helpers for expressions that are written as SQL text.

The HTML and URL expressions nest deeply.  Handing Spark one text instead of building them node by
node saves thousands of calls to the JVM for every query.
"""

from __future__ import annotations


def quoted(value: str) -> str:
    """SQL string literal of ``value``."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"
