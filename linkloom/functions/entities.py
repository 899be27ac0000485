"""HTML character references.

Strings without an ampersand cost one ``contains``; only the others are cut into tokens and
looked up.
"""

from __future__ import annotations

from html.entities import html5

from linkloom.functions.text import quoted

_PAIR, _KV = "\x01", "\x02"

# Keys stand as between '&' and the end of the reference: "amp;" and, for old names, also "amp".
_NAMED = "str_to_map({}, {}, {})".format(
    quoted(_PAIR.join(f"{name}{_KV}{value}" for name, value in sorted(html5.items()))),
    quoted(_PAIR),
    quoted(_KV),
)
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_OLD_PREFIX = "^&(" + "|".join(_OLD_NAMES) + ")"

# Numeric references to 0x80-0x9F mean the Windows-1252 character, as in browsers.
_WIN1252 = ", ".join(
    str(ord(bytes([b]).decode("cp1252", errors="ignore") or chr(b))) for b in range(0x80, 0xA0)
)

_NUMERIC = r"&#(?:[xX][0-9a-fA-F]++|[0-9]++);?+"
_NAME = r"&[A-Za-z]++[0-9]*+"
_REST = r"[^&]++|&"
# In an attribute a name without ';' counts only when no letter, digit, '=', '-' or '_' follows.
_ATTR_TOKENS = rf"(?s){_NUMERIC}|{_NAME}(?:;|(?![A-Za-z0-9=_-]))|{_REST}"
_TEXT_TOKENS = rf"(?s){_NUMERIC}|{_NAME};?+|{_REST}"

_CODE = """CAST(CASE WHEN length(d) > 8 THEN '1114112' WHEN d = '' THEN '0'
    WHEN lower(substring(t, 3, 1)) = 'x' THEN conv(d, 16, 10) ELSE d END AS BIGINT)"""
_MAPPED = f"""CASE WHEN c > 1114111 OR c BETWEEN 55296 AND 57343 THEN 65533
    WHEN c BETWEEN 128 AND 159 THEN get(array({_WIN1252}), CAST(c - 128 AS INT)) ELSE c END"""
_CHARACTER = f"""array_join(transform(transform(transform(
    array(regexp_extract(t, '^&#[xX]?0*([0-9a-fA-F]*)', 1)),
    d -> {_CODE}), c -> {_MAPPED}),
    p -> decode(unhex(lpad(hex(CAST(p AS BIGINT)), 8, '0')), 'UTF-32')), '')"""


def _lookup(in_attribute: bool) -> str:
    rest = "t"
    if not in_attribute:
        prefix = f"regexp_extract(t, {quoted(_OLD_PREFIX)}, 1)"
        rest = f"""CASE WHEN {prefix} <> ''
            THEN concat(try_element_at({_NAMED}, {prefix}), substring(t, length({prefix}) + 2))
            ELSE t END"""
    return f"""CASE WHEN NOT startswith(t, '&') OR t = '&' THEN t
        WHEN t = '&amp;' THEN '&'
        WHEN startswith(t, '&#') THEN {_CHARACTER}
        ELSE coalesce(try_element_at({_NAMED}, substring(t, 2)), {rest}) END"""


def decode_entities(text: str, in_attribute: bool = False) -> str:
    """SQL that replaces character references; attributes have the stricter rule.

    ``text`` occurs three times, so it should be a column or lambda variable.
    """
    pattern = quoted(_ATTR_TOKENS if in_attribute else _TEXT_TOKENS)
    tokens = f"regexp_extract_all({text}, {pattern}, 0)"
    decoded = f"array_join(transform({tokens}, t -> {_lookup(in_attribute)}), '')"
    return f"CASE WHEN contains({text}, '&') THEN {decoded} ELSE {text} END"
