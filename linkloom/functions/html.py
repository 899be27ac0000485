"""Links and title of an HTML text.

One regular expression walks the text tag by tag, so that comments, raw-text elements and quoted
attribute values are stepped over as a whole.  All loops are possessive: the time is linear in
the text and the stack does not grow with it.  This is a tokenizer, not a tree builder.
"""

from __future__ import annotations

from linkloom.functions.entities import decode_entities
from linkloom.functions.text import let, quoted
from linkloom.functions.urls import clean_reference, resolve_all

_END = r"(?=[\s/>])"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)"""
_NAME = r"""(?:[^\s/>=]++|=(?!\s*+["'])[^\s/>=]*+)"""
_ASSIGN = rf"(?:\s*+=\s*+{_VALUE})?+"
_BODY = rf"(?:[\s/]++|{_NAME}{_ASSIGN})*+"
_COMMENT = r"!--(?:-?>|.*?(?:--!?>|\z))"
_DECLARATION = r"[!?][^>]*+(?:>|\z)|/[^a-z>][^>]*+(?:>|\z)"
_RAW_NAMES = "script|style|textarea|title|xmp|iframe|noembed|noframes"


# A start tag of <a> or <base> up to and including its first href; group 2 of the walk below.
_BEFORE = rf"(?:[\s/]++|(?!href[\s/>=]){_NAME}{_ASSIGN})*+"
_LINKING = rf"(?:a|base)(?=[\s/]){_BEFORE}href(?=[\s/>=]){_ASSIGN}"
_WALK = (
    r"(?is)<(?:"
    rf"{_COMMENT}|{_DECLARATION}"
    rf"|({_RAW_NAMES}){_END}{_BODY}>.*?(?:</\1{_END}|\z)"
    rf"|plaintext{_END}.*+"
    rf"|({_LINKING}){_BODY}>"
    rf"|/?[a-z][^\s/>]*+{_BODY}>"
    r"|/?[a-z].*+"
    r")"
)
_HREF_VALUE = rf"(?is)^(?:a|base){_BEFORE}href(?:\s*+=\s*+)?+(.*+)$"

# What may stand before <title> without opening the body.
_TITLE = (
    r"(?is)\A\x{FEFF}?+(?:\s++|<(?:"
    rf"{_COMMENT}|{_DECLARATION}"
    rf"|/(?!(?:body|html|br){_END})[a-z][^>]*+>"
    rf"|(?:html|head|meta|link|base|basefont|bgsound|command){_END}{_BODY}>"
    rf"|(script|style|noscript|template|noframes){_END}{_BODY}>.*?(?:</\1{_END}[^>]*+>|\z)"
    rf"))*+<title{_END}{_BODY}>(.*?)(?:</title{_END}|\z)"
)


def references(html: str) -> str:
    """SQL array of ``(is_base, ref)`` for ``<a href>`` and ``<base href>`` in document order."""
    tokens = f"filter(regexp_extract_all({html}, {quoted(_WALK)}, 2), t -> t <> '')"
    values = f"""transform({tokens}, t -> named_struct(
        'is_base', lower(left(t, 1)) = 'b', 'ref', regexp_extract(t, {quoted(_HREF_VALUE)}, 1)))"""
    quote = quoted("'")
    bare = f"""transform({values}, v -> named_struct('is_base', v.is_base, 'ref',
        CASE WHEN startswith(v.ref, '"') OR startswith(v.ref, {quote})
             THEN substring(v.ref, 2, length(v.ref) - 2) ELSE v.ref END))"""
    decoded = decode_entities("b.ref", in_attribute=True)
    return f"""transform({bare}, b -> named_struct('is_base', b.is_base,
        'ref', {clean_reference(decoded)}))"""


def _refs_of(refs: str, is_base: str) -> str:
    return f"transform(filter({refs}, f -> f.is_base = {is_base}), f -> f.ref)"


def declared_base(refs: str, page: str) -> str:
    """SQL: the first ``<base href>`` that resolves against the ``page`` base, or null."""
    urls = resolve_all(_refs_of(refs, "true"), page)
    return f"CASE WHEN exists({refs}, e -> e.is_base) THEN get(filter({urls}, d -> d <> ''), 0) END"


def anchors_resolved(refs: str, base: str) -> str:
    """SQL array: URLs of all ``a[href]`` in order, ``''`` where a reference does not resolve."""
    return resolve_all(_refs_of(refs, "false"), base)


def title_of(html: str) -> str:
    """SQL: the head's first ``<title>`` with entities decoded and blanks folded, else ``''``."""
    text = let(f"regexp_extract({html}, {quoted(_TITLE)}, 2)", "x", decode_entities("x"))
    visible = f"translate({text}, {quoted(chr(0x200B) + chr(0xAD))}, '')"
    blanks = quoted(r"[ \t\n\f\r\x{A0}]++")
    return f"trim(regexp_replace({visible}, {blanks}, ' '))"
