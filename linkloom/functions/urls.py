"""URL resolution and URL predicates.

The rules are those of ``java.net.URL``: an absolute link keeps its spelling except for the case
of the scheme; a relative path is merged with the base path and loses its dot segments.  The
common cases are decided by prefix tests; only links with dots, user information or unusual
schemes take the long way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import quoted

# A link ending in one of these is not a page.
SKIP_EXTENSIONS = (".pdf", ".doc", ".jpg", ".png", ".zip", ".exe", ".rar", ".apk")

_SKIP_SUFFIX = r"(?:" + "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS) + r")\z"
_CONTROL = quoted("".join(map(chr, range(0x20))))
_SCHEME = quoted(r"^[A-Za-z][A-Za-z0-9.+-]*:")
_HIERARCHICAL = quoted(r"^(?i:https?|ftp):")
_AUTHORITY = quoted(r"^[^:]*+://")
_UNUSUAL = quoted(r"@|:///|//[^/?#]*+/\.")
_HEAD = quoted(r"^[^:]*+:(?://[^/?#]*+)?+")
_PATH = quoted(r"^[^?#]*+")
_USER = quoted(r"^//.*@")
_ABOVE_ROOT = quoted(r"^/(?:\.\.?/)++")
_CUT = "\x01"
_MARK = quoted("\x02")
_BASE = quoted(
    r"(?s)^([A-Za-z][A-Za-z0-9.+-]*+://)(?:[^/?#@]*+@)?([^/?#]++)"  # origin
    r"((?:[^?#]*/)?)([^?#/]*+)"  # folder, leaf
    r"((?:\?[^#]*+)?)(.*)$"  # query, fragment
)


def clean_reference(raw: str) -> str:
    """SQL that strips control characters, then surrounding blanks."""
    return f"trim(translate({raw}, {_CONTROL}, ''))"


def parse_base(url: str) -> str:
    """SQL array ``[origin, folder, leaf, query, fragment]`` of a base URL.

    Put it into a column of its own, so that it is computed once per page.  A text that is no
    ``scheme://host`` URL gives an array of another length, which counts as no base.
    """
    scheme = f"substring_index(translate({url}, {quoted(_CUT)}, ''), '://', 1)"
    lowered = f"concat(lower({scheme}), substring({url}, length({scheme}) + 1))"
    pieces = quoted(_CUT.join(("$1$2", "$3", "$4", "$5", "$6")))
    return f"split(regexp_replace({lowered}, {_BASE}, {pieces}), {quoted(_CUT)})"


def _merged(folder: str, ref: str) -> str:
    """Path of a relative reference; a ``..`` with nothing above it stays.

    Below a base without any path the JVM keeps dot segments.  A last ``.`` or ``..`` gives way
    to an end mark, which leaves the slash before it.
    """
    whole = f"concat({folder}, {ref})"
    path = f"regexp_extract({whole}, {_PATH}, 0)"
    closed = f"""CASE WHEN endswith({path}, '/.') THEN concat({path}, '/')
        WHEN endswith({path}, '/..') THEN concat({path}, '/', {_MARK}) ELSE {path} END"""
    segments = f"""array_join(aggregate(split({closed}, '/'), CAST(array() AS ARRAY<STRING>), (kept, seg) ->
        CASE WHEN seg = '.' THEN kept
             WHEN seg = '..' AND size(kept) > 1 AND get(kept, size(kept) - 1) <> '..'
             THEN slice(kept, 1, size(kept) - 1)
             ELSE concat(kept, array(seg)) END), '/')"""
    kept = f"replace(replace({segments}, concat('/../', {_MARK}), '/..'), {_MARK}, '')"
    return f"""CASE WHEN {folder} = '' THEN concat('/', {ref})
        WHEN contains({whole}, '/.') THEN concat({kept}, substring({whole}, length({path}) + 1))
        ELSE {whole} END"""


def _external(url: str, joined: str) -> str:
    """Lower-case the scheme; a URL ``joined`` to a base loses user information and leading dots."""
    head = f"regexp_extract({url}, {_HEAD}, 0)"
    scheme = f"lower(substring_index({head}, ':', 1))"
    given = f"substring({head}, length({scheme}) + 2)"
    authority = f"CASE WHEN {joined} THEN regexp_replace({given}, {_USER}, '//') ELSE {given} END"
    rest = f"substring({url}, length({head}) + 1)"
    rooted = f"CASE WHEN {joined} THEN regexp_replace({rest}, {_ABOVE_ROOT}, '/') ELSE {rest} END"
    rebuilt = f"""concat({scheme}, ':', CASE WHEN {given} = '//' THEN '' ELSE {authority} END, {rooted})"""
    return f"""CASE WHEN (startswith({url}, 'http://') OR startswith({url}, 'https://'))
             AND NOT rlike({url}, {_UNUSUAL}) THEN {url}
        WHEN rlike({url}, {_HIERARCHICAL}) THEN {rebuilt}
        ELSE {url} END"""


def _joined(ref: str, base: str) -> str:
    origin, folder, leaf, query, fragment = (f"get({base}, {i})" for i in range(5))
    root = f"CASE WHEN {folder} = '' THEN '/' ELSE {folder} END"
    scheme = f"substring_index({origin}, ':', 1)"
    has_scheme = f"rlike({ref}, {_SCHEME})"
    # "http:x" against an http base with a path is the relative reference "x".
    same = f"""({folder} <> '' AND startswith(lower({ref}), concat({scheme}, ':'))
        AND NOT rlike({ref}, {_AUTHORITY}))"""
    bare = f"CASE WHEN {has_scheme} THEN substring({ref}, length({scheme}) + 2) ELSE {ref} END"
    return f"""CASE
        WHEN {fragment} IS NULL THEN CASE WHEN {has_scheme} THEN {ref} ELSE '' END
        WHEN {has_scheme} AND NOT {same} THEN {ref}
        WHEN startswith({bare}, '//') THEN concat({scheme}, ':', {bare})
        WHEN startswith({bare}, '/') THEN concat({origin}, {bare})
        WHEN {bare} = '' THEN concat({origin}, {folder}, {leaf}, {query}, {fragment})
        WHEN startswith({bare}, '#') THEN concat({origin}, {folder}, {leaf}, {query}, {bare})
        WHEN startswith({bare}, '?') THEN concat({origin}, {root}, {leaf}, {bare})
        ELSE concat({origin}, {_merged(folder, bare)}) END"""


def resolve_all(refs: str, base: str) -> str:
    """SQL array of absolute URLs of cleaned references, ``''`` where a reference has none.

    ``base`` is a column of :func:`parse_base`; without one only references that carry a scheme
    resolve.
    """
    joined = f"transform({refs}, r -> {_joined('r', base)})"
    return f"transform({joined}, u -> {_external('u', f'get({base}, 4) IS NOT NULL')})"


def is_crawlable(url: Column) -> Column:
    """Starts with ``http`` and does not end, in any case, in a skipped extension."""
    return url.startswith("http") & ~F.lower(url).rlike(_SKIP_SUFFIX)


def host_of(url: Column) -> Column:
    """Host of a URL, null when it has none; IPv6 addresses keep their brackets."""
    return F.nullif(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9.+-]*+://(?:[^/?#@]*+@)?(\[[^\]/?#]*+\]|[^/?#:@]*+)", 1), F.lit("")
    )
