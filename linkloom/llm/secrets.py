"""Secret scans: patterns, and weak parts of credentials that count only beside each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import written

#: Characters between two parts of one credential at most: the scope of a part.
SCOPE = 200

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind, pattern, and where the pattern's value begins if its length counts.  The first three kinds
#: are reported wherever they stand.
BASE = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}()",
    "hex": r"[0-9a-f]{24,}()",
}
WEAK = {
    "endpoint": r"(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+()",
    "id": rf"(?i:user|user_?name|login|client_?id|account|key_?id){_VALUE}[A-Za-z0-9_.@-]+()",
    "weak": rf"(?i:pass|pwd|auth|credential|private_?key|signature){_VALUE}[A-Za-z0-9+/_.=-]+()",
}
_KINDS = [*BASE, *WEAK]
#: Which kinds identify, and which are secret: parts of one sort complete parts of the other.
SECRET = ("assign", "hex", "weak")
SHORTEST_VALUE = 6


def _matches(text: Column, pattern: str, kind: str) -> Column:
    r"""Lengths of each match, of what stands between it and the one before, and of its value.

    ``\G`` ties each search to the end of the last match, so the time is linear in the text.
    """
    walk = F.lit(rf"\G(?s:(.*?))({pattern})")
    gaps, whole = (F.regexp_extract_all(text, walk, F.lit(i)) for i in (1, 2))
    values = F.regexp_extract_all(text, walk, F.lit(3)) if kind == "assign" else whole
    # Brought together first: what a lambda calls on the whole text is done again for each match.
    parts = F.transform(
        F.arrays_zip(gaps, whole, values),
        lambda match, i: F.struct(
            F.lit(_KINDS.index(kind)).alias("kind"),
            i.alias("nth"),
            F.length(match["0"]).alias("gap"),
            F.length(match["1"]).alias("width"),
            F.length(match["2"]).alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast(_PARTS))


_PARTS = "array<struct<kind:int,nth:int,gap:int,width:int,value:int>>"


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans`` for each row of ``docs``.

    Base kinds are found by pattern in the whole text, leftmost and without overlaps for each kind.
    Weak parts (endpoints, identifiers, secrets of little weight alone) are added where they lie in
    the scope of a complementary part: an identifier or endpoint with a secret, base or weak, at
    most ``scope`` characters away, a weak secret with an access key, identifier or endpoint.
    Weak parts that overlap a base span are not spans of their own.

    ``spans`` lists ``kind:start:end`` by start, then in the order of the kinds, in code points
    with the end exclusive; ``base_sha256`` is the hash of the base ones alone.  Null texts are
    empty; texts without a span have an empty list.  Repeated rows and null ids stay rows of their
    own.  Other columns are not read.

    Texts are read once; what goes on from there is numbers.  The join of parts with the nearest
    complementary parts before and after them is one pass in order of start over each document's
    spans, whatever their number.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = [_matches(text, pattern, kind) for kind, pattern in (BASE | WEAK).items()]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.flatten(F.array(*found)).alias("parts")
    )
    rows = written(rows, "secrets")

    parts = rows.filter("size(parts) > 0").select("row", "doc_id", F.inline("parts")).repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    spans = parts.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far))
    spans = spans.withColumn("start", F.col("end") - F.col("width"))
    assign = F.col("kind") == _KINDS.index("assign")
    spans = spans.filter(~assign | (F.col("value") >= SHORTEST_VALUE))

    base = F.col("kind") < len(BASE)
    secret = F.col("kind").isin([_KINDS.index(k) for k in SECRET])
    ordered = Window.partitionBy("row").orderBy("start", "kind")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # The rows behind, as those before in the opposite order: a frame that ends at the last row is
    # computed anew for each row.
    backwards = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)

    def beside(these: Column, most: Column) -> Column:
        """Whether one of ``these`` ends after, or starts before, what ``most`` allows."""
        before = F.max(F.when(these, F.col("end"))).over(earlier) + most > F.col("start")
        after = F.min(F.when(these, F.col("start"))).over(later) - most < F.col("end")
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    overlaps = beside(base, F.lit(0))
    near = F.lit(scope + 1)
    linked = F.when(secret, beside(~secret, near)).otherwise(beside(secret, near))
    spans = spans.withColumn("kept", base | (linked & ~overlaps)).filter("kept")

    number = F.struct("start", "kind", "end")
    by_row = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        F.count(F.when(~base, 1)).alias("n_linked"),
        F.array_sort(F.collect_list(number)).alias("found"),
    )
    names = F.array(*map(F.lit, _KINDS))

    def listed(these: Column) -> Column:
        shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        return F.array_join(F.transform(these, shown), ",")

    only_base = F.filter("found", lambda s: s["kind"] < len(BASE))
    some = by_row.select(
        "row", "doc_id", *[f"n_{kind}" for kind in BASE], "n_linked",
        F.sha2(listed(only_base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )
    none = rows.join(some.select("row"), "row", "left_anti").select(
        "row", "doc_id", *[F.lit(0).cast("long").alias(f"n_{kind}") for kind in [*BASE, "linked"]],
        F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"),
    )
    return some.unionByName(none).drop("row")
