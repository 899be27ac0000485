"""Mixing sources to target weights: budgets down a tree, then token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.scratch import written

#: Hexadecimal digits that part the order of a leaf.  Sums of the parts find where a budget ends.
PART_DIGITS = 4
_WIDE = "decimal(38,0)"


def token_count(text: Column) -> Column:
    """Tokens of a text, taken as one for every four bytes begun; null has none."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def _matching(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` where ``keys`` agree, null with null."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_{k}" for k in keys])


def budgets(
    stock: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int
) -> DataFrame:
    """``stock`` (``levels``, ``tokens`` of each leaf) with the token ``budget`` of each leaf.

    ``share`` is the fraction of all tokens to hand out.  ``weights`` names whole numbers above
    zero for values of a level; others, null too, weigh 1.  A node can take ``epochs`` times its
    tokens.  From the root down a node's budget is parted among its children by weight.  What a
    child can't take goes to its siblings by their weights; as no node is given more than its
    children can take together, only a shortage of all siblings reaches their parent's siblings.
    Whole-number arithmetic throughout, shares rounded down.
    """
    leaves = stock.withColumn("can", F.col("tokens").cast(_WIDE) * epochs)
    total = leaves.agg(F.sum("can").alias("can"), F.sum("tokens").cast(_WIDE).alias("tokens"))
    given = total.select(
        F.least("can", F.expr(f"cast(tokens * {share[0]} div {share[1]} as {_WIDE})")).alias("given")
    )
    for depth, level in enumerate(levels):
        parent, path = list(levels[:depth]), list(levels[: depth + 1])
        children = leaves.groupBy(*path).agg(F.sum("can").alias("can"))
        weight = F.lit(1)
        for name, own in weights.get(level, {}).items():
            weight = F.when(F.col(level) == name, own).otherwise(weight)
        children = children.withColumn("weight", weight.cast(_WIDE))
        # The root is one row of one number; below it, parents.
        children = _matching(children, given, parent) if parent else children.join(F.broadcast(given))
        family = Window.partitionBy(*parent, F.lit(0))
        order = family.orderBy(F.col("can").cast("double") / F.col("weight").cast("double"), *path)
        before = F.coalesce(F.sum("can").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sharers = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        children = children.withColumns({"rest": (F.col("given") - before).cast(_WIDE), "sharers": sharers.cast(_WIDE)})
        # Children that run short stand first; the first other one fixes what a unit of weight gets.
        short = F.col("can") * F.col("sharers") <= F.col("rest") * F.col("weight")
        unit = F.max(F.when(~short, F.struct("sharers", "rest"))).over(family)
        children = children.withColumns({"short": short, "unit": unit})
        fair = F.expr(f"cast(unit.rest * weight div unit.sharers as {_WIDE})")
        given = children.select(*path, F.when(F.col("short"), F.col("can")).otherwise(fair).alias("given"))
    return _matching(stock, given, levels).withColumn("budget", F.col("given").cast("long")).drop("given")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column | str],
    weights: Mapping[str, Mapping[str, int]],
    share: tuple[int, int] = (1, 2),
    epochs: int = 4,
    seed: int = 42,
) -> DataFrame:
    """``doc_id``, the levels, ``tokens``, ``whole_epochs``, ``last_tokens`` for each row of ``docs``.

    ``levels`` names the tree from the root down by columns or expressions of ``docs``; see
    :func:`budgets` for the rest.  A leaf reads its documents in epochs, each in its own order by
    hash of seed, epoch and id, until its budget is used up: ``whole_epochs`` times all of them,
    then a prefix, of which ``last_tokens`` fall to this document (all, some of the last one, or
    none).  So the tokens taken of a leaf are exactly its budget.

    Null ids share one place in the order; equal rows may trade places.  Null and empty texts have
    no tokens.  Null levels are nodes of their own.  No row is dropped.  Other columns are not read.
    """
    named = {name: F.col(c) if isinstance(c, str) else c for name, c in levels.items()}
    rows = docs.select("doc_id", *[c.alias(n) for n, c in named.items()], token_count(F.col("text")).alias("tokens"))
    rows = written(rows, "mix")
    stock = rows.groupBy(*named).agg(F.sum("tokens").alias("tokens"))
    leaves = budgets(stock, list(named), weights, share, epochs)
    used = F.expr("case when tokens > 0 then budget div tokens else 0 end")
    leaves = leaves.select(
        *named, used.alias("whole_epochs"), (F.col("budget") - used * F.col("tokens")).alias("last_budget"),
        F.to_json(F.struct(*named)).alias("leaf"),
    )
    place = F.md5(F.concat_ws(":", F.lit(seed), "whole_epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ordered = _matching(rows, leaves, list(named)).withColumn("place", place)
    ordered = ordered.withColumn("part", F.substring("place", 1, PART_DIGITS))
    # Where the parts of a leaf begin in it: a leaf has 16**PART_DIGITS of them at most.
    parts = ordered.groupBy("leaf", "part").agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.partitionBy("leaf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("leaf", "part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("begin"))
    within = Window.partitionBy("leaf", "part").orderBy("place", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("begin") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    taken = F.greatest(F.lit(0), F.least("tokens", F.col("last_budget") - before)).cast("long")
    return ordered.join(parts, ["leaf", "part"]).select(
        "doc_id", *named, "tokens", F.col("whole_epochs").cast("long"), taken.alias("last_tokens")
    )


def keep_mixed(docs: DataFrame, levels: Mapping[str, Column | str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int]) -> DataFrame:
    """``docs``, all columns, without those of which one epoch of :func:`mix` takes nothing or a part.

    Decisions go by id: rows with the same id stay if any of them is taken whole.  Rows without
    an id, and without tokens, stay.
    """
    taken = mix(docs, levels, weights, share, epochs=1)
    whole = F.col("whole_epochs") * F.col("tokens") + F.col("last_tokens") >= F.col("tokens")
    gone = taken.groupBy("doc_id").agg(F.max(whole).alias("whole")).filter("not whole").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def document_domain(source: Column) -> Column:
    """The domain of a source of ``documents``, the top of its tree."""
    return (
        F.when(source.isin("src0", "src1", "src2", "src3", "src4"), "web")
        .when(source.startswith("src1"), "books")
        .otherwise("reference")
    )


def document_levels() -> dict[str, Column]:
    """The tree of ``documents`` from the root down."""
    return {"domain": document_domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


#: Target weights of the nodes of that tree; others weigh 1.
DOCUMENT_WEIGHTS = {
    "domain": {"web": 5, "books": 3, "reference": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 3, "src7": 2, "src12": 2},
}
