"""Near-duplicate documents: all SimHash links, and those of exact Jaccard similarity, most of which it can't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.graph import components
from linkloom.llm.lines import WORDS, Cut, may_match, set_groups
from linkloom.llm.simhash import close_fingerprints, fingerprints
from linkloom.scratch import written


def fingerprint_pairs(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``a, b``: sets (``held``: ``doc_id, line_set``) whose documents have linked SimHash fingerprints.

    Links are those of :func:`linkloom.llm.simhash.near_duplicates`; one set stands for each fingerprint.
    """
    prints = fingerprints(docs.filter("doc_id is not null")).distinct()
    prints = written(prints.join(held.distinct(), "doc_id").select("fp", "line_set").distinct(), "set-prints")
    nodes = written(prints.groupBy("fp").agg(F.min("line_set").alias("doc_id")), "print-nodes")
    equal = prints.join(nodes, "fp").filter("line_set <> doc_id").select(F.col("line_set").alias("a"), F.col("doc_id").alias("b"))
    # A set of two fingerprints, of rows that repeat an id, may meet itself.
    return equal.unionByName(close_fingerprints(nodes)).filter("a <> b")


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, component_id`` for each id of ``docs`` (``doc_id``, ``text``).

    A text is the set of its sequences of ``words`` following words, cut at ASCII blanks and with
    A-Z in lower case; one of fewer words is one sequence, and null, empty and blank texts are
    equal.  Texts link if their SimHash fingerprints do, as in :func:`linkloom.llm.simhash.near_duplicates`,
    and if their sets have a Jaccard similarity of 0.8 or more; ``component_id`` is the smallest id
    that can be reached.  Rows without an id are left out.  An id that repeats is one node,
    whatever its texts.

    Fingerprints reach few pairs of that similarity and some that are less similar as sets, where
    what repeats in both texts outweighs the rest.  So neither stands for the other: links of
    fingerprints stay whatever their sets, and sets also meet as in
    :func:`linkloom.llm.lines.repeated_lines`: each is verified against two of each of its groups;
    then those of a group that these links leave apart are compared, so that copies make no pairs and
    no link that joins components is missed.
    """
    sets = set_groups(docs.filter("doc_id is not null"), Cut(words, short=True, whole=True), again=True)
    node = sets.firsts.select("line_set", F.col("place.doc_id").alias("node"))

    def linked(pairs: DataFrame) -> DataFrame:
        ends = (node.select(F.col("line_set").alias(x), F.col("node").alias(f"node_{x}")) for x in "ab")
        found = pairs.join(next(ends), "a").join(next(ends), "b")
        return found.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    held = sets.lines.select("doc_id", "line_set")
    # A repeated id ties its rows together, whatever their texts.
    same = held.groupBy("doc_id").agg(F.min("line_set").alias("x"), F.max("line_set").alias("y")).filter("x <> y")
    tied = held.join(same.select("doc_id"), "doc_id").join(node, "line_set").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    prints = written(fingerprint_pairs(docs, held), "print-links")
    similar = sets.similar(prints.unionByName(sets.tried()))
    known = written(linked(prints.unionByName(similar)).unionByName(tied), "document-links")

    first = components(known).withColumnRenamed("component", "known")
    members = sets.members.withColumn("node", F.col("place.doc_id")).join(first, "node", "left")
    members = members.withColumn("known", F.coalesce("known", "node"))
    members = written(members.select("group", "line_set", "size", "at", "known"), "document-groups")
    # Groups in which some are apart, and the component that most of a group are in.
    parted = members.groupBy("group").agg(F.mode("known").alias("main"), F.min("known").alias("x"), F.max("known").alias("y"))
    parted = written(members.join(parted.filter("x <> y").select("group", "main"), "group"), "document-rest")
    pairs = parted.filter("known <> main").alias("x").join(parted.alias("y"), "group")
    pairs = pairs.filter("x.known <> y.known and (y.known = y.main or x.line_set < y.line_set) and " + may_match("x", "y"))
    rest = linked(sets.similar(pairs.select(F.col("x.line_set").alias("a"), F.col("y.line_set").alias("b"))))

    found = components(known.unionByName(rest))
    own = held.join(node, "line_set").groupBy("doc_id").agg(F.min("node").alias("node"))
    return own.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each group of :func:`similar_documents`: the smallest id.

    All columns stay.  Rows without an id are in no group and stay, also those with equal texts;
    rows that repeat the smallest id stay together.
    """
    others = similar_documents(docs, words).filter("doc_id <> component_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
