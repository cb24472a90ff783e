"""Change detection on trees without common node keys: a matching, and an edit script from it.

Nodes of two versions are matched in passes, each a join by document and a rank
in document order: equal subtrees at one path; members and items that are alike
(same path; texts by edit similarity); inner nodes at one path; equal subtrees
elsewhere, which have moved.  The script then inserts and deletes what has no
match, updates matched leaves with other values and moves matched nodes whose
parents aren't matched with each other.

Defined results: ties are paired in document order; documents that only one
version has are inserted or deleted whole; empty tables give an empty script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import axes

#: Edit similarity from which on two texts at one path of an array are one, changed.
ALIKE = 0.5
VALUES = ["v_str", "v_num", "v_bool"]


def _prepared(nodes: DataFrame, depth: int) -> DataFrame:
    hashes = axes.merkle(nodes, VALUES, depth).select("doc", "node_key", "hash")
    leaf = ~F.col("kind").isin("object", "array", "element", "document")
    return nodes.select("doc", "node_key", "parent_key", "path", "pre", "level", "kind", "name", *VALUES).join(hashes, ["doc", "node_key"]).withColumn("leaf", leaf)


def _pair(a: DataFrame, b: DataFrame, by: list[str], how: str) -> DataFrame:
    """(doc, old_key, new_key, how): nodes equal in ``by``, the first with the first."""
    ranked = lambda n, key: n.withColumn("_r", F.row_number().over(W.partitionBy("doc", *by).orderBy("pre"))).select("doc", *by, "_r", F.col("node_key").alias(key))
    return ranked(a, "old_key").join(ranked(b, "new_key"), ["doc", *by, "_r"]).select("doc", "old_key", "new_key", F.lit(how).alias("how"))


def _left(nodes: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    return nodes.join(matched.select("doc", F.col(key).alias("node_key")), ["doc", "node_key"], "left_anti")


def similarity(a, b):
    """1 - Levenshtein distance / the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def match(old: DataFrame, new: DataFrame, depth: int, write=lambda df: df) -> DataFrame:
    """(doc, old_key, new_key, how); ``depth``: of the deeper version; ``write``: cuts the plan between passes, e.g. :func:`..sources.shared.written`."""
    a, b = write(_prepared(old, depth)), write(_prepared(new, depth))
    found = write(_pair(a, b, ["path", "hash"], "same"))
    x, y = _left(a, found, "old_key"), _left(b, found, "new_key")
    leaves = _pair(x.where("leaf"), y.where("leaf"), ["path", "kind"], "changed")
    text = lambda n, key, to: n.select("doc", F.col("node_key").alias(key), F.col("v_str").alias(to), F.col("path").alias(f"{to}_path"))
    leaves = leaves.join(text(a, "old_key", "s"), ["doc", "old_key"]).join(text(b, "new_key", "t"), ["doc", "new_key"])
    item = F.col("s_path").endswith("[]")
    leaves = leaves.where(~item | F.coalesce(similarity(F.col("s"), F.col("t")) >= ALIKE, F.lit(False))).select("doc", "old_key", "new_key", "how")
    inner = _pair(x.where("NOT leaf"), y.where("NOT leaf"), ["path", "kind"], "changed")
    found = write(found.union(leaves).union(inner))
    moved = _pair(_left(a, found, "old_key"), _left(b, found, "new_key"), ["hash"], "moved")
    return write(found.union(moved))


def edit_script(old: DataFrame, new: DataFrame, depth: int, write=lambda df: df) -> DataFrame:
    """(doc, op, path, old_value, new_value): insert, delete, update and move, each node once."""
    m = match(old, new, depth, write)
    value = F.coalesce("v_str", F.col("v_bool").cast("string"))
    a = old.select("doc", F.col("node_key").alias("old_key"), F.col("parent_key").alias("old_up"), F.col("path").alias("old_path"), value.alias("old_value"), F.col("kind").alias("old_kind"), F.col("name").alias("old_name"))
    b = new.select("doc", F.col("node_key").alias("new_key"), F.col("parent_key").alias("new_up"), F.col("path").alias("new_path"), value.alias("new_value"), F.col("kind").alias("new_kind"), F.col("name").alias("new_name"))
    pairs = m.join(a, ["doc", "old_key"]).join(b, ["doc", "new_key"])
    ups = m.select("doc", F.col("old_key").alias("old_up"), F.col("new_key").alias("up_match"))
    pairs = pairs.join(ups, ["doc", "old_up"], "left")
    columns = ["doc", "op", "path", "old_value", "new_value"]
    none = F.lit(None).cast("string")
    changed = pairs.where(~F.struct("old_value", "old_kind", "old_name").eqNullSafe(F.struct("new_value", "new_kind", "new_name"))).select("doc", F.lit("update").alias("op"), F.col("new_path").alias("path"), "old_value", "new_value")
    moved = pairs.where(~F.col("up_match").eqNullSafe(F.col("new_up")) & F.col("old_up").isNotNull() & F.col("new_up").isNotNull()).select("doc", F.lit("move").alias("op"), F.col("new_path").alias("path"), F.col("old_path").alias("old_value"), F.col("new_path").alias("new_value"))
    gone = a.join(m.select("doc", "old_key"), ["doc", "old_key"], "left_anti").select("doc", F.lit("delete").alias("op"), F.col("old_path").alias("path"), "old_value", none.alias("new_value"))
    come = b.join(m.select("doc", "new_key"), ["doc", "new_key"], "left_anti").select("doc", F.lit("insert").alias("op"), F.col("new_path").alias("path"), none.alias("old_value"), "new_value")
    return changed.select(columns).union(moved.select(columns)).union(gone.select(columns)).union(come.select(columns))
