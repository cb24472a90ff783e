"""Structural axes over node tables.

A node table has ``doc``, ``node_key``, ``parent_key``, ``kind``, ``name``,
``path``, ``level``, ``pos`` (place among siblings), ``pre`` and ``post`` (orders
of the traversal) and typed values.  With pre and post numbers, ancestors and
descendants are ranges; all joins are by document first, so they never cross
documents.  Joins on ranges go by buckets of the traversal, so a large document
is many keys and its nodes meet few others that aren't in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["doc", "node_key"]


#: Places of the traversal in a bucket of a join on ranges.
WIDTH = 64


def _meet(ranges: DataFrame, points: DataFrame, by: list[str], low: Column, high: Column, at: Column) -> DataFrame:
    """Rows equal in ``by`` whose ``at`` lies in [low, high]: an equi-join on buckets of ``WIDTH`` places, each range in all it touches."""
    bucket = lambda x: F.floor(x / WIDTH)
    r = ranges.where(low <= high).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return r.join(points.withColumn("_b", bucket(at)), [*by, "_b"]).where(at.between(low, high)).drop("_b")


def _ends(nodes: DataFrame) -> DataFrame:
    """Of each document the ends of ``pre``, and the most that it is ahead of ``post``: of all nodes, pre <= post + _ahead."""
    return nodes.groupBy("doc").agg(F.min("pre").alias("_first"), F.max("pre").alias("_last"), F.max(F.col("pre") - F.col("post")).alias("_ahead"))


def _below(pre: str, post: str) -> Column:
    """The end of the range that has the ``pre`` of a node and of all below it, as :func:`_ends` tells of the latter."""
    return F.least(F.greatest(F.col(pre), F.col(post) + F.col("_ahead")), F.col("_last"))


def _context(context: DataFrame) -> DataFrame:
    return context.select("doc", F.col("node_key").alias("from_key"), F.col("pre").alias("c_pre"), F.col("post").alias("c_post"))


def _reached(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes reached from context nodes, with the context's key as ``from_key``."""
    return found.select("doc", "from_key", *[F.col(f"`{x}`") for x in nodes.columns if x != "doc"])


def self_(context: DataFrame) -> DataFrame:
    return context.withColumn("from_key", F.col("node_key"))


def child(context: DataFrame, nodes: DataFrame) -> DataFrame:
    c = context.select("doc", F.col("node_key").alias("from_key"))
    n = nodes.withColumn("from_key", F.col("parent_key"))
    return c.join(n.where("kind <> 'attribute'"), ["doc", "from_key"])


def attribute(context: DataFrame, nodes: DataFrame) -> DataFrame:
    c = context.select("doc", F.col("node_key").alias("from_key"))
    return c.join(nodes.where("kind = 'attribute'").withColumn("from_key", F.col("parent_key")), ["doc", "from_key"])


def parent(context: DataFrame, nodes: DataFrame) -> DataFrame:
    c = context.select("doc", F.col("node_key").alias("from_key"), F.col("parent_key").alias("_p"))
    return c.join(nodes.withColumn("_p", F.col("node_key")), ["doc", "_p"]).drop("_p")


def descendant(context: DataFrame, nodes: DataFrame, or_self: bool = False) -> DataFrame:
    inside = (F.col("pre") > F.col("c_pre")) & (F.col("post") < F.col("c_post"))
    found = _meet(_context(context).join(_ends(nodes), "doc"), nodes, ["doc"], F.col("c_pre"), _below("c_pre", "c_post"), F.col("pre"))
    return _reached(found.where(inside | (F.col("pre") == F.col("c_pre")) if or_self else inside), nodes)


def ancestor(context: DataFrame, nodes: DataFrame, or_self: bool = False) -> DataFrame:
    above = (F.col("pre") < F.col("c_pre")) & (F.col("post") > F.col("c_post"))
    found = _meet(nodes.join(_ends(context), "doc"), _context(context), ["doc"], F.col("pre"), _below("pre", "post"), F.col("c_pre"))
    return _reached(found.where(above | (F.col("pre") == F.col("c_pre")) if or_self else above), nodes)


def following(context: DataFrame, nodes: DataFrame) -> DataFrame:
    found = _meet(_context(context).join(_ends(nodes), "doc"), nodes, ["doc"], F.col("c_pre"), F.col("_last"), F.col("pre"))
    return _reached(found.where((F.col("pre") > F.col("c_pre")) & (F.col("post") > F.col("c_post"))), nodes)


def preceding(context: DataFrame, nodes: DataFrame) -> DataFrame:
    found = _meet(_context(context).join(_ends(nodes), "doc"), nodes, ["doc"], F.col("_first"), F.col("c_pre"), F.col("pre"))
    return _reached(found.where((F.col("pre") < F.col("c_pre")) & (F.col("post") < F.col("c_post"))), nodes)


def _siblings(context: DataFrame, nodes: DataFrame, on: Column) -> DataFrame:
    """Joined by document and parent, so that a large document is many keys; roots have no siblings."""
    c = context.select("doc", "parent_key", F.col("node_key").alias("from_key"), F.col("pos").alias("c_pos")).where("parent_key IS NOT NULL")
    return c.join(nodes.where("kind NOT IN ('attribute', 'namespace')"), ["doc", "parent_key"]).where(on).drop("c_pos")


def following_sibling(context: DataFrame, nodes: DataFrame) -> DataFrame:
    return _siblings(context, nodes, F.col("pos") > F.col("c_pos"))


def preceding_sibling(context: DataFrame, nodes: DataFrame) -> DataFrame:
    return _siblings(context, nodes, F.col("pos") < F.col("c_pos"))


def non_structural(axis: DataFrame, nodes: DataFrame) -> DataFrame:
    """An axis' nodes and, after each, its attributes and namespaces."""
    extra = nodes.where("kind IN ('attribute', 'namespace')").withColumn("_up", F.col("parent_key"))
    hit = axis.select("doc", "from_key", F.col("node_key").alias("_up"))
    return axis.unionByName(hit.join(extra, ["doc", "_up"]).drop("_up"))


def pruned(context: DataFrame, nodes: DataFrame, stop: Column) -> DataFrame:
    """Descendants, without what lies below a node that ``stop`` holds for (a visitor that skips subtrees)."""
    inside = descendant(context, nodes)
    by = ["doc", "from_key"]
    walls = inside.where(stop).select(*by, F.col("pre").alias("w_pre"), F.col("post").alias("w_post")).join(_ends(nodes), "doc")
    hidden = _meet(walls, inside.select(*by, "node_key", "pre", "post"), by, F.col("w_pre"), _below("w_pre", "w_post"), F.col("pre"))
    hidden = hidden.where("pre > w_pre AND post < w_post").select(*by, "node_key").distinct()
    return inside.join(hidden, ["doc", "from_key", "node_key"], "left_anti")


def kind_count(nodes: DataFrame, kind: str) -> DataFrame:
    """Each element's attributes or namespaces, counted."""
    n = nodes.where(F.col("kind") == kind).groupBy("doc", F.col("parent_key").alias("node_key")).agg(F.count("*").alias("n"))
    return nodes.where("kind = 'element'").join(n, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def level_order(nodes: DataFrame, max_level: int | None = None) -> DataFrame:
    """Breadth-first rank within each document, as ``ord``."""
    n = nodes if max_level is None else nodes.where(F.col("level") <= max_level)
    return n.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("level", "pre")))


def post_order(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("post")))


def limited(nodes: DataFrame, max_level: int | None = None, max_children: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """Descendants within limits on depth, children per node and nodes per document."""
    n = nodes
    if max_level is not None:
        n = n.where(F.col("level") <= max_level)
    if max_children is not None:
        n = n.where(F.col("pos") < max_children)
    if max_nodes is not None:
        n = n.withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy("pre"))).where(F.col("_r") <= max_nodes).drop("_r")
    return n


def with_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds))


def with_name(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.where(F.col("name").isin(*names))


def having(context: DataFrame, hits: DataFrame) -> DataFrame:
    """Predicate filter: context nodes from which ``hits`` (with ``from_key``) were reached."""
    return context.join(hits.select("doc", F.col("from_key").alias("node_key")).distinct(), KEY, "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(KEY)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*KEY), KEY, "left_anti").dropDuplicates(KEY)


def path_summary(nodes: DataFrame) -> DataFrame:
    """(path, kind, level, refs, min_num, max_num, distinct): the discovered schema with statistics."""
    return nodes.groupBy("path", "kind", "level").agg(F.count("*").alias("refs"), F.min("v_num").alias("min_num"), F.max("v_num").alias("max_num"), F.approx_count_distinct("v_str").alias("distinct_strings"))


def child_count(nodes: DataFrame) -> DataFrame:
    n = nodes.groupBy("doc", F.col("parent_key").alias("node_key")).agg(F.count("*").alias("children"))
    return nodes.join(n, KEY, "left").withColumn("children", F.coalesce("children", F.lit(0)))


def descendant_count(nodes: DataFrame) -> DataFrame:
    """From the numbers alone: descendants = (post - pre) + level, both orders counted from 0."""
    return nodes.withColumn("descendants", F.col("post") - F.col("pre") + F.col("level"))


def merkle(nodes: DataFrame, value_cols: list[str], depth: int) -> DataFrame:
    """Subtree hash of every node, one aggregation per level from ``depth`` up.

    Shredded tables are larger than Catalyst estimates, so levels meet by sorted merges
    that spill; a broadcast of one level would hold a document table in every task.
    """
    own = nodes.withColumn("own", F.xxhash64("kind", "name", *value_cols)).select(*KEY, "parent_key", "level", "pos", "own")
    done = own.where(F.col("level") == depth).select("doc", "node_key", "parent_key", "pos", F.col("own").alias("hash"))
    out = done
    for level in range(depth - 1, -1, -1):
        kids = done.groupBy("doc", F.col("parent_key").alias("node_key")).agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("pos", "hash")))).alias("below"))
        done = own.where(F.col("level") == level).join(kids.hint("merge"), KEY, "left").select("doc", "node_key", "parent_key", "pos", F.when(F.col("below").isNull(), F.col("own")).otherwise(F.xxhash64("own", "below")).alias("hash"))
        out = out.union(done)
    return out
