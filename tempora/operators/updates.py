"""Updates of node tables: insert, move, copy, replace, rename and remove subtrees, in all documents at once.

An update takes a node table (see :mod:`.axes`) and at most one target node a
document, and gives the new node table.  With pre and post numbers nothing is
traversed: a subtree is a range of either order, so an insertion is a shift of
what comes after it, a removal the opposite, and both are a join with the few
targets (broadcast while they are few) and arithmetic on the rest.  Documents
without a target pass unchanged.

Defined results: a target that isn't in its document changes nothing; a
document with several targets raises; inserting beside a document's root is
ignored; node keys of what stays are kept, new nodes get keys after the
document's greatest; an empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ["v_str", "v_num", "v_bool"]
COLUMNS = ["doc", "node_key", "parent_key", "kind", "name", "path", "level", "pos", "pre", "post", *VALUES]
PLACES = ("first", "last", "left", "right")
FRAGMENT = "f_key long, f_parent long, kind string, name string, f_path string, f_level int, f_pos int, f_pre long, f_post long, v_str string, v_num double, v_bool boolean"

# --- what is inserted -------------------------------------------------------------------------


class Fragment:
    """A small parsed subtree, made on the driver, to be put into many documents."""

    def __init__(self, rows: list[list], name: str | None = None):
        """``rows``: of :mod:`..sources.shred`; ``name``: of the root, for a member of an object."""
        self.rows = [(*r[:3], name if r[1] is None and name is not None else r[3], *r[4:]) for r in rows]
        self.name = self.rows[0][3]

    def beside(self, spots: DataFrame) -> DataFrame:
        """``spots`` with the fragment's rows at each."""
        names = [x.split()[0] for x in FRAGMENT.split(", ")]
        text = json.dumps([{k: v for k, v in zip(names, r, strict=True) if v is not None} for r in self.rows])
        return spots.select("*", F.lit(self.name).alias("f_name"), F.inline(F.from_json(F.lit(text), f"array<struct<{FRAGMENT.replace(' ', ':').replace(',:', ',')}>>")))


def json_fragment(text: str, name: str | None = None) -> Fragment:
    """A JSON value; its path begins anew where it is put."""
    from ..sources.shred import json_nodes

    rows = [[*r[:4], r[4][1:], *r[5:]] for r in json_nodes(text)]
    return Fragment(rows, name)


def xml_fragment(text: str) -> Fragment:
    """One element with all below it."""
    from ..sources.shred import xml_nodes

    rows = xml_nodes(text)
    inner = [r for r in rows if r[0] > 0]
    return Fragment([[r[0] - 1, None if r[1] == 0 else r[1] - 1, r[2], r[3], r[4], r[5] - 1, r[6], r[7] - 1, *r[8:]] for r in inner])


def xml_leaf(kind: str, name: str | None = None, value: str | None = None) -> Fragment:
    """A text, comment, processing instruction, attribute, namespace or empty element."""
    step = {"text": "/text()", "comment": "/comment()", "pi": "/processing-instruction()", "element": f"/{name}"}.get(kind, f"/@{name}")
    return Fragment([[0, None, kind, name, step, 0, 0, 0, 0, value, None, None]])


# --- places -----------------------------------------------------------------------------------


def _size() -> Column:
    """Nodes below one, from its numbers."""
    return F.col("post") - F.col("pre") + F.col("level")


def _one_each(targets: DataFrame) -> DataFrame:
    """Targets (doc, node_key), one a document."""
    t = targets.groupBy("doc").agg(F.min("node_key").alias("t_key"), F.count("*").alias("_n"))
    return t.where(F.assert_true(F.col("_n") == 1, "one target a document at most").isNull()).drop("_n")


def _found(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' numbers: (doc, t_key, t_pre, t_post, t_size, ..)."""
    n = nodes.withColumn("size", _size()).select("doc", *[F.col(c).alias(f"t_{c}" if c != "node_key" else "_key") for c in ("node_key", "parent_key", "pre", "post", "size", "level", "pos", "path", "name", "kind")])
    return n.join(_one_each(targets), "doc").where(F.col("_key") == F.col("t_key")).drop("_key")


def _spots(nodes: DataFrame, targets: DataFrame, where: str) -> DataFrame:
    """(doc, at_pre, at_post, at_pos, up_key, up_level, up_path, up_kind): where a subtree goes, and its parent."""
    if where not in PLACES:
        raise ValueError(f"one of {PLACES}, not {where!r}")
    t = _found(nodes, targets)
    if where in ("left", "right"):
        t = t.where("t_parent_key IS NOT NULL")  # nothing stands beside a root
        up = nodes.select("doc", F.col("node_key").alias("t_parent_key"), F.col("level").alias("up_level"), F.col("path").alias("up_path"), F.col("kind").alias("up_kind"))
        t = t.join(up, ["doc", "t_parent_key"]).withColumn("up_key", F.col("t_parent_key"))
        pre = F.col("t_pre") if where == "left" else F.col("t_pre") + F.col("t_size") + 1
        post = F.col("t_post") - F.col("t_size") if where == "left" else F.col("t_post") + 1
        pos = F.col("t_pos") + int(where == "right")
    else:
        kids = nodes.groupBy("doc", F.col("parent_key").alias("t_key")).agg(F.count("*").alias("kids"), F.count_if(F.col("kind").isin("attribute", "namespace")).alias("attributes"))
        t = t.join(kids, ["doc", "t_key"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kids", "attributes")})
        t = t.withColumns({"up_key": F.col("t_key"), "up_level": F.col("t_level"), "up_path": F.col("t_path"), "up_kind": F.col("t_kind")})
        if where == "first":  # attributes come before all children
            pre, post, pos = F.col("t_pre") + 1 + F.col("attributes"), F.col("t_post") - F.col("t_size") + F.col("attributes"), F.col("attributes")
        else:
            pre, post, pos = F.col("t_pre") + F.col("t_size") + 1, F.col("t_post"), F.col("kids")
    return t.select("doc", pre.alias("at_pre"), post.alias("at_post"), pos.cast("int").alias("at_pos"), "up_key", "up_level", "up_path", "up_kind")


def _opened(nodes: DataFrame, spots: DataFrame) -> DataFrame:
    """The node table with room for ``n`` nodes at each spot (a column of ``spots``)."""
    s = spots.select("doc", "at_pre", "at_post", "at_pos", "up_key", "n")
    out = nodes.join(s, "doc", "left")
    later = lambda c: F.col(c) + F.when(F.col(c) >= F.col(f"at_{c}"), F.col("n")).otherwise(0)
    pos = F.col("pos") + F.when((F.col("parent_key") == F.col("up_key")) & (F.col("pos") >= F.col("at_pos")), 1).otherwise(0)
    new = {"pre": later("pre"), "post": later("post"), "pos": pos.cast("int")}
    return out.select(*[F.when(F.col("at_pre").isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in COLUMNS])


def _closed(nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the node table without the subtrees of ``gone`` (see :func:`_found`), those subtrees with ``t_`` columns)."""
    out = nodes.join(gone, "doc", "left")
    inside = (F.col("pre") >= F.col("t_pre")) & (F.col("pre") <= F.col("t_pre") + F.col("t_size"))
    n = F.col("t_size") + 1
    new = {
        "pre": F.col("pre") - F.when(F.col("pre") > F.col("t_pre"), n).otherwise(0),
        "post": F.col("post") - F.when(F.col("post") > F.col("t_post"), n).otherwise(0),
        "pos": (F.col("pos") - F.when((F.col("parent_key") == F.col("t_parent_key")) & (F.col("pos") > F.col("t_pos")), 1).otherwise(0)).cast("int"),
    }
    kept = out.where(~F.coalesce(inside, F.lit(False)))
    return kept.select(*[F.when(F.col("t_pre").isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in COLUMNS]), out.where(inside)


def _step(kind: Column, name: Column, up_kind: Column) -> Column:
    """The last step of a path, in JSON: a member's name or an array's ``[]``."""
    return F.when(up_kind == "array", "[]").otherwise(F.concat(F.lit("."), name))


def _placed(spots: DataFrame, pieces: DataFrame | Fragment, as_json: bool, first_key: DataFrame | None) -> DataFrame:
    """Subtrees (a fragment, or ``doc`` and :data:`FRAGMENT`'s columns) as rows of the node tables that they go to."""
    p = pieces.beside(spots) if isinstance(pieces, Fragment) else spots.join(_with_root_name(pieces), "doc")
    key, parent = F.col("f_key"), F.col("f_parent")
    if first_key is not None:
        p = p.join(first_key, "doc")
        key, parent = F.col("new_key") + F.col("f_pre"), F.col("new_key") + F.col("f_parent")
    path = F.concat("up_path", _step(F.col("kind"), F.col("f_name"), F.col("up_kind")) if as_json else F.lit(""), "f_path")
    return p.select(
        "doc", key.alias("node_key"), F.coalesce(parent, F.col("up_key")).alias("parent_key"), "kind", F.when(F.col("f_parent").isNull() & (F.col("up_kind") == "array"), None).otherwise(F.col("name")).alias("name") if as_json else F.col("name"),
        path.alias("path"), (F.col("up_level") + 1 + F.col("f_level")).alias("level"), F.when(F.col("f_parent").isNull(), F.col("at_pos")).otherwise(F.col("f_pos")).alias("pos"),
        (F.col("at_pre") + F.col("f_pre")).alias("pre"), (F.col("at_post") + F.col("f_post")).alias("post"), *VALUES,
    )


def _with_root_name(pieces: DataFrame) -> DataFrame:
    """With the root's name on every row, which paths need."""
    return pieces.join(pieces.where("f_parent IS NULL").select("doc", F.col("name").alias("f_name")), "doc")


# --- updates ----------------------------------------------------------------------------------


def insert(nodes: DataFrame, targets: DataFrame, what: DataFrame | Fragment, where: str = "first", as_json: bool = True) -> DataFrame:
    """``what`` (a fragment for all documents, or a table of one each) as the first or last child of each target, or beside it."""
    spots = _spots(nodes, targets, where)
    spots = spots.withColumn("n", F.lit(len(what.rows))) if isinstance(what, Fragment) else spots.join(what.groupBy("doc").agg(F.count("*").alias("n")), "doc")
    last = nodes.groupBy("doc").agg((F.max("node_key") + 1).alias("new_key"))
    return _opened(nodes, spots).unionByName(_placed(spots, what, as_json, last))


def _cut_out(subtree: DataFrame) -> DataFrame:
    """Rows of subtrees with ``t_`` columns as fragments with their own keys."""
    own = F.col("node_key") == F.col("t_key")
    return subtree.select(
        "doc", F.col("node_key").alias("f_key"), F.when(own, None).otherwise(F.col("parent_key")).alias("f_parent"), "kind", "name",
        F.expr("substring(path, length(t_path) + 1)").alias("f_path"), (F.col("level") - F.col("t_level")).alias("f_level"), F.col("pos").alias("f_pos"),
        (F.col("pre") - F.col("t_pre")).alias("f_pre"), (F.col("post") - (F.col("t_post") - F.col("t_size"))).alias("f_post"), *VALUES,
    )


def _xml_root_step(pieces: DataFrame) -> DataFrame:
    """Markup's fragments keep the last step of their root's path."""
    step = F.expr("CASE kind WHEN 'element' THEN '/' || name WHEN 'attribute' THEN '/@' || name WHEN 'namespace' THEN '/@' || name WHEN 'text' THEN '/text()' WHEN 'comment' THEN '/comment()' ELSE '/processing-instruction()' END")
    root = pieces.where("f_parent IS NULL").select("doc", step.alias("_step"))
    return pieces.join(root, "doc").withColumn("f_path", F.concat("_step", "f_path")).drop("_step")


def copy(nodes: DataFrame, targets: DataFrame, to: DataFrame, where: str = "first", as_json: bool = True, source: DataFrame | None = None) -> DataFrame:
    """The targets' subtrees (of ``source``, or of the table itself) once more, as a child of the node ``to`` of each document or beside it."""
    found = _found(nodes if source is None else source, targets)
    _, subtree = _closed(nodes if source is None else source, found)
    pieces = _cut_out(subtree)
    keys = pieces.select("doc", F.col("f_key").alias("f_parent"), F.col("f_pre").alias("_p"))
    pieces = pieces.join(keys, ["doc", "f_parent"], "left").withColumn("f_parent", F.col("_p")).drop("_p")  # parents by place, for new keys
    return insert(nodes, to, pieces if as_json else _xml_root_step(pieces), where, as_json)


def move(nodes: DataFrame, targets: DataFrame, to: DataFrame, where: str = "first", as_json: bool = True) -> DataFrame:
    """The targets' subtrees, with their keys, elsewhere; where ``to`` is in the subtree itself nothing changes."""
    goal = _found(nodes, to).select("doc", F.col("t_pre").alias("g_pre"))
    found = _found(nodes, targets).join(goal, "doc").where("g_pre < t_pre OR g_pre > t_pre + t_size").drop("g_pre").where("t_parent_key IS NOT NULL")
    kept, subtree = _closed(nodes, found)
    pieces = _cut_out(subtree)
    spots = _spots(kept, to.join(found.select("doc"), "doc", "left_semi"), where)
    spots = spots.join(found.select("doc", (F.col("t_size") + 1).alias("n")), "doc")
    return _opened(kept, spots).unionByName(_placed(spots, pieces if as_json else _xml_root_step(pieces), as_json, None))


def remove(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The tables without the targets' subtrees; a root's removal leaves nothing of its document."""
    return _closed(nodes, _found(nodes, targets))[0]


def replace(nodes: DataFrame, targets: DataFrame, what: Fragment, as_json: bool = True) -> DataFrame:
    """``what`` in each target's place; a member of an object keeps its name."""
    if as_json:
        each = what.beside(_found(nodes, targets).select("doc", F.col("t_name").alias("_name")))
        what = each.withColumn("name", F.when(F.col("f_parent").isNull(), F.coalesce("_name", "name")).otherwise(F.col("name"))).drop("_name", "f_name")
    return remove(insert(nodes, targets, what, "right", as_json), targets)


def rename(nodes: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """Another name for each target, and in the paths of all below it."""
    t = _found(nodes, targets).where("t_name IS NOT NULL").select("doc", "t_key", "t_pre", "t_size", F.col("t_path").alias("old"), "t_name")
    new = F.concat(F.expr("substring(old, 1, length(old) - length(t_name))"), F.lit(name))
    out = nodes.join(t, "doc", "left")
    inside = F.coalesce((F.col("pre") >= F.col("t_pre")) & (F.col("pre") <= F.col("t_pre") + F.col("t_size")), F.lit(False))
    own = F.coalesce(F.col("node_key") == F.col("t_key"), F.lit(False))
    changed = {"name": F.when(own, F.lit(name)).otherwise(F.col("name")), "path": F.when(inside, F.concat(new, F.expr("substring(path, length(old) + 1)"))).otherwise(F.col("path"))}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in COLUMNS])


def set_value(nodes: DataFrame, targets: DataFrame, value) -> DataFrame:
    """Another value for each target leaf (text, attribute, string, number, Boolean); numbers keep their JSON text."""
    out = nodes.join(_one_each(targets), "doc", "left")
    own = F.coalesce(F.col("node_key") == F.col("t_key"), F.lit(False))
    number = isinstance(value, int | float) and not isinstance(value, bool)
    text = json.dumps(value) if number else value if isinstance(value, str) else None
    new = {"v_str": F.lit(text).cast("string"), "v_num": F.lit(float(value) if number else None).cast("double"), "v_bool": F.lit(value if isinstance(value, bool) else None).cast("boolean")}
    return out.select(*[F.when(own, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in COLUMNS])


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(op, the node table's columns): what a commit of ``after`` over ``before`` has to write."""
    state = [c for c in COLUMNS if c not in ("doc", "node_key")]
    a = before.select("doc", "node_key", F.struct(*state).alias("old"))
    b = after.select("doc", "node_key", F.struct(*state).alias("new"))
    both = a.join(b, ["doc", "node_key"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return both.select(op.alias("op"), "doc", "node_key", F.coalesce("new", "old").alias("s")).select("op", "doc", "node_key", "s.*")
