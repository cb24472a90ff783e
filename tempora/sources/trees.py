"""Stored documents: JSON, XML and HTML as versioned node tables.

A resource holds the node table of a collection of documents, keyed by document
and node; a commit writes the nodes that changed (see
:func:`..operators.updates.changes`), and any revision can be read as nodes or as
text.  Loading reads texts from a table, from files or from one text.

Defined results: malformed documents have no nodes, so they aren't stored; null
texts likewise; a commit of an unchanged table makes no revision; documents that
the new table lacks are deleted by the commit.
"""

from __future__ import annotations

import datetime as dt
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axes, updates
from . import shred
from .store import Database, Resource

KEYS = ["doc", "node_key"]


def read_texts(spark: SparkSession, uri: str) -> DataFrame:
    """(doc, text) of whole files below a path or URI, the file's name as document."""
    return spark.read.text(uri, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, uri: str) -> DataFrame:
    """(doc, text) of files with a document a line; a line's id is the hash of its file and text."""
    return spark.read.text(uri).select(F.xxhash64(F.input_file_name(), "value").alias("doc"), F.col("value").alias("text"))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """(doc, text) of one text given as such; its id is its checksum."""
    return spark.createDataFrame([(zlib.crc32(text.encode()), text)], "doc long, text string")


class Collection:
    """A versioned collection of documents of one kind."""

    def __init__(self, resource: Resource, kind: str):
        self.resource, self.kind = resource, kind

    @classmethod
    def store(cls, db: Database, name: str, docs: DataFrame, kind: str = "json", id_col: str = "doc", text_col: str = "text", author: str = "", message: str = "", commit_ts: dt.datetime | None = None) -> Collection:
        """The documents as revision 1 of a new resource."""
        return cls(db.create(name, shred.shred(docs, id_col, text_col, kind), KEYS, author, message, commit_ts), kind)

    @classmethod
    def open(cls, db: Database, name: str, kind: str = "json") -> Collection:
        return cls(db.open(name, KEYS), kind)

    def add(self, docs: DataFrame, id_col: str = "doc", text_col: str = "text") -> Collection:
        """Stages further documents."""
        self.resource.insert(shred.shred(docs, id_col, text_col, self.kind))
        return self

    def nodes(self, rev: int | None = None) -> DataFrame:
        return self.resource.snapshot(rev)

    def at_time(self, instant: dt.datetime) -> DataFrame:
        return self.resource.at_time(instant)

    def texts(self, rev: int | None = None, at: DataFrame | None = None) -> DataFrame:
        """(doc, json or xml) of a revision."""
        n = self.nodes(rev) if at is None else at
        return shred.serialize_json(n) if self.kind == "json" else shred.serialize_xml(n)

    def commit(self, nodes: DataFrame | None = None, message: str = "", author: str = "", commit_ts: dt.datetime | None = None) -> int:
        """``nodes``: the whole table as it shall be; None: what is staged."""
        if nodes is not None:
            d = updates.changes(self.nodes(), nodes)
            if d.isEmpty():
                return self.resource.latest()
            for op, stage in (("delete", "delete"), ("insert", "insert"), ("update", "update")):
                self.resource._stage(d.where(F.col("op") == op), stage)
        return self.resource.commit(message, author, commit_ts)

    def diff(self, r1: int, r2: int, start: int | None = None, depth: int | None = None) -> DataFrame:
        """(op, doc, node_key, path, old and new values) between revisions, below the node ``start`` and down to ``depth`` levels of it."""
        a, b = self.nodes(r1), self.nodes(r2)
        return tree_diff(a, b, start, depth)

    def path_summary(self, rev: int | None = None) -> DataFrame:
        return axes.path_summary(self.nodes(rev))


def tree_diff(a: DataFrame, b: DataFrame, start: int | None = None, depth: int | None = None) -> DataFrame:
    """Nodes that two versions of a node table have differently: inserted, deleted, updated (kind, name or value) or moved (another parent)."""
    if start is not None:
        a, b = below(a, start, depth), below(b, start, depth)
    elif depth is not None:
        a, b = a.where(F.col("level") <= depth), b.where(F.col("level") <= depth)
    value = lambda p: F.struct(*[F.col(c).alias(c) for c in ("kind", "name", *updates.VALUES)]).alias(p)
    x = a.select("doc", "node_key", value("old"), F.col("path").alias("old_path"), F.col("parent_key").alias("old_parent"))
    y = b.select("doc", "node_key", value("new"), F.col("path").alias("new_path"), F.col("parent_key").alias("new_parent"))
    both = x.join(y, KEYS, "full")
    op = (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "updated")
        .when(~F.col("old_parent").eqNullSafe(F.col("new_parent")), "moved")
    )
    text = lambda s: F.coalesce(F.col(s)["v_str"], F.col(s)["v_bool"].cast("string"))
    return both.select(op.alias("op"), *KEYS, F.coalesce("new_path", "old_path").alias("path"), text("old").alias("old_value"), text("new").alias("new_value")).where("op IS NOT NULL")


def below(nodes: DataFrame, start: int, depth: int | None) -> DataFrame:
    """The subtree of a node in every document that has it."""
    top = nodes.where(F.col("node_key") == start).select("doc", F.col("pre").alias("s_pre"), (F.col("post") + F.col("level")).alias("s_end"), F.col("level").alias("s_level"))
    n = nodes.join(top, "doc").where("pre >= s_pre AND pre <= s_end")
    n = n if depth is None else n.where(F.col("level") <= F.col("s_level") + depth)
    return n.drop("s_pre", "s_end", "s_level")
