"""JSON, XML and HTML texts to node tables, and back.

Parsing is inherently per document, so it runs in ``mapInArrow``: one document
in memory at a time, Arrow batches out, no shuffle.  Numbering is one traversal:
``pre`` and ``post`` from 0, ``level`` from 0, ``pos`` among siblings.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "doc {id}, node_key long, parent_key long, kind string, name string, path string, level int, pos int, pre long, post long, "
    "v_str string, v_num double, v_bool boolean"
)
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
_NAMES = ["node_key", "parent_key", "kind", "name", "path", "level", "pos", "pre", "post", "v_str", "v_num", "v_bool"]
FLUSH = 20_000

#: HTML elements without end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Numbering:
    """Collects rows in document order; ``post`` is filled in as elements close."""

    def __init__(self):
        self.rows: list[list] = []
        self.stack: list[tuple[int, str, list[int]]] = []
        self.closed = 0

    def open(self, kind: str, name: str | None, step: str, v_str=None, v_num=None, v_bool=None) -> None:
        parent, path, kids = self.stack[-1] if self.stack else (None, "", [0])
        key, pos = len(self.rows), kids[0]
        kids[0] += 1
        path = f"{path}{step}"
        self.rows.append([key, parent, kind, name, path, len(self.stack), pos, key, None, v_str, v_num, v_bool])
        self.stack.append((key, path, [0]))

    def close(self) -> None:
        key, _, _ = self.stack.pop()
        self.rows[key][8] = self.closed
        self.closed += 1

    def leaf(self, *args, **values) -> None:
        self.open(*args, **values)
        self.close()

    def finish(self) -> list[list]:
        while self.stack:
            self.close()
        return self.rows


def json_nodes(text: str | None) -> list[list]:
    """Rows of a JSON document; an object's member is one node with its name and value; malformed text gives none."""
    try:
        doc = json.loads(text) if text is not None else None
    except ValueError:
        return []
    if text is None:
        return []
    n = _Numbering()
    todo: list = [("visit", doc, None, "$")]
    while todo:
        what, value, name, step = todo.pop()
        if what == "close":
            n.close()
        elif isinstance(value, dict):
            n.open("object", name, step)
            todo.append(("close", None, None, None))
            todo += [("visit", v, k, f".{k}") for k, v in reversed(value.items())]
        elif isinstance(value, list):
            n.open("array", name, step)
            todo.append(("close", None, None, None))
            todo += [("visit", v, None, "[]") for v in reversed(value)]
        elif isinstance(value, bool):
            n.leaf("boolean", name, step, v_bool=value)
        elif isinstance(value, int | float):
            n.leaf("number", name, step, v_num=float(value), v_str=json.dumps(value))
        elif value is None:
            n.leaf("null", name, step)
        else:
            n.leaf("string", name, step, v_str=value)
    return n.finish()


class _Markup(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n = _Numbering()
        self.names: list[str] = []
        self.n.open("document", None, "")

    def handle_starttag(self, tag, attrs):
        self.n.open("element", tag, f"/{tag}")
        for k, v in attrs:
            self.n.leaf("attribute", k, f"/@{k}", v_str=v or "")
        if tag in VOID:
            self.n.close()
        else:
            self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.names:
            while self.names:
                self.n.close()
                if self.names.pop() == tag:
                    break

    def handle_data(self, data):
        if data.strip():
            self.n.leaf("text", None, "/text()", v_str=data)

    def handle_comment(self, data):
        self.n.leaf("comment", None, "/comment()", v_str=data)

    def handle_pi(self, data):
        self.n.leaf("pi", data.split(" ")[0], "/processing-instruction()", v_str=data)


def html_nodes(text: str | None) -> list[list]:
    """Rows of an HTML (or loosely, XML) document; unclosed elements close with their parents."""
    if text is None:
        return []
    p = _Markup()
    p.feed(text)
    p.close()
    return p.n.finish()


def xml_nodes(text: str | None) -> list[list]:
    """Rows of a well-formed XML document; malformed text gives none.  Entities beyond the standard five aren't expanded."""
    from xml.parsers import expat

    if text is None:
        return []
    n = _Numbering()
    n.open("document", None, "")
    p = expat.ParserCreate()
    p.buffer_text = True

    def start(tag, attrs):
        n.open("element", tag, f"/{tag}")
        for k, v in attrs.items():
            kind = "namespace" if k == "xmlns" or k.startswith("xmlns:") else "attribute"
            n.leaf(kind, k, f"/@{k}", v_str=v)

    p.StartElementHandler = start
    p.EndElementHandler = lambda tag: n.close()
    p.CharacterDataHandler = lambda d: n.leaf("text", None, "/text()", v_str=d) if d.strip() else None
    p.CommentHandler = lambda d: n.leaf("comment", None, "/comment()", v_str=d)
    p.ProcessingInstructionHandler = lambda t, d: n.leaf("pi", t, "/processing-instruction()", v_str=d)
    p.EntityDeclHandler = lambda *_: (_ for _ in ()).throw(ValueError("entity declarations aren't read"))
    try:
        p.Parse(text.encode(), True)
    except (expat.ExpatError, ValueError):
        return []
    return n.finish()


PARSERS = {"json": json_nodes, "html": html_nodes, "xml": xml_nodes}


def shred(docs: DataFrame, id_col: str, text_col: str, kind: str = "json") -> DataFrame:
    """The node table of all documents."""
    parse = PARSERS[kind]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            docs_, cols = [], [[] for _ in _NAMES]
            for doc, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for row in parse(text):
                    docs_.append(doc.as_py())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if len(docs_) >= FLUSH:
                    yield _batch(docs_, cols, b)
                    docs_, cols = [], [[] for _ in _NAMES]
            if docs_:
                yield _batch(docs_, cols, b)

    def _batch(docs_, cols, b):
        return pa.RecordBatch.from_arrays([pa.array(docs_, b.schema.field(0).type), *[pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]], names=["doc", *_NAMES])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, NODE_SCHEMA.format(id=id_type))


def _by_document(nodes: DataFrame, build, column: str) -> DataFrame:
    """(doc, ``column``): ``build`` of each document's rows in document order, one document in memory at a time."""
    kind = nodes.schema["doc"].dataType.simpleString()
    names = ["node_key", "parent_key", "kind", "name", "v_str", "v_bool"]

    def run(batches):
        current, rows, ids, texts = None, [], [], []
        for b in batches:
            docs = b.column(0).to_pylist()
            for doc, *row in zip(docs, *[b.column(i + 1).to_pylist() for i in range(len(names))], strict=True):
                if rows and doc != current:
                    ids.append(current)
                    texts.append(build(rows))
                    rows = []
                current = doc
                rows.append(row)
            if len(ids) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.string())], names=["doc", column])
                ids, texts = [], []
        if rows:
            ids.append(current)
            texts.append(build(rows))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(texts, pa.string())], names=["doc", column])

    return nodes.repartition("doc").sortWithinPartitions("doc", "pre").select("doc", *names).mapInArrow(run, f"doc {kind}, {column} string")


def _json_text(rows: list[list]) -> str:
    made: dict = {}
    top = None
    for key, parent, kind, name, v_str, v_bool in rows:
        v = {"object": dict, "array": list, "number": lambda x=v_str: json.loads(x), "boolean": lambda x=v_bool: x, "string": lambda x=v_str: x, "null": lambda: None}[kind]()
        made[key] = v
        if parent is None:
            top = v
        elif isinstance(up := made[parent], dict):
            up[name] = v
        else:
            up.append(v)
    return json.dumps(top, ensure_ascii=False, separators=(",", ":"))


def serialize_json(nodes: DataFrame) -> DataFrame:
    """(doc, json): node tables of JSON documents back to text."""
    return _by_document(nodes, _json_text, "json")


def _xml_text(rows: list[list]) -> str:
    from xml.sax.saxutils import escape, quoteattr

    out, open_, pending = [], [], False  # open_: (key, name) of elements that aren't closed; pending: the last start tag takes attributes yet
    for key, parent, kind, name, v_str, _ in [*rows, (None, None, "end", None, None, None)]:
        if kind == "document":
            continue
        while open_ and open_[-1][0] != parent:
            out.append("/>" if pending else f"</{open_[-1][1]}>")
            pending = False
            open_.pop()
        if kind in ("attribute", "namespace"):
            out.append(f" {name}={quoteattr(v_str or '')}")
            continue
        if pending:
            out.append(">")
            pending = False
        if kind == "element":
            out.append(f"<{name}")
            open_.append((key, name))
            pending = True
        elif kind == "text":
            out.append(escape(v_str or ""))
        elif kind == "comment":
            out.append(f"<!--{v_str or ''}-->")
        elif kind == "pi":
            out.append(f"<?{name} {v_str}?>" if v_str else f"<?{name}?>")
    return "".join(out)


def serialize_xml(nodes: DataFrame) -> DataFrame:
    """(doc, xml): node tables of XML documents back to text, without white space between elements."""
    return _by_document(nodes, _xml_text, "xml")


def serialize_limited(nodes: DataFrame, max_level: int | None = None, max_children: int | None = None, kind: str = "json") -> DataFrame:
    """Documents cut at a depth and at a number of children per node, as text."""
    from ..operators import axes

    n = axes.limited(nodes, max_level, max_children)
    if max_children is not None:  # what hangs below a node that went, goes too: it starts before the end of the last one gone
        end = F.max(F.when(F.col("pos") >= max_children, F.col("post") + F.col("level"))).over(W.partitionBy("doc").orderBy("pre").rowsBetween(W.unboundedPreceding, -1))
        n = nodes.withColumn("_end", end).where((F.col("pos") < max_children) & (F.col("_end").isNull() | (F.col("pre") > F.col("_end")))).drop("_end")
        n = n if max_level is None else n.where(F.col("level") <= max_level)
    return serialize_json(n) if kind == "json" else serialize_xml(n)


def serialize_records(nodes: DataFrame) -> DataFrame:
    """(doc, json, record): each child of a document's root (an array's items, an object's members) as a text of its own."""
    # the record of a node is the last top node at or before it
    w = W.partitionBy("doc").orderBy("pre")
    n = nodes.where("level >= 1").withColumn("record", F.last(F.when(F.col("level") == 1, F.col("pos")), ignorenulls=True).over(w))
    n = n.withColumn("parent_key", F.when(F.col("level") > 1, F.col("parent_key"))).withColumn("doc", F.struct("doc", "record"))
    return serialize_json(n).select("doc.doc", "doc.record", "json")
