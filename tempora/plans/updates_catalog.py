"""Queries of tree updates, serialisation, indexes and stored trees, with the SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import axes, matching
from ..operators import updates as U
from ..sources import indexes, shared, shred, store, trees

c = F.col

# --- documents made of the nations ---------------------------------------------------------------

HEAD, TAIL = "'{\"k\":' || n_nationkey || ", "'}'"


def _json_docs(t) -> DataFrame:
    text = F.concat(F.lit('{"k":'), c("n_nationkey"), F.lit(',"a":[1,"b",null],"o":{"z":true}}'))
    return shared.written(shred.shred(t.nation.select("n_nationkey", text.alias("text")), "n_nationkey", "text", "json"), "nodes")


def _xml_docs(t) -> DataFrame:
    text = F.concat(F.lit('<r><a x="'), c("n_nationkey"), F.lit('">'), c("n_name"), F.lit("</a><b/></r>"))
    return shared.written(shred.shred(t.nation.select("n_nationkey", text.alias("text")), "n_nationkey", "text", "xml"), "nodes")


def _at(nodes: DataFrame, path: str, pos: int | None = None) -> DataFrame:
    n = nodes.where(c("path") == path)
    return (n if pos is None else n.where(c("pos") == pos)).select("doc", "node_key")


def _texts(tables: dict[str, DataFrame], kind: str) -> DataFrame:
    """(op, nation, text) of several updated tables, serialised at once."""
    parts = [n.withColumn("doc", F.struct(F.lit(op).alias("op"), c("doc").alias("nation"))) for op, n in tables.items()]
    out = (shred.serialize_json if kind == "json" else shred.serialize_xml)(reduce(DataFrame.unionByName, parts))
    return out.select("doc.op", c("doc.nation").alias("nation"), c(kind).alias("text"))


def _sql(rows: dict[str, str], kind: str) -> str:
    """The same texts written out; ``@`` is the nation's key, ``#`` its name."""
    text = lambda x: "'" + x.replace("'", "''").replace("@", "' || n_nationkey || '").replace("#", "' || n_name || '") + "'"
    return " UNION ALL ".join(f"SELECT '{op}' AS op, n_nationkey AS nation, {text(x)} AS text FROM nation" for op, x in rows.items())


K, A, O = '"k":@', '"a":[1,"b",null]', '"o":{"z":true}'
WHERE_IN_ARRAY = {"first": '[{v},1,"b",null]', "last": '[1,"b",null,{v}]', "left": '[1,{v},"b",null]', "right": '[1,"b",{v},null]'}
VALUES = {"string": '"s"', "boolean": "true", "number": "7", "null": "null"}
SUBTREES = {"object": "{}", "array": "[]", "subtree": '{"x":[1,{"y":null}]}'}


def _in_array(values: dict[str, str]) -> dict[str, str]:
    return {f"{kind} {where}": "{" + f'{K},"a":' + form.replace("{v}", v) + f",{O}" + "}" for kind, v in values.items() for where, form in WHERE_IN_ARRAY.items()}


def _insert_in_array(t, values: dict[str, str]) -> DataFrame:
    n = _json_docs(t)
    place = {"first": _at(n, "$.a"), "last": _at(n, "$.a"), "left": _at(n, "$.a[]", 1), "right": _at(n, "$.a[]", 1)}
    return _texts({f"{kind} {where}": U.insert(n, at, U.json_fragment(v), where) for kind, v in values.items() for where, at in place.items()}, "json")


RECORDS = {"record": '{"y":1}', "primitive": "7"}
WHERE_IN_OBJECT = {"first": ["n", K, A, O], "last": [K, A, O, "n"], "left": [K, "n", A, O], "right": [K, A, "n", O]}
MOVED = {
    "move first": "{" + f"{O},{K},{A}" + "}", "move last": "{" + f"{K},{O},{A}" + "}", "move left": '{"k":@,"a":["b",1,null],"o":{"z":true}}', "move right": '{"k":@,"a":[null,1,"b"],"o":{"z":true}}',
    "move inwards": '{"k":@,"o":{"a":[1,"b",null],"z":true}}', "move into itself": "{" + f"{K},{A},{O}" + "}",
    "copy first": '{"k":@,"a":[{"z":true},1,"b",null],"o":{"z":true}}', "copy left": '{"k":@,"a":[1,[1,"b",null],"b",null],"o":{"z":true}}', "copy right": '{"k":@,"a":[1,"b",@,null],"o":{"z":true}}',
}
EDITED = {
    "replace by object": '{"k":{"w":[1]},"a":[1,"b",null],"o":{"z":true}}', "replace by primitive": '{"k":@,"a":[1,"b",null],"o":"x"}', "rename": '{"q":@,"a":[1,"b",null],"o":{"z":true}}', "set string": '{"k":@,"a":[1,"new",null],"o":{"z":true}}',
    "set number": '{"k":2.5,"a":[1,"b",null],"o":{"z":true}}', "set boolean": '{"k":@,"a":[1,"b",null],"o":{"z":false}}', "remove array": '{"k":@,"o":{"z":true}}', "remove item": '{"k":@,"a":[1,null],"o":{"z":true}}',
}

XML_LEAVES = {"element": ("e", None, "<e/>"), "text": (None, "t<", "t&lt;"), "comment": (None, "c", "<!--c-->"), "pi": ("p", "d", "<?p d?>")}
XML_PLACES = {"first": '<r><a x="@">{v}#</a><b/></r>', "left": '<r>{v}<a x="@">#</a><b/></r>', "right": '<r><a x="@">#</a>{v}<b/></r>'}
XML_SUBTREE = '<s i="1"><u>v</u></s>'
XML_EDITED = {
    "attribute": '<r><a x="@">#</a><b y="1"/></r>', "namespace": '<r><a x="@">#</a><b xmlns:n="urn:n"/></r>', "subtree first": f'<r>{XML_SUBTREE}<a x="@">#</a><b/></r>', "subtree left": f'<r><a x="@">#</a>{XML_SUBTREE}<b/></r>',
    "subtree right": f'<r><a x="@">#</a><b/>{XML_SUBTREE}</r>', "copy first": '<r><a x="@">#</a><b><a x="@">#</a></b></r>', "copy left": '<r><b/><a x="@">#</a><b/></r>', "copy right": '<r><a x="@">#</a><b/><a x="@">#</a></r>',
    "move first": '<r><b><a x="@">#</a></b></r>', "move left": '<r><b/><a x="@">#</a></r>', "move right": '<r><b/><a x="@">#</a></r>', "replace": f'<r><a x="@">#</a>{XML_SUBTREE}</r>', "remove": "<r><b/></r>",
    "rename": '<r><q x="@">#</q><b/></r>', "rename attribute": '<r><a q="@">#</a><b/></r>', "set text": '<r><a x="@">new</a><b/></r>', "set attribute": '<r><a x="9">#</a><b/></r>',
}


def register(query) -> None:
    """Adds every query of this module by ``query(sql)``, the catalogue's decorator."""

    @query(_sql(_in_array(VALUES), "json"))
    def json_insert_values(t):
        return _insert_in_array(t, VALUES)

    @query(_sql(_in_array(SUBTREES), "json"))
    def json_insert_subtrees(t):
        return _insert_in_array(t, SUBTREES)

    @query(_sql({f"{k} {w}": "{" + ",".join(x if x != "n" else f'"n":{v}' for x in order) + "}" for k, v in RECORDS.items() for w, order in WHERE_IN_OBJECT.items()}, "json"))
    def json_insert_records(t):
        n = _json_docs(t)
        place = {"first": _at(n, "$"), "last": _at(n, "$"), "left": _at(n, "$.a"), "right": _at(n, "$.a")}
        return _texts({f"{k} {w}": U.insert(n, at, U.json_fragment(v, "n"), w) for k, v in RECORDS.items() for w, at in place.items()}, "json")

    @query(_sql(MOVED, "json"))
    def json_move_copy(t):
        n = _json_docs(t)
        root, k, a, o, b = _at(n, "$"), _at(n, "$.k"), _at(n, "$.a"), _at(n, "$.o"), _at(n, "$.a[]", 1)
        return _texts(
            {
                "move first": U.move(n, o, root, "first"), "move last": U.move(n, a, root, "last"), "move left": U.move(n, b, _at(n, "$.a[]", 0), "left"), "move right": _first_last(shared.written(U.move(n, b, _at(n, "$.a[]", 2), "right"), "nodes")),
                "move inwards": U.move(n, a, o, "first"), "move into itself": U.move(n, o, _at(n, "$.o.z"), "left"),
                "copy first": U.copy(n, o, a, "first"), "copy left": U.copy(n, a, b, "left"), "copy right": U.copy(n, k, b, "right"),
            },
            "json",
        )

    def _first_last(n):
        """Moves the last item of the array first, after the move before."""
        return U.move(n, _at(n, "$.a[]", 1), _at(n, "$.a"), "first")

    @query(_sql(EDITED, "json"))
    def json_edit(t):
        n = _json_docs(t)
        k, o, b = _at(n, "$.k"), _at(n, "$.o"), _at(n, "$.a[]", 1)
        return _texts(
            {
                "replace by object": U.replace(n, k, U.json_fragment('{"w":[1]}')), "replace by primitive": U.replace(n, o, U.json_fragment('"x"')), "rename": U.rename(n, k, "q"), "set string": U.set_value(n, b, "new"),
                "set number": U.set_value(n, k, 2.5), "set boolean": U.set_value(n, _at(n, "$.o.z"), False), "remove array": U.remove(n, _at(n, "$.a")), "remove item": U.remove(n, b),
            },
            "json",
        )

    @query(_sql({f"{kind} {w}": form.replace("{v}", text) for kind, (_, _, text) in XML_LEAVES.items() for w, form in XML_PLACES.items()}, "xml"))
    def xml_insert_leaves(t):
        n = _xml_docs(t)
        a = _at(n, "/r/a")
        return _texts({f"{kind} {w}": U.insert(n, a, U.xml_leaf(kind, name, value), w, False) for kind, (name, value, _) in XML_LEAVES.items() for w in XML_PLACES}, "xml")

    @query(_sql(XML_EDITED, "xml"))
    def xml_edit(t):
        n = _xml_docs(t)
        r, a, b, x = _at(n, "/r"), _at(n, "/r/a"), _at(n, "/r/b"), _at(n, "/r/a/@x")
        sub = U.xml_fragment(XML_SUBTREE)
        return _texts(
            {
                "attribute": U.insert(n, b, U.xml_leaf("attribute", "y", "1"), "first", False), "namespace": U.insert(n, b, U.xml_leaf("namespace", "xmlns:n", "urn:n"), "first", False),
                "subtree first": U.insert(n, r, sub, "first", False), "subtree left": U.insert(n, b, sub, "left", False), "subtree right": U.insert(n, b, sub, "right", False),
                "copy first": U.copy(n, a, b, "first", False), "copy left": U.copy(n, b, a, "left", False), "copy right": U.copy(n, a, b, "right", False),
                "move first": U.move(n, a, b, "first", False), "move left": U.move(n, b, a, "left", False), "move right": U.move(n, a, b, "right", False), "replace": U.replace(n, b, sub, False), "remove": U.remove(n, a),
                "rename": U.rename(n, a, "q"), "rename attribute": U.rename(n, x, "q"), "set text": U.set_value(n, _at(n, "/r/a/text()"), "new"), "set attribute": U.set_value(n, x, "9"),
            },
            "xml",
        )

    @query("SELECT n_nationkey AS nation, '{\"k\":' || n_nationkey || ',\"a\":[1],\"o\":{}}' AS cut, '<r><a x=\"' || n_nationkey || '\"/><b/></r>' AS cut_xml FROM nation")
    def serialize_limited(t):
        j, x = _json_docs(t), _xml_docs(t)
        first_of_arrays = j.where("NOT (path = '$.a[]' AND pos > 0) AND path <> '$.o.z'")
        cut = shred.serialize_limited(first_of_arrays, max_level=2).select(c("doc").alias("nation"), c("json").alias("cut"))
        return cut.join(shred.serialize_limited(x.where("kind <> 'text'"), max_level=3, kind="xml").select(c("doc").alias("nation"), c("xml").alias("cut_xml")), "nation")

    @query("SELECT n_nationkey AS nation, i AS record, CASE i WHEN 0 THEN n_nationkey || '' WHEN 1 THEN '[1,\"b\",null]' ELSE '{\"z\":true}' END AS json FROM nation, (VALUES (0), (1), (2)) v(i)")
    def serialize_records(t):
        return shred.serialize_records(_json_docs(t)).select(c("doc").alias("nation"), "record", "json")

    @query("SELECT n_nationkey AS nation, '<r><a x=\"' || n_nationkey || '\">' || n_name || '</a><b/></r>' AS xml FROM nation")
    def xml_round_trip(t):
        return shred.serialize_xml(_xml_docs(t)).select(c("doc").alias("nation"), "xml")

    @query("SELECT n_nationkey AS nation, CASE path WHEN '$.k' THEN 'update' ELSE 'delete' END AS op, path FROM nation, (VALUES ('$.k'), ('$.o'), ('$.o.z')) v(path)")
    def tree_changes(t):
        """What a commit of two updates writes: the changed leaf and the removed subtree, nothing else."""
        n = _json_docs(t)
        after = U.remove(U.set_value(n, _at(n, "$.k"), -1), _at(n, "$.o"))
        same = [x for x in U.COLUMNS if x not in ("pre", "post")]
        d = U.changes(n.select(*same, F.lit(0).alias("pre"), F.lit(0).alias("post")), after.select(*same, F.lit(0).alias("pre"), F.lit(0).alias("post")))
        return d.select(c("doc").alias("nation"), "op", "path")

    # --- indexes ---------------------------------------------------------------------------------

    def made(t, kind: str):
        """(indexes of the nations' documents, the documents): all names, two paths, values of two types."""
        n = _json_docs(t) if kind == "json" else _xml_docs(t)
        i = indexes.Indexes(t.spark, shared.new_path(t.spark, "indexes"))
        i.create_name(n)
        i.create_path(n, ["$.k", "$.o.z"] if kind == "json" else ["/r/a", "/r/b"])
        i.create_cas(n, "string")
        i.create_cas(n, "number" if kind == "json" else "string", ["$.k"] if kind == "json" else ["/r/a/@x"])
        return i, n

    @query("""SELECT what, n_nationkey AS nation, path FROM nation, (VALUES ('name', '$.o'), ('name', '$.o.z'), ('path', '$.k'), ('path', '$.o.z'), ('cas', '$.a[]')) v(what, path)
    UNION ALL SELECT 'greater', n_nationkey, '$.k' FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 'lower', n_nationkey, '$.k' FROM nation WHERE n_nationkey <= 3
    UNION ALL SELECT 'range', n_nationkey, '$.k' FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 9""")
    def json_indexes(t):
        i, _ = made(t, "json")
        number = i.find_cas("$.k", "number")
        scans = {
            "name": i.scan_name(i.find_name("o"), "o", "z"), "path": i.scan_path(i.find_path("$.k"), "$.k", "$.o.z"), "cas": i.scan_cas(i.find_cas("$.a[]"), "b", "EQUAL", ["$.a[]"]), "greater": i.scan_cas(number, 20, "GREATER"),
            "lower": i.scan_cas(number, 3, "LOWER_OR_EQUAL"), "range": i.scan_cas_range(number, 5, 9, True, False),
        }
        return reduce(DataFrame.union, [s.select(F.lit(k).alias("what"), c("doc").alias("nation"), "path") for k, s in scans.items()])

    @query("""SELECT what, n_nationkey AS nation, path FROM nation, (VALUES ('name', '/r/a'), ('path', '/r/b')) v(what, path) UNION ALL SELECT 'cas', n_nationkey, '/r/a/text()' FROM nation WHERE n_name = (SELECT min(n_name) FROM nation)
    UNION ALL SELECT 'range', n_nationkey, '/r/a/@x' FROM nation WHERE CAST(n_nationkey AS VARCHAR) >= '2' AND CAST(n_nationkey AS VARCHAR) <= '5'""")
    def xml_indexes(t):
        i, _ = made(t, "xml")
        least = t.nation.agg(F.min("n_name")).first()[0]
        scans = {
            "name": i.scan_name(i.find_name("a"), "a"), "path": i.scan_path(i.find_path("/r/b"), "/r/b"), "cas": i.scan_cas(i.find_cas("/r/a/text()"), least), "range": i.scan_cas_range(1, "2", "5", paths=["/r/a/@x"]),
        }
        return reduce(DataFrame.union, [s.select(F.lit(k).alias("what"), c("doc").alias("nation"), "path") for k, s in scans.items()])

    @query("""SELECT * FROM (VALUES ('name of any', 0), ('path indexed', 0), ('path not indexed', -1), ('string values', 0), ('number values', 1), ('Boolean values', -1), ('projection', 0), ('projection of more', -1), ('valid time', 0),
    ('dropped valid time', -1), ('dropped projection', -1), ('kinds', 5)) v(what, number)""")
    def index_lookup(t):
        """What the find functions answer, before and after indexes are dropped."""
        i, _ = made(t, "json")
        i.create_projection(t.nation, ["n_nationkey", "n_name"])
        i.create_valid_time(t.orders.select("o_orderkey", "o_orderdate", c("o_orderdate").alias("until")), "o_orderdate", "until")
        kinds = len({d["kind"] for d in i.definitions()})
        out = [
            ("name of any", i.find_name("q")), ("path indexed", i.find_path("$.o.z")), ("path not indexed", i.find_path("$.a")), ("string values", i.find_cas("$.a[]")), ("number values", i.find_cas("$.k", "number")),
            ("Boolean values", i.find_cas("$.o.z", "boolean")), ("projection", i.find_projection(["n_name"])), ("projection of more", i.find_projection(["n_name", "n_regionkey"])), ("valid time", i.find_valid_time("o_orderdate", "until")), ("kinds", kinds),
        ]
        i.drop("projection", 0)
        i.drop("valid-time", 0)
        out += [("dropped valid time", i.find_valid_time("o_orderdate", "until")), ("dropped projection", i.find_projection(["n_name"]))]
        return t.spark.createDataFrame(out, "what string, number int")

    @query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderkey % 5 = 0 OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1996-06-01')")
    def valid_time_index(t):
        i = indexes.Indexes(t.spark, shared.new_path(t.spark, "indexes"))
        until = F.when(c("o_orderkey") % 5 != 0, c("o_orderdate") + F.expr("INTERVAL 90 DAY"))
        number = i.create_valid_time(t.orders.select("o_orderkey", c("o_orderdate").alias("since"), until.alias("until")), "since", "until")
        return i.scan_valid_time(number, F.expr("timestamp_ntz '1996-06-01'")).select("o_orderkey")

    @query("SELECT n_nationkey, n_name FROM nation")
    def projection_index(t):
        i = indexes.Indexes(t.spark, shared.new_path(t.spark, "indexes"))
        i.create_projection(t.nation, ["n_nationkey", "n_name"])
        return i.scan_projection(i.find_projection(["n_name"])).select("n_nationkey", "n_name")

    # --- stored documents and their differences --------------------------------------------------

    def stored(t, kind: str):
        """(collection of two revisions): the nations' documents, then edited."""
        text = F.concat(F.lit('{"k":'), c("n_nationkey"), F.lit(',"a":[1,"b",null],"o":{"z":true}}')) if kind == "json" else F.concat(F.lit('<r><a x="'), c("n_nationkey"), F.lit('">'), c("n_name"), F.lit("</a><b/></r>"))
        db = store.Database(t.spark, shared.new_path(t.spark, "store"))
        col = trees.Collection.store(db, "nations", t.nation.select(c("n_nationkey").alias("doc"), text.alias("text")), kind, author="ann")
        n = col.nodes()
        if kind == "json":
            n = U.remove(shared.written(U.set_value(n, _at(n, "$.k"), -1), "nodes"), _at(n, "$.o"))
        else:
            n = U.insert(n, _at(n, "/r/b"), U.xml_leaf("text", value="new"), "first", False)
        col.commit(n, "edited", "bob")
        return col

    both = "SELECT n_nationkey AS doc, 1 AS rev, {} AS text FROM nation UNION ALL SELECT n_nationkey, 2, {} FROM nation"

    @query(both.format("'{\"k\":' || n_nationkey || ',\"a\":[1,\"b\",null],\"o\":{\"z\":true}}'", "'{\"k\":-1,\"a\":[1,\"b\",null]}'"))
    def json_store(t):
        col = stored(t, "json")
        return reduce(DataFrame.union, [col.texts(r).select("doc", F.lit(r).alias("rev"), c("json").alias("text")) for r in (1, 2)])

    @query(both.format("'<r><a x=\"' || n_nationkey || '\">' || n_name || '</a><b/></r>'", "'<r><a x=\"' || n_nationkey || '\">' || n_name || '</a><b>new</b></r>'"))
    def xml_store(t):
        col = stored(t, "xml")
        return reduce(DataFrame.union, [col.texts(r).select("doc", F.lit(r).alias("rev"), c("xml").alias("text")) for r in (1, 2)])

    @query("""SELECT n_nationkey AS doc, op, path, CASE path WHEN '$.k' THEN n_nationkey || '' WHEN '$.o.z' THEN 'true' END AS old_value, CASE path WHEN '$.k' THEN '-1' END AS new_value
    FROM nation, (VALUES ('updated', '$.k'), ('deleted', '$.o'), ('deleted', '$.o.z')) v(op, path)""")
    def json_tree_diff(t):
        return stored(t, "json").diff(1, 2).select("doc", "op", "path", "old_value", "new_value")

    @query("SELECT n_nationkey AS doc, 'deleted' AS op, '$.o' AS path FROM nation")
    def tree_diff_below(t):
        """Below the object's node alone, and no level further."""
        return stored(t, "json").diff(1, 2, start=6, depth=0).select("doc", "op", "path")

    @query("SELECT n_nationkey AS doc, 'inserted' AS op, '/r/b/text()' AS path, NULL AS old_value, 'new' AS new_value FROM nation")
    def xml_tree_diff(t):
        return stored(t, "xml").diff(1, 2).select("doc", "op", "path", "old_value", "new_value")

    @query("""SELECT n_nationkey AS doc, op, path, CASE path WHEN '$.k' THEN n_nationkey || '' WHEN '$.t[]' THEN 'some words' WHEN '$.q.o' THEN '$.o' END AS old_value,
    CASE path WHEN '$.k' THEN 'x' || n_nationkey WHEN '$.t[]' THEN 'some wards' WHEN '$.w' THEN '1' WHEN '$.q.o' THEN '$.q.o' END AS new_value
    FROM nation, (VALUES ('delete', '$.k'), ('insert', '$.k'), ('update', '$.t[]'), ('insert', '$.w'), ('insert', '$.q'), ('move', '$.q.o')) v(op, path)""".replace("WHEN '$.k' THEN n_nationkey || '' WHEN", "WHEN '$.k' THEN CASE op WHEN 'delete' THEN n_nationkey || '' END WHEN").replace("WHEN '$.k' THEN 'x' || n_nationkey", "WHEN '$.k' THEN CASE op WHEN 'insert' THEN 'x' || n_nationkey END"))
    def tree_edit_script(t):
        """Versions without common keys: a member of another kind, a changed item, a new member and an object that moved into a new one."""
        old = F.concat(F.lit('{"k":'), c("n_nationkey"), F.lit(',"t":["same","some words"],"o":{"z":[true,2]}}'))
        new = F.concat(F.lit('{"k":"x'), c("n_nationkey"), F.lit('","t":["same","some wards"],"w":1,"q":{"o":{"z":[true,2]}}}'))
        a, b = (shared.written(shred.shred(t.nation.select("n_nationkey", x.alias("text")), "n_nationkey", "text", "json"), "nodes") for x in (old, new))
        return matching.edit_script(a, b, 4, lambda df: shared.written(df, "match"))

    # --- the store's life, markup's counts and further axes --------------------------------------

    @query("""SELECT * FROM (VALUES ('no database', 0), ('database', 1), ('resource', 1), ('revisions', 4), ('latest', 4), ('rolled back', 1), ('before hooks', 2), ('after hooks', 2), ('rows at 1', 25), ('rows at 2', 20), ('rows at 3', 21), ('reverted', 25),
    ('renamed', 1), ('author', 1), ('history of a key', 3), ('truncated', 2), ('dropped resource', 1), ('dropped database', 1)) v(what, n)""")
    def store_lifecycle(t):
        """Create, stage, roll back, commit with hooks, revert, truncate, drop: what each leaves, counted."""
        spark = t.spark
        db = store.Database(spark, shared.new_path(spark, "store"))
        out = [("no database", int(db.exists()))]
        r = db.create("nations", t.nation.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], "ann", "first")
        out += [("database", int(db.exists())), ("resource", int(db.exists("nations")))]
        seen = {"before": 0, "after": 0}
        r.pre_commit.append(lambda _: seen.__setitem__("before", seen["before"] + 1))
        r.post_commit.append(lambda _, rev: seen.__setitem__("after", seen["after"] + 1))
        r.delete(c("n_regionkey") == 1)
        r.rollback()
        out += [("rolled back", r.commit())]
        r.delete(c("n_regionkey") == 0)
        r.commit("less", "bob")
        r.insert(t.nation.where("n_nationkey = 0").select("n_nationkey", "n_name", "n_regionkey")).set(c("n_nationkey") == 24, n_name="RENAMED")
        r.commit("more", "cid")
        r.revert_to(1, "back", "ann")
        key = t.nation.where("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
        out += [
            ("revisions", r.revisions().count()), ("latest", r.latest()), ("before hooks", seen["before"]), ("after hooks", seen["after"]), ("rows at 1", r.snapshot(1).count()), ("rows at 2", r.snapshot(2).count()), ("rows at 3", r.snapshot(3).count()),
            ("reverted", r.snapshot().count()), ("renamed", r.snapshot(3).where("n_name = 'RENAMED'").count()), ("author", int(r.most_recent()[2] == "ann")), ("history of a key", r.changes().where(c("n_nationkey") == key).count()),
        ]
        r.truncate_to(2)
        out += [("truncated", r.latest()), ("dropped resource", int(db.drop("nations") and not db.exists("nations"))), ("dropped database", int(db.drop() and not db.exists()))]
        return spark.createDataFrame(out, "what string, n int")

    @query("SELECT n_nationkey AS doc, name, CASE name WHEN 'a' THEN 1 ELSE 0 END AS attributes, 0 AS namespaces FROM nation, (VALUES ('r'), ('a'), ('b')) v(name)")
    def xml_counts(t):
        n = _xml_docs(t)
        a = axes.kind_count(n, "attribute").select("doc", "node_key", "name", c("n").alias("attributes"))
        return a.join(axes.kind_count(n, "namespace").select("doc", "node_key", c("n").alias("namespaces")), ["doc", "node_key"]).select("doc", "name", "attributes", "namespaces")

    @query("""SELECT axis, n_nationkey AS doc, of, name FROM nation, (VALUES ('self', 'a', 'a'), ('attribute', 'a', 'x'), ('wrapped', 'r', 'a'), ('wrapped', 'r', 'x'), ('wrapped', 'r', 'b'), ('pruned', 'r', 'a'), ('pruned', 'r', 'b'),
    ('following', 'a', 'b'), ('preceding', 'b', 'a')) v(axis, of, name)""")
    def xml_axes(t):
        n = _xml_docs(t)
        one = lambda x: n.where(c("name") == x)
        found = {
            "self": axes.self_(one("a")), "attribute": axes.attribute(one("a"), n), "wrapped": axes.non_structural(axes.child(one("r"), n), n), "pruned": axes.pruned(one("r"), n.where("kind <> 'attribute'"), c("name") == "a"),
            "following": axes.following_sibling(one("a"), n), "preceding": axes.preceding_sibling(one("b"), n),
        }
        names = n.select("doc", c("node_key").alias("from_key"), c("name").alias("of"))
        return reduce(DataFrame.union, [d.select(F.lit(k).alias("axis"), "doc", "from_key", "name") for k, d in found.items()]).join(names, ["doc", "from_key"]).select("axis", "doc", "of", "name")
