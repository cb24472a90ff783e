import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempora.operators import axes
from tempora.sources import shred

values = st.recursive(
    st.none() | st.booleans() | st.integers(-1000, 1000) | st.text("abé\n", max_size=5),
    lambda kids: st.lists(kids, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=2), kids, max_size=3),
    max_leaves=12,
)


def check(rows):
    by = {r[0]: r for r in rows}
    assert sorted(r[7] for r in rows) == list(range(len(rows))) == sorted(r[8] for r in rows)
    for r in rows:
        if r[1] is not None:
            up = by[r[1]]
            assert up[7] < r[7] and up[8] > r[8] and up[5] + 1 == r[5]


@settings(max_examples=60, deadline=None)
@given(values)
def test_json_numbering(value):
    check(shred.json_nodes(json.dumps(value)))


def test_markup_numbering():
    check(shred.html_nodes("<html><body class=a><p>one<br>two<p>three</body>"))
    check(shred.xml_nodes('<a xmlns:q="u"><b x="1">t</b><!--c--><?p i?></a>'))
    assert shred.xml_nodes("<a>") == [] and shred.json_nodes("{") == [] and shred.html_nodes(None) == []


def test_round_trip(spark):
    docs = [(1, {"b": 1, "a": [2.5, None, True, "x"], "é": {}}), (2, [])]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id int, t string")
    got = {r["doc"]: r["json"] for r in shred.serialize_json(shred.shred(df, "id", "t")).collect()}
    assert {k: json.loads(v) for k, v in got.items()} == dict(docs)
    assert got[1].index('"b"') < got[1].index('"a"')


def test_axes_against_the_tree(spark):
    n = shred.shred(spark.createDataFrame([(1, "<a><b><c/><d/></b><e><f/></e></a>")], "id int, t string"), "id", "t", "xml").persist()
    name = {r["node_key"]: r["name"] or "#" for r in n.collect()}

    def reached(df):
        return sorted((name[r["from_key"]], r["name"] or "#") for r in df.collect())

    e = n.where("kind = 'element'")
    assert reached(axes.child(e, n)) == [("a", "b"), ("a", "e"), ("b", "c"), ("b", "d"), ("e", "f")]
    assert reached(axes.parent(e, n)) == sorted([("a", "#"), ("b", "a"), ("e", "a"), ("c", "b"), ("d", "b"), ("f", "e")])
    assert reached(axes.descendant(e.where("name = 'b'"), n, True)) == [("b", "b"), ("b", "c"), ("b", "d")]
    assert reached(axes.ancestor(e.where("name = 'c'"), n)) == sorted([("c", "#"), ("c", "a"), ("c", "b")])
    assert reached(axes.following(e.where("name = 'c'"), n)) == [("c", "d"), ("c", "e"), ("c", "f")]
    assert reached(axes.preceding(e.where("name = 'f'"), n)) == [("f", "b"), ("f", "c"), ("f", "d")]
    assert reached(axes.following_sibling(e.where("name = 'b'"), n)) == [("b", "e")]
    assert reached(axes.preceding_sibling(e.where("name = 'd'"), n)) == [("d", "c")]
    counts = {r["name"]: r["descendants"] for r in axes.descendant_count(e).collect()}
    assert counts == {"a": 5, "b": 2, "c": 0, "d": 0, "e": 1, "f": 0}
    assert {r["name"] for r in axes.limited(n, max_level=2, max_children=1).collect() if r["name"]} == {"a", "b"}


def test_merkle_sees_every_change(spark):
    def root(text):
        n = shred.shred(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
        return axes.merkle(n, ["v_str", "v_num"], 3).where("parent_key IS NULL").first()["hash"]

    assert root('{"a":[1,2]}') == root('{"a": [1, 2]}')
    assert len({root('{"a":[1,2]}'), root('{"a":[2,1]}'), root('{"b":[1,2]}'), root('{"a":[1,3]}')}) == 4


def _random_tree(size, deep, seed, step=1):
    """(doc, node_key, parent_key, kind, name, level, pos, pre, post) rows of two documents; ``step`` leaves gaps in the numbers."""
    import random

    rng, rows = random.Random(seed), []
    for doc in (1, 2):
        up = {0: None} | {i: rng.randrange(max(0, i - 3) if deep else 0, i) for i in range(1, size)}
        kids = {i: [j for j in up if up[j] == i] for i in up}
        pre, post, level, pos, todo = {}, {}, {0: 0}, {0: 0}, [(0, False)]
        while todo:
            i, done = todo.pop()
            if done:
                post[i] = len(post) * step
                continue
            pre[i] = len(pre) * step
            todo.append((i, True))
            for k, j in enumerate(kids[i]):
                level[j], pos[j] = level[i] + 1, k
            todo += [(j, False) for j in reversed(kids[i])]
        rows += [(doc, i, up[i], "element", f"n{i}", level[i], pos[i], pre[i], post[i]) for i in up]
    return rows


NODES = "doc int, node_key long, parent_key long, kind string, name string, level int, pos int, pre long, post long"


def test_axes_on_ranges_are_those_of_all_pairs(spark):
    on = {
        axes.descendant: lambda c, n: n[7] > c[7] and n[8] < c[8],
        axes.ancestor: lambda c, n: n[7] < c[7] and n[8] > c[8],
        axes.following: lambda c, n: n[7] > c[7] and n[8] > c[8],
        axes.preceding: lambda c, n: n[7] < c[7] and n[8] < c[8],
    }
    for deep, step, some in ((False, 1, 1), (True, 1, 1), (True, 7, 3)):
        rows = _random_tree(220, deep, 3, step)
        context, nodes = [r for r in rows if r[1] % 5 == 0 and (r[0] == 1 or deep)], [r for r in rows if r[1] % some == 0]
        c, n = spark.createDataFrame(context, NODES), spark.createDataFrame(nodes, NODES).drop("level")
        for axis, test in on.items():
            want = sorted((x[0], x[1], y[1]) for x in context for y in nodes if x[0] == y[0] and test(x, y))
            got = axis(c, n)
            assert got.columns == ["doc", "from_key", *n.columns[1:]]
            assert sorted(map(tuple, got.select("doc", "from_key", "node_key").collect())) == want, (axis.__name__, deep, step)
            if axis in (axes.descendant, axes.ancestor):
                want = sorted(want + [(x[0], x[1], x[1]) for x in context if x in nodes])
                assert sorted(map(tuple, axis(c, n, True).select("doc", "from_key", "node_key").collect())) == want
        got = axes.pruned(c.where("node_key % 10 = 0"), n, F.col("name").endswith("3"))
        walls = [r for r in nodes if r[4].endswith("3")]
        below = on[axes.descendant]
        want = [(x[0], x[1], y[1]) for x in context if x[1] % 10 == 0 for y in nodes if x[0] == y[0] and below(x, y) and not any(w[0] == x[0] and below(x, w) and below(w, y) for w in walls)]
        assert sorted(map(tuple, got.select("doc", "from_key", "node_key").collect())) == sorted(want)


def test_axes_of_a_large_document_dont_compare_all_pairs(spark):
    """300,000 nodes of one document: 90 billion pairs, of which 0.6 million are in the result."""
    from time import monotonic

    n = spark.range(300_000).selectExpr(
        "1 AS doc", "id AS node_key", "CASE WHEN id = 0 THEN NULL WHEN id % 100 = 1 THEN 0 ELSE id - (id - 1) % 100 END AS parent_key", "'element' AS kind", "'a' AS name",
        "CASE WHEN id = 0 THEN 0 WHEN id % 100 = 1 THEN 1 ELSE 2 END AS level", "0L AS pos", "id AS pre",
        "CASE WHEN id = 0 THEN 299999L WHEN id % 100 = 1 THEN least(id + 98, 299998L) ELSE id - 2 END AS post",
    )
    start = monotonic()
    want = 299_999 + 299_999 - 3000
    assert axes.descendant(n, n).count() == want and axes.ancestor(n, n).count() == want
    assert axes.pruned(n.where("level = 0"), n, F.col("level") == 1).count() == 3000
    assert monotonic() - start < 60


def test_merkle_broadcasts_no_level(spark):
    docs = spark.range(2).selectExpr("id", """'{"a":[1,2]}' AS t""")  # of a known, small size
    hashes = axes.merkle(shred.shred(docs, "id", "t"), ["v_str", "v_num"], 2)
    assert "BroadcastHashJoin" not in hashes._jdf.queryExecution().executedPlan().toString()
    assert hashes.count() == 8
