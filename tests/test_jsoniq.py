import pytest

from tempora.plans import jsoniq


@pytest.fixture(scope="module")
def data(spark):
    return {
        "orders": spark.createDataFrame([(1, 10, 5.0, ["a", "b"]), (2, 10, 7.0, []), (3, 11, None, ["b"]), (4, 12, 2.5, None)], "oid int, cid int, price double, tags array<string>"),
        "customers": spark.createDataFrame([(10, "Ann"), (11, "Bob")], "id int, name string"),
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ('for $o in collection("orders") where $o.price gt 3 order by $o.oid return $o.oid', [(1,), (2,)]),
        ('for $o in collection("orders") where not($o.price gt 3) order by $o.oid return $o.oid', [(3,), (4,)]),
        ('for $o in jn:doc("db","orders")[] let $v := $o.price * 2 where $v >= 5 order by $v descending return {"id": $o.oid, "v": $v}', [(2, 14.0), (1, 10.0), (4, 5.0)]),
        ('for $o in collection("orders"), $c in collection("customers") where $o.cid = $c.id order by $o.oid return {"o": $o.oid, "n": $c.name}', [(1, "Ann"), (2, "Ann"), (3, "Bob")]),
        ('for $o in collection("orders") group by $c := $o.cid order by $c return {"c": $c, "n": count($o), "s": sum($o.price)}', [(10, 2, 12.0), (11, 1, 0.0), (12, 1, 2.5)]),
        ('for $o in collection("orders") group by $c := $o.cid mod 2 order by count($o) descending return {"c": $c, "n": count($o)}', [(0, 3), (1, 1)]),
        ('for $o in collection("orders") for $t at $p in $o.tags order by $o.oid, $p return {"o": $o.oid, "p": $p, "t": $t}', [(1, 1, "a"), (1, 2, "b"), (3, 1, "b")]),
        ('count(for $o in collection("orders") where some $t in $o.tags satisfies $t eq "b" return $o)', [(2,)]),
        ('count(for $o in collection("orders") where every $t in $o.tags satisfies $t eq "b" return $o)', [(2,)]),
        ('sum(for $o in collection("orders") return $o.price)', [(14.5,)]),
        ('sum(for $o in collection("orders") where $o.oid gt 99 return $o.price)', [(0.0,)]),
        ('subsequence(for $o in collection("orders") order by $o.oid descending return $o.oid, 2, 2)', [(3,), (2,)]),
        ('for $o in collection("orders") where $o.oid eq 1 return {"x": $o.tags[0], "y": $o.tags[-1], "z": substring("metadata", 0, 3), "i": 7 idiv 2, "c": if ($o.price gt 5) then "hi" else "lo"}', [("a", "b", "me", 3, "lo")]),
        ('for $o in collection("orders") where $o.oid eq 2 (: a comment :) return concat("a", upper-case("b"), $o.oid)', [("aB2",)]),
    ],
)
def test_queries(spark, data, text, expected):
    assert [tuple(r) for r in jsoniq.run(spark, data, text).collect()] == expected


@pytest.mark.parametrize("text", ['for $o in collection("nope") return 1', 'for $o in collection("orders") return $x', "1 + 1", 'for $o in collection("orders") return nofn(1)', 'for $o in collection("orders") return 1 extra', "for ~"])
def test_problems_are_told(spark, data, text):
    with pytest.raises(jsoniq.SyntaxProblem):
        jsoniq.run(spark, data, text)


def test_joins_by_key(spark, data):
    from tempora.plans.flwor import explain

    plan = explain(jsoniq.run(spark, data, 'for $o in collection("orders"), $c in collection("customers") where $o.cid = $c.id return $c.name'))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
