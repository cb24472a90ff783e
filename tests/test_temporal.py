"""Temporal operators against a model that replays every revision."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import diff, temporal

LAST = 8


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    rows = []
    for k in range(12):
        for rev in sorted(rng.sample(range(1, LAST + 1), rng.randint(1, 6))):
            rows.append((k, rev, rev * 10, rng.choice(["a", "b", None]), rng.random() < 0.3))
    return rows


@pytest.fixture(scope="module")
def model(log):
    """rev -> key -> value."""
    state, out = {}, {}
    for rev in range(1, LAST + 1):
        for k, r, _, v, gone in log:
            if r == rev:
                if gone:
                    state.pop(k, None)
                else:
                    state[k] = v
        out[rev] = dict(state)
    return out


@pytest.fixture(scope="module")
def v(spark, log):
    df = spark.createDataFrame(log, "k int, rev int, ts int, x string, gone boolean")
    return temporal.versions(df, ["k"], ["x"], deleted="gone").persist()


def pairs(df):
    return sorted((r["rev"], r["k"], r["x"]) for r in df.collect())


def key(x):
    return (x[0], x[1], x[2] or "")


@pytest.mark.parametrize("r", range(1, LAST + 1))
def test_snapshots(v, model, r):
    assert {x["k"]: x["x"] for x in temporal.at_revision(v, r).collect()} == model[r]


def test_open_revisions(v, model):
    got = temporal.open_revisions(v, 2, 5).collect()
    assert sorted((x["rev"], x["k"]) for x in got) == sorted((r, k) for r in range(2, 6) for k in model[r])


def test_runs_stop_at_gaps(v, model):
    def stretch(k, revs):
        out = []
        for r in revs:
            if k not in model[r]:
                break
            out.append(r)
        return out

    keys = {k for r in model for k in model[r]}
    first = {k: min(r for r in model if k in model[r]) for k in keys}
    for got, want in (
        (temporal.all_times(v, ["k"], LAST), {k: stretch(k, range(first[k], LAST + 1)) for k in keys}),
        (temporal.past(v, ["k"], 6), {k: stretch(k, range(5, 0, -1)) for k in keys}),
        (temporal.past(v, ["k"], 6, True), {k: stretch(k, range(6, 0, -1)) for k in keys}),
        (temporal.future(v, ["k"], 3, LAST), {k: stretch(k, range(4, LAST + 1)) for k in keys}),
    ):
        assert sorted((x["k"], x["rev"]) for x in got.collect()) == sorted((k, r) for k, rs in want.items() for r in rs)


@pytest.mark.parametrize("r1, r2", [(1, 2), (2, 7), (3, 8)])
def test_diff(v, model, r1, r2):
    got = {x["k"]: (x["op"], x["old_x"], x["new_x"]) for x in diff.diff_revisions(v, r1, r2, ["k"], ["x"]).collect()}
    want = {}
    for k in model[r1].keys() | model[r2].keys():
        a, b = model[r1].get(k), model[r2].get(k)
        if k not in model[r1]:
            want[k] = ("inserted", None, b)
        elif k not in model[r2]:
            want[k] = ("deleted", a, None)
        elif a != b:
            want[k] = ("updated", a, b)
    # a record that went and came back between the revisions is compared by value
    assert got == want


def test_diff_needs_order(v):
    with pytest.raises(ValueError):
        diff.diff_revisions(v, 3, 3, ["k"], ["x"])


def test_adjacent_diff_is_the_diff(v):
    a = diff.diff_revisions(v, 4, 5, ["k"], ["x"]).collect()
    b = diff.diff_adjacent(v, 5, ["k"], ["x"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_valid_time_bounds(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, None, 3), (3, 4, None), (4, None, None), (5, 6, 9)], "id int, valid_from int, valid_to int")
    assert sorted(x["id"] for x in temporal.valid_at(df, F.lit(5)).collect()) == [1, 3]
    assert sorted(x["id"] for x in temporal.valid_at(df, F.lit(3)).collect()) == [1, 2]


def test_value_runs_with_nulls(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", None, None, "a"])], "k int, t int, x string")
    got = sorted((r["run_start"], r["run_end"], r["x"], r["run_length"]) for r in temporal.value_runs(df, ["k"], "t", "x").collect())
    assert got == [(0, 1, "a", 2), (2, 3, None, 2), (4, 4, "a", 1)]
    assert sorted(r["t"] for r in temporal.changed(df, ["k"], "t", "x").collect()) == [0, 2, 4]


def test_unkeyed_matching(spark):
    a = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (1, "zzz")], "doc int, t string")
    b = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delto"), (1, "qqqqqq")], "doc int, t string")
    got = sorted((r["op"], r["old_text"], r["new_text"]) for r in diff.match_unkeyed(a, b, ["doc"], "t").collect())
    assert got == [("deleted", "zzz", None), ("inserted", None, "qqqqqq"), ("same", "alpha beta", "alpha beta"), ("updated", "gamma delta", "gamma delto")]


def _one_by_one(a, b, threshold=0.5):
    """The matching of two lists of texts, row by row."""
    from difflib import SequenceMatcher

    a, b, rows = sorted(a), sorted(b), []
    for x in list(a):
        if x in b:
            a.remove(x)
            b.remove(x)
            rows.append(("same", x, x))
    scored = sorted(((-SequenceMatcher(None, x, y, False).ratio(), i, j) for i, x in enumerate(a) for j, y in enumerate(b)))
    used_a, used_b = set(), set()
    for s, i, j in scored:
        if -s >= threshold and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            rows.append(("updated", a[i], b[j]))
    return rows + [("deleted", x, None) for i, x in enumerate(a) if i not in used_a] + [("inserted", None, y) for j, y in enumerate(b) if j not in used_b]


def test_unkeyed_matching_counts_equal_texts(spark):
    rng = random.Random(1)
    some = lambda n: ["".join(rng.choices("abc", k=rng.randrange(5))) for _ in range(n)]
    groups = {(g, None if g % 3 == 0 else g): (some(rng.randrange(9)), some(rng.randrange(9))) for g in range(40)}
    frame = lambda side: spark.createDataFrame([(*g, t) for g, x in groups.items() for t in x[side]], "g int, h int, t string")
    got = sorted(map(repr, ((r["g"], r["h"], r["op"], r["old_text"], r["new_text"]) for r in diff.match_unkeyed(frame(0), frame(1), ["g", "h"], "t").collect())))
    assert got == sorted(repr((*g, *r)) for g, (a, b) in groups.items() for r in _one_by_one(a, b))


def test_unkeyed_matching_of_a_large_group_and_nulls(spark):
    """4,000 by 4,000 rows of 20 texts; null texts match each other."""
    from time import monotonic

    old = spark.range(4000).selectExpr("1 AS doc", "CASE WHEN id > 0 THEN concat('a text of a row, ', id % 10) END AS t")
    new = spark.range(4000).selectExpr("1 AS doc", "CASE WHEN id > 1 THEN concat('a text of a line, ', id % 10) END AS t")
    start = monotonic()
    got = {}
    for r in diff.match_unkeyed(old, new, ["doc"], "t").collect():
        k = (r["op"], r["old_text"] is None, r["new_text"] is None)
        got[k] = got.get(k, 0) + 1
    assert monotonic() - start < 30
    assert got == {("same", True, True): 1, ("inserted", True, True): 1, ("updated", False, False): 3998, ("deleted", False, True): 1}
