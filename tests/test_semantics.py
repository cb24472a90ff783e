import pytest
from pyspark.sql import functions as F

from tempora.functions import semantics as S


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first()[0]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: S.substring(F.lit("metadata"), 0, 3), "me"),
        (lambda: S.substring(F.lit("metadata"), 3), "tadata"),
        (lambda: S.substring(F.lit("abc"), 2, 0), ""),
        (lambda: F.size(S.tokenize(F.lit("a/b//c/"), "/")), 5),
        (lambda: S.round_up_ties(F.lit(2.5)), 3),
        (lambda: S.round_up_ties(F.lit(-2.5)), -2),
        (lambda: S.round_half_even(F.lit(2.5)), 2),
        (lambda: S.idiv(F.lit(7), F.lit(2)), 3),
        (lambda: S.idiv(F.lit(-7), F.lit(2)), -3),
        (lambda: S.mod(F.lit(7), F.lit(2)), 1),
        (lambda: S.general_eq(arr(2, 4, 6, 8), F.lit(6)), True),
        (lambda: S.general_eq(F.lit(None).cast("array<int>"), F.lit(6)), False),
        (lambda: S.at(arr(1, 2, 3), -1), 3),
        (lambda: S.at(arr(1, 2, 3), 0), 1),
        (lambda: S.at(arr(1, 2, 3), 5), None),
        (lambda: S.cut(arr(0, 1, 2, 3), 1, 3), [1, 2]),
        (lambda: S.cut(arr(0, 1, 2, 3), -2), [2, 3]),
        (lambda: S.insert_before(arr(1, 3), 2, F.lit(2)), [1, 2, 3]),
        (lambda: S.remove_at(arr(1, 2, 3), 2), [1, 3]),
        (lambda: S.index_of(arr(1, 2, 1), F.lit(1)), [1, 3]),
        (lambda: S.subsequence(arr(1, 2, 3, 4), 2, 2), [2, 3]),
        (lambda: S.subsequence(arr(1, 2, 3, 4), 0, 2), [1]),
        (lambda: S.tail(arr(1, 2, 3)), [2, 3]),
        (lambda: S.head(F.array().cast("array<int>")), None),
        (lambda: S.negate(F.lit(None).cast("boolean")), True),
        (lambda: S.known(F.lit(None).cast("boolean")), False),
        (lambda: S.boolean(F.lit("")), False),
        (lambda: S.boolean(F.lit(float("nan")), "number"), False),
        (lambda: S.to(F.lit(3), F.lit(1)), []),
        (lambda: S.compare(F.lit("a"), F.lit("b")), -1),
        (lambda: S.substring_before(F.lit("a=b=c"), F.lit("=")), "a"),
        (lambda: S.substring_after(F.lit("a=b=c"), F.lit("=")), "b=c"),
        (lambda: S.substring_after(F.lit("abc"), F.lit("=")), ""),
        (lambda: S.normalize_space(F.lit("  a \n b ")), "a b"),
        (lambda: S.concat(F.lit("a"), F.lit(None), F.lit(1)), "a1"),
        (lambda: S.codepoints(F.lit("aé")), [97, 233]),
        (lambda: S.from_codepoints(arr(97, 98)), "ab"),
        (lambda: S.encode_for_uri(F.lit("a b/c")), "a%20b%2Fc"),
        (lambda: S.local_name(F.lit("xs:int")), "int"),
        (lambda: S.number(F.lit("x")), None),
        (lambda: S.castable(F.lit("12"), "int"), True),
        (lambda: S.some(arr(1, 2), lambda x: x > 1), True),
        (lambda: S.every(arr(1, 2), lambda x: x > 1), False),
        (lambda: S.deep_equal(F.struct(F.lit(1)), F.struct(F.lit(1))), True),
        (lambda: S.field(S.parse(F.lit('{"a":{"b":2}}')), "$.a.b", "int"), 2),
        (lambda: S.field(S.parse(F.lit("broken{")), "$.a"), None),
        (lambda: S.normalize_unicode(F.lit("é")), "é"),
        (lambda: S.exactly_one(arr(5)), 5),
        (lambda: S.one_or_more(arr(5, 6)), [5, 6]),
    ],
)
def test_function(one, column, expected):
    assert value(one, column()) == expected


def test_sum_of_nothing_is_zero(spark):
    empty = spark.createDataFrame([], "x double")
    assert empty.agg(S.total(F.col("x")), F.avg("x"), S.exact_total(F.col("x"))).first()[:2] == (0, None)


def test_exactly_one_fails_for_two(one):
    with pytest.raises(Exception, match="exactly one"):
        value(one, S.exactly_one(arr(1, 2)))
