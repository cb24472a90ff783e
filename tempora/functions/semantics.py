"""The query language's semantics where they differ from Spark's, as Column helpers.

All are built-in expressions (one Unicode helper excepted), so they stay inside
generated code and can be pushed down where Spark can push them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- logic: a comparison over a missing operand is false, and its negation true ---------------


def known(predicate: Column) -> Column:
    """Two-valued: missing counts as false."""
    return F.coalesce(predicate, F.lit(False))


def negate(predicate: Column) -> Column:
    return ~known(predicate)


def all_of(*predicates: Column) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & known(p)
    return out


def any_of(*predicates: Column) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | known(p)
    return out


def boolean(value: Column, kind: str = "string") -> Column:
    """Effective boolean value: empty strings, zero, NaN, false and missing are false."""
    if kind == "boolean":
        return known(value)
    if kind == "string":
        return known(F.length(value) > 0)
    return known((value != 0) & ~F.isnan(value.cast("double")))


# --- aggregates -------------------------------------------------------------------------------


def total(value: Column) -> Column:
    """Sum; 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0))


def exact_total(value: Column, scale: int = 4) -> Column:
    """Sum in decimal arithmetic; 0 over nothing."""
    return F.coalesce(F.sum(value.cast(f"decimal(28,{scale})")), F.lit(0).cast(f"decimal(38,{scale})"))


def count_present(value: Column) -> Column:
    return F.count(value)


# --- numbers ----------------------------------------------------------------------------------


def round_up_ties(value: Column, digits: int = 0) -> Column:
    """Half goes towards positive infinity: 2.5 -> 3, -2.5 -> -2."""
    scaled = value * 10**digits if digits else value
    low = F.floor(scaled)
    out = low + F.when(scaled - low >= 0.5, 1).otherwise(0)  # not floor(x + 0.5), whose sum may round up
    return out / 10**digits if digits else out


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def idiv(a: Column, b: Column) -> Column:
    """Integer division, towards zero, exact for whole numbers; missing for a divisor of 0."""
    exact = "decimal(38,8)"
    return F.when(b != 0, F.call_function("div", a.cast(exact), b.cast(exact))).cast("long")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign."""
    return a % b


def number(value: Column) -> Column:
    return value.try_cast("double")


def castable(value: Column, kind: str) -> Column:
    return value.try_cast(kind).isNotNull()


# --- strings ----------------------------------------------------------------------------------


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start before 1 takes away from the length."""
    start = F.lit(start) if isinstance(start, int) else start
    begin = F.greatest(start, F.lit(1))
    if length is None:
        return F.substr(s, begin)
    length = F.lit(length) if isinstance(length, int) else length
    return F.substr(s, begin, F.greatest(start + length - begin, F.lit(0)))


def substring_before(s: Column, mark: Column) -> Column:
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)).otherwise("")


def substring_after(s: Column, mark: Column) -> Column:
    at = F.instr(s, mark)
    return F.when(at > 0, F.substr(s, at + F.char_length(mark))).otherwise("")


def tokenize(s: Column, pattern: str) -> Column:
    """All tokens, trailing empty ones too."""
    return F.split(s, pattern, -1)


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "\\s+", " "))


def concat(*parts: Column) -> Column:
    """Missing parts are empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def string_join(parts: Column, between: str = "") -> Column:
    return F.array_join(parts, between)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points; missing if either is."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def codepoints(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)


def from_codepoints(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def encode_for_uri(s: Column) -> Column:
    """All but letters, digits, ``-``, ``_``, ``.`` and ``~``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(s), "\\+", "%20"), "%7E", "~"), "\\*", "%2A")


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)


def normalize_unicode(s: Column, form: str = "NFC") -> Column:
    """The one function here that needs Python: an Arrow-batched UDF."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.str.normalize(form)

    return run(s)


# --- sequences (arrays; positions are 1-based, array indexes 0-based) --------------------------


def at(a: Column, index: int) -> Column:
    """``a[index]``: 0-based, negative from the end, missing out of range."""
    return F.try_element_at(a, F.lit(index + 1 if index >= 0 else index))


def cut(a: Column, start: int, end: int | None = None) -> Column:
    """``a[start:end]``: half-open, 0-based; negative bounds count from the end."""
    n = F.size(a)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = n if end is None else (F.lit(end) if end >= 0 else n + end)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def head(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def subsequence(a: Column, start: int, length: int) -> Column:
    begin = max(start, 1)
    return F.slice(a, F.lit(begin), F.lit(max(start + length - begin, 0)))


def insert_before(a: Column, position: int, value: Column) -> Column:
    p = max(position, 1)
    return F.concat(F.slice(a, F.lit(1), F.lit(p - 1)), F.array(value), F.slice(a, F.lit(p), F.greatest(F.size(a) - p + 1, F.lit(0))))


def remove_at(a: Column, position: int) -> Column:
    return F.filter(a, lambda _, i: i + 1 != position)


def index_of(a: Column, value: Column) -> Column:
    """All positions of ``value``."""
    hit = F.transform(a, lambda x, i: F.when(x == value, i + 1))
    return F.filter(hit, lambda p: p.isNotNull())


def some(a: Column, test: Callable[[Column], Column]) -> Column:
    return known(F.exists(a, lambda x: known(test(x))))


def every(a: Column, test: Callable[[Column], Column]) -> Column:
    return known(F.forall(a, lambda x: known(test(x))))


def general_eq(a: Column, value: Column) -> Column:
    """Existential ``=``: some member equals."""
    return known(F.array_contains(a, value))


def distinct_values(a: Column) -> Column:
    return F.array_distinct(a)


def deep_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def to(start: Column, end: Column) -> Column:
    """``start to end``; empty if reversed."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>"))


def zero_or_one(a: Column) -> Column:
    return F.when(F.assert_true(F.size(a) <= 1, "a sequence of one item at most is needed").isNull(), F.try_element_at(a, F.lit(1)))


def last(a: Column) -> Column:
    """``last()``: the context's size."""
    return F.size(a)


def data(value: Column) -> Column:
    """Atomised: a value, or those of a sequence, as text."""
    return value.cast("string")


def nilled(value: Column) -> Column:
    """Whether an element says that it has no value."""
    return F.coalesce(value, F.lit("")) == "true"


def one_or_more(a: Column) -> Column:
    return F.when(F.assert_true(F.size(a) >= 1, "a sequence of one or more items is needed").isNull(), a)


def exactly_one(a: Column) -> Column:
    return F.when(F.assert_true(F.size(a) == 1, "a sequence of exactly one item is needed").isNull(), F.element_at(a, 1))


# --- JSON -------------------------------------------------------------------------------------


def field(doc: Column, path: str, kind: str = "string") -> Column:
    """A member of a VARIANT document by path; missing, or not castable: null."""
    return F.try_variant_get(doc, path, kind)


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def object_keys(text: Column) -> Column:
    return F.json_object_keys(text)


# --- dates and durations ----------------------------------------------------------------------


def parts_of(ts: Column) -> dict[str, Column]:
    return {"year": F.year(ts), "month": F.month(ts), "day": F.day(ts), "hours": F.hour(ts), "minutes": F.minute(ts), "seconds": F.second(ts)}


def seconds_between(a: Column, b: Column) -> Column:
    """b - a as a day-time duration's seconds."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1_000_000


def plus_months(ts: Column, months: Column | int) -> Column:
    m = F.lit(months) if isinstance(months, int) else months
    return ts + F.make_ym_interval(F.lit(0), m)


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return ts + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


__all__: Sequence[str] = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__]
