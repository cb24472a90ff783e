"""Joins, aggregation, sorting and set operations with the query language's rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: A side is broadcast by hand only below this size, as Catalyst estimates it; else the planner and AQE choose.
BROADCAST_BYTES = 32 << 20


def size_in_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if size_in_bytes(df) <= BROADCAST_BYTES else df


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int) -> DataFrame:
    """Inner join whose left side has hot keys: left rows take one of ``salts``, right rows all."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(F.struct(*left.columns)), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"]).drop("_salt")


def band_join(points: DataFrame, ranges: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high] that hold them: an equi-join on buckets of ``width``, each range in all it touches."""
    p = points.withColumn("_b", F.floor(F.col(x) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "_b").where((F.col(x) >= F.col(low)) & (F.col(x) <= F.col(high))).drop("_b")


def count_greater(left: DataFrame, right: DataFrame, x: str, y: str, factor: float) -> DataFrame:
    """Theta join reduced to its count: for each left row, how many right rows have ``x > factor * y``.

    Right values are counted and cumulated once; each left row looks its
    place up by a union and a window over bucketed values rather than by a
    product of the sides.
    """
    steps = right.where(F.col(y).isNotNull()).groupBy((F.col(y) * factor).alias("_v")).agg(F.count("*").alias("_n"))
    lefts = left.withColumns({"_v": F.col(x), "_n": F.lit(0).cast("long"), "_left": F.lit(1)})
    # 64 buckets to a doubling, in the values' order: some 260,000 at most, whatever the rows
    size = F.floor(F.log2(F.greatest(F.abs("_v"), F.lit(1e-300))) * 64) + 70_000
    both = lefts.unionByName(steps.withColumn("_left", F.lit(0)), allowMissingColumns=True).withColumn("_bucket", size * F.signum("_v"))
    per = both.groupBy("_bucket").agg(F.sum("_n").alias("_t"))
    below = per.withColumn("_before", F.coalesce(F.sum("_t").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_before")
    w = W.partitionBy("_bucket").orderBy("_v", F.desc("_left")).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_in", F.sum("_n").over(w)).where("_left = 1").join(F.broadcast(below), "_bucket", "left")
    return out.select(*left.columns, (F.col("_in") + F.coalesce("_before", F.lit(0))).alias("n"))


def group(df: DataFrame, by: Mapping[str, Column], aggregates: Mapping[str, Column], order: str | None = None, having: Column | None = None) -> DataFrame:
    """Group by computed keys; with ``order``, ``first_at`` has each group's first appearance."""
    aggs = [c.alias(n) for n, c in aggregates.items()] + ([F.min(order).alias("first_at")] if order else [])
    out = df.groupBy(*[c.alias(n) for n, c in by.items()]).agg(*aggs)
    return out.where(having) if having is not None else out


def top(df: DataFrame, by: Sequence[Column], k: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*by).offset(offset).limit(k) if offset else df.orderBy(*by).limit(k)


def ranked(df: DataFrame, by: Sequence[Column], name: str = "ord", within: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*by)))


def numbered(df: DataFrame, by: Sequence[str], name: str = "ord") -> DataFrame:
    """A total order's ranks without one task seeing all rows: range partitions, their sizes, and a rank in each."""
    parts = written(df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")  # read twice: for the sizes and for the rows
    sizes = parts.groupBy("_p").count().orderBy("_p").collect()  # one row a partition
    start, rows = 0, []
    for p, n in sizes:
        rows.append((p, start))
        start += n
    starts = df.sparkSession.createDataFrame(rows or [(0, 0)], "_p int, _start long")
    local = F.row_number().over(W.partitionBy("_p").orderBy(*by))
    return parts.withColumn("_r", local).join(F.broadcast(starts), "_p").withColumn(name, F.col("_r") + F.col("_start")).drop("_p", "_r", "_start")


def sequence_of(*parts: DataFrame) -> DataFrame:
    """Comma operator: all rows of all parts, with each part's place."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out
