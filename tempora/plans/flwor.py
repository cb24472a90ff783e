"""FLWOR pipelines as lazy DataFrame composition.

    (flwor(orders).let(total=F.col("price") * F.col("qty")).where(F.col("total") > 10)
     .group_by("customer").aggregate(n=F.count("*")).order_by(F.desc("n")).subsequence(1, 3).returning("customer", "n"))
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import known


@dataclass(frozen=True)
class Flwor:
    df: DataFrame
    keys: tuple[Column | str, ...] = ()

    def for_(self, name: str, array: Column | str, at: str | None = None, allowing_empty: bool = False) -> "Flwor":
        """Iterate an array column: one row a member, 1-based position in ``at``."""
        array = F.col(array) if isinstance(array, str) else array
        boom = F.posexplode_outer if allowing_empty else F.posexplode
        df = self.df.select("*", boom(array).alias("_pos", name))
        df = df.withColumn(at, F.col("_pos") + 1) if at else df
        return replace(self, df=df.drop("_pos"))

    def join(self, other: DataFrame, on, how: str = "inner") -> "Flwor":
        return replace(self, df=self.df.join(other, on, how))

    def let(self, **columns: Column) -> "Flwor":
        return replace(self, df=self.df.withColumns(columns))

    def where(self, predicate: Column) -> "Flwor":
        return replace(self, df=self.df.where(known(predicate)))

    def group_by(self, *keys: Column | str) -> "Flwor":
        return replace(self, keys=keys)

    def aggregate(self, **columns: Column) -> "Flwor":
        return Flwor(self.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in columns.items()]))

    def count(self, name: str, *order: Column | str) -> "Flwor":
        """Count clause: the tuple's place in an order."""
        return replace(self, df=self.df.withColumn(name, F.row_number().over(W.orderBy(*order))))

    def order_by(self, *columns: Column | str) -> "Flwor":
        return replace(self, df=self.df.orderBy(*columns))

    def subsequence(self, start: int, length: int) -> "Flwor":
        begin = max(start, 1)
        length = max(start + length - begin, 0)
        df = self.df.offset(begin - 1) if begin > 1 else self.df
        return replace(self, df=df.limit(length))

    def returning(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*columns)


def flwor(df: DataFrame) -> Flwor:
    return Flwor(df)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
