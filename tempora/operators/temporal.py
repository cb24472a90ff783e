"""Transaction time and valid time over versioned records.

A change log has key columns, a revision number, an order within the revision
and state columns, and may flag deletions.  :func:`versions` folds it once to
validity ranges (``rev_from`` inclusive, ``rev_to`` exclusive, null: open); every
other operator is a filter, window or explode over that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def versions(changes: DataFrame, keys: Sequence[str], state: Sequence[str], rev: str = "rev", order: str = "ts", deleted: str | None = None) -> DataFrame:
    """One row per key and revision that changed it, with its range; rows for deletions only end the range before.

    One shuffle: the aggregation to the last change of a revision is by keys
    and revision, and the window by keys reuses nothing wider than keys.
    """
    last = changes.repartition(*keys).groupBy(*keys, rev).agg(F.max_by(F.struct(*state, *([deleted] if deleted else [])), order).alias("_s"))
    out = last.select(*keys, F.col(rev).alias("rev_from"), F.lead(rev).over(W.partitionBy(*keys).orderBy(rev)).alias("rev_to"), "_s.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else out


def alive(r: Column | int) -> Column:
    """Whether a version's range holds revision ``r``."""
    r = F.lit(r) if isinstance(r, int) else r
    return (F.col("rev_from") <= r) & (F.col("rev_to").isNull() | (F.col("rev_to") > r))


def at_revision(v: DataFrame, r: int) -> DataFrame:
    return v.where(alive(r))


def at_time(changes: DataFrame, keys: Sequence[str], state: Sequence[str], instant, order: str = "ts") -> DataFrame:
    """State at an instant straight from the change log: the last change not after it."""
    return changes.where(F.col(order) <= instant).groupBy(*keys).agg(F.max_by(F.struct(*state), order).alias("_s")).select(*keys, "_s.*")


def open_revisions(v: DataFrame, low: int, high: int) -> DataFrame:
    """Every snapshot from ``low`` to ``high``: (rev, keys, state); an explode of each range, not a range join."""
    a, z = F.greatest("rev_from", F.lit(low)), F.least(F.coalesce(F.col("rev_to") - 1, F.lit(high)), F.lit(high))
    return v.where((F.col("rev_from") <= high) & (F.col("rev_to").isNull() | (F.col("rev_to") > low))).withColumn("rev", F.explode(F.sequence(a, z)))


def all_times(v: DataFrame, keys: Sequence[str], last_rev: int) -> DataFrame:
    """Every revision of each record from its first up to its first gap."""
    w = W.partitionBy(*keys).orderBy("rev_from")
    gap = F.coalesce((F.lag("rev_to").over(w) != F.col("rev_from")).cast("int"), F.lit(0))
    first = v.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w)).where("_run = 0").drop("_gap", "_run")
    return open_revisions(first, 1, last_rev)


def previous(v: DataFrame, r: int) -> DataFrame:
    """Records as they were at r - 1."""
    return at_revision(v, r - 1).withColumn("rev", F.lit(r - 1))


def following(v: DataFrame, r: int) -> DataFrame:
    """Records as they are at r + 1."""
    return at_revision(v, r + 1).withColumn("rev", F.lit(r + 1))


def past(v: DataFrame, keys: Sequence[str], r: int, or_self: bool = False) -> DataFrame:
    """Snapshots before r, newest first by ``rev``, back to the first gap."""
    high = r if or_self else r - 1
    w = W.partitionBy(*keys).orderBy(F.desc("rev_from"))
    reach = v.where(F.col("rev_from") <= high)
    joined = F.coalesce(F.col("rev_to"), F.lit(1 << 30)) >= F.coalesce(F.lag("rev_from").over(w), F.lit(high + 1))
    whole = reach.withColumn("_j", joined.cast("int")).withColumn("_ok", F.min("_j").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_ok = 1").drop("_j", "_ok")
    return open_revisions(whole, 1, high)


def future(v: DataFrame, keys: Sequence[str], r: int, last_rev: int, or_self: bool = False) -> DataFrame:
    """Snapshots after r, oldest first by ``rev``, up to the first gap."""
    low = r if or_self else r + 1
    w = W.partitionBy(*keys).orderBy("rev_from")
    reach = v.where(F.col("rev_to").isNull() | (F.col("rev_to") > low))
    joined = F.col("rev_from") <= F.coalesce(F.lag("rev_to").over(w), F.lit(low))
    whole = reach.withColumn("_j", joined.cast("int")).withColumn("_ok", F.min("_j").over(w.rowsBetween(W.unboundedPreceding, 0))).where("_ok = 1").drop("_j", "_ok")
    return open_revisions(whole, low, last_rev)


def first_existing(v: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _pick(v, keys, F.min_by)


def last_existing(v: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _pick(v, keys, F.max_by)


def _pick(v: DataFrame, keys: Sequence[str], by) -> DataFrame:
    rest = [c for c in v.columns if c not in keys]
    return v.groupBy(*keys).agg(by(F.struct(*rest), "rev_from").alias("_s")).select(*keys, "_s.*")


def changed(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Item history: rows whose value differs from the one before (missing counts as a value)."""
    w = W.partitionBy(*keys).orderBy(order)
    new = F.row_number().over(w) == 1
    return df.withColumn("_new", new | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("_new").drop("_new")


def value_runs(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: (keys, value, run_start, run_end, run_length)."""
    w = W.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "_run", value).agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count("*").alias("run_length")).drop("_run")


def is_deleted(v: DataFrame, keys: Sequence[str], last_rev: int) -> DataFrame:
    """Keys that existed once and don't at ``last_rev``."""
    return v.select(*keys).distinct().join(at_revision(v, last_rev).select(*keys), list(keys), "left_anti")


def revision_at(revisions: DataFrame, instant, rev: str = "rev", ts: str = "commit_ts") -> DataFrame:
    """The greatest revision committed by an instant: one row, one column."""
    return revisions.where(F.col(ts) <= instant).agg(F.max(rev).alias(rev))


def valid_at(df: DataFrame, instant, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Closed intervals that hold ``instant``; a null bound is open, two null bounds hold nothing."""
    a, z = F.col(start), F.col(end)
    return df.where((a.isNull() | (a <= instant)) & (z.isNull() | (z >= instant)) & ~(a.isNull() & z.isNull()))


def bitemporal(v: DataFrame, r: int, instant, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Known at revision ``r`` and valid at ``instant``."""
    return valid_at(at_revision(v, r), instant, start, end)


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, state: Sequence[str]) -> DataFrame:
    """Each left row with the last right state of its keys not after it: one union and one window, no range join."""
    a = left.withColumns({"_t": F.col(left_ts), "_side": F.lit(1), "_s": F.lit(None).cast(right.select(F.struct(*state)).schema[0].dataType)})
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.struct(*state).alias("_s")).withColumn("_side", F.lit(0))
    w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col("_last")[c].alias(f"as_of_{c}") for c in state])
