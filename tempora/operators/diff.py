"""Differences between revisions: keyed, by one full outer join or straight from the change log."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import at_revision


def fingerprint(cols: Sequence[str]):
    """Hash of the compared columns; equal fingerprints stand for equal rows."""
    return F.xxhash64(*[F.col(c) for c in cols], *[F.col(c).isNull() for c in cols])


def diff_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str], keep_same: bool = False) -> DataFrame:
    """(keys, op, old_<col>.., new_<col>..) with op inserted, deleted, updated (or same).

    Both sides shuffle by key once; wide states meet as structs and are compared
    column-wise in the projection, so nothing is hashed twice.
    """
    a = old.select(*keys, F.struct(*cols).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.struct(*cols).alias("_new"), F.lit(True).alias("_in_new"))
    op = F.when(F.col("_in_old").isNull(), "inserted").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("updated")
    j = a.join(b, list(keys), "full_outer").withColumn("op", op)
    if not keep_same:
        j = j.where("op <> 'same'")
    return j.select(*keys, "op", *[F.col(f"_old.{c}").alias(f"old_{c}") for c in cols], *[F.col(f"_new.{c}").alias(f"new_{c}") for c in cols])


def diff_revisions(v: DataFrame, r1: int, r2: int, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Difference of two snapshots of one versions table; 1 <= r1 < r2.

    Rows alive at both revisions as one and the same version can't differ, so
    they are left out before the join.
    """
    if not 1 <= r1 < r2:
        raise ValueError("revisions must satisfy 1 <= r1 < r2")
    spans = (F.col("rev_from") <= r1) & (F.col("rev_to").isNull() | (F.col("rev_to") > r2))
    moved = v.where(~spans)
    return diff_snapshots(at_revision(moved, r1), at_revision(moved, r2), keys, cols)


def diff_adjacent(v: DataFrame, r: int, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Difference of r - 1 and r from the rows that begin or end at r alone."""
    return diff_snapshots(v.where(F.col("rev_to") == r), v.where(F.col("rev_from") == r), keys, cols)


def summarise(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("op").agg(F.count("*").alias("n"))


def to_json(diffs: DataFrame, keys: Sequence[str], database: str, resource: str, r1: int, r2: int) -> DataFrame:
    """The difference as one JSON document (its size is the difference's; for display)."""
    item = F.struct("op", *keys, *[c for c in diffs.columns if c not in ("op", *keys)])
    body = diffs.agg(F.sort_array(F.collect_list(item)).alias("diffs"))
    return body.select(F.to_json(F.struct(F.lit(database).alias("database"), F.lit(resource).alias("resource"), F.lit(r1).alias("old-revision"), F.lit(r2).alias("new-revision"), "diffs")).alias("diff"))


def match_unkeyed(old: DataFrame, new: DataFrame, group: Sequence[str], text: str, threshold: float = 0.5) -> DataFrame:
    """Change detection without keys: within each group, equal texts match first, then the most similar by difflib's ratio.

    A greedy matching per group, ties by text (groups are documents and small): equal
    texts are counted, so a group costs its different texts.  Null texts match each
    other only.  (group, old_text, new_text, op).
    """
    import pyarrow as pa

    both = old.select(*group, F.col(text).alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(new.select(*group, F.col(text).alias("t"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = both.groupBy(*group, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    items = counted.groupBy(*group).agg(F.collect_list(F.struct("t", "a", "b")).alias("_items"))
    kinds = ", ".join(f"{g} {old.schema[g].dataType.simpleString()}" for g in group)

    def run(batches):
        from difflib import SequenceMatcher
        from functools import lru_cache

        @lru_cache(1 << 16)
        def ratio(x: str, y: str) -> float:
            return SequenceMatcher(None, x, y, False).ratio()

        for batch in batches:
            lists = batch.column(len(group))
            off, flat = np.asarray(lists.offsets), lists.flatten()
            off, (texts, n_a, n_b) = (off - off[0]).tolist(), [x.to_pylist() for x in flat.flatten()]
            row, out = [], []
            for g in range(batch.num_rows):
                start = len(out)
                a, b = {}, {}
                for i in range(off[g], off[g + 1]):
                    t, x, y = texts[i], n_a[i], n_b[i]
                    out += [(t, t, "same")] * min(x, y)
                    if x > y:
                        a[t] = x - y
                    elif y > x:
                        b[t] = y - x
                # of equal ratios the lesser texts first, as one by one
                scored = [(-s, x, y) for x in a if x is not None for y in b if y is not None and (s := ratio(x, y)) >= threshold] if a and b else []
                for _, x, y in sorted(scored):
                    if m := min(a[x], b[y]):
                        out += [(x, y, "updated")] * m
                        a[x] -= m
                        b[y] -= m
                for x, m in a.items():
                    out += [(x, None, "deleted")] * m
                for y, m in b.items():
                    out += [(None, y, "inserted")] * m
                row += [g] * (len(out) - start)
            if out:
                at = pa.array(row, pa.int64())
                made = [pa.array(x, pa.string()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(group))], *made], names=[*group, "old_text", "new_text", "op"])

    return items.mapInArrow(run, f"{kinds}, old_text string, new_text string, op string")
