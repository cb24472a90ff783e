"""Secondary indexes of node tables and records: create, find, scan, drop.

An index is a copy of what it answers with, laid out so that a scan reads few row
groups: name and path indexes are range-partitioned and sorted by name or path,
value (content-and-structure) indexes by path and typed value, valid-time indexes
by the interval's bounds, projections are narrow typed columns.  Definitions are
small JSON files beside the data, numbered by kind; a file is renamed into place
after its data is written, so a definition never names missing data.

Defined results: an index of nothing answers with nothing; a scan of an index
that doesn't exist raises; nodes without a value of the asked type aren't in a
value index; nulls in an interval's bounds are open ends.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from .store import scan_index, scan_index_range

KINDS = ("name", "path", "cas", "projection", "valid-time", "vector")
#: Where a node table keeps values of each type.
TYPED = {"string": "v_str", "number": "v_num", "boolean": "v_bool"}


class Indexes:
    """The indexes of one document or resource, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    # definitions

    def definitions(self, kind: str | None = None) -> list[dict]:
        fs, p = self._fs(f"{self.path}/definitions")
        if not fs.exists(p) or not any(x.getPath().getName().endswith(".json") for x in fs.listStatus(p)):
            return []
        rows = self.spark.read.text(f"{self.path}/definitions/*.json", wholetext=True).collect()  # one an index
        out = sorted((json.loads(r[0]) for r in rows), key=lambda d: (d["kind"], d["id"]))
        return [d for d in out if kind is None or d["kind"] == kind]

    def _define(self, kind: str, **about) -> dict:
        ids = [d["id"] for d in self.definitions(kind)]
        return {"kind": kind, "id": max(ids, default=-1) + 1, "data": f"{self.path}/data/{uuid.uuid4().hex}", **about}

    def _add(self, definition: dict, rows: DataFrame) -> int:
        rows.write.parquet(definition["data"])
        fs, draft = self._fs(f"{self.path}/definitions/.{uuid.uuid4().hex}.draft")
        _, done = self._fs(f"{self.path}/definitions/{definition['kind']}-{definition['id']}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(definition).encode()))
        out.close()
        if fs.exists(done) or not fs.rename(draft, done):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made {definition['kind']} index {definition['id']}")
        return definition["id"]

    def drop(self, kind: str, number: int) -> bool:
        """The definition first, then the data."""
        found = [d for d in self.definitions(kind) if d["id"] == number]
        for d in found:
            for part in (f"{self.path}/definitions/{kind}-{number}.json", d["data"]):
                fs, p = self._fs(part)
                fs.delete(p, True)
        return bool(found)

    def _open(self, kind: str, number: int) -> DataFrame:
        for d in self.definitions(kind):
            if d["id"] == number:
                return self.spark.read.parquet(d["data"])
        raise KeyError(f"no {kind} index {number}")

    def _find(self, kind: str, test) -> int:
        return next((d["id"] for d in self.definitions(kind) if test(d)), -1)

    # creation; ``only``: names or paths to index, all if None

    def create_name(self, nodes: DataFrame, only: Sequence[str] | None = None) -> int:
        n = nodes.where(F.col("name").isNotNull() if only is None else F.col("name").isin(*only))
        return self._add(self._define("name", only=list(only) if only is not None else None), n.repartitionByRange("name").sortWithinPartitions("name", "doc", "pre"))

    def create_path(self, nodes: DataFrame, only: Sequence[str] | None = None) -> int:
        n = nodes if only is None else nodes.where(F.col("path").isin(*only))
        return self._add(self._define("path", only=list(only) if only is not None else None), n.repartitionByRange("path").sortWithinPartitions("path", "doc", "pre"))

    def create_cas(self, nodes: DataFrame, kind: str = "string", only: Sequence[str] | None = None, unique: bool = False) -> int:
        """``unique``: raises where a path has a value twice."""
        n = nodes.where(F.col(TYPED[kind]).isNotNull()).withColumn("value", F.col(TYPED[kind]))
        n = n if only is None else n.where(F.col("path").isin(*only))
        if unique and not n.groupBy("path", "value").count().where("count > 1").isEmpty():
            raise ValueError("a value stands twice")
        return self._add(self._define("cas", type=kind, only=list(only) if only is not None else None), n.repartitionByRange("path", "value").sortWithinPartitions("path", "value", "doc", "pre"))

    def create_projection(self, records: DataFrame, columns: Sequence[str]) -> int:
        return self._add(self._define("projection", only=list(columns)), records.select(*columns))

    def create_valid_time(self, records: DataFrame, start: str, end: str) -> int:
        return self._add(self._define("valid-time", only=[start, end]), records.repartitionByRange(start).sortWithinPartitions(start, end))

    # lookup: a number, or -1

    def find_name(self, name: str) -> int:
        return self._find("name", lambda d: d["only"] is None or name in d["only"])

    def find_path(self, path: str) -> int:
        return self._find("path", lambda d: d["only"] is None or path in d["only"])

    def find_cas(self, path: str, kind: str = "string") -> int:
        return self._find("cas", lambda d: d["type"] == kind and (d["only"] is None or path in d["only"]))

    def find_projection(self, columns: Sequence[str]) -> int:
        """One that has all the columns."""
        return self._find("projection", lambda d: set(columns) <= set(d["only"]))

    def find_valid_time(self, start: str, end: str) -> int:
        return self._find("valid-time", lambda d: d["only"] == [start, end])

    # scans

    def scan_name(self, number: int, *names: str) -> DataFrame:
        return self._open("name", number).where(F.col("name").isin(*names))

    def scan_path(self, number: int, *paths: str) -> DataFrame:
        return self._open("path", number).where(F.col("path").isin(*paths))

    def scan_cas(self, number: int, key, mode: str = "EQUAL", paths: Sequence[str] | None = None) -> DataFrame:
        n = self._open("cas", number)
        return scan_index(n if paths is None else n.where(F.col("path").isin(*paths)), "value", key, mode)

    def scan_cas_range(self, number: int, low, high, include_low: bool = True, include_high: bool = True, paths: Sequence[str] | None = None) -> DataFrame:
        n = self._open("cas", number)
        return scan_index_range(n if paths is None else n.where(F.col("path").isin(*paths)), "value", low, high, include_low, include_high)

    def scan_projection(self, number: int) -> DataFrame:
        return self._open("projection", number)

    def scan_valid_time(self, number: int, instant: Column) -> DataFrame:
        start, end = next(d["only"] for d in self.definitions("valid-time") if d["id"] == number)
        return temporal.valid_at(self._open("valid-time", number), instant, start, end)
