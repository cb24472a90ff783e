"""A versioned store: append-only change logs in Parquet, one per resource.

A resource's changes are rows (``op``, key columns, state columns) in folders
``changes/rev=N/attempt=..``; a commit is a small file ``commits/N.json`` (rev,
time, author, message, attempt).  Changes are written first, then the commit
file is renamed into place, which is atomic: readers look only into folders that
a commit names, so a writer that dies between the two leaves nothing behind but
an unread folder, and its retry succeeds.  Of two writers of one revision the
later finds the file there and fails with :class:`Conflict`.  Nothing is
rewritten; :meth:`Resource.compact` folds the log to validity ranges for readers.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, temporal

COMMIT = "rev int, commit_ts timestamp, author string, message string, attempt string"


class Conflict(RuntimeError):
    """Another writer committed first."""


class Database:
    """A folder of resources."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, resource: str | None = None) -> bool:
        fs, p = self._fs(self.path if resource is None else f"{self.path}/{resource}/commits")
        return fs.exists(p)

    def resources(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def drop(self, resource: str | None = None) -> bool:
        fs, p = self._fs(self.path if resource is None else f"{self.path}/{resource}")
        return fs.delete(p, True)

    def create(self, resource: str, records: DataFrame, keys: Sequence[str], author: str = "", message: str = "", commit_ts: dt.datetime | None = None, valid: tuple[str, str] | None = None) -> "Resource":
        """Store ``records`` as revision 1."""
        if self.exists(resource):
            raise ValueError(f"{resource} exists")
        r = Resource(self, resource, tuple(keys), tuple(c for c in records.columns if c not in keys), valid)
        r._write(records.withColumn("op", F.lit("insert")), 1, author, message, commit_ts)
        return r

    def open(self, resource: str, keys: Sequence[str], valid: tuple[str, str] | None = None) -> "Resource":
        cols = Resource(self, resource, tuple(keys), (), valid).changes().columns
        return Resource(self, resource, tuple(keys), tuple(c for c in cols if c not in (*keys, "op", "rev")), valid)


class Resource:
    """One resource: read any revision, stage changes, commit them."""

    def __init__(self, db: Database, name: str, keys: tuple[str, ...], state: tuple[str, ...], valid: tuple[str, str] | None = None):
        self.db, self.name, self.keys, self.state, self.valid = db, name, keys, state, valid
        self.path = f"{db.path}/{name}"
        self.staged: list[DataFrame] = []
        self.pre_commit: list[Callable[["Resource"], None]] = []
        self.post_commit: list[Callable[["Resource", int], None]] = []

    # reading

    def _commits(self) -> list[int]:
        """Committed revisions, from a listing."""
        fs, p = self.db._fs(f"{self.path}/commits")
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def changes(self) -> DataFrame:
        """All committed changes, with ``rev``."""
        made = self.db.spark.read.schema(COMMIT).json(f"{self.path}/commits/*.json").select("rev", "attempt").collect()  # one row a commit
        paths = [f"{self.path}/changes/rev={r}/attempt={a}" for r, a in sorted(made)]
        return self.db.spark.read.option("basePath", f"{self.path}/changes").parquet(*paths).drop("attempt")

    def revisions(self) -> DataFrame:
        return self.db.spark.read.schema(COMMIT).json(f"{self.path}/commits/*.json").select("rev", "commit_ts", "author", "message")

    def latest(self) -> int:
        return max(self._commits(), default=0)

    def most_recent(self) -> tuple[int, dt.datetime, str, str] | None:
        """(revision, time, author, message) of the last commit."""
        row = self.revisions().where(F.col("rev") == self.latest()).first()
        return tuple(row) if row else None

    def history(self, last: int | None = None) -> DataFrame:
        h = self.revisions().orderBy(F.desc("rev"))
        return h.limit(last) if last else h

    def versions(self) -> DataFrame:
        c = self.changes().withColumn("_gone", F.col("op") == "delete").withColumn("_ord", F.lit(0))
        return temporal.versions(c, self.keys, self.state, "rev", "_ord", "_gone")

    def snapshot(self, rev: int | None = None) -> DataFrame:
        """Records at a revision (the latest by default): folders after it aren't read, and one aggregation finds each key's last change."""
        c = self.changes()
        if rev is not None:
            c = c.where(F.col("rev") <= rev)
        last = c.groupBy(*self.keys).agg(F.max_by(F.struct("op", *self.state), "rev").alias("_s"))
        return last.where("_s.op <> 'delete'").select(*self.keys, *[F.col("_s")[x].alias(x) for x in self.state])

    def at_time(self, instant: dt.datetime) -> DataFrame:
        rev = temporal.revision_at(self.revisions(), F.lit(instant)).first()[0]
        return self.snapshot(rev or 0)

    def open_revisions(self, low: dt.datetime, high: dt.datetime) -> DataFrame:
        got = self.revisions().where(F.col("commit_ts").between(F.lit(low), F.lit(high))).agg(F.min("rev"), F.max("rev")).first()
        return temporal.open_revisions(self.versions(), got[0], got[1]) if got[0] else temporal.open_revisions(self.versions(), 1, 0)

    def valid_at(self, instant, rev: int | None = None) -> DataFrame:
        start, end = self.valid or ("valid_from", "valid_to")
        return temporal.valid_at(self.snapshot(rev), instant, start, end)

    def diff(self, r1: int, r2: int) -> DataFrame:
        return diff.diff_revisions(self.versions(), r1, r2, self.keys, self.state)

    # writing

    def insert(self, records: DataFrame) -> "Resource":
        return self._stage(records, "insert")

    def replace(self, records: DataFrame) -> "Resource":
        return self._stage(records, "update")

    def set(self, where, **values) -> "Resource":
        """Replace columns of the records that match, as of the latest revision."""
        return self._stage(self.snapshot().where(where).withColumns({k: F.lit(v) if not hasattr(v, "_jc") else v for k, v in values.items()}), "update")

    def delete(self, where) -> "Resource":
        return self._stage(self.snapshot().where(where), "delete")

    def rekey(self, where, **keys) -> "Resource":
        """Move (rename): the records leave their key and come in under another."""
        rows = self.snapshot().where(where)
        self._stage(rows, "delete")
        return self._stage(rows.withColumns({k: F.lit(v) if not hasattr(v, "_jc") else v for k, v in keys.items()}), "insert")

    def copy(self, where, **keys) -> "Resource":
        return self._stage(self.snapshot().where(where).withColumns({k: F.lit(v) if not hasattr(v, "_jc") else v for k, v in keys.items()}), "insert")

    def _stage(self, rows: DataFrame, op: str) -> "Resource":
        self.staged.append(rows.select(*self.keys, *self.state).withColumn("op", F.lit(op)).withColumn("_at", F.lit(len(self.staged))))
        return self

    def rollback(self) -> None:
        self.staged = []

    def commit(self, message: str = "", author: str = "", commit_ts: dt.datetime | None = None) -> int:
        """Write what is staged as the next revision; of several changes of a key the last counts."""
        if not self.staged:
            return self.latest()
        for hook in self.pre_commit:
            hook(self)
        rows = self.staged[0]
        for s in self.staged[1:]:
            rows = rows.unionByName(s)
        rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct("op", *self.state), "_at").alias("_s")).select(*self.keys, "_s.*")
        rev = self.latest() + 1
        self._write(rows, rev, author, message, commit_ts)
        self.staged = []
        for hook in self.post_commit:
            hook(self, rev)
        return rev

    def _write(self, rows: DataFrame, rev: int, author: str, message: str, commit_ts: dt.datetime | None) -> None:
        attempt = uuid.uuid4().hex
        rows.write.mode("errorifexists").parquet(f"{self.path}/changes/rev={rev}/attempt={attempt}")
        self._commit_file({"rev": rev, "commit_ts": (commit_ts or dt.datetime.now(dt.UTC)).isoformat(), "author": author, "message": message, "attempt": attempt})

    def _commit_file(self, commit: dict) -> None:
        """The commit's file, renamed into place; the loser of a race finds it there."""
        fs, done = self.db._fs(f"{self.path}/commits/{commit['rev']}.json")
        _, draft = self.db._fs(f"{self.path}/commits/.{commit['attempt']}.draft")
        if fs.exists(done):
            raise Conflict(f"revision {commit['rev']} of {self.name} is taken")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        if not fs.rename(draft, done):
            fs.delete(draft, False)
            raise Conflict(f"revision {commit['rev']} of {self.name} is taken")

    def revert_to(self, rev: int, message: str = "", author: str = "") -> int:
        """A new revision that equals an old one."""
        now = self.latest()
        if rev < now:
            d = diff.diff_revisions(self.versions(), rev, now, self.keys, self.state)
            back = d.where("op <> 'inserted'").select(*self.keys, *[F.col(f"old_{c}").alias(c) for c in self.state], F.when(F.col("op") == "deleted", "insert").otherwise("update").alias("op"))
            out = d.where("op = 'inserted'").select(*self.keys, *[F.col(f"new_{c}").alias(c) for c in self.state], F.lit("delete").alias("op"))
            self._write(back.unionByName(out), now + 1, author, message or f"revert to {rev}", None)
        return self.latest()

    def truncate_to(self, rev: int) -> None:
        """Forget all later revisions."""
        for r in reversed([x for x in self._commits() if x > rev]):  # commits first, from the last on: whatever is left is a prefix of the history
            for part in (f"{self.path}/commits/{r}.json", f"{self.path}/changes/rev={r}"):
                fs, p = self.db._fs(part)
                fs.delete(p, True)

    def compact(self, to: str) -> DataFrame:
        """Write the versions table, sorted by key within files so that readers skip row groups."""
        self.versions().repartition(*self.keys).sortWithinPartitions(*self.keys, "rev_from").write.mode("overwrite").parquet(to)
        return self.db.spark.read.parquet(to)

    # indexes: sorted or partitioned copies

    def create_value_index(self, column: str, to: str) -> DataFrame:
        """Rows range-partitioned and sorted by a column: equality and range scans read few row groups."""
        self.snapshot().repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(to)
        return self.db.spark.read.parquet(to)

    def create_projection(self, columns: Sequence[str], to: str) -> DataFrame:
        """A narrow typed copy of some columns."""
        self.snapshot().select(*self.keys, *columns).write.mode("overwrite").parquet(to)
        return self.db.spark.read.parquet(to)


#: Search modes of value-index scans.
MODES = {
    "EQUAL": lambda c, v: c == v,
    "GREATER": lambda c, v: c > v,
    "LOWER": lambda c, v: c < v,
    "GREATER_OR_EQUAL": lambda c, v: c >= v,
    "LOWER_OR_EQUAL": lambda c, v: c <= v,
}


def scan_index(index: DataFrame, column: str, key, mode: str = "EQUAL") -> DataFrame:
    return index.where(MODES[mode](F.col(column), key))


def scan_index_range(index: DataFrame, column: str, low, high, include_low: bool = True, include_high: bool = True) -> DataFrame:
    c = F.col(column)
    return index.where((c >= low if include_low else c > low) & (c <= high if include_high else c < high))
