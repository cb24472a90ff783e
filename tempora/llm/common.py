"""Shared plumbing: shared-folder tables, vectorised word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words everywhere in this subpackage (space, tab..carriage return).
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tempora-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends at files every executor sees.

    Lost executors cost nothing that is already written, unlike cached blocks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tempora-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempora_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_tempora_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- vectorised words -------------------------------------------------------------------------

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
_IS_PUNCT = np.zeros(256, bool)
_IS_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_INV = pow(int(_BASE), -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known: dict[int, np.ndarray] = {}
#: Powers that a worker keeps: 16 MB for each of the two bases.
_KEPT = 1 << 21


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if n <= _KEPT and base in _known and len(_known[base]) >= n:
        return _known[base][:n]
    if n <= _KEPT:
        _known[base] = _make_powers(min(_KEPT, max(2 * n, 1 << 16)), base)
        return _known[base][:n]
    return _make_powers(n, base)


def _make_powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k, step = 1, base
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(step)
        step = step * step % (1 << 64)
        k += m
    return out


class Words:
    """The words of a batch of texts: ``hash`` per word, ``offsets`` of each text's words, byte spans in ``data``."""

    __slots__ = ("hash", "offsets", "data", "start", "end")

    def __init__(self, texts: pa.Array, fold: bool = False):
        """``fold``: lower-case and drop ASCII punctuation first (the near-duplicate normal form)."""
        arr = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        arr = pc.fill_null(arr, "")
        if fold:
            arr = pc.utf8_lower(arr)
        n = len(arr)
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
        raw = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if arr.buffers()[2] is not None and n else np.zeros(0, np.uint8)
        off = off - (off[0] if n else 0)
        if fold and len(raw):
            gone = _IS_PUNCT[raw]
            raw, off = raw[~gone], off - np.searchsorted(np.flatnonzero(gone), off)
        self.data = raw
        if not len(raw):
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.offsets = np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
            return
        text = ~_IS_WS[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True  # a text's end is a word's end
        first = text & (np.concatenate([[True], ~text[:-1]]) | edge[:-1])
        last = text & (np.concatenate([~text[1:], [True]]) | edge[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, off).astype(np.int64)
        power, inv = _powers(len(raw), int(_BASE)), _powers(len(raw), _INV)
        acc = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power, dtype=np.uint64, out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * inv[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every k-word window, offsets by text); a text of 1..k-1 words has one window of all its words."""
        h, off = self.hash, self.offsets
        n = np.diff(off)
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        out_off = np.concatenate([[0], np.cumsum(counts)])
        if not len(h):
            return np.zeros(0, np.uint64), out_off
        full = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            full += h[j : len(h) - k + 1 + j] * _STEP[j] if len(full) else 0
        out = np.empty(out_off[-1], np.uint64)
        long = n >= k
        pos = np.repeat(off[:-1][long] - out_off[:-1][long], counts[long]) + _ranges(out_off[:-1][long], counts[long])
        where = _ranges(out_off[:-1][long], counts[long])
        out[where] = mix(full[pos])
        for i in np.flatnonzero((n > 0) & ~long):
            w = h[off[i] : off[i + 1]]
            out[out_off[i]] = mix((w * _STEP[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)))
        return out, out_off


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+count[0]-1, start[1].., as one array."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)


def unique_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each row of a ragged array."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]) if n else np.zeros(1, np.int64)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and their heaps would add up beside the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What workers keep between tasks, by its name; they live on from one operator to the next.
kept: dict[str, dict] = {"powers": _known}


def keep_only(name: str) -> None:
    """Let go of what tasks of other kinds have kept in this worker."""
    others = [d for k, d in kept.items() if k != name and d]
    for d in others:
        d.clear()
    if others:
        give_back()


def slices(batch: pa.RecordBatch, column: str, budget: int = 2 << 20, rows: int = 2048):
    """Cut a batch where its texts reach ``budget`` bytes or ``rows`` rows, so that memory holds whatever the lengths."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = acc = 0
    for i, x in enumerate(sizes):
        if i - start == rows or acc and acc + x > budget:
            yield batch.slice(start, i - start)
            start, acc = i, 0
        acc += int(x)
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back()


# --- connected components ---------------------------------------------------------------------


#: Edges up to which one task solves the graph (some 32 MB of them); beyond it the tables below do.
ONE_TASK_EDGES = 1_000_000


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, comp): comp is the least node of each component of the undirected ``edges`` (a, b), a table that is cheap to read twice.

    Up to ``ONE_TASK_EDGES``, counted, one task joins roots.  Beyond it,
    alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round is two aggregations and joins whose rows never exceed twice the
    edges, and edges end as stars around each component's least node.  Rounds
    are cut by tables in the shared folder; nothing but a row count and a
    checksum reaches the driver.  Nodes without edges don't appear.
    """
    kind = edges.schema["a"].dataType.simpleString()
    if edges.count() <= ONE_TASK_EDGES:
        return materialize(edges.select("a", "b").where("a <> b").coalesce(1).mapInArrow(_solve, f"node {kind}, comp {kind}"), "cc")
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "cc")
    mark = None
    for _ in range(max_rounds):
        large = materialize(_star(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True), "cc")
        new = materialize(_star(large, large=False), "cc")
        discard(large)
        row = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e, was, mark = new, mark, tuple(row)
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return members.union(roots)


def _solve(batches):
    """All edges of a small graph in one task: (node, comp)."""
    t = [b for b in batches if b.num_rows]
    if not t:
        return
    both = pa.concat_arrays([*[b.column(0) for b in t], *[b.column(1) for b in t]])
    first, code = _ranked(both)
    a, b = np.split(code, 2)
    root = np.arange(len(first))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    for i in range(0, len(root), 1 << 16):
        yield pa.RecordBatch.from_arrays([both.take(pa.array(first[i : i + (1 << 16)])), both.take(pa.array(first[root[i : i + (1 << 16)]]))], names=["node", "comp"])
    give_back()


def _ranked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, in order; every value's rank): whole numbers, structs of them, or texts and bytes."""
    if pa.types.is_struct(values.type):
        parts = [x.to_numpy(zero_copy_only=False) for x in values.flatten()]
        rows = np.empty(len(values), [(f"f{i}", x.dtype) for i, x in enumerate(parts)])
        for i, x in enumerate(parts):
            rows[f"f{i}"] = x
    elif pa.types.is_integer(values.type):
        rows = values.to_numpy(zero_copy_only=False)
    else:
        rows = np.array(values.to_pylist(), object)
    _, first, code = np.unique(rows, return_index=True, return_inverse=True)
    return first, code.reshape(-1)


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and the node: the larger ones, or the smaller ones and itself.

    The minima are a table of their own: were they aggregated in the join's own
    plan, all edges of a hub would have to meet in one task; so only partial
    minima do, and the join's edge side is a plain exchange that AQE can split.
    """
    least = materialize(e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc")
    j = e.join(least, "a")
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


# --- comparing the members of buckets ---------------------------------------------------------


def blocks(members: DataFrame, bucket: list[str], key: str, size_col: str, chunk: int) -> tuple[DataFrame, list[str]]:
    """Members dealt to blocks (see :func:`block_join`), sorted by block within partitions; the columns that name a block."""
    cols = [c for c in members.columns if c not in (*bucket, size_col)]
    parts = F.ceil(F.col(size_col) / F.lit(chunk)).cast("int")
    m = members.withColumn("_n", parts).withColumn("_c", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    m = m.select(*bucket, F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi"), "_c", *cols)
    by = [*bucket, "_lo", "_hi"]
    return m.repartition(*by).sortWithinPartitions(*by), by


def block_join(members: DataFrame, bucket: list[str], key: str, size_col: str, chunk: int, verify, schema: str) -> DataFrame:
    """Compare the members of every bucket pairwise, in bounded blocks spread over all tasks.

    A bucket of m members is dealt into ceil(m / ``chunk``) chunks by a hash of
    ``key``; each pair of chunks is a block, so each member goes to that many
    blocks and no task ever holds more than two chunks of a bucket.
    ``verify(columns, left)`` gets a block as a dict of Arrow arrays and, for each
    row, whether it is of the lower chunk (None: one chunk, all pairs); it
    returns a RecordBatch or None.  It emits what a block knows (links per
    member, spanning edges), never its pairs.
    """
    m, by = blocks(members, bucket, key, size_col, chunk)
    names = m.columns
    n_by = len(by)

    def emit(tables: list[pa.RecordBatch]):
        t = pa.Table.from_batches(tables)
        columns = {n: t.column(n).combine_chunks() for n in names}
        lo, hi = columns["_lo"][0].as_py(), columns["_hi"][0].as_py()
        left = None if lo == hi else columns["_c"].to_numpy() == lo
        if left is None or (left.any() and not left.all()):
            return verify(columns, left)
        return None

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            ids = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_by)]
            cut = np.zeros(b.num_rows, bool)
            for x in ids:
                cut[1:] |= x[1:] != x[:-1]
            first = tuple(x[0] for x in ids)
            if held and first != last:
                out, held = emit(held), []
                if out is not None:
                    yield out
            edges = [0, *np.flatnonzero(cut).tolist(), b.num_rows]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                held.append(b.slice(a, z - a))
                if z < b.num_rows:
                    out, held = (emit(held) if z - a > 1 or len(held) > 1 else None), []
                    if out is not None:
                        yield out
            last = tuple(x[-1] for x in ids)
        if held and (out := emit(held)) is not None:
            yield out
        give_back()

    return m.mapInArrow(run, schema)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric Boolean matrix: the least index of each index's connected group."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
