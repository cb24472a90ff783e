"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

1. Each text's set of folded word n-grams (``N`` words) gives a 128-bit key and
   a MinHash signature.  Texts with one key are one class (equal sets), counted
   before anything is shuffled further.
2. Bands and rows are chosen for the target recall at the threshold; classes
   meet in buckets of equal band hashes.  A bucket whose members already share
   an earlier band is left out; a pair is counted in its first common band
   only, so no pair list is ever built or deduplicated.
3. Only classes with bucket partners have their sets built again; buckets are
   compared in bounded blocks (matrix products of set incidences), which emit
   each class's number of links and spanning edges.
4. Classes become groups by connected components over those edges.

Result per row: id, ``class_id`` (least id of the group), ``n_links`` (other
rows whose sets have Jaccard similarity of ``threshold`` or more).

Defined results: null and wordless texts have no n-grams and stay alone with
their own id; texts of fewer than ``N`` words have one n-gram, all their words;
repeated rows link to each other; rows with a null id take part, and a group of
only such rows has a null class; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, block_join, connected_components, discard, local_roots, materialize, mix, slices, unique_by_row

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.995
CHUNK = 192


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: range = range(2, 9)) -> tuple[int, int]:
    """(bands, rows): the fewest bands that reach ``recall`` at ``threshold``, for the most rows whose total stays within 48 hashes."""
    best = None
    for r in rows:
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
        if b * r <= 48:
            best = (b, r)
    return best or (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)


_rng = np.random.default_rng(8)
_XOR = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_MUL = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def sets_of(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of every text, offsets)."""
    return unique_by_row(*Words(texts, fold=True).shingles(n))


def signatures(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) as signed longs; rows of empty sets are meaningless."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if len(full):
        starts = offsets[:-1][full]
        for k in range(bands * rows):
            x = (grams ^ _XOR[k]) * _MUL[k]
            least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
            out[full, k // rows] = mix(out[full, k // rows] * np.uint64(31) + least + np.uint64(1))
    return out.view(np.int64)


def keys_of(grams: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    data = memoryview(np.ascontiguousarray(grams).astype("<u8", copy=False)).cast("B") if len(grams) else memoryview(b"")
    return [hashlib.blake2b(data[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _sign(n: int, bands: int, rows: int, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                grams, off = sets_of(b.column(1), n)
                sig = signatures(grams, off, bands, rows)
                flat = pa.array(sig.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), b.column(2), pa.array(keys_of(grams, off), pa.binary()), lists], names=["id", "thash", "key", "bands"])

    return run


def _grams(n: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                grams, off = sets_of(b.column(1), n)
                data = grams.astype("<u8", copy=False).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[8 * a : 8 * z] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["key", "grams"])

    return run


def overlaps(sets: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks of ``width`` shared n-grams."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    grams, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    keep = shared[col]
    row, col = row[keep], new[col[keep]]
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(shared.sum()), width):
        inside = (col >= a) & (col < a + width)
        x = np.zeros((m, min(width, int(shared.sum()) - a)), np.float32)
        x[row[inside], col[inside] - a] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    names = ["key", "links", "root"]

    def verify(c: dict[str, pa.Array], left: np.ndarray | None):
        sets = [np.frombuffer(x, "<u8") for x in c["grams"].to_pylist()]
        size = np.array([len(s) for s in sets])
        m, band = len(sets), c["band"][0].as_py()
        both = overlaps(sets)
        ok = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
        ok &= ~np.eye(m, dtype=bool)
        if left is not None:
            ok &= left[:, None] != left[None, :]
        if band:
            sig = np.asarray(c["bands"].flatten()).reshape(m, -1)
            for k in range(band):
                ok &= sig[:, None, k] != sig[None, :, k]
        links = ok @ np.asarray(c["weight"]).astype(np.int64)
        root = local_roots(ok)
        at = np.flatnonzero(links)
        if not len(at):
            return None
        keys = c["key"]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(links[at].astype(np.int64)), keys.take(pa.array(root[at]))], names=names)

    return verify


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: id, thash, key; classes: key, weight, links, comp (null: alone), first (id, thash))."""
    from pyspark.sql.pandas.types import to_arrow_type

    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema[id_col].dataType
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("thash"))
    signed = materialize(src.mapInArrow(_sign(n, bands, rows, to_arrow_type(kind)), f"id {kind.simpleString()}, thash long, key binary, bands array<long>"), "signed")
    classes = materialize(
        signed.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("weight"), F.min_by(F.struct("id", "thash"), F.struct(F.col("id").isNull(), "id", "thash")).alias("first"), F.first("bands").alias("bands")),
        "classes",
    )
    spread = classes.select("key", "bands", F.posexplode("bands").alias("band", "h"))
    met = [(F.min(F.col("bands")[k]) == F.max(F.col("bands")[k])) & (F.col("band") > k) for k in range(bands - 1)]
    seen = F.lit(False)
    for x in met:
        seen = seen | x
    buckets = spread.groupBy("band", "h").agg(F.count("*").alias("m"), seen.alias("seen")).where("m > 1 AND NOT seen").drop("seen")
    members = materialize(spread.select("key", "band", "h").join(buckets, ["band", "h"]), "members")
    # one row for each class with a partner: its first, found by id, so copies of a text don't travel
    wanted = members.select("key").distinct().join(classes.select("key", "first"), "key").select("key", F.col("first.id").alias("w_id"), F.col("first.thash").alias("w_thash"))
    texts = src.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & F.col("thash").eqNullSafe(F.col("w_thash"))).groupBy("key").agg(F.first("text").alias("text"))
    grams = texts.mapInArrow(_grams(n), "key binary, grams binary").join(classes.select("key", "weight", "bands"), "key")
    linked = materialize(block_join(members.join(grams, "key"), ["band", "h"], "key", "m", CHUNK, _verify(threshold), "key binary, links long, root binary"), "linked")
    discard(members)
    comps = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    out = classes.drop("bands").join(links, "key", "left").join(comps.withColumnRenamed("node", "key"), "key", "left")
    out = materialize(out.withColumn("comp", F.coalesce("comp", "key")), "groups")
    discard(linked)
    discard(classes)
    return signed.select("id", "thash", "key"), out


def join(docs: DataFrame, **options) -> DataFrame:
    """(id, class_id, n_links) of every row; options as for :func:`groups`."""
    rows, classes = groups(docs, **options)
    least = materialize(classes.groupBy("comp").agg(F.min("first.id").alias("class_id")), "least")  # apart, so that a hot group's join can be split
    known = classes.join(least, "comp").select("key", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    id_col = options.get("id_col", "doc_id")
    met = rows.where("key IS NOT NULL").join(known, "key").select("id", "class_id", "n_links")
    alone = rows.where("key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return met.union(alone).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without all but one of each group: the one of least id, then text hash; equal rows count once."""
    rows, classes = groups(docs, id_col=id_col, text_col=text_col, **options)
    best = classes.groupBy("comp").agg(F.min_by("first", F.struct(F.col("first.id").isNull(), "first.id", "first.thash")).alias("x")).select("x.*")
    alone = rows.where("key IS NULL").select("id", "thash").distinct()
    keep = best.union(alone)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_thash"))
    hit = row.join(keep, row["_id"].eqNullSafe(keep["id"]) & row["_thash"].eqNullSafe(keep["thash"]), "left_semi")
    return hit.groupBy("_id", "_thash").agg(F.first("_row").alias("_row")).select("_row.*")


def brute_force(texts: dict, n: int = N, threshold: float = THRESHOLD) -> dict:
    """id -> (class, links) from all pairs, for tests."""
    import string

    drop = str.maketrans("", "", string.punctuation)
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().translate(drop).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = list(sets)
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}
