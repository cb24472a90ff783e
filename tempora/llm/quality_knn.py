"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms of a text are hashed from what it looks like, not from where it comes:
word forms (runs of lower case, upper case, digits, each other sign), folded
words, word lengths, words repeated in place and lines repeated within the
text.  A bounded sample of labelled texts (``SAMPLE_ROWS``, those of least
hashed id among the rows offered for training) gives idf weights and, by a
randomised singular value decomposition, ``RANK`` latent directions.  Its
labelled vectors (``SAMPLE_ROWS`` x ``RANK`` floats at most) are broadcast;
every text's exact cosines with all of them come from blocked products, and the
``NEIGHBOURS`` nearest (0.4 times the root of the sample's size, if that is
less) vote with their labels, weighted by similarity.

Defined results: a null, empty or wordless text has no direction and scores the
sample's mean label; without labelled rows every score is 0.5; repeated rows
score alike; a document with several labels counts once with the mean, rounded;
rows of one id that differ train with their least text; ties between neighbours
go to the lesser id; texts may be of any length; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, keep_only, mix, slices

TERMS = 1024
SAMPLE_ROWS = 4096
RANK = 32
NEIGHBOURS = 25
STEEP = 16
FOLDS = 5
CUT = 0.3
BLOCK = 2048

#: Byte -> sign class: lower case and bytes beyond ASCII, upper case, digits, any other sign its own.
_SIGN = np.arange(256, dtype=np.uint64)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _SIGN[_c] = 1
    elif 65 <= _c <= 90:
        _SIGN[_c] = 2
    elif 48 <= _c <= 57:
        _SIGN[_c] = 3

#: Where each kind of term is hashed to: (first bucket, buckets, weight).
_SPACE = {"form": (0, 512, 1.0), "word": (512, 448, 0.25), "length": (960, 32, 0.5), "repeat": (992, 16, 2.0), "line": (1008, 16, 2.0)}
_WEIGHT = np.ones(TERMS, np.float32)
for _first, _n, _w in _SPACE.values():
    _WEIGHT[_first : _first + _n] = _w


def terms(texts: pa.Array) -> np.ndarray:
    """Term counts (texts x ``TERMS``), float32."""
    w = Words(texts)
    n = len(w)
    out = np.zeros((n, TERMS), np.float32)
    if not len(w.hash):
        return out
    doc = np.repeat(np.arange(n), np.diff(w.offsets))

    def add(kind: str, rows: np.ndarray, key: np.ndarray) -> None:
        first, size, _ = _SPACE[kind]
        at = rows * TERMS + first + (key % np.uint64(size)).astype(np.int64)
        out.reshape(-1)[:] += np.bincount(at, minlength=n * TERMS).astype(np.float32)

    sign = _SIGN[w.data]
    starts = np.zeros(len(sign), bool)
    starts[w.start] = True
    inside = np.zeros(len(sign) + 1, np.int64)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    run = inside & (starts | np.concatenate([[True], sign[1:] != sign[:-1]]))
    at = np.flatnonzero(run)
    word_of = np.searchsorted(w.start, at, "right") - 1
    first = np.searchsorted(at, w.start)
    place = np.arange(len(at)) - first[word_of]
    form = np.add.reduceat(mix(sign[at] * np.uint64(1009) + place.astype(np.uint64)), first)
    add("form", doc, mix(form))
    add("word", doc, w.hash)
    add("length", doc, np.minimum(w.end - w.start, 31).astype(np.uint64))
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])) + 1
    add("repeat", doc[same], np.zeros(len(same), np.uint64))
    # a line is the words between newlines; its hash is the sum of its words' hashes, each mixed with its place
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.start)
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(new)
    lines = np.add.reduceat(mix(w.hash + (np.arange(len(w.hash)) - np.repeat(head, np.diff(np.append(head, len(w.hash))))).astype(np.uint64)), head)
    rows = doc[head]
    order = np.lexsort((lines, rows))
    again = np.flatnonzero((lines[order][1:] == lines[order][:-1]) & (rows[order][1:] == rows[order][:-1])) + 1
    add("line", rows[order][again], np.zeros(len(again), np.uint64))
    return out


class Model:
    """idf, latent directions and labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.neighbours = neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        df = (counts > 0).sum(0)
        self.idf = ((np.log((1 + len(counts)) / (1 + df)) + 1) * _WEIGHT).astype(np.float32)
        x = self.weigh(counts)
        rank = min(rank, *x.shape) if len(x) else 0
        rng = np.random.default_rng(0)
        y = x @ rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32) if rank else np.zeros((0, 1), np.float32)
        for _ in range(4 if rank else 0):
            q, _ = np.linalg.qr(y)
            y = x @ (x.T @ q)
        if rank:
            q, _ = np.linalg.qr(y)
            _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
            self.directions = np.ascontiguousarray(vt[:rank].T)
        else:
            self.directions = np.zeros((counts.shape[1], 1), np.float32)
        self.vectors = self.project(counts)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self.weigh(counts) @ self.directions
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        has = np.flatnonzero(counts.any(1))
        for a in range(0, len(has), BLOCK):
            rows = has[a : a + BLOCK]
            cos = self.project(counts[rows]) @ self.vectors.T
            near = nearest(cos, k)
            weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** STEEP
            out[rows] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` greatest values; of equal ones the first."""
    if k >= cos.shape[1]:
        return np.tile(np.arange(cos.shape[1]), (len(cos), 1))
    out = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cos, out, 1).min(1, keepdims=True)
    for i in np.flatnonzero((cos >= least).sum(1) > k):  # ties at the edge
        out[i] = np.argsort(-cos[i], kind="stable")[:k]
    return out


def training_rows(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(id, label) of labelled rows outside the held-out fold: crc32 of the id as text, modulo ``FOLDS``, is not 0."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg(label_col)).cast("int").alias("_label"))
    return rows.where(F.crc32(F.col("_id").cast("string").cast("binary")) % FOLDS != 0)


def fit(docs: DataFrame, train: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """``train``: (_id, _label); a sample of at most ``sample_rows`` of its rows is used, each with the least text of its id, in the order of ids."""
    sample = train.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        keep_only("powers")
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in terms(b.column(2))], pa.binary())], names=["_id", "_label", "x"])

    kind = train.schema["_id"].dataType.simpleString()
    one = text.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.first("_label").alias("_label"), F.min("text").alias("text"))
    rows = sorted(one.mapInArrow(count, f"_id {kind}, _label int, x binary").collect(), key=lambda r: r[0])  # ``sample_rows`` at most
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float32).reshape(-1, TERMS)
    return Model(x, np.array([r[1] for r in rows], float), **options)


def score(docs: DataFrame, model: Model, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """The input's columns and ``out_col``; map-only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(out_col, DoubleType())])
    arrow = to_arrow_schema(schema)
    at = docs.columns.index(text_col)

    def run(batches):
        keep_only("powers")
        m = shared.value
        for batch in batches:
            for b in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(b.columns, arrow, strict=False)], pa.array(m.score(terms(b.column(at))))], schema=arrow)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = fit(docs, training_rows(labels, label_col, id_col), id_col=id_col, text_col=text_col)
    out = score(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), model, "_score", text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select(id_col, held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows predicted to be of label 1, in the input's columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    model = fit(docs, training_rows(labels, label_col, id_col), id_col=id_col, text_col=text_col)
    return score(docs, model, name, text_col).where(F.col(name) >= CUT).select(*[F.col(f"`{c}`") for c in docs.columns])
