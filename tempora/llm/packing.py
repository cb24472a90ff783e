"""Best-fit packing of tokenised documents by swap-based local search.

Only the number of pieces of each length matters to a packing, so the driver
sees a histogram of at most ``capacity`` rows whatever the corpus.  Bins are
handled in classes (one content, many copies): best fit builds classes, then a
local search takes underfull classes and moves one document, exchanges one for
one or two for one between bins, each step raising the sum of squared fills,
until the least number of bins is reached or no step is left.  A class without a
step waits until a new class could take one from it, so nothing is tried twice.
Pieces are dealt to the plan's slots by
their rank within their length: ranks are partition offsets plus the place
within the task, so no length is ever sorted in one place.

Tokens: texts are cut at ASCII white space, which the tokenizer drops and never
merges across, so distinct words are encoded once per worker and looked up.

Defined results: a null or empty text is the closing id alone; repeated rows
are packed once each; other columns are ignored; an empty table gives an empty
result.  Which of several pieces of one length takes which slot is arbitrary.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _ranges, keep_only, kept, materialize, slices

CAPACITY = 4096
END_ID = 1
#: Pieces of words that a worker remembers.
CACHE_PIECES = 600_000
#: Latin letters that lower-casing and normalisation map one to one, then signs that no contraction begins with.
LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:*#$%&)\"]*)")


def tokenizer_json(path: str | None = None) -> str:
    """A ``tokenizers`` file's content; by default the public word-level BPE vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordCache:
    """Ids of words, encoded once; exact for tokenizers that drop white space and never merge across it.

    A word of Latin letters and trailing signs is two pieces, as the
    tokenizer's own splitter has it: the lower-cased letters and the signs.
    New letter pieces are encoded many at a time, joined by spaces, and told
    apart by the end-of-word mark of their last token.  Other words are encoded
    one by one.
    """

    _by_crc: dict[int, "WordCache"] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, spec: str) -> "WordCache":
        """One a worker process."""
        key = zlib.crc32(spec.encode())
        if key not in cls._by_crc:
            cls._by_crc[key] = cls(spec)
        return cls._by_crc[key]

    def clear(self) -> None:
        self.piece: dict[str, int] = {"": 0}
        self.start, self.flat = np.zeros(2, np.int64), np.zeros(0, np.uint32)

    def _add(self, names: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        self.piece.update(zip(names, range(len(self.piece), len(self.piece) + len(names)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, ids])

    def _encode_each(self, names: list[str]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast(names, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(names, np.fromiter((x for i in ids for x in i), np.uint32, int(lens.sum())), lens)

    def _encode_letters(self, names: list[str]) -> None:
        joined = [" ".join(names[i : i + 500]) for i in range(0, len(names), 500)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(names):
            self._add(names, ids, np.diff(last, prepend=-1))
        else:  # a vocabulary without the mark
            self._encode_each(names)

    def lookup(self, words: list[str]) -> np.ndarray:
        """The two pieces of each word."""
        if len(self.piece) > CACHE_PIECES:
            self.clear()
        if not words:
            return np.zeros((0, 2), np.int64)
        head, tail = zip(*[m.groups() if m else ("", w) for m, w in zip(map(LETTERS.fullmatch, words), words, strict=True)], strict=True)
        head = "\n".join(head).lower().split("\n")
        if letters := {x for x in head if x not in self.piece}:
            self._encode_letters(sorted(letters))
        if rest := {x for x in tail if x not in self.piece}:
            self._encode_each(sorted(rest))
        return np.array([np.fromiter(map(self.piece.__getitem__, x), np.int64, len(words)) for x in (head, tail)]).T

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, each closed by ``end_id``; offsets by text)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        n = len(words)
        off = np.asarray(words.offsets)
        off = off - off[0]
        coded = pc.dictionary_encode(words.flatten())
        known = self.lookup(coded.dictionary.to_pylist())
        size = np.diff(self.start)[known]
        at = np.asarray(coded.indices, np.int64) if len(coded) else np.zeros(0, np.int64)
        pieces, lens = known[at], size[at]
        total = np.concatenate([[0], np.cumsum(lens.sum(1))])
        offsets = total[off] + np.arange(n + 1)
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        is_end = np.zeros(len(out), bool)
        is_end[offsets[1:] - 1] = True
        out[~is_end] = self.flat[_ranges(self.start[pieces].reshape(-1), lens.reshape(-1))]
        return out, offsets


kept["tokens"] = WordCache._by_crc


def _pieces(spec: str, capacity: int, end_id: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        keep_only("tokens")
        cache = WordCache.of(spec)
        seen: Counter = Counter()
        for batch in batches:
            for b in slices(batch, "text"):
                ids, off = cache.encode(b.column(1))
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                cols = defaultdict(list)
                for doc, a, z in zip(b.column(0), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    for piece, s in enumerate(range(a, z, capacity)):
                        e = min(s + capacity, z)
                        n = e - s
                        for k, v in zip(schema.names, (doc.as_py(), piece, s - a, n, zlib.crc32(data[4 * s : 4 * e]), part, seen[n]), strict=True):
                            cols[k].append(v)
                        seen[n] += 1
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in schema], schema=schema)

    return run


# --- the plan ---------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[list]:
    """[content (lengths, largest first), copies]: each bin takes the largest length left, then whatever largest fits."""
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    down = list(range(-1, capacity))  # from a length without pieces, where to look next

    def find(i: int) -> int:
        """The greatest length with pieces left, at or below ``i``; 0: none."""
        path = []
        while i and not left[i]:
            path.append(i)
            i = down[i]
        for p in path:
            down[p] = i
        return i

    out = []
    while top := find(capacity):
        content, room = Counter({top: 1}), capacity - top
        left[top] -= 1
        while room and (n := find(room)):
            take = min(left[n], room // n)
            left[n] -= take
            content[n] += take
            room -= n * take
        copies = min(left[n] // content[n] for n in content)
        for n in content:
            left[n] -= copies * content[n]
        out.append([sorted(content.elements(), reverse=True), copies + 1])
    return out


def outs_of(content: tuple[int, ...]) -> dict[int, tuple[int, ...]]:
    """Growth that a bin's documents can give another, one or two at a time: sum -> documents."""
    kinds = sorted(set(content), reverse=True)
    have = Counter(content)
    out = {x + y: (x, y) for i, x in enumerate(kinds) for y in kinds[i:] if x != y or have[x] > 1}
    return out | {x: (x,) for x in kinds}


class _Rows:
    """Growing columns of whole numbers."""

    def __init__(self, width: int):
        self.data, self.n = np.zeros((width, 64), np.int64), 0

    def add(self, *columns) -> None:
        m = len(columns[0])
        while self.n + m > self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)], axis=1)
        for row, x in zip(self.data, columns, strict=True):
            row[self.n : self.n + m] = x
        self.n += m

    def keep(self, which: np.ndarray) -> None:
        left = self.data[:, : self.n][:, which]
        self.n = left.shape[1]
        self.data[:, : self.n] = left

    def __iter__(self):
        return iter(self.data[:, : self.n])


class OpenBins:
    """Classes of underfull bins, and what each could take and give, to find steps between them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.content: list[tuple[int, ...]] = []
        self.copies: list[int] = []
        self.waits = np.zeros(64, bool)
        self.known: dict[tuple[int, ...], int] = {}
        self.takes, self.gives = _Rows(4), _Rows(3)  # (class, fill, room once the document is out, the document or 0), (class, fill, sum)
        self.heap: list[tuple[int, int]] = []

    def add(self, content: tuple[int, ...], copies: int) -> None:
        if (i := self.known.get(content)) is not None:
            self.copies[i] += copies
            self.wake(i)
            return
        i = self.known[content] = len(self.content)
        self.content.append(content)
        self.copies.append(copies)
        if i == len(self.waits):
            self.waits = np.concatenate([self.waits, np.zeros_like(self.waits)])
        fill = sum(content)
        back = np.array([0, *sorted(set(content))])
        self.takes.add(np.full(len(back), i), np.full(len(back), fill), self.capacity - fill + back, back)
        out = np.array(sorted(outs_of(content)))
        self.gives.add(np.full(len(out), i), np.full(len(out), fill), out)
        heapq.heappush(self.heap, (fill, i))
        # classes that wait and could give this one something
        cls, its_fill, total = self.gives
        able = np.zeros(len(cls), bool)
        for x in back.tolist():
            able |= (total > x) & (total <= self.capacity - fill + x)
        for j in np.unique(cls[able & (its_fill <= fill) & self.waits[cls]]).tolist():
            self.wake(j)

    def wake(self, i: int) -> None:
        if self.waits[i]:
            self.waits[i] = False
            heapq.heappush(self.heap, (sum(self.content[i]), i))

    def remove(self, i: int, copies: int) -> None:
        self.copies[i] -= copies
        if not self.copies[i]:
            del self.known[self.content[i]]
            self.waits[i] = False
            if len(self.content) > 2 * len(self.known) + 64 and self.takes.n > 4096:
                live = np.array(self.copies) > 0
                for rows in (self.takes, self.gives):
                    rows.keep(live[next(iter(rows))])

    def best_step(self, i: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(partner, what goes there, what comes back) of the step that raises squared fills most; the partner is no emptier."""
        fill, outs = sum(self.content[i]), outs_of(self.content[i])
        cls, its_fill, room, back = self.takes
        alive = np.array(self.copies)[cls] > (cls == i)
        at = np.flatnonzero(alive & (its_fill >= fill))
        cls, its_fill, room, back = cls[at], its_fill[at], room[at], back[at]
        best = None
        total = np.array(sorted(outs, reverse=True))
        for a in range(0, len(total), width := max(1, (1 << 20) // max(len(at), 1))):
            s = total[a : a + width, None]
            grow = np.where(s <= room, s - back, 0)
            gain = np.where(grow > 0, grow * (its_fill - fill + grow), 0)
            if gain.size and (g := int(gain.max())) > (best[0] if best else 0):
                x, y = divmod(int(gain.argmax()), len(at))
                best = (g, int(cls[y]), outs[int(total[a + x])], (int(back[y]),) if back[y] else ())
        return best[1:] if best else None


def local_search(bins: list[list], capacity: int) -> list[list]:
    """Empties bins by moves, one-for-one and two-for-one exchanges; every step raises the sum of squared fills."""
    least = -(-sum(sum(c) * m for c, m in bins) // capacity)
    count = sum(m for _, m in bins)
    done, open_ = [], OpenBins(capacity)

    def put(content: tuple[int, ...], copies: int) -> None:
        if sum(content) == capacity:
            done.append([list(content), copies])
        elif content:
            open_.add(content, copies)

    for content, copies in bins:
        put(tuple(content), copies)
    while open_.heap and count > least:
        _, i = heapq.heappop(open_.heap)
        if not open_.copies[i] or open_.waits[i]:
            continue
        step = open_.best_step(i)
        if step is None:
            open_.waits[i] = True
            continue
        j, out, back = step
        a, b = open_.content[i], open_.content[j]
        both = open_.copies[i] // 2 if i == j else min(open_.copies[i], open_.copies[j])
        open_.remove(i, both)
        open_.remove(j, both)
        if open_.copies[i]:
            heapq.heappush(open_.heap, (sum(a), i))
        new = []
        for content, goes, comes in ((a, out, back), (b, back, out)):
            left = Counter(content)
            left.subtract(goes)
            left.update(comes)
            new.append(tuple(sorted(left.elements(), reverse=True)))
        count -= both * (not new[0])
        for x in new:
            put(x, both)
    return done + [[list(c), m] for c, m in zip(open_.content, open_.copies, strict=True) if m]


class Plan:
    """Slots by length: the piece of rank r within its length -> (sequence, offset)."""

    def __init__(self, bins: list[list]):
        rows, first, rank = [], 0, Counter()
        for content, copies in bins:
            at = 0
            for n, k in sorted(Counter(content).items(), reverse=True):
                rows.append((n, rank[n], first, k, at))
                rank[n] += k * copies
                at += n * k
            first += copies
        rows.sort()
        self.sequences = first
        self.length, self.rank, self.first, self.per, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(5)) if rows else (np.zeros(0, np.int64),) * 5

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        kinds, first = np.unique(length[order], return_index=True)
        for n, rows in zip(kinds, np.split(order, first[1:]), strict=True):
            a, z = np.searchsorted(self.length, [n, n + 1])
            out[rows] = a + np.searchsorted(self.rank[a:z], rank[rows], "right") - 1
        k = rank - self.rank[out]
        return self.first[out] + k // self.per[out], self.at[out] + k % self.per[out] * length


def plan_bins(counts: dict[int, int], capacity: int) -> list[list]:
    return local_search(best_fit(counts, capacity), capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.  ``tokenizer``: path of its file on the driver."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = _pieces(tokenizer_json(tokenizer), capacity, end_id, to_arrow_type(kind))
    pieces = materialize(src.mapInArrow(cut, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, local long"), "pieces")
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # ``capacity`` rows at most
    plan = spark.sparkContext.broadcast(Plan(plan_bins(counts, capacity)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(sizes.select("length", "part", before.alias("before")), ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )

    def deal(batches):
        p = plan.value
        for b in batches:
            if b.num_rows:
                seq, at = p.place(np.asarray(b.column(3)), np.asarray(b.column(5)))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(at)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(deal, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
