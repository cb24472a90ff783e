"""Secret scans: fixed patterns, then a randomness test battery with length-aware false-discovery control.

Pass 1 goes over every whole text once, map-only: pattern matches, candidate
tokens and the corpus's character-pair counts, written to the shared folder
without the texts.  Candidates are ``MIN_TOKEN`` characters or more: maximal runs
of key characters between inner ``=``, and the parts of those between separators
(see :func:`candidates`), since a name or path before a key may share its
characters.

Pass 2 judges candidates.  An encoding is inferred from the characters (hex,
base32, base36, base62, base64).  Chi-squared uniformity over that alphabet, a
runs test about the alphabet's median and lag-1 serial correlation ask whether
the token can be uniformly random; Bonferroni joins the three to one p-value u.
Let LLR be the log-likelihood of the uniform law over that of the corpus's own
character pairs.  Under ordinary text exp(LLR) has mean 1 at most at every
length, and so has u exp(LLR), since u is 1 at most: an e-value that all three
tests enter, small for what isn't random and for what is short.  Its inverse is
a p-value; Benjamini-Hochberg over those of all candidates, runs and parts alike
(from a histogram), sets the cut at ``q``, which for e-values holds whatever their
dependence.  Of candidates that overlap, the least p-value's is given.

Defined results: null and empty texts have no spans; rows are independent, so
repeated rows repeat their spans; other columns are ignored; an empty table
gives an empty result.  Equal spans of several kinds are listed in the order of
``KINDS``.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
Q = 1e-3
#: Least p-value of the battery that is told from 0.
TINY = 1e-300

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")

#: What may part a key from what stands before or after it; the other characters of a key's alphabet stay within.
SPLITS = tuple(re.compile(rf"[^{x}]{{{MIN_TOKEN},}}") for x in ("/", "/+", "_-", "/_-", "/+_-"))

ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]

#: Byte -> class of the character-pair model: 0-9, A-Z, a-z, one for other ASCII, one for bytes beyond ASCII.
_CLASS = np.full(256, 63, np.int64)
_CLASS[:128] = 62
for _i, _c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
    _CLASS[ord(_c)] = _i
CLASSES = 64

SPAN = "struct<kind:int,start:long,end:long>"
FOUND = f"id {{id}}, spans array<{SPAN}>, runs array<struct<start:long,token:string>>, pairs array<long>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by start and kind."""
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in RUN.finditer(text):  # hex digits are key characters: no match of 24 crosses a run's ends
        out += [(2, *m.span()) for m in HEX.finditer(text, *run.span()) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def candidates(run: str) -> list[tuple[int, str]]:
    """(offset, token) of what is tested of a run: what stands between inner ``=`` (the last with its padding), and its parts by each of ``SPLITS``."""
    body = run.rstrip("=")
    found = {}
    at = 0
    for piece in body.split("="):
        whole = piece if at + len(piece) < len(body) else run[at:]
        if len(whole) >= MIN_TOKEN:
            found[at, len(whole)] = whole
            if not piece.isalnum():
                for split in SPLITS:
                    for m in split.finditer(whole):
                        found[at + m.start(), len(m[0])] = m[0]
        at += len(piece) + 1
    return [(a, t) for (a, _), t in sorted(found.items())]


def infer(token: str) -> tuple[str, np.ndarray, int] | None:
    """(encoding, digit values, alphabet size) of the smallest alphabet that holds the token without its padding."""
    body = token.rstrip("=")
    have = set(body)
    for name, chars, index in _SETS:
        if have <= chars:
            return name, np.array([index[c] for c in body]), len(chars)
    return None


def uniformity(x: np.ndarray, k: int) -> float:
    """Chi-squared p-value against the uniform law; Wilson-Hilferty with the statistic's exact mean and variance."""
    n = len(x)
    stat = (np.bincount(x, minlength=k).astype(float) ** 2).sum() * k / n - n
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    if var <= 0:
        return 1.0
    shape = 2 * mean * mean / var  # degrees of freedom of the scaled chi-squared with these moments
    z = ((stat / mean) ** (1 / 3) - (1 - 2 / (9 * shape))) / math.sqrt(2 / (9 * shape))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(x: np.ndarray, k: int) -> float:
    """Wald-Wolfowitz p-value (two-sided) of runs above and below the alphabet's median."""
    up = x >= k / 2
    a, b = int(up.sum()), int((~up).sum())
    n = a + b
    if not a or not b or n < 3:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    r = 1 + int((up[1:] != up[:-1]).sum())
    return math.erfc(abs(r - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def serial(x: np.ndarray) -> float:
    """Two-sided p-value of lag-1 correlation."""
    n = len(x)
    d = x - x.mean()
    v = (d * d).sum()
    if v == 0 or n < 4:
        return 0.0 if n >= 4 else 1.0
    r = (d[1:] * d[:-1]).sum() / v
    return math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))


def battery(token: str) -> tuple[float, float] | None:
    """(p-value of being uniformly random over its encoding, log-likelihood under that law), None for no encoding."""
    if (e := infer(token)) is None or len(e[1]) < MIN_TOKEN - 2:
        return None
    _, x, k = e
    return min(1.0, 3 * min(uniformity(x, k), runs(x, k), serial(x))), -len(x) * math.log(k)


def text_model(pairs: np.ndarray) -> np.ndarray:
    """log P(class | class before), smoothed by ``CLASSES`` pairs as single classes have it."""
    c = pairs.reshape(CLASSES, CLASSES).astype(float)
    single = (c.sum(0) + 0.5) / (c.sum() + 0.5 * CLASSES)
    return np.log((c + CLASSES * single) / (c.sum(1, keepdims=True) + CLASSES))


def log_p_value(token: str, model: np.ndarray) -> float:
    """log of a bound on the chance that ordinary text yields a token so random-looking by likelihood and battery; 0 if no encoding fits."""
    if (x := battery(token)) is None:
        return 0.0
    u, uniform = x
    c = _CLASS[np.frombuffer(token.rstrip("=").encode(), np.uint8)]
    text = model[c[:-1], c[1:]].sum() - math.log(CLASSES)
    return min(0.0, text - uniform - math.log(max(u, TINY)))


def _scan(id_field: pa.Field):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    run = pa.list_(pa.struct([("start", pa.int64()), ("token", pa.string())]))
    schema = pa.schema([("id", id_field), ("spans", span), ("runs", run), ("pairs", pa.list_(pa.int64()))])

    def scan(batches):
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                text = pc.fill_null(part.column(1), "").cast(pa.large_string())
                off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
                if len(raw) > 1:
                    c = _CLASS[raw]
                    both = c[:-1] * CLASSES + c[1:]
                    inside = np.ones(len(both), bool)
                    cut = off[1:-1] - off[0] - 1
                    inside[cut[(cut >= 0) & (cut < len(both))]] = False
                    pairs += np.bincount(both[inside], minlength=CLASSES * CLASSES)
                spans, found = [], []
                for t in text.to_pylist():
                    spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t)])
                    found.append([{"start": m.start() + a, "token": x} for m in RUN.finditer(t) for a, x in candidates(m[0])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, span), pa.array(found, run), pa.nulls(part.num_rows, pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_field), pa.nulls(1, span), pa.nulls(1, run), pa.array([pairs.tolist()], pa.list_(pa.int64()))], schema=schema)

    return scan


def best_of(tested: list[dict], taken: list[tuple[int, int]]) -> None:
    """Sets ``best``, from the least p-value on, where neither ``taken`` nor a better one overlaps; ones that can't pass any cut aren't looked at."""
    reach: list[tuple[int, int]] = []  # what is taken, joined where it overlaps
    for a, z in sorted(taken):
        if reach and a < reach[-1][1]:
            reach[-1] = (reach[-1][0], max(z, reach[-1][1]))
        else:
            reach.append((a, z))
    for x in sorted(tested, key=lambda x: (x["log_p"], x["start"] - x["end"], x["start"])):
        at = bisect.bisect_left(reach, (x["end"],))
        x["best"] = x["log_p"] < 0 and (at == 0 or reach[at - 1][1] <= x["start"])
        if x["best"]:
            reach.insert(at, (x["start"], x["end"]))


def _judge(model: np.ndarray):
    """Adds to each candidate its log p-value, and whether it is the best of those that it overlaps, fixed patterns first."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_p", pa.float64()), ("best", pa.bool_())]))

    def judge(batches):
        for b in batches:
            out = []
            for row, spans in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = []
                for r in row or ():
                    got.append({"start": r["start"], "end": r["start"] + len(r["token"]), "log_p": log_p_value(r["token"], model)})
                best_of(got, [(s["start"], s["end"]) for s in spans or ()])
                out.append(got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], names=["id", "spans", "tested"])

    return judge


def cut_from(histogram: list[tuple[int, int]], q: float = Q) -> int:
    """Benjamini-Hochberg from (floor(-log p), count): the least bucket that is accepted, p taken as the bucket's greatest."""
    total, above, best = sum(n for _, n in histogram), 0, 1 << 30
    for bucket, n in sorted(histogram, reverse=True):
        above += n
        if bucket > 0 and math.exp(-bucket) <= q * above / total:
            best = bucket
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """(id, spans): array of (kind index into ``KINDS``, start, end) by start, then kind; one row per input row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(src.mapInArrow(_scan(to_arrow_type(kind)), FOUND.format(id=kind.simpleString())), "secrets")
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    summed = found.where("pairs IS NOT NULL").select(F.posexplode("pairs")).groupBy("pos").agg(F.sum("col"))
    for pos, n in summed.collect():  # CLASSES ** 2 rows
        pairs[pos] = n
    tested = found.where("pairs IS NULL").select("id", "spans", "runs").mapInArrow(
        _judge(text_model(pairs)), f"id {kind.simpleString()}, spans array<{SPAN}>, tested array<struct<start:long,end:long,log_p:double,best:boolean>>"
    )
    bucket = lambda x: F.floor(F.least(-x["log_p"], F.lit(1000.0))).cast("int")
    histogram = tested.select(F.explode("tested").alias("x")).groupBy(bucket(F.col("x")).alias("b")).count().collect()  # 1001 rows at most
    cut = cut_from([tuple(r) for r in histogram], q)
    extra = F.filter("tested", lambda x: (bucket(x) >= cut) & x["best"])
    added = F.transform(extra, lambda x: F.struct(F.lit(3).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    by_start = F.transform(F.sort_array(F.transform(F.concat("spans", added), lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return tested.select(F.col("id").alias(id_col), by_start.alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    text = lambda s: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 3), text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """(n_assign, n_access, n_hex, base_sha256) straight from the patterns' definition, for tests."""
    out = []
    for t in texts:
        t = t or ""
        s = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        s += [("access", *m.span()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
        s += [("hex", *m.span()) for m in HEX.finditer(t) if len(m[0]) >= 24]
        s.sort(key=lambda x: (x[1], KINDS.index(x[0])))
        n = [sum(x[0] == k for x in s) for k in KINDS[:3]]
        out.append((*n, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in s).encode()).hexdigest()))
    return out
