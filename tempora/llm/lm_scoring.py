"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

1. Every word of the corpus is counted; the ``TOP`` most frequent get a token
   each, the rest share ``RARE`` tokens by hash.  The counts of all words stay a
   table: a word that shares a token has its own P(word | token).
2. A small network predicts a token from ``SIDE`` tokens on either side (never
   from itself): embeddings, one tanh layer, and a two-level softmax (token =
   group and member, so the cost is two small softmaxes), begun at the tokens'
   own frequencies.  Texts are dealt to shards of about ``SHARD_WORDS`` words by
   a hash of id and text, whatever the table's partitions; every shard trains
   from one starting point (Adagrad, minibatches in the order of the hash),
   parameters are averaged, weighted by tokens, and the next of ``ROUNDS``
   starts there.  So a table scores alike however it is split.
3. A text's score is the sum over its words of log P(token | both sides) +
   log P(word | token); the latter is 0 for words with a token of their own, and
   otherwise (count + 1) / (words and distinct words of the token + 1), so a word
   the corpus hasn't got has a count of 0.  The most frequent of these words,
   ``LISTED`` at most, are looked up in a broadcast list; the others are joined
   to the counts by hash.

What tasks send grows with the corpus (word counts, tokens, one parameter set a
task); the driver gets ``TOP`` words, ``LISTED`` counts at most and one averaged
parameter set.

Defined results: null and wordless texts have no tokens, a score of 0 and a
null mean; texts may be of any length; repeated rows score alike; ties between
equally frequent words go to the lesser hash; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, give_back, materialize, slices

GROUPS, MEMBERS = 32, 32
#: A token's group is its upper bits, its place in the group the lower ones.
SHIFT, LOW = 5, 31
TOKENS = GROUPS * MEMBERS
RARE = 64
TOP = TOKENS - RARE
SIDE = 2
DIM, HIDDEN = 16, 32
BATCH = 4096
RATE = 0.1
ROUNDS = 1
SHARD_WORDS = 1 << 21
#: Tasks that a round is dealt to at most; each trains its shards in turn.
MOST_TASKS = 20_000
#: Words that share a token whose probabilities every task gets (12 bytes each).
LISTED = 1 << 20


class Vocabulary:
    """Word hash -> token."""

    def __init__(self, top: np.ndarray):
        """``top``: hashes, most frequent first."""
        order = np.argsort(top)
        self.known, self.token = top[order], order.astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        rare = TOP + (h % np.uint64(RARE)).astype(np.int64)
        if not len(self.known):
            return rare
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.token[at], rare)


def contexts(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(tokens x 2 SIDE): the neighbours of each token within its text, ``TOKENS`` where there is none."""
    n = len(tokens)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full((n, 2 * SIDE), TOKENS, np.int64)
    for k in range(1, SIDE + 1):
        if n > k:
            same = row[k:] == row[:-k]
            out[k:, SIDE - k] = np.where(same, tokens[:-k], TOKENS)
            out[:-k, SIDE + k - 1] = np.where(same, tokens[k:], TOKENS)
    return out


SHAPES = (
    ("embed", (TOKENS + 1, DIM)),
    ("w", (2 * SIDE * DIM, HIDDEN)),
    ("b", (HIDDEN,)),
    ("group", (HIDDEN, GROUPS)),
    ("group_b", (GROUPS,)),
    ("member", (GROUPS, HIDDEN, MEMBERS)),
    ("member_b", (GROUPS, MEMBERS)),
)
SIZE = sum(int(np.prod(s)) for _, s in SHAPES)


class Network:
    """Parameters in one vector; views by name."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 2):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.standard_normal(s) * (0.3 if k == "embed" else 1 / np.sqrt(s[-2])) if len(s) > 1 and k != "member_b" else np.zeros(s)).ravel() for k, s in SHAPES])
        self.flat = np.array(flat, np.float32)
        self.sums = np.zeros(0, np.float32)
        at = 0
        for name, shape in SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embed[ctx].reshape(len(ctx), -1)
        return x, np.tanh(x @ self.w + self.b)

    @staticmethod
    def by_group(tokens: np.ndarray):
        """(group, rows) of each group that occurs."""
        order = np.argsort((tokens >> SHIFT).astype(np.uint8), kind="stable")
        edge = np.searchsorted(tokens[order] >> SHIFT, np.arange(GROUPS + 1))
        return [(g, order[a:z]) for g, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if z > a]

    def log_p(self, tokens: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        out = np.empty(len(tokens), np.float64)
        for a in range(0, len(tokens), BATCH):
            t = tokens[a : a + BATCH]
            _, h = self.hidden(ctx[a : a + BATCH])
            got = _log_softmax(h @ self.group + self.group_b)[np.arange(len(t)), t >> SHIFT].astype(np.float64)
            for g, rows in self.by_group(t):
                got[rows] += _log_softmax(h[rows] @ self.member[g] + self.member_b[g])[np.arange(len(rows)), t[rows] & LOW]
            out[a : a + BATCH] = got
        return out

    def step(self, t: np.ndarray, ctx: np.ndarray) -> None:
        """One Adagrad step on the mean loss of a minibatch."""
        n = len(t)
        x, h = self.hidden(ctx)
        grad = Network(np.zeros(SIZE, np.float32))
        d = _softmax(h @ self.group + self.group_b)
        d[np.arange(n), t >> SHIFT] -= 1
        np.matmul(h.T, d, out=grad.group)
        grad.group_b[:] = d.sum(0)
        dh = d @ self.group.T
        for g, rows in self.by_group(t):
            hg = h[rows]
            d = _softmax(hg @ self.member[g] + self.member_b[g])
            d[np.arange(len(rows)), t[rows] & LOW] -= 1
            np.matmul(hg.T, d, out=grad.member[g])
            grad.member_b[g] = d.sum(0)
            dh[rows] += d @ self.member[g].T
        dh *= 1 - h * h
        np.matmul(x.T, dh, out=grad.w)
        grad.b[:] = dh.sum(0)
        dx = (dh @ self.w.T).reshape(-1, DIM)
        at = ctx.reshape(-1).astype(np.uint16)
        order = np.argsort(at, kind="stable")
        which, first = np.unique(at[order], return_index=True)
        grad.embed[which] = np.add.reduceat(dx[order], first)
        g = grad.flat / n
        if not len(self.sums):
            self.sums = np.full(SIZE, 1e-8, np.float32)
        self.sums += g * g
        self.flat -= RATE * g / np.sqrt(self.sums)


#: Logits are held within these bounds, so their exponentials neither overflow nor vanish.
BOUND = np.float32(40)


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(np.clip(x, -BOUND, BOUND, out=x), out=x)
    x /= x @ np.ones((x.shape[1], 1), np.float32)
    return x


def _log_softmax(x: np.ndarray) -> np.ndarray:
    np.clip(x, -BOUND, BOUND, out=x)
    x -= np.log(np.exp(x) @ np.ones((x.shape[1], 1), np.float32))
    return x


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): occurrences of every folded word."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                h, n = np.unique(Words(b.column(0), fold=True).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return _texts(docs, text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "h").limit(TOP).select("h").collect()
    return Vocabulary(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _with_token(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The counts with each word's ``token``."""
    spark = counts.sparkSession
    top = spark.createDataFrame([(int(h), int(t)) for h, t in zip(vocab.known.view(np.int64), vocab.token, strict=True)], "h long, token int")  # TOP rows
    return counts.join(F.broadcast(top), "h", "left").withColumn("token", F.coalesce("token", (F.lit(TOP) + F.col("h").bitwiseAND(RARE - 1)).cast("int")))


def token_counts(counts: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences, distinct words) of each token."""
    out = np.zeros((2, TOKENS))
    for token, n, words in _with_token(counts, vocab).groupBy("token").agg(F.sum("n"), F.count("*")).collect():  # TOKENS rows at most
        out[:, token] = n, words
    return out[0], out[1]


def unigram_start(occurrences: np.ndarray) -> Network:
    """A network whose biases are the tokens' log frequencies, smoothed by one."""
    net = Network()
    p = (occurrences + 1).reshape(GROUPS, MEMBERS)
    net.group_b[:] = np.log(p.sum(1) / p.sum())
    net.member_b[:] = np.log(p / p.sum(1, keepdims=True))
    return net


def _shards(docs: DataFrame, vocab: Vocabulary, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(shard, place, tokens as little-endian 16-bit numbers) of every text with words."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)
    place = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    src = docs.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column(2), fold=True)
                t = words.value(w.hash).astype("<u2").tobytes()
                has = pa.array(np.flatnonzero(np.diff(w.offsets)))
                tokens = pa.array([t[2 * a : 2 * z] for a, z in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(has), b.column(1).take(has), tokens.take(has)], names=["shard", "place", "tokens"])

    return src.mapInArrow(run, "shard int, place long, tokens binary")


def _train_shard(net: Network, texts) -> int:
    """Trains on texts (token arrays) in turn, in minibatches of ``BATCH``; the number of tokens."""
    held, n, seen = [], 0, 0

    def steps() -> None:
        t, off = np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
        ctx = contexts(t, off)
        for a in range(0, len(t), BATCH):
            net.step(t[a : a + BATCH], ctx[a : a + BATCH])

    for t in texts:
        held.append(t)
        n, seen = n + len(t), seen + len(t)
        if n >= BATCH:
            steps()
            held, n = [], 0
    if held:
        steps()
    return seen


def _texts_by_shard(batches):
    """(shard, iterator of its token arrays), from rows sorted by shard."""
    from itertools import groupby

    def rows():
        for b in batches:
            for s, t in zip(b.column(0).to_numpy().tolist(), b.column(1), strict=True):
                yield s, t

    for s, group in groupby(rows(), lambda r: r[0]):
        yield s, (np.frombuffer(t.as_buffer(), "<u2").astype(np.int64) for _, t in group)


def train(docs: DataFrame, vocab: Vocabulary, counts: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> Network:
    sc = docs.sparkSession.sparkContext
    occurrences, _ = token_counts(counts, vocab)
    net, shards = unigram_start(occurrences), max(1, -(-int(occurrences.sum()) // shard_words))
    tokens = materialize(_shards(docs, vocab, shards, id_col, text_col), "lm-tokens")
    dealt = tokens.repartition(min(shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "place", "tokens").select("shard", "tokens")
    for _ in range(rounds):
        start = sc.broadcast(net.flat)

        def run(batches, start=start):
            total, seen = np.zeros(SIZE), 0
            for _, texts in _texts_by_shard(batches):
                mine = Network(start.value)
                n = _train_shard(mine, texts)
                total += mine.flat.astype(np.float64) * n
                seen += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.append(total, seen))], names=["at", "x"])
            give_back()

        got = dealt.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # SIZE + 1 rows
        if got.num_rows:
            x = np.zeros(SIZE + 1)
            x[got.column("at").to_numpy()] = got.column("x").to_numpy()
            net = Network(x[:-1] / x[-1])
    discard(tokens)
    return net


def _masses(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """What a shared token's probabilities are shares of: words, distinct words and one."""
    n, words = token_counts(counts, vocab)
    return (n + words + 1)[TOP:]


def least_listed(counts: DataFrame, most: int) -> int:
    """The least count from which on ``most`` words have that count or more, at most; from a histogram on a log scale."""
    bucket = F.floor(F.log2("n") * 8).cast("int")
    out = 1 << 62
    above = 0
    for b, m, low in sorted(counts.groupBy(bucket.alias("b")).agg(F.count("*"), F.min("n")).collect(), reverse=True):  # 504 rows at most
        above += m
        if above > most:
            break
        out = low
    return out


def score(docs: DataFrame, vocab: Vocabulary, net: Network, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: int = LISTED) -> DataFrame:
    """(id, n_tokens, log_likelihood, mean_log_likelihood) of every row."""
    mass = np.log(_masses(counts, vocab))
    floor = least_listed(counts, listed)
    spark = docs.sparkSession
    rare = _with_token(counts, vocab).where(F.col("token") >= TOP)
    known = rare.where(F.col("n") >= floor).select("h", "n").toArrow()  # ``listed`` rows at most
    h = known.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, log_n = h[order], np.log1p(known.column("n").to_numpy()[order].astype(np.float32))
    shared = spark.sparkContext.broadcast((vocab, net.flat, mass, h, log_n))

    def run(batches):
        from pyspark import TaskContext

        words, flat, mass, list_h, list_n = shared.value
        net = Network(flat)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column(1), fold=True)
                t = words(w.hash)
                each = net.log_p(t, contexts(t, w.offsets))
                at = np.flatnonzero(t >= TOP)
                each[at] -= mass[t[at] - TOP]
                place = np.minimum(np.searchsorted(list_h, w.hash[at]), max(len(list_h) - 1, 0))
                there = list_h[place] == w.hash[at] if len(list_h) else np.zeros(len(at), bool)
                each[at[there]] += list_n[place[there]]
                other = at[~there]
                total = np.concatenate([[0.0], np.cumsum(each)])
                n = np.diff(w.offsets)
                ll = total[w.offsets[1:]] - total[w.offsets[:-1]]
                off = np.searchsorted(other, w.offsets)
                keys = np.arange(row, row + len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0), pa.array(n), pa.array(ll), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(w.hash[other].view(np.int64)))], names=["row", "id", "n_tokens", "ll", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"row long, id {kind}, n_tokens long, ll double, rare array<long>")
    got = materialize(got, "lm-scores")
    uses = got.select("row", F.explode("rare").alias("h"))
    seldom = counts.where(F.col("n") < floor).select("h", F.log1p(F.col("n").cast("double")).alias("log_n"))
    own = uses.join(seldom, "h").groupBy("row").agg(F.sum("log_n").alias("own"))  # log 1 of an unseen word adds nothing
    out = got.select("row", F.col("id").alias(id_col), "n_tokens", "ll").join(own, "row", "left").withColumn("log_likelihood", F.col("ll") + F.coalesce("own", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(id_col, "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    counts = materialize(count_words(docs, text_col), "lm-words")
    vocab = vocabulary(counts)
    return score(docs, vocab, train(docs, vocab, counts, rounds, id_col, text_col), counts, id_col, text_col)
