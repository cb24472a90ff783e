"""Quality rules as a short-circuit cascade (built-in functions only).

Every rule is a Boolean Column over the text's derived columns, with the work it
takes on a text.  On a bounded sample, taken from the head of a few files all
over the table, one small job estimates each rule's rejection rate and its cost:
the mean work, in characters looked at.  Work is counted, not timed, so that the
estimate is that of the texts and not of a busy machine, and the order is the
same in every run.  Rules are then ordered by rejections per cost and chained in
one ``CASE WHEN``, evaluated left to right and left at the first rejection.  The
order changes the cost and ``rejected_by``, never ``kept``.

Metrics that are wanted anyway (words, symbols, repeated lines) are computed
once, and rules on them cost next to nothing; what fails the base is rejected
before any rule is looked at.

Defined results: a null text has no words (so it fails the length rule); texts
may be of any length; rows are independent, so repeated rows get the same values
and ties don't arise; other input columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

#: Rows of the sample on which costs and selectivities are estimated, at most, and the files that they come from.
SAMPLE_ROWS, SAMPLE_FILES = 512, 8
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: Characters a byte search passes in the time of one step of a regular expression's character class, or of a lambda.
CLASS_STEP, LAMBDA_STEP = 16, 32


@dataclass(frozen=True)
class Rule:
    """``rejects``: true for texts to drop, over :func:`prepare`'s columns; ``work``: characters looked at to tell."""

    name: str
    rejects: Column
    work: Column


def default_rules() -> list[Rule]:
    """Thresholds in the spirit of published web-text filters; each leaves ordinary prose in any language alone."""
    c = F.col
    n, length = c("_words_n"), F.length("_text")
    letters = F.regexp_count(c("_text"), F.lit("\\p{L}"))
    return [
        Rule("symbols", c("_symbols") * 5 > n, F.lit(1)),
        Rule("shouting", F.regexp_count(c("_text"), F.lit("\\p{Lu}")) * 2 > letters, length * (2 * CLASS_STEP)),
        Rule("exclamations", (length - F.length(F.replace("_text", F.lit("!"), F.lit("")))) * 2 > n, length * 2),
        Rule("duplicate_lines", c("_dup_lines") * 100 > F.size("_lines") * 40, F.lit(1)),
        Rule("word_length", (c("_chars") < n * 2) | (c("_chars") > n * 15), F.lit(1)),
        Rule("stutter", F.size(F.filter("_words", lambda w, i: w == F.get(c("_words"), i - 1))) * 4 > n, n * LAMBDA_STEP),
    ]


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and what rules read: ``_text``, ``_words``, ``_words_n``, ``_lines`` (those with a word), ``_chars`` (in words), ``_symbols``, ``_dup_lines``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.col("_text")
    for x in " \t\n\x0b\f\r":
        bare = F.replace(bare, F.lit(x), F.lit(""))
    return (
        docs.select(F.col(id_col), text.alias("_text"))
        .withColumn("_words", F.array_remove(F.split("_text", f"[{WS}]+"), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{WS}]")))
        .withColumns({"_words_n": F.size("_words").cast("long"), "_chars": F.length(bare).cast("long"), "_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long")})
        .withColumn("_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )


def sample_of(docs: DataFrame, rows: int, files: int = SAMPLE_FILES) -> DataFrame:
    """At most ``rows`` rows: every other one at the head of ``files`` of the table's files, evenly spread; without files, at the table's head."""
    paths = sorted(docs.inputFiles())
    try:
        path = docs.metadataColumn("_metadata")["file_path"]
        docs.where(path == "").schema  # noqa: B018  (resolved here)
    except AnalysisException:
        paths = []
    if not paths:
        return docs.limit(rows)
    take = min(files, len(paths))
    out = None
    for k in range(take):
        head = docs.where(path == paths[k * len(paths) // take]).sample(False, 0.5, seed=7).limit(rows // take)  # other files aren't opened
        out = head if out is None else out.union(head)
    return out


def measure(prepared: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[float, float]]:
    """Rule name -> (mean work, rejection rate) over a sample, in one job; of a rule that rejects nothing there, less than one row is assumed."""
    what = [F.count("*").alias("n")]
    for k, r in enumerate(rules):
        what += [F.avg(F.coalesce(r.work, F.lit(0)).cast("double")).alias(f"w{k}"), F.count_if(F.coalesce(r.rejects, F.lit(False))).alias(f"r{k}")]
    got = prepared.agg(*what).first()
    return {r.name: (max(got[f"w{k}"] or 0.0, 1.0), (got[f"r{k}"] + 0.5) / (got["n"] + 1)) for k, r in enumerate(rules)}


def order(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per cost, most first; names break ties."""
    return sorted(rules, key=lambda r: (-measured[r.name][1] / measured[r.name][0], r.name))


def verdict(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects, r.name) if out is None else out.when(r.rejects, r.name)
    return out if out is not None else F.lit(None).cast("string")


def ordered(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The rules in the order that the sample gives them."""
    rules = list(default_rules() if rules is None else rules)
    if len(rules) > 1:
        rules = order(rules, measure(prepare(sample_of(docs, sample_rows), id_col, text_col), rules))
    return rules


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, rejected_by), one row per input row, plus the prepared columns for callers that add metrics."""
    out = prepare(docs, id_col, text_col).withColumn("rejected_by", verdict(ordered(docs, rules, sample_rows, id_col, text_col)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def repeated_words(df: DataFrame, words: str = "_words", out: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words inside ``WINDOW``-word windows that occur twice or more in their own text.

    Windows are 64-bit hashes of word hashes.  Only texts where hashes repeat
    go on to the sort that finds the positions; work is O(n log n) in the text.
    """
    n = F.size(words)
    df = df.withColumn("_w1", F.when(n >= WINDOW, F.transform(words, lambda w: F.xxhash64(w))))
    for size in (1, 2, 4):  # windows of 2, 4 and 8, each of two of the size before
        c = f"_w{size}"
        df = df.withColumn(f"_w{2 * size}", F.zip_with(c, F.slice(c, F.lit(size + 1), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_win", F.slice(f"_w{WINDOW}", F.lit(1), n - (WINDOW - 1)))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_win")) < F.size("_win"),
            F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("_sorted"), j)["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    gaps = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.get(F.col("_at"), k + 1) - p))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_w1", "_w2", "_w4", "_w8", "_win", "_sorted", "_at")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Base metrics, ``base_failed``, ``kept`` and ``rejected_by`` ('base', a rule's name, null for what is kept) of every row."""
    rules = ordered(docs, id_col=id_col, text_col=text_col, **options)
    df = repeated_words(prepare(docs, id_col, text_col))
    n = F.col("_words_n")
    df = df.withColumn("_failed", (n < 20) | (F.col("n_repeat_words") * 100 > n * 30))
    df = df.withColumn("rejected_by", F.when(F.col("_failed"), "base").otherwise(verdict(rules)))
    return df.select(
        F.col(id_col),
        n.alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"),
        "n_repeat_words",
        F.col("_failed").alias("base_failed"),
        F.col("rejected_by").isNull().alias("kept"),
        "rejected_by",
    )
