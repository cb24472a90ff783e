"""Benchmark decontamination by template windows (built-in functions only).

Texts are folded to tokens of which three kinds are slots: numbers (tokens that
begin with a digit), units (a fixed list, after a number) and names (tokens with
a capital letter, wherever they stand, but for common words).  Slots become typed
placeholders, and every window of ``WINDOW`` template tokens is hashed, in a
plain form too that takes names for the words they are: what is capitalised
changes with headings and shouting, and a copy must not hide behind that.
Document windows of either form are hash-joined to the benchmark's (broadcast
only while their counted number is below ``BROADCAST_WINDOWS``).  Hits on one
diagonal (document position less item position) align the texts; there, each of
the item's slot values must stand for one document value throughout, which holds
for copies and for re-parameterised questions alike and not for chance
templates.  A document leaks an item when hits on consistent diagonals cover
``COVERAGE`` of the item's windows.

A window needs a token that is no slot; those without one aren't counted.
Items without such a window, or of fewer than ``WINDOW`` tokens, are looked for
as whole lines: a line of the document must have their very tokens, case and
ASCII punctuation aside.

Defined results: null and empty texts or items match nothing; texts may be of any
length; rows equal in id and text give their matches once; rows with a null id
are reported with a null id; items that repeat are reported each; other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize

WINDOW = 8
COVERAGE = 0.3
BROADCAST_WINDOWS = 500_000

#: Unit words that follow numbers.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years hz khz mhz ghz w kw mw v a ma pa kpa bar psi j kj cal kcal mol k c f usd eur gbp dollar dollars euro euros cent cents "
    "percent meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter liters litre litres kb mb gb tb"
).split()

#: Words that are capitalised for standing first, not for being names.
COMMON = (
    "a an the this that these those it its he she they we you i his her their our your my there here what which who whom whose where when why how "
    "if is are was were be been has have had do does did can could will would shall should may might must in on at of to from for with by as and or but not no "
    "all each every some any one two three after before then so find let given suppose consider calculate compute determine name"
).split()

PUNCTUATION = "[!-/:-@\\[-`{-~]+"


def tokens(text: Column) -> Column:
    """The words without ASCII punctuation, in their own case."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), PUNCTUATION, ""), f"[{WS}]+"), "")


def is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def fixed_kind(toks: Column, w: Column, i: Column) -> Column:
    """'num' or 'unit' of the lower-case token ``w`` at ``i``; null for another."""
    unit = w.isin(UNITS) & F.coalesce(is_number(F.get(toks, i - 1)), F.lit(False))
    return F.when(is_number(w), "num").when(unit, "unit")


def is_name(cased: Column, low: Column) -> Column:
    return (cased != low) & ~low.isin(COMMON)


def kind(cased: Column, low: Column, i: Column) -> Column:
    """'num', 'unit' or 'name' of the token at ``i``; null for a literal."""
    w = F.get(low, i)
    return F.coalesce(fixed_kind(low, w, i), F.when(is_name(F.get(cased, i), w), "name"))


def windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., pos, h, plain): the hashes of every window of ``WINDOW`` template tokens of ``toks``, in the plain form and in that with names; nulls for shorter texts."""
    n = F.size("toks")
    df = df.withColumn("low", F.transform("toks", F.lower))
    plain = F.transform("low", lambda w, i: F.xxhash64(F.coalesce(F.concat(F.lit("\u0002"), fixed_kind(F.col("low"), w, i)), w)))
    df = df.withColumn("plain1", F.when(n >= WINDOW, plain))
    name, *fixed = (F.xxhash64(F.lit(f"\u0002{k}")) for k in ("name", "num", "unit"))
    df = df.withColumn("named1", F.transform("plain1", lambda h, i: F.when(is_name(F.get("toks", i), F.get("low", i)) & ~h.isin(*fixed), name).otherwise(h)))
    for form in ("plain", "named"):  # windows of 2, 4 and 8, each of two of the size before
        for size in (1, 2, 4):
            c = f"{form}{size}"
            df = df.withColumn(f"{form}{2 * size}", F.zip_with(c, F.slice(c, F.lit(size + 1), n), lambda a, b: F.xxhash64(a, b)))
    whole = [F.slice(f"{form}{WINDOW}", F.lit(1), n - (WINDOW - 1)) for form in ("plain", "named")]
    # the outer form: from the plain one Catalyst infers a filter that computes the arrays again
    df = df.select(*keep, (n - (WINDOW - 1)).alias("_m"), F.posexplode_outer(F.concat(*whole)).alias("pos", "h"))
    plain = F.col("pos") < F.col("_m")
    return df.select(*keep, F.when(plain, F.col("pos")).otherwise(F.col("pos") - F.col("_m")).alias("pos"), "h", plain.alias("plain"))


def bench_windows(items: DataFrame) -> DataFrame:
    """(ikey, ipos, h, n_windows): windows with a literal in the form they are hashed in."""
    low, cased = F.col("low"), F.col("toks")
    literal = lambda slot: F.transform("low", lambda w, i: slot(w, i).isNull())
    df = items.where(F.size("toks") >= WINDOW).withColumn("low", F.transform("toks", F.lower))
    df = df.withColumns({"lit_plain": literal(lambda w, i: fixed_kind(low, w, i)), "lit_named": literal(lambda w, i: kind(cased, low, i))}).drop("low")
    spread = windows(df.select("ikey", "toks", "lit_plain", "lit_named"), ["ikey", "lit_plain", "lit_named"])
    some = lambda c: F.array_contains(F.slice(c, F.col("pos") + 1, F.lit(WINDOW)), True)
    used = spread.where(F.when(F.col("plain"), some("lit_plain")).otherwise(some("lit_named"))).select("ikey", F.col("pos").alias("ipos"), "h").distinct()
    return used.join(used.groupBy("ikey").agg(F.countDistinct("ipos").alias("n_windows")), "ikey")


def lines_like(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, thash, ikey) where a line of the document has an item's very tokens."""
    key = lambda toks: F.lower(F.array_join(toks, " "))
    line = docs.select("id", "thash", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    line = line.select("id", "thash", key(tokens(F.col("line"))).alias("key"))
    return line.join(items.select("ikey", key(F.col("toks")).alias("key")), "key").select("id", "thash", "ikey").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, thash, item, n_windows, n_hits, n_slots, reparameterised): one row per leaked item and document."""
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("toks"))
    items = materialize(items.where(F.size("toks") > 0).withColumn("ikey", F.monotonically_increasing_id()), "items")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("thash"), text.alias("text"))
    bench = materialize(bench_windows(items), "bench-windows")
    small = bench.count() <= BROADCAST_WINDOWS
    probe = windows(src.select("id", "thash", tokens(F.col("text")).alias("toks")), ["id", "thash"]).drop("plain")
    hits = probe.join(F.broadcast(bench) if small else bench, "h")
    diagonals = hits.groupBy("id", "thash", "ikey", "n_windows", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.collect_set("ipos").alias("at"))
    diagonals = materialize(diagonals, "diagonals")
    per = ["id", "thash", "ikey"]
    enough = diagonals.groupBy(*per, "n_windows").agg(F.sum(F.size("at")).alias("n")).where(F.col("n") >= F.col("n_windows") * coverage)
    some = diagonals.join(enough.select(*[F.col(c).alias(f"e_{c}") for c in per]), F.expr("id <=> e_id AND thash <=> e_thash AND ikey = e_ikey"), "left_semi")
    wanted = some.select(F.col("id").alias("w_id"), F.col("thash").alias("w_thash")).distinct()
    texts = src.join(wanted, F.expr("id <=> w_id AND thash <=> w_thash"), "left_semi").groupBy(F.col("id").alias("t_id"), F.col("thash").alias("t_thash")).agg(F.first("text").alias("text"))
    texts = texts.select("t_id", "t_thash", F.transform(tokens(F.col("text")), F.lower).alias("d_low"))
    aligned = some.join(texts, F.expr("id <=> t_id AND thash <=> t_thash")).join(items.select("ikey", "item", "toks"), "ikey")
    aligned = aligned.withColumn("low", F.transform("toks", F.lower))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + WINDOW - 1))))
    pair = lambda i: F.struct(kind(F.col("toks"), F.col("low"), i).alias("kind"), F.get("low", i).alias("a"), F.get("d_low", (i + F.col("diag")).cast("int")).alias("b"))
    aligned = aligned.withColumn("pairs", F.array_distinct(F.filter(F.transform(covered, pair), lambda x: x["kind"].isNotNull())))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"], x["a"]))))
    good = aligned.where(consistent).groupBy(*per, "item", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hits"),
        F.max(F.size("pairs")).cast("long").alias("n_slots"),
        F.max(F.exists("pairs", lambda x: x["a"] != x["b"])).alias("reparameterised"),
    )
    good = good.where(F.col("n_hits") >= F.col("n_windows") * coverage).select("id", "thash", "item", "n_windows", "n_hits", "n_slots", "reparameterised")
    rest = items.join(bench, "ikey", "left_anti")
    if rest.isEmpty():
        return good
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = lines_like(src, rest).join(rest.select("ikey", "item"), "ikey").select("id", "thash", "item", one.alias("n_windows"), one.alias("n_hits"), none.alias("n_slots"), F.lit(False).alias("reparameterised"))
    return good.union(whole)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, item_id, n_windows, n_hits, n_slots, reparameterised) of every document that leaks an item."""
    out = matches(docs, benchmark, id_col=id_col, **options)
    return out.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "n_windows", "n_hits", "n_slots", "reparameterised")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows without those that leak an item, in the input's columns."""
    bad = matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("id", "thash").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_thash"))
    return row.join(bad, row["_id"].eqNullSafe(bad["id"]) & (row["_thash"] == bad["thash"]), "left_anti").select("_row.*")
