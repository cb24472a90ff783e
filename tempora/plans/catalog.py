"""The query catalogue: one entry per operator, over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import axes, diff, relational, temporal, vector
from ..sources import shared, shred, store
from . import functions_catalog, updates_catalog
from .flwor import flwor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = lambda spark, sf_dir: f(_Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


c = F.col
KEYS = ["user_id", "event_type"]
LAST = 30

# --- projection-style analytics ----------------------------------------------------------------


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def filter_count(t):
    return t.lineitem.where((c("l_quantity") > 25) & (c("l_returnflag") == "R")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def group_count(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT round(coalesce(sum(l_quantity), 0), 2) AS s FROM lineitem")
def sum_col(t):
    return t.lineitem.agg(F.round(S.total(c("l_quantity")), 2).alias("s"))


@query("SELECT coalesce(sum(l_quantity), 0) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def sum_of_nothing(t):
    return t.lineitem.where(c("l_quantity") < 0).agg(S.total(c("l_quantity")).alias("s"), F.avg("l_quantity").alias("a"), F.min("l_quantity").alias("lo"), F.count("*").alias("n"))


@query("SELECT round(avg(l_quantity), 6) AS a FROM lineitem")
def avg_col(t):
    return t.lineitem.agg(F.round(F.avg("l_quantity"), 6).alias("a"))


@query("SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem")
def min_max(t):
    return t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_two_keys(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def filter_group(t):
    return t.lineitem.where("l_returnflag = 'R'").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_returnflag) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def count_distinct(t):
    return t.lineitem.agg(F.count_distinct("l_returnflag").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity < 30 AND l_returnflag = 'R'")
def compound_and(t):
    return t.lineitem.where((c("l_quantity") > 10) & (c("l_quantity") < 30) & (c("l_returnflag") == "R")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'R') OR (l_discount >= 0.05 AND (l_linestatus = 'O' OR l_tax < 0.02))")
def predicate_tree_or(t):
    return t.lineitem.where(
        S.any_of(S.all_of(c("l_quantity") > 45, c("l_returnflag") == "R"), S.all_of(c("l_discount") >= 0.05, S.any_of(c("l_linestatus") == "O", c("l_tax") < 0.02)))
    ).agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (NOT coalesce(o_totalprice > 100000, false)) AS n_not, count(*) FILTER (coalesce(o_totalprice > 100000, false)) AS n_yes
FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def predicate_not_missing(t):
    big = c("o_totalprice") > 100000
    return t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left").agg(F.count_if(S.negate(big)).alias("n_not"), F.count_if(S.known(big)).alias("n_yes"))


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))) AS DOUBLE) AS revenue FROM lineitem")
def computed_agg(t):
    d = "decimal(18,4)"
    return t.lineitem.agg(F.sum(c("l_extendedprice").cast(d) * (F.lit(1).cast("decimal(1,0)") - c("l_discount").cast(d))).cast("double").alias("revenue"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def multi_agg_group(t):
    return t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("net"),
        F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"),
    )


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def having(t):
    return relational.group(t.lineitem, {"l_suppkey": c("l_suppkey")}, {"n": F.count("*")}, having=c("n") > 5)


@query("SELECT l_orderkey % 3 AS k, count(*) AS n FROM lineitem GROUP BY 1")
def group_computed_key(t):
    return relational.group(t.lineitem, {"k": S.mod(c("l_orderkey"), F.lit(3))}, {"n": F.count("*")})


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1")
def first_appearance_order(t):
    return relational.group(t.events, {"event_type": c("event_type")}, {"n": F.count("*")}, order="event_id").orderBy("first_at")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1")
def order_by_aggregate(t):
    return flwor(t.lineitem).group_by("l_returnflag").aggregate(n=F.count("*")).order_by(F.desc("n"), "l_returnflag").returning("l_returnflag", "n")


@query("SELECT o_orderkey, {'price': o_totalprice, 'status': o_orderstatus}['price'] AS price, o_orderstatus AS status FROM orders WHERE o_totalprice > 200000")
def covered_rows(t):
    row = F.struct(c("o_totalprice").alias("price"), c("o_orderstatus").alias("status"))
    return flwor(t.orders).where(c("o_totalprice") > 200000).let(row=row).returning("o_orderkey", c("row.price").alias("price"), c("row.status").alias("status"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE list_contains(list_slice(list_transform(embedding, lambda x: x > 0.3), 1, 8), true)")
def set_membership_count(t):
    return t.embeddings.where(S.some(F.slice("embedding", 1, 8), lambda x: x.cast("double") > 0.3)).agg(F.count("*").alias("n"))


@query()
def approx_distinct(t):
    return t.lineitem.agg(F.approx_count_distinct("l_partkey").alias("n"))


@query()
def value_histogram(t):
    return t.lineitem.select(F.explode(F.expr("histogram_numeric(l_quantity, 16)")).alias("b")).select(c("b.x").alias("x"), c("b.y").alias("y"))


# --- sorting, limits ----------------------------------------------------------------------------


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS INTEGER) AS ord FROM supplier")
def sort_multi(t):
    return relational.ranked(t.supplier, [c("s_nationkey"), F.desc("s_acctbal"), c("s_suppkey")]).select("s_suppkey", "ord")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS ord FROM orders")
def document_order(t):
    return relational.numbered(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", c("ord").cast("long").alias("ord"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def topk_offset(t):
    return relational.top(t.orders, [F.desc("o_totalprice"), c("o_orderkey")], 10, 5).select("o_orderkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2""")
def topk_per_group(t):
    return relational.ranked(t.orders, [F.desc("o_totalprice"), c("o_orderkey")], within=["o_custkey"]).where("ord <= 2").select("o_custkey", "o_orderkey", "ord")


@query("SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 2")
def subsequence(t):
    return flwor(t.nation).order_by("n_name").subsequence(3, 5).returning("n_name")


# --- joins --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_group(t):
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("k"), F.sum("l_quantity").alias("q"))
    j = per.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("k").alias("n"), F.round(F.sum("q"), 2).alias("qty"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_count(t):
    return t.customer.join(t.orders.select("o_custkey", "o_orderkey"), c("c_custkey") == c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey, count(p_partkey) AS n FROM customer LEFT JOIN part ON c_acctbal > 4 * p_retailprice GROUP BY 1")
def theta_join(t):
    return relational.count_greater(t.customer.select("c_custkey", "c_acctbal"), t.part, "c_acctbal", "p_retailprice", 4.0).select("c_custkey", "n")


@query("""SELECT event_id, b AS bucket FROM events JOIN (SELECT unnest(range(0, 20)) AS b) ON value >= b * 10 AND value <= b * 10 + 4""")
def band_join(t):
    ranges = t.spark.range(20).select(c("id").alias("bucket"), (c("id") * 10.0).alias("low"), (c("id") * 10.0 + 4).alias("high"))
    return relational.band_join(t.events.select("event_id", "value"), ranges, "value", "low", "high", 10.0).select("event_id", "bucket")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'")
def salted_join(t):
    a = t.orders.where(c("o_orderpriority").startswith("1")).select("o_orderkey", c("o_custkey").alias("k"))
    return relational.salted_join(a, t.customer.select(c("c_custkey").alias("k"), "c_mktsegment"), ["k"], 4).select("o_orderkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def semi_join(t):
    return t.customer.join(t.orders.where("o_totalprice > 150000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_small(t):
    return t.region.crossJoin(relational.small(t.nation)).select("r_name", "n_name")


@query("""SELECT o_orderkey, arg_max(value, ts) AS as_of_value FROM orders LEFT JOIN events ON o_custkey = user_id AND ts <= o_orderdate + INTERVAL 27 YEAR GROUP BY 1""")
def as_of_join(t):
    left = t.orders.select("o_orderkey", c("o_custkey").alias("user_id"), S.plus_months(c("o_orderdate"), 27 * 12).alias("at"))
    return temporal.as_of_join(left, t.events, ["user_id"], "at", "ts", ["value"]).select("o_orderkey", "as_of_value")


# --- set operations -----------------------------------------------------------------------------


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_nodes(t):
    return t.orders.select(c("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def intersect_nodes(t):
    return t.lineitem.select(c("l_partkey").alias("k")).intersect(t.part.where("p_size > 25").select("p_partkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_nodes(t):
    return t.customer.select(c("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT r_name AS x, 0 AS part FROM region UNION ALL SELECT n_name, 1 FROM nation")
def sequence_concat(t):
    return relational.sequence_of(t.region.select(c("r_name").alias("x")), t.nation.select(c("n_name").alias("x")))


# --- transaction time ---------------------------------------------------------------------------

_REV = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER)"
_V = f"""WITH l AS (SELECT user_id, event_type, rev, arg_max(value, ts) AS value, arg_max(event_id % 7 = 0, ts) AS gone FROM (SELECT *, {_REV} AS rev FROM events) GROUP BY ALL),
v AS (SELECT * FROM (SELECT user_id, event_type, value, rev AS rev_from, lead(rev) OVER (PARTITION BY user_id, event_type ORDER BY rev) AS rev_to, gone FROM l) WHERE NOT gone)
"""


def _changes(t) -> DataFrame:
    rev = (F.datediff(c("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    return t.events.select(*KEYS, "ts", "value", rev.alias("rev"), (c("event_id") % 7 == 0).alias("gone"))


def _versions(t) -> DataFrame:
    return temporal.versions(_changes(t), KEYS, ["value"], deleted="gone")


@query(_V + "SELECT user_id, event_type, value, rev_from, coalesce(rev_to, 0) AS rev_to FROM v")
def version_ranges(t):
    return _versions(t).withColumn("rev_to", F.coalesce("rev_to", F.lit(0)))


@query(_V + "SELECT user_id, event_type, value FROM v WHERE rev_from <= 15 AND (rev_to IS NULL OR rev_to > 15)")
def snapshot_at_rev(t):
    return temporal.at_revision(_versions(t), 15).select(*KEYS, "value")


@query("SELECT user_id, event_type, arg_max(value, ts) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2")
def snapshot_at_time(t):
    return temporal.at_time(t.events, KEYS, ["value"], F.expr("timestamp_ntz '2024-01-15 12:00:00'"))


@query(_V + "SELECT user_id, event_type, value, CAST(r AS INTEGER) AS rev FROM v JOIN (SELECT unnest(range(5, 9)) AS r) ON rev_from <= r AND (rev_to IS NULL OR rev_to > r)")
def open_revisions(t):
    return temporal.open_revisions(_versions(t), 5, 8).select(*KEYS, "value", "rev")


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS previous FROM events")
def previous_value(t):
    from pyspark.sql import Window as W

    return t.events.select("event_id", F.lag("value").over(W.partitionBy(*KEYS).orderBy("ts")).alias("previous"))


@query("SELECT event_id, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS next FROM events")
def next_value(t):
    from pyspark.sql import Window as W

    return t.events.select("event_id", F.lead("value").over(W.partitionBy(*KEYS).orderBy("ts")).alias("next"))


@query(_V + "SELECT user_id, event_type, value, 14 AS rev FROM v WHERE rev_from <= 14 AND (rev_to IS NULL OR rev_to > 14)")
def previous_version(t):
    return temporal.previous(_versions(t), 15).select(*KEYS, "value", "rev")


@query(_V + "SELECT user_id, event_type, value, 16 AS rev FROM v WHERE rev_from <= 16 AND (rev_to IS NULL OR rev_to > 16)")
def next_version(t):
    return temporal.following(_versions(t), 15).select(*KEYS, "value", "rev")


@query(_V + "SELECT user_id, event_type, value FROM v WHERE rev_from = 1")
def first_version(t):
    return temporal.at_revision(_versions(t), 1).select(*KEYS, "value")


@query(_V + "SELECT user_id, event_type, value FROM v WHERE rev_to IS NULL")
def last_version(t):
    return temporal.at_revision(_versions(t), LAST).select(*KEYS, "value")


@query(_V + "SELECT user_id, event_type, arg_min(value, rev_from) AS value, min(rev_from) AS rev_from FROM v GROUP BY 1, 2")
def first_existing(t):
    return temporal.first_existing(_versions(t), KEYS).select(*KEYS, "value", "rev_from")


@query(_V + "SELECT user_id, event_type, arg_max(value, rev_from) AS value, max(rev_from) AS rev_from FROM v GROUP BY 1, 2")
def last_existing(t):
    return temporal.last_existing(_versions(t), KEYS).select(*KEYS, "value", "rev_from")


_RUN = "SELECT user_id, event_type, value, r AS rev, CAST(count(*) OVER () AS BIGINT) AS z FROM v JOIN (SELECT CAST(unnest(range(1, 31)) AS INTEGER) AS r) ON rev_from <= r AND (rev_to IS NULL OR rev_to > r)"


@query(_V + f"""SELECT user_id, event_type, value, rev FROM (SELECT *, rev - row_number() OVER (PARTITION BY user_id, event_type ORDER BY rev) AS g,
min(rev) OVER (PARTITION BY user_id, event_type) AS m FROM ({_RUN})) WHERE g = m - 1""")
def all_times(t):
    return temporal.all_times(_versions(t), KEYS, LAST).select(*KEYS, "value", "rev")


@query(_V + f"""SELECT user_id, event_type, value, rev FROM (SELECT *, rev + row_number() OVER (PARTITION BY user_id, event_type ORDER BY rev DESC) AS g FROM ({_RUN}) WHERE rev < 15) WHERE g = 15""")
def past_versions(t):
    return temporal.past(_versions(t), KEYS, 15).select(*KEYS, "value", "rev")


@query(_V + f"""SELECT user_id, event_type, value, rev FROM (SELECT *, rev - row_number() OVER (PARTITION BY user_id, event_type ORDER BY rev) AS g FROM ({_RUN}) WHERE rev > 15) WHERE g = 15""")
def future_versions(t):
    return temporal.future(_versions(t), KEYS, 15, LAST).select(*KEYS, "value", "rev")


_K = "json_extract_string(props, '$.k')"


@query(f"SELECT event_id FROM (SELECT event_id, {_K} AS k, lag({_K}) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)) WHERE r = 1 OR k IS DISTINCT FROM p")
def item_history(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    return temporal.changed(e, KEYS, "ts", "k").select("event_id")


@query(f"""SELECT user_id, event_type, k, min(ts) AS run_start, max(ts) AS run_end, count(*) AS run_length FROM (
SELECT *, sum(CASE WHEN r = 1 OR k IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS g FROM (
SELECT user_id, event_type, ts, {_K} AS k, lag({_K}) OVER w AS p, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))) GROUP BY user_id, event_type, g, k""")
def value_runs(t):
    return temporal.value_runs(t.events.withColumn("k", F.get_json_object("props", "$.k")), KEYS, "ts", "k")


@query(_V + "SELECT DISTINCT user_id, event_type FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND b.rev_to IS NULL)")
def is_deleted(t):
    return temporal.is_deleted(_versions(t), KEYS, LAST)


@query(f"SELECT {_REV} AS rev, min(ts) AS commit_ts, count(*) AS changes FROM events GROUP BY 1")
def revision_history(t):
    return _changes(t).groupBy("rev").agg(F.min("ts").alias("commit_ts"), F.count("*").alias("changes"))


@query(f"SELECT max(rev) AS rev FROM (SELECT {_REV} AS rev, min(ts) AS commit_ts FROM events GROUP BY 1) WHERE commit_ts <= TIMESTAMP '2024-01-20 08:00:00'")
def revision_at_instant(t):
    return temporal.revision_at(revision_history(t), F.expr("timestamp_ntz '2024-01-20 08:00:00'"))


# --- valid time, bitemporal ----------------------------------------------------------------------

_VALID = """(SELECT o_orderkey, o_orderdate AS valid_from, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END AS valid_to,
CAST(o_orderkey % 10 AS INTEGER) + 1 AS rev_from, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 10 AS INTEGER) + 6 END AS rev_to FROM orders)"""


def _valid(t) -> DataFrame:
    k = c("o_orderkey")
    return t.orders.select(
        k, c("o_orderdate").alias("valid_from"), F.when(k % 5 != 0, c("o_orderdate") + F.expr("INTERVAL 90 DAY")).alias("valid_to"),
        ((k % 10).cast("int") + 1).alias("rev_from"), F.when(k % 3 == 0, (k % 10).cast("int") + 6).alias("rev_to"),
    )


@query(f"SELECT o_orderkey FROM {_VALID} WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1996-06-01')")
def valid_at(t):
    return temporal.valid_at(_valid(t), F.expr("timestamp_ntz '1996-06-01'")).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_VALID} WHERE rev_from <= 7 AND (rev_to IS NULL OR rev_to > 7) AND valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1996-06-01')")
def bitemporal(t):
    return temporal.bitemporal(_valid(t), 7, F.expr("timestamp_ntz '1996-06-01'")).select("o_orderkey")


@query(f"SELECT o_orderkey, valid_from, valid_to FROM {_VALID}")
def valid_bounds(t):
    return _valid(t).select("o_orderkey", "valid_from", "valid_to")


# --- differences ----------------------------------------------------------------------------------

_D = _V + """, a AS (SELECT * FROM v WHERE rev_from <= 10 AND (rev_to IS NULL OR rev_to > 10)), b AS (SELECT * FROM v WHERE rev_from <= 20 AND (rev_to IS NULL OR rev_to > 20)),
d AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
CASE WHEN a.user_id IS NULL THEN 'inserted' WHEN b.user_id IS NULL THEN 'deleted' ELSE 'updated' END AS op, a.value AS old_value, b.value AS new_value
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.value IS DISTINCT FROM b.value)
"""


@query(_D + "SELECT * FROM d")
def diff_revs(t):
    return diff.diff_revisions(_versions(t), 10, 20, KEYS, ["value"])


@query(_D + "SELECT op, count(*) AS n FROM d GROUP BY 1")
def diff_summary(t):
    return diff.summarise(diff_revs(t))


@query(_D.replace("<= 10", "<= 19").replace("> 10", "> 19") + "SELECT * FROM d")
def diff_adjacent(t):
    return diff.diff_adjacent(_versions(t), 20, KEYS, ["value"])


@query()
def diff_json(t):
    return diff.to_json(diff_revs(t), KEYS, "driver", "events", 10, 20)


# --- JSON -----------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_deref(t):
    return t.events.select("event_id", S.field(S.parse(c("props")), "$.k", "bigint").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.nope') AS missing FROM events")
def json_missing(t):
    return t.events.select("event_id", S.field(S.parse(c("props")), "$.nope").alias("missing"))


@query("SELECT event_id, json_keys(props)[1] AS key, len(json_keys(props)) AS n FROM events")
def json_object_keys(t):
    return t.events.select("event_id", S.at(S.object_keys(c("props")), 0).alias("key"), F.size(S.object_keys(c("props"))).cast("long").alias("n"))


@query("""SELECT event_id AS doc, 0::BIGINT AS node_key, 'object' AS kind, '$' AS path, 0 AS level, NULL::DOUBLE AS v_num FROM events
UNION ALL SELECT event_id, 1, 'number', '$.k', 1, CAST(json_extract(props, '$.k') AS DOUBLE) FROM events""")
def json_shred(t):
    return shred.shred(t.events, "event_id", "props", "json").select("doc", "node_key", "kind", "path", "level", "v_num")


@query("SELECT event_id AS doc, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def json_round_trip(t):
    return shred.serialize_json(shred.shred(t.events, "event_id", "props", "json"))


@query("SELECT '$' AS path, 'object' AS kind, count(*) AS refs FROM events UNION ALL SELECT '$.k', 'number', count(*) FROM events")
def path_summary(t):
    return axes.path_summary(shred.shred(t.events, "event_id", "props", "json")).select("path", "kind", "refs")


@query("""SELECT vec_id, round(embedding[1], 5) AS first, round(embedding[64], 5) AS last, len(embedding[2:4]) AS n, round(list_sum(embedding[2:4]), 4) AS s FROM embeddings""")
def array_index_slice(t):
    e = c("embedding")
    part = S.cut(e, 1, 4)
    return t.embeddings.select(
        "vec_id", F.round(S.at(e, 0), 5).alias("first"), F.round(S.at(e, -1), 5).alias("last"), F.size(part).cast("long").alias("n"),
        F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("s"),
    )


@query("SELECT user_id, bool_or(event_type = 'purchase') AS has, bool_and(event_type <> 'purchase') AS lacks, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def array_membership(t):
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return kinds.select("user_id", S.general_eq(c("k"), F.lit("purchase")).alias("has"), S.every(c("k"), lambda x: x != "purchase").alias("lacks"), F.size("k").cast("long").alias("kinds"))


@query("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def unbox_array(t):
    return flwor(t.part.withColumn("ws", S.tokenize(c("p_name"), " "))).for_("w", "ws").group_by("w").aggregate(n=F.count("*")).returning("w", "n")


@query("SELECT p_partkey, i AS at, string_split(p_name, ' ')[i] AS w FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)")
def for_positional(t):
    return flwor(t.part.withColumn("ws", S.tokenize(c("p_name"), " "))).for_("w", "ws", at="at").returning("p_partkey", c("at").cast("long").alias("at"), "w")


# --- functions --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, substring(p_name, 1, 2) AS sub, upper(p_brand) AS up, contains(p_type, 'A') AS has, starts_with(p_brand, 'B') AS starts,
replace(p_name, ' ', '_') AS rep, translate(p_name, 'ae', 'xy') AS tr, length(p_name) AS len,
CASE WHEN instr(p_brand, '#') > 0 THEN split_part(p_brand, '#', 1) ELSE '' END AS before, p_name || '|' || p_brand AS both FROM part""")
def string_funcs(t):
    n, b = c("p_name"), c("p_brand")
    return t.part.select(
        "p_partkey", S.substring(n, 0, 3).alias("sub"), F.upper(b).alias("up"), c("p_type").contains("A").alias("has"), b.startswith("B").alias("starts"),
        F.regexp_replace(n, " ", "_").alias("rep"), F.translate(n, "ae", "xy").alias("tr"), F.char_length(n).cast("long").alias("len"),
        S.substring_before(b, F.lit("#")).alias("before"), S.concat(n, F.lit("|"), b).alias("both"),
    )


@query("""SELECT s_suppkey, floor(s_acctbal + 0.5)::BIGINT AS up, CAST(trunc(s_acctbal / 7) AS BIGINT) AS q, s_suppkey % 7 AS m, abs(s_acctbal) AS a,
ceil(s_acctbal)::BIGINT AS ce, floor(s_acctbal)::BIGINT AS fl FROM supplier""")
def numeric_funcs(t):
    x = c("s_acctbal")
    return t.supplier.select("s_suppkey", S.round_up_ties(x).cast("long").alias("up"), S.idiv(x, F.lit(7)).alias("q"), S.mod(c("s_suppkey"), F.lit(7)).alias("m"), F.abs(x).alias("a"), F.ceil(x).alias("ce"), F.floor(x).alias("fl"))


@query("""SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, ts + INTERVAL 3 MONTH AS later, ts + INTERVAL 90 SECOND AS soon,
date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS secs FROM events""")
def date_funcs(t):
    p = S.parts_of(c("ts"))
    secs = S.seconds_between(F.expr("timestamp_ntz '2024-01-01'"), F.date_trunc("second", c("ts"))).cast("long")
    return t.events.select("event_id", *[p[k].cast("long").alias(a) for k, a in (("year", "y"), ("month", "mo"), ("day", "d"), ("hours", "h"))], S.plus_months(c("ts"), 3).alias("later"), S.plus_seconds(c("ts"), 90).alias("soon"), secs.alias("secs"))


@query("""SELECT user_id, len(a) AS n, a[1] AS first, array_to_string(a, ',') AS joined, array_to_string(list_reverse(a), ',') AS back, array_to_string(a[2:], ',') AS rest
FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY 1)""")
def sequence_funcs(t):
    a = c("a")
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a")).select(
        "user_id", F.size(a).cast("long").alias("n"), S.head(a).alias("first"), S.string_join(a, ",").alias("joined"), S.string_join(F.reverse(a), ",").alias("back"), S.string_join(S.tail(a), ",").alias("rest"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS class, TRY_CAST(replace(c_name, 'Customer#', '') AS BIGINT) AS num FROM customer")
def conditionals(t):
    b = c("c_acctbal")
    return t.customer.select("c_custkey", F.when(b < 0, "debt").when(b < 1000, "low").otherwise("ok").alias("class"), F.regexp_replace("c_name", "Customer#", "").try_cast("bigint").alias("num"))


# --- trees ------------------------------------------------------------------------------------------

_TREE = """WITH n AS (SELECT r_regionkey AS r, NULL AS nk, NULL::BIGINT AS s, r_name AS name, 1 AS level FROM region
UNION ALL SELECT n_regionkey, n_nationkey, NULL, n_name, 2 FROM nation
UNION ALL SELECT n_regionkey, n_nationkey, s_suppkey, s_name, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tree AS (SELECT *, row_number() OVER (ORDER BY r, nk NULLS FIRST, s NULLS FIRST) AS pre, row_number() OVER (ORDER BY r, nk NULLS LAST, s NULLS LAST) AS post FROM n)
"""


def _tree(t) -> DataFrame:
    """region > nation > supplier as a node table of one document."""
    none = F.lit(None)
    reg = t.region.select(c("r_regionkey").alias("r"), none.cast("int").alias("nk"), none.cast("long").alias("s"), c("r_name").alias("name"), F.lit(1).alias("level"))
    nat = t.nation.select("n_regionkey", "n_nationkey", none.cast("long"), "n_name", F.lit(2))
    sup = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select("n_regionkey", "n_nationkey", "s_suppkey", "s_name", F.lit(3))
    n = reg.union(nat).union(sup)
    n = relational.ranked(n, [c("r"), F.asc_nulls_first("nk"), F.asc_nulls_first("s")], "pre")
    n = relational.ranked(n, [c("r"), F.asc_nulls_last("nk"), F.asc_nulls_last("s")], "post")
    up = n.where("level < 3").select(c("r").alias("ur"), c("nk").alias("un"), c("level").alias("ul"), c("pre").alias("parent_key"))
    n = n.join(up, (c("r") == c("ur")) & (c("ul") == c("level") - 1) & ((c("ul") == 1) | (c("nk") == c("un"))), "left")
    n = relational.ranked(n, [c("pre")], "pos", ["parent_key"]).withColumn("pos", c("pos") - 1)
    return n.select(F.lit(0).alias("doc"), c("pre").alias("node_key"), "parent_key", F.lit("element").alias("kind"), "name", F.element_at(F.array(F.lit("/region"), F.lit("/region/nation"), F.lit("/region/nation/supplier")), c("level")).alias("path"), "level", "pos", "pre", "post")


def _named(df: DataFrame, nodes: DataFrame) -> DataFrame:
    who = nodes.select(c("node_key").alias("from_key"), c("name").alias("of"))
    return df.select("from_key", "name").join(who, "from_key").select("of", "name")


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre > a.pre AND b.post < a.post")
def axes_desc(t):
    n = _tree(t)
    return _named(axes.descendant(n, n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre < a.pre AND b.post > a.post")
def axes_ancestor(t):
    n = _tree(t)
    return _named(axes.ancestor(n, n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre > a.pre AND b.post < a.post AND b.level = a.level + 1")
def axes_child(t):
    n = _tree(t)
    return _named(axes.child(n, n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre < a.pre AND b.post > a.post AND b.level = a.level - 1")
def axes_parent(t):
    n = _tree(t)
    return _named(axes.parent(n, n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre > a.pre AND b.post > a.post WHERE a.level = 2")
def axes_following(t):
    n = _tree(t)
    return _named(axes.following(n.where("level = 2"), n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre < a.pre AND b.post < a.post WHERE a.level = 2")
def axes_preceding(t):
    n = _tree(t)
    return _named(axes.preceding(n.where("level = 2"), n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON a.level = 2 AND b.level = 2 AND a.r = b.r AND b.pre > a.pre")
def axes_following_sibling(t):
    n = _tree(t)
    return _named(axes.following_sibling(n.where("level = 2"), n), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON a.level = 2 AND b.level = 2 AND a.r = b.r AND b.pre < a.pre")
def axes_preceding_sibling(t):
    n = _tree(t)
    return _named(axes.preceding_sibling(n.where("level = 2"), n), n)


@query(_TREE + "SELECT name, CAST(row_number() OVER (ORDER BY level, pre) AS INTEGER) AS ord FROM tree")
def level_order(t):
    return axes.level_order(_tree(t)).select("name", "ord")


@query(_TREE + "SELECT name, CAST(row_number() OVER (ORDER BY post) AS INTEGER) AS ord FROM tree")
def post_order(t):
    return axes.post_order(_tree(t)).select("name", "ord")


@query(_TREE + "SELECT a.name, CAST(count(b.name) AS BIGINT) AS children FROM tree a LEFT JOIN tree b ON b.pre > a.pre AND b.post < a.post AND b.level = a.level + 1 GROUP BY a.name, a.pre")
def child_count(t):
    return axes.child_count(_tree(t)).select("name", "children")


@query(_TREE + "SELECT a.name FROM tree a WHERE level = 2 AND EXISTS (SELECT 1 FROM tree b WHERE b.pre > a.pre AND b.post < a.post AND b.name LIKE '%1')")
def predicate_filter(t):
    n = _tree(t)
    hits = axes.child(n.where("level = 2"), n).where(c("name").endswith("1"))
    return axes.having(n.where("level = 2"), hits).select("name")


@query(_TREE + "SELECT path, count(*) AS n FROM (SELECT CASE level WHEN 1 THEN '/region' WHEN 2 THEN '/region/nation' ELSE '/region/nation/supplier' END AS path FROM tree) GROUP BY 1")
def tree_paths(t):
    return _tree(t).groupBy("path").agg(F.count("*").alias("n"))


@query()
def html_shred(t):
    return shred.shred(t.pages, "page_id", "html", "html").drop("v_bool")


@query()
def html_kinds(t):
    return shred.shred(t.pages, "page_id", "html", "html").groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages WHERE contains(html, '<li>')")
def html_list_items(t):
    n = shred.shred(t.pages, "page_id", "html", "html")
    return n.where("kind = 'element' AND name = 'li'").groupBy(c("doc").alias("page_id")).agg(F.count("*").alias("items"))


@query()
def subtree_hashes(t):
    n = shred.shred(t.events, "event_id", "props", "json")
    return axes.merkle(n, ["v_str", "v_num"], 1).select("doc", "node_key", "hash")


# --- value indexes ------------------------------------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_retailprice >= 1000 AND p_retailprice < 1200")
def cas_range(t):
    return store.scan_index_range(t.part, "p_retailprice", 1000, 1200, True, False).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 40")
def cas_greater(t):
    return store.scan_index(t.part, "p_size", 40, "GREATER").select("p_partkey")


@query("SELECT name, kind FROM (VALUES ('k', 'number')) v(name, kind)")
def name_index(t):
    n = shred.shred(t.events, "event_id", "props", "json")
    return axes.with_name(n, "k").select("name", "kind").distinct()


# --- vectors --------------------------------------------------------------------------------------------

_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _knn(t, metric: str) -> DataFrame:
    first = t.embeddings.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return vector.search(t.embeddings, list(first), 10, metric).select("vec_id", F.round("distance", 5).alias("distance"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) + 0.0 AS distance FROM embeddings, {_Q} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def knn_cosine(t):
    return _knn(t, "cosine").withColumn("distance", c("distance") + 0.0)


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 5) AS distance FROM embeddings, {_Q} ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def knn_l2(t):
    return _knn(t, "l2")


@query(f"SELECT vec_id, round(1 - list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 5) + 0.0 AS distance FROM embeddings, {_Q} ORDER BY 1 - list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), vec_id LIMIT 10")
def knn_ip(t):
    return _knn(t, "ip").withColumn("distance", c("distance") + 0.0)


@query("""SELECT query_id, id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS INTEGER) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_batch(t):
    e = t.embeddings
    return vector.knn(e, e.where("vec_id % 20 = 0"), 5, "l2").select("query_id", "id", "rank")


@query()
def ann_search(t):
    """Approximate neighbours of every vector whose id is divisible by 20, from an index of all vectors."""
    e = t.embeddings
    return vector.ListIndex(e).search(e.where("vec_id % 20 = 0"), 10)


@query()
def hyperplane_buckets(t):
    return vector.hyperplane_index(t.embeddings, 64).select("vec_id", "buckets")


# --- flagship -------------------------------------------------------------------------------------------


@query(_V + "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM v WHERE rev_from <= 15 AND (rev_to IS NULL OR rev_to > 15) GROUP BY 1")
def snapshot_profile(t):
    now = temporal.at_revision(_versions(t), 15)
    return now.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy("event_type")


# --- text front end ---------------------------------------------------------------------------------------


def _text(t, text: str, made: dict | None = None, **options) -> DataFrame:
    from . import jsoniq

    made = made or {}
    return jsoniq.run(t.spark, {n: made[n] if n in made else getattr(t, n) for n in re.findall(r'collection\("(\w+)"\)', text)}, text, **options)


@query("SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
def text_group(t):
    q = """for $l in collection("lineitem") where $l.l_discount gt 0.02 group by $f := $l.l_returnflag
           return {"flag": $f, "n": count($l), "qty": sum($l.l_quantity)}"""
    return _text(t, q).withColumn("qty", F.round("qty", 2))


@query("SELECT o_orderkey AS o, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def text_join(t):
    return _text(t, """for $o in collection("orders"), $c in collection("customer") where $o.o_custkey = $c.c_custkey and $o.o_totalprice gt 100000
                       return {"o": $o.o_orderkey, "c": $c.c_name}""")  # fmt: skip


@query("SELECT count(*) AS count FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.5)) > 0")
def text_quantified(t):
    return _text(t, 'count(for $e in collection("embeddings") where some $x in $e.embedding satisfies $x gt 0.5 return $e.vec_id)')


@query("SELECT s_suppkey AS value FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5 OFFSET 1")
def text_subsequence(t):
    return _text(t, 'subsequence(for $s in collection("supplier") order by $s.s_acctbal descending, $s.s_suppkey return $s.s_suppkey, 2, 5)')


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_discount > 0.01 GROUP BY 1 HAVING count(*) > 1400 AND avg(l_quantity) > 1")
def text_having(t):
    return _text(t, """for $l in collection("lineitem") where $l.l_discount gt 0.01 group by $f := $l.l_returnflag let $n := count($l)
                       where $n gt 1400 and avg($l.l_quantity) gt 1 order by $n descending return {"flag": $f, "n": $n}""")  # fmt: skip


@query("SELECT vec_id AS id, len(list_filter(embedding, lambda x: x::DOUBLE > 0.1::DOUBLE)) AS n FROM embeddings WHERE label < 3")
def text_predicate(t):
    return _text(t, 'for $e in collection("embeddings")[?$$.label lt 3] return {"id": $e.vec_id, "n": size($e.embedding[?$$ gt 0.1])}').withColumn("n", c("n").cast("long"))


def _nested(t) -> DataFrame:
    """region documents with members called name at several depths."""
    item = lambda x: F.struct(F.concat("r_name", F.lit(x)).alias("name"), F.lit(len(x)).alias("size"))
    return t.region.select(c("r_regionkey").alias("k"), F.struct(c("r_name").alias("name"), F.array(item("1"), item("22")).alias("items")).alias("info"))


@query("SELECT r_regionkey AS k, [r_name, r_name || '1', r_name || '22'] AS names, [1, 2] AS sizes, 0 AS nothing FROM region")
def text_descendant(t):
    out = _text(t, 'for $d in collection("nested") return {"k": $d.k, "names": $d=>>name, "sizes": $d=>>size, "nothing": size($d=>>none)}', {"nested": _nested(t)})
    return out


@query("SELECT r_regionkey AS k, [r_name || '1', r_name || '22'] AS names, i AS item, r_name || CASE i WHEN 1 THEN '1' ELSE '22' END AS name FROM region, (VALUES (1), (2)) v(i)")
def text_unbox(t):
    return _text(t, 'for $d in collection("nested") for $i at $p in $d.info.items[] return {"k": $d.k, "names": $d.info.items[].name, "item": $p, "name": $i.name}', {"nested": _nested(t)})


@query("SELECT o_custkey AS c, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def text_nested(t):
    q = """for $x in (for $o in collection("orders") where $o.o_totalprice gt 100000 return {"c": $o.o_custkey, "p": $o.o_totalprice})
           group by $c := $x.c return {"c": $c, "n": count($x), "most": max($x.p)}"""
    return _text(t, q).withColumn("most", F.round("most", 2))


@query("SELECT vec_id AS id, len(list_filter(embedding, lambda x: x::DOUBLE * 2 > 0.3::DOUBLE)) AS n FROM embeddings")
def text_array_flwor(t):
    q = 'for $e in collection("embeddings") return {"id": $e.vec_id, "n": size(for $x in $e.embedding let $y := number($x) * 2 where $y gt 0.3 return $y)}'
    return _text(t, q).withColumn("n", c("n").cast("long"))


@query("SELECT l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount)), 1) AS net, max(length(l_linestatus)) AS m FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def text_functions(t):
    q = """declare variable $low external; declare function local:net($p, $d) { $p * (1 - $d) };
           for $l in collection("lineitem") where $l.l_discount gt $low group by $f := $l.l_returnflag
           return {"flag": $f, "net": sum(local:net($l.l_extendedprice, $l.l_discount)), "m": max(my:length($l.l_linestatus))}"""
    return _text(t, q, variables={"low": 0.05}, functions={"my:length": F.length}).withColumns({"net": F.round("net", 1), "m": c("m").cast("long")})


@query("SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, translate(o_orderpriority, '12345', 'abcde') AS p FROM orders")
def text_switch(t):
    return _text(t, """for $o in collection("orders") return {"k": $o.o_orderkey, "state": switch ($o.o_orderstatus) case "F" return "done" case "O" return "open" default return "other",
                       "p": translate($o.o_orderpriority, "12345", "abcde")}""")  # fmt: skip


# --- more tree operators ----------------------------------------------------------------------------------


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre >= a.pre AND b.post <= a.post WHERE a.level = 1")
def axes_descendant_or_self(t):
    n = _tree(t)
    return _named(axes.descendant(n.where("level = 1"), n, True), n)


@query(_TREE + "SELECT a.name AS of, b.name FROM tree a JOIN tree b ON b.pre <= a.pre AND b.post >= a.post WHERE a.level = 3")
def axes_ancestor_or_self(t):
    n = _tree(t)
    return _named(axes.ancestor(n.where("level = 3"), n, True), n)


@query(_TREE + "SELECT name FROM tree WHERE level = 1 OR name LIKE '%1'")
def tree_union(t):
    n = _tree(t)
    return axes.union(n.where("level = 1"), n.where(c("name").endswith("1"))).select("name")


@query(_TREE + "SELECT name FROM tree WHERE level = 2 AND name LIKE '%1'")
def tree_intersect(t):
    n = _tree(t)
    return axes.intersect(n.where("level = 2"), n.where(c("name").endswith("1"))).select("name")


@query(_TREE + "SELECT name FROM tree WHERE level = 2 AND name NOT LIKE '%1'")
def tree_except(t):
    n = _tree(t)
    return axes.except_(n.where("level = 2"), n.where(c("name").endswith("1"))).select("name")


@query(_TREE + "SELECT name FROM (SELECT name, level, row_number() OVER (PARTITION BY r, CASE WHEN level > 2 THEN nk END, level ORDER BY pre) AS i FROM tree) WHERE level = 1 OR (level = 2 AND i <= 2)")
def tree_limited(t):
    n = _tree(t)
    return axes.limited(n.where("level = 1"), max_level=1).union(axes.limited(n.where("level = 2"), 2, 2)).select("name")


@query(_TREE + "SELECT a.name, CAST(count(b.name) AS BIGINT) AS descendants FROM tree a LEFT JOIN tree b ON b.pre > a.pre AND b.post < a.post GROUP BY a.name, a.pre")
def descendant_count(t):
    n = _tree(t)
    return axes.descendant_count(n.withColumn("level", c("level") - 1)).select("name", c("descendants").cast("long").alias("descendants"))


@query(_TREE + "SELECT name, level FROM tree WHERE pre = 3")
def select_item(t):
    return _tree(t).where("node_key = 3").select("name", "level")


@query()
def unkeyed_diff(t):
    """Customers' order priorities of two years, matched without keys."""
    o = t.orders.select(c("o_custkey").alias("cust"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("t"), F.year("o_orderdate").alias("y"))
    return diff.match_unkeyed(o.where("y = 1996"), o.where("y = 1997"), ["cust"], "t")


@query()
def versioned_store(t):
    """Write customers as a resource, commit changes, and read the difference of two revisions back."""
    db = store.Database(t.spark, shared.new_path(t.spark, "store"))
    r = db.create("customer", t.customer, ["c_custkey"], "loader")
    r.set(c("c_mktsegment") == "BUILDING", c_acctbal=0.0).delete(c("c_acctbal") < 0)
    r.commit("settle", "clerk")
    return r.diff(1, 2)


functions_catalog.register(query)
updates_catalog.register(query)
