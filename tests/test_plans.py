"""Plans: what reaches the scan, what is broadcast, what shuffles."""

from pyspark.sql import functions as F

from tempora.operators import relational, vector
from tempora.plans import catalog
from tempora.plans.flwor import explain, flwor


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = explain(catalog.QUERIES["filter_count"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), GreaterThan(l_quantity,25.0), EqualTo(l_returnflag,R)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_top_k_does_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in explain(catalog.QUERIES["knn_l2"](spark, sf))


def test_theta_join_has_no_product(spark, sf):
    plan = explain(catalog.QUERIES["theta_join"](spark, sf))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flwor(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, xs array<string>")
    assert sorted(map(tuple, flwor(df).for_("x", "xs", at="p").returning("id", "p", "x").collect())) == [(1, 1, "a"), (1, 2, "b")]
    assert flwor(df).for_("x", "xs", allowing_empty=True).returning("id").count() == 4
    assert [r[0] for r in flwor(df).order_by(F.desc("id")).subsequence(2, 5).returning("id").collect()] == [2, 1]
    assert flwor(df).where(F.col("id") > F.lit(None)).returning("id").count() == 0


def test_salted_and_band_joins(spark):
    a = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    b = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    assert relational.salted_join(a, b, ["k"], 5).count() == a.join(b, "k").count()
    p = spark.range(100).select((F.col("id") / 3).alias("x"))
    r = spark.createDataFrame([(1.0, 4.0), (3.5, 20.0)], "low double, high double")
    assert relational.band_join(p, r, "x", "low", "high", 2.0).count() == p.join(r, (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).count()


def test_theta_count_at_all_magnitudes(spark):
    xs = [-1e6, -3.0, -2.0, -0.5, -1e-5, 0.0, 1e-5, 0.5, 0.75, 2.0, 2.0, 1e6, None]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    right = spark.createDataFrame([(x,) for x in xs], "y double")
    got = {r["id"]: r["n"] for r in relational.count_greater(left, right, "x", "y", 2.0).collect()}
    assert got == {i: sum(x is not None and y is not None and x > 2 * y for y in xs) for i, x in enumerate(xs)}


def test_numbered_is_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] + 1 == r["ord"] for r in relational.numbered(df, ["x"]).collect())


def test_batch_knn_is_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((60, 4))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in vector.knn(df, df.where("vec_id < 3"), 4, "cosine").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    x32 = x.astype(np.float32).astype(float)
    for q in range(3):
        d = 1 - x32 @ x32[q] / np.linalg.norm(x32, axis=1) / np.linalg.norm(x32[q])
        assert [i for _, i in sorted(got[q])] == np.argsort(d, kind="stable")[:4].tolist()


def test_batch_knn_takes_any_number_of_queries(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((90, 4))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, vector.knn(df, df, 3).select("query_id", "id", "rank").collect()))
    monkeypatch.setattr(vector, "MOST_QUERIES", 40)
    assert sorted(map(tuple, vector.knn(df, df, 3).select("query_id", "id", "rank").collect())) == want and len(want) == 270


def test_batch_knn_is_bounded_in_memory_and_dealt_to_all_cores(spark):
    """A batch of 10,000 vectors by 4,096 queries, over several blocks of both, in memory that does not depend on either."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (10_000, 8)).astype(float)  # with many ties
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * (b - a) + 1, 8), pa.int32()), pa.array(x[a:b].ravel()))], names=["id", "vec"])
    batches = [batch(0, 9_000), batch(9_000, 10_000)]
    for metric in vector.DISTANCES:
        shared = SimpleNamespace(value=(np.arange(4096) + 7, x[:4096] + 0.25))
        tracemalloc.start()
        got = pa.Table.from_batches(list(vector._searched(shared, 5, metric)(iter(batches))))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20
        ids, d = got["id"].to_numpy().reshape(4096, 5), got["distance"].to_numpy().reshape(4096, 5)
        for q in range(0, 4096, 97):
            want = vector.distances(x, np.tile(x[q] + 0.25, (len(x), 1)), metric)
            order = np.lexsort((np.arange(len(x)), want))[:5]
            assert ids[q].tolist() == order.tolist() and np.array_equal(d[q], want[order])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x[:300])], "vec_id long, embedding array<double>").coalesce(1)
    assert vector._nearest(df, df.limit(3).collect(), 5, "l2", "vec_id", "embedding").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_list_index_recall_and_updates(spark, sf):
    from tempora.operators import vector

    e = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0")
    for metric in ("l2", "cosine"):
        exact = {(r["query_id"], r["id"]) for r in vector.knn(e, queries, 10, metric).collect()}
        index = vector.ListIndex(e, metric)
        got = index.search(queries, 10).collect()
        assert len(got) == len(exact)
        recall = len(exact & {(r["query_id"], r["id"]) for r in got}) / len(exact)
        print(metric, recall)
        assert recall >= 0.9
        assert {(r["query_id"], r["id"]) for r in index.search(queries, 10, len(index.centres)).collect()} == exact
    index.delete(queries)
    assert index.search(queries, 3).where("id % 20 = 0").count() == 0
    index.insert(queries)
    assert index.search(queries, 1).where("id = query_id").count() >= 0.9 * queries.count()
    assert index.search(queries.limit(0), 3).count() == 0


def test_top_k_against_sorting():
    import numpy as np

    from tempora.operators import vector

    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (300, 5)).astype(float)
    q, keys = x[:40] + 0.0, rng.permutation(300)
    for metric in ("l2", "cosine", "ip"):
        for k in (1, 5, 299, 400):
            col, got, d = vector.top_k(keys, x[1:], q[1:], k, metric) if metric != "cosine" else vector.top_k(keys, x + 3, q + 3, k, metric)
            a, b, ids = (x[1:], q[1:], keys) if metric != "cosine" else (x + 3, q + 3, keys)
            for j in range(len(b)):
                all_d = vector.distances(a, np.repeat(b[j : j + 1], len(a), 0), metric)
                want = [int(ids[i]) for i in sorted(range(len(a)), key=lambda i: (all_d[i], ids[i]))[:k]]
                assert got[col == j].tolist() == want
