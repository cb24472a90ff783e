"""The pipeline's stages, each against the brute force of its operator, on its own input."""

import pytest

import corpus_pipeline as P
from tempora.llm import line_dedup, ngram_join


@pytest.fixture(scope="module")
def tables(spark, sf):
    out = [P.table(spark, sf, "documents")]
    for name, stage in P.STAGES:
        out.append(P.materialize(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_columns(tables):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "decontaminate", "packing"]
    for t in tables[1:-1]:
        assert t.columns == tables[0].columns
    assert all(b.count() <= a.count() for a, b in zip(tables[:-2], tables[1:-1], strict=True))


def test_line_stage(tables):
    before, after = texts(tables[1]), texts(tables[2])
    gone = line_dedup.brute_force(before)
    for i, t in before.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert after.get(i, "") == left or (i not in after and not any(ch.isalnum() for ch in left))


def test_join_stage(tables):
    before, after = texts(tables[2]), texts(tables[3])
    assert set(after) == {c for c, _ in ngram_join.brute_force(before).values()}


def test_leak_stage(tables, spark, sf):
    items = [r["text"] for r in P.table(spark, sf, "benchmark").collect()]
    before, after = texts(tables[3]), texts(tables[4])
    assert set(before) - set(after) >= {i for i, t in before.items() if any(x in t for x in items)}
    assert all(not any(x in t for x in items) for t in after.values())


def test_packing_stage(tables, spark, sf):
    assert {r["doc_id"] for r in tables[5].collect()} == set(texts(tables[4]))
    assert P.run(spark, sf).columns == tables[5].columns


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_and_empty_tables(spark, docs_of, awkward, tmp_path, empty):
    """Nulls, empties, one huge text, repeated rows, null ids and clashing columns go through all stages; so does nothing at all."""
    d = docs_of(awkward)
    at = str(tmp_path / "sf")
    (d.limit(0) if empty else d).write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    (labels.limit(0) if empty else labels).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = P.run(spark, at)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r["doc_id"] for r in got.collect()}
    assert ids == set() if empty else {4, 5, 7, 8, 9, 10} <= ids and 6 not in ids
