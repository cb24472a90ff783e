"""opN queries: SQL in DuckDB where there is some, brute force elsewhere."""

import zlib

import numpy as np
import pytest
from compare import assert_same

from tempora.llm import chat_format, line_dedup, ngram_join, packing, queries, secret_scan


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: queries.queries()[name](spark, sf).toPandas()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(run, duck, name):
    assert_same(run(name), duck.execute(queries.SQL[name]).fetchdf())


def test_op2_scores_every_document(run, sample):
    r = run("op2_lm_scoring")
    assert set(r.doc_id) == set(sample) and (r.log_likelihood <= 0).all()


def test_op4_matches_the_patterns(run, sample):
    want = dict(zip(sample, secret_scan.brute_force(list(sample.values())), strict=True))
    r = run("op4_secret_scan")
    assert {x.doc_id: (x.n_assign, x.n_access, x.n_hex, x.base_sha256) for x in r.itertuples()} == want


def test_op5_matches_all_pairs(run, sample):
    r = run("op5_line_dedup")
    gone = line_dedup.brute_force(sample)
    for x in r.itertuples():
        lines = sample[x.doc_id].split("\n")
        drop = {k for i, k in gone if i == x.doc_id}
        assert x.text == "\n".join(t for k, t in enumerate(lines) if k not in drop)
        assert (x.n_lines, x.n_removed) == (len(lines), len(drop))


def test_op6_finds_the_planted_items(run, sample, spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(i, b["item_id"]) for i, t in sample.items() for b in items if b["text"] in t}
    r = run("op6_decontaminate")
    assert set(zip(r.doc_id, r.item_id, strict=True)) == want


def test_op7_round_trip(run, sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = run("op7_best_fit_packing")
    for i, g in r.groupby("doc_id"):
        ids = np.array([*tok.encode(sample[i], add_special_tokens=False).ids, 1], "<u4")
        got = sorted(zip(g.piece, g.start, g.length, g.ids_crc32, strict=True))
        assert got == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for _, g in r.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= packing.CAPACITY
    assert r.sequence_id.nunique() <= -(-r.length.sum() // packing.CAPACITY) + 1


def test_op8_matches_all_pairs(run, sample):
    r = run("op8_ngram_join")
    assert {x.doc_id: (x.class_id, x.n_links) for x in r.itertuples()} == ngram_join.brute_force(sample)


def test_op9_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table has 8 rejected labels to learn from
    r = queries.queries()["op9_quality_knn"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = r[r.held_out]
    assert ((r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)) == r.held_out).all()
    assert (held.predicted == held.quality).mean() >= 0.95


def test_op10_links_hold(run, spark, sf):
    r = run("op10_warc_derivatives")
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert len(r) == 2 * n and r.record_id.is_unique
    assert (r.groupby("page_id").refers_to.nunique() == 1).all()


def test_chat_round_trip_of_control_strings():
    for text in ("<|im_end|>", "<\\|x", "<\\\\|", "a<|b|>c<", "\\n", ""):
        seg = chat_format.segment("assistant", text)[0]
        assert chat_format.read_back(seg) == ("assistant", text)
        assert seg.count("<|im_start|>") == seg.count("<|im_end|>") == 1
