"""Nulls, empties, very long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tempora.llm import chat_format, decontaminate, line_dedup, lm_scoring, ngram_join, packing, quality_knn, quality_rules, secret_scan, warc

TEN = "one two three four five six seven eight nine ten"


@pytest.fixture(scope="module")
def docs(docs_of, awkward):
    return docs_of(awkward).persist()


@pytest.fixture(scope="module")
def none(docs_of, docs):
    return docs.limit(0)


def test_quality_rules(docs, none, awkward):
    r = {x["doc_id"]: x for x in quality_rules.score(docs).collect()}
    assert r[1]["n_words"] == r[2]["n_words"] == r[3]["n_words"] == 0 and r[1]["base_failed"] and not r[1]["kept"]
    assert r[4]["n_words"] == 60_000 and r[7]["word_chars"] == 200_000 and r[None]["n_words"] == 10
    assert quality_rules.score(docs).count() == len(awkward)
    assert quality_rules.score(none).count() == 0


def test_quality_rule_order_never_changes_the_verdict(docs_of, sample):
    d = docs_of(list(sample.items()))
    rules = quality_rules.default_rules()
    a = {r["doc_id"]: r["kept"] for r in quality_rules.cascade(d, rules).select("doc_id", "kept").collect()}
    measured = {r.name: (1.0, float(i)) for i, r in enumerate(rules)}
    assert [r.name for r in quality_rules.order(rules, measured)] == [r.name for r in reversed(rules)]
    p = quality_rules.prepare(d)
    for rs in (rules, rules[::-1]):
        got = {r["doc_id"]: r["k"] for r in p.select("doc_id", quality_rules.verdict(rs).isNull().alias("k")).collect()}
        assert got == a


def test_quality_rules_are_ordered_by_rejections_per_cost(spark, sf, docs_of):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    first = [r.name for r in quality_rules.ordered(d)]
    assert all([r.name for r in quality_rules.ordered(d)] == first for _ in range(4))
    got = quality_rules.measure(quality_rules.prepare(docs_of([(1, "a b"), (2, "! ! !"), (3, "plain words"), (None, None)])), quality_rules.default_rules())
    assert got["exclamations"] == (2 * (3 + 5 + 11) / 4, 1.5 / 5) and got["symbols"] == (1.0, 0.5 / 5)
    assert got["shouting"][0] == 32 * (3 + 5 + 11) / 4 and got["stutter"][0] == 32 * 7 / 4


def test_the_first_rule_that_rejects_is_reported(docs_of):
    d = docs_of([(1, " ".join(f"!#{i}" for i in range(30))), (2, "too short"), (3, " ".join(f"plain{i}" for i in range(30)))])
    rules = quality_rules.default_rules()
    for some in (rules, rules[::-1]):
        order = [r.name for r in quality_rules.ordered(d, some)]
        bad = {r.name for r in rules if quality_rules.prepare(d).where("doc_id = 1").where(r.rejects).count()}
        got = {r["doc_id"]: r["rejected_by"] for r in quality_rules.score(d, rules=some).collect()}
        assert got == {1: next(n for n in order if n in bad), 2: "base", 3: None} and len(bad) > 1


def test_lm_scoring(docs, none, awkward):
    r = lm_scoring.fit_and_score(docs).collect()
    by = {x["doc_id"]: x for x in r}
    assert len(r) == len(awkward) and by[4]["n_tokens"] == 60_000
    for i in (1, 2, 3, 9):
        assert (by[i]["n_tokens"], by[i]["log_likelihood"], by[i]["mean_log_likelihood"]) == (0, 0.0, None)
    assert by[5]["log_likelihood"] == pytest.approx(by[6]["log_likelihood"])
    assert lm_scoring.fit_and_score(none).count() == 0


def test_lm_query_against_loops(docs_of):
    """Counts, shares of tokens, training in the order of the hash and every word's sum, by loops."""
    import math
    from collections import Counter

    import numpy as np

    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 700} w{k % 7}" for k in range(60 + i))) for i in range(40)] + [(90, "often " * 500 + "seldom"), (91, None), (92, "often"), (92, "often")]
    d = docs_of(rows)
    words = {(i, t): (t or "").split() for i, t in rows}
    counts = Counter(w for i, t in rows for w in (t or "").split())
    hashed = {w: int(lm_scoring.Words(lm_scoring.pa.array([w]), fold=True).hash[0]) for w in counts}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ranked = sorted(counts, key=lambda w: (-counts[w], signed(hashed[w])))
    token = {w: i if i < lm_scoring.TOP else lm_scoring.TOP + hashed[w] % lm_scoring.RARE for i, w in enumerate(ranked)}
    share = Counter()
    for w in ranked:
        share[token[w]] += counts[w] + 1
    occurrences = np.zeros(lm_scoring.TOKENS)
    for w, n in counts.items():
        occurrences[token[w]] += n
    place = [r[0] for r in d.select(F.xxhash64("doc_id", "text")).collect()]
    texts = [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    order = [t for _, t in sorted(zip(place, texts, strict=True), key=lambda x: (x[0], str(x[1]))) if words[t]]
    net = lm_scoring.unigram_start(occurrences)
    for _ in range(lm_scoring.ROUNDS):
        mine = lm_scoring.Network(net.flat)
        lm_scoring._train_shard(mine, [np.array([token[w] for w in words[t]]) for t in order])
        net = mine
    got = {(r["doc_id"]): r for r in lm_scoring.fit_and_score(d).collect()}
    for i, t in rows:
        tokens = np.array([token[w] for w in words[i, t]], int)
        want = float(net.log_p(tokens, lm_scoring.contexts(tokens, np.array([0, len(tokens)]))).sum())
        for w in words[i, t]:
            if token[w] >= lm_scoring.TOP:
                want += math.log((counts[w] + 1) / (share[token[w]] + 1))
        assert got[i]["log_likelihood"] == pytest.approx(want, rel=1e-3, abs=1e-6)


def test_lm_scores_do_not_depend_on_partitions_or_lists(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    counts = lm_scoring.count_words(d).persist()
    vocab = lm_scoring.vocabulary(counts)
    scores = []
    for parts, listed in ((2, 1 << 21), (16, 100), (64, 0)):
        x = d.repartition(parts)
        net = lm_scoring.train(x, vocab, counts, shard_words=20_000)
        scores.append({r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(x, vocab, net, counts, listed=listed).collect()})
    for other in scores[1:]:
        assert other == pytest.approx(scores[0], rel=1e-4, abs=1e-6)


def test_lm_words_that_share_a_token_have_their_own_probability(docs_of):
    import math

    d = docs_of([(1, " ".join(f"w{i} w{i}" for i in range(3000))), (2, "often " * 1000 + "seldom")])
    counts = lm_scoring.count_words(d).persist()
    vocab = lm_scoring.vocabulary(counts)
    net = lm_scoring.train(d, vocab, counts)
    n, words = lm_scoring.token_counts(counts, vocab)
    assert n.sum() == 7001 and words.sum() == 3002 and (n + words + 1)[lm_scoring.TOP :].tolist() == lm_scoring._masses(counts, vocab).tolist()
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(docs_of([(1, "w2999 often"), (2, "unheard often"), (3, "w2999"), (4, "unheard")]), vocab, net, counts).collect()}
    assert math.exp(got[1]) > 0 and got[3] != got[4]


def test_window_network_against_loops():
    import numpy as np

    net, rng = lm_scoring.Network(), np.random.default_rng(0)
    t = rng.integers(0, lm_scoring.TOKENS, 9)
    off = np.array([0, 4, 4, 9])
    ctx = lm_scoring.contexts(t, off)
    got = net.log_p(t, ctx)
    for i in range(9):
        lo, hi = (0, 4) if i < 4 else (4, 9)
        c = [t[j] if lo <= j < hi else lm_scoring.TOKENS for j in (i - 2, i - 1, i + 1, i + 2)]
        assert ctx[i].tolist() == c
        h = np.tanh(np.concatenate([net.embed[x] for x in c]) @ net.w + net.b)
        g, m = divmod(int(t[i]), lm_scoring.MEMBERS)

        def log_softmax(x):
            return x - np.log(np.exp(x).sum())

        assert got[i] == pytest.approx(log_softmax(h @ net.group + net.group_b)[g] + log_softmax(h @ net.member[g] + net.member_b[g])[m], rel=1e-4)


def test_window_network_gradient_and_learning():
    import numpy as np

    t = np.tile(np.array([3, 700, 45, 9, 1000]), 400)
    ctx = lm_scoring.contexts(t, np.array([0, len(t)]))
    net = lm_scoring.Network()
    before = net.log_p(t, ctx).mean()
    for _ in range(60):
        net.step(t, ctx)
    assert net.log_p(t, ctx).mean() > before + 4
    # one step alone goes downhill
    net = lm_scoring.Network()
    t, ctx = t[:50], ctx[:50]
    flat = net.flat.copy()
    net.step(t, ctx)
    assert net.log_p(t, ctx).mean() > lm_scoring.Network(flat).log_p(t, ctx).mean()


def test_chat_format(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|im_end|>"), (1, 1, "assistant", "b<|im_end|>"), (2, 0, "assistant", None), (2, None, None, "x"), (None, 0, "user", "n"), (3, 0, "us\ner", "")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"segment": F.lit(1), "content": F.lit("z")})
    r = {x["conv_id"]: x for x in chat_format.digest(chat_format.format_turns(d)).collect()}
    assert {k: v["n_turns"] for k, v in r.items()} == {1: 3, 2: 2, None: 1, 3: 1}
    assert r[1]["loss_chars"] == 22 and r[2]["loss_chars"] == 0
    assert chat_format.digest(chat_format.format_turns(d.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [
        {"type": "text", "text": "see <|"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.5},
        {"type": "document", "ref": "c", "pages": 2}, {"type": "hologram", "ref": "d"}, None,
    ]
    schema = chat_format.T.StructType([chat_format.T.StructField(n, t) for n, t in (("conv_id", chat_format.T.LongType()), ("turn", chat_format.T.IntegerType()), ("role", chat_format.T.StringType()))])
    schema = schema.add("text", chat_format.T.ArrayType(chat_format.PART))
    full = [None if p is None else {f.name: p.get(f.name) for f in chat_format.PART} for p in parts]
    d = spark.createDataFrame([(1, 0, "user", full), (1, 1, "assistant", full[1:2]), (1, 2, "user", None)], schema)
    got = sorted(chat_format.format_turns(d).collect(), key=lambda r: r["turn_no"])
    assert [(a["index"], a["kind"], a["tokens"]) for a in got[0]["attachments"]] == [(0, "image", 4), (1, "audio", 38), (2, "document", 1152), (3, "other", 0)]
    assert got[0]["segment"] == "<|im_start|>user\nsee <\\|<|image:0|><|audio:1|><|document:2|><|other:3|><|im_end|>\n"
    assert got[1]["attachments"][0]["index"] == 4 and got[1]["segment"][got[1]["loss_start"] : got[1]["loss_end"]] == "<|image:4|>"
    assert got[2]["segment"] == "<|im_start|>user\n<|im_end|>\n"


def test_secret_scan(docs_of, docs, none, awkward):
    r = secret_scan.digest(secret_scan.scan(docs)).collect()
    assert len(r) == len(awkward) and all(x["spans"] == "" for x in r if x["doc_id"] != 4)
    assert secret_scan.scan(none).count() == 0


def test_secret_battery(docs_of):
    import random

    rng = random.Random(4)
    keys = {i: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for i in range(30)}
    prose = "the committee will then consider an internationalization_of_everything_that_is_known and more "
    d = docs_of([(i, prose * 5 + k + " " + prose) for i, k in keys.items()] + [(100 + i, prose * 6 + "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz xyxyxyxyxyxyxyxyxyxyxyxyxyxy " + prose) for i in range(30)])
    r = {x["doc_id"]: x["spans"] for x in secret_scan.digest(secret_scan.scan(d)).collect()}
    assert sum(r[i] == f"random:{len(prose) * 5}:{len(prose) * 5 + 40}" for i in keys) >= 28
    assert all(r[100 + i] == "" for i in range(30))


def test_every_test_of_the_battery_counts():
    """The p-value by its definition, and tokens that fail one test each."""
    import math
    import random

    import numpy as np

    rng = random.Random(1)
    flat = np.full(secret_scan.CLASSES**2, 1000)
    model = secret_scan.text_model(flat)
    good = "".join(rng.choice("0123456789abcdef") for _ in range(60))
    u, uniform = secret_scan.battery(good)
    text = 59 * math.log(1 / 64) - math.log(64)
    assert secret_scan.log_p_value(good, model) == pytest.approx(min(0, text - uniform - math.log(u)), rel=1e-3)
    digits = "0123456789abcdef"
    for bad in ("0123456789abcdef" * 4, "08192a3b4c5d6e7f" * 4, "a" * 40 + "b1", "".join(rng.choice("01234567") for _ in range(56)) + "f"):
        assert secret_scan.battery(bad)[0] < 1e-6 and secret_scan.log_p_value(bad, model) > secret_scan.log_p_value(good, model) * len(bad) / 60
    assert secret_scan.log_p_value("no encoding has a space", model) == 0.0 and set(good) <= set(digits)


def test_secrets_behind_names_and_paths(docs_of):
    import random

    rng = random.Random(9)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["AWS_SECRET_ACCESS_KEY={}", "sig={}", "https://host.io/user_files/{}", "see host.io/static-files/{}/index_page", "a=1=SOME_LONG_NAME_OF_A_VALUE={}=="]
    prose = "the committee will then consider an internationalization_of_everything_that_is_known and more "
    rows, want = [], {}
    for i in range(60):
        key, form = "".join(rng.choice(chars) for _ in range(40)), forms[i % len(forms)]
        text = prose * 5 + form.format(key) + " " + prose
        end = text.index(key) + 40
        rows.append((i, text))
        want[i] = f"random:{end - 40}:{end + 2 * form.endswith('==')}"
    rows += [(100 + i, prose * 6 + "path_of_the/internationalization-office=of_everything_known") for i in range(20)]
    r = {x["doc_id"]: x["spans"] for x in secret_scan.digest(secret_scan.scan(docs_of(rows))).collect()}
    assert sum(want[i] in r[i].split(",") for i in want) >= 55
    assert all(r[100 + i] == "" for i in range(20))


def test_line_dedup(docs_of, none, awkward):
    line = "a line of seven words stands here"
    near = " ".join(f"token{i}" for i in range(80))
    extra = [(20, f"{line}\nshort one\nown line of document number twenty alone"), (21, f"{line}\nshort one"), (22, f"{line}!"), (23, near), (24, near.replace("token40 ", "token4o "))]
    d = docs_of(awkward + extra)
    r = {x["doc_id"]: x for x in line_dedup.dedup(d).collect()}
    assert r[1]["text"] is None and r[2]["text"] == "" and r[20]["line_dedup_n_removed" if "line_dedup_n_removed" in d.columns else "n_removed"] == 0
    assert r[21]["text"] == "short one" and not r[21]["emptied"] and r[22]["text"] == "" and r[22]["emptied"]
    assert r[5]["text"] == TEN and r[6]["emptied"] and r[None]["emptied"]
    assert line_dedup.dedup(d).count() == len(awkward) + len(extra)
    kept = line_dedup.filter_docs(d)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} >= {1, 2, 3, 4, 5, 8, 9, 10, 20, 21}
    assert [x["n_chars"] for x in kept.where("doc_id = 21").collect()] == [9]
    assert line_dedup.dedup(none).count() == 0


def edited(rng, a, edits, how):
    """A line ``edits`` word edits away from ``a``, at most."""
    b = list(a)
    for _ in range(edits):
        at = rng.randrange(len(b))
        kind = rng.randrange(3) if how == "mixed" else 0
        if kind == 0:
            b[at] = f"new{rng.randrange(10**9)}" if how != "common" else "w1"
        elif kind == 1:
            b.insert(at, "w2")
        elif len(b) > 1:
            del b[at]
    return b


@pytest.mark.parametrize("low,high", [(5, 9), (10, 14), (15, 24), (25, 49), (50, 100), (101, 400)])
def test_recall_by_line_length(docs_of, low, high):
    """Pairs at the very threshold, each of words of its own but for common ones: found by the operator, of all that edit similarity has."""
    import random

    rng = random.Random(low)
    rows = []
    for i in range(120):
        n = rng.randint(low, high)
        a = [f"w{int(rng.paretovariate(0.5))}" if rng.random() < 0.5 else f"x{i}y{rng.randrange(60)}" for _ in range(n)]
        b = edited(rng, a, max(1, n // 5), rng.choice(["fresh", "common", "mixed"]))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {(r["id"], r["line"]) for r in line_dedup.duplicates(docs_of(rows)).collect()}
    want = line_dedup.brute_force(dict(rows))
    assert len(want) >= 60 and got <= want
    recall = len(got) / len(want)
    assert recall == 1 if high < 16 else recall >= 0.95, recall


def test_edited_lines_of_every_kind(docs_of):
    import random

    rng = random.Random(7)
    rows = []
    for n in (5, 6, 8, 9, 10, 12, 14, 19, 20, 24, 30, 50, 120):
        for part in (0.0, 0.1, 0.2):
            for how in ("fresh", "common", "mixed"):
                a = [f"w{min(int(rng.paretovariate(0.6)), 5000)}" for _ in range(n)]
                b = edited(rng, a, max(1, int(part * n)), how)
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    rows += [(1000, "la la la la la la"), (1001, "la la la la la lu"), (1002, "one word only here " * 2), (1003, "one word only here one word only")]
    want = line_dedup.brute_force(dict(rows))
    got = {(r["id"], r["line"]) for r in line_dedup.duplicates(docs_of(rows)).collect()}
    assert len(want) >= 60 and got == want


def test_blocks_survive_three_changes_of_five():
    import random

    import numpy as np

    rng, level = random.Random(3), np.full(line_dedup.SLOTS, 20, np.uint8)
    level[rng.sample(range(line_dedup.SLOTS), 1 << 19)] = 90
    for n in (5, 7, 10, 14, 19):
        for _ in range(200):
            a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            b = a.copy()
            b[rng.sample(range(n), n // 5)] = np.array([rng.getrandbits(64) for _ in range(n // 5)], np.uint64)
            k, off = line_dedup.pair_blocks(np.concatenate([a, b]), np.array([n, n]), level)
            assert set(k[: off[1]].tolist()) & set(k[off[1] :].tolist())


@pytest.mark.parametrize("n", [20, 23, 24, 25, 40, 99, 250])
def test_similar_lines_share_a_block_wherever_the_edits_are(n):
    """Edits on a line's rarest words first, or on every fifth word: as many as the threshold allows, of every kind."""
    import random

    import numpy as np

    rng, level = random.Random(n), np.full(line_dedup.SLOTS, 20, np.uint8)
    level[rng.sample(range(line_dedup.SLOTS), 1 << 19)] = 90
    rare = lambda w: (level[w & (line_dedup.SLOTS - 1)], int(line_dedup.mix(np.array([w], np.uint64))[0]))
    for turn in range(60):
        a = [rng.getrandbits(64) for _ in range(n)]
        b, edits = list(a), 0
        for at, w in enumerate(sorted(a, key=rare) if turn % 2 else a[::5]):
            c, place, kind = list(b), b.index(w), turn // 2 % 4 if turn < 40 else rng.randrange(3)
            if kind == 1:
                c.insert(place, rng.getrandbits(64))
            elif kind == 2:
                del c[place]
            else:
                c[place] = rng.getrandbits(64)
            if at + 1 > int(0.2 * max(len(c), n) + 1e-9):
                break
            b, edits = c, at + 1
        assert edits >= n // 5 - 1 and line_dedup.similarity_at_least(a, b, 0.8)
        k, off = line_dedup.pair_blocks(np.array(a + b, np.uint64), np.array([n, len(b)]), level)
        assert set(k[: off[1]].tolist()) & set(k[off[1] :].tolist()), (turn, edits)


def test_long_lines_whose_rarest_words_all_differ(docs_of):
    """Each line's rarest words are changed in its copy; common words are all that is left."""
    common = [f"w{i}" for i in range(60)]
    rows = [(1000 + i, " ".join(common[i:] + common[:i])) for i in range(0, 60, 15)]
    for i in range(40):
        n, k = 20 + i, (20 + i) // 5
        words = [common[(7 * i + 13 * j) % 60] for j in range(n)]
        for copy in range(2):
            w = list(words)
            for j in range(k):
                w[j * 5] = f"r{i}x{j}y{copy}"  # once in this line, again in the two lines below
            rows += [(10 * i + copy, " ".join(w)), (10 * i + 2 + copy, " ".join(x for x in w if x[0] == "r"))]
    want = line_dedup.brute_force(dict(rows))
    got = {(r["id"], r["line"]) for r in line_dedup.duplicates(docs_of(rows)).collect()}
    assert got == want and len(want) >= 40


def test_simhash_against_loops():
    import numpy as np

    rng = np.random.default_rng(5)
    n = np.array([1, 3, 70_000, 8])
    h = rng.integers(0, 2**64, n.sum(), dtype=np.uint64)
    for x, part in zip(line_dedup.simhash(h, n).tolist(), np.split(h, np.cumsum(n)[:-1]), strict=True):
        assert x == sum(1 << k for k in range(64) if 2 * int((part >> np.uint64(k) & np.uint64(1)).sum()) > len(part) - len(part) % 2)


def test_hot_buckets_are_split(docs_of, monkeypatch):
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        w[5 * i] = f"other{i}"
        rows.append((i, " ".join(w)))
    d = docs_of(rows)
    want = line_dedup.brute_force(dict(rows)), ngram_join.brute_force(dict(rows))
    for k, v in (("CHUNK", 7), ("TEXT_CHUNK", 5), ("SIGN_CHUNK", 6), ("GROUP", 2)):
        monkeypatch.setattr(line_dedup, k, v)
    monkeypatch.setattr(ngram_join, "CHUNK", 9)
    assert {(r["id"], r["line"]) for r in line_dedup.duplicates(d).collect()} == want[0]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(d).collect()}
    assert got == want[1] and set(got.values()) == {(0, 59)}


def test_hot_blocks_of_several_groups(docs_of, monkeypatch):
    """Families of near copies, chains between them and unrelated lines, all with the same rare words."""
    import random

    rng = random.Random(11)
    for k, v in (("CHUNK", 6), ("TEXT_CHUNK", 8), ("SIGN_CHUNK", 5), ("GROUP", 3)):
        monkeypatch.setattr(line_dedup, k, v)
    shared = ["rare0", "rare1"]
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(18)] + shared
        for i in range(12):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(4), "common"))))
    chain = [f"c{i}" for i in range(18)] + shared
    for _ in range(15):
        chain = edited(rng, chain, 2, "common")
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, " ".join([f"u{i}x{j}" for j in range(9)] * 2 + shared)) for i in range(30)]
    want = line_dedup.brute_force(dict(rows))
    assert {(r["id"], r["line"]) for r in line_dedup.duplicates(docs_of(rows)).collect()} == want and len(want) > 40


def test_levenshtein_threshold():
    import random

    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = random.Random(0)
    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "ab")
        want = 1 - slow(a, b) / max(len(a), len(b), 1) >= 0.6 - 1e-12
        assert line_dedup.similarity_at_least(a, b, 0.6) == want


def test_workers_let_go_of_what_other_operators_kept():
    from types import SimpleNamespace as S

    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    docs = S(schema=schema, columns=["doc_id", "text"], sparkSession=S(sparkContext=S(broadcast=lambda m: S(value=m))), mapInArrow=lambda run, _: run)
    spec = packing.tokenizer_json()
    for run in (quality_knn.score(docs, None), line_dedup._lines(5, pa.int64())):
        packing.WordCache.of(spec)
        assert list(run(iter([]))) == [] and not packing.WordCache._by_crc


def test_decontaminate(spark, docs_of, awkward, none):
    q = "A train leaves Boston at 60 miles per hour and reaches Chicago after 14 hours , how far did it travel in total"
    b = spark.createDataFrame([(1, q), (2, None), (3, ""), (4, "too short"), (1, q)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    new = q.replace("60", "75").replace("Boston", "Denver").replace("14", "9").replace("miles", "km")
    odd = "A train leaves Boston at 60 miles per hour and reaches Boston after 60 hours , how far did it travel in total"
    rows = [(30, f"Before. {q}. After"), (31, f"so then {new} and more"), (32, "a train leaves on time and nothing else is said about it here or there")]
    d = docs_of(awkward + rows)
    r = decontaminate.leaks(d, b).collect()
    assert sorted((x["doc_id"], x["reparameterised"]) for x in r) == [(30, False), (30, False), (31, True), (31, True)]
    swapped = q.replace("60 miles", "14 miles") + " " + odd
    assert decontaminate.leaks(docs_of([(33, swapped)]), b).count() in (0, 2)
    assert sorted(x["doc_id"] or 0 for x in decontaminate.drop_leaks(d, b).collect()) == sorted(i or 0 for i, _ in awkward + rows if i not in (30, 31))
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.drop_leaks(d, b.limit(0)).count() == d.count()


def test_case_and_line_breaks_hide_no_copy(spark, docs_of):
    q = "Which treaty signed in Paris between France and Spain in 1763 gave the land west of the river to Louis and his heirs for 20 years"
    r = "A train leaves Boston at 60 miles per hour and reaches Chicago after 14 hours , how far did it travel in total"
    b = spark.createDataFrame([(1, q), (2, r)], "item_id long, text string")
    forms = [str, str.lower, str.upper, str.title, lambda x: x.replace(" ", "\n"), lambda x: x.replace(" ", "  "), lambda x: x.upper().replace("1763", "1648").replace("60", "75")]
    rows = [(10 * i + k, f"so it goes. {f(x)} and so on") for i, f in enumerate(forms) for k, x in ((1, q), (2, r))]
    other = [(99, "which train signed in the land west of the city to louis after 14 hours in total and how far is it to chicago")]
    got = {(x["doc_id"], x["item_id"], x["reparameterised"]) for x in decontaminate.leaks(docs_of(rows + other), b).collect()}
    assert got == {(i, i % 10, i >= 60) for i, _ in rows}


def test_names_that_begin_sentences(spark, docs_of):
    one = "Alice has 5 red apples. Alice gives 2 of them to her brother and eats the rest of them at home"
    two = "Tom has 5 red apples. Sue has 3. Tom gives Sue 2 kg of pears. How many apples are left?"
    b = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    rows = [
        (10, one.replace("Alice", "Bob")), (11, "So: \"" + one.replace("Alice", "Bob").replace("5", "7").replace("2", "4") + "\""), (12, "(" + one.replace(" Alice", "\nEve").replace("Alice", "Eve") + ")"),
        (20, two.replace("Tom", "Bob").replace("Sue", "Ann").replace("5", "7")), (21, two.upper()), (22, two.replace(". ", ".\n").replace("Tom", "Zoë")),
        (30, one.replace("Alice gives", "Carl gives")), (31, "Alice and Tom went home and nobody else has seen them since then"), (32, "AN ALL CAPITAL LINE OF SHOUTED WORDS THAT GOES ON AND ON AND ON FOR NO GOOD REASON AT ALL"),
    ]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs_of(rows), b).collect()}
    assert got - {(30, 1)} == {(10, 1), (11, 1), (12, 1), (20, 2), (21, 2), (22, 2)}


def test_short_items_are_whole_lines(spark, docs_of):
    b = spark.createDataFrame([(1, "Name the capital of France."), (2, "Who?"), (3, "1 2 3 4 5 6 7 8 9"), (4, "...")], "item_id long, text string")
    rows = [(1, "text\n  name the  capital of FRANCE\nmore"), (2, "they name the capital of France here"), (3, "who\n1 2 3 4 5 6 7 8 9"), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, None), (6, "")]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs_of(rows), b).collect()}
    assert got == {(1, 1), (3, 2), (3, 3)}


def test_inconsistent_slots_do_not_leak(spark, docs_of):
    w = [" ".join(f"{x}{k}" for k in "abcdef") for x in "pqrs"]
    item, same, mixed = (f"{w[0]} {a} {w[1]} {b} {w[2]} {c} {w[3]}" for a, b, c in ((5, 5, 5), (8, 8, 8), (1, 2, 3)))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {x["doc_id"] for x in decontaminate.leaks(docs_of([(1, same), (2, mixed)]), b).collect()} == {1}


def test_packing(docs, none, awkward):
    r = packing.pack(docs).toPandas()
    assert len(r[r.piece == 0]) == len(awkward)
    assert set(r[r.doc_id.isin([1, 2, 3])].length) == {1}
    for _, g in r.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= packing.CAPACITY
    assert r.sequence_id.nunique() == -(-r.length.sum() // packing.CAPACITY)
    assert packing.pack(none).count() == 0


def test_packing_plans():
    import random
    from collections import Counter

    rng = random.Random(2)
    for low, high, n in ((1, 4096, 300), (1000, 2100, 300), (1366, 1366, 50), (1, 60, 2000), (4096, 4096, 7)):
        counts = Counter(rng.randint(low, high) for _ in range(n))
        first, bins = packing.best_fit(counts, 4096), packing.plan_bins(counts, 4096)
        got = Counter()
        for content, copies in bins:
            assert sum(content) <= 4096
            for x in content:
                got[x] += copies
        assert got == counts and sum(m for _, m in bins) <= sum(m for _, m in first)
    assert packing.plan_bins({}, 4096) == []
    # a fixed point: no class has a step to one that is no emptier
    rest = packing.OpenBins(4096)
    for content, copies in packing.plan_bins(Counter(rng.randint(900, 2300) for _ in range(400)), 4096):
        if sum(content) < 4096:
            rest.add(tuple(content), copies)
    assert all(rest.best_step(i) is None for i in range(len(rest.content)))
    # a move, a swap and a two-for-one each free a bin
    assert sum(m for _, m in packing.local_search([[[6, 3], 1], [[5, 4], 1], [[2], 1]], 10)) == 2


def test_tokens_of_strange_words():
    import pyarrow as pa

    cache = packing.WordCache(packing.tokenizer_json())
    texts = ["It's <|endoftext|> don't", "ÀÉ́x y İstanbul ΣΑΣ", "a b", "x" * 5000, "don't'll 'Tis", "", "日本 3.14%$#", "É\n\n\tß"]
    ids, off = cache.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*cache.tok.encode(t, add_special_tokens=False).ids, 1], t


def test_ngram_join(docs, none, awkward):
    r = [(x["doc_id"], x["class_id"], x["n_links"]) for x in ngram_join.join(docs).collect()]
    assert len(r) == len(awkward)
    assert sorted((x for x in r if x[1] == 5), key=str) == [(5, 5, 3), (5, 5, 3), (6, 5, 3), (None, 5, 3)]
    assert all(x[2] == 0 and x[0] == x[1] for x in r if x[0] not in (5, 6, None))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert ngram_join.join(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_quality_knn(spark, docs, none, awkward):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 0), (7, None), (8, 0), (None, 1), (99, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    r = quality_knn.classify(docs, labels).collect()
    assert len(r) == len(awkward) and all(0 <= x["score"] <= 1 for x in r)
    kept = quality_knn.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {x["score"] for x in quality_knn.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_knn.classify(none, labels).count() == 0


def test_neighbour_votes_against_loops():
    import numpy as np
    import pyarrow as pa

    texts = ["plain words in a row", "Other plain words here", "###$$ %%% ###", "$$$ ### %%", "more plain words"]
    x = quality_knn.terms(pa.array(texts))
    m = quality_knn.Model(x, np.array([1.0, 1, 0, 0, 1]), rank=3, neighbours=3)
    for row, s in zip(x, m.score(x), strict=True):
        v = m.project(row[None])[0]
        cos = np.array([float(v @ w) for w in m.vectors])
        near = np.argsort(-cos)[:3]
        w = np.maximum(cos[near], 1e-3) ** quality_knn.STEEP
        assert s == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-4)
    assert m.score(x)[2] < 0.5 < m.score(x)[0]


def test_neighbours_that_tie():
    import numpy as np

    rng = np.random.default_rng(1)
    cos = rng.integers(0, 6, (300, 40)) / 8
    for k in (1, 7, 39, 40, 50):
        got = quality_knn.nearest(cos, k)
        for row, c in zip(got, cos, strict=True):
            assert sorted(row.tolist()) == sorted(sorted(range(40), key=lambda i: (-c[i], i))[:k])


def test_classifier_against_loops(docs_of, spark):
    """The whole query by loops: sample, idf, directions from a full decomposition, every cosine, votes."""
    import random
    import zlib

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(["plain", "word", "here", "and", "There"] if i % 3 else ["#$%", "##", "BUY", "n0w", "!!!"]) + rng.choice(["", "s", ","]) for _ in range(rng.randint(3, 40))) for i in range(150)}
    labels = {i: int(i % 3 > 0) for i in range(120)}
    d = docs_of([*texts.items(), (5, "zz the greater text of an id that repeats")])
    got = {}
    for r in quality_knn.classify(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect():
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["score"], r["predicted"]))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    ids = [i for i in sorted(labels) if not held[i]]
    least = {i: min(texts[i], "zz the greater text of an id that repeats") if i == 5 else texts[i] for i in texts}
    counts = quality_knn.terms(pa.array([least[i] for i in ids]))
    m = quality_knn.Model(counts, np.array([labels[i] for i in ids], float))
    x = m.weigh(counts).astype(float)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    rank = min(quality_knn.RANK, len(ids))
    for i, t in texts.items():
        v = m.weigh(quality_knn.terms(pa.array([t])))[0].astype(float)
        own = sum(float(v @ d) * d for d in vt[:rank])
        votes = []
        for row, j in zip(x, ids, strict=True):
            other = sum(float(row @ d) * d for d in vt[:rank])
            votes.append((float(own @ other) / np.sqrt(float(own @ own) * float(other @ other)), labels[j]))
        votes = sorted(votes, key=lambda c: -c[0])[: quality_knn.NEIGHBOURS]
        w = [max(c, 1e-3) ** quality_knn.STEEP for c, _ in votes]
        want = sum(a * y for a, (_, y) in zip(w, votes, strict=True)) / sum(w)
        assert any(h == held[i] and s == pytest.approx(want, abs=0.02) and p == (s >= 0.3) for h, s, p in got[i])


def test_warc(spark):
    html = "<html lang=de><head><title>A &amp; B</title><style>x{}</style></head><body><!-- <p>no --><p>One<br>two&nbsp;three<script>var a='<p>'</script><a href='/x?a=1&amp;b=2'>link</a><td title=\"a>b\">cell"
    rows = [(1, "http://a/ b", html), (2, None, None), (3, "http://c", ""), (3, "http://c", ""), (None, "u", "<p"), (4, "http://d", "x " * 300_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record": F.lit("clash"), "id": F.lit(0)})
    rec = warc.responses(d)
    out = warc.derive(rec).collect()
    assert len(out) == 2 * len(rows)
    one = {r["warc_type"]: r for r in out if r["page_id"] == 1}
    assert one["conversion"]["block"] == "One\ntwo threelink\ncell" and one["conversion"]["target_uri"] == "http://a/%20b"
    assert one["metadata"]["block"].split("\r\n")[:2] == ["title: A & B", "language: de"] and "outlink: /x?a=1&b=2" in one["metadata"]["block"]
    source = warc.parse(bytes(rec.where("page_id = 1").first()["record"]))[0]
    for r in out:
        h, block = warc.parse(bytes(r["record"]))
        assert h["warc-block-digest"] == warc.digest(block) and h["warc-refers-to"] == r["refers_to"]
    assert one["metadata"]["refers_to"] == source["warc-record-id"]
    assert {r["block"] for r in out if r["page_id"] == 2} == {"", "source-content-type: text/html; charset=utf-8\r\nsource-content-length: 0\r\n"}
    assert warc.parse(bytes(warc.derive(warc.responses(d, gzip=True), gzip=True).first()["record"]))[0]["warc-type"] in ("metadata", "conversion")
    assert warc.derive(warc.responses(d.limit(0))).count() == 0
    assert warc.derivatives(warc.build([("WARC-Type", "request")], b"")) == []


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task):
    from tempora.llm import common
    from tempora.llm.common import connected_components

    monkeypatch.setattr(common, "ONE_TASK_EDGES", one_task)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.createDataFrame(pairs, "a long, b long")
    node = lambda c: F.struct((F.col(c) % 7).alias("x"), F.col(c).alias("y")).alias(c)
    structs = {r["node"]["y"]: r["comp"]["y"] for r in connected_components(rows.select(node("a"), node("b"))).collect()}
    assert structs == {k: {0: 0, 100: 105, 300: 301}[v] for k, v in got.items()}
    texts = {r["node"]: r["comp"] for r in connected_components(rows.select(F.col("a").cast("string"), F.col("b").cast("string"))).collect()}
    assert texts == {str(k): str(v) for k, v in got.items()}


def test_line_families_cost_their_number(monkeypatch):
    """Near copies are linked by about as many comparisons as they are, and what is of one group isn't compared again."""
    import numpy as np
    import pyarrow as pa

    m, words = 150, [[f"w{j}" if j != i % 40 else f"new{i}" for j in range(40)] for i in range(150)]
    w = line_dedup.Words(pa.array([" ".join(x) for x in words]))
    n = np.diff(w.offsets)
    t = {"key": np.full(m, 7), "k1": np.arange(m), "k2": np.arange(m), "n": n.astype(np.int32), "sim": line_dedup.simhash(w.hash, n).view(np.int64), "words": [" ".join(x) for x in words]}
    t |= {k: x.view(np.int64) for k, x in zip(line_dedup.LANES, line_dedup.word_sets(w.hash, n), strict=True)}
    calls, real = [], line_dedup.similarity_at_least
    monkeypatch.setattr(line_dedup, "similarity_at_least", lambda *a: calls.append(1) or real(*a))
    first = pa.Table.from_batches(line_dedup._alike(0.8, ["key"], line_dedup.WINDOW)([pa.RecordBatch.from_pydict(t)]))
    assert len(first) == m - 1 and len(calls) <= 2 * m
    calls.clear()
    assert not list(line_dedup._alike(0.8, ["key"])([pa.RecordBatch.from_pydict(t | {"group": np.zeros(m, np.int64)})])) and not calls
