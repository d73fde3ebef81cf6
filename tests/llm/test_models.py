import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import attention_lm, cross_polytope, toxicity
from ledgerloom.llm.common import table

from .conftest import SMALL

LARGE = "/root/testdata/sf0.1"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numeric(loss, x, at, step):
    x[at] += step
    high = loss()
    x[at] -= 2 * step
    low = loss()
    x[at] += step
    return (high - low) / (2 * step)


def doubles(p):
    return {k: v.astype(np.float64) if isinstance(v, np.ndarray) and v.dtype == np.float32 else v for k, v in p.items()}


def test_recurrent_gradients():
    windows = [[b"one", b"two", b"three"], [b"two", b"four"], [b"one"], [b"three"] * 5] * 3
    words, ids = toxicity.numbered(windows)
    p = toxicity.fresh(1, [[w] for w in windows])
    y = np.arange(len(windows)) % 2
    g = toxicity.gradients(p, words, ids, y.astype(np.float32))

    def loss():
        logit, _ = toxicity.forward(p, toxicity.encode(p, words), ids)
        return float(np.mean(np.logaddexp(0, logit.astype(np.float64)) - y * logit))

    for name in ("in", "shift", "ahead", "back", "look", "ask", "out", "bias", "word", "gram"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        assert numeric(loss, p[name], at, 1e-2) == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-4), name


def test_windows_cover_every_word_and_overlap():
    for n in range(1, 400):
        starts = toxicity.spans(n)
        covered = sorted({i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))})
        assert covered == list(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_a_toxic_word_counts_wherever_it_stands():
    clean = [f"word{i % 30} and{i % 7} then{i % 11}".encode().split() * 16 for i in range(60)]
    bad = [w[:20] + [b"vilest"] + w[20:47] for w in clean]
    p = toxicity.train([([w[:48]], 0) for w in clean] + [([w[:48]], 1) for w in bad], epochs=6)
    scorer = toxicity.Scorer(p)
    text = " ".join(w.decode() for w in clean[0] * 5)
    words = text.split(" ")
    for at in (0, 100, len(words) - 1):
        assert scorer.scores([" ".join(words[:at] + ["Vilest,"] + words[at:])])[0] > 0.7
    assert scorer.scores([text])[0] < 0.3
    assert scorer.scores([None, "", "  "]).tolist() == [scorer.empty] * 3
    assert scorer.scores(["x" * 200000]).shape == (1,)


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    out = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    hit = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert len(hit) > 50 and np.mean(hit) >= 0.85 and np.mean(clean) <= 0.02


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(d, d % 2, "own") for d in range(1, 13)] + [(3, None, "own"), (None, 1, "own")], "doc_id bigint, toxic int, score string")
    out = toxicity.score_toxicity(odd, labels)
    assert out.count() == odd.count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.score_toxicity(odd, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    kept = toxicity.keep_clean(odd, labels)
    assert kept.schema == odd.schema and kept.count() <= odd.count()


def plain_nearest(rows, every=20, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            scored = sorted((-float((v * w).sum()), j) for b, (j, w) in enumerate(good) if b != a)
            out.setdefault(i, scored[:k])
    return out


@pytest.mark.parametrize("sf", [SMALL, LARGE])
def test_recall(spark, sf):
    df = table(spark, sf, "embeddings")
    want = plain_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in cross_polytope.search(df, slice_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == set(want)
    for q in got:
        assert got[q] == sorted(got[q]) and len({v for _, v in got[q]}) == len(got[q])
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (None, [0.9, 0.0]), (20, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [None, 1.0]), (40, [0.0, 0.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "own", "own") for i, v in rows], "vec_id bigint, embedding array<double>, rid string, bucket string")
    out = {}
    for r in cross_polytope.search(df).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(out) == {0, 20}
    assert out[0][0] == (1, 5.0) and out[0][1][0] == 2 and [v for v, _ in out[0]][2:4] == [6, 20]
    assert cross_polytope.search(df.limit(0)).count() == 0


def test_search_among_extreme_vectors(spark):
    """Every query is answered; products beyond doubles are infinite and tie by vec_id."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [-1e200, 1.0]), (3, [5e-324, 0.0]), (20, [1e-200, 0.0]), (4, [3.0, 4.0]), (40, [1.0, 0.0])]
    out = {}
    for r in cross_polytope.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: len(v) for q, v in out.items()} == {0: 6, 20: 6, 40: 6}
    assert out[0][0] == (1, math.inf) and out[0][-1] == (2, -math.inf) and out[0][1] == (4, 7e200)
    assert out[40][:3] == [(0, 1e200), (1, 1e200), (4, 3.0)] and out[40][-1] == (2, -1e200)
    assert [v for v, _ in out[20][:3]] == [0, 1, 4] and out[20][2][1] == pytest.approx(3e-200)


def test_every_query_gets_all_that_is_due(spark):
    """Few vectors, and queries far off a large group of copies that the probes are fitted on."""
    draw = np.random.default_rng(6)
    few = [(20 * i, v) for i, v in enumerate(draw.normal(size=(15, 16)).tolist())]
    copies = [(20 * i, [1.0] + [0.0] * 15) for i in range(160)]
    lone = [(20 * (1000 + i), v) for i, v in enumerate(draw.normal(size=(12, 16)).tolist())]
    for rows in (few, copies + lone, few[:1]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        out = cross_polytope.search(df).groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.count_distinct("vec_id").alias("ids")).collect()
        due = min(20, len(rows) - 1)
        assert {tuple(r) for r in out} == ({(i, due, due, due) for i, _ in rows} if due else set())


def test_no_group_or_product_holds_all_queries(spark):
    """Products of bounded blocks, and slices on both sides of a bucket of copies that meet in every pair once."""
    draw = np.random.default_rng(4)
    query, x = draw.normal(size=(700, 8)), draw.normal(size=(300, 8))
    plain = [np.lexsort((np.arange(300), -(x * q).sum(1)))[:5].tolist() for q in query]
    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    got = cross_polytope.top_rows(query.view(Watched), np.arange(300), np.arange(300), x, np.full(700, -1), 5)
    assert [at.tolist() for _, at, _ in got] == plain and sum(seen) == 700 and max(seen) <= 256
    copies = spark.range(1000).selectExpr("id as rid", "id as vec_id", "array(1.0D, 0.5D) as v", "array(3, 40) as buckets")
    base, asking = cross_polytope.sliced(copies, copies.where("rid < 600"), 100)
    groups = ["bucket", "slice", "ask_slice"]
    assert max(r[0] for df in (base, asking) for r in df.groupBy(groups).count().select("count").collect()) < 200
    pairs = base.join(asking.withColumnRenamed("rid", "asked"), groups).groupBy("bucket").agg(F.count("*"), F.count_distinct("rid", "asked"))
    assert sorted(map(tuple, pairs.collect())) == [(3, 600_000, 600_000), (40, 600_000, 600_000)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


def plain_base(rows):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) for i, (_, t) in enumerate(rows)}
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for i, (d, _) in enumerate(rows):
        if not out(d):
            c.update(tokens[i] + [None])
    n, v = sum(c.values()), len(c)
    base = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted((-1 if d is None else d, out(d), len(tokens[i]) + 1, sum(c[w] > 0 for w in tokens[i] + [None]), n, round(sum(base(w) for w in tokens[i] + [None]), 4)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunk, words", [(2000, 300), (4_000_000, 0), (4_000_000, 1 << 17)])
def test_base_scores(docs, odd, nothing, chunk, words):
    for df in (docs, odd):
        out = attention_lm.score_documents(df, chunk=chunk, steps=20, words=words, shard_ids=20_000).collect()
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == plain_base(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert attention_lm.score_documents(nothing, steps=5).count() == 0


def test_held_out_documents_score_better_than_their_base(spark):
    out = attention_lm.score_documents(table(spark, LARGE, "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_scores_are_probabilities():
    """Known words and one class of all others: the mix is that of two distributions, and sums to one at most."""
    draw = np.random.default_rng(7)
    attention = draw.dirichlet(np.ones(500))
    c = np.where(np.arange(500) < 120, draw.integers(1, 90, 500), 0)
    n, v = c.sum(), (c > 0).sum()
    base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    assert (10 ** base[:121]).sum() == pytest.approx(1)
    for mix in (0.01, 0.75, 0.99):
        got = 10 ** attention_lm.word_scores(np.log10(attention), base, mix)
        assert np.allclose(got, (1 - mix) * attention + mix * 10**base)
        assert all(got[:120].sum() + other <= 1 + 1e-9 for other in got[120:])


def test_scoring_follows_plain_attention():
    """The lean pass over target classes gives what attend() gives, block by block."""
    p = attention_lm.fit(small_model(), [np.arange(400) % 77], steps=40)
    for ids in (np.arange(50) * 13 % 700, np.array([5])):
        symbols, target = attention_lm.inputs_targets(p, ids)
        now, first = attention_lm.blocks([symbols])
        logp, _ = attention_lm.attend(p, now, np.concatenate((now[:1], now[:-1])), first)
        plain = np.take_along_axis(logp.reshape(-1, attention_lm.CLASSES)[: len(target)], target[:, None], 1)[:, 0]
        plain[:-1] += p["within"][ids]
        assert np.allclose(attention_lm.log_probabilities(p, [ids])[0], plain, atol=1e-3)


def test_rounds_average_what_shards_learn(spark):
    """One shard is plain training; several end with common weights that have learned; none leave the prior."""
    model = small_model()
    texts = [np.array([3, 9, 4, 8] * 30), np.array([5, 2] * 50), np.arange(60)]
    rows = spark.createDataFrame([(t.astype("<u4").tobytes(),) for t in texts * 4], "ids binary")
    loss = lambda p: -sum(x.sum() for x in attention_lm.log_probabilities(p, texts))
    start = loss(attention_lm.fit(model, [], steps=1))
    for parts in (1, 3):
        assert loss(attention_lm.fit_in_rounds(model, rows.repartition(parts), 60, 2)) < 0.9 * start
    assert loss(attention_lm.fit_in_rounds(model, rows.limit(0), 60, 2)) == pytest.approx(start)


def small_model():
    draw = np.random.default_rng(2)
    symbol = np.minimum(np.arange(attention_lm.VOCABULARY), attention_lm.SYMBOLS)
    classes = np.arange(attention_lm.VOCABULARY) % (attention_lm.CLASSES - 1)
    weight = draw.random(attention_lm.VOCABULARY)
    within = np.log(weight / np.bincount(classes, weight)[classes])
    prior = draw.normal(size=(attention_lm.SYMBOLS + 2, attention_lm.CLASSES))
    return {"symbol": symbol.astype(np.int32), "class": classes.astype(np.int32), "prior": prior.astype(np.float32), "within": within.astype(np.float32)}


def test_model_is_causal_and_sums_to_one():
    texts = [np.random.default_rng(i).integers(0, 600, n) for i, n in enumerate((0, 1, 15, 16, 17, 100))]
    p = attention_lm.fit(small_model(), texts, steps=30)
    whole = attention_lm.log_probabilities(p, texts)
    for t, got in zip(texts, whole):
        assert len(got) == len(t) + 1
        alone = attention_lm.log_probabilities(p, [t])[0]
        assert np.allclose(alone, got, atol=1e-4)
        if len(t) > 3:  # what comes later changes nothing before
            other = np.append(t[:3], [5, 6, 7])
            assert np.allclose(attention_lm.log_probabilities(p, [other])[0][:3], got[:3], atol=1e-4)
    now, first = attention_lm.blocks([attention_lm.inputs_targets(p, texts[-1])[0]])
    logp, _ = attention_lm.attend(p, now, np.concatenate((now[:1], now[:-1])), first)
    assert np.allclose(np.exp(logp).sum(2), 1, atol=1e-3)
    assert np.allclose(np.bincount(p["class"], np.exp(p["within"].astype(float))), 1, atol=1e-3)


def test_attention_gradients():
    p = attention_lm.fresh(3) | small_model()
    p["out"] = np.random.default_rng(4).normal(size=p["out"].shape).astype(np.float32) * 0.3
    p = doubles(p)
    draw = np.random.default_rng(5)
    now, before = draw.integers(0, 40, (6, 16)), draw.integers(0, 40, (6, 16))
    first, target, use = np.array([True, False] * 3), draw.integers(0, attention_lm.CLASSES, (6, 16)), np.ones((6, 16))

    def loss():
        logp, _ = attention_lm.attend(p, now, before, first)
        return float(-np.take_along_axis(logp, target[:, :, None], 2).mean())

    g = attention_lm.gradients(p, now, before, first, target, use)
    for name in ("e", "q", "k", "v", "near", "o", "h", "out"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        assert numeric(loss, p[name], at, 1e-4) == pytest.approx(float(g[name][at]), rel=0.02, abs=1e-6), name
