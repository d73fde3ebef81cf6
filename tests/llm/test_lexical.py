import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lexical
from ledgerloom.llm.common import table

from .conftest import SMALL

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [w.translate(FOLD) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(items, docs, top):
    """Every document scored for every item by the definition."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for w, x in df.items()}
    out = []
    for item_id, text in items:
        asked = Counter(terms(text))
        found = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(times * weight[w] * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, times in asked.items() if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item_id, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def rows(df, key):
    return [(r[0], r[1]) for r in df.select(key, "text").collect()]


@pytest.mark.parametrize("how", [{}, {"top": 3, "shard_docs": 9, "query_terms": 100}, {"top": 400, "shard_bytes": 1}])
def test_search_against_all_scores(spark, docs, how):
    items = table(spark, SMALL, "benchmark")
    assert got(lexical.search(items, docs.repartition(3), **how)) == plain(rows(items, "item_id"), rows(docs, "doc_id"), how.get("top", 20))


def test_search_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "this LINE is, is is in"), (1, "words"), (None, "one two word"), (2, None), (3, ""), (4, "nowhere_"), (5, "x" * 50000)], "item_id bigint, text string")
    for docs in (odd, odd.withColumn("doc_id", F.lit(None).cast("bigint"))):
        for how in ({}, {"top": 2, "shard_docs": 3}):
            assert got(lexical.search(items, docs, **how)) == plain(rows(items, "item_id"), rows(docs, "doc_id"), how.get("top", 20))
    assert lexical.search(items, nothing).count() == 0 and lexical.search(items.limit(0), odd).count() == 0
    with pytest.raises(ValueError, match="shard"):
        lexical.build_index(odd, shard_docs=1 << 17)


def test_ties_prefer_small_ids(spark):
    docs = spark.range(3000).select((3000 - F.col("id")).alias("doc_id"), F.lit("same few words").alias("text"))
    docs = docs.unionByName(spark.range(50).select((F.col("id") + 9000).alias("doc_id"), F.lit("other").alias("text")))
    items = spark.createDataFrame([(1, "words few")], "item_id bigint, text string")
    out = lexical.search(items, docs, top=5, shard_docs=400).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [1, 2, 3, 4, 5] and len({r.score for r in out}) == 1


def test_best_first_skips_documents():
    """An interval that cannot beat the kept documents is never opened: few of the documents are scored."""
    shard = lexical.Shard()
    for i in range(4000):
        shard.add(i, (b"common word " + (b"rare" if i % 500 == 3 else b"plain")))
    row = dict(zip([c.split()[0] for c in lexical.INDEX.split(", ")], shard.row()))
    lists = lexical.Lists(row, {b"rare": 0, b"common": 1}, np.array([8000, 700]), 4000, 12000)
    item = lexical.Item(8)
    assert lexical.best_first(lists, [(np.array([0, 1]), np.array([1, 2]))], [item]) < 60
    assert sorted(-d for _, d, _ in item.best) == [i for i in range(4000) if i % 500 == 3]


def test_range_maxima():
    shard = lexical.Shard()
    rng = np.random.default_rng(1)
    for i in range(200):
        shard.add(i, b" ".join([b"a"] * int(rng.integers(1, 9)) + [b"b"] * int(rng.integers(0, 3))))
    row = dict(zip([c.split()[0] for c in lexical.INDEX.split(", ")], shard.row()))
    lists = lexical.Lists(row, {b"a": 0, b"b": 1}, np.array([5, 7]), 200, 1500)
    for a in range(0, 190, 7):
        for b in range(a + 1, 200, 11):
            assert lists.highest(np.array([a]), np.array([b]))[0] == a + int(lists.impact[a:b].argmax())
