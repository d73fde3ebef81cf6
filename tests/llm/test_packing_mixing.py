import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import mixing, packing


def check_pieces(rows, texts):
    """Every id in exactly one piece, every sequence gapless, at most 1024, ids as the tokenizer file gives them."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        want[d, np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    whole = defaultdict(int)
    for (d, ids), n in want.items():
        for start in range(0, 0 if n > 1 else 1):
            parts = sorted(p for p in pieces[d, len(ids) // 4])
            if len({p[0] for p in parts}) == len(parts):
                assert b"".join(p[1] for p in parts) == ids
        whole[d] += n * len(ids) // 4
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == whole
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding <= 0.001 * sum(sizes)


def test_packing_of_the_small_table(docs):
    check_pieces(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_packing_of_odd_rows(odd, nothing):
    check_pieces(packing.pack(odd, group_docs=4).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert packing.pack(nothing).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_is_first_fit_decreasing(sizes):
    bins = packing.first_fit(sizes, 64)
    plain, left = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, room in enumerate(left) if room >= sizes[i]), len(left))
        if k == len(left):
            left.append(64)
            plain.append([])
        left[k] -= sizes[i]
        plain[k].append(i)
    assert bins == plain


def by_hand(rows):
    """(source, size) rows to targets by resharing until no source is above three times its size."""
    size = Counter()
    for s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * size[s] for s in over}
        rest -= sum(3.0 * size[s] for s in over)
        free -= over
    return size, target


@pytest.mark.parametrize("block_docs", [1, 3, 256])
def test_mixing(docs, block_docs):
    for frame in (docs, docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("source")))):
        out = mixing.mix(frame, block_docs=block_docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "shards").collect()
        sizes, targets = by_hand([(r.source, r.size) for r in out])
        taken, longest = Counter(), Counter()
        for r in out:
            assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.shards) * r.size == r.taken
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
            taken[r.source] += r.taken
            longest[r.source] = max(longest[r.source], r.size)
        for s in targets:
            assert abs(taken[s] - targets[s]) <= longest[s]
        assert len(out) == frame.count()
        again = mixing.mix(frame, block_docs=block_docs).select("row.doc_id", "taken", "shards").collect()
        assert sorted((r.doc_id, r.taken, tuple(r.shards)) for r in out) == sorted((r.doc_id, r.taken, tuple(r.shards)) for r in again)


def test_reruns_agree_without_ids(spark):
    """Null ids and equal sizes, dealt over other partitions in another order: every text is taken as often."""
    rows = [(None if i % 2 else i, f"w{i % 40} " * (1 + i % 5) + f"own{i // 2}", f"src{i % 3}") for i in range(400)]
    want = None
    for parts, order in ((1, rows), (3, rows[::-1]), (7, rows)):
        df = spark.createDataFrame(order, "doc_id bigint, text string, source string").repartition(parts)
        out = sorted((r.text, -1 if r.doc_id is None else r.doc_id, r.taken) for r in mixing.mix(df, block_docs=8).select("row.text", "row.doc_id", "taken").collect())
        assert want is None or out == want
        want = out


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 7), (3, 0), (4, 100)], "source_no bigint, blocks bigint")
    out = mixing.split_quotas(quotas, 5, 1).collect()
    by_source, by_shard = Counter(), Counter()
    for r in out:
        by_source[r.source_no] += r.blocks
        by_shard[r.shard] += r.blocks
        assert r.blocks >= 0
    assert by_source == Counter({1: 40, 2: 7, 3: 0, 4: 100}) and max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 5


def test_mixing_odd_rows(odd, nothing):
    out = mixing.mix(odd).select("row.doc_id", "row.source", "row.size", F.col("size").alias("n"), "target", "taken").collect()
    sizes, targets = by_hand([(r.source, r.n) for r in out])
    assert len(out) == odd.count() and all(r.target == pytest.approx(targets[r.source]) for r in out) and {r.size for r in out} == {"own size"}
    assert mixing.mix(nothing).count() == 0
    blank = odd.withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in mixing.mix(blank).select("taken", "target").collect()} == {(0, 0.0)}
    whole = mixing.mixed(odd)
    assert whole.columns == odd.columns and whole.count() > 0


def test_copies_of_one_row_spread_over_the_groups(spark):
    """Half of the table is one row; no group holds much more than its share, and order in a task is free."""
    rows = [(7, "the same words")] * 4000 + [(100 + i, f"own words {i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    places = Counter(r.sequence_id >> 32 for r in packing.pack(df, group_docs=500).where("start = 0").select("sequence_id").collect())
    assert len(places) == 16 and sum(places.values()) == 8000 and max(places.values()) < 700
    assert {packing.group_of(5, 2, n, 9) for n in range(200)} == set(range(9))
