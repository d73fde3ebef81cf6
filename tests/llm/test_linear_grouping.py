import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import linear_grouping as lg


def check_pieces(rows, texts, room=1024):
    """Every document cut as asked, every piece with its ids, every sequence gapless; gives the number of sequences."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, sequences = Counter(), defaultdict(list)
    for d, t in texts:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        starts = [0, *range(len(ids) % room or room, len(ids), room)]
        for i, (a, b) in enumerate(itertools.pairwise([*starts, len(ids)])):
            want[d, i, a, b - a, ids[a:b].tobytes()] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= room
    return len(sequences)


def test_packing_of_the_small_table(docs):
    rows = lg.pack(docs.repartition(3)).collect()
    least = -(-sum(r.length for r in rows) // 1024)
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()]) <= least + 2


def test_packing_of_odd_rows(odd, nothing):
    check_pieces(lg.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert lg.pack(nothing).count() == 0
    copies = odd.where("doc_id = 10").withColumn("more", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    rows = lg.pack(copies, with_ids=False).collect()
    assert len(rows) == 3000 and "ids" not in rows[0].asDict() and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert len({r.sequence_id for r in rows}) == -(-3000 // (1024 // rows[0].length))


def laid_out(plan, room):
    """sequence -> [(offset, length)] and the ranks used of each length, from a plan."""
    sequences, ranks = defaultdict(list), defaultdict(list)
    for length, rank, count, first, offset in plan.rows:
        ranks[length] += range(rank, rank + count)
        for i in range(count):
            sequences[first + i].append((offset, length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= room
    return sequences, ranks


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(0, 40), st.integers(1, 12))
def test_plans_place_every_piece_once(sizes, small, groups):
    histogram = np.bincount(sizes, minlength=61) if sizes else np.zeros(61, int)
    plan = lg.plan(histogram, small, groups)
    sequences, ranks = laid_out(plan, 60)
    assert {k: sorted(v) for k, v in ranks.items()} == {n: list(range(c)) for n, c in enumerate(histogram.tolist()) if c}
    assert len(sequences) == plan.bins >= -(-sum(sizes) // 60)


@pytest.mark.parametrize("sizes, groups, least", [([31, 29] * 50, 2, 50), ([20] * 300, 7, 100), ([24, 18, 18] * 40 + [30, 30] * 20, 4, 60), ([44, 16] * 100 + [60] * 5, 2, 105)])
def test_perfect_configurations_are_found(sizes, groups, least):
    """Groups that hold one length each lose nothing by rounding."""
    assert lg.plan(np.bincount(sizes, minlength=61), 10, groups).bins == least


def test_programme_against_all_configurations():
    """The optimum of the programme equals that over every configuration that fits, by duality."""
    sizes, wanted, room = [27, 23, 14, 11], [40, 70, 31, 90], 60
    found = lg.Programme(sizes, wanted, room).solve()
    value = sum(n for _, n in found)
    for g in range(4):
        assert sum(c[g] * n for c, n in found) == pytest.approx(wanted[g], rel=1e-3)
    basis = np.array([c for c, _ in found], float)
    price = np.linalg.solve(basis, np.ones(4))
    every = [c for c in itertools.product(range(3), range(3), range(5), range(6)) if sum(a * s for a, s in zip(c, sizes)) <= room]
    assert max(float(price @ np.array(c)) for c in every) <= 1 + 1e-3 and value == pytest.approx(float(price @ np.array(wanted)), rel=1e-3)


def test_grouping_rounds_up_in_equal_groups():
    histogram = np.bincount([50, 49, 48, 47, 30, 30, 30, 30, 29, 28, 9, 60], minlength=61)
    sizes, wanted, contents = lg.equal_groups(histogram, 10, 5)
    assert sum(wanted) == 10 and sizes == [50, 48, 30, 29] and contents[0] == [[50, 1], [49, 1]] and wanted == [2, 2, 4, 2]
