import random

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import embed_dedup, simhash
from ledgerloom.llm.common import components, roots, table

from .conftest import SMALL

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_groups(rows):
    prints = [plain_print(t) for _, t in rows]
    label = smallest(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min(least.get(k, 1 << 60), 1 << 60 if d is None else d)
    return sorted(((-1 if d is None else d), f, None if least[k] == 1 << 60 else least[k]) for (d, _), f, k in zip(rows, prints, label))


def groups(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())


def test_simhash_of_small_and_odd_tables(docs, odd, nothing):
    for df in (docs, odd):
        assert groups(df) == plain_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in odd.select("text").collect()]
    prints = [plain_print(t) for t in texts]
    label = dict(zip(prints, smallest(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)))
    left = [label[plain_print(r.text)] for r in kept.collect()]
    assert sorted(left) == sorted(set(label.values()))  # one row of each component, whatever ids its rows have


@pytest.mark.parametrize("group", [4, 16, 512])
def test_index_finds_every_link(spark, group):
    draw = random.Random(group)
    found = set()
    for _ in range(12):
        seed = draw.getrandbits(64)
        for _ in range(60):
            flips = draw.sample(range(64), draw.choice([0, 1, 2, 3, 4]))
            found.add(seed ^ sum(1 << b for b in flips))
    found = sorted(found)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in found], "fp bigint"), group=group)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    label = smallest(len(found), lambda i, j: (found[i] ^ found[j]).bit_count() <= 2)
    want, have = {}, {}
    for x, k in zip(found, label):
        want.setdefault(k, set()).add(x)
        have.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    out = components(edges).collect()
    assert {r.root for r in out} == {0} and sorted(r.node for r in out) == list(range(200))


def plain_links(rows, cosine=0.9):
    def unit(v):
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    near = lambda i, j: units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    label = smallest(len(rows), near)
    least = {}
    for (d, _), k in zip(rows, label):
        least[k] = min(least.get(k, 1 << 60), d)
    return sorted((d, sum(near(i, j) for j in range(len(rows)) if j != i), least[k], d == least[k]) for i, ((d, _), k) in enumerate(zip(rows, label)))


ODD_VECTORS = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [-1.0, 0.0, 0.0]),
    (8, [1.0, 0.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.1]), (10, [0.0, 1.0, 0.5]), (11, [float("inf"), 0.0, 0.0]), (12, [1.0, 0.0]), (13, []),
    (14, [0.9, 0.43588989, 0.0]),
]


@pytest.mark.parametrize("interval", [2, 5, 2048])
def test_embedding_links(spark, interval):
    odd = spark.createDataFrame([(i, v, "own", "own") for i, v in ODD_VECTORS], "vec_id bigint, embedding array<float>, rid string, part string")
    whole = table(spark, SMALL, "embeddings")
    for df in (odd, *([whole] if interval > 5 else [])):
        out = embed_dedup.near_duplicates(df, interval=interval).collect()
        rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == plain_links(rows)
    assert embed_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_links_of_extreme_vectors(spark):
    """Squares that underflow or overflow: cosine is that of the vectors all the same."""
    rows = [
        (1, [1e-200, 0.0, 0.0]), (2, [5e-324, 0.0, 0.0]), (3, [1e200, 0.0, 0.0]), (4, [1e200, 0.0, 0.0]), (5, [0.0, 1e-200, 1e-201]),
        (6, [0.0, 1e308, 1e307]), (7, [-1e308, 0.0, 0.0]), (8, [0.0, 0.0, 1.0]),
    ]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == plain_links(rows)


def test_blocks_lose_no_pair():
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(20, 16))
    x = (centre[:, None] + 0.2 * draw.normal(size=(20, 15, 16))).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.argsort(x[:, 0])]
    got = {(i, j) for a, b in embed_dedup.near_pairs(x, x, x[:, :8], x[:, :8], 0.9, True, block=7) for i, j in zip(a.tolist(), b.tolist())}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert got == set(zip(i.tolist(), j.tolist()))


def test_roots_of_edges_in_parts():
    labels = np.arange(3)
    for i, j in ((1, 2), (0, 2)):
        labels = roots(labels, np.array([i]), np.array([j]))
    assert labels.tolist() == [0, 0, 0]
    draw = np.random.default_rng(5)
    for size in (1, 7, 400):
        edges = draw.integers(0, 500, (400, 2))
        labels = np.arange(500)
        for at in range(0, len(edges), size):
            labels = roots(labels, edges[at : at + size, 0], edges[at : at + size, 1])
        linked = {(max(e), min(e)) for e in edges.tolist()}
        assert labels.tolist() == smallest(500, lambda i, j: (i, j) in linked)


def test_chains_of_vectors_in_many_blocks(spark):
    """Clusters whose members mostly link to their neighbours only: 3,000 vectors against brute force."""
    draw = np.random.default_rng(8)
    x = np.empty((3000, 12))
    for i in range(len(x)):
        x[i] = draw.normal(size=12) if i % 300 == 0 else x[i - 1] + 0.1 * draw.normal(size=12)
        x[i] /= np.linalg.norm(x[i])
    x = x[draw.permutation(len(x))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    near = x @ x.T >= 0.9
    label = smallest(len(x), lambda i, j: near[i, j])
    want = [(i, int(near[i].sum()) - 1, k, i == k) for i, k in enumerate(label)]
    for interval in (512, 2048):
        out = embed_dedup.near_duplicates(df, interval=interval).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == want


def test_one_row_of_each_component_stays(spark):
    """Null doc_ids, one doc_id for several texts, and a copy that shares its id with another text."""
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcde")
    rows = [
        (None, a, "x"), (None, b, "x"), (None, b, "x"), (None, c, "x"), (7, c, "x"), (5, d, "x"), (5, e, "x"), (5, e, "y"), (3, d, "x"),
        (None, None, "z"), (None, "", "z"), (None, "z", None),
    ]
    shape = "doc_id bigint, text string, source string"
    want = None
    for order in (rows, rows[::-1]):
        out = [tuple(r) for r in simhash.one_of_each(spark.createDataFrame(order, shape).repartition(3)).collect()]
        keyed = sorted(("" if t is None else t, -1 if i is None else i) for i, t, _ in out)
        assert keyed == sorted([(a, -1), (b, -1), (c, 7), (d, 3), (e, 5), ("", -1), ("z", -1)])
        assert want is None or sorted(out, key=str) == want
        want = sorted(out, key=str)


@pytest.mark.parametrize("slab", [3, 40, 100_000])
def test_slabs_lose_and_repeat_no_link(spark, slab):
    """Vectors that go to the tasks in several slabs link as in one, and none is shuffled to its partners."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 6))
    rows = [(n, [float(x) for x in centres[n % 12] + rng.normal(scale=0.15, size=6)]) for n in range(90)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (None, rows[5][1]), (202, [0.0] * 6), (203, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    out = embed_dedup.near_duplicates(df, interval=8, slab=slab)
    n_links = {}
    for r in out.collect():
        n_links.setdefault(r.vec_id, []).append(r.n_links)
    units = [np.array(v) / np.linalg.norm(v) if v and any(v) else None for _, v in rows]
    for i, (vec_id, _) in enumerate(rows):
        want = sum(units[i] is not None and u is not None and j != i and units[i] @ u >= 0.9 for j, u in enumerate(units))
        assert n_links[vec_id] == [want]
    assert embed_dedup.slabs([(2, 5), (0, 3), (1, 0)], 4) == [(0, 3), (2 << 33, (2 << 33) + 4), ((2 << 33) + 4, (2 << 33) + 5)]
    assert embed_dedup.slabs([(0, 2), (1, 2), (2, 1)], 4) == [(0, (1 << 33) + 2), (2 << 33, (2 << 33) + 1)]
