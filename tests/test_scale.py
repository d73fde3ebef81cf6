"""Splitting a hot key must not change a result: tiny limits against plain Python."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scale


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    hot = [("hot", rng.randint(0, 50), f"v{n:04d}") for n in range(900)]
    return hot + [("cold", rng.randint(0, 50), f"v{n:04d}") for n in range(40)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, x int, id string").repartition(4)


def test_hot_keys_are_cut_into_ordered_slices(frame):
    cut = scale.ordered_slices(frame, ["k"], ["x", "id"], target=50).collect()
    sizes = {}
    for r in cut:
        sizes[r.k, r._slice] = sizes.get((r.k, r._slice), 0) + 1
    assert len([s for s in sizes if s[0] == "hot"]) > 5 and {s[1] for s in sizes if s[0] == "cold"} == {0}
    ordered = sorted(((r.x, r.id, r._slice) for r in cut if r.k == "hot"))
    assert [s for *_x, s in ordered] == sorted(s for *_x, s in ordered)


@pytest.mark.parametrize("target", [10, 50, 10_000])
def test_rank_is_the_same_however_it_is_cut(frame, rows, target):
    got = {(r.k, r.id, r.x): r.n for r in scale.ranked(frame, ["k"], ["x", "id"], "n", target=target).collect()}
    for key in ("hot", "cold"):
        for n, (k, x, i) in enumerate(sorted(r for r in rows if r[0] == key), start=1):
            assert got[k, i, x] == n


def test_no_row_is_compared_with_a_list_of_cuts(frame):
    """However often a key is cut, the plan holds no array of cut points and forces no broadcast."""
    plan = scale.ranked(frame, ["k"], ["x", "id"], "n", target=10)._jdf.queryExecution().toString()
    assert "cuts" not in plan and "filter(" not in plan and "broadcast)" not in plan.lower()
    plan = scale.previous_row(frame, ["k"], ["x", "id"], "n", target=10)._jdf.queryExecution().toString()
    assert "filter(" not in plan and "strategy=broadcast" not in plan.lower()


def test_two_hot_keys_share_a_range(spark):
    """Slices are partitions of all hot keys together, so a key may begin in the middle of one."""
    rows = [(k, n % 7, f"{n:03d}") for k in ("a", "b", "c", None) for n in range(95)]
    df = spark.createDataFrame(rows, "k string, x int, id string").repartition(3)
    got = {(r.k, r.id): r.n for r in scale.ranked(df, ["k"], ["x", "id"], "n", target=40).collect()}
    for key in ("a", "b", "c", None):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]), start=1):
            assert got[key, i] == n


@pytest.mark.parametrize("target", [10, 10_000])
def test_previous_row_crosses_slices(frame, rows, target):
    got = {(r.k, r.id, r.x): r.p for r in scale.previous_row(frame, ["k"], ["x", "id"], "p", target=target).collect()}
    for key in ("hot", "cold"):
        before = None
        for k, x, i in sorted(r for r in rows if r[0] == key):
            p = got[k, i, x]
            assert (p and (p.x, p.id)) == before
            before = (x, i)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_join(spark, frame, how):
    sizes = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).where(F.col("k") == "hot")
    got = scale.salted_join(frame, sizes, ["k"], weight="n", salt_by=["id"], how=how, target=20)
    want = frame.join(sizes, ["k"], how)
    assert sorted(map(tuple, got.select("k", "id", "x", "top").collect()), key=str) == sorted(
        map(tuple, want.select("k", "id", "x", "top").collect()), key=str
    )


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    values = {"a": [int(10 ** rng.uniform(0, 11)) for _ in range(501)], "b": [5] * 10 + [7, 9], "c": [3]}
    cells = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long").groupBy("k", "v").agg(
        F.count(F.lit(1)).alias("w")
    )
    got = scale.exact_quantiles(cells, ["k"], "v", "w", scale.amount_bucket(F.col("v")), [0.1, 0.5, 0.9])
    for r in got.select("k", "n", *[scale.between(f"q{i}").alias(f"p{i}") for i in range(3)]).collect():
        assert r.n == len(values[r.k]) and r.p1 == pytest.approx(statistics.median(values[r.k]))
        for i, share in enumerate([0.1, 0.5, 0.9]):
            assert r[f"p{i}"] == pytest.approx(float(np.quantile(values[r.k], share)), rel=1e-12)


def test_buckets_keep_order(spark):
    df = spark.range(1, 200_000, 37).select(F.col("id"), scale.amount_bucket(F.col("id")).alias("b"), scale.spread_bucket(F.col("id") / 97.0 - 900).alias("s"))
    pairs = [(r.b, r.s) for r in df.orderBy("id").collect()]
    assert all(x[0] <= y[0] and x[1] <= y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert math.isfinite(pairs[-1][0])


def test_a_cluster_must_name_its_shared_folder(spark):
    assert scale.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
