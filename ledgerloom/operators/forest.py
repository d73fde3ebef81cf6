"""An isolation forest per ledger, fitted and scored as Spark jobs.

Each tree draws its own vouchers: those with the ``SAMPLE`` smallest hashes of (tree, voucher),
by the same rule in a ledger of any size. One ledger's fit is one small task on at most
``TREES * SAMPLE`` drawn rows. Scoring splits a ledger's vouchers by
hash into groups of at most ``SCORE_ROWS`` and meets the forest in a cogroup, so a ledger
holding most of the data is scored by as many tasks as it needs. Draws are by hash of the
voucher id: results do not depend on partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER
from ledgerloom.operators.scale import exact_quantiles, between, salted_join, spread_bucket, stage
from ledgerloom.operators.statistics import FEATURES, voucher_features

# Fixed values of the model.
TREES, SAMPLE, SEED = 200, 256, 20250906
MODEL_VERSION = "hash-isolation-forest-1"
TOP_FEATURES = 3
SCORE_ROWS = 100_000
#: Rows that walk down the trees together.
WALKERS = 4096

# How each feature is spoken about.
FEATURE_WORDS = {
    "log_amount": "the size of the amount",
    "line_count": "the number of lines",
    "first_digit": "the leading digit of the amount",
    "trailing_zeros": "how round the amount is",
    "is_round_thousand": "the amount being a round figure",
    "posting_hour": "the time of day it was entered",
    "has_posting_time": "whether a posting time was recorded",
    "day_of_week": "the day of the week",
    "days_to_year_end": "how close it falls to the year end",
    "posting_lag_days": "the delay between its date and its entry",
    "is_manual": "it being a manual entry",
    "is_post_close": "it being entered after the close",
    "has_evidence": "the absence of a supporting document",
    "evidence_coverage": "how few of its lines are documented",
    "has_approver": "whether it was approved",
    "account_pair_rarity": "how rarely these accounts appear together",
    "preparer_familiarity": "how rarely this preparer uses these accounts",
    "amount_deviation": "how far the amount sits from others on the account",
}

#: A ledger's whole forest as one row: heap-numbered node arrays, tree after tree.
FOREST = "ledger_id string, width int, feature binary, cut binary, depth binary"


def path_credit(n: int) -> float:
    """Average unsuccessful search length among ``n`` points: the depth a leaf stands for."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, float]]:
    """One random tree as heap-numbered nodes ``(node, feature or -1, cut, leaf depth)``."""
    nodes, todo = [], [(1, np.arange(len(rows)), 0)]
    while todo:
        node, members, depth = todo.pop()
        low, high = rows[members].min(axis=0), rows[members].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, depth + path_credit(len(members))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = rows[members, feature] <= cut
        nodes.append((node, feature, cut, 0.0))
        todo.append((2 * node, members[left], depth + 1))
        todo.append((2 * node + 1, members[~left], depth + 1))
    return nodes


def draws(features: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(features, tree): for each tree of a ledger the ``sample`` vouchers with the smallest hashes of (tree, voucher).

    A hash above twice the wanted share cannot be among them (that fewer lie below it has odds of
    1 to e^78, and would end the fit with an error), so about ``2 * trees * sample`` rows of a
    ledger, whatever its size, are sorted. No row is told apart by the size of its ledger.
    """
    share = F.lit(2.0 * sample) / F.col("n_vouchers")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "tree", *KEY), 11) / float(1 << 53)
    # Laid out as rows and tested in generated code: an array of draws would be built by an interpreted function.
    every = features.select(*KEY, "n_vouchers", *FEATURES, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = every.where(draw < share).withColumn("draw", draw)
    nth = Window.partitionBy(LEDGER, "tree").orderBy("draw", "voucher_id")
    return drawn.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= sample)


def fit_ledger(drawn: pd.DataFrame) -> pd.DataFrame:
    """All trees of one ledger, packed (about 1.5 MB), from the rows that its trees drew."""
    drawn = drawn.sort_values(["tree", "nth"], kind="mergesort")
    rows = drawn[FEATURES].to_numpy(dtype="float64")
    size = min(SAMPLE, int(drawn["n_vouchers"].iloc[0]))
    if len(rows) != TREES * size:
        raise ValueError(f"the trees drew {len(rows)} rows instead of {TREES * size}")
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    width = 2 ** (limit + 1)
    feature = np.full((TREES, width), -1, dtype="int8")
    cut, depth = np.zeros((TREES, width)), np.zeros((TREES, width), dtype="float32")
    for tree in range(TREES):
        rng = np.random.default_rng([SEED, tree])
        for node, on, at, leaf in grow(rows[tree * size : (tree + 1) * size], rng, limit):
            feature[tree, node], cut[tree, node], depth[tree, node] = on, at, leaf
    one = {"ledger_id": drawn["ledger_id"].iloc[0], "width": width, "feature": feature.tobytes(), "cut": cut.tobytes(), "depth": depth.tobytes()}
    return pd.DataFrame([one])


def depths(values: np.ndarray, packed: pd.Series) -> np.ndarray:
    """Sum of the leaf depths of every row over the trees, tree after tree.

    A leaf leads to itself, so all rows take as many steps as the tree is deep, and few enough
    rows walk at a time to stay in the cache.
    """
    width = int(packed["width"])
    feature = np.frombuffer(packed["feature"], dtype="int8").astype(np.intp)
    cut, depth = np.frombuffer(packed["cut"]), np.frombuffer(packed["depth"], dtype="float32")
    node, leaf = np.arange(TREES * width) % width, feature < 0
    left = np.where(leaf, np.arange(TREES * width), np.arange(TREES * width) + node)
    feature, cut = np.where(leaf, 0, feature), np.where(leaf, np.inf, cut)
    steps = [int(inner).bit_length() for inner in np.where(leaf, 0, node).reshape(TREES, width).max(axis=1)]
    total = np.zeros(len(values))
    for start in range(0, len(values), WALKERS):
        some = values[start : start + WALKERS]
        flat, row = some.ravel(), np.arange(len(some)) * some.shape[1]
        for tree in range(TREES):
            at = np.full(len(some), tree * width + 1)
            for _ in range(steps[tree]):
                at = left.take(at) + (flat.take(row + feature.take(at)) > cut.take(at))
            total[start : start + WALKERS] += depth.take(at)
    return total


def score_rows(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
    """Scores of one group of vouchers under its ledger's forest; higher is stranger."""
    values = rows[FEATURES].to_numpy(dtype="float64")
    total = depths(values, forest.iloc[0])
    size = int(rows["n_vouchers"].iloc[0]) if len(rows) else 2
    expected = path_credit(min(SAMPLE, max(size, 2)))
    score = np.power(2.0, -(total / TREES) / expected)
    return rows[["ledger_id", "voucher_id"]].assign(score=score)


def forest_scores(features: DataFrame) -> DataFrame:
    """Isolation score per voucher. ``features`` is read three times, so it should be a staged table."""
    forest = draws(features).groupBy(LEDGER).applyInPandas(fit_ledger, FOREST)
    groups = F.ceil(F.col("n_vouchers") / SCORE_ROWS).cast("int")
    rows = features.withColumn("part", F.pmod(F.xxhash64(*KEY), groups).cast("int"))
    sizes = features.groupBy(LEDGER).agg(F.max(groups).alias("parts"))
    copies = forest.join(sizes, LEDGER).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return (
        rows.groupBy(LEDGER, "part")
        .cogroup(copies.groupBy(LEDGER, "part"))
        .applyInPandas(score_rows, "ledger_id string, voucher_id string, score double")
    )


def score_thresholds(scores: DataFrame, times: DataFrame) -> DataFrame:
    """Per ledger the score above which its strangest share of vouchers lies.

    Ledgers may ask for different shares, so the share is a column: the rank is taken per
    ledger from the exact score ladder.
    """
    shares = times.select(LEDGER, "t_model_contamination", "n_vouchers")
    cells = scores.groupBy(LEDGER, "score").agg(F.count(F.lit(1)).alias("w"))
    bucketed = cells.withColumn("_b", F.floor(F.col("score") * 65536).cast("bigint"))
    along = Window.partitionBy(LEDGER).orderBy("_b")
    ladder = (
        bucketed.groupBy(LEDGER, "_b").agg(F.sum("w").alias("_c"))
        .withColumn("_end", F.sum("_c").over(along))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .join(shares, LEDGER)
    )
    spot = (1 - F.col("t_model_contamination")) * (F.col("n_vouchers") - 1)
    low, high = F.floor(spot), F.ceil(spot)
    held = lambda r, a, b: (r >= F.col(a)) & (r < F.col(b))
    wanted = ladder.where(held(low, "_start", "_end") | held(high, "_start", "_end"))
    inside = Window.partitionBy(LEDGER, "_b").orderBy("score")
    placed = (
        bucketed.join(wanted.drop("_c", "_end"), [LEDGER, "_b"])
        .withColumn("_to", F.col("_start") + F.sum("w").over(inside))
        .withColumn("_from", F.col("_to") - F.col("w"))
    )
    pick = lambda r: F.max(F.when(held(r, "_from", "_to"), F.col("score")))
    return placed.groupBy(LEDGER).agg(
        pick(low).alias("lo"), pick(high).alias("hi"), F.max(spot - low).alias("part")
    ).select(LEDGER, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("threshold"))


def feature_centres(features: DataFrame) -> DataFrame:
    """Per ledger: median and spread (population) of every feature, as two arrays."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("value")) for i, f in enumerate(FEATURES)])
    long = features.select(LEDGER, F.explode(pairs).alias("x")).groupBy(
        LEDGER, F.col("x.f").alias("f"), F.col("x.value").alias("value")
    ).agg(F.count(F.lit(1)).alias("w"))
    long = stage(long)
    medians = exact_quantiles(long, [LEDGER, "f"], "value", "w", spread_bucket(F.col("value")), [0.5]).select(
        LEDGER, F.struct("f", between("q0").alias("median")).alias("m")
    )
    mid = medians.groupBy(LEDGER).agg(F.array_sort(F.collect_list("m"))["median"].alias("medians"))
    spread = features.groupBy(LEDGER).agg(F.array(*[F.stddev_pop(f) for f in FEATURES]).alias("spreads"))
    return mid.join(spread, LEDGER)


def top_features(features: DataFrame, centres: DataFrame) -> DataFrame:
    """Per voucher the three features furthest from the ledger's median, in spread units."""
    joined = salted_join(
        features, centres.join(features.groupBy(LEDGER).agg(F.count(F.lit(1)).alias("_rows")), LEDGER),
        [LEDGER], weight="_rows", salt_by=["voucher_id"], how="inner",
    )
    far = [
        F.struct(
            (-F.round(F.coalesce(F.abs(F.col(f) - F.col("medians")[i]) / F.nullif(F.col("spreads")[i], F.lit(0.0)), F.lit(0.0)), 6)).alias("down"),
            F.lit(i).alias("i"),
            F.lit(f).alias("feature"),
            F.lit(FEATURE_WORDS[f]).alias("words"),
            F.col(f).alias("value"),
        )
        for i, f in enumerate(FEATURES)
    ]
    return joined.select(*KEY, F.slice(F.array_sort(F.array(*far)), 1, TOP_FEATURES).alias("top"))


def scored_features(frames) -> tuple[DataFrame, DataFrame]:
    """The features of every voucher, and its score with its ledger's threshold; worked out once for a book."""
    if getattr(frames, "_ml_scored", None) is None:
        features = stage(voucher_features(frames))
        scores = stage(forest_scores(features))
        limits = score_thresholds(scores, frames.times).join(frames.times.select(LEDGER, "n_vouchers", "t_model_contamination"), LEDGER)
        frames._ml_scored = features, salted_join(scores, limits, [LEDGER], weight="n_vouchers", salt_by=["voucher_id"], how="inner")
    return frames._ml_scored


def ml_scores(frames) -> DataFrame:
    """Scores with each ledger's threshold."""
    return scored_features(frames)[1]


def ml_anomaly_hits(frames) -> DataFrame:
    from ledgerloom.operators.signals import sparse_hits

    if getattr(frames, "_ml_hits", None) is not None:
        return frames._ml_hits
    features, scored = scored_features(frames)
    strange = scored.where(F.col("score") >= F.col("threshold"))
    chosen = features.join(strange.select(*KEY), KEY, "left_semi")
    top = top_features(chosen, feature_centres(features))
    score, limit = F.col("score"), F.col("threshold")
    words = F.transform("top", lambda x: x["words"])
    named = F.concat(F.array_join(F.slice(words, 1, TOP_FEATURES - 1), ", "), F.lit(" and "), F.element_at(words, -1))
    out = sparse_hits(
        strange.join(top, KEY),
        "ml_anomaly",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - limit) / F.greatest(limit, F.lit(1e-9)))),
        F.concat(F.lit("Statistically unusual against the rest of this ledger, mostly because of "), named, F.lit(".")),
        [
            F.lit(MODEL_VERSION).alias("model_version"),
            F.round(score, 4).alias("score"),
            F.round(limit, 4).alias("threshold"),
            F.col("t_model_contamination").alias("contamination"),
            F.transform("top", lambda x: F.struct(x["feature"].alias("feature"), F.round(x["value"], 3).alias("value"))).alias("top_features"),
        ],
    )
    frames._ml_hits = stage(out)
    return frames._ml_hits
