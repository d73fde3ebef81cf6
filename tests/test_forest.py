"""The forest draws by one rule at every size, and a ledger's scores do not depend on its neighbours."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.config import KEY, LEDGER
from ledgerloom.operators import forest
from ledgerloom.operators.statistics import FEATURES


def features_of(spark, ledger, n):
    """n vouchers with hash-drawn features; the first is far from all others."""
    value = lambda i: F.when(F.col("id") == 0, 50.0).otherwise(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000)
    return spark.range(n).select(
        F.lit(ledger).alias(LEDGER), F.format_string("V%07d", "id").alias("voucher_id"), F.lit(n).cast("bigint").alias("n_vouchers"),
        *[value(i).alias(f) for i, f in enumerate(FEATURES)],
    )


@pytest.mark.parametrize("n, trees", [(40, 200), (1_000, 200), (200_000, 5)])
def test_trees_draw_the_smallest_hashes(spark, n, trees):
    table = features_of(spark, "L", n)
    pairs = table.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn(
        "h", F.shiftrightunsigned(F.xxhash64(F.lit(forest.SEED), "tree", *KEY), 11) / float(1 << 53)
    )
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("h", "voucher_id"))
    plain = {(r.tree, r.voucher_id) for r in pairs.withColumn("n", nth).where(F.col("n") <= forest.SAMPLE).select("tree", "voucher_id").collect()}
    got = forest.draws(table.repartition(7), trees).select("tree", "voucher_id").collect()
    assert len(got) == len(plain) == trees * min(n, forest.SAMPLE) and {(r.tree, r.voucher_id) for r in got} == plain


def test_a_ledger_scores_the_same_alone_and_among_others(spark):
    one, two = features_of(spark, "A", 700), features_of(spark, "B", 300)
    alone = {r.voucher_id: r.score for r in forest.forest_scores(one).collect()}
    both = {(r.ledger_id, r.voucher_id): r.score for r in forest.forest_scores(one.unionByName(two).repartition(5)).collect()}
    assert len(alone) == 700 and all(both["A", v] == s for v, s in alone.items()) and len(both) == 1000
    assert max(alone, key=alone.get) == "V0000000" and alone["V0000000"] > 0.6 > np.median(list(alone.values()))


def test_too_few_draws_are_an_error(spark):
    rows = forest.draws(features_of(spark, "A", 300)).toPandas()
    with pytest.raises(ValueError, match="drew"):
        forest.fit_ledger(rows.iloc[1:])


def test_draws_are_rows_of_generated_code(spark):
    """No array of all draws is built and filtered by an interpreted function."""
    plan = forest.draws(features_of(spark, "A", 300))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "lambdafunction" not in plan


def test_rows_walk_as_they_would_alone(spark, monkeypatch):
    """Few rows at a time or many, and a plain walk node by node, give the same depths."""
    table = features_of(spark, "A", 300)
    packed = forest.fit_ledger(forest.draws(table).toPandas()).iloc[0]
    values = table.select(*FEATURES).toPandas().to_numpy(dtype="float64")
    values[3, 2], values[4, 1] = np.nan, np.inf
    shape = (forest.TREES, packed["width"])
    feature, cut = np.frombuffer(packed["feature"], dtype="int8").reshape(shape), np.frombuffer(packed["cut"]).reshape(shape)
    depth = np.frombuffer(packed["depth"], dtype="float32").reshape(shape)

    def alone(row):
        total = 0.0
        for tree in range(forest.TREES):
            node = 1
            while feature[tree, node] >= 0:
                node = 2 * node + int(row[feature[tree, node]] > cut[tree, node])
            total += float(depth[tree, node])
        return total

    want = [alone(row) for row in values[:20]]
    assert forest.depths(values, packed)[:20].tolist() == want
    monkeypatch.setattr(forest, "WALKERS", 7)
    assert forest.depths(values, packed)[:20].tolist() == want and len(forest.depths(values[:0], packed)) == 0
