"""Building blocks that stay correct and spread out when one key holds much of the data.

Nothing here collects a group: hot groups are dealt by range or salted. Only the list of
hot keys of a salted join is broadcast: at most rows in the job / HOT_ROWS of them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key that one task is asked to handle before the key is split.
HOT_ROWS = 200_000


#: Bytes of code above which the JVM leaves a method to its interpreter.
COMPILED_METHOD = "8000"


def stage(df: DataFrame, *, wide: bool = False) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back.

    The table cuts the lineage (plans stay short, a lost executor costs a file read, not a
    recomputation), keeps columns prunable and tells the optimizer its real size.

    ``wide`` is for frames that work out many columns from text: fused into one generated method
    they would be interpreted row by row, so for this write such methods are not fused.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    limit = "spark.sql.codegen.hugeMethodLimit"
    usual = spark.conf.get(limit)
    if wide:
        spark.conf.set(limit, COMPILED_METHOD)
    try:
        df.write.parquet(path)
    finally:
        if wide:
            spark.conf.set(limit, usual)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    A local master (tests) falls back to a fresh temporary folder; a cluster must set it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    weight: str,
    salt_by: Sequence[str],
    how: str = "left",
    target: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join a large side to a per-key table that knows how many large-side rows each key has.

    ``right`` has one row per key and a ``weight`` column with that count. Keys above
    ``target`` are salted: their right row is copied once per salt and the left rows are
    spread over the salts by hash. The list of hot keys has at most
    ``total weight / target`` rows, which is what bounds the broadcast. ``sizes`` may name a
    cheaper frame than ``right`` that holds the keys and the weight.
    """
    target = target or HOT_ROWS
    fan = F.ceil(F.col(weight) / F.lit(target)).cast("int")
    known = right if sizes is None else sizes
    hot = known.where(F.col(weight) > target).select(*on, fan.alias("_fan"))
    spread = F.pmod(F.xxhash64(*salt_by), F.coalesce(F.col("_fan"), F.lit(1)))
    salted = left.join(F.broadcast(hot), list(on), "left").withColumn("_salt", spread.cast("int")).drop("_fan")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(fan, F.lit(1)) - 1)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def cut_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target: int | None = None
) -> tuple[DataFrame, bool]:
    """df with ``_slice``, and whether any key was cut.

    Keys with at most ``target`` rows stay whole (slice 0). The rows of all others are dealt by
    range of (keys, order) to as many partitions as they need, and the partition is the slice:
    sampled splitters, not a list of cut points that every row would have to be compared with.
    The dealt rows are written once, so that a slice holds the same rows in every job after it.
    """
    target = target or HOT_ROWS
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target)
    rows = sizes.agg(F.sum("_n")).first()[0]
    if rows is None:
        return df.withColumn("_slice", F.lit(0)), False
    hot = stage(sizes.select(*keys))
    ranged = df.join(hot, list(keys), "left_semi").repartitionByRange(-(-rows // target), *keys, *order)
    dealt = stage(ranged.withColumn("_slice", F.spark_partition_id()))
    whole = df.join(hot, list(keys), "left_anti").withColumn("_slice", F.lit(0))
    return whole.unionByName(dealt), True


def ordered_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, target: int | None = None
) -> DataFrame:
    """Add ``_slice``: a cut of each hot key's rows into runs that follow ``order``.

    ``order`` must be ascending and unique within a key.
    """
    return cut_by_range(df, keys, order, target)[0]


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, target: int | None = None
) -> DataFrame:
    """Row number 1..n within ``keys`` following ``order``, also for a key of any size.

    A row's number is its number in its slice plus the rows in the slices before.
    """
    sliced, cut = cut_by_range(df, keys, order, target)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn(name, F.row_number().over(inside).cast("bigint"))
    if not cut:
        return numbered.drop("_slice")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_off", F.sum("_c").over(earlier)).where(F.col("_off") > 0).drop("_c")
    return (
        numbered.join(offsets, [*keys, "_slice"], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_off"), F.lit(0)))
        .drop("_off", "_slice")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    target: int | None = None,
) -> DataFrame:
    """Add ``name``: the ``order`` columns of the row before this one, as a struct."""
    sliced, cut = cut_by_range(df, keys, order, target)
    spot = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    lagged = sliced.withColumn(name, F.lag(spot).over(inside))
    if not cut:
        return lagged.drop("_slice")
    ends = sliced.groupBy(*keys, "_slice").agg(F.max(spot).alias("_end"))
    along = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.withColumn("_carry", F.lag("_end").over(along)).where(F.col("_carry").isNotNull()).drop("_end")
    return (
        lagged.join(carried, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_carry")))
        .drop("_carry", "_slice")
    )


def amount_bucket(amount: Column) -> Column:
    """Order-preserving bucket of a positive integer: at most 4,096 per power of two."""
    size = F.greatest(amount, F.lit(1)).cast("double")
    return F.floor(F.log2(size) * 4096).cast("bigint")


def spread_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double, fine near zero and relative further out."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1e6) * 4096).cast("bigint")


def exact_quantiles(
    cells: DataFrame, keys: Sequence[str], value: str, weight: str, bucket: Column, shares: Sequence[float]
) -> DataFrame:
    """Exact quantiles per key, from ``(keys, value, weight)`` cells, without gathering a key.

    The cells are first counted in order-preserving buckets, a running count over the
    buckets finds the few buckets that hold the wanted ranks, and only those are sorted.
    Result: keys, ``n`` and one struct ``q0``, ``q1``... per share with the neighbouring
    values ``lo``, ``hi`` and the fraction between them.
    """
    keys = list(keys)
    spots = [F.lit(share) * (F.col("_n") - 1) for share in shares]
    ranks = [r for s in spots for r in (F.floor(s), F.ceil(s))]
    cells = cells.withColumn("_b", bucket)
    counted = cells.groupBy(*keys, "_b").agg(F.sum(weight).alias("_c"))
    along = Window.partitionBy(*keys).orderBy("_b")
    whole = Window.partitionBy(*keys)
    ladder = (
        counted.withColumn("_end", F.sum("_c").over(along))
        .withColumn("_n", F.sum("_c").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    holds = None
    for r in ranks:
        one = (r >= F.col("_start")) & (r < F.col("_end"))
        holds = one if holds is None else holds | one
    wanted = ladder.where(holds).select(*keys, "_b", "_n", "_start")
    inside = Window.partitionBy(*keys, "_b").orderBy(value)
    placed = (
        cells.join(wanted, [*keys, "_b"])
        .withColumn("_to", F.col("_start") + F.sum(weight).over(inside))
        .withColumn("_from", F.col("_to") - F.col(weight))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col(value)))

    picked = placed.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(r).alias(f"_r{i}") for i, r in enumerate(ranks)],
    )
    return picked.select(
        *keys,
        F.col("_n").alias("n"),
        *[
            F.struct(
                F.col(f"_r{2 * i}").alias("lo"),
                F.col(f"_r{2 * i + 1}").alias("hi"),
                (spots[i] - F.floor(spots[i])).alias("part"),
            ).alias(f"q{i}")
            for i in range(len(shares))
        ],
    )


def between(q: str) -> Column:
    """Linear interpolation of one ``exact_quantiles`` struct."""
    lo, hi, part = F.col(f"{q}.lo"), F.col(f"{q}.hi"), F.col(f"{q}.part")
    return lo + (hi - lo) * part
