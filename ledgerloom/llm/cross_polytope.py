"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are lifted to one more dimension so that the largest inner product becomes the nearest unit
vector, padded to a power of two, and turned by three rounds of random signs and a fast Hadamard
transform. The signed axis a vector comes closest to is its bucket; every table has its own signs.
A query probes, in each table, the buckets of its closest axes; candidates are reranked by the inner
product of the original vectors in double precision.

The number of probes is fitted on SAMPLE queries: their exact neighbours among all rows are found by
one scan, and the probes are set so that TARGET of them share a probed bucket. All rows are indexed.
A query that found fewer than the nearest that are due asks again with twice the probes, up to all buckets.
A bucket with more than SLICE vectors, or asked by more than SLICE queries, is cut into slices on either
side; every pair of slices is searched by itself, a block of queries at a time.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part; a null vec_id is a candidate but no query; repeated rows are candidates of
their own, and a row is never its own candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.embed_dedup import matrix, numbered, unit, usable
from ledgerloom.operators.scale import stage

TABLES = 8
SLICE = 2048
#: Queries that a task multiplies at a time.
QUERY_BLOCK = 256
NEAREST = 20
#: Queries that the number of probes is fitted on, and the share of neighbours it is to reach.
SAMPLE = 128
TARGET = 0.95
SEED = 9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row, scaled to keep lengths."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def signs(dims: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables, 3, dims))


def lift(x: np.ndarray, peak: float, longest: float, dims: int) -> np.ndarray:
    """Candidates as unit vectors of ``dims`` dimensions: the spare length goes into one more dimension.

    peak: the largest component of all; longest: the greatest length of all, counted in peaks.
    """
    out = np.zeros((len(x), dims))
    out[:, : x.shape[1]] = x / peak / longest
    out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (out * out).sum(1)))
    return out


def turned(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for f in flips:
        x = hadamard(x * f)
    return x


def closeness(y: np.ndarray) -> np.ndarray:
    """How close each row is to every signed axis: bucket 2a is +axis a, 2a + 1 is -axis a."""
    return np.stack((y, -y), axis=2).reshape(len(y), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def top_rows(query: np.ndarray, rid: np.ndarray, vec: np.ndarray, x: np.ndarray, query_rid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, exact scores): the k nearest of x to every query, its own row left out."""
    # single precision picks, on rows scaled into its range; double precision on the vectors themselves decides
    scaled = x / max(np.abs(x).max(initial=0), 5e-324)
    fast, turn = scaled.astype(np.float32).T, unit(query)
    slack = 1e-5 * x.shape[1]
    for i in range(len(query)):
        if i % QUERY_BLOCK == 0:
            rough = turn[i : i + QUERY_BLOCK].astype(np.float32) @ fast
        row = rough[i % QUERY_BLOCK]
        if len(row) > k + 1:
            at = np.nonzero(row >= np.partition(row, len(row) - k - 1)[len(row) - k - 1] - slack)[0]
        else:
            at = np.arange(len(row))
        at = at[rid[at] != query_rid[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (x[at] * query[i]).sum(1)
        if not np.isfinite(exact).all():  # beyond doubles only the sign is left to tell
            sign = np.sign((scaled[at] * turn[i]).sum(1))
            exact = np.where(np.isfinite(exact), exact, np.where(sign == 0, 0.0, sign * np.inf))
        order = best(exact, vec[at], k)
        yield i, at[order], exact[order]


def fit_probes(sound: DataFrame, queries: DataFrame, peak: float, longest: float, flips: np.ndarray, nearest: int, sample: int, target: float) -> int:
    """Probes per table that reach the target share of the sample's exact neighbours."""
    picked = queries.orderBy(F.xxhash64("rid"), "rid").limit(sample).select("rid", "v").collect()
    asked = np.array([r["v"] for r in picked])
    asked_rid = np.array([r["rid"] for r in picked])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            q, at, score = [], [], []
            for i, where, exact in top_rows(asked, rid, rid, x, asked_rid, nearest):
                q += [i] * len(where)
                at += where.tolist()
                score += exact.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.float64()), batch.column(1).take(pa.array(at, pa.int64()))], ["q", "score", "v"])

    near = sound.select("rid", "v").mapInArrow(scan, "q int, score double, v array<double>")
    place = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = near.withColumn("n", F.row_number().over(place)).where(F.col("n") <= nearest).select("q", "v").collect()  # sample x nearest rows at most
    if not rows:
        return 1
    dims = flips.shape[-1]
    which, found = np.array([r["q"] for r in rows]), lift(np.array([r["v"] for r in rows]), peak, longest, dims)
    wide = np.zeros((len(asked), dims))
    wide[:, : asked.shape[1]] = unit(asked)
    least = np.full(len(rows), 2 * dims)
    for f in flips:
        bucket = closeness(turned(found, f)).argmax(1)
        order = np.argsort(np.argsort(-closeness(turned(wide, f)), axis=1, kind="stable"), axis=1)
        least = np.minimum(least, order[which, bucket])
    return int(np.quantile(least, target, method="higher")) + 1


def sliced(filed: DataFrame, probing: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries of each probed (bucket, slice, ask_slice): about ``slice_rows`` on either side, every pair meets once."""
    parts = lambda df, name: df.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias(name))
    sizes = stage(parts(filed, "slices").join(parts(probing, "ask_slices"), "bucket"))
    own = lambda name: F.pmod(F.xxhash64("rid"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    spread = lambda df: df.select("rid", "vec_id", "v", F.explode("buckets").alias("bucket")).join(sizes, "bucket")
    base = spread(filed).select("bucket", own("slices").alias("slice"), each("ask_slices").alias("ask_slice"), "rid", "vec_id", "v")
    asking = spread(probing).select("bucket", each("slices").alias("slice"), own("ask_slices").alias("ask_slice"), "rid", "vec_id", "v")
    return base, asking


def search(embeddings: DataFrame, every: int = 20, nearest: int = NEAREST, tables: int = TABLES, slice_rows: int = SLICE, sample: int = SAMPLE, target: float = TARGET, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found for every row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    sound = stage(usable(numbered(embeddings)))
    head = sound.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("peak")).first()
    if head["n"] is None:
        return spark.createDataFrame([], shape)
    peak = float(head["peak"])
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / peak) * (x / peak))
    longest = float(np.sqrt(sound.agg(F.max(square)).first()[0])) * (1 + 1e-12)
    dims = 1 << int(head["n"]).bit_length()
    flips = signs(dims, tables, seed)
    asked = sound.where(F.col("vec_id") % every == 0)
    probes = fit_probes(sound, asked, peak, longest, flips, nearest, sample, target)

    def hashes(query: bool, probes: int = 1, tables: int = tables):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(2))
                if query:
                    y = np.zeros((len(x), dims))
                    y[:, : x.shape[1]] = unit(x)
                else:
                    y = lift(x, peak, longest, dims) if len(x) else np.zeros((0, dims))
                found = []
                for t in range(tables):
                    near = closeness(turned(y, flips[t]))
                    if query:
                        found.append(np.argsort(-near, axis=1, kind="stable")[:, :probes] + t * 2 * dims)
                    else:
                        found.append(near.argmax(1)[:, None] + t * 2 * dims)
                found = np.concatenate(found, axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["rid", "vec_id", "v", "buckets"])

        return run

    columns = "rid bigint, vec_id bigint, v array<double>"
    filed = stage(sound.select("rid", "vec_id", "v").mapInArrow(hashes(False), f"{columns}, buckets array<int>"))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"rid": pa.int64(), "query_id": pa.int64(), "found": pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("rid", pa.int64())]))}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        rid, x = left.column("rid").to_numpy(), matrix(left.column("v"))
        vec = left.column("vec_id").fill_null(2**63 - 1).to_numpy()
        query, query_rid, names = matrix(right.column("v")), right.column("rid").to_numpy(), right.column("vec_id").to_numpy()
        which, offsets, at, scores = [], [0], [], []
        for i, where, exact in top_rows(query, rid, vec, x, query_rid, nearest):
            if len(where):
                which.append(i)
                at.append(where)
                scores.append(exact)
                offsets.append(offsets[-1] + len(where))
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        inner = pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else np.empty(0)), pa.array(vec[at]), pa.array(rid[at])], names=["score", "vec_id", "rid"])
        return pa.table({"rid": pa.array(query_rid[which], pa.int64()), "query_id": pa.array(names[which], pa.int64()), "found": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)})

    def merge(group: pa.Table) -> pa.Table:
        """One query: tables x probes x slices lists of ``nearest``; a row found in several tables has one exact score."""
        found = group.column("found").combine_chunks().flatten()
        rid, at = np.unique(found.field("rid").to_numpy(), return_index=True)
        score, vec = found.field("score").to_numpy()[at], found.field("vec_id").to_numpy()[at]
        order = np.lexsort((rid, vec, -score))[:nearest]
        vec = pa.array(vec[order], mask=vec[order] == 2**63 - 1)
        query = pa.array(np.full(len(order), group.column("query_id")[0].as_py()), pa.int64())
        return pa.table({"rid": pa.array(np.full(len(order), group.column("rid")[0].as_py()), pa.int64()), "query_id": query, "rank": pa.array(np.arange(1, len(order) + 1), pa.int32()), "vec_id": vec, "score": pa.array(score[order])})

    def found(asked: DataFrame, probes: int, tables: int) -> DataFrame:
        probing = stage(asked.select("rid", "vec_id", "v").mapInArrow(hashes(True, probes, tables), f"{columns}, buckets array<int>"))
        base, probing = sliced(filed, probing, slice_rows)
        hits = base.groupBy("bucket", "slice", "ask_slice").cogroup(probing.groupBy("bucket", "slice", "ask_slice")).applyInArrow(
            rerank, "rid bigint, query_id bigint, found array<struct<score double, vec_id bigint, rid bigint>>"
        )
        return stage(hits.groupBy("rid").applyInArrow(merge, f"rid bigint, {shape}"))

    due, out = min(nearest, head["rows"] - 1), spark.createDataFrame([], shape)
    while True:
        every_bucket = probes >= 2 * dims  # one table then holds each candidate once
        got = found(asked, min(probes, 2 * dims), 1 if every_bucket else tables)
        if every_bucket:
            break
        counts = got.groupBy("rid").agg(F.max("rank").alias("found"))
        short = stage(asked.join(counts, "rid", "left").where(F.coalesce("found", F.lit(0)) < due).select("rid", "vec_id", "v"))
        if short.isEmpty():
            break
        out = out.unionByName(got.join(short.select("rid"), "rid", "left_anti").drop("rid"))
        asked, probes = short, 2 * probes
    return out.unionByName(got.drop("rid"))
