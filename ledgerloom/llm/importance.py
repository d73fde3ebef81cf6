"""Importance resampling towards a target: weights from arrays of bucket gains, ranks by regular sampling.

Runs of words are hashed into buckets. Bucket counts of all documents and of the target give each bucket a
gain, an array of ``buckets`` numbers that every task holds, and a document's weight is the floored mean of
the gains of its features. A Gumbel noise drawn from the doc_id is added, so that the highest scores are a
weighted draw without replacement.

Ranks come from a sort by regular sampling: every task writes its scores as a sorted run; runs give samples at
a regular stride, the sorted samples give regular splitters, each row goes to the segment between its
splitters, segments are sorted where they arrive, and the counts of the segments before give exact ranks.
No segment depends on one value: rows that tie in everything are told apart by their place in their run.

Defined cases: a null or empty text has no feature, weight 0 and no rank; a null doc_id draws its noise from
the empty string and comes after all others of its score; rows that repeat a doc_id are documents of their
own, and of equal scores the one with fewer features, then the smaller text hash, comes first; without a
target all counts t are 0; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scale import stage

BUCKETS, LONGEST = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: Rows a segment is made for, segments at most, and samples a segment takes part with.
SEGMENT_ROWS, SEGMENTS, SAMPLES = 8192, 4096, 64
#: monotonically_increasing_id holds the task above these bits and the row below.
ROW_BITS = 33

#: bytes.translate table: digits, letters (A-Z lower-cased) and all of non-ASCII stay, the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_of(text: bytes | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words of a text in UTF-8, and the bucket of every run of 1 to ``longest`` consecutive words."""
    words = (text or b"").translate(WORD_BYTES).split()
    runs = [words] + [[b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, longest + 1)]
    return len(words), np.concatenate([np.fromiter(map(zlib.crc32, r), np.uint32, len(r)) for r in runs]) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket: every task counts into one array, at most ``buckets`` rows reach the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(buckets_of(text, buckets, longest)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths of a nat."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, longest: int, seed: str) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, text_key) of rows that have row, doc_id and text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_pylist()
            words, features, weight, total = [], [], [], []
            for doc_id, text in zip(ids, batch.column(2).cast(pa.binary()).to_pylist()):
                n, found = buckets_of(text, len(gain), longest)
                words.append(n)
                features.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
                total.append(weight[-1] + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (words, features, weight, total)), batch.column(3)],
                names=["row", "doc_id", "n_words", "n_features", "weight", "score", "text_key"],
            )

    kept = docs.select("row", F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return kept.mapInArrow(scored, "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint, text_key bigint")


def spot(score: int, doc_id: int | None, features: int, text_key: int, place: int) -> tuple:
    """Where a row stands: by falling score, then doc_id (null last), features, text, and place in the runs."""
    return -score, doc_id is None, doc_id or 0, features, text_key, place


def rank(scored: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, int]:
    """scored with ``rank`` (1, 2, 3...) of the rows that ``ranked`` marks, null for the others; how many are marked."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "text_key", "place"]
    runs = stage(scored.sortWithinPartitions(~F.col("ranked"), *order[:4]).withColumn("place", F.monotonically_increasing_id()))
    among = runs.where("ranked")
    rows = among.count()
    segments = min(SEGMENTS, max(1, -(-rows // segment_rows)))
    stride = max(1, rows // (SAMPLES * segments))
    # a regular sample of each run; short runs begin at a place of their own, so that they count by their length
    run, at = F.shiftright("place", ROW_BITS), F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sample = among.where(F.pmod(at + F.xxhash64(run).bitwiseAND(F.lit((1 << 31) - 1)), F.lit(stride)) == 0)
    samples = sorted(spot(*r) for r in sample.select("score", "doc_id", "n_features", "text_key", "place").collect())
    splitters = [samples[i * len(samples) // segments] for i in range(1, segments)] if samples else []

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = [names.index(c) for c in ("score", "doc_id", "n_features", "text_key", "place")]
        for batch in batches:
            where = [bisect_right(splitters, spot(*r)) for r in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], names=[*names, "segment"])

    names = among.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in among.schema) + ", segment int"
    dealt = among.mapInArrow(sent, schema)
    held = np.zeros(len(splitters) + 1, np.int64)
    for r in dealt.groupBy("segment").count().collect():  # at most SEGMENTS rows
        held[r["segment"]] = r["count"]
    before = (np.cumsum(held) - held).tolist()
    # segment i is partition i, so a row's place in its partition is its place in the segment
    sorted_segments = dealt.repartitionById(len(held), "segment").sortWithinPartitions(*order)
    placed = sorted_segments.withColumn("here", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    offset = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("segment") + 1)
    kept = [c for c in names if c not in ("place", "ranked")]
    others = runs.where("not ranked").select(*kept, F.lit(None).cast("long").alias("rank"))
    return placed.select(*kept, (offset + F.col("here") + 1).alias("rank")).unionByName(others), rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST,
    seed: str = SEED, segment_rows: int = SEGMENT_ROWS, row: str | None = None,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, row) of every document; rank null if not drawn, row from the column so named."""
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    number = (F.col(row) if row else F.lit(None)).cast("long").alias("row")
    scored = score(docs.select(number, "doc_id", "text"), gain, longest, seed)
    ranked, rows = rank(scored.withColumn("ranked", F.col("n_words") >= min_words), segment_rows)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= percent * rows // 100, F.col("rank")).alias("rank"), "row")


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, all columns as they are."""
    name = "row"
    while name in docs.columns:
        name += "_"
    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()))
    rows = resample(numbered, target, row=name, **how).where("rank is not null")
    return numbered.join(rows.select(F.col("row").alias(name)), name, "left_semi").select(*[numbered[c] for c in docs.columns])
