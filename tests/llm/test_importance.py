import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import importance

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, min_words=20, buckets=10_000, longest=1):
    """(doc_id, n_features, weight, score, rank) rows by the definition, without any array or splitter."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text, longest)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    draws = percent * len(able) // 100
    return [(*r[:4], i + 1 if i < draws else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"percent": 37, "longest": 2, "buckets": 64}])
@pytest.mark.parametrize("segment_rows", [7, 8192])
def test_against_the_definition(docs, how, segment_rows):
    target = docs.where("doc_id % 11 = 3").select("text")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], **how)
    assert got(importance.resample(docs.repartition(5), target, segment_rows=segment_rows, **how)) == sorted(want, key=repr)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for min_words in (0, 2):
        want = plain(rows, ["own words", None, ""], percent=50, min_words=min_words)
        target = odd.sparkSession.createDataFrame([("own words",), (None,), ("",)], "text string")
        out = got(importance.resample(odd, target, percent=50, min_words=min_words, segment_rows=3))
        # rows that tie in doc_id and score may take each other's rank
        assert [r[:4] for r in out] == [r[:4] for r in sorted(want, key=repr)] and sorted(r[4] for r in out if r[4]) == sorted(r[4] for r in want if r[4])
    assert importance.resample(nothing, nothing.select("text")).count() == 0
    assert len(got(importance.resample(odd, nothing.select("text")))) == len(rows)
    whole = importance.drawn(odd, nothing.select("text"), percent=50, min_words=2)
    able = sum(features(t)[0] >= 2 for _, t in rows)
    assert whole.columns == odd.columns and whole.count() == able // 2 and {r.row for r in whole.collect()} == {"own row"}


def test_copies_are_spread_over_segments(spark):
    """A third of the rows tie in everything: ranks stay exact and no segment takes them all."""
    text = " ".join(f"w{i}" for i in range(30))
    copies = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    others = spark.range(8000).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit(text), F.lit(" x"), F.col("id").cast("string")).alias("text"))
    scored = importance.score(
        copies.unionByName(others).withColumn("row", F.lit(None).cast("long")),
        importance.gains(*[importance.bucket_counts(copies, 100, 1)] * 2), 1, "2024",
    ).withColumn("ranked", F.lit(True))
    ranked, rows = importance.rank(scored, 1000)
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert rows == 12000 and len(sizes) >= 12 and max(sizes) < 2000
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(1, 12001))
