"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

Distinct fingerprints are indexed three times, each time with another third of the bits in front: two
fingerprints that differ in at most two bits agree on at least one third. Rows with the same leading
third form a group; a group that is too large is indexed again inside, by thirds of its other bits,
until groups are small (fingerprints are distinct, so this ends). A task streams its groups, sorted by
Gray rank, and in each builds the upper nodes: runs of neighbours in Gray order with the bits that all
of them share. A query's differences against a node's shared bits prune the whole run; only runs that
survive compare members. What leaves a group is one edge per linked fingerprint, not its pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; copies share a fingerprint; a null doc_id is never a component's name unless all are null; an
empty table gives an empty result; further columns pass through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, roots, words_of
from ledgerloom.operators.scale import stage

SHINGLE = 3
SEED = 42
NEAR = 2
#: Fingerprints of one group that a task compares; larger groups are split by further bits.
GROUP = 512
#: Neighbours in Gray order under one upper node.
RUN = 16
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    stops = ends[min(size, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        cut = zip(starts[at : min(n, at + CHUNK)].tolist(), stops[at : at + CHUNK].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in cut], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.nonzero(2 * counts > n)[0].tolist())


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for every row, and its ``keys`` (longs); fp is the 64-bit pattern as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keys])

    shape = ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *keys))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(run, shape)


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray order."""
    rank = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def group_links(found: np.ndarray, near: int = NEAR, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest linked member) of distinct patterns, through the nodes of Gray-ordered runs."""
    found = found[np.argsort(gray_rank(found))]
    cuts = np.arange(0, len(found), run)
    ones, zeros = np.bitwise_and.reduceat(found, cuts), np.bitwise_and.reduceat(~found, cuts)
    shared = ones | zeros
    away = np.bitwise_count((found[:, None] ^ ones[None, :]) & shared[None, :])
    query, node = np.nonzero(away <= near)
    left, right = [], []
    for k in range(run):
        at = node * run + k
        ok = at < len(found)
        q, a = query[ok], at[ok]
        hit = (a > q) & (np.bitwise_count(found[q] ^ found[a]) <= near)
        left.append(q[hit])
        right.append(a[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    root = roots(np.arange(len(found)), left, right)
    linked = np.nonzero(root != np.arange(len(found)))[0]
    return found[linked], found[root[linked]]


#: Parts of a pattern's bits: each level cuts every free part's bits into three.
def thirds(bits: list[int]) -> list[list[int]]:
    k = len(bits)
    return [bits[k * i // 3 : k * (i + 1) // 3] for i in range(3)]


def index_groups(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """(path, lead, fp): rows of one (path, lead) may hold links; path names the leading bits, lead their values."""

    def split(rows: DataFrame, free: dict[str, list[int]]) -> tuple[DataFrame, dict[str, list[int]]]:
        parts, after = [], {}
        for path, bits in free.items():
            for i, part in enumerate(thirds(bits)):
                mask = sum(1 << b for b in part)
                mask = mask - (1 << 64) if mask >> 63 else mask
                parts.append((path, f"{path}{i}", mask))
                after[f"{path}{i}"] = [b for b in bits if b not in part]
        ways = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("path"), F.lit(m).cast("long").alias("mask")) for a, b, m in parts])
        wide = rows.select(F.col("path").alias("was"), F.col("lead").alias("had"), "fp", F.explode(F.filter(ways, lambda w: w["old"] == F.col("path"))).alias("way"))
        return wide.select(F.col("way.path").alias("path"), F.col("had").bitwiseOR(F.col("fp").bitwiseAND(F.col("way.mask"))).alias("lead"), "fp"), after

    rows, free = split(distinct.select(F.lit("").alias("path"), F.lit(0).cast("long").alias("lead"), "fp"), {"": list(range(64))})
    done = []
    while True:
        rows = stage(rows)
        sizes = stage(rows.groupBy("path", "lead").count().where(F.col("count") > 1))
        paired = rows.join(sizes, ["path", "lead"])
        done.append(paired.where(F.col("count") <= group).select("path", "lead", "fp"))
        large = sizes.where(F.col("count") > group).select("path").distinct()
        paths = [r[0] for r in large.collect()]  # names of bit masks: at most 3 per level of the index and path
        if not paths:
            break
        rows, free = split(paired.where(F.col("count") > group), {p: free[p] for p in paths})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def links(distinct: DataFrame, near: int = NEAR, group: int = GROUP) -> DataFrame:
    """(a, b): edges whose components are those of all fingerprints at ``near`` or fewer differing bits."""
    if near != NEAR:
        raise ValueError("the index has a third of the bits in front: it finds links of at most two bits")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, lead, held = None, None, []

        def close():
            a, b = group_links(np.concatenate(held)) if held else (np.empty(0, np.uint64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            paths, leads = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
            found = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.concatenate(([0], np.nonzero((paths[1:] != paths[:-1]) | (leads[1:] != leads[:-1]))[0] + 1, [len(found)]))
            for i, j in zip(cuts[:-1], cuts[1:]):
                if (paths[i], leads[i]) != (path, lead):
                    if held:
                        yield close()
                    path, lead, held = paths[i], leads[i], []
                held.append(found[i:j])
        if held:
            yield close()

    placed = index_groups(distinct, group)
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small rows with much work are not merged
    return placed.repartition(tasks, "path", "lead").sortWithinPartitions("path", "lead", "fp").mapInArrow(search, "a bigint, b bigint")


def named_groups(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) per fingerprint: root is the smallest fingerprint of its component, component_id the smallest doc_id."""
    named = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = stage(links(named.select("fp")))
    linked = components(edges).join(named, F.col("node") == F.col("fp")).select("node", "root", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("all_least"))
    tops = stage(linked.join(whole, "root").select("node", "root", "all_least"))
    return stage(named.join(tops, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("all_least", "least").alias("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable by links."""
    marked = stage(fingerprints(docs))
    return marked.join(named_groups(marked), "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, the first by doc_id (nulls last), fingerprint and hash of the row.

    A component is known by its smallest fingerprint, not by a doc_id: ids may be null or stand for several texts.
    """
    whole = [F.to_json(docs[c]) if "map<" in kind else docs[c] for c, kind in docs.dtypes]
    # Null flags go in as well, since the hash passes over nulls; rows with the same two hashes are the same row.
    mark = lambda i: F.xxhash64(F.lit(i), *[docs[c].isNull() for c in docs.columns], *whole)
    marked = stage(fingerprints(docs.select("doc_id", "text", mark(1).alias("h1"), mark(2).alias("h2")), keys=("h1", "h2")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "h1", "h2")
    firsts = marked.groupBy("fp").agg(F.min(order).alias("first"))
    kept = firsts.join(named_groups(marked), "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.h1", "first.h2")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), mark(1).alias("h1"), mark(2).alias("h2"))
    rows = held.join(stage(kept), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
