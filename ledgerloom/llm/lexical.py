"""Ranked lexical search: best-first document intervals over posting lists with range-maximum sparse tables.

Documents are indexed once, in shards of a bounded size whose documents are ordered by doc_id. A shard
answers all items of a block together: an interval of documents is bounded by the sum, over an item's
terms, of the largest impact that a term's list holds inside it (two lookups in a sparse table). The
interval with the highest bound goes first; it is split at the document with the largest single impact,
that document is scored exactly, and the two remaining parts get bounds of their own. An interval that
cannot reach the item's worst kept document is dropped; one that only ties it is dropped if all its
documents have larger ids. Only the kept documents of each task leave it.

Items come in blocks of about QUERY_TERMS (item, term) rows. A block is what the driver and every task
hold at a time, with its terms' weights; the index is read once per block.

Defined cases: a null or empty text has no term and is found by nothing; an item without a term that any
document holds gives no rows; every row counts as a document of its own, also if it repeats another; equal
scores are ordered by doc_id, null last; every row of items is answered, also if its item_id is null or
repeated; empty tables give no rows; further columns do not matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.scale import stage

TOP = 20
#: Documents, and bytes of text, after which a shard is closed.
SHARD_DOCS, SHARD_BYTES = 1 << 14, 1 << 26
#: (item, term) rows of a block of items, about.
QUERY_TERMS = 200_000
#: Intervals an item may have split in one round of the search.
WIDTH = 4
LAST = (1 << 63) - 1

#: bytes.translate table: digits, letters (A-Z lower-cased) and all of non-ASCII stay, the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(TERM_BYTES).split()


def texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


class Numbers(dict):
    """Numbers terms in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Shard:
    """Collects documents, then gives one index row: postings by term, documents by doc_id."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        self.number = Numbers()
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms_of(text)
        if words:
            self.ids.append(doc_id)
            self.words.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
            self.bytes += len(text or b"")

    def row(self) -> tuple:
        ids = np.array([LAST if i is None else i for i in self.ids], dtype="<i8")
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        lengths = np.array([len(w) for w in self.words], dtype="<i8")
        key = (np.concatenate(self.words).astype(np.int64) << 16) + np.repeat(place, lengths)
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tfs = np.diff(np.append(starts, len(key))).astype("<u4")
        key = key[starts]
        dfs = np.bincount(key >> 16, minlength=len(self.number)).astype("<u4")
        return (
            len(ids), int(lengths.sum()), ids[order].tobytes(), bytes(self.ids[i] is None for i in order), lengths[order].tobytes(),
            b" ".join(self.number), dfs.tobytes(), (key & 0xFFFF).astype("<u2").tobytes(), tfs.tobytes(),
        )


INDEX = "n_docs bigint, n_terms bigint, doc_ids binary, no_id binary, lengths binary, terms binary, dfs binary, docs binary, tfs binary"


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard of documents: its documents' ids and lengths, its terms, their postings."""
    if not 0 < shard_docs <= 1 << 16:
        raise ValueError("a shard holds 1 to 65,536 documents")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(shard: Shard) -> pa.RecordBatch:
            kinds = [pa.int64()] * 2 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(shard.row(), kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, 1)):
                shard.add(doc_id, text)
                if len(shard.ids) >= shard_docs or shard.bytes >= shard_bytes:
                    yield closed(shard)
                    shard = Shard()
        if shard.ids:
            yield closed(shard)

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, INDEX))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every (start, size), one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Lists:
    """Impact lists of a shard for the terms of a block, with sparse tables for their maxima."""

    def __init__(self, row: dict, number: dict[bytes, int], weight: np.ndarray, corpus_docs: int, corpus_terms: int) -> None:
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        self.no_id = np.frombuffer(row["no_id"], np.uint8)
        self.room = len(self.ids) + 1
        lengths = np.frombuffer(row["lengths"], "<i8")
        m = np.array([75 + 25 * n * corpus_docs // corpus_terms for n in lengths.tolist()], np.int64)
        dfs = np.frombuffer(row["dfs"], "<u4").astype(np.int64)
        starts = np.cumsum(dfs) - dfs
        found = [(number[t], i) for i, t in enumerate(row["terms"].split(b" ")) if t in number]
        found.sort()
        known = np.array([t for t, _ in found], np.int64)
        places = np.array([i for _, i in found], np.int64)
        #: Where a block's term stands among those of this shard, -1 if it is in none of its documents.
        self.local = np.full(len(weight), -1, np.int64)
        self.local[known] = np.arange(len(known))
        take = spread(starts[places], dfs[places])
        term = np.repeat(np.arange(len(known)), dfs[places])
        doc = np.frombuffer(row["docs"], "<u2")[take].astype(np.int64)
        tf = np.frombuffer(row["tfs"], "<u4")[take].astype(np.int64)
        self.impact = np.repeat(weight[known], dfs[places]) * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        self.doc = doc
        self.key = term * self.room + doc
        levels = [np.arange(len(doc), dtype=np.int32)]
        longest, step = int(dfs[places].max(initial=1)), 1
        while 2 * step <= longest:  # place of the largest impact among the 2 * step postings from here on
            low = levels[-1]
            high = low.copy()
            right = low[step:]
            better = self.impact[right] > self.impact[low[: len(right)]]
            high[: len(right)][better] = right[better]
            levels.append(high)
            step *= 2
        self.levels = np.stack(levels)

    def at(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where in a term's list the documents from ``doc`` on begin."""
        return np.searchsorted(self.key, term * self.room + doc)

    def highest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact in each non-empty range [a, b) of one list; the leftmost of equals."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        left, right = self.levels[level, a], self.levels[level, b - (1 << level)]
        return np.where(self.impact[right] > self.impact[left], right, left)


class Pool:
    """Flat rows (term of an item, its part [a, b) of the list) of the queued intervals."""

    def __init__(self) -> None:
        self.held = np.empty((3, 1 << 16), np.int32)
        self.used = 0

    def put(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
        start, self.used = self.used, self.used + len(rows)
        if self.used > self.held.shape[1]:
            grown = np.empty((3, 2 * self.used), np.int32)
            grown[:, :start] = self.held[:, :start]
            self.held = grown
        self.held[:, start : self.used] = rows, a, b
        return start


class Item:
    """The best documents of an item so far, over all shards of a task."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.best: list[tuple[int, int, bool]] = []  # (score, -doc_id, has no doc_id): the worst first

    def open_for(self, bound: int, least_id: int) -> bool:
        """Whether documents of at most this score and at least this id can still come in."""
        if len(self.best) < self.top:
            return bound > 0
        worst = self.best[0]
        return bound > worst[0] or bound == worst[0] and least_id < -worst[1]

    def add(self, score: int, doc_id: int, no_id: bool) -> None:
        if len(self.best) < self.top:
            heapq.heappush(self.best, (score, -doc_id, no_id))
        else:
            heapq.heappushpop(self.best, (score, -doc_id, no_id))


def best_first(lists: Lists, terms: list[tuple[np.ndarray, np.ndarray]], items: list[Item], width: int = WIDTH) -> int:
    """Bring a shard's documents into the items' best. terms: per item, the block's term numbers and repeats.

    All items take part in a round, each with its ``width`` most promising intervals, so that the lookups of
    a round are a few array operations. Gives the number of documents scored.
    """
    local = [(lists.local[t][here], n[here]) for t, n in terms for here in [lists.local[t] >= 0]]
    size = np.array([len(t) for t, _ in local], np.int64)
    first = np.cumsum(size) - size
    every = np.flatnonzero(size > 0)
    if not len(every):
        return 0
    term = np.concatenate([t for t, _ in local])
    times = np.concatenate([n for _, n in local])
    pool = Pool()
    #: Per item: (-bound, first document, end, document to split at, where its rows are in the pool, how many).
    queues: list[list[tuple[int, ...]]] = [[] for _ in items]

    def queue(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Bound the intervals [lo, hi) and queue them. rows, a, b: their terms and parts of the lists, owner by owner."""
        some = b > a
        rows, owner, a, b = rows[some], owner[some], a[some], b[some]
        if not len(rows):
            return
        spot = lists.highest(a, b)
        most = lists.impact[spot] * times[rows]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(owner)))
        bound = np.add.reduceat(most, starts)
        top = np.repeat(np.maximum.reduceat(most, starts), sizes)
        split = np.minimum.reduceat(np.where(most == top, lists.doc[spot], lists.room), starts)
        at = pool.put(rows, a, b)
        own = owner[starts]
        for i, x, l, h, s, start, n in zip(item[own].tolist(), bound.tolist(), lo[own].tolist(), hi[own].tolist(), split.tolist(), (at + starts).tolist(), sizes.tolist()):
            if items[i].open_for(x, ids[l]):
                heapq.heappush(queues[i], (-x, l, h, s, start, n))

    ids = lists.ids.tolist()
    rows, owner = spread(first[every], size[every]), np.repeat(np.arange(len(every)), size[every])
    lo, hi = np.zeros(len(every), np.int64), np.full(len(every), lists.room - 1)
    queue(every, lo, hi, rows, owner, lists.at(term[rows], lo[owner]), lists.at(term[rows], hi[owner]))
    scored, active = 0, every.tolist()
    while active:
        chosen = []
        for i in active:
            waiting, item = queues[i], items[i]
            for _ in range(min(width, len(waiting))):
                bound, l, h, s, start, n = heapq.heappop(waiting)
                if item.open_for(-bound, ids[l]):
                    chosen.append((i, l, h, s, start, n))
                elif -bound < item.best[0][0]:
                    waiting.clear()  # all others are bounded lower still
                    break
        if chosen:
            item, lo, hi, split, start, n = np.array(chosen, np.int64).T
            rows, a, b = pool.held[:, spread(start, n)].astype(np.int64)
            owner = np.repeat(np.arange(len(item)), n)
            mid = lists.at(term[rows], split[owner])
            hit = (mid < b) & (lists.doc[np.minimum(mid, b - 1)] == split[owner])
            score = np.add.reduceat(np.where(hit, lists.impact[np.minimum(mid, b - 1)] * times[rows], 0), np.cumsum(n) - n)
            for i, x, s in zip(item.tolist(), score.tolist(), split.tolist()):
                items[i].add(x, ids[s], bool(lists.no_id[s]))
            scored += len(item)
            queue(
                np.concatenate([item, item]), np.concatenate([lo, split + 1]), np.concatenate([split, hi]), np.concatenate([rows, rows]),
                np.concatenate([owner, owner + len(item)]), np.concatenate([a, mid + hit]), np.concatenate([mid, b]),
            )
        active = [i for i in active if queues[i]]
    return scored


def search(items: DataFrame, docs: DataFrame, top: int = TOP, query_terms: int = QUERY_TERMS, **how) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``top`` best documents. how: see build_index."""
    index = build_index(docs, **how)
    corpus = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    corpus_docs, corpus_terms = int(corpus[0] or 0), int(corpus[1] or 0)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(terms_of(t)) for t in texts(batch, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b" ".join(c) for c in held], pa.binary()), pa.array([np.array(list(c.values()), "<i8").tobytes() for c in held], pa.binary()), pa.array([len(c) for c in held], pa.int64())],
                names=["item_no", "item_id", "terms", "times", "n"],
            )

    id_type = items.schema["item_id"].dataType.simpleString()
    numbered = stage(items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "text"))
    queries = stage(numbered.mapInArrow(asked, f"item_no bigint, item_id {id_type}, terms binary, times binary, n bigint").where("n > 0"))
    blocks = max(1, -(-(queries.agg(F.sum("n")).first()[0] or 0) // query_terms))
    found = None
    for block in range(blocks if corpus_docs else 0):
        part = search_block(queries.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == block), index, corpus_docs, corpus_terms, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.selectExpr("item_no", "cast(null as bigint) as doc_id", "cast(null as bigint) as score").limit(0)
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(numbered.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


def search_block(block: DataFrame, index: DataFrame, corpus_docs: int, corpus_terms: int, top: int) -> DataFrame:
    """The best documents of every task for the items of one block: (item_no, doc_id, score)."""
    asked = [(r.item_no, r.terms.split(b" "), np.frombuffer(r.times, "<i8")) for r in block.select("item_no", "terms", "times").collect()]
    number: dict[bytes, int] = {}
    queries = [(no, np.array([number.setdefault(bytes(t), len(number)) for t in terms], np.int64), times) for no, terms, times in asked]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t, n in zip(terms.split(b" "), np.frombuffer(dfs, "<u4").tolist()):
                    if t in number:
                        df[number[t]] += n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    weight = np.zeros(len(number), np.int64)
    for r in index.select("terms", "dfs").mapInArrow(held, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weight[r.term] = math.floor(1000 * math.log((2 * corpus_docs + 2) / (2 * r.df + 1)))
    # a term of weight 0 adds nothing to any score
    weighed = [(no, t[weight[t] > 0], n[weight[t] > 0]) for no, t, n in queries]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(top) for _ in weighed]
        for batch in batches:
            for row in batch.to_pylist():
                best_first(Lists(row, number, weight, corpus_docs, corpus_terms), [(t, n) for _, t, n in weighed], items)
        rows = [(no, None if no_id else -doc, score) for (no, _, _), item in zip(weighed, items) for score, doc, no_id in item.best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_no", "doc_id", "score"])

    return index.mapInArrow(answered, "item_no bigint, doc_id bigint, score bigint")
