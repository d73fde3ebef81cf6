"""Best-fit packing by linear grouping: few rounded sizes, configurations of them, real documents put in their place.

What is solved is a histogram of piece lengths, which has at most ``room`` rows whatever the corpus. Pieces
longer than ``small`` (and shorter than a sequence) are sorted and dealt to groups of equal cardinality; each group rounds up to its longest
piece. A linear programme over the configurations of these few sizes that fit a sequence is solved by column
generation, a knapsack finding each next configuration. Whole numbers of every configuration are laid out and
their places given to real pieces; the pieces left over and all small ones then go, longest first, to the
tightest room that takes them (best fit). Equal bins are handled as runs, so the plan says, for runs of pieces
of one length by their rank among that length, where they go.

Documents never meet in a task: a piece gets its rank from its place in its task and from the counts of the
tasks before, and its sequence by a look into the plan. Ids stay where they are.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays
null; an empty table gives no pieces; further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.packing import encoder
from ledgerloom.operators.scale import stage

LENGTH = 1024
#: Groups of equal cardinality, and the length up to which a piece counts as small.
GROUPS, SMALL = 256, 192
END_ID = 2
#: Column generation ends when the bound proves the programme solved to this share.
GAP = 5e-4
#: Rounds without a gain after which the programme is left as it is (what it holds is a solution all the same).
IDLE = 20


class Programme:
    """Least number of bins for rounded sizes: the linear programme over configurations, by column generation."""

    def __init__(self, sizes: list[int], wanted: list[int], room: int) -> None:
        self.sizes, self.room = np.array(sizes), room
        # slightly apart, so that no step of the programme stands still
        self.wanted = np.array(wanted) * (1 + 1e-5 * np.arange(1, len(wanted) + 1) / len(wanted))

    def configurations(self, price: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The configurations of the highest total price that hold each size, dearest first: one unbounded knapsack."""
        value = np.zeros(self.room + 1)
        choice = np.full(self.room + 1, -1)
        for i, (n, paid) in enumerate(zip(self.sizes.tolist(), price.tolist())):
            times = 1
            while times * n <= self.room:  # so many at once, then twice as many: any number comes about
                got = value[: -times * n] + times * paid
                better = got > value[times * n :] + 1e-12
                value[times * n :][better] = got[better]
                choice[times * n :][better] = i * 16 + times.bit_length()
                times *= 2
        found = []
        for i in np.argsort(-(value[self.room - self.sizes] + price), kind="stable").tolist():
            column, c = np.zeros(len(self.sizes)), self.room - int(self.sizes[i])
            column[i] += 1
            while choice[c] >= 0:
                k, times = choice[c] // 16, 1 << (choice[c] % 16 - 1)
                column[k] += times
                c -= times * int(self.sizes[k])
            found.append((float((price * column).sum()), column))
        return found

    def solve(self) -> list[tuple[np.ndarray, float]]:
        """(configuration, how many) of the optimum. Sums are written out: no threads of a linear algebra library on the driver."""
        k = len(self.sizes)
        basis = np.diag((self.room // self.sizes).astype(float))
        inverse = inverted(basis)
        amount = np.einsum("ij,j->i", inverse, self.wanted)
        turn, before, idle = 0, np.inf, 0
        while idle < IDLE:
            found = self.configurations(inverse.sum(axis=0))
            if max(worth for worth, _ in found) <= 1 + GAP:
                break
            idle = idle + 1 if amount.sum() > before * (1 - GAP / 100) else 0
            before = min(before, amount.sum())
            for _, column in found:
                if (inverse.sum(axis=0) * column).sum() <= 1 + GAP / 2:
                    continue  # no longer worth it at the prices that the others have brought about
                way = np.einsum("ij,j->i", inverse, column)
                ahead = way > 1e-7
                ratio = np.where(ahead, amount / np.where(ahead, way, 1), np.inf)
                out = int(np.where(ratio <= ratio.min() + 1e-9, way, 0).argmax())  # of equals, the steadiest to divide by
                basis[:, out] = column
                turn += 1
                if turn % 100 == 0:
                    inverse = inverted(basis)
                else:
                    row = inverse[out] / way[out]
                    inverse -= np.outer(way, row)
                    inverse[out] = row
                amount = np.maximum(np.einsum("ij,j->i", inverse, self.wanted), 0)
        return [(basis[:, j].astype(int), float(amount[j])) for j in range(k)]


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination, the largest element of each column going first."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for j in range(n):
        k = j + int(np.abs(both[j:, j]).argmax())
        both[[j, k]] = both[[k, j]]
        both[j] /= both[j, j]
        by = both[:, j].copy()
        by[j] = 0
        both -= np.outer(by, both[j])
    return both[:, n:]


class Plan:
    """Where runs of pieces go; bins are held as runs (first sequence, how many) by the room they have left."""

    def __init__(self, histogram: np.ndarray, room: int) -> None:
        self.left = histogram.astype(np.int64).copy()
        self.used = np.zeros(len(histogram), np.int64)
        self.room = room
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]
        self.bins = 0

    def new_bins(self, count: int) -> tuple[int, int]:
        first, self.bins = self.bins, self.bins + count
        return first, count

    def place(self, length: int, count: int, first: int, offset: int) -> None:
        """One piece of ``length`` into each of ``count`` sequences from ``first`` on."""
        self.rows.append((length, int(self.used[length]), count, first, offset))
        self.used[length] += count
        self.left[length] -= count

    def lay_out(self, configuration: list[tuple[int, int]], count: int, groups: list[list[list[int]]]) -> None:
        """``count`` bins of a configuration of (group, times), filled with what the groups really hold: [length, pieces]."""
        runs = [(*self.new_bins(count), 0)]
        for group, times in configuration:
            for _ in range(times):
                filled = []
                for first, many, fill in runs:
                    while many and groups[group]:
                        piece = groups[group][0]
                        n = min(many, piece[1])
                        self.place(piece[0], n, first, fill)
                        filled.append((first, n, fill + piece[0]))
                        first, many, piece[1] = first + n, many - n, piece[1] - n
                        if not piece[1]:
                            groups[group].pop(0)
                    if many:
                        filled.append((first, many, fill))
                runs = filled
        for first, many, fill in runs:
            self.open[self.room - fill].append((first, many))

    def best_fit(self) -> None:
        """All pieces left, longest first, each to the tightest room that takes it."""
        for length in range(self.room, 0, -1):
            while left := int(self.left[length]):
                free = next((f for f in range(length, self.room + 1) if self.open[f]), None)
                if free is None:
                    free, (first, many) = self.room, self.new_bins(-(-left // (self.room // length)))
                else:
                    first, many = self.open[free].pop()
                each = min(free // length, left)
                full = min(many, left // each)
                for i in range(each):
                    self.place(length, full, first, self.room - free + i * length)
                self.open[free - each * length].append((first, full))
                if many > full:
                    self.open[free].append((first + full, many - full))


def equal_groups(histogram: np.ndarray, small: int, groups: int) -> tuple[list[int], list[int], list[list[list[int]]]]:
    """Pieces above ``small``, longest first, in groups of equal cardinality: rounded sizes, numbers, contents.

    Groups that round to one length are one group. Pieces that fill a sequence need no configuration.
    """
    per_group = max(1, -(-int(histogram[small + 1 : -1].sum()) // groups))
    sizes: list[int] = []
    contents: list[list[list[int]]] = []
    space = 0
    for length in range(len(histogram) - 2, small, -1):
        left = int(histogram[length])
        while left:
            if not space:
                space = per_group
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    contents.append([])
            n = min(space, left)
            if contents[-1] and contents[-1][-1][0] == length:
                contents[-1][-1][1] += n
            else:
                contents[-1].append([length, n])
            space, left = space - n, left - n
    return sizes, [sum(n for _, n in c) for c in contents], contents


def plan(histogram: np.ndarray, small: int = SMALL, groups: int = GROUPS) -> Plan:
    """Where the pieces of a histogram (pieces by length, index 0 unused) go."""
    out = Plan(histogram, len(histogram) - 1)
    sizes, wanted, contents = equal_groups(histogram, small, groups)
    if sizes:
        for configuration, amount in Programme(sizes, wanted, out.room).solve():
            if count := int(amount + 1e-6):
                out.lay_out([(g, int(n)) for g, n in enumerate(configuration) if n], count, contents)
    out.best_fit()
    return out


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint, ids binary"


def cut(n: int, room: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all of ``room``, but for the first."""
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))]


def encode(docs: DataFrame, length: int, end_id: int, ranks: str, file: str) -> DataFrame:
    """The pieces of all documents, written to the shared folder, each with its place among its task's pieces of that length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make, task = encoder(ranks, file), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(make.ids(text or ""), np.uint32(end_id)).astype("<u4").tobytes()
                for i, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, i, start, n, zlib.crc32(part), task, int(seen[n]), part))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES))


def pack(
    docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, small: int = SMALL, groups: int = GROUPS, with_ids: bool = True,
    ranks: str = "byte_bpe_50k.tiktoken", file: str = "byte_bpe_50k.json",
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; with_ids adds the ids (little-endian unsigned 32-bit)."""
    pieces = encode(docs, length, end_id, ranks, file)
    counts = stage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        histogram[r.length] = r.n
    found = plan(histogram, small, groups)
    rows = np.array(sorted(found.rows), np.int64).reshape(-1, 5)
    spot, first_rank, first_sequence, at = (rows[:, 0] << 44) + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    if not with_ids:
        pieces = pieces.drop("ids")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place")).drop("task", "before", "place")
    kept = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids") if c in ranked.columns]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(spot, (n << 44) + rank, "right") - 1
            sequence, offset = (first_sequence[i] + rank - first_rank[i], at[i]) if len(n) else (n, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*kept).schema) + ", sequence_id bigint, offset bigint"
    return ranked.select(*kept, "rank").mapInArrow(placed, schema)
