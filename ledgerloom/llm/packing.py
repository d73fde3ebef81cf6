"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to groups by hash, so a group has a bounded expected number of them and any group
packs alone. The hash takes in which of its copies a row is, so copies of one row spread over all groups
like other rows: a task numbers the copies it reads and adds its own number. The rows of a lost task fall
to the same groups when it runs again, in whatever order it then reads them. In a group every document gives its full sequences and one remainder; remainders go,
longest first, to the leftmost bin with room, found by walking a tree whose nodes hold the largest
free room below them. What first-fit leaves open is then filled by cutting up the emptiest bins, and
the one bin left over is cut into lengths that are powers of two.

Ids come from the rank form of the same vocabulary (equal ids, checked by the tests); the tokenizer
file itself takes over for a text that the rank form cannot handle.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table
gives no pieces; further columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
#: Documents in a group, on average.
GROUP_DOCS = 1024
SPECIAL = "<|endoftext|>"

_loaded: dict[tuple[str, str], object] = {}


class Encoder:
    """Token ids of the byte-level vocabulary; built once per worker."""

    def __init__(self, ranks: str = "byte_bpe_50k.tiktoken", file: str = "byte_bpe_50k.json") -> None:
        import public_tokenizers
        import tiktoken

        self.file = public_tokenizers.path(file)
        with open(public_tokenizers.path(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(merges)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.slow = None

    def plain(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the rank form's pattern engine gives up on some very long runs, outside Exception
            from tokenizers import Tokenizer

            self.slow = self.slow or Tokenizer.from_file(self.file)
            return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return np.array(self.plain(text), dtype=np.uint32)
        out: list[int] = []
        for n, part in enumerate(text.split(SPECIAL)):
            out += [self.special] * (n > 0) + self.plain(part)
        return np.array(out, dtype=np.uint32)


def encoder(ranks: str = "byte_bpe_50k.tiktoken", file: str = "byte_bpe_50k.json") -> Encoder:
    if (ranks, file) not in _loaded:
        _loaded[ranks, file] = Encoder(ranks, file)
    return _loaded[ranks, file]


def first_fit(sizes: list[int], room: int) -> list[list[int]]:
    """First-fit decreasing: the indices of sizes in each bin of ``room``."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [room] * (2 * width)
    bins: list[list[int]] = []
    for i in order:
        need, at = sizes[i], 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        if at - width >= len(bins):
            bins.append([])
        bins[at - width].append(i)
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return bins


def group_of(row: int, task: int, copy: int, groups: int) -> int:
    """The group of the ``copy``-th row with hash ``row`` that a task has read."""
    mixed = hashlib.blake2b(struct.pack("<qqq", row, task, copy), digest_size=8).digest()
    return int.from_bytes(mixed, "little") % groups


def pack_group(lengths: list[int], room: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences are numbered from 0."""
    sequence = 0
    rests: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % room, room):
            yield doc, start, room, sequence, 0
            sequence += 1
        if n % room:
            rests.append((doc, n - n % room, n % room))
    bins = [[rests[i] for i in b] for b in first_fit([r[2] for r in rests], room)]
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    head, tail = 0, len(bins)
    free = room - sum(p[2] for p in bins[0]) if bins else 0
    while head < tail - 1:  # the emptiest bin is cut up to fill the fullest open one
        if not free:
            head += 1
            free = room - sum(p[2] for p in bins[head])
            continue
        doc, start, n = bins[tail - 1].pop()
        part = min(n, free)
        bins[head].append((doc, start, part))
        free -= part
        if part < n:
            bins[tail - 1].append((doc, start + part, n - part))
        if not bins[tail - 1]:
            tail -= 1
    last = bins[head] if bins else []
    for b in bins[:head]:
        offset = 0
        for doc, start, n in b:
            yield doc, start, n, sequence, offset
            offset += n
        sequence += 1
    left = sum(p[2] for p in last)
    pieces = list(last)
    while pieces:  # powers of two need no padding
        want = 1 << (left.bit_length() - 1)
        left -= want
        offset = 0
        while offset < want:
            doc, start, n = pieces.pop()
            part = min(n, want - offset)
            yield doc, start, part, sequence, offset
            offset += part
            if part < n:
                pieces.append((doc, start + part, n - part))
        sequence += 1


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, length: int = LENGTH, group_docs: int = GROUP_DOCS, ranks: str = "byte_bpe_50k.tiktoken", file: str = "byte_bpe_50k.json") -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and place in a sequence."""
    groups = max(1, -(-docs.count() // group_docs))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, task, copies = encoder(ranks, file), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            dealt = []
            for row in batch.column(0).to_pylist():
                dealt.append(group_of(row, task, copies[row], groups))
                copies[row] += 1
            found = [np.append(make.ids(t.as_py() or ""), np.uint32(0)).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int64()), batch.column(1), pa.array(found, pa.binary())], ["grp", "doc_id", "ids"])

    def packed(group: pa.Table) -> pa.Table:
        ids, names = group.column("ids").to_pylist(), group.column("doc_id").to_pylist()
        first = int(group.column("grp")[0].as_py()) << 32
        rows = []
        for doc, start, n, sequence, offset in pack_group([len(b) // 4 for b in ids], length):
            part = ids[doc][4 * start : 4 * (start + n)]
            rows.append((names[doc], start, n, zlib.crc32(part), len(ids[doc]) // 4, first + sequence, offset, part))
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    encoded = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, "grp bigint, doc_id bigint, ids binary")
    return encoded.groupBy("grp").applyInArrow(packed, PIECES)
