"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a vector for the word itself plus the mean of vectors for its character n-grams, so
unseen forms of known stems are recognised. Words and n-grams that few of the training documents hold
have no vector: they could only be learned by heart. Texts are scored whole: overlapping windows of WINDOW words
overlap by WINDOW - STRIDE words, and a document's score is that of its worst window.

The network learns from a bounded sample of labelled documents (SAMPLE toxic and twice as many others,
smallest hash first, up to WINDOWS windows each, spread over the text). Labels are per document, so
training takes a toxic document's worst window as the toxic one. Weights are a few megabytes and travel with the scoring tasks.

Defined cases: a null or empty text, or one without words, gets the score of an empty window (no word,
no evidence); repeated rows are scored each; conflicting labels of a doc_id count as toxic; null labels
do not count; without labels of both kinds every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import words_of

WINDOW = 48
STRIDE = 32
SAMPLE = 1200
WINDOWS = 10
CUTOFF = 0.7
EPOCHS = 4
BATCH = 128
#: Steps that a round of training takes at least; a small sample is passed over again.
ROUND = 150
HIDDEN = 8
INPUT = 12
#: Hash buckets of n-grams and words; a bucket has a vector if this share of the sample's documents holds it (3 at least).
GRAM_BUCKETS = 1 << 18
WORD_BUCKETS = 1 << 16
HELD_BY = 0.005
DECAY = 2e-4
#: Words whose gate inputs a scoring task keeps.
CACHE = 200_000
#: Windows scored together.
TOGETHER = 4096
EDGES = b".,;:!?\"'()[]{}<>*#%&$/\\|+=~^_`-"


def letters(word: bytes) -> bytes:
    return word.strip(EDGES) or word


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of all its n-grams of 3 to 5 bytes, where each word's n-grams start)."""
    framed = [b"\x02" + letters(w) + b"\x03" for w in words]
    lengths = np.fromiter(map(len, framed), np.int64, len(framed))
    raw = np.frombuffer(b"".join(framed), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(framed)), lengths)
    left = ends[of] - np.arange(len(raw))  # bytes from here to the end of the word
    code, grams, owner = np.zeros(len(raw), np.uint64), [], []
    for n in range(1, 6):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[: len(raw) - n + 1] = raw[n - 1 :]
        code = code * np.uint64(1_000_003) + shifted
        ok = left >= n
        if n >= 3:
            grams.append(mix64(code[ok] + np.uint64(n)) % np.uint64(GRAM_BUCKETS))
            owner.append(of[ok])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    # The whole word by sums of its bytes at their places, so any length costs its bytes once.
    place = np.arange(len(raw)) - (ends - lengths)[of]
    spots = mix64(raw + np.uint64(257) * place.astype(np.uint64))
    whole = np.add.reduceat(spots, ends - lengths) if len(framed) else spots
    starts = np.searchsorted(owner[order], np.arange(len(framed)))
    return (mix64(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64), grams[order].astype(np.int64), starts


def word_rows(p: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the tables (0: no vector) for words and n-grams, where n-grams start, and how many count."""
    whole, grams, starts = buckets(words)
    grams = p["gram_row"][grams]
    return p["word_row"][whole], grams, starts, np.add.reduceat((grams > 0).astype(np.float32), starts) + 1


def encode(p: dict, words: list[bytes]) -> np.ndarray:
    """Input vectors of words (each has an n-gram: its frame alone makes one of three bytes or more)."""
    if not words:
        return np.zeros((0, p["word"].shape[1]), np.float32)
    rows, grams, starts, counts = word_rows(p, words)
    return p["word"][rows] + np.add.reduceat(p["gram"][grams], starts) / counts[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def recur(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Gated recurrence over (steps, batch, 3 * hidden) inputs; (steps, batch, hidden) states."""
    steps, batch, wide = x.shape
    k = wide // 3
    h = np.zeros((batch, k), np.float32)
    out, saved = np.empty((steps, batch, k), np.float32), []
    for t in range(steps):
        g = h @ u
        gates = sigmoid(x[t, :, : 2 * k] + g[:, : 2 * k])
        z, r = gates[:, :k], gates[:, k:]
        c = np.tanh(x[t, :, 2 * k :] + r * g[:, 2 * k :])
        if keep:
            saved.append((h, g, z, r, c))
        h = h + mask[t][:, None] * z * (c - h)
        out[t] = h
    return out, saved


def recur_back(d_out: np.ndarray, mask: np.ndarray, u: np.ndarray, saved: list):
    steps, batch, k = d_out.shape
    d_x, d_u, d_h = np.empty((steps, batch, 3 * k), np.float32), np.zeros_like(u), np.zeros((batch, k), np.float32)
    for t in range(steps - 1, -1, -1):
        h, g, z, r, c = saved[t]
        d_h = d_h + d_out[t]
        m = mask[t][:, None]
        d_c = d_h * m * z * (1 - c * c)
        d_z = d_h * m * (c - h) * z * (1 - z)
        d_r = d_c * g[:, 2 * k :] * r * (1 - r)
        d_x[t] = np.concatenate((d_z, d_r, d_c), axis=1)
        d_g = np.concatenate((d_z, d_r, d_c * r), axis=1)
        d_u += h.T @ d_g
        d_h = d_h * (1 - m * z) + d_g @ u.T
    return d_x, d_u


def pool(p: dict, states: np.ndarray, mask: np.ndarray):
    """Attention pooling of (steps, batch, 2 * hidden) states to logits."""
    a = np.tanh(states @ p["look"])
    score = np.where(mask > 0, a @ p["ask"], -1e9)
    weight = np.exp(score - score.max(0)) * mask
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ p["out"] + p["bias"][0], (a, weight, pooled)


def fresh(seed: int, docs: list[list[list[bytes]]]) -> dict:
    """First weights, and tables from buckets to rows made of what enough documents hold."""
    held = [np.zeros(WORD_BUCKETS, np.int64), np.zeros(GRAM_BUCKETS, np.int64)]
    for d in docs:
        words = list({x for w in d for x in w})
        if words:
            for h, found in zip(held, buckets(words)):
                h[np.unique(found)] += 1
    enough = max(3, HELD_BY * len(docs))
    word_row, gram_row = (np.where(h >= enough, np.cumsum(h >= enough), 0).astype(np.int32) for h in held)
    draw = np.random.default_rng(seed)
    one = lambda *shape: (draw.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    k = HIDDEN
    return {
        "word_row": word_row, "gram_row": gram_row,
        "word": (0.1 * draw.normal(size=(word_row.max() + 1, INPUT)) * (np.arange(word_row.max() + 1) > 0)[:, None]).astype(np.float32),
        "gram": (0.3 * draw.normal(size=(gram_row.max() + 1, INPUT)) * (np.arange(gram_row.max() + 1) > 0)[:, None]).astype(np.float32),
        "in": one(INPUT, 6 * k), "shift": np.zeros(6 * k, np.float32), "ahead": one(k, 3 * k), "back": one(k, 3 * k),
        "look": one(2 * k, k), "ask": one(k), "out": one(2 * k), "bias": np.full(1, -1.0, np.float32),
    }


def forward(p: dict, types: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Logits of windows: ids (batch, steps) are rows of types plus one, 0 is padding."""
    k3 = 3 * HIDDEN
    table = np.concatenate((np.zeros((1, 2 * k3), np.float32), types @ p["in"] + p["shift"]))
    ids = ids.T
    mask = (ids > 0).astype(np.float32)
    ahead, saved = recur(table[:, :k3][ids], mask, p["ahead"], keep)
    back, saved_back = recur(table[:, k3:][ids[::-1]], mask[::-1], p["back"], keep)
    states = np.concatenate((ahead, back[::-1]), axis=2)
    logit, rest = pool(p, states, mask)
    return logit, (mask, states, saved, saved_back, rest)


def gradients(p: dict, words: list[bytes], ids: np.ndarray, y: np.ndarray) -> dict:
    rows, grams, starts, counts = word_rows(p, words)
    types = p["word"][rows] + np.add.reduceat(p["gram"][grams], starts) / counts[:, None]
    logit, (mask, states, saved, saved_back, (a, weight, pooled)) = forward(p, types, ids, True)
    d = (sigmoid(logit) - y) / len(y)
    g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * p["out"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["ask"] = np.einsum("tb,tbk->k", d_score, a)
    d_a = d_score[:, :, None] * p["ask"] * (1 - a * a)
    g["look"] = np.einsum("tbi,tbk->ik", states, d_a)
    d_states = d_states + d_a @ p["look"].T
    d_x, g["ahead"] = recur_back(d_states[:, :, :HIDDEN], mask, p["ahead"], saved)
    d_y, g["back"] = recur_back(d_states[::-1, :, HIDDEN:], mask[::-1], p["back"], saved_back)
    d_in = np.concatenate((d_x, d_y[::-1]), axis=2).reshape(-1, 6 * HIDDEN)
    d_table = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
    flat = ids.T.ravel()
    np.add.at(d_table, flat, d_in)
    d_table = d_table[1:]
    g["in"], g["shift"] = types.T @ d_table, d_table.sum(0)
    d_types = d_table @ p["in"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], rows, d_types)
    np.add.at(g["gram"], grams, np.repeat(d_types / counts[:, None], np.diff(np.append(starts, len(grams))), axis=0))
    g["word"][0] = g["gram"][0] = 0
    return g


def numbered(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words of windows, and the windows as rows of them plus one."""
    known: dict[bytes, int] = {}
    ids = np.zeros((len(windows), WINDOW), np.int64)
    for i, w in enumerate(windows):
        ids[i, : len(w)] = [known.setdefault(x, len(known) + 1) for x in w]
    return list(known), ids


def logits(p: dict, windows: list[list[bytes]]) -> np.ndarray:
    out = []
    for at in range(0, len(windows), TOGETHER):
        words, ids = numbered(windows[at : at + TOGETHER])
        out.append(forward(p, encode(p, words), ids)[0])
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: list[tuple[list[list[bytes]], int]], seed: int = 8, epochs: int = EPOCHS) -> dict:
    """Weights from (windows, label) documents.

    A first network takes every window of a toxic document as toxic, for one round. It only chooses:
    a second one starts anew on the worst window of each toxic document and all windows of the others.
    """
    draw = np.random.default_rng(seed)
    windows = [w for d, _ in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
    label = np.array([y for _, y in docs], np.float32)[owner]
    start = fresh(seed, [d for d, _ in docs])
    p = None
    for epoch in range(epochs):
        use = np.arange(len(windows))
        if p is not None:
            score = logits(p, windows)
            worst = np.full(len(docs), -np.inf)
            np.maximum.at(worst, owner, score)
            use = np.nonzero((label == 0) | (score == worst[owner]))[0]
            if epoch > 1:
                use = np.concatenate((use, *[np.nonzero((label == 0) & (score > -3))[0]] * 3))
        if epoch < 2:
            p = {k: v.copy() for k, v in start.items()}
            first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
        use = np.concatenate([draw.permutation(use) for _ in range(max(1, -(-ROUND * BATCH // max(1, len(use)))))])
        for at in range(0, len(use), BATCH):
            pick = use[at : at + BATCH]
            words, ids = numbered([windows[i] for i in pick])
            if not words:
                continue
            step += 1
            rate = 0.01 * min(1, step / 20) * (0.4 if epoch == epochs - 1 else 1)
            for k, g in gradients(p, words, ids, label[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7) + (DECAY * p[k] if k in ("word", "gram") else 0)).astype(np.float32)
    return p


def spans(n: int) -> np.ndarray:
    """Starts of the windows over n words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else np.zeros(1, np.int64)


class Scorer:
    """Scores texts with a growing table of gate inputs per distinct word."""

    def __init__(self, p: dict) -> None:
        self.p = p
        self.empty = float(sigmoid(p["bias"][0]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1, 6 * HIDDEN), np.float32)

    def ids(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.known) > CACHE:
            self.forget()
        new = [w for w in set().union(*docs) if w not in self.known] if docs else []
        at = len(self.known) + 1
        self.known.update(zip(new, range(at, at + len(new))))
        if new:
            self.table = np.concatenate((self.table, encode(self.p, new) @ self.p["in"] + self.p["shift"]))
        get = self.known.__getitem__
        return [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]

    def windows(self, ids: np.ndarray) -> np.ndarray:
        k3 = 3 * HIDDEN
        out = []
        for at in range(0, len(ids), TOGETHER):
            part = ids[at : at + TOGETHER].T
            mask = (part > 0).astype(np.float32)
            ahead, _ = recur(self.table[:, :k3][part], mask, self.p["ahead"])
            back, _ = recur(self.table[:, k3:][part[::-1]], mask[::-1], self.p["back"])
            out.append(pool(self.p, np.concatenate((ahead, back[::-1]), axis=2), mask)[0])
        return sigmoid(np.concatenate(out))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The worst window of each text."""
        docs = [words_of(t) for t in texts]
        result = np.full(len(texts), self.empty)
        parts, owner = [], []
        for i, ids in enumerate(self.ids(docs)):
            if len(ids):
                starts = spans(len(ids))
                wide = np.zeros(starts[-1] + WINDOW, np.int64)
                wide[: len(ids)] = ids
                parts.append(np.lib.stride_tricks.sliding_window_view(wide, WINDOW)[starts])
                owner.append(np.full(len(starts), i))
        if parts:
            worst = np.zeros(len(texts))
            owner = np.concatenate(owner)
            np.maximum.at(worst, owner, self.windows(np.concatenate(parts)))
            result[np.unique(owner)] = worst[np.unique(owner)]
        return result


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame, sample: int, windows: int) -> list[tuple[list[list[bytes]], int]]:
    """The bounded sample: ``sample`` toxic documents and twice as many others, by hash, with spread windows."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = marked.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    ids = [(r["doc_id"], r["toxic"]) for y in (0, 1) for r in seen.where(F.col("toxic") == y).orderBy(*order).limit(sample * (2 - y)).collect()]
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id bigint, toxic int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic, found = [], [], []
            for d, y, t in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(t)
                starts = spans(len(words))
                for s in starts[np.unique(np.linspace(0, len(starts) - 1, min(windows, len(starts))).round().astype(int))]:
                    ids.append(d)
                    toxic.append(y)
                    found.append(b" ".join(words[s : s + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "toxic", "words"])

    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most 3 x sample rows
    rows = one.mapInArrow(cut, "doc_id bigint, toxic int, words binary").collect()
    held: dict[int, tuple[list, int]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["words"])):
        held.setdefault(r["doc_id"], ([], r["toxic"]))[0].append(bytes(r["words"]).split())
    return list(held.values())


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS, cutoff: float = CUTOFF, seed: int = 8) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    seen = training_windows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), sample, windows)
    flags = held_out(F.col("doc_id")).alias("held_out")
    if len({y for _, y in seen}) < 2:
        share = F.lit(float(seen[0][1]) if seen else 0.0)
        return docs.select("doc_id", flags, share.alias("score"), (share >= cutoff).cast("int").alias("predicted"))
    weights = train(seen, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scorer.scores(part.column(2).to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", flags, "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the documents that the network rejects, with their columns as they are."""
    cutoff = how.get("cutoff", CUTOFF)
    seen = training_windows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), how.get("sample", SAMPLE), how.get("windows", WINDOWS))
    if len({y for _, y in seen}) < 2:
        return docs
    weights = train(seen, how.get("seed", 8))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield part.filter(pa.array(scorer.scores(part.column(names.index("text")).to_pylist()) < cutoff))

    return docs.mapInArrow(run, docs.schema)
