"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is how far its share of toxic fitting documents lies from that of the others (in standard errors), its own
embedding (both for words that several fitting documents share), and the mean embedding of its hashed character pairs.
While fitting, most words at random show only the first of these, so that few documents are not learnt by heart. Windows of T words that overlap by T - STRIDE are run forwards and
backwards; attention weighs the states of a window; a text scores as its worst window does. Fitting is
multiple-instance: of each labelled text the window that now scores highest learns the label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common
from .common import U64, mix

T, STRIDE = 32, 24
H, WORD_DIM, CHAR_DIM, CHAR_BITS, ATTEND = 8, 10, 6, 12, 8
#: Bounds of the fitting sample and of the words that have an embedding of their own.
FIT_DOCS_PER_CLASS, VOCABULARY = 3000, 30_000
STEPS, BATCH = 1000, 32
#: Fitting documents that a word must be in to be known; standard errors of its standing that count as chance; share of words
#: that show nothing but their standing in a step.
SHARED, CHANCE, MOST, DROPPED = 3, 2.0, 2.0, 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Words of a batch of texts: distinct ones with their inputs' indexes, and windows over them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, vocabulary: np.ndarray | None):
        starts, ends, at = common.word_bounds(data, offs)
        hashes = common.word_hashes(data, starts, ends)
        self.at, self.hashes = at, hashes
        distinct, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.distinct = distinct
        if vocabulary is None:
            return
        place = np.minimum(np.searchsorted(vocabulary, distinct), max(len(vocabulary) - 1, 0))
        known = vocabulary[place] == distinct if len(vocabulary) else np.zeros(len(distinct), bool)
        self.known = np.where(known, place + 1, 0)  # 0: no embedding of its own
        self.shown = np.full((len(distinct), 1), 1 - DROPPED, np.float32)  # of each word, how much of its embeddings shows
        a, b = starts[first], ends[first]
        lengths = b - a
        self.char_at = np.cumsum(lengths) - lengths
        where = np.repeat(a - self.char_at, lengths) + np.arange(lengths.sum())
        low = common._LOWER[data]
        one = low[where].astype(np.uint32)
        two = np.zeros_like(one)
        two[:-1] = one[1:]
        two[self.char_at + lengths - 1] = 0
        self.chars = ((one * np.uint32(257) + two) * np.uint32(0x9E3779B1) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
        self.lengths = lengths
        counts = np.diff(at)
        windows = np.maximum(1, -(-np.maximum(counts - T, 0) // STRIDE) + 1)  # a wordless text has one empty window
        self.window_at = np.concatenate([[0], np.cumsum(windows)])
        row = np.repeat(np.arange(len(counts)), windows)
        begin = at[row] + (np.arange(len(row)) - self.window_at[row]) * STRIDE
        places = begin[:, None] + np.arange(T)
        self.mask = places < at[row + 1][:, None]
        self.windows = self.number[np.minimum(places, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(places.shape, np.int64)


def start(words: int, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    d = 1 + WORD_DIM + CHAR_DIM
    p = {"Z": np.zeros(words + 1, np.float32), "E": 0.05 * r.standard_normal((words + 1, WORD_DIM)).astype(np.float32), "C": 0.3 * r.standard_normal((1 << CHAR_BITS, CHAR_DIM)).astype(np.float32)}
    p["E"][0] = 0
    for side in "fb":
        p |= {f"W{side}": draw(d, 3 * H), f"U{side}": draw(H, 3 * H), f"B{side}": np.zeros(3 * H, np.float32)}
    return p | {"A": draw(2 * H, ATTEND), "v": draw(ATTEND), "w": draw(2 * H), "b": np.array([-1.0], np.float32)}


def _inputs(p: dict, w: Words) -> np.ndarray:
    if not len(w.distinct):
        return np.zeros((1, 1 + WORD_DIM + CHAR_DIM), np.float32)
    chars = np.add.reduceat(p["C"][w.chars], w.char_at, axis=0) / w.lengths[:, None].astype(np.float32)
    return np.concatenate([p["Z"][w.known][:, None], np.concatenate([p["E"][w.known], chars], axis=1) * w.shown], axis=1)


def _run(p: dict, side: str, projected: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States (T, windows, H) of one direction; steps off the text leave the state as it is."""
    u, h = p[f"U{side}"], np.zeros((len(windows), H), np.float32)
    out = np.zeros((T, len(windows), H), np.float32)
    for t in range(T) if side == "f" else range(T - 1, -1, -1):
        x, hu, on = projected[windows[:, t]], h @ u, mask[:, t, None]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * H] + hu[:, : 2 * H])))
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
        new = np.where(on, n + z * (h - n), h)
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * H :], on))
        h = out[t] = new
    return out


def forward(p: dict, w: Words, windows: np.ndarray, mask: np.ndarray, inputs: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    inputs = _inputs(p, w) if inputs is None else inputs
    steps = {"f": [], "b": []}
    states = np.concatenate([_run(p, s, inputs @ p[f"W{s}"] + p[f"B{s}"], windows, mask, steps[s] if keep is not None else None) for s in "fb"], axis=2)
    act = np.tanh(states @ p["A"])
    e = np.where(mask.T, act @ p["v"], np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a *= mask.T
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, states)
    if keep is not None:
        keep |= {"steps": steps, "states": states, "act": act, "a": a, "pooled": pooled, "inputs": inputs}
    return pooled @ p["w"] + p["b"][0]


def backward(p: dict, w: Words, windows: np.ndarray, mask: np.ndarray, keep: dict, error: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients for dLoss/dlogit = error. E and C come as gradients of the distinct words' inputs, 'X'."""
    g = {"w": keep["pooled"].T @ error, "b": np.array([error.sum()], np.float32)}
    d_pool = error[:, None] * p["w"]
    states, a = keep["states"], keep["a"]
    d_states = a[:, :, None] * d_pool[None]
    d_a = np.einsum("tnh,nh->tn", states, d_pool)
    d_e = a * (d_a - (a * d_a).sum(0))
    g["v"] = np.einsum("tn,tnk->k", d_e, keep["act"])
    d_act = d_e[:, :, None] * p["v"] * (1 - keep["act"] ** 2)
    g["A"] = np.einsum("tnh,tnk->hk", states, d_act)
    d_states = d_states + d_act @ p["A"].T
    d_x = np.zeros_like(keep["inputs"])
    for i, side in enumerate("fb"):
        u = p[f"U{side}"]
        g[f"U{side}"] = np.zeros_like(u)
        d_p = np.zeros((len(keep["inputs"]), 3 * H), np.float32)
        d_h = np.zeros((len(windows), H), np.float32)
        for t, h, z, r, n, hn, on in reversed(keep["steps"][side]):
            d_new = d_h + d_states[t, :, i * H : (i + 1) * H]
            d_live = np.where(on, d_new, 0)
            d_n, d_z = d_live * (1 - z) * (1 - n * n), d_live * (h - n) * z * (1 - z)
            d_r = d_n * hn * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r, d_n], axis=1)
            d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
            g[f"U{side}"] += h.T @ d_hu
            np.add.at(d_p, windows[:, t], d_gate)
            d_h = d_hu @ u.T + d_live * z + np.where(on, 0, d_new)
        g[f"B{side}"] = d_p.sum(0)
        g[f"W{side}"] = keep["inputs"].T @ d_p
        d_x += d_p @ p[f"W{side}"].T
    g["X"] = d_x
    return g


def _standing(ones: np.ndarray, zeros: np.ndarray, all_ones: float, all_zeros: float) -> np.ndarray:
    """Log odds ratio of a word's shares of the two classes' documents, in its standard errors beyond CHANCE and up to
    MOST more, half a document added to each."""
    odds = np.log((ones + 0.5) / (all_ones - ones + 0.5)) - np.log((zeros + 0.5) / (all_zeros - zeros + 0.5))
    z = odds / np.sqrt(1 / (ones + 0.5) + 1 / (all_ones - ones + 0.5) + 1 / (zeros + 0.5) + 1 / (all_zeros - zeros + 0.5))
    return np.sign(z) * np.clip(np.abs(z) - CHANCE, 0, MOST)


def fit_texts(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> tuple[dict, np.ndarray]:
    """Parameters and vocabulary from labelled texts. Both classes are drawn equally often."""
    r = np.random.default_rng(seed)
    seen, toxic = [], []
    for a in range(0, len(texts), 200):
        part = texts[a : a + 200]
        w = Words(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), None)
        row = np.repeat(np.arange(len(part)), np.diff(w.at)).astype(U64)
        pairs = np.unique(mix(w.hashes + row * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
        seen.append(w.hashes[pairs])
        toxic.append(labels[a + row[pairs].astype(np.int64)])
    words, at, df = np.unique(np.concatenate(seen), return_inverse=True, return_counts=True)
    hits = np.bincount(at, weights=np.concatenate(toxic), minlength=len(words))
    standing = _standing(hits, df - hits, labels.sum(), len(labels) - labels.sum())
    top = np.flatnonzero(df >= SHARED)
    top = np.sort(top[np.lexsort((-df[top], -np.abs(standing[top])))[:VOCABULARY]])  # the most telling, then the most frequent
    vocabulary = words[top]
    p = start(len(vocabulary))
    p["Z"][1:] = standing[top]
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(map(len, classes)):
        p["w"][:] = 0
        p["b"][0] = -4.0 if not len(classes[1]) else 4.0
        return p, vocabulary
    for step in range(1, steps + 1):
        own = np.concatenate([r.choice(c, BATCH // 2) for c in classes])
        part = [texts[i] for i in own]
        w = Words(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), vocabulary)
        w.shown = (r.random((len(w.distinct), 1)) >= DROPPED).astype(np.float32)
        inputs = _inputs(p, w)
        logits = forward(p, w, w.windows, w.mask, inputs)
        best = np.array([a + np.argmax(logits[a:b]) for a, b in zip(w.window_at, w.window_at[1:], strict=False)])
        windows, mask, keep = w.windows[best], w.mask[best], {}
        out = forward(p, w, windows, mask, inputs, keep)
        g = backward(p, w, windows, mask, keep, ((_sigmoid(out) - labels[own]) / len(own)).astype(np.float32))
        x = g.pop("X")
        if len(w.distinct):
            x[:, 1:] *= w.shown
            g["E"] = np.zeros_like(p["E"])
            np.add.at(g["E"], w.known, x[:, 1 : 1 + WORD_DIM])
            g["E"][0] = 0
            share = (x[:, 1 + WORD_DIM :] / w.lengths[:, None]).repeat(w.lengths, axis=0)
            g["C"] = np.stack([np.bincount(w.chars, weights=share[:, k], minlength=1 << CHAR_BITS) for k in range(CHAR_DIM)], axis=1).astype(np.float32)
        rate = 0.02 * (1 - 0.8 * step / steps)
        for k, d in g.items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p, vocabulary


def score_texts(p: dict, vocabulary: np.ndarray, data: np.ndarray, offs: np.ndarray, block: int = 4096) -> np.ndarray:
    w = Words(data, offs, vocabulary)
    inputs = _inputs(p, w)
    logits = np.concatenate([forward(p, w, w.windows[a : a + block], w.mask[a : a + block], inputs) for a in range(0, len(w.windows), block)])
    return _sigmoid(np.maximum.reduceat(logits, w.window_at[:-1]).astype(float))


# ---------------------------------------------------------------- on tables

_NAMES = ["Z", "E", "C", "Wf", "Uf", "Bf", "Wb", "Ub", "Bb", "A", "v", "w", "b"]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS_PER_CLASS) -> tuple[dict, np.ndarray]:
    """Parameters and vocabulary, from at most about per_class labelled documents of each class, drawn by a
    hash of the id. Documents without a label or a doc_id teach nothing; of repeated labels the largest counts."""
    spark = docs.sparkSession
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    keep = F.lit(False)  # about 2 * per_class ids pass: small enough to broadcast
    for c in (0, 1):
        limit = int(min(1.0, per_class / max(1, counts.get(c, 0))) * (1 << 30))
        keep = keep | ((F.col("toxic") == c) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit))
    sample = docs.select("doc_id", "text").join(F.broadcast(marks.where(keep)), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            data, offs = common.text_bytes(batch.column("text"))
            texts += [data[a:b].tobytes() for a, b in zip(offs, offs[1:], strict=False)]
            marks.append(batch.column("toxic").to_numpy())
        if texts:
            order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
            p, vocabulary = fit_texts([texts[i] for i in order], np.concatenate(marks)[order])
            names, values = ["vocabulary", *_NAMES], [vocabulary, *(p[k] for k in _NAMES)]
            yield pa.record_batch([pa.array(names), pa.array([x.tobytes() for x in values], pa.binary())], ["name", "value"])

    found = {r["name"]: r["value"] for r in sample.repartition(1).mapInArrow(run, "name string, value binary").collect()}
    if not found:
        return start(0) | {"w": np.zeros(2 * H, np.float32), "b": np.array([-4.0], np.float32)}, np.zeros(0, U64)
    vocabulary = np.frombuffer(found["vocabulary"], U64)
    shapes = {k: x.shape for k, x in start(len(vocabulary)).items()}
    return {k: np.frombuffer(found[k], np.float32).reshape(shapes[k]) for k in _NAMES}, vocabulary


def score(docs: DataFrame, model: tuple[dict, np.ndarray]) -> DataFrame:
    """All columns of docs and toxicity, 0 to 1: the score of the worst of all windows of the whole text.

    Null, empty and wordless texts score as one empty window does, below 0.5. Repeated rows score alike;
    other columns pass through, an existing toxicity column is replaced; no rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    common.bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("toxicity")
        p, vocabulary = shared.value
        for batch in batches:
            data, offs = common.text_bytes(batch.column("text"))
            runs = [score_texts(p, vocabulary, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in common.byte_runs(offs)]
            out = np.concatenate(runs) if runs else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "toxicity"])

    schema = StructType([*(docs.schema[c] for c in kept), StructField("toxicity", DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(F.pmod(common.crc32_of_id(), F.lit(5)) != 0))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.pmod(common.crc32_of_id(), F.lit(5)) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
