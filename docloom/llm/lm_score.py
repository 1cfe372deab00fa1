"""Language-model scores: a causal self-attention model over subword ids, in numpy, beside a word count model.

Text counts as its words with A-Z lower-cased, each spelled by byte-level BPE ids with a leading space, and
one end. Windows of STEP tokens attend, under a causal mask, to themselves and to the STEP tokens before
them; windows overlap in context only, so each token is scored once. The next id is drawn in two
softmaxes, group then member, over the SLOTS most frequent ids; one slot stands for all other ids, by their
frequency. Fitting is data-parallel: in each round tasks take gradient steps on all their own training
documents and their parameters are averaged. Word and id counts come from all training documents too.
A word's probability is the mean of two: that of its ids under the attention model, and that of the word counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_grammar import TOKENIZER, encoder, spelled

STEP, DIM, HIDDEN, GROUPS, MEMBERS = 8, 16, 32, 32, 32  # as many groups as members: _Softmaxes has both in rows of one width
SLOTS = GROUPS * MEMBERS
#: Each round goes over all training documents EPOCHS times, at every size.
ROUNDS, EPOCHS, BATCH = 1, 1, 512
#: About how many of the most frequent words' counts tasks hold; the other words' counts are joined.
HELD_WORDS = 200_000

_LOWER = bytes(common._LOWER)


# ---------------------------------------------------------------- ids and windows


def _spaced(texts: list[bytes]) -> list[str]:
    """Texts as their words, in lower case, with single spaces between."""
    return [b" ".join(t.translate(_LOWER).split()).decode() for t in texts]


def ids_of(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of each text's words."""
    ids, size, many = encoder(path).words_of(_spaced(texts))
    ends = np.concatenate([[0], np.cumsum(size)])
    return np.split(ids, ends[np.cumsum(many)[:-1]]) if texts else []


class Windows:
    """Texts' slots laid out in windows of STEP: each text begins a window; the end slot closes it."""

    def __init__(self, texts: list[np.ndarray], end: int):
        n = np.array([len(t) + 1 for t in texts])
        padded = -(-n // STEP) * STEP
        self.at = np.cumsum(padded) - padded
        size = int(padded.sum())
        place = np.repeat(self.at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.target = np.full(size, -1, np.int64)
        self.target[place] = np.concatenate([x for t in texts for x in (t, [end])])
        self.input = np.full(size, SLOTS, np.int64)  # slot SLOTS: the beginning
        self.input[1:] = np.where(self.target[:-1] >= 0, self.target[:-1], SLOTS)
        self.input[self.at] = SLOTS
        self.first = np.zeros(size // STEP, bool)
        self.first[self.at // STEP] = True


# ---------------------------------------------------------------- the model


def start(seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "E": 0.3 * r.standard_normal((SLOTS + 1, DIM)).astype(np.float32), "Q": draw(DIM, DIM), "K": draw(DIM, DIM), "V": draw(DIM, DIM),
        "P": np.zeros((STEP, 2 * STEP), np.float32), "W": draw(2 * DIM, HIDDEN), "c": np.zeros(HIDDEN, np.float32),
        "G": 0.1 * draw(HIDDEN, GROUPS), "g": np.zeros(GROUPS, np.float32), "M": 0.1 * draw(HIDDEN, GROUPS * MEMBERS), "m": np.zeros((GROUPS, MEMBERS), np.float32),
    }


_CAUSAL = (np.arange(2 * STEP)[None] <= np.arange(STEP)[:, None] + STEP).astype(np.float32)
#: Scores of a softmax are held within this, so their exponentials neither overflow nor vanish.
_FAR = 80.0


def _exp(x: np.ndarray) -> np.ndarray:
    """In place."""
    if len(x) and (x.max() > _FAR or x.min() < -_FAR):
        np.clip(x, -_FAR, _FAR, out=x)
    return np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows."""
    return x @ np.ones(x.shape[1], x.dtype)


def run(p: dict, inputs: np.ndarray, before: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden states of windows (n, STEP). before: the inputs of the windows before them."""
    both = np.concatenate([before, inputs], axis=1)
    n, e = len(both), p["E"].take(both, axis=0)
    kv = (e.reshape(-1, DIM) @ np.concatenate([p["K"], p["V"]], axis=1)).reshape(n, 2 * STEP, 2 * DIM)
    x = np.empty((n, STEP, 2 * DIM), e.dtype)
    x[:, :, DIM:] = e[:, STEP:]
    q, k, v = (x.reshape(-1, 2 * DIM)[:, DIM:] @ p["Q"]).reshape(n, STEP, DIM), kv[:, :, :DIM], kv[:, :, DIM:]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(DIM**-0.5)
    a += p["P"]
    _exp(a)
    a *= _CAUSAL
    a[first, :, :STEP] = 0
    a /= _sums(a.reshape(-1, 2 * STEP)).reshape(n, STEP, 1)
    np.matmul(a, v, out=x[:, :, :DIM])
    h = x.reshape(-1, 2 * DIM) @ p["W"]
    h += p["c"]
    np.tanh(h, out=h)
    return {"both": both, "e": e, "q": q, "k": k, "v": v, "a": a, "x": x, "h": h}


def _of_slots(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each slot: keys and values, queries, and what it adds to a hidden state itself. For scores, where parameters stay."""
    return p["E"] @ np.concatenate([p["K"], p["V"]], axis=1), p["E"] @ p["Q"] * np.float32(DIM**-0.5), p["E"] @ p["W"][DIM:] + p["c"]


def hidden(p: dict, slots: tuple[np.ndarray, np.ndarray, np.ndarray], inputs: np.ndarray, before: np.ndarray, first: np.ndarray) -> np.ndarray:
    """run()'s hidden states alone, from what _of_slots gives."""
    kv, q, own = slots
    kv = kv.take(np.concatenate([before, inputs], axis=1), axis=0)
    a = q.take(inputs, axis=0) @ kv[:, :, :DIM].transpose(0, 2, 1)
    a += p["P"]
    _exp(a)
    a *= _CAUSAL
    a[first, :, :STEP] = 0
    a /= _sums(a.reshape(-1, 2 * STEP)).reshape(len(a), STEP, 1)
    h = (a @ kv[:, :, DIM:]).reshape(-1, DIM) @ p["W"][:DIM]
    h += own.take(inputs.ravel(), axis=0)
    return np.tanh(h, out=h)


def _tops(p: dict) -> np.ndarray:
    """Of each group: weights, the last row biases, of scores of its members and then of all groups."""
    out = np.empty((GROUPS, HIDDEN + 1, MEMBERS + GROUPS), p["M"].dtype)
    out[:, :HIDDEN, :MEMBERS] = p["M"].reshape(HIDDEN, GROUPS, MEMBERS).transpose(1, 0, 2)
    out[:, HIDDEN, :MEMBERS] = p["m"]
    out[:, :HIDDEN, MEMBERS:] = p["G"]
    out[:, HIDDEN, MEMBERS:] = p["g"]
    return out


class _Softmaxes:
    """Both softmaxes of states h (tokens, HIDDEN), the tokens in order of their targets' groups: those of a group share one product."""

    def __init__(self, p: dict, h: np.ndarray, target: np.ndarray, tops: np.ndarray | None = None):
        group = (target // MEMBERS).astype(np.uint8)
        self.order = np.argsort(group, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
        self.runs = [(g, a, b) for g, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        self.h, target = np.ones((len(h), HIDDEN + 1), h.dtype), target.take(self.order)
        self.h[:, :HIDDEN] = h.take(self.order, axis=0)
        self.tops = _tops(p) if tops is None else tops
        x = np.empty((len(h), MEMBERS + GROUPS), h.dtype)
        for g, a, b in self.runs:
            np.matmul(self.h[a:b], self.tops[g], out=x[a:b])
        #: Exponentials of scores (of a token's members, then of the groups), where in them the targets' are, and sums of rows.
        self.x = _exp(x.reshape(-1, MEMBERS))
        self.at = np.arange(0, x.size, MEMBERS)
        self.at[::2] += target % MEMBERS
        self.at[1::2] += target // MEMBERS
        self.total = _sums(self.x)

    def logs(self) -> np.ndarray:
        """Natural log probabilities, in the order of groups."""
        both = np.log(self.x.ravel().take(self.at) / self.total)
        return both[::2] + both[1::2]


def log_probs(p: dict, h: np.ndarray, target: np.ndarray, tops: np.ndarray | None = None) -> np.ndarray:
    """Natural log probability of target slots, for states h (tokens, HIDDEN). tops: what _tops gives, if at hand."""
    chosen = _Softmaxes(p, h, target, tops)
    out = np.empty(len(h), h.dtype)
    out[chosen.order] = chosen.logs()
    return out


def gradients(p: dict, inputs: np.ndarray, before: np.ndarray, first: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of the windows' targets (-1: none), and its gradients."""
    r = run(p, inputs, before, first)
    live = np.flatnonzero(target.ravel() >= 0)
    n = max(1, len(live))
    chosen = _Softmaxes(p, r["h"] if len(live) == target.size else r["h"].take(live, axis=0), target.ravel()[live])
    loss, h, d = -chosen.logs().sum(), chosen.h, chosen.x
    d *= (1 / (n * chosen.total))[:, None]
    d.ravel()[chosen.at] -= 1 / n
    d = d.reshape(-1, MEMBERS + GROUPS)
    tops, dh = np.zeros_like(chosen.tops), np.zeros((len(h) + 1, HIDDEN), h.dtype)  # a last row of zeros, for positions without target
    for g, a, b in chosen.runs:
        np.matmul(h[a:b].T, d[a:b], out=tops[g])
        np.matmul(d[a:b], chosen.tops[g, :HIDDEN].T, out=dh[a:b])
    of_groups = tops[:, :, MEMBERS:].sum(0)
    out = {"M": tops[:, :HIDDEN, :MEMBERS].transpose(1, 0, 2).reshape(HIDDEN, -1), "m": tops[:, HIDDEN, :MEMBERS], "G": of_groups[:HIDDEN], "g": of_groups[HIDDEN]}
    h *= h
    np.subtract(1, h, out=h)
    dh[:-1] *= h[:, :HIDDEN]
    place = np.full(target.size, len(h))
    place[live.take(chosen.order)] = np.arange(len(h))
    full = dh.take(place, axis=0)
    x, a, both = r["x"].reshape(-1, 2 * DIM), r["a"], r["both"]
    out["W"], out["c"] = x.T @ full, _sums(full.T)
    dx = full @ p["W"].T
    do = dx.reshape(*target.shape, 2 * DIM)[:, :, :DIM]
    ds = do @ r["v"].transpose(0, 2, 1)
    ds *= a
    ds -= a * _sums(ds.reshape(-1, 2 * STEP)).reshape(*target.shape, 1)
    out["P"] = ds.sum(0)
    ds *= np.float32(DIM**-0.5)
    dkv = np.empty((*both.shape, 2 * DIM), a.dtype)
    np.matmul(ds.transpose(0, 2, 1), r["q"], out=dkv[:, :, :DIM])
    np.matmul(a.transpose(0, 2, 1), do, out=dkv[:, :, DIM:])
    dq, dkv = (ds @ r["k"]).reshape(-1, DIM), dkv.reshape(-1, 2 * DIM)
    out["Q"], of_both = x[:, DIM:].T @ dq, r["e"].reshape(-1, DIM).T @ dkv
    out["K"], out["V"] = of_both[:, :DIM], of_both[:, DIM:]
    de = dkv @ np.concatenate([p["K"], p["V"]], axis=1).T
    de.reshape(*both.shape, DIM)[:, STEP:] += (dx[:, DIM:] + dq @ p["Q"].T).reshape(*target.shape, DIM)
    ids = both.ravel().astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids = ids.take(order)
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    pairs = de.take(order, axis=0).view(np.result_type(de, np.complex64))  # numbers are summed two at once, as one complex number
    out["E"] = np.zeros_like(p["E"])
    out["E"][ids[at]] = np.add.reduceat(pairs, at, axis=0).view(de.dtype)
    return float(loss) / n, out


class Adam:
    """Steps on p's arrays, which become parts of one."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.all = np.concatenate([x.ravel() for x in p.values()])
        at = 0
        for k, x in p.items():
            p[k] = self.all[at : at + x.size].reshape(x.shape)
            at += x.size
        self.m, self.v = (np.zeros_like(self.all) for _ in range(2))

    def step(self, g: dict) -> None:
        self.t += 1
        rate, scale = self.rate / (1 - 0.9**self.t), (1 - 0.99**self.t) ** -0.5
        d = np.concatenate([g[k].ravel() for k in self.p])
        self.m *= 0.9
        self.m += 0.1 * d
        self.v *= 0.99
        d *= d
        d *= 0.01
        self.v += d
        by = np.sqrt(self.v, out=d)
        by += 1e-8 / scale
        np.divide(self.m, by, out=by)
        by *= rate / scale
        self.all -= by


def train(p: dict, w: Windows, rate: float, epochs: int, seed: int) -> None:
    inputs, target = w.input.reshape(-1, STEP), w.target.reshape(-1, STEP)
    before = np.concatenate([np.full((1, STEP), SLOTS), inputs[:-1]])
    np.empty(16 << 20, np.uint8)  # given back at once: the C library then keeps what a step frees, up to twice as much, for the next step
    r, adam = np.random.default_rng(seed), Adam(p, rate)
    for _ in range(epochs):
        order = r.permutation(len(inputs))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            adam.step(gradients(p, *(x.take(own, axis=0) for x in (inputs, before, w.first, target)))[1])


def score_windows(p: dict, w: Windows, block: int = 512) -> np.ndarray:
    """Natural log probability of each position's target (0 where there is none)."""
    inputs = w.input.reshape(-1, STEP)
    before = np.concatenate([np.full((1, STEP), SLOTS), inputs[:-1]])
    out, slots, tops = np.zeros(len(w.target)), _of_slots(p), _tops(p)
    for a in range(0, len(inputs), block):
        h = hidden(p, slots, inputs[a : a + block], before[a : a + block], w.first[a : a + block])
        target = w.target[a * STEP : (a + block) * STEP]
        live = np.flatnonzero(target >= 0)
        if len(live) < len(target):
            h, target = h.take(live, axis=0), target.take(live)
        out[a * STEP + live] = log_probs(p, h, target, tops)
    return out


class Model:
    """Parameters, the slot of each id, and the rest's log frequencies."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.end, self.other = 0, 1
        self.slot = np.full(len(counts), self.other, np.int64)
        top = order[: SLOTS - 2]
        self.slot[top] = np.arange(2, len(top) + 2)
        rest = np.where(self.slot == self.other, counts + 1.0, 0.0)
        self.rest = np.where(rest > 0, np.log(np.maximum(rest, 1.0) / max(rest.sum(), 1.0)), 0.0)
        self.p = start()
        mass = np.ones(SLOTS)
        mass[2 : len(top) + 2] += counts[top]
        mass[self.other] += counts[self.slot == self.other].sum()
        mass[self.end] += counts.sum() / 600  # about one end a text
        mass = mass.reshape(GROUPS, MEMBERS)
        self.p["g"][:] = np.log(mass.sum(1) / mass.sum())
        self.p["m"][:] = np.log(mass / mass.sum(1, keepdims=True))

    def lay_out(self, ids: list[np.ndarray]) -> Windows:
        return Windows([self.slot[x] for x in ids], self.end)

    def score(self, ids: np.ndarray, size: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word, from its ids, and of each text's end; size: ids in each word, many: words in each text."""
        ends = np.concatenate([[0], np.cumsum(size)])
        at = ends[np.concatenate([[0], np.cumsum(many)])]
        w = self.lay_out([ids[a:b] for a, b in zip(at, at[1:], strict=False)])
        got = score_windows(self.p, w)
        stop = w.at + np.diff(at)
        live = w.target >= 0
        live[stop] = False
        by_word = np.concatenate([[0], np.cumsum(got[live] + self.rest[ids])])[ends]
        return np.diff(by_word) / np.log(10), got[stop] / np.log(10)


# ---------------------------------------------------------------- on tables


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = common.text_bytes(batch.column("text"))
    for a, b in common.byte_runs(offs):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def _rows(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(offs, offs[1:], strict=False)]


def _stored_ids(docs: DataFrame, path: str, kind: type) -> DataFrame:
    """Runs of texts of docs(text, ...), encoded once for all passes over them: ids (all of a run, as `kind`), many (ids in each text), words
    (64-bit hashes of a run's distinct words), size (ids in each of those), which (of those each word is), texts (words in each text), and
    docs' other columns as arrays."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = "ids binary, many binary, words binary, size binary, which binary, texts binary" + "".join(f", {f.name} array<{f.dataType.simpleString()}>" for f in others)
    names = [*_RUN, *(f.name for f in others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("ids")
        for batch in batches:
            for a, b, data, offs in _texts(batch):
                own, size, words, which, texts = encoder(path).distinct_words_of(_spaced(_rows(data, offs)))
                ids, at = spelled(own, size, which), np.concatenate([[0], np.cumsum(texts)])
                many = np.diff(np.concatenate([[0], np.cumsum(size[which], dtype=np.int64)])[at])
                row = ids.astype(kind), many, words, size.astype(np.uint32), which.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32), texts.astype(np.int64)
                lists = [pa.LargeListArray.from_arrays(pa.array([0, b - a], pa.int64()), batch.column(f.name).slice(a, b - a)) for f in others]
                lists = [x.cast(pa.list_(x.type.value_type)) for x in lists]
                yield pa.record_batch([*(pa.array([x.tobytes()], pa.binary()) for x in row), *lists], names)

    return common.written(docs.select("text", *(f.name for f in others)).mapInArrow(run, schema), "lm-ids", "zstd")  # ids and numbers of words have few frequent values


_RUN = ("ids", "many", "words", "size", "which", "texts")


def _runs_of(batches: Iterator[pa.RecordBatch], kind: type, some: str) -> Iterator[tuple]:
    """Of each stored run, the texts that a column of booleans marks: ids, many, words, size, which, texts as arrays, and the row (a batch and
    a number) and mask of the marked texts."""
    for batch in batches:
        for i in range(len(batch)):
            ids, many, words, size, which, texts = (batch.column(c)[i].as_buffer() if c in batch.schema.names else b"" for c in _RUN)
            marked = np.asarray(batch.column(some)[i].values.to_numpy(zero_copy_only=False), bool)
            ids, many = np.frombuffer(ids, kind), np.frombuffer(many, np.int64)
            words, size, texts = np.frombuffer(words, np.int64), np.frombuffer(size, np.uint32).astype(np.int64), np.frombuffer(texts, np.int64)
            which = np.frombuffer(which, np.uint16 if len(words) <= 1 << 16 else np.uint32)
            if not marked.all():
                ids, which = (x[np.repeat(marked, n)] if len(x) else x for x, n in ((ids, many), (which, texts)))
                many, texts = (x[marked] if len(x) else x for x in (many, texts))
            if marked.any():
                yield ids, many, words, size, which, texts, (batch, i), marked


def word_counts(stored: DataFrame, kind: type) -> DataFrame:
    """word (64-bit hash), n over the training texts of stored runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(words)).astype(np.int64)
            return pa.record_batch([pa.array(words), pa.array(n)], ["word", "n"])

        for _, _, words, _, which, _, _, _ in _runs_of(batches, kind, "trains"):
            n = np.bincount(which, minlength=len(words))
            met = np.flatnonzero(n)
            held.append((words[met], n[met]))
            size += len(met)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return stored.select("words", "which", "texts", "trains").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(stored: DataFrame, path: str, kind: type) -> Model:
    """The model: ids counted and gradient steps taken on every training text of stored runs."""
    spark = stored.sparkSession
    vocabulary = encoder(path).tokenizer.get_vocab_size()
    stored = stored.select("ids", "many", "trains")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for ids, *_ in _runs_of(batches, kind, "trains"):
            total += np.bincount(ids, minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(vocabulary)
    for r in stored.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        counts[r["id"]] = r["n"]
    model = Model(counts)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        rate = 0.012 * 0.4**turn

        def steps(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            common.work_for("lm")
            own = shared.value
            p, n = {k: x.copy() for k, x in own.p.items()}, 0
            for ids, many, *_ in _runs_of(batches, kind, "trains"):
                w = own.lay_out(np.split(ids, np.cumsum(many)[:-1]))
                train(p, w, rate, EPOCHS, turn)
                n += len(w.target)
            if n:
                yield pa.record_batch([pa.array([n]), pa.array([np.concatenate([x.ravel() for x in p.values()]).tobytes()], pa.binary())], ["n", "p"])

        weight, flat = _averaged(stored.mapInArrow(steps, "n long, p binary"))
        if weight:
            at = 0
            for k, x in model.p.items():
                model.p[k] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
    return model


def _averaged(parts: DataFrame, most: int = 16) -> tuple[int, np.ndarray]:
    """The mean of p weighted by n, by tasks that average `most` rows each until `most` are left for the driver."""

    def mean(rows: list) -> tuple[int, np.ndarray]:
        n = np.array([r["n"] for r in rows])
        return int(n.sum()), np.average([np.frombuffer(r["p"], np.float32) for r in rows], axis=0, weights=n).astype(np.float32)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            n, p = mean(rows)
            yield pa.record_batch([pa.array([n]), pa.array([p.tobytes()], pa.binary())], ["n", "p"])

    parts = common.written(parts, "lm-parts")
    while (rows := parts.count()) > most:
        parts = common.written(parts.repartition(-(-rows // most)).mapInArrow(merge, "n long, p binary"), "lm-parts")
    found = parts.collect()
    return mean(found) if found else (0, np.zeros(0, np.float32))


def _mixed(count: np.ndarray | float, attention: np.ndarray, floor: float) -> np.ndarray:
    """log10 of the mean of a word's probability by counts, (count + 1) / 10 ** floor, and by attention."""
    return np.log10(0.5 * (np.asarray(count) + 1.0) * 10.0**-floor + 0.5 * 10.0 ** np.maximum(attention, -300.0))


def _held(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, in order, and counts of the words that occur oftener than some number, chosen from the sizes of classes of counts so
    that about `most` pass: a filter, so tasks send no more than what is held."""
    kinds = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("words")).collect()  # a few hundred rows
    least, total = None, 0
    for r in sorted(kinds, key=lambda r: -r["at"]):
        if total + r["words"] > most and total:
            break
        total, least = total + r["words"], r["at"]
        if total > most:
            break
    if least is None or total > 4 * most:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = counts.where(F.floor(F.log2("n") * 8) >= least).toPandas().sort_values("word")
    return held["word"].to_numpy(np.int64), held["n"].to_numpy(np.int64)


def score(docs: DataFrame, training: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text).

    Both models learn from training(doc_id, text). base_score: sum over words and the end of
    log10((c + 1) / (N + V + 1)); score: the text's log10 probability, words by the mean of the attention model's and the counts'
    probability. Null text: an empty one, which is only an end. With no training rows all words are unknown and N is 0. Repeated
    rows each get their scores; rows of one doc_id with different texts are scored apart. Very long texts are scored in
    pieces' memory, whole. Other columns, whatever their names, are not read; no rows in, no rows out.
    """
    return _score(_to_score(docs).select("*", F.lit(False).alias("trains")).union(training.select(F.lit(None), F.lit(None), "text", F.lit(False), F.lit(True))), path)


def _to_score(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.lit(True).alias("scored"))


def _score(rows: DataFrame, path: str | None = None) -> DataFrame:
    """score() where rows(doc_id, text_hash, text, scored, trains) say what they are for, so a text that is for both is encoded once."""
    spark, path = rows.sparkSession, path or public_tokenizers.path(TOKENIZER)
    common.bound_batches(spark)
    kind = np.uint16 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
    stored = _stored_ids(rows, path, kind)
    counts = common.written(word_counts(stored, kind), "words")
    ends = stored.agg(F.coalesce(F.sum(F.size(F.filter("trains", lambda x: x))), F.lit(0)).alias("n")).first()["n"]
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    floor = float(np.log10(tokens + kinds + 1))
    model = fit(stored, path, kind)
    shared = spark.sparkContext.broadcast((*_held(counts, HELD_WORDS), model))
    schema = "doc_id long, text_hash long, n_tokens long, known long, logs double, score double, word long, attention double"

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("lm")
        known, known_n, own = shared.value
        for ids, _, words, size, which, texts, (batch, i), marked in _runs_of(batches, kind, "scored"):
            row = np.repeat(np.arange(len(texts)), texts)
            place = np.searchsorted(known, words)
            place[place == len(known)] = 0
            hits = known[place] == words if len(known) else np.zeros(len(words), bool)
            counted = np.where(hits, known_n[place], 0) if len(known) else np.zeros(len(words), np.int64)
            hit, n = hits[which], counted[which]
            attention, stop = own.score(ids, size[which], texts)
            logs = np.bincount(row[hit], weights=np.log10(counted + 1.0)[which[hit]], minlength=len(texts)) + np.log10(ends + 1.0)
            got = np.bincount(row[hit], weights=_mixed(n[hit], attention[hit], floor), minlength=len(texts)) + _mixed(float(ends), stop, floor)
            n_known = np.bincount(row[hit], minlength=len(texts)) + (ends > 0)
            heads = [batch.column(c)[i].values.filter(pa.array(marked)) for c in ("doc_id", "text_hash")]
            blank, ints = pa.nulls(len(texts), pa.float64()), pa.nulls(len(texts), pa.int64())
            yield pa.record_batch([*heads, pa.array(texts + 1), pa.array(n_known), pa.array(logs), pa.array(got), ints, blank], schema_names)
            cold = np.flatnonzero(~hit)
            if len(cold):
                blank, ints = pa.nulls(len(cold), pa.float64()), pa.nulls(len(cold), pa.int64())
                yield pa.record_batch([*(h.take(pa.array(row[cold])) for h in heads), ints, ints, blank, blank, pa.array(words[which[cold]]), pa.array(attention[cold])], schema_names)

    schema_names = [c.split()[0] for c in schema.split(", ")]
    made = common.written(stored.drop("trains").mapInArrow(run_, schema), "lm-rows")
    key = ["doc_id", "text_hash"]
    n = F.coalesce("n", F.lit(0))
    mixed = F.log10(F.lit(0.5) * (n + 1) * F.lit(10.0**-floor) + F.lit(0.5) * F.pow(F.lit(10.0), F.greatest("attention", F.lit(-300.0))))
    cold = made.where("word IS NOT NULL").select(*key, "word", "attention").join(counts, "word", "left")
    cold = cold.groupBy(*key).agg(F.count("n").alias("cold_known"), F.sum(F.log10(n + 1)).alias("cold_logs"), F.sum(mixed).alias("cold_score"))
    whole = made.where("word IS NULL").select(*key, "n_tokens", "known", "logs", "score")
    alike = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))  # equal rows' words were summed together
    sums_of = ("cold_known", "cold_logs", "cold_score")
    cold = cold.join(alike, [cold[c].eqNullSafe(alike[c]) for c in key]).select(*(cold[c] for c in key), *((F.col(c) / F.col("rows")).alias(c) for c in sums_of))
    c = cold.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), *sums_of)
    more = lambda x: F.coalesce(x, F.lit(0.0))
    return whole.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + more("cold_known")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more("cold_logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + more("cold_score")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(common.crc32_of_id(), F.lit(7)) == 2
    scored = _score(_to_score(docs).select("*", (~held_out).alias("trains")))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
