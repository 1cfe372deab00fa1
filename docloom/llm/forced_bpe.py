"""BPE encoding and decoding with forced boundaries, for tokenizer files that mark the ends of words.

A merge makes a vocabulary token, so two neighbouring bytes that stand side by side inside no token can never be merged into
one: between them there is a certain cut. A pre-token falls into fragments at its certain cuts; each fragment is encoded
by itself, and their ids one after another are the pre-token's. The last byte of a pre-token carries the end-of-word
mark, so it has a table of pairs of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from . import common

TOKENIZER = "word_bpe_49k.json"
#: Words that a Python worker remembers, in two generations. Results don't depend on it.
REMEMBERED = 500_000
#: Fragments from this length on are merged by a heap each, shorter ones all at once.
LONG = 48
#: Above all ranks.
NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file: a byte-level BPE whose pre-tokens never hold white space."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        own = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        model, letters = spec["model"], byte_letters()
        mark, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        byte_of = {c: b for b, c in enumerate(letters)}
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or not mark:
            raise ValueError("not a BPE with marked ends of words")
        if own.pre_tokenizer.pre_tokenize_str("a b") != [("a", (0, 1)), ("b", (2, 3))]:
            raise ValueError("pre-tokens hold white space")
        self.byte_of = byte_of
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + mark] for c in letters], np.int64)
        self.n = len(vocab)
        #: (left id, right id) as one number -> (rank, id of both).
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] * self.n + vocab[b]] = rank, vocab[a + b]
        self.pairs = np.array([*sorted(self.merges), NEVER * NEVER], np.int64)
        self.pair_ranks = np.array([*(self.merges[k][0] for k in sorted(self.merges)), NEVER], np.int64)
        self.made = np.array([made for _, made in sorted(self.merges.values())], np.int64)
        #: 1 where two neighbouring bytes occur inside a token: for most pairs, and for those whose second byte ends a word.
        self.inside, self.at_end = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for token in vocab:
            marked = token.endswith(mark)
            spelled = [byte_of[c] for c in (token[: -len(mark)] if marked else token)]
            for i, (x, y) in enumerate(zip(spelled, spelled[1:])):  # noqa: B905, RUF007
                (self.at_end if marked and i == len(spelled) - 2 else self.inside)[x << 8 | y] = 1
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in s) for s, t in added.items()):
            raise ValueError("added tokens with rules of their own")
        self.added = {s: t["id"] for s, t in added.items()}
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        tokens = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in (vocab | self.added).items():
            tokens[i] = token.encode()
        self.tokens = tokens
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.remembered = remembered
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    # ------------------------------------------------------------ fragments

    def fragments(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of fragments of pre-tokens laid one after another, and the places of bytes that end a pre-token. stops are
        the pre-tokens' ends; a cut is wherever it is certain."""
        final = np.zeros(len(data), bool)
        final[stops - 1] = True
        pairs = data[:-1].astype(np.int64) << 8 | data[1:]
        cut = np.ones(len(data), bool)
        cut[1:] = final[:-1] | (np.where(final[1:], self.at_end[pairs], self.inside[pairs]) == 0)
        return np.flatnonzero(cut), final

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where there is no such merge."""
        keys = left * self.n + right
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.pair_ranks[at], NEVER)

    def merged(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens laid one after another: an array over their bytes, and which of its places hold an id.

        All fragments are merged at once: in each round every fragment merges its pair of lowest rank, the leftmost of
        equals, and those without one are done. A long fragment has a heap of its own."""
        starts, final = self.fragments(data, stops)
        flat = np.where(final, self.final[data], self.inner[data])
        held = np.zeros(len(data), bool)
        sizes = np.diff(starts, append=len(data))
        for a, size in zip(starts[sizes >= LONG].tolist(), sizes[sizes >= LONG].tolist(), strict=True):
            done = self.merged_long(flat[a : a + size].tolist())
            flat[a : a + len(done)] = done
            held[a : a + len(done)] = True
        place = np.flatnonzero(np.repeat(sizes < LONG, sizes))
        sizes = sizes[sizes < LONG]
        ids = flat[place]
        starts = np.cumsum(sizes) - sizes
        ranks = np.full(len(ids), NEVER, np.int64)
        if len(ids) > 1:
            ranks[:-1] = self.ranks_of(ids[:-1], ids[1:])
            ranks[starts[1:] - 1] = NEVER
        while len(starts):
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), starts)
            rank, at = best >> 32, best & 0xFFFFFFFF
            going = rank < NEVER
            sizes = np.diff(starts, append=len(ids))
            keep = np.repeat(going, sizes)
            done = place[~keep]
            flat[done], held[done] = ids[~keep], True
            at = at[going]
            ids[at] = self.made[rank[going]]
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, ranks, place, sizes = ids[keep], ranks[keep], place[keep], sizes[going] - 1
            starts = np.cumsum(sizes) - sizes
            right, left = at[at < starts + sizes - 1], at[at > starts] - 1
            ranks[at] = NEVER
            ranks[right] = self.ranks_of(ids[right], ids[right + 1])
            ranks[left] = self.ranks_of(ids[left], ids[left + 1])
        return flat, held

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one long fragment, with a heap of (rank, place): n log n steps."""
        get, n, m = self.merges.get, self.n, len(ids)
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))
        heap = [(found[0], i, found[1]) for i in range(m - 1) if (found := get(ids[i] * n + ids[i + 1]))]
        heapify(heap)
        while heap:
            rank, i, made = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= m or get(ids[i] * n + ids[j]) != (rank, made):
                continue  # one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < m:
                before[k] = i
                if found := get(made * n + ids[k]):
                    heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := get(ids[h] * n + made)):
                heappush(heap, (found[0], h, found[1]))
        return [x for x in ids if x >= 0]

    # ------------------------------------------------------------ texts

    def pieces(self, word: bytes) -> list[bytes | int]:
        """Pre-tokens, as bytes, and ids of added tokens of a stretch between white space. Nothing reaches over ASCII white
        space: neither normal forms nor pre-tokens nor added tokens. Below U+0300, where each letter is its own normal
        form and all versions of Unicode agree, the pattern is tried here; other words go through the file's own rules."""
        out: list[bytes | int] = []
        text = word.decode()
        for part in self.cut_added.split(text) if self.cut_added and self.cut_added.search(text) else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif max(word) < 0xCC:
                if part[:-1].isalpha() and part[-1] in ".,;:!?" and "\u0130" not in part:  # which alone has a mark in lower case
                    out += [part[:-1].lower().encode(), part[-1:].encode()]
                else:
                    out += [p.encode() for p in self.split(part.lower())]
            elif part:
                out += [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.pre_tokenize(self.normalize(part))]
        return out

    def learn(self, words: list[bytes]) -> None:
        """Works out the ids of words that aren't remembered: the fragments of all of them at once."""
        pieces: list[bytes] = []
        upto: list[int] = []
        fixed: list[tuple[int, int]] = []
        for word in words:
            if word.isalpha():
                pieces.append(word.lower())
            else:
                for piece in self.pieces(word):
                    if isinstance(piece, int):
                        fixed.append((len(pieces), piece))
                        pieces.append(b"\0")  # a place for the id
                    else:
                        pieces.append(piece)
            upto.append(len(pieces))
        if not pieces:
            self.words.update((w, b"") for w in words)
            return
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        flat, held = self.merged(np.frombuffer(b"".join(pieces), np.uint8), stops)
        for i, added in fixed:
            flat[stops[i] - 1] = added
        ids = flat[held].astype("<u4").tobytes()
        before = np.append(0, np.cumsum(held))
        ends = before[np.append(0, stops)[upto]] * 4
        a = 0
        for word, b in zip(words, ends.tolist(), strict=True):
            self.words[word] = ids[a:b]
            a = b

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts in UTF-8, as little-endian 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for run in _runs(texts):
            words = [stretch.split() for _, stretch in run]
            new = set().union(*words).difference(self.words)
            if new:
                if len(self.words) >= self.remembered // 2:
                    self.older, self.words = self.words, {}
                    new = set().union(*words)
                have = new & self.older.keys()
                self.words.update((w, self.older[w]) for w in have)
                self.learn(list(new - have))
            for (i, _), w in zip(run, words, strict=True):
                out[i].append(b"".join(map(self.words.__getitem__, w)))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, ids: list[int]) -> bytes:
        """The file names no decoder: tokens as they are spelled, one space between."""
        return b" ".join(map(self.tokens.__getitem__, ids))


_CUT = re.compile(rb"[\t-\r ]")


def _runs(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[tuple[int, bytes]]]:
    """(number of the text, stretch of it) in runs of about `most` bytes; longer texts are cut at white space."""
    run, size = [], 0
    for i, text in enumerate(texts):
        a = 0
        while True:
            cut = _CUT.search(text, a + most) if len(text) - a > most else None
            stretch = text[a : cut.start()] if cut else text[a:] if a else text
            run.append((i, stretch))
            size += len(stretch)
            if size >= most:
                yield run
                run, size = [], 0
            if not cut:
                break
            a = cut.end()
    if run:
        yield run


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


common.remembers("forced-bpe", codec.cache_clear)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs but `text`, and `out`: array<int> of the text's ids, no special tokens put around it.

    Added tokens spelled out in a text get their own ids, as in the library. The file must be at `path` on every executor.
    Null text: no ids, as for an empty one. Repeated rows are encoded each for itself, texts of any length whole; a
    column named `out` that docs has already is replaced. Keeps every row; an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    common.bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("forced-bpe")
        own = codec(path)
        for batch in batches:
            ids = own.encode([t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()])
            offs = np.cumsum([0, *map(len, ids)]) // 4
            values = pa.Array.from_buffers(pa.int32(), int(offs[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)], [*(f.name for f in kept), out])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`")).mapInArrow(run, StructType([*kept, StructField(out, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and `out`: the tokens of the ids with one space between them. Null ids give an empty text."""
    path = path or public_tokenizers.path(TOKENIZER)
    kept = [f for f in encoded.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("forced-bpe")
        own = codec(path)
        for batch in batches:
            column = batch.column(ids)
            rows, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            texts = [own.decode(values[rows[i] : rows[i + 1]].tolist()) if known[i] else b"" for i in range(len(column))]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(texts, pa.binary()).cast(pa.string())], [*(f.name for f in kept), out])

    return encoded.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, StructType([*kept, StructField(out, StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
