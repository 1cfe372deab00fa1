"""Byte-level BPE by rank files: encoding with a rank queue, decoding by table.

Merges of one pre-token are driven by a queue with a bucket for each merge rank. A bucket holds
positions of the pre-token's linked list of parts; a bitmap of two levels, with words of 256 bits,
says which buckets hold something, so finding the next rank takes two find-first-set steps however long
the pre-token is. An entry whose part has been merged away, or whose pair has changed, is skipped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words that a Python worker remembers, in two generations. Results don't depend on it.
REMEMBERED = 500_000

#: Pre-tokens that share a queue at most; each has less than 64 characters.
TOGETHER = 50_000

_ODD_SPACE = re.compile(r"\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, remembered: int = REMEMBERED):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        most = max(self.ranks.values())
        #: The rank queue: positions (a heap, leftmost first) by rank, and the bitmap's lower level.
        self.buckets: dict[int, list[int]] = {}
        self.leaf = [0] * ((most >> 8) + 1)
        self.of_two = [self.ranks.get(bytes((x, y)), -1) for x in range(256) for y in range(256)]
        self.two = np.array(self.of_two)
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.remembered = remembered
        self.forget()
        get = self.ranks.get
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None
        ]
        made = np.array(pairs, np.int64).reshape(-1, 3)
        self.after, self.before = _Pairs(made[:, 0], made[:, 1], made[:, 2], most + 1), _Pairs(made[:, 1], made[:, 0], made[:, 2], most + 1)
        spelled = {rank: token for token, rank in self.ranks.items()}
        n = max(spelled) + 1
        self.table = _Table([spelled.get(i, b"") for i in range(n)])

    def forget(self) -> None:
        """Remembers no words. Spark takes the workers of an executor in turn, so what one keeps between tasks all of them keep."""
        self.words = _Words(self)
        self.pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, longest, n = self.ranks.get, self.longest, len(piece)
        buckets, leaf, top = self.buckets, self.leaf, 0  # all empty here
        end = list(range(1, n + 1))  # where the part that starts here ends; the next part starts there
        back = list(range(-1, n))  # start of the part before
        pair = [-1] * (n + 1)  # rank of the part that starts here merged with its successor, or -1
        of_two, i = self.of_two, 0
        for x, y in zip(piece, piece[1:]):  # noqa: B905, RUF007
            rank = pair[i] = of_two[x << 8 | y]
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    a = rank >> 8
                    leaf[a] |= 1 << (rank & 255)
                    top |= 1 << a
                else:
                    bucket.append(i)  # ascending, so a heap
            i += 1
        while top:
            a = (top & -top).bit_length() - 1  # find first set, level by level
            word = leaf[a]
            rank = a << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                word &= word - 1
                leaf[a] = word
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            pair[j] = pair[i] = -1
            fresh = ()
            if stop < n:
                back[stop] = i
                if end[stop] - i <= longest and (rank := get(piece[i : end[stop]], -1)) >= 0:
                    pair[i] = rank
                    fresh = (i,)
            if i:
                h = back[i]
                rank = get(piece[h:stop], -1) if stop - h <= longest else -1
                if rank != pair[h]:
                    pair[h] = rank
                    if rank >= 0:
                        fresh += (h,)
            for i in fresh:
                rank = pair[i]
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [i]
                    a = rank >> 8
                    leaf[a] |= 1 << (rank & 255)
                    top |= 1 << a
                else:
                    heappush(bucket, i)
        ranks = self.ranks
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each of many pre-tokens, as little-endian 32-bit integers, by one queue."""
        none = len(self.leaf) << 8  # the token of the gaps between pieces, which no pair holds
        data = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size + 1)  # the gap after each piece
        token = np.array([self.ranks.get(bytes((x,)), -1) for x in range(256)])[data]
        token[0] = token[ends] = none
        if (token < 0).any():
            raise KeyError("a byte without a rank")
        word = np.repeat(np.arange(-1, len(pieces)), np.concatenate([[1], size + 1]))
        n = len(data)
        after, back = np.arange(1, n + 1), np.arange(-1, n)  # starts of the parts around the part that starts here
        pair = np.full(n, -1)  # rank of the part that starts here merged with its successor, or -1
        pair[:-1] = self.two[data[:-1].astype(np.int64) << 8 | data[1:]]
        pair[0] = pair[ends] = pair[ends - 1] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        found, cuts = np.unique(pair[at], return_index=True)
        buckets, leaf, top = self.buckets, self.leaf, 0  # all empty here
        for rank, own in zip(found.tolist(), np.split(at, cuts[1:]), strict=False):
            buckets[rank] = own.tolist()
            leaf[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        while top:
            a = (top & -top).bit_length() - 1  # find first set, level by level
            bits = leaf[a]
            rank = a << 8 | (bits & -bits).bit_length() - 1
            i = np.array(buckets.pop(rank))
            i = i[pair[i] == rank]  # others are stale
            later = ()
            if len(i) > 1:
                i.sort()
                own = word[i]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                if not first.all():
                    later, i = i[~first].tolist(), i[first]
            if later:
                buckets[rank] = later
            else:
                bits &= bits - 1
                leaf[a] = bits
                if not bits:
                    top &= top - 1
            if not len(i):
                continue
            j = after[i]
            stop = after[j]
            h = back[i]
            token[i] = rank
            after[i] = stop
            back[stop] = i
            pair[j] = -1
            pair[i] = now = self.after.find(rank, token[stop])
            pair[h] = old = self.before.find(rank, token[h])
            for own, ranks in ((i, now), (h, old)):
                fresh = np.flatnonzero(ranks >= 0)
                for x, rank in zip(own[fresh].tolist(), ranks[fresh].tolist(), strict=True):
                    bucket = buckets.get(rank)
                    if bucket is None:
                        buckets[rank] = [x]
                        a = rank >> 8
                        leaf[a] |= 1 << (rank & 255)
                        top |= 1 << a
                    else:
                        bucket.append(x)
        held = np.zeros(n, bool)  # where parts start: followed from all pieces' starts together
        at = ends - size
        while len(at):
            held[at] = True
            at = after[at]
            at = at[token[at] != none]
        at = np.flatnonzero(held)
        ids, to = token[at].astype("<u4").tobytes(), (np.searchsorted(at, ends) * 4).tolist()
        return [ids[x:y] for x, y in zip([0, *to], to, strict=False)]

    def _split_words(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of each word after a space. Words without white space are split as one text: each begins with a space."""
        got = self.split(" " + " ".join(words))
        starts = [i for i, p in enumerate(got) if p[0] == " "]
        if len(starts) != len(words):
            return [self.split(" " + w) for w in words]
        return [got[a:b] for a, b in zip(starts, [*starts[1:], len(got)], strict=True)]

    def learn(self, cuts: list[list[str]]) -> None:
        """Remembers the words of many texts, as `_cut` gives them; new ones are worked out together, but for very long ones."""
        words, older, pieces = self.words, self.words.older, self.pieces
        met: set[str] = set()
        for own in cuts:
            met.update(own[1:])
        new = [w for w in met if w not in words and w not in older and len(w) < 64]
        odd = [w for w in new if w.split() != [w]]
        if odd:
            apart = set(odd)
            new = [w for w in new if w not in apart]
        cut = self._split_words(new) if new else []
        new += odd
        cut += [self.split(" " + w) for w in odd]
        fresh = {p for own in cut for p in own if p not in pieces and not (p[0] == " " and (p[1:] in words or p[1:] in older))}
        if len(pieces) + len(fresh) >= 100_000:
            fresh.update(p for own in cut for p in own if p in pieces)
            pieces.clear()
        some = list(fresh)
        got: dict[str, bytes] = {}
        coded = [p.encode() for p in some]
        whole = [self.ranks.get(p) for p in coded]
        got.update((p, pack("<I", rank)) for p, rank in zip(some, whole, strict=True) if rank is not None)
        rest = [i for i, rank in enumerate(whole) if rank is None]
        for a in range(0, len(rest), TOGETHER):
            own = rest[a : a + TOGETHER]
            got.update(zip([some[i] for i in own], self.merge_together([coded[i] for i in own]), strict=True))
        for p, ids in got.items():
            if p[0] == " ":
                words[p[1:]] = ids
            else:
                pieces[p] = ids
        for w, own in zip(new, cut, strict=True):
            if len(own) > 1:
                words[w] = b"".join([(words.get(p[1:]) or older[p[1:]]) if p[0] == " " else pieces[p] for p in own])

    def chunk(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of text that starts and ends at pre-token borders."""
        out = []
        for piece in self.split(text):
            ids = (self.words.get(piece[1:]) or self.words.older.get(piece[1:])) if piece[:1] == " " else self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= 100_000:
                    self.pieces.clear()
                got = self.merge(piece.encode())
                ids = pack(f"<{len(got)}I", *got)
                if len(piece) < 64:
                    if piece[:1] == " ":
                        self.words[piece[1:]] = ids
                    else:
                        self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out) if len(out) != 1 else out[0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. A space between two non-spaces always begins a pre-token, so the text is
        cut there first and repeated words are looked up."""
        return self._looked_up(_cut(text))

    def encode_together(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; their new words are worked out together."""
        cuts = [_cut(t) for t in texts]
        self.learn(cuts)
        return [self._looked_up(own) for own in cuts]

    def _looked_up(self, words: list[str]) -> bytes:
        first = self.chunk(words[0])
        del words[0]
        if len(self.words) >= self.remembered // 2:
            self.words.age()
        return first + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.table.spell(ids)[0]


def _cut(text: str) -> list[str]:
    """A text cut at each space between two non-spaces."""
    return _LONE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")


class _Pairs:
    """Tokens' partners on one side, in order, and the ranks of what they make together."""

    def __init__(self, token: np.ndarray, partner: np.ndarray, rank: np.ndarray, n: int):
        order = np.lexsort((partner, token))
        self.partners, self.ranks = partner[order], rank[order]
        self.at = np.searchsorted(token[order], np.arange(n + 1)).tolist()

    def find(self, token: int, partners: np.ndarray) -> np.ndarray:
        """Ranks of one token with each of many partners; -1 where they make none."""
        a, b = self.at[token], self.at[token + 1]
        if a == b:
            return np.full(len(partners), -1)
        place = self.partners[a:b].searchsorted(partners)
        place[place == b - a] = 0
        place += a
        return np.where(self.partners[place] == partners, self.ranks[place], -1)


class _Words(dict):
    """Ids of words that follow a space, worked out when first asked for. Words of the generation before are asked before that;
    those not asked for during a whole generation are forgotten."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.chunk(" " + word)
        if len(word) < 64:
            self[word] = ids
        return ids

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


class _Table:
    """Byte strings by number, joined for an array of numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings one after another, and len + 1 offsets."""
        lengths = self.lengths[numbers]
        ends = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        at = np.repeat(self.starts[numbers] - ends[:-1], lengths)
        at += np.arange(len(at))
        return self.flat[at], ends


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


common.remembers("bpe", codec.cache_clear)


def _lists(ids: list[bytes]) -> pa.ListArray:
    offs = np.cumsum([0, *map(len, ids)]) // 4
    values = pa.Array.from_buffers(pa.int32(), int(offs[-1]), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)


def _spelled(own: Codec, column: pa.ListArray) -> Iterator[tuple[int, int, pa.Array]]:
    """Runs of rows of a column of ids, and their bytes."""
    rows = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    for a, b in common.byte_runs(rows * 4):
        data, ends = own.table.spell(values[rows[a] : rows[b]])
        made = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends[rows[a : b + 1] - rows[a]].copy()), pa.py_buffer(data)])
        yield a, b, made.cast(pa.binary())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs but `text`, and `out`: array<int> of the text's ids, special tokens unused.

    The rank file must be at `path` on every executor. Null text: no ids, as for an empty one. Texts of
    any length are encoded whole; an existing column named `out` is replaced. Keeps every row.
    """
    path = path or public_tokenizers.path(RANKS)
    common.bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("bpe")
        own = codec(path)
        for batch in batches:
            made = _lists(own.encode_together([t or "" for t in batch.column(text).to_pylist()]))
            yield pa.record_batch([*(batch.column(f.name) for f in kept), made], [*(f.name for f in kept), out])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text)).mapInArrow(run, StructType([*kept, StructField(out, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and `out`: the bytes that the ids stand for. Null ids give no bytes."""
    path = path or public_tokenizers.path(RANKS)
    kept = [f for f in encoded.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("bpe")
        own = codec(path)
        for batch in batches:
            column = batch.column(ids)
            column = column.fill_null([]) if column.null_count else column
            for a, b, made in _spelled(own, column):
                yield pa.record_batch([*(batch.column(f.name).slice(a, b - a) for f in kept), made], [*(f.name for f in kept), out])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return encoded.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, StructType([*kept, StructField(out, BinaryType())]))


def encode_and_decode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """What decode(encode(docs)) returns, by one Python worker a task: two would each hold a codec and its memory of words."""
    path = path or public_tokenizers.path(RANKS)
    common.bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name not in (text, ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("bpe")
        own = codec(path)
        for batch in batches:
            lists = _lists(own.encode_together([t or "" for t in batch.column(text).to_pylist()]))
            for a, b, made in _spelled(own, lists):
                yield pa.record_batch([*(batch.column(f.name).slice(a, b - a) for f in kept), lists.slice(a, b - a), made], [*(f.name for f in kept), ids, out])
        own.forget()
        common.give_back()

    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    schema = StructType([*kept, StructField(ids, ArrayType(IntegerType())), StructField(out, BinaryType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode(encoded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
