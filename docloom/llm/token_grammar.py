"""Token ids on disk under Re-Pair grammars, in document order, with random access.

Documents are range-partitioned by doc_id. Each task cuts its run of documents into shards of about
SHARD_IDS ids and compresses each by itself: frequent pairs of neighbouring symbols are replaced by new
symbols (rules) until no pair occurs twice, never across the end of a document. A shard is one row of a Parquet
table: its place, doc_ids, each document's count of ids and of symbols, the ids that occur, the rules (two symbols
each), every rule's expansion length, and the symbols left. Expansion lengths say which symbols hold the ids asked
for, so any stretch of a document is decoded from those symbols and the rules alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
END = 2
SHARD_IDS = 1_000_000
#: A round replaces the pairs that are at least 1 / FALL as frequent as the most frequent one.
FALL = 256
#: Pieces that a worker remembers, about 50 bytes each. Results don't depend on it.
REMEMBERED = 2_000_000
#: Bits of the table that says which pairs occur twice.
_SEEN = 22

#: White space, as Python's \s has it; before a space; at a piece's edge, or an empty piece.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = _WHITE + " "
_AT_EDGE = rf"^{_WHITE}|{_WHITE}$|^$"
_ASCII_WORDS = re.compile(r"(?: [A-Za-z]+)+")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, then marks that are neither letters, digits nor white space; an apostrophe may begin a pre-token of letters.
_LETTERS = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~¡-©«-±´·¸»¿×÷‐-‧‰-⁞]+)$"


# ---------------------------------------------------------------- ids


class Encoder:
    """Whole texts to ids with the tokenizers library. A space between two non-spaces always begins a
    pre-token of a byte-level tokenizer, so texts are cut there and the library sees each piece once. A text
    that holds an added token goes to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.marks: dict[str, np.ndarray] = {}  # ids of runs of marks that follow letters
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.bare = self._without_splits(path)
        self.forget()

    @staticmethod
    def _without_splits(path: str) -> tokenizers.Tokenizer | None:
        """The tokenizer with pre-tokens given, one after each space, where it is byte-level, doesn't change texts and cuts them by the usual
        pattern: there letters with a space before them are one pre-token."""
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        split = own.get("pre_tokenizer") or {}
        if own.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        bare = tokenizers.Tokenizer.from_file(path)
        bare.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
        return bare

    def forget(self) -> None:
        self.known = 0  # pieces that follow a space, numbered
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0  # their ids, one piece after another
        self.starts, self.lengths = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0  # their bytes, likewise
        self.byte_starts, self.byte_lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of their bytes, in order, and their numbers

    def spell(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece by itself."""
        if self.bare is not None and len(pieces) == 1 and _ASCII_WORDS.fullmatch(pieces[0]):
            return [np.array(self.bare.encode_batch_fast([pieces[0].replace(" ", " Ġ")], add_special_tokens=False)[0].ids, np.uint32)]
        return [np.array(g.ids, np.uint32) for g in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of pieces that follow a space, -1 for those not known: by hashes, then by all their bytes."""
        data, offs, hashes = _hashed(pieces)
        if not self.known or not len(hashes):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = self.hashes.searchsorted(hashes[order])
        at[at == len(self.hashes)] = 0
        size = np.diff(offs)
        met = np.flatnonzero(self.hashes[at] == hashes)
        found = self.place[at[met]]
        met, found = (x[self.byte_lengths[found] == size[met]] for x in (met, found))
        differ = self.bytes[_runs(self.byte_starts[found], size[met])] != data[_runs(offs[met], size[met])]
        if differ.any():
            same = np.ones(len(met), bool)
            same[np.searchsorted(np.cumsum(size[met]), np.flatnonzero(differ), "right")] = False
            met, found = met[same], found[same]
        out = np.full(len(hashes), -1)
        out[met] = found
        return out

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Numbers distinct pieces that follow a space and keeps their ids. Letters before one run of other marks are two pre-tokens:
        their ids are those of the letters, which are learnt once for all marks, and those of the marks."""
        parts = pc.extract_regex(pieces, _LETTERS)
        tailed = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        cut = parts.filter(pa.array(tailed))
        cores, tails = cut.field("core").dictionary_encode(), cut.field("tail").dictionary_encode()
        of_core = self._find(cores.dictionary)
        new = np.flatnonzero(of_core < 0)
        plain = pieces.filter(pa.array(~tailed))
        whole = pa.concat_arrays([plain, cores.dictionary.take(pa.array(new))]).dictionary_encode()
        edged = pc.match_substring_regex(whole.dictionary, _AT_EDGE).to_numpy(zero_copy_only=False)
        number = np.empty(len(edged), np.int64)
        ascii_only = pc.match_substring_regex(whole.dictionary, "^[A-Za-z]+$").to_numpy(zero_copy_only=False)
        for tight in (ascii_only, ~edged & ~ascii_only):
            own = whole.dictionary.filter(pa.array(tight))
            number[tight] = self._keep(own, *self._joined(own.to_pylist()))
        if edged.any():
            rest = whole.dictionary.filter(pa.array(edged))
            number[edged] = self._keep(rest, *_flat(self.spell([" " + w for w in rest.to_pylist()])))
        number = number[whole.indices.to_numpy()]
        out = np.empty(len(pieces), np.int64)
        out[~tailed], of_core[new] = number[: len(plain)], number[len(plain) :]
        if len(cut):
            kinds = tails.dictionary.to_pylist()
            for t in kinds:
                if t not in self.marks:
                    self.marks[t] = self.spell([t])[0]
            marks, many = _flat([self.marks[t] for t in kinds])
            kind = tails.indices.to_numpy()
            place = of_core[cores.indices.to_numpy()]
            size, more = self.lengths[place], many[kind]
            lengths = size + more
            to = np.cumsum(lengths) - lengths
            ids = np.empty(int(lengths.sum()), np.uint32)
            ids[_runs(to, size)] = self.flat[_runs(self.starts[place], size)]
            ids[_runs(to + size, more)] = marks[_runs((np.cumsum(many) - many)[kind], more)]
            out[tailed] = self._keep(pieces.filter(pa.array(tailed)), ids, lengths)
        return out

    def _joined(self, pieces: list[str], most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that neither begin nor end with white space, each after a space, and how many each has. Up to `most` are
        spelled as one text: each begins with an id that begins with a space. Where those are not as many, each is spelled by itself."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(pieces), most):
            some = pieces[a : a + most]
            got = self.spell([" " + " ".join(some)])[0]
            begins = np.flatnonzero(self.spaced[got])
            if len(begins) == len(some) and begins[0] == 0:
                many = np.diff(begins, append=len(got))
            else:
                got, many = _flat(self.spell([" " + w for w in some]))
            ids.append(got)
            lengths.append(many)
        return np.concatenate(ids), np.concatenate(lengths)

    def _keep(self, pieces: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Their numbers."""
        self._put(ids, lengths)
        self.used += len(ids)
        data, offs, hashes = _hashed(pieces)
        while self.held + len(data) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.held : self.held + len(data)] = data
        self.byte_starts = np.concatenate([self.byte_starts, (self.held + offs[:-1]).astype(np.int32)])
        self.byte_lengths = np.concatenate([self.byte_lengths, np.diff(offs).astype(np.int32)])
        self.held += len(data)
        numbers = self.known + np.arange(len(hashes))
        order = np.argsort(hashes)
        at = self.hashes.searchsorted(hashes[order])
        self.hashes, self.place = np.insert(self.hashes, at, hashes[order]), np.insert(self.place, at, numbers[order])
        self.known += len(hashes)
        return numbers

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Writes ids of further pieces behind those of the known ones."""
        n, to = self.known, self.known + len(lengths)
        while to > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[n:to] = lengths
        self.starts[n:to] = self.used + np.cumsum(lengths) - lengths

    def numbers(self, pieces: pa.Array | list[str]) -> np.ndarray:
        """Numbers of distinct pieces that follow a space; new ones are learnt. A full memory is begun anew."""
        if not isinstance(pieces, pa.Array):
            pieces = pa.array(pieces, pa.large_string())
        if self.known > REMEMBERED:
            self.forget()
        found = self._find(pieces)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn(pieces.take(pa.array(new)))
        return found

    def distinct_words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that are words with single spaces between: all distinct words' ids, each spelled after a space, ids in each of
        them, their hashes, which of them each word is, and words in each text."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        many = np.diff(cut.offsets.to_numpy().astype(np.int64))
        many[[not t for t in texts]] = 0
        coded = cut.values.filter(pc.not_equal(cut.values, "")).dictionary_encode()
        place = self.numbers(coded.dictionary)
        size = self.lengths[place]
        return self.flat[_runs(self.starts[place], size)], size, _hashed(coded.dictionary)[2], coded.indices.to_numpy(), many

    def words_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' ids, ids in each word, and words in each text."""
        ids, size, _, which, many = self.distinct_words_of(texts)
        return spelled(ids, size, which), size[which], many

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, `end` after each, and len + 1 offsets."""
        whole = {i: self.spell([t])[0] for i, t in enumerate(texts) if any(a in t for a in self.added)}
        texts = ["" if i in whole else t for i, t in enumerate(texts)]
        column = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(column, _ODD_SPACE).to_numpy(zero_copy_only=False)).tolist()
        if odd:
            lists: list = pc.split_pattern(column, " ").to_pylist() if len(odd) < len(texts) else [None] * len(texts)
            for i in odd:
                lists[i] = _LONE_SPACE.split(texts[i])
            cut = pa.array(lists, pa.large_list(pa.large_string()))
        else:
            cut = pc.split_pattern(column, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        heads = cut.values.take(pa.array(at[:-1])).to_pylist()
        coded = cut.values.dictionary_encode()
        place = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        own = [*(whole.get(i, None) for i in range(len(texts)))]
        spelled = iter(self.spell([h for h, w in zip(heads, own, strict=True) if w is None]))
        first = [w if w is not None else next(spelled) for w in own]
        # each text's first piece, then the end, behind the known pieces
        n = self.known
        self._put(*_flat([*first, np.array([end], np.uint32)]))
        place[at[:-1]] = n + np.arange(len(texts))
        place = np.insert(place, at[1:], n + len(texts))
        size = self.lengths[place]
        return self.flat[_runs(self.starts[place], size)], np.concatenate([[0], np.cumsum(size)[at[1:] + np.arange(len(texts))]])


def spelled(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Ids of words, from all distinct words' ids, ids in each of them, and which of them each word is."""
    return ids[_runs((np.cumsum(size) - size)[which], size[which])]


def _hashed(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces one after another, len + 1 offsets, and a hash of each."""
    data, offs = common.text_bytes(pieces)
    return data, offs, common.word_hashes(np.append(data, np.uint8(0)), offs[:-1], offs[1:], common.CASED)  # an empty last piece begins there


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists one after another, and how many each has."""
    return np.concatenate(lists).astype(np.uint32), np.array([len(x) for x in lists], np.int64)


def _runs(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + size[i] of all i, one after another."""
    ends = np.cumsum(size)
    total, top = int(ends[-1]) if len(ends) else 0, int((starts + size).max(initial=0))
    kind = np.int32 if max(total, top) < 1 << 31 else np.int64
    take = np.repeat((starts - ends + size).astype(kind), size)
    take += np.arange(total, dtype=kind)
    return take


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


common.remembers("ids", encoder.cache_clear)


# ---------------------------------------------------------------- grammar


def compress(ids: np.ndarray, end: int = END, fall: int = FALL) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, alphabet, rules, rounds). Symbol i below len(alphabet) is the id alphabet[i]; symbol len(alphabet) + i stands
    for the two symbols rules[i]. rounds counts the rules of each round: a round's rules name symbols of earlier rounds only.

    A round counts the pairs that don't overlap themselves, takes those at least 1 / fall as frequent as the most frequent, and
    replaces them: of overlapping occurrences that of the more frequent pair (of equals, by a hash of the pair, so
    that copies are cut alike). Rounds go on until no pair without `end` occurs twice.
    """
    alphabet = np.flatnonzero(np.bincount(ids, minlength=end + 1))
    place = np.zeros(int(ids.max(initial=end)) + 1, np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    last = int(place[end]) if end in alphabet else -1
    symbols, used = place[ids], len(alphabet)
    # places whose pair may occur twice: a pair that occurs once never comes again, as new pairs hold a new symbol
    maybe = symbols != last
    maybe[:-1] &= maybe[1:]
    maybe[-1:] = False
    rules, rounds = [np.zeros((0, 2), np.int64)], []
    while len(symbols) > 1:
        narrow = used <= 1 << 16
        half = np.uint32 if narrow else np.uint64  # holds a pair; symbols take half of it
        shift = half(16 if narrow else 32)
        at = np.flatnonzero(maybe)
        left, right = symbols[at], symbols[at + 1]
        pairs = left.astype(half)
        pairs <<= shift
        pairs |= right
        twin = np.flatnonzero(left == right)
        if len(twin):  # of a run of one symbol, every second pair
            own = at[twin]
            run = np.concatenate([[True], np.diff(own) > 1])
            begin = own[run][np.cumsum(run) - 1]
            live = np.ones(len(at), bool)
            live[twin[(own - begin) % 2 == 1]] = False
            at, pairs = at[live], pairs[live]
        if not len(at):
            break
        ordered = np.sort(pairs)
        starts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        starts = np.concatenate([[0], starts])
        counts = np.diff(np.append(starts, len(ordered)))
        most = int(counts.max())
        if most < 2:
            break
        seen = np.zeros(1 << _SEEN, bool)
        seen[_slots(ordered[starts[counts >= 2]], _SEEN)] = True
        again = seen[_slots(pairs, _SEEN)]
        maybe[at[~again]] = False
        at, pairs = at[again], pairs[again]
        often = np.flatnonzero(counts >= max(2, most // fall))
        counts, kinds = counts[often], ordered[starts[often]]
        # most frequent first, equals by 12 bits of a hash, then by the pair; one sort of (count, hash, place)
        key = counts.astype(np.uint64) << np.uint64(40) | kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52) << np.uint64(28)
        key = np.sort(key | np.arange(len(often), dtype=np.uint64))[::-1]
        chosen = kinds[(key & np.uint64((1 << 28) - 1)).astype(np.int64)]
        rank = _rank_of(chosen, pairs)
        hit = np.flatnonzero(chosen[rank] == pairs)
        at, rank = at[hit], rank[hit]
        picked, rank = _apart(at, rank)
        kept = np.bincount(rank, minlength=len(chosen)) >= 2
        good = kept[rank]
        picked, rank = picked[good], rank[good]
        symbols[picked] = (np.cumsum(kept) - 1 + used)[rank]
        after = np.minimum(picked + 2, len(symbols) - 1)
        maybe[picked] = symbols[after] != last
        before = picked[picked > 0] - 1
        maybe[before] |= symbols[before] != last
        stay = np.ones(len(symbols), bool)
        stay[picked + 1] = False
        symbols, maybe = symbols[stay], maybe[stay]
        maybe[-1] = False
        own = chosen[kept]
        rules.append(np.stack([(own >> shift).astype(np.int64), (own & (half(1) << shift) - half(1)).astype(np.int64)], axis=1))
        rounds.append(len(own))
        used += len(own)
    return symbols.astype(np.int64), alphabet.astype(np.int64), np.concatenate(rules), np.array(rounds, np.int64)


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    kind = values.dtype.type
    return values * kind(0x9E3779B1 if values.dtype.itemsize == 4 else 0x9E3779B97F4A7C15) >> kind(values.dtype.itemsize * 8 - bits)


def _rank_of(chosen: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value a place in chosen, the right one if it is there: a hash table, in which the earlier of two chosen that
    meet stays; the other one waits for the next round."""
    bits = min(22, max(16, len(chosen).bit_length() + 4))
    table = np.zeros(1 << bits, np.int32)
    table[_slots(chosen, bits)[::-1]] = np.arange(len(chosen) - 1, -1, -1)
    return table[_slots(values, bits)]


def _apart(at: np.ndarray, rank: np.ndarray, tries: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places without neighbours among them, and their ranks: those that no neighbour outranks, then again among what these
    leave."""
    places, ranks = [], []
    for _ in range(tries):
        if not len(at):
            break
        near = np.diff(at) == 1
        first, second = near & (rank[:-1] < rank[1:]), near & (rank[1:] < rank[:-1])
        wins = np.ones(len(at), bool)
        wins[1:][first] = False
        wins[:-1][second] = False
        places.append(at[wins])
        ranks.append(rank[wins])
        stay = ~wins
        stay[1:] &= ~(wins[:-1] & near)
        stay[:-1] &= ~(wins[1:] & near)
        at, rank = at[stay], rank[stay]
    return (np.concatenate(places), np.concatenate(ranks)) if places else (at, rank)


def rule_lengths(first: int, rules: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """How many ids each rule stands for."""
    lengths = np.ones(first + len(rules), np.int64)
    for a, b in _spans(rounds):
        lengths[first + a : first + b] = lengths[rules[a:b]].sum(1)
    return lengths[first:]


def _spans(rounds: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(rounds)
    return list(zip((ends - rounds).tolist(), ends.tolist(), strict=True))


def expand(symbols: np.ndarray, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols: symbols of more than one id are replaced by their two until none is left."""
    first = len(alphabet)
    size = np.concatenate([np.ones(first, np.int64), lengths])
    out = np.zeros(int(size[symbols].sum()), np.uint32)
    at = np.cumsum(size[symbols]) - size[symbols]
    while len(symbols):
        done = symbols < first
        out[at[done]] = alphabet[symbols[done]]
        symbols, at = symbols[~done], at[~done]
        two = rules[symbols - first]
        at = np.stack([at, at + size[two[:, 0]]], axis=1).ravel()
        symbols = two.ravel()
    return out


def stretch(symbols: np.ndarray, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a run of symbols, from the symbols that hold them."""
    ends = np.cumsum(np.concatenate([np.ones(len(alphabet), np.int64), lengths])[symbols])
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], alphabet, rules, lengths)[start - skipped : stop - skipped]


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, lowest first, as many as the largest needs (a leading byte says how many)."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(stored: bytes) -> np.ndarray:
    width = stored[0]
    planes = np.frombuffer(stored, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


# ---------------------------------------------------------------- tables

_PACKED = ("alphabet", "rules", "rule_lengths", "symbols")
_SHARD = "part long, shard long, n_ids long, low long, high long, doc_ids array<long>, doc_ids_n array<long>, doc_symbols array<long>, " + ", ".join(f"{c} binary" for c in _PACKED)
_FIELDS = [c.split()[0] for c in _SHARD.split(", ")]
_KINDS = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3 + [pa.binary()] * 4


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encodes docs(doc_id, text), appends `end` to each document and writes shards to the folder `path`.

    Documents are in ascending order of (doc_id, hash of text), null ids first; a null text is an empty one and
    gives just the end id. Repeated rows are kept, ties in (doc_id, text) are rows alike. A document is never split over shards,
    so a very long one is a shard of its own. Other columns are not read; an empty table gives an empty folder of shards.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.work_for("ids")
        part, shard, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []

        def out() -> pa.RecordBatch:
            nonlocal shard, names, parts, sizes
            ids = np.concatenate(parts)
            symbols, alphabet, rules, rounds = compress(ids, end)
            lengths = rule_lengths(len(alphabet), rules, rounds)
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.ones(len(alphabet), np.int64), lengths])[symbols])])
            of_doc = np.diff(np.searchsorted(ends, np.cumsum([0, *sizes])))
            known = [n for n in names if n is not None]
            row = [part, shard, len(ids), min(known, default=None), max(known, default=None), names, sizes, of_doc.tolist(), *map(_narrow, (alphabet, rules.ravel(), lengths, symbols))]
            shard, names, parts, sizes = shard + 1, [], [], []
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], _FIELDS)

        held = 0
        for batch in batches:
            for some in common.slices(batch, "text", 1 << 22):
                ids, at = own.encode([t or "" for t in some.column("text").to_pylist()], end)
                for name, a, b in zip(some.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    names.append(name)
                    parts.append(ids[a:b])
                    sizes.append(b - a)
                    held += b - a
                    if held >= shard_ids:
                        yield out()
                        held = 0
        if names:
            yield out()

    order = ["doc_id", "tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


def _grammar(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, alphabet, rules, lengths of a shard."""
    alphabet, rules, lengths, symbols = (_wide(r[c]) for c in _PACKED)
    return symbols, alphabet, rules.reshape(-1, 2), lengths


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A batch's rows one at a time: a row is a shard."""
    for batch in batches:
        for i in range(len(batch)):
            yield from batch.slice(i, 1).to_pylist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document of a folder that write() made: start is the number of ids of all
    documents before it, ids its ids as little-endian unsigned 32-bit integers in a binary."""
    shards = spark.read.schema(_SHARD).parquet(path)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = shards.select("part", "shard", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as tasks wrote
    parts = parts.select("part", before(W.orderBy("part"), "n").alias("part_start"))
    places = heads.withColumn("in_part", before(W.partitionBy("part").orderBy("shard"), "n_ids")).join(parts, "part")
    placed = shards.join(places.select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("start")), ["part", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _single(batches):
            ids = expand(*_grammar(r))
            ends = np.concatenate([[0], np.cumsum(r["doc_ids_n"])]).astype(np.int64)
            data = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends[:-1]), data.cast(pa.binary())], ["doc_id", "start", "ids"])

    return placed.select("doc_ids", "doc_ids_n", *_PACKED, "start").mapInArrow(run, "doc_id long, start long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """doc_id, ids start..stop of the asked documents (all of them by default), as read() has them.

    Only shards whose range of doc_ids an asked one lies in are read, and only the symbols that hold the asked ids are
    expanded. A doc_id that is not there gives no row, one that several rows have a row each, one that is asked twice counts
    once, a null or an empty list nothing; a stretch beyond a document's end is cut there.
    """
    asked = sorted({int(i) for i in doc_ids if i is not None})
    shards = spark.read.schema(_SHARD).parquet(path)
    hit = shards.where(F.lit(False))
    if asked:
        near = shards.where((F.col("low") <= asked[-1]) & (F.col("high") >= asked[0]))  # reaches the Parquet statistics
        hit = near.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, asked)).cast("array<long>")))
    wanted = set(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _single(batches):
            symbols, *rest = _grammar(r)
            ends = np.concatenate([[0], np.cumsum(r["doc_symbols"])])
            own = [(i, a, b, n) for i, a, b, n in zip(r["doc_ids"], ends, ends[1:], r["doc_ids_n"], strict=False) if i in wanted]
            got = [stretch(symbols[a:b], *rest, start, n if stop is None else stop).astype("<u4").tobytes() for _, a, b, n in own]
            yield pa.record_batch([pa.array([i for i, *_ in own], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "ids"])

    return hit.select("doc_ids", "doc_ids_n", "doc_symbols", *_PACKED).mapInArrow(run, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-grammar")
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
