"""Forced-boundary BPE, ranked lexical search and runs of words: library, brute force and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import forced_bpe, term_pipeline, word_runs
from docloom.llm.registry import QUERIES

DOC = "doc_id long, text string"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()

# ---------------------------------------------------------------- 11 forced boundaries


@pytest.fixture(scope="module")
def own():
    return forced_bpe.Codec(public_tokenizers.path(forced_bpe.TOKENIZER), remembered=50)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(forced_bpe.TOKENIZER))


def same(own, library, texts):
    for text, got in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:200]
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(st.sampled_from("abcqzxj ''´́éñ中ßIİΣ.,!19½\n\t\x1c\x85 ​﻿"), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_forced_bpe_agrees_with_the_library(own, library, texts):
    same(own, library, texts)


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=150, deadline=None)
def test_forced_bpe_agrees_on_any_characters(own, library, texts):
    same(own, library, texts)


def test_forced_bpe_on_added_tokens_and_long_words(own, library):
    same(own, library, ["", " ", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "a" * 3000, "qzx" * 2000, "thequickbrown" * 500, "ab " * 400_000])


def test_forced_bpe_cuts_only_where_no_token_reaches(own):
    starts, final = own.fragments(np.frombuffer(b"theqzcat", np.uint8), np.array([5, 8]))
    assert 0 in starts and 5 in starts and final.tolist() == [False] * 4 + [True] + [False] * 2 + [True]
    inside = {(a, b) for token in library_vocab() for a, b in zip(token, token[1:], strict=False)}
    for x, y in [("q", "z"), ("t", "h"), ("e", "r")]:
        assert bool(own.inside[ord(x) << 8 | ord(y)] or own.at_end[ord(x) << 8 | ord(y)]) == ((x, y) in inside)


def library_vocab():
    return [t.removesuffix("</w>") for t in Tokenizer.from_file(public_tokenizers.path(forced_bpe.TOKENIZER)).get_vocab(with_added_tokens=False)]


def test_forced_bpe_query_and_odd_rows(spark, library):
    rows = [(1, "Hello it's 12"), (None, "x"), (2, None), (3, ""), (1, "Hello it's 12")]
    made = forced_bpe.decode(forced_bpe.encode(spark.createDataFrame([(*r, "old", 5) for r in rows], DOC + ", ids string, from int")))
    got = sorted(((r["doc_id"], r["ids"], r["decoded"], r["from"]) for r in made.collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False), 5))
    assert got == sorted(want, key=str)
    assert forced_bpe.decode(forced_bpe.encode(spark.createDataFrame([], DOC))).count() == 0
    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    for r in QUERIES["op11_forced_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


# ---------------------------------------------------------------- 12 lexical search


def ranked(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        best = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                best.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, b[3], -b[0]) for r, b in enumerate(sorted(best)[:k])]
    return sorted(out, key=str)


def test_lexical_search_is_the_plain_ranking(spark):
    r = random.Random(5)
    word = lambda: r.choice("the of and".split()) if r.random() < 0.5 else "".join(r.choice("abcé") for _ in range(r.randrange(1, 4)))
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 40)))) for i in range(400)]
    docs += [(9, "The, of-AND"), (9, "The, of-AND"), (None, "the abc"), (401, None), (402, " .. "), (403, "É é ÀB_c")] + [(500 + i, "abc the") for i in range(60)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(300)] + [(7, "abc the"), (300, None), (301, ""), (302, "zzzz"), (None, "the É")]
    frame = spark.createDataFrame([(*d, "old", 1) for d in docs], DOC + ", score string, m int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k, options in ((10, {"block_docs": 64}), (3, {"block_docs": 5000, "owners": (0.5,)}), (10, {"pass_chars": 900, "owners": (0.01, 0.02, 0.2, 0.6)})):
        got = term_pipeline.search(frame, asked, k, **options).collect()
        assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in got), key=str) == ranked(docs, items, k)


def test_lexical_search_on_empty_tables(spark):
    none, one = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], DOC)
    ask = lambda df: df.withColumnRenamed("doc_id", "item_id")
    assert term_pipeline.search(none, ask(one)).count() == 0
    assert term_pipeline.search(one, ask(none)).count() == 0
    assert [tuple(r) for r in term_pipeline.search(one, ask(one)).collect()][0][:3] == (1, 1, 1)
    long = spark.createDataFrame([(1, "a b " * 300_000), (2, "a")], DOC)
    assert {(r["doc_id"], r["rank"]) for r in term_pipeline.search(long, ask(one)).collect()} == {(1, 1), (2, 2)}


# ---------------------------------------------------------------- 13 runs


def plain_runs(x, least=24, times=3):
    n, seen = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                seen.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in seen.items()), key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 9), st.sampled_from([(2, 2), (6, 2), (6, 3)]))
@settings(max_examples=400, deadline=None)
def test_runs_are_those_of_brute_force(x, period, bounds):
    for y in (x, [x[i % period % len(x)] for i in range(3 * len(x))]):
        assert list(zip(*(a.tolist() for a in word_runs.runs_of(np.array(y, np.int64), *bounds)), strict=True)) == plain_runs(y, *bounds)


@given(st.lists(st.tuples(st.integers(0, 120), st.integers(1, 40), st.integers(0, 10), st.integers(1, 3)), max_size=5), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_runs_of_several_texts(shapes, r):
    texts = []
    for n, p, a, kinds in shapes:
        x = [str(r.randrange(kinds * 9)).encode() for _ in range(n)]
        texts.append([w if i < a else x[(a + (i - a) % p) % n] for i, w in enumerate(x)])
    got = defaultdict(list)
    for i, *run in zip(*(a.tolist() for a in word_runs.runs_in(texts)), strict=True):
        got[i].append(tuple(run))
    assert [got[i] for i in range(len(texts))] == [plain_runs(t) for t in texts]


def expected(doc_id, text):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, x = h // 10, (text or "").encode().split()
    n = len(x)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
    runs, drop = plain_runs(x), set()
    for s, length, q in runs:
        drop |= set(range(s + q, s + length))
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(b" ".join(w for i, w in enumerate(x) if i not in drop)))


def test_runs_query_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = QUERIES["op13_periodic_runs"](spark, SF).collect()
    short = {i for i, t in rows if len(t or "") < 6000}
    assert len(got) == len(rows)
    assert sorted((tuple(r) for r in got if r["doc_id"] in short), key=str) == sorted((expected(i, t) for i, t in rows if i in short), key=str)


def test_runs_on_odd_rows(spark):
    ten = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, "a b " * 20), (None, "x " * 24), (2, None), (3, ""), (ten, " \t"), (ten, "one"), (ten, "c d e f g h " * 30), (1, "a b " * 20), (4, "é x " * 30), (5, "A a " * 11), (6, "x\x1cy " * 25)]
    df = spark.createDataFrame([(*r, 5, "old") for r in rows], DOC + ", n_words int, from string")
    got = word_runs.find_runs(df).collect()
    assert sorted((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"], r["from"]) for r in got if r["doc_id"] in (1, 5)) == [(1, [(0, 40, 2)], "a b", "old")] * 2 + [(5, [], ("A a " * 11).strip(), "old")]
    assert {r["doc_id"]: r["n_words"] for r in got}[None] == 24
    assert word_runs.find_runs(spark.createDataFrame([], DOC)).count() == 0
    long = " ".join(str(i % 50_000) for i in range(200_000))
    one = word_runs.find_runs(spark.createDataFrame([(1, long)], DOC)).first()
    assert [tuple(x) for x in one["runs"]] == [(0, 200_000, 50_000)] and one["collapsed"] == " ".join(map(str, range(50_000)))
