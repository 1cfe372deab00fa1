"""Vector search for many queries, dictionaries as tables, tables that change, stored results of plug-ins, streaming state."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import answers, cleaning, embedding, layout, stored, vectors
from docloom.operators.dictionary import Terms
from docloom.plans import derived
from docloom.streaming.ingest import incremental_ingest

# ---------------------------------------------------------------- R4, R5


def plain_nearest(chunks, queries, n, threshold, allowed=lambda q, c: True):
    usable = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out = []
    for q in queries:
        if not usable(q[1]):
            continue
        a = np.array(q[1], float)
        found = []
        for c in chunks:
            if usable(c[1]) and len(c[1]) == len(q[1]) and allowed(q, c):
                b = np.array(c[1], float)
                s = round(float(a / np.sqrt((a * a).sum()) @ (b / np.sqrt((b * b).sum()))), 12)
                if threshold is None or s >= threshold:
                    found.append((-s, c[0], c[2]))
        out += [(q[0], c, d, r + 1) for r, (_, c, d) in enumerate(sorted(found)[:n])]
    return sorted(out)


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(2)
    near = lambda: [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]
    chunks = [(i, near(), i // 3 if i % 5 else None, r.choice("ab"), r.choice(["x", "y", None])) for i in range(300)]
    chunks += [(300, None, 1, "a", "x"), (301, [], 1, "a", "x"), (302, [0.0, 0.0, 0.0], 1, "a", "x"), (303, [1.0, float("nan"), 1.0], 1, "a", "x"), (304, [1.0, None, 1.0], 1, "a", "x"), (305, [1.0, 2.0], 1, "a", "x"), (306, [float("inf"), 1.0, 0.0], 1, "a", "x"), (7, [1.0, 1.0, 1.0], 9, "a", "x")]
    queries = [(i, near(), r.choice([None, "a", "b"]), r.choice([None, [], ["x"], ["x", "y"], [None, "y"]])) for i in range(60)]
    queries += [(60, None, None, None), (61, [2.0, 4.0], None, None), (62, [0.0] * 3, None, None), (63, [1.0, float("nan"), 0.0], None, None), (64, [1.0, None, 0.0], None, None)]
    return chunks, queries


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "row_packs": 1}, {"broadcast_bytes": 0, "row_packs": 3}])
def test_nearest_is_brute_force(spark, mixed, options, monkeypatch):
    monkeypatch.setattr(vectors, "PACK_QUERIES", 16)
    monkeypatch.setattr(vectors, "PACK_CHUNKS", 50)
    chunks, queries = mixed
    c = spark.createDataFrame(chunks, "id long, embedding array<float>, document_id long, _a string, _b string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query_embedding array<float>, fa string, fb array<string>").repartition(2)
    allowed = lambda q, c: (q[2] is None or q[2] == c[3]) and (not q[3] or (c[4] is not None and c[4] in q[3]))
    for n, threshold in ((4, None), (400, 0.5)):
        got = vectors.nearest(c, q, n, threshold, carry=["document_id"], **options).collect()
        assert sorted((r["query_id"], r["id"], r["document_id"], r["vec_rank"]) for r in got) == plain_nearest(chunks, queries, n, threshold)
    got = vectors.nearest(c, q, 5, 0.1, {"fa": "_a", "fb": "_b"}, ["document_id"], **options).collect()
    assert sorted((r["query_id"], r["id"], r["document_id"], r["vec_rank"]) for r in got) == plain_nearest(chunks, queries, 5, 0.1, allowed)


def test_nearest_hands_on_what_it_can_not_hold(spark, mixed, monkeypatch):
    monkeypatch.setattr(vectors, "HELD_ROWS", 0)
    monkeypatch.setattr(vectors, "PACK_CHUNKS", 20)
    chunks, queries = mixed
    c = spark.createDataFrame([x[:3] for x in chunks], "id long, embedding array<double>, document_id long")
    q = spark.createDataFrame([x[:2] for x in queries], "query_id long, query_embedding array<double>")
    got = vectors.nearest(c, q, 3, None, carry=["document_id"]).collect()
    assert sorted((r["query_id"], r["id"], r["document_id"], r["vec_rank"]) for r in got) == plain_nearest(chunks, queries, 3, None)
    assert vectors.nearest(c, q.limit(0), 3).count() == 0
    assert vectors.nearest(c.limit(0), q, 3).count() == 0


# ---------------------------------------------------------------- C9, A5

EDGE = "A-Za-z一-鿿"


def plain_terms(text, pairs, edge=EDGE, flags=re.IGNORECASE):
    hits, first = [], {}
    for term, full in sorted(pairs):
        first.setdefault(term, full)
    for term, full in sorted(first.items(), key=lambda p: (-len(p[0]), p[0])):
        if text.isascii() and term.isascii() and term.lower() not in text.lower():
            continue  # compiling is what takes time
        around = (f"(?<![{edge}])", f"(?![{edge}])") if edge else ("", "")
        new, n = re.subn(around[0] + re.escape(term) + around[1], lambda m, full=full: full, text, flags=flags)
        if n:
            hits.append(term)
            text = new
    return text, hits


@given(st.text("aAbB 台.İıſsß", max_size=40), st.lists(st.tuples(st.text("aAbB 台.İıſsß", min_size=1, max_size=4), st.text("aAb .台", max_size=5)), max_size=12))
@settings(max_examples=400, deadline=None)
def test_terms_are_replaced_one_after_another(text, pairs):
    assert Terms(pairs, EDGE, True).apply(text) == plain_terms(text, pairs)
    assert Terms(pairs).apply(text) == plain_terms(text, pairs, "", 0)


def test_a_dictionary_of_twenty_thousand_terms(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    pairs = list({word() if r.random() < 0.8 else f"{word()} {word()}": word().upper() + r.choice(["", " x", "-y"]) for _ in range(26_000)}.items())[:20_000]
    texts = [" ".join(r.choice([word(), r.choice(pairs)[0]]) for _ in range(60)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")]
    terms = spark.createDataFrame([*pairs, (None, "z"), ("", "z"), (pairs[0][0], "~~~")], "term string, full_name string")
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("terms_applied", F.lit("old"))
    want = {i: plain_terms(t, pairs) for i, t in enumerate(texts)} | {90: (None, []), 91: ("", [])}
    assert {x["doc_id"]: (x["text"], x["terms_applied"]) for x in cleaning.apply_terms(df, terms).collect()} == want
    from docloom.operators import dictionary

    parts = dictionary.replace_terms(df.drop("terms_applied"), terms, "text", "h", "A-Za-z\\u4e00-\\u9fff", True, part_chars=60_000)
    assert {x["doc_id"]: (x["text"], x["h"]) for x in parts.collect()} == want


def test_companies_of_a_table(spark):
    q = spark.createDataFrame([(1, "abc ab 比較"), (2, "aabcb x"), (3, None)], "query_id long, question string")
    names = spark.createDataFrame([("abc",), ("ab",), ("ab",), (None,)], "company string")
    got = {r["query_id"]: r["values"] for r in answers.detect_comparison(q, names).collect()}
    assert got == {1: ["abc", "ab"], 2: ["abc", "ab"], 3: None}  # what is left when a name is taken out may hold another


# ---------------------------------------------------------------- tables that change


def test_a_change_rewrites_the_buckets_of_its_keys_alone(spark, tmp_path):
    at = str(tmp_path / "docs")
    docs = derived.documents(spark, SF).drop("text")
    stored.create(docs, at, "id", buckets=16)
    before = stored._version(spark, at, 1)["folders"]
    patch = spark.createDataFrame([(4, "new"), (8, " "), (10**9, "no such row")], "id long, category string")
    touched = stored.update_documents(spark, at, patch)
    after = stored._version(spark, at, 2)["folders"]
    assert 1 <= len(touched) <= 2 and {int(b) for b in after if after[b] != before[b]} == set(touched)
    rows = {r["id"]: r["category"] for r in stored.read(spark, at).select("id", "category").collect()}
    old = {r["id"]: r["category"] for r in stored.read(spark, at, 1).select("id", "category").collect()}
    assert len(rows) == len(old) == docs.count() and {i for i in rows if rows[i] != old[i]} == {i for i in (4, 8) if old[i] != {4: "new", 8: None}[i]}
    assert rows[4] == "new" and rows[8] is None
    assert stored.update_documents(spark, at, patch.where("id > 1000000")) == [] and stored.versions(spark, at) == [1, 2]
    gone = stored.vacuum(spark, at)
    assert gone == len(touched) and stored.versions(spark, at) == [2] and stored.read(spark, at).count() == len(rows)


def test_a_killed_change_leaves_the_version_before(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "config")
    config = spark.createDataFrame([(f"k{i}", str(i)) for i in range(50)] + [(None, "null")], "key string, value string")
    stored.create(config, at, "key", buckets=4)
    want = sorted(map(tuple, stored.read(spark, at).collect()), key=str)
    with monkeypatch.context() as m:
        m.setattr(stored, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            stored.upsert_config(spark, at, config.withColumn("value", F.lit("lost")))
    assert sorted(map(tuple, stored.read(spark, at).collect()), key=str) == want and stored.versions(spark, at) == [1]
    stored.upsert_config(spark, at, spark.createDataFrame([("k1", "one"), ("new", "x")], "key string, value string"))
    got = {r["key"]: r["value"] for r in stored.read(spark, at).collect()}
    assert got["k1"] == "one" and got["new"] == "x" and got["k2"] == "2" and got[None] == "null" and len(got) == 52
    with pytest.raises(RuntimeError):  # a change that began from version 1
        stored._commit(spark, at, 2, {})
    with pytest.raises(RuntimeError):
        stored.create(config, at, "key")
    assert len(stored.versions(spark, at)) == 2


def test_stored_deletes_cascade(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(20)], "id long, file_name string")
    chunks = spark.createDataFrame([(100 + i, i, None) for i in range(20)] + [(200, 3, 103), (201, 5, 103), (202, 5, 105)], "id long, document_id long, parent_chunk_id long")
    d, c = str(tmp_path / "d"), str(tmp_path / "c")
    stored.create(docs, d, "id", 8)
    stored.create(chunks, c, "document_id", 8)
    for _ in range(2):  # again changes nothing
        stored.delete_documents(spark, d, c, spark.createDataFrame([(3,), (4,), (99,)], "id long"))
        assert {r["id"] for r in stored.read(spark, d).collect()} == set(range(20)) - {3, 4}
        assert {r["id"] for r in stored.read(spark, c).collect()} == {100 + i for i in range(20) if i not in (3, 4)} | {202}


# ---------------------------------------------------------------- E1, P3


def test_vectors_are_stored_by_text_and_resumed(spark, tmp_path):
    log, at = tmp_path / "sent", str(tmp_path / "vectors")
    log.mkdir()

    def counting(fail=""):
        def make():
            import uuid

            model = embedding.hashing_model(8)

            def run(texts):
                if fail and any(fail in t for t in texts):
                    raise RuntimeError("the model is gone")
                (log / uuid.uuid4().hex).write_text("\x00".join(texts))
                return model(texts)

            return run

        return make

    sent = lambda: [t for f in log.iterdir() for t in f.read_text().split("\x00")]
    texts = [f"text {i % 30}" for i in range(90)] + [None, "", "  ", "é中"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text_content string")
    with pytest.raises(Exception, match="the model is gone"):
        embedding.embed_stored(df, counting("text 17"), at, parts=6)
    first = len(sent())
    got = embedding.embed_stored(df, counting(), at, parts=6)
    want = {r["id"]: r["embedding"] for r in embedding.embed(df, lambda: embedding.hashing_model(8)).collect()}
    assert {r["id"]: r["embedding"] for r in got.collect()} == want
    assert 0 < first < 33 and len(sent()) <= 33 + 6  # parts that were stored whole aren't sent again
    now = len(sent())
    embedding.embed_stored(df, counting(), at, parts=6).collect()
    assert len(sent()) == now


def test_only_pages_routed_to_vision_are_seen(spark, tmp_path):
    log, at = tmp_path / "seen", str(tmp_path / "results")
    log.mkdir()

    def make(broken=()):
        def engine():
            import uuid

            def look(image):
                (log / uuid.uuid4().hex).write_bytes(image)
                if image in broken:
                    raise RuntimeError("no answer")
                return "saw " + image.decode()

            return look

        return engine

    rows = [(1, 0, "long enough " * 9, b"one"), (1, 1, "short", b"two"), (2, 0, None, b"two"), (2, 1, " ", b"bad"), (2, 2, "x", None), (3, 0, "", b"EMPTY_PAGE")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string, image binary")
    seen = layout.see_pages(pages, make({b"bad"}), at, tries=3, parts=2)
    assert {(r["doc_id"], r["page"]): r["vision_text"] for r in seen.collect()} == {(1, 0): None, (1, 1): "saw two", (2, 0): "saw two", (2, 1): None, (2, 2): None, (3, 0): "saw EMPTY_PAGE"}
    assert sorted(f.read_bytes() for f in log.iterdir()) == [b"EMPTY_PAGE", b"bad", b"bad", b"bad", b"two"]
    again = {r["doc_id"]: r["markdown"] for r in layout.route_pages(layout.see_pages(pages, make(), at, parts=2)).collect()}
    assert len(list(log.iterdir())) == 6  # the failed page alone
    assert again[2] == "<!-- PAGE:0 -->\nsaw two\n\n---\n\n<!-- PAGE:1 -->\nsaw bad" and again[3] == ""


# ---------------------------------------------------------------- T1


def test_a_replayed_batch_stores_the_same_rows(spark, tmp_path, monkeypatch):
    source, kb, progress = str(tmp_path / "src"), str(tmp_path / "kb"), str(tmp_path / "cp")
    rows = lambda part: spark.createDataFrame(part, "id long, file_name string, text string")
    held = lambda: sorted((r["id"], r["text"]) for r in spark.read.parquet(f"{kb}/documents").collect())
    rows([(5, "f", "same"), (2, "f", "same"), (3, "f", "other"), (4, "f", None)]).write.parquet(source)
    incremental_ingest(spark, source, kb, progress).awaitTermination()
    assert held() == [(2, "same"), (3, "other"), (4, None)]
    rows([(1, "f", "same"), (9, "f", "fresh"), (8, "f", "fresh"), (7, "f", None)]).write.mode("append").parquet(source)
    from docloom.streaming import ingest

    with monkeypatch.context() as m:  # documents are stored, then the batch dies
        m.setattr(ingest, "chunk_parent_child", lambda df: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            incremental_ingest(spark, source, kb, progress).awaitTermination()
    for _ in range(2):
        incremental_ingest(spark, source, kb, progress).awaitTermination()
        assert held() == [(2, "same"), (3, "other"), (4, None), (8, "fresh")]
    chunks = spark.read.parquet(f"{kb}/document_chunks")
    assert {r[0] for r in chunks.select("document_id").collect()} >= {2, 3, 8}
    # Another checkpoint, as after a loss: what kb holds isn't stored again.
    incremental_ingest(spark, source, kb, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(x for x in held() if x[1] is not None) == [(2, "same"), (3, "other"), (8, "fresh")]


# ---------------------------------------------------------------- numbering, G22


def test_rows_are_numbered_over_ranges(spark):
    from docloom.operators.numbering import numbered

    rows = [(i % 7 if i < 300 else 0, (i * 37) % 1000) for i in range(1000)] + [(None, 5), (None, 3), (2, None)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = numbered(df, ["g"], [F.col("v").desc()], "place").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        values = [v for _, v in own if v is not None]
        assert values == sorted(values, reverse=True)
    whole = sorted((r["n"], r["v"]) for r in numbered(df.where("v IS NOT NULL"), [], [F.col("v")]).collect())
    assert [n for n, _ in whole] == list(range(1, 1003)) and [v for _, v in whole] == sorted(v for _, v in whole)
    assert numbered(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_usage_of_late_and_repeated_batches(spark, tmp_path, monkeypatch):
    import datetime as dt

    from docloom.operators import catalog
    from docloom.streaming import usage

    at = lambda day, hour: dt.datetime(2024, 1, day, hour, tzinfo=dt.UTC)
    source, table, progress = (str(tmp_path / x) for x in ("in", "table", "cp"))
    rows = lambda r: spark.createDataFrame(r, usage.SCHEMA)
    first = [(at(1, 3), "a", 5), (at(1, 4), "a", 7), (at(1, 4), "b", None), (at(2, 1), None, 1)]
    rows(first).write.parquet(source)
    usage.usage_stream(spark, source, table, progress).awaitTermination()
    later = [(at(1, 23), "a", 2), (at(2, 2), "b", 4)]  # the first day's window is still open
    rows(later).write.mode("append").parquet(source)
    real = stored.upsert
    with monkeypatch.context() as m:  # the table is changed, then the batch dies
        m.setattr(stored, "upsert", lambda *a: (real(*a), (_ for _ in ()).throw(RuntimeError("killed"))))
        with pytest.raises(Exception, match="killed"):
            usage.usage_stream(spark, source, table, progress).awaitTermination()
    usage.usage_stream(spark, source, table, progress).awaitTermination()
    want = catalog.usage_rollup(rows(first + later)).collect()
    order = lambda got: sorted((str(r["day"]), str(r["source"]), r["level"], r["calls"], r["tokens"]) for r in got)
    assert order(usage.usage_totals(stored.read(spark, table)).collect()) == order(want)


def test_a_crawl_stays_on_its_own_host(spark):
    from docloom.operators import web

    html = '<a href="/b">b</a><a href="https://other.example/x">x</a><a href="//H.example/c">c</a>'
    pages = spark.createDataFrame([(1, "https://h.example/a", html), (2, "https://h.example/b", '<a href="/c">c</a>'), (3, "https://h.example/c", ""), (4, "https://other.example/x", "")], "page_id long, url string, html string")
    links = web.page_links(pages)
    roots = spark.createDataFrame([("https://h.example/a",)], "root string")
    got = {r["url"]: r["depth"] for r in web.crawl_reachable(pages.select("url"), links, roots).collect()}
    assert got == {"https://h.example/a": 0, "https://h.example/b": 1, "https://h.example/c": 2}
