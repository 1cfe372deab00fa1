"""Text and fused search over small tables, against their SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from test_oracle import plain

from docloom.operators import search, vectors
from docloom.plans.queries import ORACLE_SQL, QUERIES

#: Passages with words that web syntax reads as operators, and one with repeated words.
ITEMS = ["alpha or beta gamma", "delta -epsilon zeta", 'eta "theta iota" kappa', "OR lambda", "mu nu mu -nu or mu", "alpha beta", "x y", None, "", "- ?"]


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """benchmark, documents that hold the items' words in any order and with gaps, embeddings: as a folder and a DuckDB connection."""
    r, folder, con = random.Random(5), tmp_path_factory.mktemp("small"), duckdb.connect()
    texts = []
    for i in range(240):
        words = (ITEMS[i % 7] or "").replace('"', "").replace("-", "").lower().split()
        words = words * r.randrange(1, 4) + r.choices(["or", "fill", "pad", "beta", "nu", "lambda"], k=r.randrange(0, 6))
        r.shuffle(words)
        texts.append(" ".join(w for w in words if r.random() < 0.97))
    vectors = [[r.gauss(0, 1) for _ in range(6)] for _ in range(240)]
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(ITEMS)))
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, r.choice(["en", "de"])) for i, t in enumerate(texts)])
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", list(enumerate(vectors)))
    for t in ("benchmark", "documents", "embeddings"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), con


@pytest.mark.parametrize("name", ["R7_fts_topk", "R9_hybrid_search", "R10_hybrid_search_labeled"])
def test_items_are_plain_texts(spark, small, name):
    folder, con = small
    got, result = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in result.description)
    want = [dict(zip((c[0] for c in result.description), row, strict=True)) for row in result.fetchall()]
    assert want
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[c]) for c in columns) for r in want)


def test_queries_of_one_text_are_matched_once(spark, tmp_path, monkeypatch):
    """Each chunk is ranked once for a text, however many queries ask for it and whatever filters they have."""
    log, real = tmp_path / "ranked", search.density_of
    log.mkdir()

    def counting(q, words):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return real(q, words)

    monkeypatch.setattr(search, "density_of", counting)
    chunks = spark.createDataFrame([(i, 10 + i % 2, "a b" if i % 3 else "a x b", "child" if i < 9 else "parent") for i in range(10)], "id long, document_id long, text_content string, chunk_type string")
    docs = spark.createDataFrame([(10, "en"), (11, None)], "id long, language string")
    asked = [(q, "b a" if q < 40 else None, [None, "en", "de"][q % 3]) for q in range(41)]
    queries = spark.createDataFrame(asked, "query_id long, query_text string, filter_language string")
    got = sorted((r["query_id"], r["id"], r["fts_rank"]) for r in search.fts_topk(chunks, docs, queries, 4).collect())
    best = {None: [1, 2, 4, 5], "en": [2, 4, 8, 0], "de": []}
    assert got == sorted((q, i, n + 1) for q, text, language in asked if text for n, i in enumerate(best[language]))
    assert len(list(log.iterdir())) == 9


def test_best_rows_do_not_grow_with_tasks(spark, tmp_path, monkeypatch):
    """What tasks keep of a query grows with the columns of the grid, not with the partitions of the chunks."""
    log, real = tmp_path / "kept", vectors.Best
    log.mkdir()

    def counting(*sizes):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return real(*sizes)

    monkeypatch.setattr(vectors, "Best", counting)
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 0, raising=False)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(40)
    queries = spark.createDataFrame([(i + 1000, v) for i, v in rows[:50]], "query_id long, query_embedding array<double>").coalesce(1)
    got = sorted((x["query_id"], x["vec_rank"], x["id"]) for x in vectors.nearest(chunks, queries, 5).collect())
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows}
    near = lambda a: sorted(unit, key=lambda b: (-round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 12), b))[:5]
    assert got == [(i + 1000, n + 1, b) for i in range(50) for n, b in enumerate(near(i))]
    assert len(list(log.iterdir())) == 1


def test_the_grid_weighs_best_rows_against_copies_of_chunks(monkeypatch):
    size = lambda rows, width: {"rows": rows, "bytes": rows * width * 8, "n": -(-rows // 1024)}
    for queries, chunks, n in ((31_000, 461_000, 100), (31_000, 461_000, 10), (300_000, 4_600_000, 100), (3, 10, 5)):
        q, c = size(queries, 64), size(chunks, 64)
        rows, columns = vectors._grid(q, c, n, 64)
        cells = queries * chunks / vectors.CELL_PAIRS
        assert rows * columns >= cells and queries * n / rows <= vectors.HELD_ROWS
        moved = lambda r, k: r * c["bytes"] / 2 + k * (q["bytes"] + queries * n * vectors.ROW_BYTES)
        assert moved(rows, columns) <= 1.5 * min(moved(-(-cells // k), k) for k in range(1, int(cells) + 2))
