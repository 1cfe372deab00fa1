"""Cleaning, chunking, packing and web helpers against hand-written cases and one-document references."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import fiscal_year_int, parse_filter_values, strip
from docloom.operators import chunking, cleaning, layout, web
from docloom.operators._cover import cover_density, parse_query
from docloom.operators._packing import pack_lines, pack_paragraphs
from docloom.plans.queries import QUERIES


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("**Foo bar**\n\nText", "### Foo bar\nText"),
        ("**1.0 盤查**\n\nT", "## 1.0 盤查\nT"),
        ("##字", "## 字"),
        ("#######x", "#######x"),
    ],
)
def test_headings(spark, text, want):
    assert one(spark, text, cleaning.normalize_headings(F.col("text"))) == want


def test_wide_space_is_stripped(spark):
    assert one(spark, "　a　", strip(F.col("text"))) == "a"


def clean_reference(text):
    """A separate, line-at-a-time reading of C1 to C5 and C7 for texts without bold lines."""
    out, level = [], 0
    for line in text.splitlines():
        m = re.match(r"(#{1,6})\s+(\S.*)", line.strip())
        if m:
            if level:
                if len(m[1]) <= level:
                    level = 0
                    out.append(line)
                continue
            if any(w in m[2] for w in cleaning.CONTENTS_WORDS):
                level = len(m[1])
                continue
        if not level:
            out.append(line)
    bad = [*cleaning.HEADER_FOOTER, r"^.{2,60}[.\s·…]{3,}\s*\d{1,4}\s*$", r"^.{2,60}\s{3,}\d{1,4}\s*$", r"^[.\s·…]{5,}$"]
    kept = [x.rstrip() for x in out if not x.strip() or not any(re.match(p, x.strip()) for p in bad)]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def test_clean_matches_reference(spark):
    texts = [
        "# A\nx\n## Contents\nlist .... 3\n### deep\nmore\n# B\nend\n\n\n\nlast  ",
        "12\n- 7 -\nPage 3 of 9\nTitle ........ 42\nTitle     42\n.......\nkept 1",
        "# 目錄\na\n## b\nc", "", "plain",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["text"] for r in cleaning.clean_markdown(df).collect()]
    assert got == [clean_reference(t) for t in texts]
    again = cleaning.clean_markdown(spark.createDataFrame([(t,) for t in got], "text string"))
    assert [r["text"] for r in again.collect()] == got


def test_long_runs_do_not_hang(spark):
    text = "a" + " " * 20000 + "b\n" + "." * 20000 + "x"
    assert one(spark, text, cleaning.clean_markdown_column(F.col("text"))) is not None


def test_null_text_stays_null(spark):
    assert one(spark, None, cleaning.clean_markdown_column(F.col("text"))) is None


def test_sections(spark):
    got = one(spark, "#\n\nfoo\n## b", chunking.sections_column(F.col("text")))
    assert [(s["title"], s["level"]) for s in got] == [("foo", 1), ("b", 2)]
    got = one(spark, "intro\n# T\nx", chunking.sections_column(F.col("text")))
    assert [(s["title"], s["level"]) for s in got] == [(chunking.PREAMBLE, None), ("T", 1)]


def test_empty_text_gives_one_empty_chunk(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "document_id long, text string")
    assert [(r["chunk_index"], r["text_content"]) for r in chunking.chunk(df).collect()] == [(0, "")] * 2
    assert chunking.chunk(df, drop_empty=True).count() == 0


def test_tables_are_atoms():
    text = "Intro\n\n|a|b|\n|---|---|\n|1|2|\n\nPara after\n\nLast"
    assert pack_paragraphs(text, 10) == ["Intro", "|a|b|\n|---|---|\n|1|2|\n\nPara after", "Last"]


def test_pieces_rejoin():
    text = "\n".join(f"# h{i}\n{'x' * (i * 7 % 50)}" for i in range(60))
    assert "\n".join(pack_lines(text, 100)) == text
    assert pack_lines("short", 100) == ["short"]


def test_parent_and_children(spark):
    text = "# A\n" + "\n\n".join(f"para {i} " + "w" * 150 for i in range(6)) + "\n# B\n" + "y" * 60 + "\n# C\n" + "\n\n".join("z" * 200 for _ in range(5))
    rows = chunking.chunk_parent_child(spark.createDataFrame([(3, text)], "document_id long, text string"), overlap=0).orderBy("chunk_index").collect()
    parents = [r for r in rows if r["chunk_type"] != "child"]
    assert [r["chunk_type"] for r in parents] == ["parent", "standalone", "parent"]
    first = [r["chunk_index"] for r in rows if r["parent_chunk_id"] == parents[0]["id"]]
    last = [r["chunk_index"] for r in rows if r["parent_chunk_id"] == parents[2]["id"]]
    assert last[0] == first[-1] + 2  # the lone child of B uses up an index


@pytest.mark.parametrize(("value", "want"), [("2022-2024", ["2022", "2023", "2024"]), ("2024-2022", None), ("a, b", ["a", "b"]), (" ", None), (None, None)])
def test_filter_values(spark, value, want):
    assert one(spark, value, parse_filter_values(F.col("text"))) == want


@pytest.mark.parametrize(("value", "want"), [("2024", 2024), ("113", 2024), ("113年度", 2024), (None, None)])
def test_fiscal_year(spark, value, want):
    assert one(spark, value, fiscal_year_int(F.col("text"))) == want


def test_terms(spark):
    df = cleaning.apply_terms(spark.createDataFrame([("TCX x aTCX 台TCX (tcx)",)], "text string"), [("TCX", "Z")])
    assert tuple(df.first()) == ("Z x aTCX 台TCX (Z)", ["TCX"])


def test_query_syntax_and_cover_density():
    at = {"a": [0, 10], "b": [1, 30], "c": [12]}
    assert cover_density(parse_query("a b"), at) == pytest.approx(1 / 2 + 1 / 10 + 1 / 21)  # spans [0, 1], [1, 10], [10, 30]
    assert cover_density(parse_query('"a b"'), at) == pytest.approx(1 / 2)
    assert cover_density(parse_query("a -c"), at) is None
    assert cover_density(parse_query("x or a"), at) is not None
    assert parse_query("-only") == []


def test_urls(spark):
    rows = [("../b/?q=1#f", "https://h.x/a/c/"), ("/", "http://h.x"), ("https://o.y/z/", "https://h.x"), ("#top", "https://h.x/p")]
    got = spark.createDataFrame(rows, "u string, b string").select(web.normalize_url(F.col("u"), F.col("b")).alias("x"))
    assert [r["x"] for r in got.collect()] == ["https://h.x/a/b?q=1", "https://h.x/", "https://o.y/z", "https://h.x/p"]


def test_crawl_caps_follow_queue_order(spark):
    pages = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    links = spark.createDataFrame([("a", 0, "c"), ("a", 1, "b"), ("c", 0, "d"), ("b", 0, "e"), ("a", 2, "gone")], "url string, pos int, link string")
    roots = spark.createDataFrame([("a",)], "root string")
    got = web.crawl_reachable(pages, links, roots, max_depth=3, max_pages=4).orderBy("position").collect()
    assert [(r["url"], r["depth"]) for r in got] == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]
    assert web.crawl_reachable(pages, links, roots, max_depth=1).count() == 3


def test_crawl_query_starts_from_many_roots_and_meets_its_budget(spark, tmp_path):
    n, got = 1201, {}
    rows = [(i, f"https://h{i % 3}.x/p{i}", f'<a href="/gone">x</a><a href="https://h0.x/p{i - i % 3}/">y</a>' if i % 2 else None) for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for r in QUERIES["W4_crawl_many_roots"](spark, str(tmp_path)).orderBy("position").collect():
        got.setdefault(r["root"], []).append((r["url"], r["depth"]))
    want, sizes = {}, [len(range(host, n, 3)) for host in range(3)]  # links within a host; those to h0 from others aren't followed

    def leads_to(page):
        host, k = page % 3, page // 3
        own = [page - host] * (page % 2 and host == 0)
        return own + sorted({3 * ((3 * k + 1) % sizes[host]) + host, 3 * ((3 * k + 2) % sizes[host]) + host})

    for root in range(0, n, 20):
        queue, seen, found = [(root, 0)], {root}, []
        for page, depth in queue:
            found.append((rows[page][1], depth))
            for to in leads_to(page) if depth < 7 else []:
                if to not in seen:
                    seen.add(to)
                    queue.append((to, depth + 1))
        want[rows[root][1]] = found[:200]
    assert got == want and max(map(len, want.values())) == 200


def test_crawl_query_finds_every_page_within_its_depth(spark, tmp_path):
    n, got = 1201, {}
    rows = [(2 * i, f"https://h{i % 3}.x/p{i}", f'<a href="/gone">x</a><a href="https://h0.x/p{i}/">y</a>' if i % 2 else None) for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for r in QUERIES["W4_crawl_reachable"](spark, str(tmp_path)).orderBy("position").collect():
        got.setdefault(int(r["root"].rsplit("/p", 1)[1]), []).append((int(r["url"].rsplit("/p", 1)[1]), r["depth"]))
    want = {}
    for root in range(0, n, 10):  # ids are twice the places, so these have ids divisible by 20
        queue, seen = [(root, 0)], {root}
        for page, depth in queue:
            for to in sorted({(3 * page + 1) % n, (3 * page + 2) % n}) if depth < 5 else []:
                if to not in seen:
                    seen.add(to)
                    queue.append((to, depth + 1))
        want[2 * root] = [(2 * page, depth) for page, depth in queue]
    assert got == want and max(map(len, want.values())) > 40


def test_page_content(spark):
    html = '<html lang="en-GB"><head><title> A &amp; B </title></head><body><nav>n</nav><article><h2>T</h2><p>x <b>y</b> <a href="/l">z</a></p><ul><li>1<li>2</ul><table><tr><th>a<th>b</tr><tr><td>1</tr></table></article></body></html>'
    df = spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id long, url string, html string")
    rows = web.page_content(df).orderBy("page_id").collect()
    assert (rows[0]["title"], rows[0]["language"]) == ("A & B", "en")
    assert rows[0]["markdown"] == "## T\n\nx **y** [z](/l)\n\n- 1\n- 2\n\n| a | b |\n| --- | --- |\n| 1 |  |"
    assert (rows[1]["markdown"], rows[1]["language"]) == ("", "zh-TW")


def test_page_batches_reset_contents(spark):
    text = "<!-- PAGE:1 -->\n# CONTENTS\na\n<!-- PAGE:2 -->\nkept"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert "kept" in layout.clean_by_page_batch(df, n=1).first()["text"]
    assert "kept" not in layout.clean_by_page_batch(df, n=20).first()["text"]
