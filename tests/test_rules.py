"""Hand-written cases of rules whose SQL could repeat a mistake of the code, and plain one-document readings of chunking."""

from __future__ import annotations

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from docloom import storage
from docloom.functions.text import lines, strip
from docloom.operators import answers, catalog, chunking, cleaning, layout, search, web
from docloom.operators._packing import pack_paragraphs
from docloom.plans import derived


def column(spark, values, f):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], "text string").select(f(F.col("text")).alias("x")).collect()]


def test_contents_lines(spark):
    gone = ["ab   42", "Title . . 42", "Foo.  12", "前言   3", "Title ........ 42", "x" * 60 + "   7", ". . .", "·····"]
    kept = ["ab  42", "a   42x", "Title 42", "ab   12345", "x" * 70 + "   7", "....", "a....", ""]
    got = column(spark, gone + kept, lambda c: F.size(cleaning.drop_toc_lines(F.array(c))))
    assert got == [0] * len(gone) + [1] * len(kept)


def test_composition_is_the_whole_cleaning(spark):
    c = cleaning.remove_toc_sections(lines(F.col("text")))
    for drop in (cleaning.drop_header_footer, cleaning.drop_nav_bars, cleaning.drop_garbled, cleaning.drop_toc_lines):
        c = drop(c)
    # a line is trimmed at its end before headings are looked for
    step = cleaning.squeeze_blank_lines(cleaning.normalize_headings(F.array_join(F.transform(c, lambda x: F.rtrim(x, F.lit("\t 　\x1f\xa0"))), "\n")))
    odd = ["a\r\n12\r\nb Page 3 x c", "治理 減碳\n治理\nx �� y\n- 3 -　\n**1.0 a**  \n##b\n\n\n\nc \t\n", "  Confidential x\n　　5 \nTitle　　　42\n  ...   \n ..... ", "# CONTENTS\nx\n#c\n# d\n#e", "no end 12\n\n34"]
    df = spark.createDataFrame([(t,) for t in odd], "text string").unionByName(derived.decorated(spark, SF).select("text"))
    rows = df.select(step.alias("a"), cleaning.clean_markdown_column(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows), next((r for r in rows if r["a"] != r["b"]))


def plain_chunks(text, overlap=100, most=2000, least=50, child=400):
    """A plain reading of sections, merging, splitting, overlap and children."""
    found = list(re.finditer(r"^(#{1,6})\s+(.+)$", text, re.M))
    parts = [("", text)] if not found else ([("(前言)", text[: found[0].start()])] if text[: found[0].start()].strip() else []) + [(m[2].strip(), text[m.start() : n]) for m, n in zip(found, [*(x.start() for x in found[1:]), len(text)], strict=True)]
    merged = []
    for title, t in parts:
        if merged and len(t.strip()) < least:
            merged[-1][1] += "\n\n" + t.strip()
        else:
            merged.append([title, t.strip()])
    sections = []
    for title, t in merged:
        cut = pack_paragraphs(t, most) if len(t) > most else [t]
        sections += [(title, t)] if len(cut) <= 1 else [(f"{title} ({i + 1}/{len(cut)})" if title else "", x) for i, x in enumerate(cut)]
    marker, parents, rows = r"<!-- PAGE:(\d+) -->", [], []
    for i, (title, t) in enumerate(sections):
        t = (sections[i - 1][1][-overlap:] + "\n" + t if i else t).strip()
        pages = [int(x) for x in re.findall(marker, t)]
        parents.append((title, t, min(pages, default=None), max(pages, default=None)))
    at = len(parents)
    for i, (title, t, a, b) in enumerate(parents):
        kids = [k for k in (pack_paragraphs(t, child) if len(t) > child else [t]) if k.strip()]
        rows.append((i, re.sub(marker, "", t).strip(), title, a, b, "parent" if len(kids) > 1 else "standalone", None))
        for k in kids:
            pages = [int(x) for x in re.findall(marker, k)]
            if len(kids) > 1:
                rows.append((at, re.sub(marker, "", k).strip(), title, min(pages, default=0) or a, max(pages, default=0) or b, "child", i))
            at += 1
    return sorted(rows)


def test_parents_and_children_as_a_plain_reading_has_them(spark):
    texts = {r["doc_id"]: r["text"] for r in cleaning.clean_markdown(derived.decorated(spark, SF)).collect()} | {9001: "", 9002: "# A\n" + "\n\n".join("w" * 300 for _ in range(30)) + "\n\n<!-- PAGE:0 -->\n\n<!-- PAGE:7 -->\n\n" + "v" * 300, 9003: "intro\n# B\nx"}
    df = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    got = {}
    for r in chunking.chunk_parent_child(df).collect():
        m = r["metadata"]
        parent = None if r["parent_chunk_id"] is None else r["parent_chunk_id"] - r["document_id"] * 1_000_000
        got.setdefault(r["document_id"], []).append((r["chunk_index"], r["text_content"], m["section_title"], m["page_start"], m["page_end"], r["chunk_type"], parent))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_chunks(t) for k, t in texts.items()}
    four = {(r["document_id"], r["chunk_index"]): r["text_content"] for r in chunking.chunk(df).collect()}
    assert four == {(k, r[0]): r[1] for k, t in texts.items() for r in plain_chunks(t) if r[5] != "child"}


def test_parent_child_plan_has_one_scan_and_no_shuffle(spark):
    plan = chunking.chunk_parent_child(cleaning.clean_markdown(derived.decorated(spark, SF)).withColumnRenamed("doc_id", "document_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_links_are_parsed(spark):
    html = "<a href='/a?x=1&amp;b=2'>a</a><A HREF=/q>q</A><a name=n>n</a><a href>e</a><a href='#t'>t</a><a href=' mailto:x'>m</a><a href='tel:1'>c</a><script>'<a href=/no>'</script><a href=\"JavaScript:x\">j</a>"
    df = spark.createDataFrame([(1, "https://h/p", html), (2, "u", None)], "page_id long, url string, html string")
    assert [r["href"] for r in web.extract_links(df).orderBy("pos").collect()] == ["/a?x=1&b=2", "/q", "", " mailto:x", "JavaScript:x"]


@pytest.mark.parametrize("end", [".gz", ".tar", ".wmv", ".rss", ".atom", ".PDF"])
def test_assets_are_skipped(spark, end):
    url = f"https://h.x/a{end}"
    assert column(spark, [url, "https://h.x/a.7z", "https://h.x/a.woff", "https://o.x/a", None], lambda c: web.should_skip(c, F.lit("h.x"))) == [True, False, False, True, True]


def test_deep_pages_do_not_recurse(spark):
    html = "<body><article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<ul><li>a<ul><li>b</li></ul></li><li>c <p>d</p></li></ul><h2>T <em>e</em></h2></article></body>"
    row = web.page_content(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert row["markdown"] == "deep\n\n- a\n  - b\n- c d\n\n## T *e*" and row["content"].startswith("deep")


def test_dropped_parts_hide_their_articles(spark):
    html = "<html><body><nav><article>no</article></nav><main><p>yes</p><footer>f</footer></main></body></html>"
    assert web.html_to_markdown(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()["markdown"] == "yes"


def test_layout_lines_have_blank_lines_round_headings(spark):
    rows = [(1, 1, 0, 0, 0, "Big", 20.0, "S"), (1, 1, 0, 1, 0, " text ", 9.0, "S"), (1, 2, 0, 0, 0, " ", 9.0, "S"), (1, 3, 0, 0, 0, "x", 13.0, "S-BOLD")]
    df = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, span int, text string, size double, font string")
    assert layout.lines_to_markdown(df).first()["markdown"] == "<!-- PAGE:1 -->\n\n# Big\n\ntext\n\n<!-- PAGE:2 -->\n\n<!-- PAGE:3 -->\n\n### x\n"


def test_table_cells_are_trimmed(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, " head　"), (1, 0, 0, 1, None), (1, 0, 1, 0, "\tx ")], "doc_id long, table_no int, row int, col int, text string")
    assert layout.rows_to_markdown_table(cells).first()["markdown"] == "| head |  |\n| ---- | --- |\n| x |  |"


@pytest.mark.parametrize("word", "比較 差異 差別 不同 對比 相比 優於 落後 領先 變化 趨勢 成長 vs VS 勝過 超越".split())
def test_comparison_words(spark, word):
    q = spark.createDataFrame([(1, f"甲公司{word}去年"), (2, "甲公司比起去年"), (3, "甲公司和甲公司子")], "query_id long, question string")
    got = {r["query_id"]: (r["dimension"], r["values"]) for r in answers.detect_comparison(q, ["甲公司", "甲公司子"]).collect()}
    assert got == {1: ("company", ["甲公司"]), 2: (None, None), 3: ("company", ["甲公司子", "甲公司"])}


def test_prompt_and_comparison_contexts(spark):
    q = spark.createDataFrame([(1, 1, "問"), (2, 1, "空")], "query_id long, conv_id long, question string")
    ctx = spark.createDataFrame([(1, "文")], "query_id long, context string")
    past = spark.createDataFrame([(1, 0, "model", "p")], "conv_id long, turn long, role string, text string")
    rows = {r["query_id"]: r for r in answers.build_prompt(q, ctx, past, "規則", "2026年01月01日").collect()}
    said = [(m["role"], m["text"]) for m in rows[1]["messages"]]
    assert said[:3] == [("user", "今天是 2026年01月01日。規則"), ("model", "好的，我會嚴格根據提供的參考資料回答，並標註出處。"), ("model", "p")]
    assert said[3][1].startswith("以下是從知識庫中搜尋到的參考資料：\n\n<context>\n文\n</context>\n\n使用者問題：\n<user_query>\n問\n</user_query>\n\n請根據")
    assert rows[2]["answer"].startswith("根據目前資料庫中的資料，無法找到") and rows[2]["messages"] is None
    hit = spark.createDataFrame([(1, 1, 5, "n.pdf", None, "內", ("節", 3, 4), "a / b"), (1, 2, 6, "m", "顯", "容", (None, None, None), "c")], "query_id long, rank int, id long, file_name string, display_name string, text_content string, metadata struct<section_title:string,page_start:int,page_end:int>, group_label string")
    assert answers.compare_context(hit).first()["context"] == "[來源1] 【a / b】文件：n.pdf （第3-4頁）\n章節：節\n內容：內\n\n---\n[來源2] 【c】文件：顯\n章節：無\n內容：容\n"


def test_metadata_falls_back(spark):
    docs = spark.createDataFrame([(1, "pdf", "x.pdf", None, None, "c"), (2, "url", "https://h/esg/1?q#f", None, None, None), (3, "docx", "http://h/a/b", None, None, None), (4, "docx", "y", None, "g", None)], "id long, source_type string, file_name string, display_name string, report_group string, category string")
    got = {r["id"]: (r["display_name"], r["report_group"]) for r in catalog.backfill_pdf_metadata(docs, [("%z%", "Z")], [("%z%", "Z")]).collect()}
    assert got[1] == ("x.pdf", "c") and got[2] == (None, None)
    got = {r["id"]: (r["display_name"], r["report_group"]) for r in catalog.backfill_url_metadata(docs, [("%/esg/%", "E")], "官網").collect()}
    assert got == {1: ("x.pdf", None), 2: ("esg/1", "E"), 3: ("a/b", None), 4: ("y", "g")}


def test_category_by_source_type(spark):
    rows = [("pdf", "a-Annual.pdf"), ("pdf", "esg.pdf"), ("docx", "annual.docx"), ("url", "https://x/ESG/a"), ("url", "newsletter"), ("url", "電子報"), (None, "x")]
    df = spark.createDataFrame(rows, "source_type string, file_name string")
    assert [r["guessed_category"] for r in catalog.guess_category(df).collect()] == ["年度報告", "其他", "官網", "ESG專區", "新聞", "電子報", "官網"]


def test_each_query_has_its_own_filters(spark):
    chunks = spark.createDataFrame([(i, i, 0, f"word{i % 2} all", [1.0, i / 10], "standalone", None) for i in range(6)], "id long, document_id long, chunk_index int, text_content string, embedding array<float>, chunk_type string, parent_chunk_id long").withColumn("metadata", F.lit(None).cast("struct<section_title:string,page_start:int,page_end:int>"))
    docs = spark.createDataFrame([(i, f"f{i}", "en " if i < 3 else None, str(2020 + i), "draft") for i in range(6)], "id long, file_name string, language string, fiscal_year string, status string")
    q = spark.createDataFrame([(1, "all", [1.0, 0.0], "en", None), (2, "all", [1.0, 0.0], None, ["2021", "2025"]), (3, "all", [1.0, 0.0], None, []), (4, "all", [1.0, 0.0], "fr", None)], "query_id long, query_text string, query_embedding array<float>, filter_language string, filter_fiscal_years array<string>")
    for rows in (search.vector_search(chunks, docs, q, 9, 0.1).collect(), search.hybrid_search(chunks, docs, q, 9).collect()):
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], set()).add(r["id"])
        assert got == {1: {0, 1, 2}, 2: {1, 5}, 3: {0, 1, 2, 3, 4, 5}} and {r["status"] for r in rows} == {"draft"}


def test_missing_parents_leave_the_own_text(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "own", [1.0], "child", 77)], "id long, document_id long, chunk_index int, text_content string, embedding array<float>, chunk_type string, parent_chunk_id long").withColumn("metadata", F.lit(None).cast("struct<section_title:string,page_start:int,page_end:int>"))
    docs, q = spark.createDataFrame([(1, "f")], "id long, file_name string"), spark.createDataFrame([(1, [1.0])], "query_id long, query_embedding array<float>")
    assert search.vector_search(chunks, docs, q).first()["text_content"] == "own"


def test_scratch_tables_can_be_dropped(spark):
    storage.drop_scratch(spark)
    df = storage.written(spark.range(3), "x")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.drop_scratch(spark) == 1 and storage.drop_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_strip_takes_every_white_space(spark):
    assert column(spark, ["　\x1f a \n", None, "﻿x"], strip) == ["a", None, "﻿x"]
