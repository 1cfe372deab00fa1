"""Markdown from decoded layout tables, page routing, pages and offsets."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .cleaning import clean_markdown_column
from .plugins import PARTS, worked_out

PAGE = r"<!-- PAGE:(\d+) -->"


def _joined(struct: Column, field: str, by: str) -> Column:
    """The field of collected structs, in their order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(struct)), lambda x: x[field]), by)


def lines_to_markdown(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """P1 on spans(doc_id, page, block, line, span, text, size, font): doc_id, markdown.

    A line's heading level is by its largest size: 20 and more 1, 16 and more 2, 13 and more if bold 3; lines over
    200 characters are none. A heading has a blank line before and after it. Each page's marker comes before its lines; a page
    whose lines are all blank is its marker. tables(doc_id, page, table_no, markdown), as P2 makes them, follow their page's
    lines. Aggregations with sorted structs, by line, page and document.
    """
    line = spans.groupBy("doc_id", "page", "block", "line").agg(
        strip(_joined(F.struct("span", F.coalesce("text", F.lit("")).alias("t")), "t", "")).alias("t"), F.max("size").alias("size"),
        F.coalesce(F.bool_or(F.lower("font").contains("bold")), F.lit(False)).alias("bold"),
    )
    short = F.length("t") <= 200
    level = F.when(short & (F.col("size") >= 20), 1).when(short & (F.col("size") >= 16), 2).when(short & (F.col("size") >= 13) & F.col("bold"), 3)
    shown = F.when(level.isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), F.col("t"), F.lit("\n"))).otherwise(F.col("t"))
    full = F.when(F.col("t") != "", F.struct("block", "line", shown.alias("t")))
    page = line.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(full)), lambda x: x["t"]).alias("lines"))
    marker = F.concat(F.lit("<!-- PAGE:"), F.col("page").cast("string"), F.lit(" -->"))
    text = F.array_join(F.concat(F.array(marker), "lines"), "\n")
    if tables is not None:
        own = tables.groupBy("doc_id", "page").agg(_joined(F.struct("table_no", "markdown"), "markdown", "\n\n").alias("tables"))
        page = page.join(own, ["doc_id", "page"], "left")
        text = F.concat(text, F.when(F.col("tables") != "", F.concat(F.lit("\n\n"), "tables")).otherwise(""))
    return page.select("doc_id", "page", text.alias("t")).groupBy("doc_id").agg(_joined(F.struct("page", "t"), "t", "\n\n").alias("markdown"))


def rows_to_markdown_table(cells: DataFrame) -> DataFrame:
    """P2 on cells(doc_id, table_no, row, col, text): doc_id, table_no, markdown. The first row heads the table, cells are
    trimmed, null ones are empty, short rows are filled up to the head's width."""
    value = strip(F.coalesce("text", F.lit("")))
    rows = cells.groupBy("doc_id", "table_no", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", value.alias("t")))), lambda x: x["t"]).alias("r"))
    tables = rows.groupBy("doc_id", "table_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("rows"))
    width = F.size(F.col("rows")[0])
    bar = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    fill = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
    rule = F.transform(F.col("rows")[0], lambda c: F.repeat(F.lit("-"), F.greatest(F.length(c), F.lit(3))))
    body = F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: bar(fill(r)))
    return tables.select("doc_id", "table_no", F.array_join(F.concat(F.array(bar(F.col("rows")[0]), bar(rule)), body), "\n").alias("markdown"))


def _rich(mode: str, threshold: int) -> Column:
    """Whether a page's own text is taken."""
    return (F.length(strip(F.coalesce("text", F.lit("")))) >= threshold) & F.lit(mode != "vision")


def route_pages(pages: DataFrame, mode: str = "hybrid", threshold: int = 100) -> DataFrame:
    """P3 on pages(doc_id, page, text, vision_text): doc_id, markdown, text_pages, vision_pages, skipped_pages.

    A page whose trimmed text has `threshold` characters or more is taken as it is ('hybrid' mode); others take the vision
    engine's text (a column that the caller's plug-in filled); pages with EMPTY_PAGE or nothing are skipped.
    """
    routed = pages.withColumn("rich", _rich(mode, threshold)).withColumn("t", F.when(F.col("rich"), strip(F.col("text"))).otherwise(strip(F.coalesce("vision_text", F.lit("")))))
    skip = ~F.col("rich") & (F.col("t").contains("EMPTY_PAGE") | (F.col("t") == ""))
    marked = routed.withColumn("skip", skip)
    part = F.when(~F.col("skip"), F.struct("page", F.concat(F.lit("<!-- PAGE:"), F.col("page").cast("string"), F.lit(" -->\n"), "t").alias("t")))
    return marked.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n---\n\n").alias("markdown"),
        F.count_if("rich").alias("text_pages"), F.count_if(~F.col("rich") & ~F.col("skip")).alias("vision_pages"), F.count_if("skip").alias("skipped_pages"),
    )


#: Heading levels by paragraph style.
STYLES = {"Title": 1, "Subtitle": 2} | {f"Heading {i}": i for i in range(1, 7)}


def see_pages(pages: DataFrame, make_vision: Callable[[], Callable[[bytes], str]], path: str, mode: str = "hybrid", threshold: int = 100, tries: int = 5, pause: float = 0.0, parts: int = PARTS) -> DataFrame:
    """pages(doc_id, page, text, image) with vision_text, as route_pages() takes it, for the pages routed to vision alone.

    make_vision runs once for each task and returns the plug-in, from an image to Markdown. Results are stored under `path` by the
    image's hash: an image seen before, in whatever document, isn't sent again, and a killed run goes on where it stopped. A
    page that fails `tries` times has no text in this run (route_pages skips it) and is tried again by the next; after the
    k-th failure a call waits k times `pause` seconds. A page without an image has no text."""
    keyed = pages.drop("vision_text").withColumn("_key", F.when(~_rich(mode, threshold), F.sha2("image", 256)))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vision = make_vision()
        for part in parts:
            seen = [(k, t) for k, image in zip(part["_key"], part["image"], strict=True) if (t := _tried(vision, image, tries, pause)) is not None]
            yield pd.DataFrame(seen, columns=["_key", "vision_text"], dtype=object)

    schema = "_key string, vision_text string"
    results = worked_out(keyed.where("_key IS NOT NULL").select("_key", "image"), "_key", lambda p: p.select("_key", "image").mapInPandas(look, schema), path, schema, parts)
    return keyed.join(results, "_key", "left").drop("_key")


def _tried(vision: Callable[[bytes], str], image: bytes, tries: int, pause: float) -> str | None:
    for k in range(tries):
        try:
            return vision(bytes(image))
        except Exception:  # whatever a remote model raises
            time.sleep(pause * (k + 1))
    return None


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """P4 on blocks(doc_id, pos, kind, style, runs, table_markdown): doc_id, markdown. kind 'tbl' takes table_markdown."""
    level = F.create_map(*(F.lit(x) for pair in STYLES.items() for x in pair))[F.col("style")]
    mark = lambda r: F.when(r["bold"] & r["italic"], "***").when(r["bold"], "**").when(r["italic"], "*").otherwise("")
    plain = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    styled = F.array_join(F.transform("runs", lambda r: F.when(strip(r["text"]) == "", r["text"]).otherwise(F.concat(mark(r), r["text"], mark(r)))), "")
    text = F.when(F.col("kind") == "tbl", F.col("table_markdown")).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), strip(plain))).otherwise(strip(styled))
    kept = blocks.select("doc_id", "pos", text.alias("t"), strip(plain).alias("p"), "kind").where("t <> '' AND (kind = 'tbl' OR p <> '')")
    return kept.groupBy("doc_id").agg(_joined(F.struct("pos", "t"), "t", "\n\n").alias("markdown"))


def split_pages(df: DataFrame, col: str = "text") -> DataFrame:
    """P5: one row per page part: pos, page_no (null before the first marker), page_text; blank parts dropped."""
    parts = F.posexplode(F.split(F.col(col), r"(?=<!-- PAGE:\d+ -->)")).alias("pos", "page_text")
    kept = df.select(*(c for c in df.columns if c != col), parts).where(strip(F.col("page_text")) != "")
    return kept.withColumn("page_no", F.nullif(F.regexp_extract("page_text", PAGE, 1), F.lit("")).cast("int"))


def clean_by_page_batch(df: DataFrame, key: str = "doc_id", col: str = "text", n: int = 20) -> DataFrame:
    """Key, text: pages cleaned n at a time (a contents section ends with its batch), joined by line ends. A
    document is worked on as an array inside its row, without a shuffle."""
    pages = F.filter(F.split(F.col(col), r"(?=<!-- PAGE:\d+ -->)"), lambda p: strip(p) != "")
    batches = F.transform(F.sequence(F.lit(0), F.greatest((F.size("pages") - 1), F.lit(0)), F.lit(n)), lambda i: F.array_join(F.slice(F.col("pages"), i + 1, F.lit(n)), ""))
    return df.withColumn("pages", pages).select(key, F.array_join(F.transform(batches, clean_markdown_column), "\n").alias(col))


def apply_page_offset(chunks: DataFrame, offset: Column) -> DataFrame:
    """page_start and page_end of metadata moved by a positive offset."""
    moved = chunks["metadata"]
    for c in ("page_start", "page_end"):
        moved = moved.withField(c, F.when(offset > 0, chunks[f"metadata.{c}"] + offset).otherwise(chunks[f"metadata.{c}"]).cast("int"))
    return chunks.withColumn("metadata", moved)
