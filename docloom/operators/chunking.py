"""K1-K6: sections, parent and child chunks. A document's sections stay an array in its row until chunks are
exploded, so chunking shuffles nothing; the two greedy packings run in one Arrow helper each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import CHUNKS_PER_DOCUMENT
from ._packing import pack_paragraphs

PREAMBLE = "(前言)"
MARKER = r"<!-- PAGE:\d+ -->"
SECTION = "struct<title:string,level:int,text:string>"


def sections_column(c: Column) -> Column:
    """K1: array of (title, level, text). Text before the first heading is a section of its own if not blank;
    without headings the whole text is one untitled section."""
    heading = r"(?dU)^(#{1,6})\s+([^\n]+)"

    def one(part: Column, at: Column) -> Column:
        level = F.length(F.regexp_extract(part, heading, 1))
        has = level > 0
        title = F.when(has, strip(F.regexp_extract(part, heading, 2))).when(at == 0, F.lit(PREAMBLE))
        return F.struct(title.alias("title"), F.when(has, level).cast("int").alias("level"), strip(part).alias("text"))

    def of(parts: Column) -> Column:
        titled = F.filter(parts, lambda s: s["level"].isNotNull() | (s["text"] != ""))
        whole = F.array(F.struct(F.lit("").alias("title"), F.lit(None).cast("int").alias("level"), strip(c).alias("text")))
        return F.when(F.exists(parts, lambda s: s["level"].isNotNull()), titled).otherwise(whole)

    # the array of one holds the parts while they are looked at twice
    parts = F.transform(F.split(c, r"(?mdU)(?=^#{1,6}\s+[^\n]+$)", -1), one)
    return F.transform(F.array(parts), of)[0].cast(f"array<{SECTION}>")


def merged_column(sections: Column, min_chars: int = 50) -> Column:
    """K2: a section shorter than min_chars, other than the first, joins the one before it."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.length(s[i]["text"]) >= min_chars))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: joined(s, i, F.coalesce(F.try_element_at(at, k + 2), F.size(s)))))[0]

    def joined(s: Column, i: Column, end: Column) -> Column:
        text = F.array_join(F.transform(F.slice(s, i + 1, end - i), lambda x: x["text"]), "\n\n")
        return F.struct(s[i]["title"].alias("title"), s[i]["level"].alias("level"), text.alias("text"))

    return F.transform(F.array(sections), of)[0].cast(f"array<{SECTION}>")


def split_by_heading(df: DataFrame, col: str = "text") -> DataFrame:
    """K1 as rows: pos, title, level, text."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode_outer(sections_column(F.col(col))).alias("pos", "s")).select(*rest, "pos", "s.title", "s.level", F.col("s.text").alias("section_text"))


def merge_short_sections(df: DataFrame, col: str = "text", min_chars: int = 50) -> DataFrame:
    """K1 and K2 as rows."""
    rest = [c for c in df.columns if c != col]
    merged = merged_column(sections_column(F.col(col)), min_chars)
    return df.select(*rest, F.posexplode_outer(merged).alias("pos", "s")).select(*rest, "pos", "s.title", "s.level", F.col("s.text").alias("section_text"))


def _packer(budget: int):
    @F.pandas_udf("array<array<string>>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: [pack_paragraphs(t, budget) if len(t) > budget else [t] for t in row])

    return pack


def _family_packer(max_chars: int, overlap: int, child_max: int):
    """Of a document's sections: the parents' texts (K3's pieces, each after the end of the one before it), each with its
    section, its place among the section's pieces, its non-blank child pieces, and the number of those before them."""

    def of(sections: list[str]) -> list[dict]:
        pieces = []
        for n, s in enumerate(sections):
            cut = pack_paragraphs(s, max_chars) if len(s) > max_chars else [s]
            cut = cut if len(cut) > 1 else [s]
            pieces += [(n, i + 1, len(cut), t) for i, t in enumerate(cut)]
        out, at, before = [], 0, None
        for n, i, many, t in pieces:
            text = (before[-overlap:] + "\n" + t if before is not None and overlap > 0 else t).strip()
            before = t
            kids = [k for k in (pack_paragraphs(text, child_max) if len(text) > child_max else [text]) if k.strip()]
            out.append({"section": n, "piece": i, "pieces": many, "text": text, "begin": at, "kids": kids})
            at += len(kids)
        return out

    @F.pandas_udf("array<struct<section:int,piece:int,pieces:int,text:string,begin:int,kids:array<string>>>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return pack


def split_long_column(sections: Column, max_chars: int = 2000) -> Column:
    """K3: sections longer than max_chars become pieces of whole paragraphs titled 'title (i/n)'."""
    pieces = _packer(max_chars)(F.transform(sections, lambda s: s["text"]))

    def titled(s: Column, got: Column) -> Column:
        one = F.size(got) <= 1
        name = lambda i: F.when(one | (s["title"] == ""), s["title"]).otherwise(F.format_string("%s (%d/%d)", s["title"], i + 1, F.size(got)))
        texts = F.when(one, F.array(s["text"])).otherwise(got)
        return F.transform(texts, lambda t, i: F.struct(name(i).alias("title"), s["level"].alias("level"), t.alias("text")))

    return F.flatten(F.zip_with(sections, pieces, titled))


def _pages(c: Column) -> tuple[Column, Column]:
    found = F.transform(F.regexp_extract_all(c, F.lit(r"<!-- PAGE:(\d+) -->"), F.lit(1)), lambda x: x.cast("int"))
    some = c.contains("<!-- PAGE:")
    return F.when(some, F.array_min(found)), F.when(some, F.array_max(found))


def _unmarked(c: Column) -> Column:
    return strip(F.when(c.contains("<!-- PAGE:"), F.regexp_replace(c, MARKER, "")).otherwise(c))


def _led(sections: Column, overlap: int) -> Column:
    """Array of (title, level, text, page_start, page_end): each section after the end of the one before it."""

    def one(c: Column, i: Column) -> Column:
        tail = F.when(F.lit(overlap > 0) & (i > 0), F.concat(F.right(sections[i - 1]["text"], F.lit(overlap)), F.lit("\n"))).otherwise(F.lit(""))
        return F.struct(c["title"].alias("title"), c["level"].alias("level"), F.concat(tail, c["text"]).alias("text"))

    def paged(c: Column) -> Column:
        low, high = _pages(c["text"])
        return F.struct(c["title"].alias("title"), c["level"].alias("level"), c["text"].alias("text"), low.alias("page_start"), high.alias("page_end"))

    return F.transform(F.transform(sections, one), paged)


def _cut(df: DataFrame, key: str, col: str, max_chars: int, min_chars: int) -> DataFrame:
    """key, s: a document's sections after K1 to K3."""
    base = df.select(F.col(key), merged_column(sections_column(F.coalesce(F.col(col), F.lit(""))), min_chars).alias("m"))
    return base.select(key, split_long_column(F.col("m"), max_chars).alias("s"))


def _meta(c: Column, low: Column, high: Column) -> Column:
    return F.struct(c["title"].alias("section_title"), c["level"].alias("heading_level"), low.alias("page_start"), high.alias("page_end"))


def chunk(df: DataFrame, key: str = "document_id", col: str = "text", overlap: int = 100, max_chars: int = 2000, min_chars: int = 50, strip_markers: bool = True, drop_empty: bool = False) -> DataFrame:
    """K4: key, chunk_index, text_content, metadata. A chunk begins with the last `overlap` characters of the section
    before it; its pages are those whose markers its text holds. Empty text gives one empty chunk."""
    rows = _cut(df, key, col, max_chars, min_chars).select(key, F.posexplode_outer(_led(F.col("s"), overlap)).alias("chunk_index", "c"))
    text = _unmarked(F.col("c.text")) if strip_markers else strip(F.col("c.text"))
    out = rows.select(key, "chunk_index", text.alias("text_content"), _meta(F.col("c"), F.col("c.page_start"), F.col("c.page_end")).alias("metadata"))
    return out.where("text_content <> ''") if drop_empty else out


_CHUNK = "array<struct<chunk_index:int,text_content:string,metadata:struct<section_title:string,heading_level:int,page_start:int,page_end:int>,chunk_type:string,parent_index:int>>"


def chunk_parent_child(df: DataFrame, key: str = "document_id", col: str = "text", child_max: int = 400, overlap: int = 100, max_chars: int = 2000, min_chars: int = 50, drop_empty: bool = False) -> DataFrame:
    """K5: rows of parents and children with id, chunk_index, chunk_type and parent_chunk_id.

    A parent packed into one child has none; that child's index stays unused. A child's missing page (0
    counts as missing) is its parent's. drop_empty leaves blank parents out. A document stays one row,
    its chunks an array, until they are exploded once: nothing is shuffled and Python sees a document once.
    """
    base = df.select(F.col(key), merged_column(sections_column(F.coalesce(F.col(col), F.lit(""))), min_chars).alias("m"))
    packed = base.withColumn("parents", _family_packer(max_chars, overlap, child_max)(F.transform("m", lambda s: s["text"])))
    if drop_empty:
        packed = packed.withColumn("parents", F.filter("parents", lambda p: p["text"] != ""))

    def family(p: Column, i: Column) -> Column:
        return _let(F.struct(p.alias("p"), F.array(*_pages(p["text"])).alias("pages"), F.element_at(F.col("m"), p["section"] + 1).alias("s")), lambda x: rows_of(x, i))[0]

    def rows_of(x: Column, i: Column) -> Column:
        p, s, kids = x["p"], x["s"], x["p"]["kids"]
        has = F.size(kids) > 1
        title = F.when((p["pieces"] <= 1) | (s["title"] == ""), s["title"]).otherwise(F.format_string("%s (%d/%d)", s["title"], p["piece"], p["pieces"]))
        meta = lambda low, high: F.struct(title.alias("section_title"), s["level"].alias("heading_level"), low.alias("page_start"), high.alias("page_end"))
        first, last = x["pages"][0], x["pages"][1]
        top = F.struct(i.alias("chunk_index"), _unmarked(p["text"]).alias("text_content"), meta(first, last).alias("metadata"), F.when(has, "parent").otherwise("standalone").alias("chunk_type"), F.lit(None).cast("int").alias("parent_index"))

        def child(t: Column, k: Column) -> Column:
            low, high = _pages(t)
            own = meta(F.coalesce(F.nullif(low, F.lit(0)), first), F.coalesce(F.nullif(high, F.lit(0)), last))
            at = F.size("parents") + p["begin"] + k
            return F.struct(at.alias("chunk_index"), _unmarked(t).alias("text_content"), own.alias("metadata"), F.lit("child").alias("chunk_type"), i.alias("parent_index"))

        return F.concat(F.array(top).cast(_CHUNK), F.when(has, F.transform(kids, child)).otherwise(F.array()).cast(_CHUNK))

    made = packed.select(key, F.flatten(F.transform("parents", family)).alias("made"))
    rows = made.select(key, F.explode_outer("made").alias("c")).select(key, "c.*")
    base = F.col(key) * CHUNKS_PER_DOCUMENT
    return rows.select((base + F.col("chunk_index")).alias("id"), key, "chunk_index", "text_content", "metadata", "chunk_type", (base + F.col("parent_index")).alias("parent_chunk_id"))


def _let(value: Column, use) -> Column:
    """An array of one: use(value) with value worked out once."""
    return F.transform(F.array(value), use)


def embed_targets(chunks: DataFrame) -> DataFrame:
    """K6: the chunks that get a vector."""
    return chunks.where(F.col("chunk_type").isin("child", "standalone"))
