"""Citations, contexts, history, prompts, comparison and usage records, for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .dictionary import replace_terms

UNKNOWN = "未知文件"
#: Words that ask for a comparison.
COMPARE_WORDS = ["比較", "差異", "差別", "不同", "對比", "相比", "優於", "落後", "領先", "變化", "趨勢", "成長", "vs", "VS", "勝過", "超越"]
#: What is said where nothing was found, and the frame of a question.
REFUSAL = "根據目前資料庫中的資料，無法找到與您問題相關的資訊。請嘗試更換關鍵字，或確認相關文件已入庫。"
TODAY = ("今天是 ", "。")
ACKNOWLEDGE = "好的，我會嚴格根據提供的參考資料回答，並標註出處。"
ASK = (
    "以下是從知識庫中搜尋到的參考資料：\n\n<context>\n",
    "\n</context>\n\n使用者問題：\n<user_query>\n",
    "\n</user_query>\n\n請根據 <context> 內的參考資料回答，並在句末引用處直接標註來源標籤，格式為 [文件名 p.頁數]（例如 [113年度年報 p.41] 或 [2024年永續報告書 p.65]）。標籤內容請直接複製 context 中每個段落開頭的方括號內容。",
)


def _rank() -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))


def citations(results: DataFrame) -> DataFrame:
    """A1: index, document_name, label ('name p.N') and page_text ('（第a-b頁）') for results(query_id, rank, id, …)."""
    name = F.coalesce(blank_to_null(F.col("display_name")), blank_to_null(F.col("file_name")), F.lit(UNKNOWN))
    stem = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    a, b = F.col("metadata.page_start"), F.col("metadata.page_end")
    has = F.coalesce(a != 0, F.lit(False))
    to = F.when(F.coalesce((b != 0) & (b != a), F.lit(False)), F.concat(F.lit("-"), b.cast("string"))).otherwise("")
    return results.withColumns(
        {
            "index": _rank(),
            "document_name": name,
            "label": F.when(has, F.concat(stem, F.lit(" p."), a.cast("string"))).otherwise(stem),
            "page_text": F.when(has, F.concat(F.lit("（第"), a.cast("string"), to, F.lit("頁）"))).otherwise(""),
        }
    )


def _contexts(cited: DataFrame, head: Column, body: str) -> DataFrame:
    section = F.coalesce("metadata.section_title", F.lit("無"))
    block = F.concat(head, F.lit("\n章節："), section, F.lit(body), F.coalesce("text_content", F.lit("")), F.lit("\n"))
    return cited.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("context"))


def build_context(results: DataFrame) -> DataFrame:
    """A2: one context per query, after top k, so a row holds k blocks."""
    head = F.concat(F.lit("["), "label", F.lit("] 文件："), "document_name", F.lit(" "), "page_text")
    return _contexts(citations(results), head, "\n內容：\n")


def recent_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """A3 on turns(conv_id, turn, role, text): the last n turns of each conversation; assistant is 'model', others 'user'."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n").withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise("user"))


def build_prompt(questions: DataFrame, contexts: DataFrame, history: DataFrame, system: str, today: str, acknowledge: str = ACKNOWLEDGE) -> DataFrame:
    """A4 on questions(query_id, conv_id, question): messages array (system text under its date, acknowledgement, history, the
    framed context and question), or the refusal where there is no context."""
    past = history.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("past"))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    both = questions.join(contexts, "query_id", "left").join(past, "conv_id", "left")
    head = F.array(say("user", F.lit(f"{TODAY[0]}{today}{TODAY[1]}{system}")), say("model", F.lit(acknowledge)))
    ask = F.array(say("user", F.concat(F.lit(ASK[0]), F.col("context"), F.lit(ASK[1]), F.col("question"), F.lit(ASK[2]))))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return both.select(
        "query_id", "conv_id", F.when(F.col("context").isNotNull(), F.concat(head, F.coalesce("past", none), ask)).alias("messages"),
        F.when(F.col("context").isNull(), F.lit(REFUSAL)).alias("answer"),
    )


def detect_comparison(questions: DataFrame, companies: DataFrame | list[str], words: list[str] = COMPARE_WORDS) -> DataFrame:
    """A5 on questions(query_id, question): dimension and values, or nulls. companies is a list of names or a table(company), all
    looked for in one pass. Longer names are looked for first and taken out, and come in that order; years are 20dd, and
    dd(d)年 from 100 to 150 counted from 1911."""
    names = companies.select(F.col("company").alias("term"), F.lit("").alias("full_name")) if isinstance(companies, DataFrame) else [(c, "") for c in companies]
    looked = replace_terms(questions.select("query_id", "question", F.col("question").alias("_rest")), names, "_rest", "_named")
    named = F.col("_named")
    western = F.regexp_extract_all("question", F.lit(r"(20\d{2})"), F.lit(1))
    local = F.transform(F.regexp_extract_all("question", F.lit(r"(?:民國?\s*)?(\d{2,3})\s*年"), F.lit(1)), lambda y: y.cast("int"))
    local = F.transform(F.filter(local, lambda y: y.between(100, 150)), lambda y: (y + 1911).cast("string"))
    years = F.array_sort(F.array_distinct(F.concat(western, local)))
    asks = F.lit(False)
    for w in words:
        asks = asks | F.col("question").contains(w)
    found = looked.select("query_id", "question", named.alias("c"), years.alias("y"), asks.alias("a"))
    company = (F.size("c") >= 2) | ((F.size("c") == 1) & (F.size("y") < 2) & F.col("a"))
    return found.select(
        "query_id",
        F.when(company, "company").when(F.size("y") >= 2, "fiscal_year").alias("dimension"),
        F.when(company, F.col("c")).when(F.size("y") >= 2, F.col("y")).alias("values"),
    )


def compare_search(per_group: DataFrame, k: int) -> DataFrame:
    """A6 on results per (query_id, group label): the top k of each group, merged by similarity and numbered anew."""
    w = W.partitionBy("query_id", "group_label").orderBy(F.desc("similarity"), "id")
    top = per_group.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "group_label", "id")))


def compare_context(results: DataFrame) -> DataFrame:
    """Context with the group of each source."""
    pages = F.when(F.col("page_text") != "", F.concat(F.lit(" "), "page_text")).otherwise("")
    head = F.concat(F.lit("[來源"), F.col("index").cast("string"), F.lit("] 【"), "group_label", F.lit("】文件："), "document_name", pages)
    return _contexts(citations(results), head, "\n內容：")


def usage_records(answers: DataFrame) -> DataFrame:
    """A8 on answers(question, answer, messages_chars, input_tokens): token estimates where none were given."""
    out = F.greatest(F.lit(1), F.floor(F.length("answer") / 2)).cast("int")
    given = F.coalesce("input_tokens", F.floor(F.col("messages_chars") / 3).cast("int"))
    return answers.withColumns({"question": F.substring("question", 1, 500), "input_tokens": given, "output_tokens": out, "total_tokens": given + out})
