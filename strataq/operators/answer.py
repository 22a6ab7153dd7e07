"""From ranked passages to answers: context strings, cited sources, and the generator seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import settings as S


def passage_header(i: Column, file_name: Column, title: Column, page: Column) -> Column:
    """[片段i] 《file》title，第p页; the page is left out where it is null or 0, a null title is empty."""
    paged = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("，第"), page.cast("string"), F.lit("页"))).otherwise("")
    return F.concat(F.lit("[片段"), i.cast("string"), F.lit("] 《"), F.coalesce(file_name, F.lit("")), F.lit("》"), F.coalesce(title, F.lit("")), paged)


def contexts(ranked: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(query, context, sources): passages in rank order under their headers; distinct sources, first seen first.

    ranked has the few final passages of each query, so a query's passages are one small group.
    """
    d = docs.select(F.col(id_col).alias("doc"), "file_name", "section_title", "page", "page_content")
    j = ranked.select("query", "doc", "rank").join(d, "doc")
    part = F.concat(passage_header(F.col("rank"), F.col("file_name"), F.col("section_title"), F.col("page")), F.lit("\n"), F.coalesce("page_content", F.lit("")))
    each = j.select("query", "rank", part.alias("part"), F.struct("file_name", "section_title", "page").alias("source"))
    grouped = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "part", "source"))).alias("ps"))
    return grouped.select("query", F.array_join(F.transform("ps", lambda p: p["part"]), "\n\n").alias("context"), F.array_distinct(F.transform("ps", lambda p: p["source"])).alias("sources"))


def first_sentence(question: Column, context: Column) -> Column:
    """The default generator: the first sentence of the best passage."""
    body = F.regexp_extract(context, r"(?s)^[^\n]*\n(.*?)(?:\n\n\[片段|$)", 1)
    return F.substring(F.regexp_extract(body, S.SENTENCE, 0), 1, S.DEFAULT.chunking.size)


def answer(queries: DataFrame, ranked: DataFrame, docs: DataFrame, id_col: str, generate: Callable[[Column, Column], Column] = first_sentence) -> DataFrame:
    """(query, question, answer, context, sources); a query without passages has a null answer and no sources.

    `generate` makes a column from question and context: an expression, or a pandas UDF that calls a model.
    """
    j = queries.select("query", "question").join(contexts(ranked, docs, id_col), "query", "left")
    return j.select("query", "question", F.when(F.col("context").isNotNull(), generate(F.col("question"), F.col("context"))).alias("answer"), "context", F.coalesce("sources", F.array().cast("array<struct<file_name:string,section_title:string,page:int>>")).alias("sources"))
