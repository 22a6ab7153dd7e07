"""Evaluation of retrieval and answers: gold labels, hits, coverage of key points, a judge behind a seam, and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.functions import text as T

Judge = Callable[[Column, Column, Column, Column], Column]


def _points(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def is_gold(item: dict, chunk: dict) -> Column:
    """Whether a chunk is an item's gold: same id; or same file and (any match term, no section, or its section in title or text)."""
    n = T.normalise_for_match
    body, title, section = n(chunk["page_content"]), n(chunk["section_title"]), n(item["section"])
    terms = F.exists(_points(item["match_terms"]), lambda t: (F.coalesce(t, F.lit("")) != "") & (body.contains(n(t)) | title.contains(n(t))))
    has_terms = F.coalesce(F.size(item["match_terms"]), F.lit(0)) > 0
    bare = lambda c: F.translate(c, "条章节", "")
    two_way = (title != "") & (title.contains(section) | section.contains(title) | (bare(title) != "") & (bare(title).contains(bare(section)) | bare(section).contains(bare(title))))
    by_section = F.when(section == "", True).otherwise(two_way | body.contains(section))
    same_id = F.coalesce(F.lower(item["source_chunk_id"]) == F.lower(chunk["chunk_id"]), F.lit(False))
    same_file = F.coalesce(item["source_file"] == chunk["file_name"], F.lit(False))
    return same_id | (same_file & F.when(has_terms, terms).otherwise(by_section))


def labelled(ranked: DataFrame, items: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """ranked (query, doc, rank, ...) with `gold` and `passage`; only the retrieved rows are tested."""
    e = items.select(F.col(id_col).alias("query"), "source_chunk_id", "source_file", "section", "match_terms")
    c = chunks.select(F.col(id_col).alias("doc"), "chunk_id", "file_name", "section_title", F.col("page_content").alias("passage"))
    j = ranked.join(e, "query").join(c, "doc")
    gold = is_gold({k: F.col(k) for k in ("source_chunk_id", "source_file", "section", "match_terms")}, {"chunk_id": F.col("chunk_id"), "file_name": F.col("file_name"), "section_title": F.col("section_title"), "page_content": F.col("passage")})
    return j.select(*ranked.columns, gold.alias("gold"), "passage")


def retrieval_details(ranked: DataFrame, items: DataFrame, chunks: DataFrame, id_col: str, modes: tuple[str, ...], k: int = S.DEFAULT.retrieval.final) -> DataFrame:
    """(query, mode, hit, rr, context_recall, n_retrieved) over the first k of each question and mode; nothing retrieved counts as zeros."""
    top = labelled(ranked.where(F.col("rank") <= k), items, chunks, id_col)
    # k passages a question and mode
    each = top.groupBy("query", "mode").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda p: p["passage"]), "\n").alias("context"))
    asked = items.select(F.col(id_col).alias("query"), "key_points", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    j = asked.join(each, ["query", "mode"], "left")
    recall = F.round(T.coverage(_points(F.col("key_points")), F.col("context")), 6)
    return j.select("query", "mode", F.col("first").isNotNull().alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), recall.alias("context_recall"), F.coalesce("n", F.lit(0)).cast("int").alias("n_retrieved"))


def retrieval_summary(details: DataFrame, key: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 4)
    return details.groupBy(key).agg(F.count(F.lit(1)).alias("n"), mean(F.col("hit").cast("double")).alias("hit_rate"), mean("rr").alias("mrr"), mean("context_recall").alias("context_recall"))


def overlap_judge(points: Column, reference: Column, context: Column, answer: Column) -> Column:
    """The default judge, as the text a model would send: 1 to 5 by covered key points, right from half of them on.

    Faithful is an answer whose numbers all stand in its contexts. A blank answer scores 0. The reference isn't used.
    """
    share = T.coverage(_points(points), answer)
    blank = F.length(T.without_space(F.coalesce(answer, F.lit("")))) == 0
    numbers = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    faithful = ~blank & F.forall(numbers, lambda n: F.coalesce(context, F.lit("")).contains(n))
    verdict = F.struct(F.when(blank, 0).otherwise(1 + F.floor(share * 4)).cast("int").alias("score"), (~blank & (share >= 0.5)).alias("correct"), faithful.alias("faithful"))
    return F.concat(F.lit("评分如下：\n"), F.to_json(verdict))


def parse_object(output: Column, shape: str) -> Column:
    """The widest {...} of a model's output as a struct; null where there is none or it isn't valid."""
    return F.from_json(F.nullif(F.regexp_extract(output, r"(?s)\{.*\}", 0), F.lit("")), shape, {"mode": "PERMISSIVE"})


def parse_items(output: Column) -> Column:
    """The widest [...] of a model's output as items that have a question and an answer; empty where it isn't valid."""
    shape = "array<struct<question: string, answer: string, key_points: array<string>>>"
    got = F.from_json(F.nullif(F.regexp_extract(output, r"(?s)\[.*\]", 0), F.lit("")), shape, {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(got, lambda x: (F.coalesce(x["question"], F.lit("")) != "") & (F.coalesce(x["answer"], F.lit("")) != "")), F.array().cast(shape))


def generation_details(answers: DataFrame, items: DataFrame, judge: Judge = overlap_judge, context_chars: int = 6000) -> DataFrame:
    """(row_id, id, category, mode, coverage, score, correct, faithful, latency) of answers joined with their question's item."""
    e = items.select("question", "id", "category", "key_points", F.col("answer").alias("reference"))
    j = answers.select("row_id", "question", "answer", "contexts", "mode", "latency_seconds").join(e, "question")
    context = F.substring(F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n---\n"), 1, context_chars)
    said = j.withColumn("verdict", parse_object(judge(F.col("key_points"), F.col("reference"), context, F.col("answer")), "score int, correct boolean, faithful boolean"))
    return said.select(
        "row_id", "id", "category", "mode", F.round(T.coverage(_points(F.col("key_points")), F.col("answer")), 6).alias("coverage"),
        F.coalesce("verdict.score", F.lit(0)).alias("score"), F.coalesce("verdict.correct", F.lit(False)).alias("correct"), F.coalesce("verdict.faithful", F.lit(False)).alias("faithful"), F.col("latency_seconds").alias("latency"),
    )


def generation_summary(details: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, accuracy, faithfulness, score, coverage, latency); scores and latencies of 0 are left out, without any they are 0."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    above = lambda c, digits: F.coalesce(F.round(F.avg(F.when(F.col(c) > 0, F.col(c).cast("double"))), digits), F.lit(0.0))
    return details.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), share("correct").alias("accuracy"), share("faithful").alias("faithfulness"), above("score", 3).alias("score"), share("coverage").alias("coverage"), above("latency", 2).alias("latency"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def delta_text(base: Column, new: Column) -> Column:
    """0.500 -> 0.625  (Δ+0.125 ↑); an arrow from 1e-9 on; null if either is."""
    d = new - base
    return F.when(d.isNotNull(), F.format_string("%.3f -> %.3f  (Δ%+.3f %s)", base, new, d, F.when(d > 1e-9, "↑").when(d < -1e-9, "↓").otherwise("=")))


def is_daily_limit(messages: Column) -> Column:
    """Whether any message of an exception's chain of causes is a refusal for the daily limit."""
    return F.exists(messages, lambda m: m.contains("429") & (m.contains("free-models-per-day") | m.contains("Rate limit")))
