"""The pN_ queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.common import materialise, small, table
from strataq.llm import abuse, leakage, lm, lookalike, merkle, mojibake, packing, pairs, quality, scan, split


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_docs")
    keys = ["table_name", "row_id", "pos"]
    points = lookalike.find(lookalike.key_point_entries(table(spark, d, "eval_items")), keys, "txt")
    odd = materialise(lookalike.odd_rows(pages.select("row_id", "source", "page_content"), "page_content"))
    found = lookalike.find(lookalike.page_entries(odd), keys, "txt")
    counts = lm.count_corpus(pages, ["page_content"], mojibake.TRUE)
    garbled = mojibake.affected(odd, "row_id", "source", ["page_content"], counts).select(F.col("rid").alias("row_id"))
    return points.unionByName(found.join(garbled, "row_id", "left_anti").select(*keys))


def p1_normalised(spark: SparkSession, d: str) -> DataFrame:
    keys = ["table_name", "row_id", "pos"]
    entries = lookalike.key_point_entries(table(spark, d, "eval_items")).unionByName(lookalike.page_entries(table(spark, d, "page_docs")))
    return lookalike.normalise(entries, keys, "txt")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_docs")
    return mojibake.affected(pages, "row_id", "source", ["page_content", "file_name"]).select(F.col("rid").alias("row_id"), F.col("field").alias("field_name"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    out = mojibake.restore(table(spark, d, "page_docs"), "row_id", "source", ["page_content", "file_name"])
    return out.select(F.col("rid").alias("row_id"), F.col("field").alias("field_name"), F.col("cls").alias("swap"), "restored")


def _not_garbled(pages: DataFrame, rows: DataFrame, counts) -> DataFrame:
    """Rows whose page_content holds no wrongly decoded stretch; only the pages in question are looked at."""
    asked = rows.select("row_id").distinct()
    texts = pages.join(small(materialise(asked)), "row_id", "left_semi")
    garbled = mojibake.affected(texts, "row_id", "source", ["page_content"], counts).select(F.col("rid").alias("row_id"))
    return rows.join(garbled, "row_id", "left_anti")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_docs")
    found, counts = scan.noise(pages, "row_id", "source", "page", "page_content", mojibake.TRUE)
    return _not_garbled(pages, materialise(found.withColumnRenamed("rid", "row_id")), counts)


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan.repair(table(spark, d, "page_docs"), "row_id", "source", "page", "page_content").withColumnRenamed("rid", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page_docs")
    counts = lm.count_corpus(pages, ["page_content"], mojibake.TRUE)
    rows = materialise(quality.found(pages, "row_id", "page_content", counts).withColumnRenamed("rid", "row_id"))
    return rows.where("kind <> 'junk'").unionByName(_not_garbled(pages, rows.where("kind = 'junk'"), counts))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(table(spark, d, "page_docs"), "row_id", "page_content").withColumnRenamed("rid", "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return merkle.copy_pairs(table(spark, d, "chunk_rows"), "row_id", "page_content")


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return merkle.collapse(table(spark, d, "chunk_rows"), "row_id", "page_content")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    tables = {name: table(spark, d, name) for name in ("eval_items", "rag_answers")}
    counts = pairs.count_tails(tables["eval_items"].select("answer").unionByName(tables["rag_answers"].select("answer")))
    found = [pairs.defects(t, "row_id", "question", "answer", counts).select(F.lit(name).alias("table_name"), F.col("rid").alias("row_id"), "defect") for name, t in tables.items()]
    return found[0].unionByName(found[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = split.longest_stretch(table(spark, d, "chunk_rows"), "row_id", "page_content", 450)
    return found.select(F.col("item").alias("row_id"), F.when(F.col("longest") > 450, "forced").otherwise("natural").alias("cut"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_items(table(spark, d, "chunk_rows"), "row_id", "page_content", F.col("section_title"))
    return pieces.select(F.col("item").alias("row_id"), "piece_no", F.col("title").alias("section_title"), "offset", "piece")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents"), "doc_id", "text")
    return packed.where("part > 0").select(F.col("doc").alias("doc_id")).distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "part", F.col("size").alias("tokens"), "container")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    each = p8_packed(spark, d).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * packing.CAPACITY), 6).alias("fill"))


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """That every document is placed once, whole or in parts, and no container is above its capacity."""
    packed = materialise(p8_packed(spark, d))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.sum(F.when(F.col("t") > packing.CAPACITY, 1).otherwise(0)).alias("overfull"))
    docs = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("t"), F.max("part").alias("last"))
    one = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("parts") == 1, F.col("t"))).alias("tokens_whole"), F.coalesce(F.sum(F.when(F.col("parts") > 1, F.col("t") - F.col("parts"))), F.lit(0)).alias("bytes_split"), F.sum(F.when(F.col("last") + 1 != F.col("parts"), 1).otherwise(0)).alias("broken"))
    return one.crossJoin(F.broadcast(over))  # one row each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def _abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    model = abuse.train(table(spark, d, "abuse_samples"), "text", "label")
    return abuse.scores(table(spark, d, "documents"), "doc_id", "source", "text", model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select(F.col("doc").alias("doc_id"), "kind").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).select(F.col("doc").alias("doc_id"), "kind", "score")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_abuse_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_normalised, p2_found, p2_repaired, p4_found, p4_restored, p3_found, p3_collapsed, p5_found, p5_statistics, p6_found, p7_found, p7_pieces, p8_found, p8_packed, p8_whole, p8_fill, p9_found, p10_found, p10_scores, p10_rates)}

SQL = {
    "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
    "p8_whole": "SELECT count(*) AS documents, sum(CASE WHEN coalesce(strlen(text), 0) < 8192 THEN coalesce(strlen(text), 0) + 1 END)::BIGINT AS tokens_whole, coalesce(sum(CASE WHEN strlen(text) >= 8192 THEN strlen(text) END), 0)::BIGINT AS bytes_split, 0::BIGINT AS broken, 0::BIGINT AS overfull FROM documents",
    "p7_found": r"""
        SELECT row_id, CASE WHEN list_max(list_transform(string_split(
            regexp_replace(regexp_replace(page_content, '([\n。；！？;!?])', '\1' || chr(1), 'g'), '(\.)([\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}])', '\1' || chr(1) || '\2', 'g'), chr(1)),
            lambda x: length(x))) > 450 THEN 'forced' ELSE 'natural' END AS cut
        FROM chunk_rows WHERE length(page_content) > 450""",
}
