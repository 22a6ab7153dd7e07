"""Evaluation queries: labels, coverage, summaries, samples, report differences, and the context an answer saw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.common import materialise, numbered, small, table
from strataq.functions import text as T
from strataq.operators import evaluation as E
from strataq.operators.evaluation import is_gold
from strataq.plans.registry import MATCH, NOSPACE, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query(f"""SELECT row_id, {MATCH("page_content")} AS normal FROM chunk_rows""")
def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", T.normalise_for_match(F.col("page_content")).alias("normal"))


@query(f"""WITH e AS (SELECT row_id, {MATCH("answer")} AS a, list_transform(list_filter(coalesce(key_points, []), lambda k: length({NOSPACE("k")}) > 0), lambda k: {MATCH("k")}) AS ks FROM eval_items)
SELECT row_id, round(CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k: contains(a, k)))::DOUBLE / len(ks) ELSE 0.0 END, 6) AS coverage FROM e""")
def keypoint_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.select("row_id", F.round(T.coverage(F.coalesce("key_points", F.array().cast("array<string>")), F.col("answer")), 6).alias("coverage"))


_SEC, _TIT = MATCH("f.section"), MATCH("ans.src.section_title")


@query(f"""WITH first AS (SELECT * FROM eval_items WHERE row_id IN (SELECT min(row_id) FROM eval_items WHERE question IS NOT NULL GROUP BY question)),
ans AS (SELECT row_id, question, unnest(sources) AS src, generate_subscripts(sources, 1) AS i FROM rag_answers),
j AS (SELECT ans.row_id AS answer_id, (ans.i - 1)::INTEGER AS pos, coalesce(ans.src.file_name = f.source_file, false) AS same_file, f.match_terms AS terms, {_SEC} AS sec, {_TIT} AS tit FROM ans JOIN first f ON ans.question = f.question)
SELECT answer_id, pos, same_file AND CASE WHEN coalesce(len(terms), 0) > 0 THEN len(list_filter(terms, lambda t: coalesce(t, '') <> '' AND contains(tit, {MATCH("t")}))) > 0
WHEN sec = '' THEN true ELSE tit <> '' AND (contains(tit, sec) OR contains(sec, tit) OR (translate(tit, '条章节', '') <> '' AND (contains(translate(tit, '条章节', ''), translate(sec, '条章节', '')) OR contains(translate(sec, '条章节', ''), translate(tit, '条章节', ''))))) END AS gold FROM j""")
def gold_match(spark: SparkSession, d: str) -> DataFrame:
    """Every answer's sources against its question's label: is the gold file and section among them?"""
    a = table(spark, d, "rag_answers").select(F.col("row_id").alias("answer_id"), "question", F.posexplode("sources").alias("pos", "s"))
    e = first_items(spark, d)
    j = a.join(e, "question")
    chunk = {"chunk_id": F.lit(None).cast("string"), "file_name": F.col("s.file_name"), "section_title": F.col("s.section_title"), "page_content": F.lit("")}
    return j.select("answer_id", "pos", is_gold({k: F.col(k) for k in ("source_chunk_id", "source_file", "section", "match_terms")}, chunk).alias("gold"))


_FIRST = "first AS (SELECT * FROM eval_items WHERE row_id IN (SELECT min(row_id) FROM eval_items WHERE question IS NOT NULL GROUP BY question))"


def first_items(spark: SparkSession, d: str) -> DataFrame:
    """The first item of each question, so that joins by question don't multiply."""
    e = table(spark, d, "eval_items")
    keep = e.where("question is not null").groupBy("question").agg(F.min("row_id").alias("row_id")).select("row_id")
    return e.join(keep, "row_id", "left_semi")


@query("""SELECT e.row_id, CASE WHEN e.source_file IS NULL OR e.source_file NOT IN (SELECT file_name FROM chunk_rows WHERE file_name IS NOT NULL) THEN 'no chunks'
WHEN e.source_chunk_id IS NOT NULL AND lower(e.source_chunk_id) NOT IN (SELECT lower(chunk_id) FROM chunk_rows WHERE chunk_id IS NOT NULL) THEN 'unreachable' ELSE 'ok' END AS status FROM eval_items e""")
def audit_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_rows")
    files = c.where("file_name is not null").select(F.col("file_name").alias("source_file")).distinct().withColumn("f", F.lit(1))
    ids = c.where("chunk_id is not null").select(F.lower("chunk_id").alias("k")).distinct().withColumn("i", F.lit(1))
    e = table(spark, d, "eval_items").select("row_id", "source_file", F.lower("source_chunk_id").alias("k"))
    j = e.join(files, "source_file", "left").join(ids, "k", "left")
    return j.select("row_id", F.when(F.col("f").isNull(), "no chunks").when(F.col("k").isNotNull() & F.col("i").isNull(), "unreachable").otherwise("ok").alias("status"))


@query("SELECT count(*) AS items, sum(CASE WHEN status = 'no chunks' THEN 1 ELSE 0 END)::BIGINT AS no_chunks, sum(CASE WHEN status = 'unreachable' THEN 1 ELSE 0 END)::BIGINT AS unreachable, round(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END)::DOUBLE / greatest(1, count(*)), 6) AS reachable FROM (" + SQL["audit_labels"] + ")")
def audit_totals(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    a = audit_labels(spark, d)
    return a.agg(F.count(F.lit(1)).alias("items"), count("no chunks").alias("no_chunks"), count("unreachable").alias("unreachable"), F.round(count("ok") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("reachable"))


@query(f"""WITH {_FIRST} SELECT a.row_id, f.id, f.category, a.mode FROM rag_answers a JOIN first f ON a.question = f.question""")
def gen_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "rag_answers").select("row_id", "question", "mode")
    return a.join(first_items(spark, d).select("question", "id", "category"), "question").select("row_id", "id", "category", "mode")


_POINTS = f"""pts AS (SELECT row_id, source_file, {MATCH("k")} AS p FROM (SELECT row_id, source_file, unnest(key_points) AS k FROM eval_items WHERE source_file IN (SELECT file_name FROM chunk_rows)) WHERE length({NOSPACE("coalesce(k, '')")}) > 0),
body AS (SELECT file_name, {MATCH("page_content")} AS t FROM chunk_rows),
hit AS (SELECT DISTINCT source_file, p FROM (SELECT DISTINCT source_file, p FROM pts) q JOIN body ON body.file_name = q.source_file WHERE contains(body.t, q.p))"""


@query(f"""WITH {_POINTS} SELECT pts.row_id, count(*) AS points, sum(CASE WHEN hit.p IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM pts LEFT JOIN hit ON hit.source_file = pts.source_file AND hit.p = pts.p GROUP BY pts.row_id""")
def audit_points(spark: SparkSession, d: str) -> DataFrame:
    """Per item whose file has chunks: its key points, and those that stand in no chunk of the file."""
    e, c = table(spark, d, "eval_items"), table(spark, d, "chunk_rows").where("file_name is not null")
    points = e.select("row_id", "source_file", F.explode("key_points").alias("k")).where(F.length(T.without_space(F.col("k"))) > 0)
    points = points.join(c.select(F.col("file_name").alias("source_file")).distinct(), "source_file", "left_semi").select("row_id", "source_file", T.normalise_for_match(F.col("k")).alias("p"))
    points = materialise(points)
    body = c.select(F.col("file_name").alias("source_file"), T.normalise_for_match(F.col("page_content")).alias("t"))
    # Each chunk against the distinct points of its file; the texts stay where they are while the points are few.
    hit = body.join(small(materialise(points.select("source_file", "p").distinct())), "source_file").where(F.col("t").contains(F.col("p"))).select("source_file", "p").distinct().withColumn("hit", F.lit(1))
    return points.join(hit, ["source_file", "p"], "left").groupBy("row_id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missing"))


@query("SELECT coalesce(sum(missing), 0)::BIGINT AS bad_points, coalesce(sum(points), 0)::BIGINT AS points, sum(CASE WHEN missing > 0 THEN 1 ELSE 0 END)::BIGINT AS items, printf('%.1f%%', 100.0 * coalesce(sum(missing), 0) / greatest(1, coalesce(sum(points), 0))) AS share FROM (" + SQL["audit_points"] + ")")
def audit_point_totals(spark: SparkSession, d: str) -> DataFrame:
    a = audit_points(spark, d).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("bad_points"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.sum(F.when(F.col("missing") > 0, 1).otherwise(0)).alias("items"))
    return a.withColumn("share", E.percent(F.col("bad_points") / F.greatest(F.lit(1), F.col("points"))))


@query("""WITH s AS (SELECT row_id, unnest(sources) AS x, generate_subscripts(sources, 1) AS i FROM rag_answers), c AS (SELECT row_id, unnest(contexts) AS t, generate_subscripts(contexts, 1) AS i FROM rag_answers)
SELECT s.row_id, (s.i - 1)::INTEGER AS pos, s.x.file_name AS file_name, length(c.t)::INTEGER AS context_length FROM s JOIN c ON s.row_id = c.row_id AND s.i = c.i""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "rag_answers").where("sources is not null and contexts is not null")
    zipped = a.select("row_id", F.posexplode(F.arrays_zip("sources", "contexts")).alias("pos", "z"), F.least(F.size("sources"), F.size("contexts")).alias("k"))
    return zipped.where("pos < k").select("row_id", "pos", F.col("z.sources.file_name").alias("file_name"), F.length("z.contexts").alias("context_length"))


@query("""SELECT row_id, substr(array_to_string(contexts, chr(10) || '---' || chr(10)), 1, 6000) AS context FROM rag_answers""")
def context_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_answers").select("row_id", F.substring(F.array_join("contexts", "\n---\n"), 1, 6000).alias("context"))


_COVER = f"""(CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k: contains(a, k)))::DOUBLE / len(ks) ELSE 0.0 END)"""
_GENERATED = f"""{_FIRST}, j AS (SELECT r.row_id, f.id, f.category, r.mode, r.latency_seconds AS latency, coalesce(r.answer, '') AS answer, substr(array_to_string(coalesce(r.contexts, []), chr(10) || '---' || chr(10)), 1, 6000) AS ctx,
{MATCH("r.answer")} AS a, list_transform(list_filter(coalesce(f.key_points, []), lambda k: length({NOSPACE("k")}) > 0), lambda k: {MATCH("k")}) AS ks FROM rag_answers r JOIN first f ON r.question = f.question),
g AS (SELECT row_id, id, category, mode, round({_COVER}, 6) AS coverage, (CASE WHEN length({NOSPACE("answer")}) = 0 THEN 0 ELSE 1 + floor({_COVER} * 4) END)::INTEGER AS score, length({NOSPACE("answer")}) > 0 AND {_COVER} >= 0.5 AS correct,
length({NOSPACE("answer")}) > 0 AND len(list_filter(regexp_extract_all(answer, '[0-9]+(?:[.][0-9]+)?'), lambda n: NOT contains(ctx, n))) = 0 AS faithful, latency FROM j)"""
_GEN_RATES = "count(*) AS n, round(avg(correct::INTEGER::DOUBLE), 4) AS accuracy, round(avg(faithful::INTEGER::DOUBLE), 4) AS faithfulness, coalesce(round(avg(CASE WHEN score > 0 THEN score::DOUBLE END), 3), 0.0) AS score, round(avg(coverage), 4) AS coverage, coalesce(round(avg(CASE WHEN latency > 0 THEN latency END), 2), 0.0) AS latency"


@query(f"WITH {_GENERATED} SELECT * FROM g")
def generation_details(spark: SparkSession, d: str) -> DataFrame:
    return E.generation_details(table(spark, d, "rag_answers"), first_items(spark, d))


@query(f"WITH {_GENERATED} SELECT {_GEN_RATES} FROM g")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.generation_summary(generation_details(spark, d))


@query(f"WITH {_GENERATED} SELECT category, {_GEN_RATES} FROM g GROUP BY category")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.generation_summary(generation_details(spark, d), "category")


@query("SELECT row_id, (CASE WHEN coalesce(question, '') <> '' AND coalesce(answer, '') <> '' THEN 1 ELSE 0 END)::INTEGER AS kept FROM eval_items")
def parse_model_items(spark: SparkSession, d: str) -> DataFrame:
    """Items in a model's chatty output: those without question or answer are dropped."""
    e = table(spark, d, "eval_items")
    said = F.concat(F.lit("好的，题目如下：\n["), F.to_json(F.struct("question", "answer", "key_points")), F.lit("]\n以上。"))
    return e.select("row_id", F.size(E.parse_items(said)).alias("kept"))


@query("SELECT category, is_seed, count(*) AS n FROM eval_items GROUP BY category, is_seed")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").groupBy("category", "is_seed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, id FROM eval_items ORDER BY coalesce(is_seed, false) DESC, md5(row_id::VARCHAR), row_id LIMIT 60")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.orderBy(F.coalesce("is_seed", F.lit(False)).desc(), F.md5(F.col("row_id").cast("string")), "row_id").limit(60).select("row_id", "id")


@query("SELECT row_id FROM chunk_rows ORDER BY md5(row_id::VARCHAR), row_id LIMIT 200")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id").orderBy(F.md5(F.col("row_id").cast("string")), "row_id").limit(200)


@query("SELECT row_id, CASE WHEN is_seed THEN id ELSE printf('gen_%03d', n) END AS new_id FROM (SELECT *, row_number() OVER (ORDER BY coalesce(is_seed, false) DESC, row_id) AS n FROM eval_items)")
def renumber_records(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select("row_id", "id", "is_seed")
    n = numbered(e, [F.coalesce("is_seed", F.lit(False)).desc(), F.col("row_id").asc()])
    return n.select("row_id", F.when(F.col("is_seed"), F.col("id")).otherwise(F.format_string("gen_%03d", F.col("n"))).alias("new_id"))


@query("SELECT row_id, ((n - 1) // 6)::BIGINT AS batch FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS n FROM eval_items WHERE NOT coalesce(is_seed, false))")
def gen_batches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").where(~F.coalesce("is_seed", F.lit(False))).select("row_id")
    return numbered(e, [F.col("row_id").asc()]).select("row_id", F.floor((F.col("n") - 1) / 6).alias("batch"))


@query("SELECT 'eval' AS origin, row_id, question FROM eval_items UNION ALL SELECT 'rag', row_id, question FROM rag_answers")
def dataset_union(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, o: table(spark, d, t).select(F.lit(o).alias("origin"), "row_id", "question")
    return pick("eval_items", "eval").unionByName(pick("rag_answers", "rag"))


@query(r"""SELECT row_id, CASE WHEN regexp_matches(page_content, '图\s*[0-9]') AND contains(coalesce(section_title, ''), '图') THEN '图纸解读' WHEN doc_type = 'table' OR regexp_matches(page_content, '[0-9]+\s*(m|mm|米|dB|%|倍|日|小时|年|人)') THEN '参数查阅'
WHEN regexp_matches(page_content, '隐患|判定|危险') THEN '隐患判定' ELSE '制度查询' END AS kind FROM chunk_rows""")
def categorize(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_rows")
    return c.select("row_id", T.category_of(F.col("doc_type"), F.col("page_content"), F.coalesce("section_title", F.lit(""))).alias("kind"))


@query("""SELECT mode, asked_at::DATE AS day, substr(arg_min(question, (asked_at, row_id)), 1, 18) AS title FROM rag_answers WHERE question IS NOT NULL AND asked_at IS NOT NULL GROUP BY mode, asked_at::DATE""")
def conversation_titles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "rag_answers").where("question is not null and asked_at is not null")
    return a.groupBy("mode", F.to_date("asked_at").alias("day")).agg(F.substring(F.min_by("question", F.struct("asked_at", "row_id")), 1, 18).alias("title"))
