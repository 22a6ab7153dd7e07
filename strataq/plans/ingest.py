"""Queries that keep the store: anti-joins, manifests, diagnosis, repair, de-duplication, requests and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq import settings as S
from strataq.common import materialise, table
from strataq.functions import text as T
from strataq.functions.unicode import normalise_question as nfkc
from strataq.operators import retrieval as R
from strataq.operators import stateful, store
from strataq.plans.pages import META
from strataq.plans.registry import CJK, TOKENS, WS, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""SELECT row_id, chunk_id FROM chunk_rows c WHERE NOT EXISTS (SELECT 1 FROM eval_items e WHERE lower(e.source_chunk_id) = lower(c.chunk_id))""")
def migrate_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "eval_items").where("source_chunk_id is not null").select(F.lower("source_chunk_id").alias("k")).distinct()
    chunks = table(spark, d, "chunk_rows").select("row_id", "chunk_id")
    return chunks.join(have, F.lower(chunks["chunk_id"]) == have["k"], "left_anti")


@query("SELECT (SELECT count(*) FROM embeddings) AS n, (SELECT max(len(embedding))::INTEGER FROM embeddings) AS dim, concat_ws(',', " + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in META) + ") AS keys FROM chunk_rows")
def profile_collection(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim"))
    k = table(spark, d, "chunk_rows").agg(F.concat_ws(",", *[F.when(F.count(c) > 0, c) for c in META]).alias("keys"))
    return v.crossJoin(F.broadcast(k))  # one row each


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.items[0].k') AS BIGINT), try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events""")
def json_items_or_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.items[0].k') as bigint)"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)")).alias("k"))


@query(r"""SELECT event_id, try_cast(regexp_extract(regexp_extract(props, '(?s)\{.*\}'), '"k":\s*(\d+)', 1) AS BIGINT) AS k FROM events""")
def parse_model_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(?s)\{.*\}", 0).alias("j"))
    return e.select("event_id", F.from_json("j", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("""SELECT row_id FROM rag_answers WHERE length(question) BETWEEN 1 AND 1000 AND regexp_full_match(mode, 'vector|bm25|hybrid|hybrid_rerank')""")
def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_answers").where(F.length("question").between(1, 1000) & F.col("mode").rlike("^(vector|bm25|hybrid|hybrid_rerank)$")).select("row_id")


@query("""SELECT row_id FROM request_log WHERE req_key IN (SELECT req_key FROM request_log WHERE req_key IS NOT NULL GROUP BY req_key HAVING count(*) >= 10)""")
def auth_semi_join(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "request_log").select("row_id", "req_key")
    keys = r.where("req_key is not null").groupBy("req_key").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").select("req_key")
    return r.join(keys, "req_key", "left_semi").select("row_id")


@query("""SELECT p.row_id FROM page_docs p WHERE NOT EXISTS (SELECT 1 FROM chunk_rows c WHERE c.source = p.source AND c.page IS NOT DISTINCT FROM p.page)""")
def upsert_anti_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs").select("row_id", "source", "page")
    c = table(spark, d, "chunk_rows").select(F.col("source").alias("s"), F.col("page").alias("g")).distinct()
    return p.join(c, (F.col("source") == F.col("s")) & F.col("page").eqNullSafe(F.col("g")), "left_anti").select("row_id")


_MANIFEST = "SELECT source AS path, min(file_name) AS file_name, count(*) AS size FROM chunk_rows WHERE source IS NOT NULL GROUP BY source"
_FILES = "SELECT source AS path, min(file_name) AS file_name, count(*) AS size FROM page_docs WHERE source IS NOT NULL GROUP BY source"


def _files(df: DataFrame) -> DataFrame:
    return df.where("source is not null").groupBy(F.col("source").alias("path")).agg(F.min("file_name").alias("file_name"), F.count(F.lit(1)).alias("size"))


@query(f"""WITH m AS ({_MANIFEST}), f AS ({_FILES}), b AS (SELECT file_name, max(size) AS size FROM m GROUP BY file_name)
SELECT f.path, coalesce(m.size, b.size) AS known_size FROM f LEFT JOIN m ON m.path = f.path LEFT JOIN b ON b.file_name = f.file_name""")
def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    m, f = _files(table(spark, d, "chunk_rows")), _files(table(spark, d, "page_docs"))
    by_name = m.groupBy("file_name").agg(F.max("size").alias("b"))
    return f.join(m.select("path", F.col("size").alias("a")), "path", "left").join(by_name, "file_name", "left").select("path", F.coalesce("a", "b").alias("known_size"))


_STATES = """SELECT source AS path, min(file_name) AS file_name, max(loaded_at) AS mtime, sum(coalesce(strlen(page_content), 0))::BIGINT AS size FROM page_docs WHERE source IS NOT NULL {more} GROUP BY source"""
#: The manifest is what was loaded when the last chunk was indexed; the files are what is there now.
_STATUS = f"""known AS ({_STATES.format(more="AND loaded_at <= (SELECT max(indexed_at) FROM chunk_rows)")}), now AS ({_STATES.format(more="")}),
st AS (SELECT now.path, now.file_name, CASE WHEN known.path IS NULL THEN 'new' WHEN known.mtime IS NOT DISTINCT FROM now.mtime AND known.size IS NOT DISTINCT FROM now.size THEN 'unchanged' ELSE 'changed' END AS status FROM now LEFT JOIN known ON known.path = now.path)"""


def _known(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "chunk_rows").agg(F.max("indexed_at").alias("_last"))  # one row
    return store.file_states(table(spark, d, "page_docs").crossJoin(F.broadcast(last)).where("loaded_at <= _last"))


@query(f"WITH {_STATUS} SELECT path, status FROM st")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return store.file_status(_known(spark, d), store.file_states(table(spark, d, "page_docs"))).select("path", "status")


#: The text index holds what isn't staged: scanned chunks are.
_INDEXED = "(SELECT * FROM chunk_rows WHERE NOT coalesce(is_ocr, false))"
_MISSING = f"""SELECT path FROM ({_FILES}) f WHERE NOT EXISTS (SELECT 1 FROM {_INDEXED} c WHERE c.source = f.path) AND NOT EXISTS (SELECT 1 FROM {_INDEXED} c WHERE c.file_name = f.file_name)"""


@query(_MISSING)
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_rows").where(~F.coalesce("is_ocr", F.lit(False)))
    f = _files(table(spark, d, "page_docs"))
    return f.join(c.select(F.col("source").alias("path")).distinct(), "path", "left_anti").join(c.select("file_name").distinct(), "file_name", "left_anti").select("path")


_GONE = "gone AS (SELECT min(source) AS path, file_name FROM chunk_rows WHERE source IS NOT NULL AND file_name IN (SELECT source_file FROM eval_items WHERE is_seed) GROUP BY file_name)"


@query(f"""WITH {_GONE} SELECT row_id FROM chunk_rows c WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.path = c.source) AND NOT (coalesce(c.source, '') = '' AND EXISTS (SELECT 1 FROM gone WHERE gone.file_name = c.file_name))""")
def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """The store without the files that seeds point to: rows of such a source, or of such a name where the source is empty."""
    c = table(spark, d, "chunk_rows")
    names = table(spark, d, "eval_items").where("is_seed and source_file is not null").select(F.col("source_file").alias("file_name")).distinct()
    gone = c.where("source is not null").join(names, "file_name", "left_semi").groupBy("file_name").agg(F.min("source").alias("path"))
    return store.delete_by_file(c.select("row_id", "source", "file_name"), gone).select("row_id")


_DIAG = f"""SELECT coalesce(nullif(source, ''), nullif(file_name, ''), '?') AS source, count(*) AS chunks,
coalesce(sum({CJK("page_content")} * length(page_content)) / nullif(sum(length(page_content)), 0), 0.0) AS ratio,
sum(coalesce(len(regexp_extract_all(page_content, '\\|\\s*[一-鿿]\\s*\\|\\s*[一-鿿]\\s*\\|')), 0))::DOUBLE / count(*) AS frags,
sum(CASE WHEN length(page_content) >= 150 AND {CJK("page_content")} >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS readable FROM chunk_rows GROUP BY 1"""
_BAD = "(readable < greatest(2, floor(chunks * 0.05)) AND (ratio < 0.4 OR frags > 3))"
_REASON = "concat_ws('；', CASE WHEN ratio < 0.4 THEN '中文占比低' END, CASE WHEN frags > 3 THEN '碎片过多' END)"


def _diagnosis(c: DataFrame) -> DataFrame:
    """Per file: chunks, character-weighted Han ratio, fragments a chunk, readable chunks; whether it is bad, and why."""
    t, q = F.col("page_content"), S.DEFAULT.quality
    key = F.coalesce(F.nullif("source", F.lit("")), F.nullif("file_name", F.lit("")), F.lit("?"))
    agg = c.groupBy(key.alias("source")).agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(T.cjk_ratio(t) * F.length(t)) / F.nullif(F.sum(F.length(t)), F.lit(0)), F.lit(0.0)).alias("ratio"),
        (F.sum(F.coalesce(T.fragment_count(t), F.lit(0))) / F.count(F.lit(1))).alias("frags"), F.sum(F.when((F.length(t) >= q.min_chars_per_page) & (T.cjk_ratio(t) >= q.readable_ratio), 1).otherwise(0)).alias("readable"),
    )
    bad = (F.col("readable") < F.greatest(F.lit(2), F.floor(F.col("chunks") * 0.05))) & ((F.col("ratio") < q.min_cjk_ratio) | (F.col("frags") > 3))
    reason = F.concat_ws("；", F.when(F.col("ratio") < q.min_cjk_ratio, "中文占比低"), F.when(F.col("frags") > 3, "碎片过多"))
    return agg.select("source", "chunks", F.round("ratio", 6).alias("cjk_ratio"), F.round("frags", 6).alias("frag_per_chunk"), "readable", bad.alias("bad"), F.when(bad, reason).otherwise("").alias("reason"))


@query(f"SELECT source, chunks, round(ratio, 6) AS cjk_ratio, round(frags, 6) AS frag_per_chunk, readable, {_BAD} AS bad, CASE WHEN {_BAD} THEN {_REASON} ELSE '' END AS reason FROM ({_DIAG})")
def diagnose_files(spark: SparkSession, d: str) -> DataFrame:
    return _diagnosis(table(spark, d, "chunk_rows"))


_BADLIST = f"""SELECT source AS path, chunks, {_REASON} AS reason FROM ({_DIAG}) WHERE {_BAD} UNION ALL
SELECT path, 0 AS chunks, '缺失' AS reason FROM ({_MISSING})"""


@query(_BADLIST)
def bad_files(spark: SparkSession, d: str) -> DataFrame:
    bad = _diagnosis(table(spark, d, "chunk_rows")).where("bad").select(F.col("source").alias("path"), "chunks", "reason")
    return bad.unionByName(missing_files(spark, d).select("path", F.lit(0).cast("bigint").alias("chunks"), F.lit("缺失").alias("reason")))


@query(f"""WITH b AS ({_BADLIST}) SELECT p.row_id, p.source FROM page_docs p WHERE p.source IN (SELECT path FROM b)""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").select("row_id", "source").join(bad_files(spark, d).select(F.col("path").alias("source")).distinct(), "source", "left_semi").select("row_id", "source")


@query("""SELECT DISTINCT source AS path, lower(chunk_id) AS chunk_id FROM chunk_rows WHERE source IS NOT NULL AND chunk_id IS NOT NULL""")
def manifest_update(spark: SparkSession, d: str) -> DataFrame:
    # One row a file and id: a manifest in long form has no entry that grows with its file.
    return table(spark, d, "chunk_rows").where("source is not null and chunk_id is not null").select(F.col("source").alias("path"), F.lower("chunk_id").alias("chunk_id")).distinct()


@query("""SELECT count(*) AS pages, count(DISTINCT source) AS files, coalesce(sum(length(page_content)), 0)::BIGINT AS chars, sum(CASE WHEN is_ocr THEN 1 ELSE 0 END)::BIGINT AS ocr_pages FROM page_docs""")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs")
    return p.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("source").alias("files"), F.coalesce(F.sum(F.length("page_content")), F.lit(0)).alias("chars"), F.sum(F.when(F.col("is_ocr"), 1).otherwise(0)).alias("ocr_pages"))


@query("""SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM chunk_rows) AS chunks, (SELECT count(DISTINCT source) FROM page_docs) AS files""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, e, n: df.agg(e.alias(n))
    v, c, f = one(table(spark, d, "embeddings"), F.count(F.lit(1)), "vectors"), one(table(spark, d, "chunk_rows"), F.count(F.lit(1)), "chunks"), one(table(spark, d, "page_docs"), F.count_distinct("source"), "files")
    return v.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(f))


@query("""SELECT row_id FROM chunk_rows WHERE chunk_id IS NULL UNION ALL SELECT min(row_id) FROM chunk_rows WHERE chunk_id IS NOT NULL GROUP BY lower(chunk_id)""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_rows").select("row_id", F.lower("chunk_id").alias("k"))
    return R.keep_first(c, ["k"], ["row_id"]).select("row_id")


@query("""WITH s AS (SELECT row_id, unnest(sources) AS x, generate_subscripts(sources, 1) AS i FROM rag_answers) SELECT row_id, x.file_name AS file_name, x.section_title AS section_title, x.page AS page, (min(i) - 1)::INTEGER AS first_pos FROM s GROUP BY ALL""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "rag_answers").select("row_id", F.posexplode("sources").alias("i", "x"))
    return s.groupBy("row_id", F.col("x.file_name").alias("file_name"), F.col("x.section_title").alias("section_title"), F.col("x.page").alias("page")).agg(F.min("i").alias("first_pos"))


@query(f"""WITH live AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY lower(chunk_id) ORDER BY indexed_at DESC NULLS LAST, row_id) AS n FROM chunk_rows WHERE chunk_id IS NOT NULL) WHERE n = 1 UNION ALL SELECT row_id FROM chunk_rows WHERE chunk_id IS NULL)
SELECT term, doc, count(*) AS tf FROM (SELECT row_id AS doc, unnest({TOKENS("page_content")}) AS term FROM chunk_rows WHERE row_id IN (SELECT row_id FROM live)) GROUP BY term, doc""")
def bm25_merge_staged(spark: SparkSession, d: str) -> DataFrame:
    """Postings of base and staged part as one index: of each id the newest entry. Scanned chunks stand for the staged part."""
    c, scanned = table(spark, d, "chunk_rows"), F.coalesce("is_ocr", F.lit(False))
    return store.merge_staged(c.where(~scanned), c.where(scanned), "row_id", "chunk_id", "indexed_at", "page_content")


@query()
def repair_run(spark: SparkSession, d: str) -> DataFrame:
    """The store after bad and missing files were deleted and ingested anew from their pages."""
    bad = bad_files(spark, d).select("path").distinct()
    pages = table(spark, d, "page_docs")
    todo = materialise(store.file_states(pages).join(bad, "path", "left_semi").select("path", "file_name"))
    return store.replace_files(table(spark, d, "chunk_rows"), pages, todo)


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    return store.ingest(table(spark, d, "chunk_rows"), table(spark, d, "page_docs"), _known(spark, d))


@query()
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The store after the run; its manifest, its postings and the answers that it makes stale are the three after it."""
    return _ingested(spark, d)


@query()
def incremental_ingest_manifest(spark: SparkSession, d: str) -> DataFrame:
    return store.manifest(_ingested(spark, d))


@query()
def incremental_ingest_index(spark: SparkSession, d: str) -> DataFrame:
    # Rows without an id are each an entry of their own.
    rows = _ingested(spark, d).select(F.coalesce(F.lower("chunk_id"), F.concat(F.lit("row "), "row_id")).alias("id"), "page_content")
    return R.postings(rows, "id", "page_content")


@query(f"WITH {_STATUS} SELECT row_id FROM rag_answers WHERE EXISTS (SELECT 1 FROM st WHERE status <> 'unchanged')")
def incremental_ingest_stale(spark: SparkSession, d: str) -> DataFrame:
    # Any change of the store makes every cached answer stale.
    todo = manifest_diff(spark, d).where("status <> 'unchanged'").limit(1).select(F.lit(1).alias("one"))
    return table(spark, d, "rag_answers").select("row_id").crossJoin(F.broadcast(todo)).select("row_id")


_KEPT = "list_filter(a.kept, lambda t: x.kept[1] - t <= 60000000)"


@query(f"""WITH k AS (SELECT req_key, list({{'us': epoch_us(ts), 'id': row_id}} ORDER BY ts, row_id) AS l FROM request_log WHERE req_key IS NOT NULL AND ts IS NOT NULL GROUP BY req_key),
f AS (SELECT req_key, l, list_reduce(list_prepend({{'kept': []::BIGINT[], 'ok': []::BOOLEAN[]}}, list_transform(l, lambda r: {{'kept': [r.us], 'ok': []::BOOLEAN[]}})),
lambda a, x: CASE WHEN len({_KEPT}) < 3 THEN {{'kept': list_append({_KEPT}, x.kept[1]), 'ok': list_append(a.ok, true)}} ELSE {{'kept': {_KEPT}, 'ok': list_append(a.ok, false)}} END).ok AS oks FROM k)
SELECT unnest(list_transform(l, lambda r: r.id)) AS row_id, req_key, unnest(oks) AS admitted FROM f""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return stateful.rate_limit(table(spark, d, "request_log"), "req_key", "ts", "row_id", limit=3, window_s=60).withColumnRenamed("rid", "row_id").withColumnRenamed("key", "req_key")


@query("""SELECT row_id, count(*) OVER (PARTITION BY req_key ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS in_window FROM request_log WHERE req_key IS NOT NULL AND ts IS NOT NULL""")
def requests_in_window(spark: SparkSession, d: str) -> DataFrame:
    return stateful.in_window(table(spark, d, "request_log"), "req_key", "ts", "row_id", 60).withColumnRenamed("rid", "row_id").select("row_id", "in_window")


@query("""WITH n AS (SELECT row_id, req_key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY req_key ORDER BY ts, row_id) AS i FROM request_log WHERE req_key IS NOT NULL AND ts IS NOT NULL)
SELECT row_id, req_key, max(us - i * 3000000) OVER (PARTITION BY req_key ORDER BY us, row_id ROWS UNBOUNDED PRECEDING) + i * 3000000 AS start_us FROM n""")
def min_interval_schedule(spark: SparkSession, d: str) -> DataFrame:
    return stateful.min_interval(table(spark, d, "request_log"), "req_key", "ts", "row_id").withColumnRenamed("rid", "row_id").withColumnRenamed("key", "req_key")


@query("""WITH k AS (SELECT question, mode, list({'us': epoch_us(asked_at), 'id': row_id} ORDER BY asked_at, row_id) AS l FROM rag_answers WHERE asked_at IS NOT NULL AND question IS NOT NULL GROUP BY question, mode),
f AS (SELECT l, list_reduce(list_prepend({'at': NULL::BIGINT, 'hit': []::BOOLEAN[]}, list_transform(l, lambda r: {'at': r.us, 'hit': []::BOOLEAN[]})),
lambda a, x: CASE WHEN a.at IS NOT NULL AND x.at - a.at <= 3600000000 THEN {'at': a.at, 'hit': list_append(a.hit, true)} ELSE {'at': x.at, 'hit': list_append(a.hit, false)} END).hit AS hits FROM k)
SELECT unnest(list_transform(l, lambda r: r.id)) AS row_id, unnest(hits) AS hit FROM f""")
def cache_ttl_hits(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "rag_answers")
    return stateful.cache_hits(a, F.when(F.col("question").isNotNull(), F.concat_ws("|", nfkc("question"), F.col("mode"))), "asked_at", "row_id", S.DEFAULT.limits.ttl_answer_s).withColumnRenamed("rid", "row_id")


@query("""WITH last AS (SELECT max(indexed_at) AS t FROM chunk_rows) SELECT row_id FROM rag_answers, last WHERE asked_at >= t""")
def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "chunk_rows").agg(F.max("indexed_at").alias("t"))
    return table(spark, d, "rag_answers").crossJoin(F.broadcast(last)).where("asked_at >= t").select("row_id")


@query("""SELECT e.row_id FROM eval_items e WHERE NOT EXISTS (SELECT 1 FROM rag_answers a WHERE a.question = e.question AND a.answer IS NOT NULL)""")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "rag_answers").where("answer is not null and question is not null").select("question").distinct()
    return table(spark, d, "eval_items").select("row_id", "question").join(done, "question", "left_anti").select("row_id")


#: NFKC of what questions are written in: full-width ASCII forms and the wide space (letters are composed already).
_FLAT = lambda c: f"trim(regexp_replace(lower(translate(nfc_normalize({c}), '{''.join(chr(0xFF01 + i) for i in range(94)).replace(chr(39), chr(39) * 2)}', '{''.join(chr(0x21 + i) for i in range(94)).replace(chr(39), chr(39) * 2)}')), '{WS}+', ' ', 'g'))"


@query(f"SELECT row_id, {_FLAT('question')} AS normal FROM rag_answers")
def normalize_question(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_answers").select("row_id", nfkc("question").alias("normal"))


@query(f"""SELECT row_id, 'strataq:answer:' || substr(sha1(concat_ws('|', {_FLAT('question')}, mode)), 1, 20) AS key FROM rag_answers""")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """The key of the normalised question, as the cache looks it up."""
    return table(spark, d, "rag_answers").select("row_id", T.cache_key("answer", nfkc("question"), F.col("mode")).alias("key"))
