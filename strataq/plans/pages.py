"""Queries over parsed pages: scans, cleaning, quality predicates, tables and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.common import materialise, numbered_within, small, table
from strataq.functions import text as T
from strataq.operators import chunking as C
from strataq.plans.registry import CJK, GARBLED, NOSPACE, STRIP, WS, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
META = ["category", "doc_type", "file_name", "has_table", "is_ocr", "page", "rel_path", "sheet", "source", "total_pages"]


@query("""SELECT DISTINCT rel_path FROM page_docs WHERE lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) IN ('txt','md','pdf','docx','doc','xlsx','xls') AND file_name <> 'README.md'""")
def scan_supported_files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs")
    return p.where(F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).isin(*S.SUPPORTED) & (F.col("file_name") != "README.md")).select("rel_path").distinct()


@query("""SELECT source, row_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY row_id) AS n FROM page_docs WHERE rel_path LIKE '%.xlsx') WHERE n <= 2000""")
def sheet_row_cap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs").where(F.col("rel_path").endswith(".xlsx")).select("source", "row_id")
    return p.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("row_id"))).where("n <= 2000").drop("n")


@query("""SELECT row_id, source, page, chunk_id, page_content FROM chunk_rows""")
def scan_all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", "source", "page", "chunk_id", "page_content")


@query("""SELECT DISTINCT lower(chunk_id) AS chunk_id FROM chunk_rows WHERE chunk_id IS NOT NULL""")
def existing_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").where("chunk_id is not null").select(F.lower("chunk_id").alias("chunk_id")).distinct()


@query("""SELECT count(*) AS n FROM chunk_rows""")
def collection_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT row_id, sha1(concat_ws('|', rel_path, epoch_us(loaded_at)::VARCHAR, length(page_content)::VARCHAR)) AS cache_key FROM page_docs""")
def parse_cache_key(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs")
    return p.select("row_id", F.sha1(F.concat_ws("|", "rel_path", F.unix_micros(F.col("loaded_at").cast("timestamp")).cast("string"), F.length("page_content").cast("string"))).alias("cache_key"))


@query("""SELECT row_id, CASE WHEN rel_path IS NULL THEN '外部' WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE '根目录' END AS category FROM page_docs""")
def path_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").select("row_id", T.path_category(F.col("rel_path")).alias("category"))


_WSX = WS.replace(r"\n", "")


@query(f"""SELECT row_id, {STRIP(f"regexp_replace(regexp_replace(regexp_replace(page_content, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m){_WSX}+$', '', 'g')")} AS cleaned FROM page_docs""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").select("row_id", T.clean_text(F.col("page_content")).alias("cleaned"))


@query(f"""SELECT row_id, round({CJK("page_content")}, 6) AS ratio FROM page_docs""")
def script_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").select("row_id", F.round(T.cjk_ratio(F.col("page_content")), 6).alias("ratio"))


@query(f"""SELECT row_id FROM page_docs WHERE {GARBLED("page_content")}""")
def garbled_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").where(T.is_garbled(F.col("page_content"))).select("row_id")


@query(f"""WITH cells AS (SELECT row_id, list_filter(flatten(list_transform(list_filter(string_split(page_content, chr(10)), lambda l: starts_with(l, '|')), lambda l: list_slice(string_split(l, '|'), 2, -2))), lambda c: c <> '') AS c FROM page_docs)
SELECT row_id, len(c)::INTEGER AS n_cells, (len(c) >= 8 AND len(list_filter(c, lambda x: length({STRIP("x")}) <= 2))::DOUBLE / len(c) > 0.7) AS garbage FROM cells WHERE len(c) > 0""")
def table_garbage(spark: SparkSession, d: str) -> DataFrame:
    q = S.DEFAULT.quality
    lines = F.filter(F.split("page_content", "\n"), lambda x: x.startswith("|"))
    cells = F.filter(F.flatten(F.transform(lines, lambda x: F.slice(F.split(x, r"\|"), 2, F.greatest(F.size(F.split(x, r"\|")) - 2, F.lit(0))))), lambda c: c != "")
    p = table(spark, d, "page_docs").select("row_id", cells.alias("c")).where(F.size("c") > 0)
    short = F.size(F.filter("c", lambda c: F.length(T.strip(c)) <= 2))
    return p.select("row_id", F.size("c").alias("n_cells"), ((F.size("c") >= q.garbage_min_cells) & (short / F.size("c") > q.garbage_ratio)).alias("garbage"))


@query(f"""SELECT source, (avg(coalesce(length(page_content), 0)) < 150 OR sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 THEN 1 ELSE 0 END) = 0
OR sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 AND {GARBLED("page_content")} THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 THEN 1 ELSE 0 END) > 0.5) AS unusable FROM page_docs GROUP BY source""")
def file_text_unusable(spark: SparkSession, d: str) -> DataFrame:
    return _unusable(table(spark, d, "page_docs"))


def _unusable(p: DataFrame) -> DataFrame:
    filled = F.coalesce(F.length(T.without_space(F.col("page_content"))), F.lit(0)) > 0
    agg = p.groupBy("source").agg(F.avg(F.coalesce(F.length("page_content"), F.lit(0))).alias("mean"), F.sum(F.when(filled, 1).otherwise(0)).alias("filled"), F.sum(F.when(filled & T.is_garbled(F.col("page_content")), 1).otherwise(0)).alias("garbled"))
    return agg.select("source", ((F.col("mean") < S.DEFAULT.quality.min_chars_per_page) | (F.col("filled") == 0) | F.coalesce(F.col("garbled") / F.nullif("filled", F.lit(0)) > 0.5, F.lit(False))).alias("unusable"))


@query(f"""WITH n AS (SELECT source, page_content, row_number() OVER (PARTITION BY source ORDER BY page NULLS FIRST, row_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM page_docs),
s AS (SELECT * FROM n WHERE i < 6 OR (n > 12 AND (i - 6) % greatest(1, (n - 6) // 6) = 0 AND (i - 6) // greatest(1, (n - 6) // 6) < 6))
SELECT source, (avg(coalesce(length(page_content), 0)) < 150 OR sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 THEN 1 ELSE 0 END) = 0
OR sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 AND {GARBLED("page_content")} THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN coalesce(length({NOSPACE("page_content")}), 0) > 0 THEN 1 ELSE 0 END) > 0.5) AS unusable FROM s GROUP BY source""")
def needs_ocr_sampled(spark: SparkSession, d: str) -> DataFrame:
    # Only ids are numbered, by ranges, since one file may hold a third of all pages; texts join for the sampled ones.
    p = table(spark, d, "page_docs")
    k = S.DEFAULT.quality.sample_pages
    ids = p.select("source", "page", "row_id")
    sizes = materialise(ids.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("size")))
    ranked = numbered_within(ids, "source", [F.col("page").asc_nulls_first(), F.col("row_id").asc()]).withColumn("i", F.col("n") - 1).join(small(sizes), F.col("source").eqNullSafe(F.col("src")))
    step = F.greatest(F.lit(1), F.floor((F.col("size") - k) / k))
    sampled = ranked.where((F.col("i") < k) | ((F.col("size") > 2 * k) & ((F.col("i") - k) % step == 0) & (F.floor((F.col("i") - k) / step) < k)))
    return _unusable(sampled.select("row_id").join(p.select("row_id", "source", "page_content"), "row_id"))


@query("""SELECT row_id FROM page_docs WHERE regexp_matches(page_content, '(?m)^[\t\n\v\f\r ]*(图|表)[\t\n\v\f\r ]*[0-9]+([-.．][0-9]+)*')""")
def has_caption_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").where(F.col("page_content").rlike(S.CAPTION)).select("row_id")


@query(r"""SELECT row_id, array_to_string(list_filter(string_split(page_content, chr(10)), lambda l: NOT regexp_matches(l, '^\s*[0-9]{1,4}\s*$')), chr(10)) AS kept FROM page_docs WHERE page_content IS NOT NULL""")
def drop_page_number_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs").where("page_content is not null")
    return p.select("row_id", F.array_join(F.filter(F.split("page_content", "\n"), lambda x: ~x.rlike(r"^\s*[0-9]{1,4}\s*$")), "\n").alias("kept"))


@query("""SELECT row_id, CASE WHEN is_ocr AND NOT coalesce(has_table, false) THEN 'ocr_text' WHEN coalesce(has_table, false) THEN 'mixed'
WHEN regexp_matches(page_content, '(?m)^[\t\n\v\f\r ]*(图|表)[\t\n\v\f\r ]*[0-9]+([-.．][0-9]+)*') THEN 'figure_caption' ELSE 'text' END AS doc_type FROM page_docs""")
def doc_type_case(spark: SparkSession, d: str) -> DataFrame:
    has_table = F.coalesce("has_table", F.lit(False))
    kind = F.when(F.col("is_ocr") & ~has_table, "ocr_text").when(has_table, "mixed").when(F.col("page_content").rlike(S.CAPTION), "figure_caption").otherwise("text")
    return table(spark, d, "page_docs").select("row_id", kind.alias("doc_type"))


@query(f"""SELECT row_id, CASE WHEN starts_with(question, '{S.QUERY_INSTRUCTION}') THEN question ELSE '{S.QUERY_INSTRUCTION}' || question END AS text FROM eval_items""")
def query_instruction(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return table(spark, d, "eval_items").select("row_id", F.when(q.startswith(S.QUERY_INSTRUCTION), q).otherwise(F.concat(F.lit(S.QUERY_INSTRUCTION), q)).alias("text"))


@query("""SELECT row_id FROM chunk_rows WHERE length(page_content) BETWEEN 120 AND 700 AND (doc_type = 'table' OR regexp_matches(page_content, '应当|不得|严禁|不应|必须|不少于|不大于'))""")
def good_source(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("page_content")
    return table(spark, d, "chunk_rows").where(F.length(c).between(120, 700) & ((F.col("doc_type") == "table") | T.any_of(c, S.MODAL_WORDS))).select("row_id")


@query(r"""SELECT row_id, len(regexp_extract_all(page_content, '\|\s*[一-鿿]\s*\|\s*[一-鿿]\s*\|'))::INTEGER AS fragments FROM page_docs""")
def fragment_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").select("row_id", T.fragment_count(F.col("page_content")).alias("fragments"))


@query("SELECT row_id, concat_ws(';', " + ", ".join(f"'{c}=' || {c}::VARCHAR" for c in META) + ") AS metadata FROM chunk_rows")
def clean_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", T.metadata_string(META).alias("metadata"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, l_linenumber AS n, '| ' || concat_ws(' | ', l_partkey::VARCHAR, l_suppkey::VARCHAR, l_quantity::BIGINT::VARCHAR, CASE WHEN l_returnflag = '' THEN ' ' ELSE l_returnflag END, l_linestatus) || ' |' AS line
FROM orders JOIN lineitem ON o_orderkey = l_orderkey), g AS (SELECT o_orderkey, min(o_orderpriority) AS cap, list(line ORDER BY n, line) AS lines FROM r GROUP BY o_orderkey)
SELECT o_orderkey, concat_ws(chr(10), '【表格：' || cap || '】', lines[1], '|---|---|---|---|---|', nullif(array_to_string(lines[2:], chr(10)), '')) AS markdown FROM g""")
def table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), "l_returnflag", "l_linestatus")
    return C.table_to_markdown(rows, ["o_orderkey"], "l_linenumber", cells, F.col("o_orderpriority"))


@query("""WITH l AS (SELECT o_custkey, list('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' ORDER BY o_orderkey) AS lines FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, list_reduce(list_prepend({'part': 0, 'used': 0, 'out': []::INTEGER[]}, list_transform(lines, lambda x: {'part': 0, 'used': length(x)::INTEGER, 'out': []::INTEGER[]})),
lambda a, x: CASE WHEN a.used > 0 AND 60 + a.used + x.used > 900 THEN {'part': a.part + 1, 'used': x.used + 1, 'out': list_append(a.out, a.part + 1)} ELSE {'part': a.part, 'used': a.used + x.used + 1, 'out': list_append(a.out, a.part)} END).out AS parts FROM l),
u AS (SELECT o_custkey, unnest(parts) AS part FROM f) SELECT o_custkey, part, count(*) AS n_rows FROM u GROUP BY o_custkey, part""")
def table_split(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return lines.select("o_custkey", F.explode(C.pack_rows(F.col("lines"), F.lit(60))).alias("part")).groupBy("o_custkey", "part").agg(F.count(F.lit(1)).alias("n_rows"))


_STARTS = r"第[一二三四五六七八九十百零〇0-9]+[条章节]|[0-9]+\.[0-9]+|[一二三四五六七八九十]+、"


def _units_sql(c: str) -> str:
    return f"""list_filter(list_transform(string_split(regexp_replace({c}, '\\n+({_STARTS})', chr(1) || '\\1', 'g'), chr(1)), lambda u: {STRIP("u")}), lambda u: u <> '')"""


@query(f"""WITH u AS (SELECT row_id, {_units_sql("page_content")} AS us FROM page_docs WHERE page_content IS NOT NULL)
SELECT row_id, unnest(CASE WHEN len(us) > 0 THEN us ELSE [''] END) AS unit, generate_subscripts(CASE WHEN len(us) > 0 THEN us ELSE [''] END, 1)::INTEGER - 1 AS i FROM u""")
def structure_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_docs").where("page_content is not null").select("row_id", F.posexplode(C.structure_units(F.col("page_content"))).alias("i", "unit"))


def _title_sql(c: str) -> str:
    head = f"replace(substr({c}, 1, 60), chr(10), ' ')"
    pats = ["第[一二三四五六七八九十百零〇0-9]+[章节条]", r"[0-9]+\.[0-9]+\.[0-9]+", "[一二三四五六七八九十]+、"]
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({head}, '{p}'), '')" for p in pats) + f", substr(regexp_extract({c}, '^[^\\n]*'), 1, 24))"


@query(f"""SELECT row_id, {_title_sql("page_content")} AS title FROM chunk_rows""")
def section_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", T.section_title(F.col("page_content")).alias("title"))


def _greedy_sql(units: str) -> str:
    return f"""list_reduce(list_prepend({{'done': []::VARCHAR[], 'buf': ''}}, list_transform({units}, lambda w: {{'done': []::VARCHAR[], 'buf': w}})),
lambda a, x: CASE WHEN length(x.buf) > 450 THEN {{'done': CASE WHEN length(a.buf) > 0 THEN list_append(list_append(a.done, a.buf), x.buf) ELSE list_append(a.done, x.buf) END, 'buf': ''}}
WHEN length(a.buf) > 0 AND length(a.buf) + length(x.buf) + 2 > 450 THEN {{'done': list_append(a.done, a.buf), 'buf': x.buf}}
WHEN length(a.buf) = 0 THEN {{'done': a.done, 'buf': x.buf}} ELSE {{'done': a.done, 'buf': a.buf || chr(10) || x.buf}} END)"""


@query(f"""WITH u AS (SELECT row_id, {_units_sql("page_content")} AS us FROM page_docs WHERE page_content IS NOT NULL), f AS (SELECT row_id, {_greedy_sql("us")} AS r FROM u),
p AS (SELECT row_id, CASE WHEN length(r.buf) > 0 THEN list_append(r.done, r.buf) ELSE r.done END AS ps FROM f) SELECT row_id, unnest(ps) AS packed, generate_subscripts(ps, 1)::INTEGER - 1 AS i FROM p""")
def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_docs").where("page_content is not null")
    return p.select("row_id", F.posexplode(C.greedy_pack(C.structure_units(F.col("page_content")))).alias("i", "packed"))


@query("""WITH s AS (SELECT row_id, list_filter(regexp_extract_all(page_content, '[^。；！？;]*[。；！？;]|[^。；！？;]+$'), lambda x: x <> '') AS ss FROM chunk_rows WHERE page_content IS NOT NULL)
SELECT row_id, unnest(ss) AS sentence, generate_subscripts(ss, 1)::INTEGER - 1 AS i FROM s""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").where("page_content is not null").select("row_id", F.posexplode(T.sentences(F.col("page_content"))).alias("i", "sentence"))


@query("""WITH s AS (SELECT row_id, list_filter(regexp_extract_all(page_content, '[^。；！？;]*[。；！？;]|[^。；！？;]+$'), lambda x: x <> '') AS ss FROM chunk_rows WHERE page_content IS NOT NULL),
f AS (SELECT row_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'buf': ''}, list_transform(ss, lambda u: {'done': []::VARCHAR[], 'buf': u})),
lambda a, x: CASE WHEN length(a.buf) > 0 AND length(a.buf) + length(x.buf) > 450 THEN {'done': list_append(a.done, a.buf), 'buf': right(a.buf, 80) || x.buf} ELSE {'done': a.done, 'buf': a.buf || x.buf} END) AS r FROM s),
p AS (SELECT row_id, CASE WHEN length(r.buf) > 0 THEN list_append(r.done, r.buf) ELSE r.done END AS ps FROM f) SELECT row_id, unnest(ps) AS packed, generate_subscripts(ps, 1)::INTEGER - 1 AS i FROM p""")
def sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_rows").where("page_content is not null")
    return c.select("row_id", F.posexplode(C.sentence_pack(T.sentences(F.col("page_content")))).alias("i", "packed"))


@query("""WITH w AS (SELECT doc_id, CASE WHEN length(text) * 2 > 450 * 3 THEN list_transform(range(0, length(text), 370), lambda i: substr(text, i + 1, 450)) ELSE [text] END AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, unnest(ws) AS win, generate_subscripts(ws, 1)::INTEGER - 1 AS i FROM w""")
def hard_window_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.hard_windows(F.col("text"))).alias("i", "win"))


@query("""SELECT row_id, substr(sha256(concat_ws(':', source, coalesce(page::VARCHAR, 'None'), chunk_index::VARCHAR, substr(page_content, 1, 256))), 1, 16) AS chunk_id FROM chunk_rows""")
def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", C.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("page_content")).alias("chunk_id"))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(table(spark, d, "page_docs"))
