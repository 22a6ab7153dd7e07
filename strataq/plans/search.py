"""Retrieval queries: every evaluation item whose row_id is divisible by 100 asks all chunk rows; vectors likewise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.common import materialise, table
from strataq.functions import text as T
from strataq.operators import evaluation as E
from strataq.operators import retrieval as R
from strataq.plans.registry import MATCH, NOSPACE, TOKENS, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_BASE = f"""q AS (SELECT row_id AS query, question FROM eval_items WHERE row_id % 100 = 0),
qt AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({TOKENS("question")}) AS term FROM q) GROUP BY ALL),
dt AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM (SELECT row_id AS doc, unnest({TOKENS("page_content")}) AS term FROM chunk_rows) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(coalesce(len({TOKENS("page_content")}), 0)) AS avgdl FROM chunk_rows),
dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
dl AS (SELECT row_id AS doc, coalesce(len({TOKENS("page_content")}), 0) AS dl FROM chunk_rows),
bs AS (SELECT query, dt.doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM dt JOIN qt USING (term) JOIN idf USING (term) JOIN dl ON dl.doc = dt.doc, st GROUP BY query, dt.doc),
br AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bs),
hv AS MATERIALIZED (SELECT doc, bucket, sum(tf) AS w FROM (SELECT doc, ('0x' || substr(md5(term), 1, 4))::INTEGER % 256 AS bucket, tf FROM dt) GROUP BY ALL),
hn AS (SELECT doc, sqrt(sum(w * w)::DOUBLE) AS norm FROM hv GROUP BY doc),
qv AS (SELECT query, bucket, sum(qtf) AS w FROM (SELECT query, ('0x' || substr(md5(term), 1, 4))::INTEGER % 256 AS bucket, qtf FROM qt) GROUP BY ALL),
qn AS (SELECT query, sqrt(sum(w * w)::DOUBLE) AS norm FROM qv GROUP BY query),
vd AS (SELECT query, doc, sum(hv.w * qv.w) AS dot FROM hv JOIN qv USING (bucket) GROUP BY query, doc),
vs AS (SELECT query, doc, round(dot / (hn.norm * qn.norm), 6) AS score FROM vd JOIN hn USING (doc) JOIN qn USING (query)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM vs)"""
_FUSED = """, v20 AS (SELECT query, doc, score, rank FROM vr WHERE rank <= 20), b20 AS (SELECT query, doc, score, rank FROM br WHERE rank <= 20 AND score > 0),
fs AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(no * 1000 + rank) AS first FROM (SELECT query, doc, rank, 0 AS no FROM v20 UNION ALL SELECT query, doc, rank, 1 FROM b20) GROUP BY query, doc),
fr AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS rank FROM fs)"""
_RERANK = f""", qd AS (SELECT query, list_distinct({TOKENS("question")}) AS qt FROM q),
rs AS (SELECT fr.query, fr.doc, fr.rank AS old, round(len(list_filter(qd.qt, lambda t: list_contains({TOKENS("c.page_content")}, t)))::DOUBLE / greatest(len(qd.qt), 1), 6) AS score FROM fr JOIN qd USING (query) JOIN chunk_rows c ON c.row_id = fr.doc WHERE fr.rank <= 30),
rr AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, old) AS rank FROM rs)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("row_id % 100 = 0").select(F.col("row_id").alias("query"), "question")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_rows").select("row_id", "page_content")


@query(f"""SELECT row_id, array_to_string({TOKENS("page_content")}, ' ') AS tokens FROM chunk_rows""")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("row_id", F.array_join(T.tokens(F.col("page_content")), " ").alias("tokens"))


@query(f"WITH {_BASE} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    i = R.Index(chunks(spark, d), "row_id", "page_content")
    return R.term_weights(i.frequency, i.stats).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BASE} SELECT query, doc, score, rank::INTEGER AS rank FROM br WHERE rank <= 20 AND score > 0")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(questions(spark, d), R.Index(chunks(spark, d), "row_id", "page_content"))


_VEC = """WITH q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query, vec_id AS doc, round(list_sum(list_transform(range(1, len(qv) + 1), lambda i: qv[i]::DOUBLE * embedding[i]::DOUBLE)), 6) AS score FROM q, embeddings {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, score, rank::INTEGER AS rank FROM r WHERE rank <= 20"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    asked = materialise(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")))
    return asked, e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"), "label")


@query(_VEC.format(where=""))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, d))


@query(_VEC.format(where="WHERE label = 3"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, d), where=F.col("label") == 3)


def channels(spark: SparkSession, d: str, k: int = S.DEFAULT.retrieval.top_k) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vector list, BM25 list (both materialised: k rows a query) and their fusion."""
    q, i = questions(spark, d), R.Index(chunks(spark, d), "row_id", "page_content")
    both = materialise(R.lexical_topk(q, i, k))
    v, b = (both.where(F.col("channel") == c).drop("channel") for c in ("vector", "bm25"))
    return v, b, R.rrf([v, b])


@query(f"WITH {_BASE}{_FUSED} SELECT query, doc, score, rank::INTEGER AS rank FROM fr")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return channels(spark, d)[2]


@query(f"WITH {_BASE}{_FUSED}{_RERANK} SELECT query, doc, score, rank::INTEGER AS rank FROM rr")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    fused = channels(spark, d)[2].where(F.col("rank") <= S.DEFAULT.retrieval.pool)
    return R.rerank(fused, questions(spark, d), chunks(spark, d), "row_id", "page_content")


_MODES = """SELECT query, 'vector' AS mode, doc, score, rank::INTEGER AS rank FROM v20 UNION ALL SELECT query, 'bm25', doc, score, rank::INTEGER FROM b20
UNION ALL SELECT query, 'hybrid', doc, score, rank::INTEGER FROM fr WHERE rank <= 5 UNION ALL SELECT query, 'hybrid_rerank', doc, score, rank::INTEGER FROM rr WHERE rank <= 5"""


@query(f"WITH {_BASE}{_FUSED}{_RERANK} {_MODES}")
def retrieve_modes(spark: SparkSession, d: str) -> DataFrame:
    r = S.DEFAULT.retrieval
    v, b, fused = channels(spark, d)
    again = R.rerank(fused.where(F.col("rank") <= r.pool), questions(spark, d), chunks(spark, d), "row_id", "page_content")
    tag = lambda df, m: df.select("query", F.lit(m).alias("mode"), "doc", "score", "rank")
    return tag(v, "vector").unionByName(tag(b, "bm25")).unionByName(tag(fused.where(F.col("rank") <= r.final), "hybrid")).unionByName(tag(again.where(F.col("rank") <= r.final), "hybrid_rerank"))


@query(f"""WITH {_BASE}{_FUSED} SELECT 'rrf30' AS strategy, query, doc FROM fr WHERE rank <= 30 UNION ALL SELECT 'rrf_all', query, doc FROM fr
UNION ALL SELECT 'union', query, doc FROM (SELECT query, doc FROM v20 UNION SELECT query, doc FROM b20) UNION ALL SELECT 'union2', query, doc FROM (SELECT query, doc FROM v20 WHERE rank <= 10 UNION SELECT query, doc FROM b20 WHERE rank <= 10)""")
def pool_strategies(spark: SparkSession, d: str) -> DataFrame:
    v, b, fused = channels(spark, d)
    tag = lambda df, m: df.select(F.lit(m).alias("strategy"), "query", "doc")
    both = lambda x, y: x.select("query", "doc").union(y.select("query", "doc")).distinct()
    ten = F.col("rank") <= 10
    return tag(fused.where(F.col("rank") <= S.DEFAULT.retrieval.pool), "rrf30").union(tag(fused, "rrf_all")).union(tag(both(v, b), "union")).union(tag(both(v.where(ten), b.where(ten)), "union2"))


def GOLD(rows: str) -> str:  # noqa: N802
    """SQL: rows (query, doc, rank, and what else they have) with gold and the passage."""
    two_way = "(tit <> '' AND (contains(tit, sec) OR contains(sec, tit) OR (translate(tit, '条章节', '') <> '' AND (contains(translate(tit, '条章节', ''), translate(sec, '条章节', '')) OR contains(translate(sec, '条章节', ''), translate(tit, '条章节', ''))))))"
    return f"""(SELECT *, same_id OR (same_file AND CASE WHEN coalesce(len(terms), 0) > 0 THEN len(list_filter(terms, lambda t: coalesce(t, '') <> '' AND (contains(body, {MATCH("t")}) OR contains(tit, {MATCH("t")})))) > 0 WHEN sec = '' THEN true ELSE {two_way} OR contains(body, sec) END) AS gold
FROM (SELECT x.*, coalesce(lower(e.source_chunk_id) = lower(c.chunk_id), false) AS same_id, coalesce(e.source_file = c.file_name, false) AS same_file, e.match_terms AS terms, {MATCH("e.section")} AS sec, {MATCH("c.page_content")} AS body, {MATCH("c.section_title")} AS tit, c.page_content AS passage
FROM ({rows}) x JOIN eval_items e ON e.row_id = x.query JOIN chunk_rows c ON c.row_id = x.doc))"""


def DETAILS(ranked: str, modes: tuple[str, ...]) -> str:  # noqa: N802
    """SQL of retrieval_details over ranked (query, mode, doc, rank)."""
    names = ", ".join(f"'{m}'" for m in modes)
    points = f"list_transform(list_filter(coalesce(q.key_points, []), lambda k: length({NOSPACE('k')}) > 0), lambda k: {MATCH('k')})"
    return f"""SELECT q.row_id AS query, x.mode, g.first IS NOT NULL AS hit, round(coalesce(1.0::DOUBLE / g.first, 0.0), 6) AS rr, round(CASE WHEN len({points}) > 0 THEN len(list_filter({points}, lambda k: contains({MATCH('g.context')}, k)))::DOUBLE / len({points}) ELSE 0.0 END, 6) AS context_recall, coalesce(g.n, 0)::INTEGER AS n_retrieved
FROM (SELECT * FROM eval_items WHERE row_id % 100 = 0) q CROSS JOIN (SELECT unnest([{names}]) AS mode) x LEFT JOIN
(SELECT query, mode, min(CASE WHEN gold THEN rank END) AS first, count(*) AS n, string_agg(passage, chr(10) ORDER BY rank) AS context FROM {GOLD(ranked)} GROUP BY query, mode) g ON g.query = q.row_id AND g.mode = x.mode"""


_DETAIL = f"WITH {_BASE}{_FUSED}{_RERANK}, m AS ({_MODES}), d AS (" + DETAILS("SELECT query, mode, doc, rank FROM m WHERE rank <= 5", S.MODES) + ")"


def asked_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("row_id % 100 = 0")


@query(f"{_DETAIL} SELECT * FROM d")
def retrieval_details(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_details(retrieve_modes(spark, d).select("query", "mode", "doc", "rank"), asked_items(spark, d), table(spark, d, "chunk_rows"), "row_id", S.MODES)


@query(f"{_DETAIL} SELECT query, mode, hit, rr FROM d")
def hit_mrr(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_details(spark, d).select("query", "mode", "hit", "rr")


_SUMMARY = "count(*) AS n, round(avg(hit::INTEGER::DOUBLE), 4) AS hit_rate, round(avg(rr), 4) AS mrr, round(avg(context_recall), 4) AS context_recall"


@query(f"{_DETAIL} SELECT mode, {_SUMMARY} FROM d GROUP BY mode")
def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_summary(retrieval_details(spark, d), "mode")


_STRATEGIES = ("rrf30", "rrf_all", "union", "union2")
_POOLED = f"""pool AS (SELECT 'rrf30' AS mode, query, doc, rank AS old FROM fr WHERE rank <= 30 UNION ALL SELECT 'rrf_all', query, doc, rank FROM fr
UNION ALL SELECT 'union', query, doc, min(no * 1000 + rank) FROM (SELECT 0 AS no, * FROM v20 UNION ALL SELECT 1, * FROM b20) GROUP BY query, doc
UNION ALL SELECT 'union2', query, doc, min(no * 1000 + rank) FROM (SELECT 0 AS no, * FROM v20 WHERE rank <= 10 UNION ALL SELECT 1, * FROM b20 WHERE rank <= 10) GROUP BY query, doc),
again AS (SELECT pool.mode, pool.query, pool.doc, pool.old, round(len(list_filter(qd.qt, lambda t: list_contains({TOKENS("c.page_content")}, t)))::DOUBLE / greatest(len(qd.qt), 1), 6) AS score FROM pool JOIN qd USING (query) JOIN chunk_rows c ON c.row_id = pool.doc),
pr AS (SELECT mode, query, doc, row_number() OVER (PARTITION BY mode, query ORDER BY score DESC, old) AS rank FROM again)"""


@query(f"WITH {_BASE}{_FUSED}{_RERANK}, {_POOLED}, d AS (" + DETAILS("SELECT query, mode, doc, rank FROM pr WHERE rank <= 5", _STRATEGIES) + f") SELECT mode AS strategy, {_SUMMARY} FROM d GROUP BY mode")
def strategy_summary(spark: SparkSession, d: str) -> DataFrame:
    """Hit, MRR and context recall of the four ways to make a pool, each re-ranked."""
    v, b, fused = channels(spark, d)
    lists = v.select("query", "doc", "rank", F.lit(0).alias("no")).unionByName(b.select("query", "doc", "rank", F.lit(1).alias("no")))
    joined = lambda df: df.groupBy("query", "doc").agg(F.min(F.col("no") * 1000 + F.col("rank")).alias("rank"))
    pools = {"rrf30": fused.where(F.col("rank") <= S.DEFAULT.retrieval.pool), "rrf_all": fused, "union": joined(lists), "union2": joined(lists.where("rank <= 10"))}
    q, c, ranked = questions(spark, d), chunks(spark, d), None
    for name, pool in pools.items():
        part = R.rerank(pool.select("query", "doc", "rank"), q, c, "row_id", "page_content").select("query", F.lit(name).alias("mode"), "doc", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    details = E.retrieval_details(ranked, asked_items(spark, d), table(spark, d, "chunk_rows"), "row_id", _STRATEGIES)
    return E.retrieval_summary(details.withColumnRenamed("mode", "strategy"), "strategy")


_COMPARED = f"{_DETAIL}, j AS (SELECT b.query, b.hit::INTEGER AS base_hit, n.hit::INTEGER AS new_hit FROM d b JOIN d n ON b.query = n.query WHERE b.mode = 'bm25' AND n.mode = 'hybrid_rerank')"


@query(f"{_COMPARED} SELECT * FROM j")
def compare_reports(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each question in a base report and a new one."""
    one = materialise(retrieval_details(spark, d))
    side = lambda mode, name: one.where(F.col("mode") == mode).select("query", F.col("hit").cast("int").alias(name))
    return side("bm25", "base_hit").join(side("hybrid_rerank", "new_hit"), "query")


@query(f"{_COMPARED} SELECT query, CASE WHEN new_hit > base_hit THEN 'miss->hit' ELSE 'hit->miss' END AS flip FROM j WHERE base_hit <> new_hit")
def flip_details(spark: SparkSession, d: str) -> DataFrame:
    return compare_reports(spark, d).where("base_hit <> new_hit").select("query", F.when(F.col("new_hit") > F.col("base_hit"), "miss->hit").otherwise("hit->miss").alias("flip"))


@query(f"""{_COMPARED}, mean AS (SELECT avg(base_hit) AS b, avg(new_hit) AS n FROM j) SELECT printf('%.3f -> %.3f  (Δ%+.3f %s)', b, n, n - b, CASE WHEN n - b > 1e-9 THEN '↑' WHEN n - b < -1e-9 THEN '↓' ELSE '=' END) AS hit_rate FROM mean""")
def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    m = compare_reports(spark, d).agg(F.avg("base_hit").alias("b"), F.avg("new_hit").alias("n"))
    return m.select(E.delta_text(F.col("b"), F.col("n")).alias("hit_rate"))


@query(f"""WITH {_BASE}{_FUSED}, l AS (SELECT 'v' AS mode, query, doc, rank FROM vr WHERE rank <= 100 UNION ALL SELECT 'b', query, doc, rank FROM br WHERE rank <= 100 AND score > 0 UNION ALL SELECT 'f', query, doc, rank FROM fr),
g AS (SELECT query, min(CASE WHEN mode = 'v' THEN rank END) AS v, min(CASE WHEN mode = 'b' THEN rank END) AS b, min(CASE WHEN mode = 'f' THEN rank END) AS f FROM {GOLD("SELECT * FROM l")} WHERE gold GROUP BY query)
SELECT q.query, v::INTEGER AS vector_rank, b::INTEGER AS bm25_rank, f::INTEGER AS fused_rank, CASE WHEN f <= 30 THEN 'in pool' WHEN f IS NOT NULL THEN 'cut by pool' WHEN v IS NOT NULL OR b IS NOT NULL THEN 'too deep' ELSE 'not recalled' END AS verdict FROM q LEFT JOIN g USING (query)""")
def recall_attribution(spark: SparkSession, d: str) -> DataFrame:
    r = S.DEFAULT.retrieval
    v, b, _ = channels(spark, d, r.deep)
    fused = R.rrf([v.where(F.col("rank") <= r.top_k), b.where(F.col("rank") <= r.top_k)])
    tag = lambda df, m: df.select(F.lit(m).alias("mode"), "query", "doc", "rank")
    lists = tag(v, "v").unionByName(tag(b, "b")).unionByName(tag(fused, "f"))
    good = E.labelled(lists, asked_items(spark, d), table(spark, d, "chunk_rows"), "row_id").where("gold")
    best = good.groupBy("query").agg(*[F.min(F.when(F.col("mode") == m, F.col("rank"))).alias(n) for m, n in (("v", "vector_rank"), ("b", "bm25_rank"), ("f", "fused_rank"))])
    out = questions(spark, d).select("query").join(best, "query", "left")
    verdict = F.when(F.col("fused_rank") <= r.pool, "in pool").when(F.col("fused_rank").isNotNull(), "cut by pool").when(F.col("vector_rank").isNotNull() | F.col("bm25_rank").isNotNull(), "too deep").otherwise("not recalled")
    return out.withColumn("verdict", verdict)


@query(f"""WITH {_BASE}{_FUSED}{_RERANK} SELECT rr.query, rr.doc, substr(regexp_extract(c.page_content, '[^。；！？;]*[。；！？;]|[^。；！？;]+$'), 1, 450) AS answer FROM rr JOIN chunk_rows c ON c.row_id = rr.doc WHERE rr.rank = 1""")
def answer_extractive(spark: SparkSession, d: str) -> DataFrame:
    best = rerank_topk(spark, d).where("rank = 1").select("query", F.col("doc").alias("row_id"))
    return best.join(chunks(spark, d), "row_id").select("query", F.col("row_id").alias("doc"), F.substring(F.regexp_extract("page_content", S.SENTENCE, 0), 1, 450).alias("answer"))
