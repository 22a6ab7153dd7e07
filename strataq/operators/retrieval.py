"""Inverted index, BM25, cosine search, rank fusion, re-ranking and the four retrieval modes, on batches of queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq import settings as S
from strataq.common import materialise, small
from strataq.functions import text as T


Tokenizer = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]


def postings(docs: DataFrame, id_col: str, text_col: str, tokens: Tokenizer = T.tokens) -> DataFrame:
    """(term, doc, tf); documents without a token have none."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))


def _counted(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, document, term, count) of a column of token lists; null lists hold nothing."""
    flat = column.flatten().dictionary_encode()
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    terms = flat.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keys, n = np.unique(doc * max(1, len(terms)) + flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return terms, keys // max(1, len(terms)), keys % max(1, len(terms)), n


class Index:
    """What BM25 needs to know of a corpus: document frequencies (materialised), document count, mean length.

    One scan; terms are counted per batch, so that only (term, count) pairs move. Documents are scored where they lie.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, tokens: Tokenizer = T.tokens):
        self.tokens = tokens
        self.docs = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("tokens"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                terms, _, term, n = _counted(b.column(0))
                df = np.bincount(term, minlength=len(terms))
                # The null term carries the documents and tokens of the batch.
                yield pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array([*df, len(b.column(0))], pa.int64()), pa.array([*[0] * len(terms), int(n.sum())], pa.int64())], names=["term", "df", "tokens"])

        counted = materialise(self.docs.select("tokens").mapInArrow(run, "term string, df bigint, tokens bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")))
        self.frequency = counted.where("term is not null").select("term", "df")
        self.stats = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select("n", (F.col("tokens") / F.greatest("n", F.lit(1))).alias("avgdl"))  # one row


def term_weights(frequency: DataFrame, stats: DataFrame, epsilon: float = S.DEFAULT.retrieval.epsilon) -> DataFrame:
    """(term, df, idf): ln(N - df + .5) - ln(df + .5); negative ones become epsilon times the mean over all terms."""
    raw = frequency.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Questions that are scored in one scan of the corpus, and documents at once.
BLOCK_QUERIES, BLOCK_DOCS = 2_000, 1_000


def query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The query set in blocks of about BLOCK_QUERIES."""
    n = max(1, -(-queries.count() // BLOCK_QUERIES))
    for k in range(n):
        yield queries if n == 1 else queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == k)


def _best(ids: pa.Array, scores: np.ndarray, k: int, names: list, floor: float) -> tuple[list, pa.Array, list]:
    """(query, document, score) of the k best documents a query above floor; equal scores (to 6 digits) go by document."""
    order_of = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    out_q, out_d, out_s = [], [], []
    for j, name in enumerate(names):
        s = scores[:, j]
        at = np.flatnonzero(s > floor)
        if len(at) > k:
            rounded = np.floor(s[at] * 1e6 + 0.5)
            least = np.partition(rounded, len(at) - k)[len(at) - k]
            at = at[rounded >= least]
            at = at[np.lexsort((order_of[at], -np.floor(s[at] * 1e6 + 0.5)))[:k]]
        out_q += [name] * len(at)
        out_d.append(at)
        out_s += s[at].tolist()
    return out_q, ids.take(pa.array(np.concatenate(out_d) if out_d else np.zeros(0, dtype=np.int64))), out_s


def _bucket(term: str) -> int:
    return int(hashlib.md5(term.encode("utf-8")).hexdigest()[:4], 16) % BUCKETS


#: Dimensions of the hashed vectors that stand in for an embedding model.
BUCKETS = 256


def lexical_topk(queries: DataFrame, index: Index, k: int = S.DEFAULT.retrieval.top_k) -> DataFrame:
    """(channel, query, doc, score, rank): the k best documents of each query by BM25 and by the cosine of hashed token counts.

    A query set against all rows, in blocks: the weighted terms of a block of queries go to the workers, each batch of
    documents is scored as a matrix and keeps k a query, and only those move. Scores are rounded to 6 digits before
    ranking, ties go by document id; scores of 0 or less are no hits. A null question has no terms.
    """
    r, found = S.DEFAULT.retrieval, None
    weights = term_weights(index.frequency, index.stats)
    n, avgdl = index.stats.first()
    id_type, q_type = index.docs.schema["doc"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    for block in query_blocks(queries):
        asked = materialise(block.select("query", F.explode(index.tokens(F.col("question"))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf")))
        rows = asked.join(weights.join(small(asked.select("term").distinct()), "term"), "term", "left").select("query", "term", "qtf", "idf").collect()  # the terms of one block
        names = sorted({x[0] for x in rows})
        terms = sorted({x[1] for x in rows if x[3] is not None})
        row, col = {t: i for i, t in enumerate(terms)}, {q: j for j, q in enumerate(names)}
        bm, hashed = np.zeros((len(terms), len(names))), np.zeros((BUCKETS, len(names)))
        for q, t, qtf, idf in rows:
            hashed[_bucket(t), col[q]] += qtf
            if idf is not None:
                bm[row[t], col[q]] = qtf * idf
        hashed /= np.maximum(np.sqrt((hashed**2).sum(0)), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], row=row, bm=bm, hashed=hashed, names=names, q_type=q_type) -> Iterator[pa.RecordBatch]:
            buckets: dict[str, int] = {}
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK_DOCS):
                    b = whole.slice(at, BLOCK_DOCS)
                    words, doc, term, tf = _counted(b.column(1))
                    for w in words:
                        if w not in buckets:
                            buckets[w] = _bucket(w)
                    dl = np.bincount(doc, weights=tf, minlength=b.num_rows)
                    known = np.array([row.get(w, -1) for w in words] or [-1])[term]
                    on = known >= 0
                    part = tf[on] * (r.k1 + 1) / (tf[on] + r.k1 * (1 - r.b + r.b * dl[doc[on]] / max(avgdl, 1e-300)))
                    x = np.zeros((b.num_rows, len(row)))
                    x[doc[on], known[on]] = part
                    v = np.zeros((b.num_rows, BUCKETS))
                    np.add.at(v, (doc, np.array([buckets[w] for w in words] or [0])[term]), tf)
                    norm = np.maximum(np.sqrt((v**2).sum(1, keepdims=True)), 1e-300)
                    out = [_best(b.column(0), s, k, names, 0.0) for s in (x @ bm, (v @ hashed) / norm)]
                    for channel, (qs, ds, ss) in zip(("bm25", "vector"), out):
                        yield pa.RecordBatch.from_arrays([pa.array([channel] * len(qs), pa.string()), pa.array(qs, _ARROW.get(q_type)), ds, pa.array(ss, pa.float64())], names=["channel", "query", "doc", "score"])

        part = index.docs.mapInArrow(run, f"channel string, query {q_type}, doc {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    rounded = found.withColumn("score", F.round("score", 6)).where("score > 0")
    w = W.partitionBy("channel", "query").orderBy(F.col("score").desc(), "doc")
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def bm25(queries: DataFrame, index: Index, k: int = S.DEFAULT.retrieval.top_k) -> DataFrame:
    """(query, doc, score, rank) of the BM25 channel."""
    return lexical_topk(queries, index, k).where("channel = 'bm25'").drop("channel")


def cosine_text(queries: DataFrame, index: Index, k: int = S.DEFAULT.retrieval.top_k) -> DataFrame:
    """(query, doc, score, rank) of the vector channel: hashed token counts, a deterministic stand-in for an embedding model."""
    return lexical_topk(queries, index, k).where("channel = 'vector'").drop("channel")


def top(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = S.DEFAULT.retrieval.top_k, where: Column | None = None) -> DataFrame:
    """(query, doc, score, rank) by inner product of (query, qv) against (doc, v, ...): a stated query set in blocks.

    Each task multiplies its batches of vectors with a block of queries and keeps k a query before the shuffle. Null
    vectors, and those of another length than the queries', take no part.
    """
    data = (vectors if where is None else vectors.where(where)).where("v is not null").select("doc", "v")
    id_type, q_type = vectors.schema["doc"].dataType.simpleString(), queries.schema["query"].dataType.simpleString()
    found = None
    for block in query_blocks(queries):
        rows = block.where("qv is not null").select("query", "qv").collect()  # one block
        names, dim = [x[0] for x in rows], max((len(x[1]) for x in rows), default=0)
        qs = np.array([x[1] for x in rows], dtype=np.float64).reshape(len(rows), dim).T

        def run(batches: Iterator[pa.RecordBatch], names=names, qs=qs, dim=dim) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                b = whole.filter(pc.equal(pc.list_value_length(whole.column(1)), dim))
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
                got = _best(b.column(0), v @ qs, k, names, -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(got[0], _ARROW.get(q_type)), got[1], pa.array(got[2], pa.float64())], names=["query", "doc", "score"])

        part = data.mapInArrow(run, f"query {q_type}, doc {id_type}, score double")
        found = part if found is None else found.unionByName(part)
    return top(found.withColumn("score", F.round("score", 6)), k)


def rrf(lists: list[DataFrame], k: int = S.DEFAULT.retrieval.rrf_k) -> DataFrame:
    """(query, doc, score, rank): sum of 1 / (k + rank); ties by the first list and the rank in it."""
    tagged = [x.select("query", "doc", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)]
    both = tagged[0]
    for x in tagged[1:]:
        both = both.unionByName(x)
    fused = both.groupBy("query", "doc").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min(F.col("list_no") * 1000 + F.col("rank")).alias("first"))
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "first")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def token_overlap(question: Column, passage: Column) -> Column:
    """The default re-ranker: share of the question's distinct tokens found in the passage."""
    q = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(q, T.tokens(passage))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, score: Scorer = token_overlap) -> DataFrame:
    """(query, doc, score, rank) by `score` of question and passage (an expression, or a pandas UDF that calls a model).

    Scores are rounded to 6 digits, ties keep their order; nothing is cut by score.
    """
    both = candidates.select("query", "doc", F.col("rank").alias("old")).join(queries.select("query", "question"), "query").join(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("passage")), "doc")
    scored = both.select("query", "doc", "old", F.round(score(F.col("question"), F.col("passage")), 6).alias("score"))
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "old")
    return scored.withColumn("rank", F.row_number().over(w)).drop("old")


def retrieve_modes(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, mode, doc, score, rank) for all four modes: single channels return top_k, fused ones `final`."""
    r = S.DEFAULT.retrieval
    both = materialise(lexical_topk(queries, Index(docs, id_col, text_col)))
    vector, words = (both.where(F.col("channel") == c).drop("channel") for c in ("vector", "bm25"))
    fused = rrf([vector, words])
    reranked = rerank(fused.where(F.col("rank") <= r.pool), queries, docs, id_col, text_col)
    limit = {"vector": (vector, r.top_k), "bm25": (words, r.top_k), "hybrid": (fused, r.final), "hybrid_rerank": (reranked, r.final)}
    out = None
    for mode, (df, k) in limit.items():
        part = df.where(F.col("rank") <= k).select("query", F.lit(mode).alias("mode"), "doc", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key part are each kept.

    The minimum of the order columns is found first (with partial aggregation), then joined back: no key collects its
    rows in one task.
    """
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    first = df.where(~null).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o"))
    firsts = first.select(*[F.col(f"_o.{o}").alias(o) for o in order])
    return df.where(null).unionByName(df.where(~null).join(firsts, order, "left_semi"))
