"""Order-dependent folds over the events of one key, in batch form (the streaming twins are in strataq.streaming)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq import settings as S


def _times(requests: DataFrame, key: Column, ts: str, rid: str) -> DataFrame:
    src = requests.select(F.col(rid).alias("rid"), key.alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return src.where("key is not null and us is not null")


def _episodes(src: DataFrame, gap_us: int, slice_s: int) -> DataFrame:
    """src with `episode`: a number within the key that grows where more than gap_us passed since the request before.

    Neighbours are found within slices of time; what lies before a slice comes from a summary of one row a key and
    slice. A busy key is so cut wherever its state is empty anyway.
    """
    sliced = src.withColumn("slice", F.floor(F.col("us") / (slice_s * 1_000_000)))
    w = W.partitionBy("key", "slice").orderBy("us", "rid")
    local = sliced.withColumn("prev", F.lag("us").over(w)).withColumn("cut", F.when(F.col("us") - F.col("prev") > gap_us, 1).otherwise(0)).withColumn("cuts", F.sum("cut").over(w))
    each = local.groupBy("key", "slice").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("cuts").alias("inner"))
    order = W.partitionBy("key").orderBy("slice")
    joined = each.withColumn("new", F.when(F.col("first") - F.lag("last").over(order) > gap_us, 1).otherwise(0))
    before = joined.select("key", "slice", (F.sum(F.col("new") + F.col("inner")).over(order) - F.col("inner")).alias("base"))
    return local.join(before, ["key", "slice"]).select("rid", "key", "us", (F.col("base") + F.col("cuts")).alias("episode"))


def rate_limit(requests: DataFrame, key: str, ts: str, rid: str, limit: int = S.DEFAULT.limits.per_window, window_s: int = S.DEFAULT.limits.window_s, slice_s: int = 3600) -> DataFrame:
    """(rid, key, admitted): at most `limit` admitted requests within the last window_s seconds, exactly window_s included.

    Rejected requests aren't counted, so admission depends on earlier admissions: a sequential pass over sorted requests.
    A key is cut into episodes wherever a whole window passed without a request, as nothing is remembered there; each
    episode streams through one task (state: at most `limit` times), never collected. Null keys and times take no part.
    """
    src = _episodes(_times(requests, F.col(key), ts, rid), window_s * 1_000_000, slice_s)

    def run(batches):
        import pandas as pd

        now, kept = None, []
        for b in batches:
            out = []
            for k, t in zip(zip(b["key"], b["episode"]), b["us"]):
                if k != now:
                    now, kept = k, []
                kept = [x for x in kept if t - x <= window_s * 1_000_000]
                ok = len(kept) < limit
                if ok:
                    kept.append(t)
                out.append(ok)
            yield pd.DataFrame({"rid": b["rid"], "key": b["key"], "admitted": out})

    id_type = requests.schema[rid].dataType.simpleString()
    return src.repartition("key", "episode").sortWithinPartitions("key", "episode", "us", "rid").mapInPandas(run, f"rid {id_type}, key {requests.schema[key].dataType.simpleString()}, admitted boolean")


def in_window(requests: DataFrame, key: str, ts: str, rid: str, window_s: int, slice_s: int = 3600) -> DataFrame:
    """(rid, key, in_window): requests of the key in the window_s seconds up to and including each request's time.

    Time is cut into slices, and a request is also seen in every later slice that its window reaches, so that one busy
    key is many groups.
    """
    width, halo = slice_s * 1_000_000, window_s * 1_000_000
    src = _times(requests, F.col(key), ts, rid).withColumn("home", F.floor(F.col("us") / width))
    both = src.withColumn("slice", F.explode(F.sequence("home", F.floor((F.col("us") + halo) / width))))
    w = W.partitionBy("key", "slice").orderBy("us").rangeBetween(-halo, 0)
    return both.withColumn("in_window", F.count(F.lit(1)).over(w)).where("slice = home").select("rid", "key", "in_window")


def min_interval(requests: DataFrame, key: str, ts: str, rid: str, gap_s: float = S.DEFAULT.limits.min_interval_s, slice_s: int = 3600) -> DataFrame:
    """(rid, key, start_us): the request starts at its time or gap_s after the one before it in its key, whichever is later.

    start_i = max over j <= i of (t_j + (i - j) * gap): a running maximum of t_j - j * gap. It is taken within slices of
    time; numbers and maxima of earlier slices come from a summary of one row a key and slice.
    """
    gap = int(gap_s * 1_000_000)
    src = _times(requests, F.col(key), ts, rid).withColumn("slice", F.floor(F.col("us") / (slice_s * 1_000_000)))
    w = W.partitionBy("key", "slice").orderBy("us", "rid")
    local = src.withColumn("i", F.row_number().over(w))
    local = local.withColumn("best", F.max(F.col("us") - F.col("i") * gap).over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = local.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("c"), F.max("best").alias("top"))
    order = W.partitionBy("key").orderBy("slice")
    based = each.withColumn("base", F.sum("c").over(order) - F.col("c"))
    before = based.withColumn("prior", F.max(F.col("top") - F.col("base") * gap).over(order.rowsBetween(W.unboundedPreceding, -1))).select("key", "slice", "base", "prior")
    j = local.join(before, ["key", "slice"])
    number = F.col("base") + F.col("i")
    return j.select("rid", "key", (F.greatest(F.col("best") - F.col("base") * gap, F.coalesce("prior", F.col("best") - F.col("base") * gap)) + number * gap).alias("start_us"))


def cache_hits(requests: DataFrame, key: Column, ts: str, rid: str, ttl_s: int, slice_s: int = 3600) -> DataFrame:
    """(rid, hit): whether the key was written at most ttl_s seconds before; a miss writes, a hit doesn't refresh.

    After more than ttl_s without a request nothing is cached, so a key is cut into episodes there.
    """
    src = _episodes(_times(requests, key, ts, rid), ttl_s * 1_000_000, max(slice_s, ttl_s))

    def run(batches):
        import pandas as pd

        now, written = None, None
        for b in batches:
            out = []
            for k, t in zip(zip(b["key"], b["episode"]), b["us"]):
                if k != now:
                    now, written = k, None
                hit = written is not None and t - written <= ttl_s * 1_000_000
                if not hit:
                    written = t
                out.append(hit)
            yield pd.DataFrame({"rid": b["rid"], "hit": out})

    id_type = requests.schema[rid].dataType.simpleString()
    return src.repartition("key", "episode").sortWithinPartitions("key", "episode", "us", "rid").mapInPandas(run, f"rid {id_type}, hit boolean")
