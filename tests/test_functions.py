"""Golden cases of the scalar functions and folds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strataq.functions import text as T
from strataq.functions.unicode import normalise_question
from strataq.operators import chunking as C
from strataq.operators import retrieval as R
from strataq.operators import stateful


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize("given, want", [("a \t\nb\r\n\n\n\nc  ", "a\nb\n\nc"), ("", ""), (None, None), ("x \n　y　", "x\n　y")])
def test_clean_text(spark, given, want):
    assert one(spark, given, T.clean_text) == (want.replace("\n　y", "\n　y") if want else want)


@pytest.mark.parametrize("given, ratio, garbled", [("安全 ab", 0.5, False), ("", 0.0, True), (None, 0.0, True), ("安全abc", 0.4, False), ("安abc", 0.25, True)])
def test_ratio(spark, given, ratio, garbled):
    assert one(spark, given, T.cjk_ratio) == pytest.approx(ratio)
    assert one(spark, given, T.is_garbled) is garbled


def test_fragments(spark):
    assert one(spark, "|以|黑|以|黑|", T.fragment_count) == 1


@pytest.mark.parametrize("given, want", [("第五十九条", "第59条"), ("三十日", "30日"), ("一般", "一般"), ("２ ｍ", "2ｍ"), ("三十万人", "10030人"), ("一二人", "2人"), ("零日", "零日"), ("一百二十日", "120日"), (None, "")])
def test_normalise_for_match(spark, given, want):
    assert one(spark, given, T.normalise_for_match) == want


def test_coverage(spark):
    df = spark.createDataFrame([(["a", " ", "b"], "xa"), ([], "x"), (["第五条"], "见第五条")], "p array<string>, t string")
    assert [r[0] for r in df.select(T.coverage(F.col("p"), F.col("t"))).collect()] == [0.5, 0.0, 1.0]


@pytest.mark.parametrize("given, want", [("第五条 内容", "第五条"), ("3.1.2 内容", "3.1.2"), ("总则", "总则"), ("3.1 见第五条", "第五条")])
def test_section_title(spark, given, want):
    assert one(spark, given, T.section_title) == want


@pytest.mark.parametrize("n, want", [(800, [450, 430, 60]), (675, [675]), (0, [0])])
def test_hard_windows(spark, n, want):
    assert [len(x) for x in one(spark, "字" * n, lambda c: C.hard_windows(c))] == want


def test_greedy_pack(spark):
    got = one(spark, ["a" * 200, "b" * 249, "c" * 10], lambda c: C.greedy_pack(c), "array<string>")
    assert got == ["a" * 200, "b" * 249 + "\n" + "c" * 10]


def test_chunk_id(spark):
    df = spark.createDataFrame([("s", None, 0, "c")], "s string, p int, i int, c string")
    assert df.select(C.chunk_id(F.col("s"), F.col("p"), F.col("i"), F.col("c"))).first()[0] == hashlib.sha256(b"s:None:0:c").hexdigest()[:16]


def test_table_to_markdown(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, [None, ""]), (1, 2, ["1"])], "k int, o int, c array<string>")
    assert C.table_to_markdown(rows, ["k"], "o", F.col("c"), F.lit(None).cast("string")).first()["markdown"] == "【表格】\n| a | b |\n|---|---|\n| 1 |   |"


def test_table_parts(spark):
    rows = [f"| 叉车 | {i:03d} |" for i in range(120)]
    table = "\n".join(["【表格：台账】", "| 名称 | 数量 |", "|---|---|", *rows])
    parts = one(spark, table, lambda c: C.table_parts(c))
    assert len(parts) > 1 and all(len(p) <= 900 and p.startswith("【表格：台账】\n| 名称 | 数量 |\n|---|---|\n") for p in parts)
    assert [x for p in parts for x in p.split("\n")[3:]] == rows
    assert one(spark, "| a |", lambda c: C.table_parts(c)) == ["| a |"]
    long = "| " + "x" * 1000 + " |"
    assert [p.split("\n")[2:] for p in one(spark, "\n".join(["| h |", "|---|", rows[0], long, rows[1]]), lambda c: C.table_parts(c))] == [[rows[0]], [long], [rows[1]]]
    assert one(spark, "字" * 1000, lambda c: C.table_parts(c)) is None


def test_rrf(spark):
    lists = [spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(xs)], "query int, doc string, rank int") for xs in ("xy", "yz")]
    got = {r["doc"]: (round(r["score"], 9), r["rank"]) for r in R.rrf(lists).collect()}
    assert got == {"y": (0.032522475, 1), "x": (0.016393443, 2), "z": (0.016129032, 3)}
    tie = R.rrf([spark.createDataFrame([(1, d, 1)], "query int, doc string, rank int") for d in "xz"]).orderBy("rank").collect()
    assert [r["doc"] for r in tie] == ["x", "z"]


def test_bm25_drops_documents_without_terms(spark):
    docs = spark.createDataFrame([(1, "火灾 报警"), (2, "叉车"), (3, None), (4, "绝缘手套")], "row_id int, page_content string")
    asked = spark.createDataFrame([(7, "火灾"), (8, None)], "query int, question string")
    assert [(r["query"], r["doc"]) for r in R.bm25(asked, R.Index(docs, "row_id", "page_content")).collect()] == [(7, 1)]


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7), (4, None, 8)], "row_id int, k string, row int")
    assert sorted(r[0] for r in R.keep_first(df, ["k"], ["row_id"]).collect()) == [1, 3, 4]


BASE = 1_700_000_000


def requests(spark, times, key="k"):
    return spark.createDataFrame([(i, key, t) for i, t in enumerate(times)], "rid int, key string, s bigint").select("rid", "key", F.timestamp_seconds(F.col("s") + BASE).alias("ts"))


def test_rate_limit(spark):
    r = requests(spark, [0, 1, 2, 60, 61, 62]).unionByName(spark.createDataFrame([(9, None, None)], "rid int, key string, ts timestamp"))
    got = stateful.rate_limit(r, "key", "ts", "rid", limit=2, window_s=60).orderBy("rid").collect()
    assert [x["admitted"] for x in got] == [True, True, False, False, True, True]


def test_streaming_rate_limit_equals_batch(spark, tmp_path):
    from strataq.streaming import limits

    path = str(tmp_path / "in")
    requests(spark, [0, 1, 2, 60, 61, 62]).write.parquet(path)
    stream = spark.readStream.schema("rid int, key string, ts timestamp").parquet(path)
    q = limits.rate_limit(stream, "key", "ts", "rid", limit=2, window_s=60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["admitted"] for r in spark.table("limited").orderBy("rid").collect()] == [True, True, False, False, True, True]


def test_min_interval_and_cache(spark):
    r = requests(spark, [0, 1, 10])
    assert [x["start_us"] - BASE * 1_000_000 for x in stateful.min_interval(r, "key", "ts", "rid", 3).orderBy("rid").collect()] == [0, 3_000_000, 10_000_000]
    assert [x["hit"] for x in stateful.cache_hits(requests(spark, [0, 5, 11]), F.col("key"), "ts", "rid", 10).orderBy("rid").collect()] == [False, True, False]


def test_normalise_question(spark):
    assert one(spark, "  ＡＢＣ　 d ", lambda c: normalise_question(c)) == "abc d"


def test_numbered(spark):
    from strataq.common import numbered

    df = spark.range(50).repartition(4).select(F.col("id"), (F.col("id") * 7 % 50).alias("v"))
    got = numbered(df, [F.col("v").asc()]).orderBy("n").collect()
    assert [r["v"] for r in got] == list(range(50)) and [r["n"] for r in got] == list(range(1, 51))


def test_answers(spark):
    from strataq.operators import answer as A

    docs = spark.createDataFrame([(1, "甲.pdf", "第五条", 3, "应当检查。其余。"), (2, "乙.docx", None, None, "不得进入。"), (3, "甲.pdf", "第五条", 3, "另一段。")], "row_id int, file_name string, section_title string, page int, page_content string")
    asked = spark.createDataFrame([(7, "问？"), (8, "无")], "query int, question string")
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query int, doc int, rank int")
    got = {r["query"]: r for r in A.answer(asked, ranked, docs, "row_id").collect()}
    assert got[7]["context"] == "[片段1] 《甲.pdf》第五条，第3页\n应当检查。其余。\n\n[片段2] 《乙.docx》\n不得进入。\n\n[片段3] 《甲.pdf》第五条，第3页\n另一段。"
    assert got[7]["answer"] == "应当检查。" and [s["file_name"] for s in got[7]["sources"]] == ["甲.pdf", "乙.docx"]
    assert got[8]["answer"] is None and got[8]["sources"] == []


def test_ocr_tables_and_embedding_text(spark):
    from strataq.functions import text as T

    df = spark.createDataFrame([(1, "page", "识别出的文字。"), (2, "page", "abc"), (3, "page", None), (4, "page", " ")], "i int, page string, ocr string")
    assert [r[0] for r in df.orderBy("i").select(T.accept_ocr(F.col("page"), F.col("ocr"))).collect()] == ["识别出的文字。", "page", "page", "page"]
    sizes = spark.createDataFrame([(1, 31_457_280, 120), (2, 31_457_281, 1), (3, 1, 121)], "i int, size bigint, pages int")
    assert [r[0] for r in sizes.orderBy("i").select(T.needs_tables(F.col("size"), F.col("pages"))).collect()] == [True, False, False]
    assert tuple(df.limit(1).select(T.embedding_text(F.lit(None).cast("string")).alias("a"), T.embedding_text(F.lit("")).alias("b"), T.embedding_text(F.lit("a")).alias("c")).first()) == (" ", " ", "a")


def test_limits_deltas_and_model_output(spark):
    from strataq.operators import evaluation as E

    df = spark.createDataFrame([(["boom", "HTTP 429: Rate limit exceeded"],), (["429"],), (["Rate limit"],)], "chain array<string>")
    assert [r[0] for r in df.select(E.is_daily_limit(F.col("chain"))).collect()] == [True, False, False]
    one = spark.range(1)
    assert one.select(E.delta_text(F.lit(0.5), F.lit(0.5)).alias("x")).first()["x"] == "0.500 -> 0.500  (Δ+0.000 =)"
    said = 'Here: [{"question": "q", "answer": "a"}, {"question": "", "answer": "a"}] done'
    assert one.select(F.size(E.parse_items(F.lit(said))).alias("n"), F.size(E.parse_items(F.lit("[broken"))).alias("m")).first().asDict() == {"n": 1, "m": 0}


def test_windows_longer_than_slices(spark):
    from datetime import datetime

    from strataq.operators import stateful

    rows = [(1, "k", datetime(2024, 1, 1, 0, 10)), (2, "k", datetime(2024, 1, 1, 1, 10)), (3, "k", datetime(2024, 1, 1, 2, 5))]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    assert {r["rid"]: r["in_window"] for r in stateful.in_window(df, "key", "ts", "id", 7200).collect()} == {1: 1, 2: 2, 3: 3}


def test_episodes_leave_results_alone(spark):
    import random
    from datetime import datetime, timedelta

    from strataq.operators import stateful

    rng = random.Random(4)
    at, rows = datetime(2024, 1, 1), []
    for i in range(400):
        at += timedelta(seconds=rng.choice((0, 1, 5, 20, 59, 60, 61, 200)))
        rows.append((i, rng.choice("aab"), at))
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    want_rate, want_hit, kept, written = {}, {}, {}, {}
    for i, k, t in rows:
        kept[k] = [x for x in kept.get(k, []) if (t - x).total_seconds() <= 60]
        want_rate[i] = len(kept[k]) < 3
        if want_rate[i]:
            kept[k].append(t)
        want_hit[i] = k in written and (t - written[k]).total_seconds() <= 100
        if not want_hit[i]:
            written[k] = t
    for s in (50, 300, 3600):
        assert {r["rid"]: r["admitted"] for r in stateful.rate_limit(df, "key", "ts", "id", 3, 60, s).collect()} == want_rate
        assert {r["rid"]: r["hit"] for r in stateful.cache_hits(df, F.col("key"), "ts", "id", 100, s).collect()} == want_hit
