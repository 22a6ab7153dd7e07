"""The ten operators: edge cases (nulls, empty, very long, ties, repeated rows, empty tables, extra columns) and round trips."""

import bisect
import difflib
import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataq.llm import abuse, leakage, lm, lookalike, merkle, mojibake, packing, pairs, quality, queries, scan, split

PROSE = "动火作业所用叉车经质量检验部加固后贴合格标签，并在班前会上说明淹溺风险。设备管理员应当检查安全阀。"


def frame(spark, rows, schema, extra="rid string, digest string, doc string, kind string, n string"):
    """A table with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, schema)
    for c in extra.split(", "):
        name = c.split()[0]
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# 3 -----------------------------------------------------------------------------------------------------------------
def test_merkle_groups(spark):
    rows = [
        (1, "编号：A-1\n型号：Dovra-67\n系统：PLC"), (2, "型号：dOVRA-67; 系统：plc; 编号：a-1"), (3, "型号：Dovra-67\n编号：A-1\n系统：ESD"),
        (4, "压力 17.1 kPa，停用。"), (5, "压力17.1kPa。停用"), (6, "压力 171 kPa，停用。"), (7, None), (8, ""), (9, " 。"), (10, "日期 2025-11-22"), (11, "日期 2025 11 22"),
        (12, "a" * 300_000), (13, "A" * 300_000), (14, "| 26.3 | 43.9 |"), (15, "26.3, 43.9"), (16, "26.343.9"),
        (17, "名称：甲\n数量：乙"), (18, "名称：乙\n数量：甲"),
    ]
    got = {(r["keep_id"], r["copy_id"]) for r in merkle.copy_pairs(frame(spark, rows, "row_id bigint, page_content string"), "row_id", "page_content").collect()}
    assert got == {(1, 2), (4, 5), (8, 9), (12, 13), (14, 15)}


def test_merkle_long_fields(spark):
    long, name = "数" * 130, "一个超过十六个字的很长很长很长的字段名称"
    rows = [(1, f"编号：A1；说明：{long}"), (2, f"说明：{long}\n编号：a1"), (3, f"{name}：甲；编号：A1"), (4, f"编号：A1，{name}：甲"), (5, f"编号：A1；说明：{long}数")]
    assert {tuple(r) for r in merkle.copy_pairs(spark.createDataFrame(rows, "row_id bigint, page_content string"), "row_id", "page_content").collect()} == {(1, 2), (3, 4)}


def test_merkle_nested_records(spark):
    kind = "id int, r struct<a: string, m: map<string, string>, l: array<struct<x: int, y: string>>>"
    rows = [
        (1, ("A b", {"k": "v", "q": "w"}, [(1, "s"), (2, "t")])), (2, ("a B。", {"q": "W", "k": "V"}, [(1, "S"), (2, "t!")])), (3, ("a b", {"k": "v", "q": "w"}, [(2, "t"), (1, "s")])),
        (4, ("ab", {"k": "w", "q": "v"}, [])), (5, None), (6, (None, None, None)), (7, (None, None, None)), (8, (None, {}, [])),
    ]
    assert {tuple(r) for r in merkle.copy_pairs(spark.createDataFrame(rows, kind), "id", "r").collect()} == {(1, 2), (6, 7)}


def test_merkle_one_digest_for_several_structures(spark, monkeypatch):
    monkeypatch.setattr(merkle, "root_digest", lambda kids: F.lit("x"))
    rows = [(1, "甲"), (2, "乙"), (3, "甲。"), (4, "乙 "), (5, "丙")]
    assert {tuple(r) for r in merkle.copy_pairs(spark.createDataFrame(rows, "row_id bigint, page_content string"), "row_id", "page_content").collect()} == {(1, 3), (2, 4)}


def test_merkle_collapse_counts_and_empty(spark):
    df = spark.createDataFrame([(i, "同一内容" if i % 3 else f"第{i}条") for i in range(1, 31)], "row_id bigint, page_content string")
    got = {r["keep_id"]: r["n_copies"] for r in merkle.collapse(df, "row_id", "page_content").collect()}
    assert got[1] == 20 and sum(got.values()) == 30 and len(got) == 11
    assert merkle.copy_pairs(df.where("false"), "row_id", "page_content").count() == 0


# 7 -----------------------------------------------------------------------------------------------------------------
def brute_longest(text):
    longest = run = 0
    for i, c in enumerate(text):
        run += 1
        if c in "\n。；！？;!?" or c == "." and text[i + 1 : i + 2].isspace():
            longest, run = max(longest, run), 0
    return max(longest, run)


def test_split_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("字母ab.。 \n；") if rng.random() < 0.1 else "字" for _ in range(rng.choice((451, 700, 2000)))) for _ in range(30)] + ["x" * 5000, "。" * 600, "a. " * 300, None, "", "短"]
    df = frame(spark, list(enumerate(texts)), "row_id int, page_content string", "item string, at string, part string")
    for size in (64, 1000, 65_536):
        got = {r["item"]: r["longest"] for r in split.longest_stretch(df, "row_id", "page_content", 450, size).collect()}
        assert got == {i: brute_longest(t) for i, t in enumerate(texts) if t and len(t) > 450}
    pieces = defaultdict(list)
    for r in split.split_items(df, "row_id", "page_content", F.lit("标题"), 450, 80, 1000).orderBy("item", "piece_no").collect():
        assert 0 < len(r["piece"]) <= 450 and texts[r["item"]][r["offset"] : r["offset"] + len(r["piece"])] == r["piece"]
        pieces[r["item"]].append((r["offset"], r["piece"]))
    for i, ps in pieces.items():
        assert ps[0][0] == 0 and ps[-1][0] + len(ps[-1][1]) == len(texts[i])
        assert all(a + len(p) - b == 80 or b == 0 for (a, p), (b, _) in zip(ps, ps[1:]))
    assert split.split_items(df.where("false"), "row_id", "page_content", F.lit("")).count() == 0


def test_split_files_by_byte_ranges(spark, tmp_path):
    text = "".join(random.Random(5).choice("安全生产。ab c\n；") for _ in range(9000))
    path = tmp_path / "giant.txt"
    path.write_text(text, encoding="utf-8")
    ps = [(r["offset"], r["piece"]) for r in split.split_files(spark, [str(path)], 450, 80, 4096).orderBy("offset").collect()]
    end = 0
    for a, p in ps:
        assert text[a : a + len(p)] == p and len(p) <= 450 and a <= end
        end = max(end, a + len(p))
    assert end == len(text)


# 1 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("odd, normal", [("Ｐ‍ＬＣ", "PLC"), ("Lörby", "Lörby"), ("Насос", "Насос"), ("kРа", "kPa"), ("⽕灾", "火灾"), ("1 2", "1 2"), ("X‑5", "X-5"), ("℃ Ω μ ³ ± ①，（）—•", "℃ Ω μ ³ ± ①，（）—•"), ("ậ", "ậ"), ("ậ", "ậ"), ("Н​асос", "Насос"), ("", ""), (None, None), ("𝐀", "A")])
def test_lookalikes(spark, odd, normal):
    df = frame(spark, [("t", 1, 0, odd)], "table_name string, row_id bigint, pos int, txt string", "cp string, kind string, i string, seg string")
    keys = ["table_name", "row_id", "pos"]
    assert lookalike.normalise(df, keys, "txt").first()["normal"] == normal
    assert lookalike.find(df, keys, "txt").count() == int(odd != normal)


def test_canonically_equal_texts_become_equal(spark):
    """All orders and degrees of composition of letters with marks, syllables and kana give one form, that of composition."""
    rng = random.Random(12)
    letters, marks = "aeiouAEOnszйиΑωがかハ한갃", "\u0300\u0301\u0302\u0303\u0308\u0323\u0327\u0328\u0331\u031b\u3099"
    texts = ["".join(rng.choice(letters) + "".join(rng.choice(marks) for _ in range(rng.choice((0, 1, 1, 2, 3)))) for _ in range(4)) for _ in range(150)]
    texts += ["ạ\u0308", "a\u0323\u0308", "é\u0323", "e\u0323\u0301", "ｱ", "ｶﾞ", "ｳﾞｧ", "\u1112\u1161\u11ab", "\u212b", "\u0958"]
    forms = [(i, f, unicodedata.normalize(f, t)) for i, t in enumerate(texts) for f in ("NFC", "NFD")] + [(i, "raw", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(forms, "id int, form string, txt string")
    got = defaultdict(set)
    for r in lookalike.normalise(df, ["id", "form"], "txt").collect():
        got[r["id"]].add(r["normal"])
    assert all(len(v) == 1 for v in got.values())
    for i, t in enumerate(texts):
        if not set(unicodedata.normalize("NFD", t)) & set("иΑΩ"):  # beside Latin letters these are look-alikes
            assert got[i] == {unicodedata.normalize("NFC", unicodedata.normalize("NFKC", t) if t[:1] in "ｱｶｳ" else t)}


@pytest.mark.parametrize("odd, normal", [("cօde", "code"), ("Հայերեն", "Հայերեն"), ("ᎪᏴC", "ABC"), ("lɑtin ɡas", "latin gas"), ("ﾎﾟﾝﾌﾟ", "ポンプ"), ("ﬁn", "fin"), ("ﷲ", unicodedata.normalize("NFKC", "ﷲ"))])
def test_lookalikes_beyond_two_alphabets(spark, odd, normal):
    df = spark.createDataFrame([("t", 1, 0, odd)], "table_name string, row_id bigint, pos int, txt string")
    assert lookalike.normalise(df, ["table_name", "row_id", "pos"], "txt").first()["normal"] == normal


def test_lookalike_long_and_repeated(spark):
    text = "汉" * 50_000 + "​" + "字"
    df = spark.createDataFrame([("t", 1, 0, text), ("t", 2, 0, text)], "table_name string, row_id bigint, pos int, txt string")
    keys = ["table_name", "row_id", "pos"]
    assert {r["row_id"] for r in lookalike.find(df, keys, "txt").collect()} == {1, 2}
    assert lookalike.normalise(df, keys, "txt").first()["normal"] == text.replace("​", "")
    assert lookalike.find(df.where("false"), keys, "txt").count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------
SWAPPED = [("utf-8", "latin-1"), ("utf-8", "gb18030"), ("gb18030", "latin-1"), ("utf-8", "cp932")]


@pytest.mark.parametrize("true, wrong", SWAPPED)
def test_mojibake_found_and_restored(spark, true, wrong):
    rows = [(i, "s", PROSE, "正常.pdf") for i in range(40)] + [(50, "s", PROSE[:24].encode(true).decode(wrong, "replace") + PROSE, None), (51, None, None, ""), (52, "s", "", "正常.pdf"), (53, "t", "翎北檐口棠原", "栎畔.pdf")]
    df = frame(spark, rows, "row_id bigint, source string, page_content string, file_name string", "field string, obs string, ll string, start string")
    got = {(r["rid"], r["field"]) for r in mojibake.affected(df, "row_id", "source", ["page_content", "file_name"]).collect()}
    assert got == {(50, "page_content")}
    restored = mojibake.restore(df, "row_id", "source", ["page_content", "file_name"]).first()["restored"]
    assert sum(a == b for a, b in zip(restored, PROSE[:24])) >= 20
    assert mojibake.affected(df.where("false"), "row_id", "source", ["page_content"]).count() == 0


RU = "при любых признаках утечки работу прекращают и сообщают мастеру перед входом в склад ответственный проверяет оборудование и заполняет журнал проходы держат свободными освещение включают заранее инструмент осматривают замер кислорода выполняют каждые минут"


def test_unknown_cipher_is_learned_per_source(spark):
    rng = random.Random(6)
    letters = sorted(set(RU) - {" "})
    shown = [chr(0xC0 + i) for i in range(len(letters))]
    rng.shuffle(shown)
    table = str.maketrans("".join(letters), "".join(shown))
    words = RU.split()
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    hidden = {100 + i: text() for i in range(6)}
    rows = [(i, "clean", text()) for i in range(60)] + [(i, "swapped", t.translate(table)) for i, t in hidden.items()]
    df = frame(spark, rows, "row_id bigint, source string, page_content string", "field string")
    got = {r["rid"]: (r["cls"], r["restored"]) for r in mojibake.restore(df, "row_id", "source", ["page_content"]).collect()}
    assert set(got) == set(hidden) and all("cipher" in c for c, _ in got.values())
    assert sum(a == b for i in hidden for a, b in zip(got[i][1], hidden[i])) > 0.97 * sum(map(len, hidden.values()))


ZH = "动火 作业 叉车 质量 检验 合格 标签 班前 说明 淹溺 风险 设备 管理 检查 安全 气瓶 电工 线路 架子 监护 到场 不得 开始 每日 记录 压力 阀门 消防 通道 保持 畅通 发现 隐患 立即 报告 主管 负责 整改 措施 完成 复查 签字 存档 岗位 人员 培训 考核 上岗 证书".split()


@pytest.mark.parametrize("write, seed", [("utf-8", 1), ("utf-8", 2)])
def test_unknown_page_of_bytes_is_learned_per_source(spark, write, seed):
    """Chinese text read in a page of single bytes that no list has: every source its own."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(ZH) for _ in range(90))
    hidden, rows = {}, [(i, "clean", text()) for i in range(150)]
    for k, source in enumerate(("one", "two")):
        page = [chr(0xC0 + i) for i in range(128)]
        rng.shuffle(page)
        for i in range(8):
            hidden[1000 * (k + 1) + i] = text()
            rows.append((1000 * (k + 1) + i, source, "".join(page[b - 128] if b > 127 else chr(b) for b in hidden[1000 * (k + 1) + i].encode(write))))
    df = frame(spark, rows, "row_id bigint, source string, page_content string", "field string, cls string, enc string, src string, dst string")
    got = {r["rid"]: r["restored"] for r in mojibake.restore(df, "row_id", "source", ["page_content"]).collect()}
    assert set(got) == set(hidden)
    right = sum(m.size for i in hidden for m in difflib.SequenceMatcher(None, got[i], hidden[i], False).get_matching_blocks())
    assert right > 0.97 * sum(map(len, hidden.values()))


def test_a_source_with_another_page_learns_its_own_table(spark):
    """Two bytes of the page stand elsewhere in one source: its pairs overrule the pooled table."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(ZH) for _ in range(90))
    counts = lm.count_corpus(spark.createDataFrame([(text(),) for _ in range(200)], "t string"), ["t"], mojibake.TRUE)
    hidden = text() + text() + text()
    shown = hidden.encode("utf-8").decode("latin-1").translate({0xE6: 0xE7, 0xE7: 0xE6, 0xBD: 0xA1, 0xA1: 0xBD})
    rows = [("usual", "utf8-latin", text().encode("utf-8").decode("latin-1")) for _ in range(20)] + [("odd", "utf8-latin", shown)]
    pooled, own = mojibake.learn_tables(spark.createDataFrame(rows, "source string, cls string, obs string"), counts)
    got = own.collect()
    assert [r["source"] for r in got] == ["odd"]
    table = dict(zip(map(ord, got[0]["src"]), got[0]["dst"]))
    assert mojibake.read_symbols(mojibake.symbols(shown, "utf8-latin"), "utf8-latin", table) == hidden


def test_language_model_counts_everything(spark):
    df = spark.createDataFrame([("ab",), ("ab",), (None,), ("",), ("b",)], "t string")
    counts = lm.count_corpus(df, ["t"])
    a = int(lm.char_bucket(lm.codes("a"))[0])
    pair = int(lm.pair_bucket(lm.codes("a"), lm.codes("b"))[0])
    assert counts[a] == 2 and counts[pair] == 2


# 5 -----------------------------------------------------------------------------------------------------------------
def test_kinds(spark):
    rng = random.Random(1)
    rows = [(i, PROSE * 3) for i in range(40)]
    rows += [(100, "\n".join(f"{k}. 叉车 {k}具" for k in range(1, 12))), (101, "| 名称 | 数量 |\n|---|---|\n" + "\n".join(f"| 叉车 | {k} |" for k in range(9))), (102, "页眉" * 90), (103, "".join(rng.choice("=#@&%$^~|<>_") for _ in range(300)))]
    rows += [(104, None), (105, "  \n"), (106, "单位\n数量\n" + "\n".join(f"kPa\n{k}" for k in range(12))), (107, PROSE + "\n1) 叉车\n2) 吊篮")]
    df = frame(spark, rows, "row_id bigint, page_content string", "lang string, stat string, value string")
    got = {r["rid"]: r["kind"] for r in quality.kinds(df, "row_id", "page_content").collect()}
    assert {k: v for k, v in got.items() if v != "prose"} == {100: "list", 101: "table", 102: "junk", 103: "junk", 106: "table"}
    assert 104 not in got and 105 not in got
    assert quality.kinds(df.where("false"), "row_id", "page_content").count() == 0


def test_tails_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(("zh", "en")), *[rng.choice((0.0, rng.random())) for _ in quality.STATS]) for i in range(300)]
    df = spark.createDataFrame(rows, "rid bigint, lang string, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = quality.tail_table(df).collect()
    at = {s: 2 + i for i, s in enumerate(quality.STATS)}
    for r in got:
        sign, stat = (1 if r["stat"][0] == "+" else -1), r["stat"][1:]
        own = [x[at[stat]] * sign for x in rows if x[1] == r["lang"]]
        assert r["tail"] == pytest.approx(sum(v >= r["value"] for v in own) / len(own))
    assert len(got) == len({(r[1], s, sign, x) for r in rows for (s, sign), least in quality._levels().items() for x in [r[at[s]] * sign] if x >= least})


def test_scores_choose_among_the_profiles_a_page_meets(spark):
    """The rarer of two profiles gives the kind: many pages of symbols make symbols usual, and the cells decide."""
    base = dict.fromkeys(quality.STATS, 0.0) | {"common_share": 1.0, "variety": 1.0, "letter_share": 1.0, "sentence_rate": 2.0}
    both = base | {"sentence_rate": 0.0, "symbol_ratio": 0.5, "cell_share": 1.0, "layout": 1.0, "lead": -1.0}
    symbols, cells = base | {"symbol_ratio": 0.6}, base | {"cell_share": 1.0, "layout": 1.0, "lead": -1.0}
    cols = "rid bigint, lang string, " + ", ".join(f"{s} double" for s in quality.STATS)
    for usual, kind in ((symbols, "table"), (cells, "junk")):
        rows = [(0, "zh", *both.values())] + [(i, "zh", *(usual if i < 40 else base).values()) for i in range(1, 100)]
        assert {r["rid"]: r["kind"] for r in quality.scores(spark.createDataFrame(rows, cols)).collect()} == {0: kind}


def test_every_value_is_ranked_across_partitions(spark):
    """Values that no level asks for have exact tails too, and one that most pages share runs over several partitions."""
    rng = random.Random(5)
    rows = [(i, rng.choice(("zh", "zh", "en")), *[rng.choice((0.0, 0.0, 0.25, rng.random())) for _ in quality.STATS]) for i in range(3000)]
    df = spark.createDataFrame(rows, "rid bigint, lang string, " + ", ".join(f"{s} double" for s in quality.STATS))
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are put into one partition
    try:
        got = quality.ranked(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    want, at = {}, {s: 2 + i for i, s in enumerate(quality.STATS)}
    for i, ((s, sign), least) in enumerate(quality._levels().items()):
        for lang in ("zh", "en"):
            own = sorted(r[at[s]] * sign for r in rows if r[1] == lang)
            want |= {(i, r[0]): (len(own) - bisect.bisect_left(own, r[at[s]] * sign)) / len(own) for r in rows if r[1] == lang and r[at[s]] * sign >= least}
    assert {(r["stat"], r["rid"]): r["tail"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert {r["value"] for r in quality.tail_table(df).where("stat = '+mean_word'").collect()} == {r[at["mean_word"]] for r in rows}


def test_all_tails_of_a_profile_are_combined(spark):
    """One rare statistic of a profile doesn't outweigh that its other one is usual."""
    base = dict.fromkeys(quality.STATS, 0.0) | {"common_share": 1.0, "variety": 1.0, "letter_share": 1.0, "sentence_rate": 2.0}
    both = base | {"sentence_rate": 0.0, "symbol_ratio": 0.5, "cell_share": 1.0, "layout": 1.0, "lead": -0.5}
    cols = "rid bigint, lang string, " + ", ".join(f"{s} double" for s in quality.STATS)
    # tails of page 0: symbols 20 of 100; cells 10 of 100 and lead 90 of 100
    other = lambda i: base | {"symbol_ratio": 0.6 if i < 20 else 0.0, "cell_share": 1.0 if i < 10 else 0.0, "lead": -0.5 if i < 90 else 0.5}
    rows = [(0, "zh", *both.values())] + [(i, "zh", *other(i).values()) for i in range(1, 100)]
    df = spark.createDataFrame(rows, cols)
    (got,) = quality.scores(df).collect()
    assert got["kind"] == "junk" and got["score_junk"] == pytest.approx(-np.log(0.2)) and got["score_table"] == pytest.approx(-np.log(0.1 * 0.9) / 2)
    assert {r["rid"]: r["score_junk"] for r in quality.scores(df, every=True).collect()}[5] == pytest.approx(-np.log(0.19))


_SENTENCE = re.compile(r"[。！？；](?<=[^\n。！？；]{4}[。！？；])|[.!?](?<=[a-z]{2}[.!?])(?=[\s\"”)’]|\Z)")
_WORD = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]+|[0-9]+(?:\.[0-9]+)?")
_LETTERS = re.compile(r"\b[A-Za-zÀ-ɏ][a-zà-ɏ]+\b|[㐀-鿿぀-ヿЀ-ӿ]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab.9。！\n\x00 é×Б中あ😀𠀀\"’|—…Z_$", min_size=1, max_size=40), min_size=1, max_size=5))
def test_blocks_count_what_patterns_find(texts):
    """Texts counted together, one after the other, give what the patterns find in each of them alone."""
    got = quality._counted(texts, np.ones(1 << lm.PAIR_BITS, dtype=bool))
    for t, row in zip(texts, got):
        words = _WORD.findall(t)
        assert row[6:10].tolist() == [len(words), sum(map(len, words)), len(_SENTENCE.findall(t)), len(quality._SYMBOL.findall(t))]
        assert row[10] + sum(map(len, quality._LATIN.findall(t))) == sum(map(len, _LETTERS.findall(t)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab.9。！\n\x00 é中😀\"’|$", min_size=1, max_size=40), min_size=1, max_size=5))
def test_prose_of_blocks_is_that_of_each_text(texts):
    odd = [sum(not quality._USUAL[min(ord(c), 0x10000)] for c in t) / len(t) for t in texts]
    assert quality.prose_flags(texts).tolist() == [len(_SENTENCE.findall(t)) * 100 >= 0.3 * len(t) and o <= 0.25 for t, o in zip(texts, odd)]
    assert quality.prose_flags([]).tolist() == [] and quality.prose_flags(["", *texts])[1:].tolist() == quality.prose_flags(texts).tolist()


def test_large_texts_are_counted_in_blocks(monkeypatch):
    texts = [PROSE * k for k in (1, 40, 2, 3, 90, 1)]
    whole = quality.prose_flags(texts).tolist()
    monkeypatch.setattr(quality, "BLOCK", 1000)
    parts = list(quality.blocks(texts))
    assert len(parts) > 2 and [t for p in parts for t in p] == texts and quality.prose_flags(texts).tolist() == whole


def test_variety_reads_the_whole_text():
    assert quality._variety("".join(chr(0x4E00 + i) for i in range(200)) + "ab" * 500_000) < 0.12
    assert quality._variety("".join(chr(0x4E00 + i % 997) for i in range(5000))) == 1.0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text("aZ é×ÂБё中锟\ufffdÀÿ—’·\n😀1", max_size=12), max_size=6))
def test_texts_with_a_trigger_are_plausible(texts):
    """A text that is passed over without a search holds no trigger, whatever stands beside it."""
    got = mojibake.plausible(texts).tolist()
    assert len(got) == len(texts) and all(ok or not mojibake.TRIGGER.search(t or "") for ok, t in zip(got, texts))
    assert mojibake.plausible([PROSE, None, "", "abc", "é"]).tolist() == [False, False, False, False, True]


# 2 -----------------------------------------------------------------------------------------------------------------
def test_trie_automaton_is_complete():
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))): 1 for _ in range(300)}
    trie = scan.Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for q in ("abcd", "dd", "abcabc", "zzz"):
        assert {w for w, _, _ in trie.within(q, 2)} == {w for w in words if distance(q, w) <= 2}


def test_lookup_is_exact():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 62, 5000))
    table = scan.Lookup(keys, np.arange(1, len(keys) + 1))
    assert (table.get(keys) == np.arange(1, len(keys) + 1)).all() and not table.get(keys + 1)[~np.isin(keys + 1, keys)].any()
    assert not scan.Lookup(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)).get(keys).any()


EN = "After heavy rain, the pump house remains closed until the electrician and the technician have walked the route together. The ammonia alarm may be bypassed only with a written note."


def test_scan_noise(spark):
    head = "Site Safety Manual, Volume 8"
    rows = [(i, "f.pdf", i, f"{head}\n{EN}\n{EN}\n— {i} —") for i in range(1, 31)]
    rows += [(40, "f.pdf", 40, EN.replace("electrician", "elec-\ntrician") + "\n" + EN), (41, "f.pdf", 41, EN.replace("ammonia", "arnmonia") + "\n" + EN), (42, "f.pdf", 42, "Site Safcty Manual, Volurne 8\n" + EN + "\n" + EN)]
    rows += [(43, "g.pdf", None, None), (44, "g.pdf", 1, " "), (45, None, None, EN), (46, "g.pdf", 2, "explosion-\nproof fan. " + EN), (47, "g.pdf", 2, "The explosion-proof fan and the explosion-proof fan and the explosion-proof fan stop. " + EN)]
    df = frame(spark, rows, "row_id bigint, source string, page int, page_content string", "what string, a string, b string, sig string")
    got = defaultdict(set)
    for r in scan.noise(df, "row_id", "source", "page", "page_content")[0].collect():
        got[r["rid"]].add(r["noise"])
    assert got[1] == {"header", "page_number"} and got[40] == {"hyphen"} and got[41] == {"misread"} and got[42] == {"header", "misread"}
    assert not {43, 44, 45, 46, 47} & set(got)
    fixed = {r["rid"]: r["repaired"] for r in scan.repair(df, "row_id", "source", "page", "page_content").collect()}
    assert fixed[1] == EN + "\n" + EN and fixed[40].startswith(EN) and "ammonia" in fixed[41] and "arnmonia" not in fixed[41]
    assert scan.noise(df.where("false"), "row_id", "source", "page", "page_content")[0].count() == 0


def test_vocabulary_in_blocks(spark):
    words = [("ammonia", 50), ("arnmonia", 2), ("electrician", 40), ("e1ectrician", 1), ("valve", 30), ("va1ve", 1), ("supervisor", 20), ("operator", 20), ("rare", 3), ("rnaintenance", 1), ("maintenance", 9)]
    forms = spark.createDataFrame(words, "word string, n bigint")
    whole = {tuple(r) for r in scan.misread_words(forms)[0].collect()}
    assert {("arnmonia", "ammonia"), ("e1ectrician", "electrician"), ("rnaintenance", "maintenance")} <= whole
    assert {tuple(r) for r in scan.misread_words(forms, 3)[0].collect()} == whole


def test_neighbours_misread_together(spark):
    body = "焊工作业前检查气瓶，电工作业后检查线路，架子工作业时检查脚手架。监护人未到场的，不得开始作业检查。"
    swap = lambda t: t.translate(str.maketrans("作业检查", "昨亚捡杳"))
    rows = [(i, "f.pdf", i, f"{body}\n{body}") for i in range(20)]
    for k, (a, b) in enumerate(zip("作业检查", "昨亚捡杳")):  # each misread alone, where context tells
        rows += [(20 + 5 * k + i, "f.pdf", 20 + 5 * k + i, f"{body}\n{body.replace(a, b, 1)}") for i in range(5)]
    title = "棠原酸洗作业检查手册"
    rows += [(50 + i, "g.pdf", i, f"{title}\n{EN}") for i in range(4)] + [(60, "g.pdf", 9, f"{swap(title)}\n{EN}"), (61, "h.pdf", 1, f"昨天收到通知。\n{EN}")]
    df = frame(spark, rows, "row_id bigint, source string, page int, page_content string", "what string, a string, b string, sig string")
    got = {r["rid"] for r in scan.noise(df, "row_id", "source", "page", "page_content")[0].where("noise = 'misread'").collect()}
    assert 60 in got and not got & {*range(20), *range(50, 54), 61}
    line = f"{swap(title)}第三条规定如下。\n{EN}"
    fixed = scan.repair(df.where("row_id <> 60").unionByName(frame(spark, [(60, "g.pdf", 9, f"{EN}\n{EN}\n{line}\n{EN}\n{EN}")], "row_id bigint, source string, page int, page_content string", "what string, a string, b string, sig string")), "row_id", "source", "page", "page_content")
    assert title in fixed.where("rid = 60").first()["repaired"]


@pytest.mark.parametrize("line, rest", [("— 4 —", ""), ("第8页 共17页", ""), ("Page 3 of 15", ""), ("l2", ""), ("xii", ""), ("青洲手册    — 8 —", "青洲手册"), ("青洲手册 | 21", "青洲手册"), ("Volume 8", None), ("第八条 动火", None)])
def test_page_numbers(line, rest):
    assert scan.without_page_number(line) == ((line, False) if rest is None else (rest, True))


# 6 -----------------------------------------------------------------------------------------------------------------
def test_defects(spark):
    q = "在中控室进行高处作业前，承包商代表应当确认哪些事项？"
    whole = [(i, q, f"第{i}项由安全员检查并通知质量检验部。同时悬挂警示牌。") for i in range(60)]
    rows = whole + [
        (100, q, None), (101, q, "……"), (102, q, "抱歉，无法提供关于氨制冷机房的信息。"), (103, q, "抱歉信号装置（APOLOGY灯）亮起时表示暂停使用。"), (104, q, q), (105, q, "您问的是：" + q),
        (106, q, "The operator must check the valve and the gauge before the shift ends."), (107, q, "第3项由安全员检查并通知质量检验部。同时悬"), (108, q, "每44天一次"), (109, q, "15.7 kV"), (110, None, "由安全员检查。"),
        (111, q, "关于“" + q + "”，由安全员检查并通知质量检验部。"), (112, q, "```\nx = 1"), (113, "Who signs?", "Die Arbeit ist sofort zu unterbrechen und der Meister zu verständigen."), (114, q, "第1项由安全员检查并通知质量检验部"),
    ]
    df = frame(spark, rows, "row_id bigint, question string, answer string", "defect string, k string")
    counts = pairs.count_tails(df.select("answer"))
    got = {r["rid"]: r["defect"] for r in pairs.defects(df, "row_id", "question", "answer", counts).collect()}
    assert got == {100: "empty", 101: "empty", 102: "refusal", 104: "copy", 105: "copy", 106: "language", 107: "truncated", 112: "truncated", 113: "language"}
    assert pairs.defects(df.where("false"), "row_id", "question", "answer", counts).count() == 0


@pytest.mark.parametrize("text, left", [('"the valve must be', ['"']), ('"the valve" must', []), ('a 5" pipe', []), ("<b>the valve", ["<b>"]), ("<ul><li>one</ul> two", []), ("line<br>next", []), ("see <a href", ["<"]), ("p < 3", []), ("（甲【乙】", ["（"]), ("1) one (2) two", [])])
def test_open_constructs(text, left):
    assert pairs.open_constructs(text) == left


def test_long_refusals_and_long_pairs(spark):
    q = "在中控室进行高处作业前，承包商代表应当确认哪些事项？"
    long = "抱歉，我无法回答这个问题。" + "该问题涉及的内容需要由专业人员结合现场情况判断。" * 22
    assert len(long) > 494 and pairs.defect_of(q, long, np.zeros(2 << pairs.BITS, dtype=np.int64)) == "refusal"
    import time

    text = "".join(chr(0x4E00 + i % 3000) for i in range(4000))
    began = time.time()
    assert pairs.is_copy(text, text) and not pairs.is_copy(text, text[::-1])
    assert time.time() - began < 2


@settings(max_examples=50, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_tiles_stay_inside(q, a):
    outside, covered = pairs.tile(q, a)
    assert 0 <= outside <= len(a) and 0 <= covered <= len(q)
    assert pairs.tile(q, q) == ((0, len(q)) if len(q) >= 3 else (len(q), 0))


# 8 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [1, 2])
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randint(0, 60), rng.randint(60, 400), 250, 511)) for _ in range(700)] + [1200, 2047, 5000]
    docs = frame(spark, [(i, "x" * n) for i, n in enumerate(sizes)] + [(9000, None), (9001, "字" * 700)], "doc_id bigint, text string", "part string, size string, container string, rank string")
    rows = packing.pack(docs, "doc_id", "text", 512, 12).collect()
    load = Counter()
    tokens = Counter()
    for r in rows:
        load[r["container"]] += r["size"]
        tokens[r["doc"]] += r["size"]
    assert max(load.values()) <= 512 and set(tokens) == {*range(len(sizes)), 9000, 9001}
    split_docs = {r["doc"] for r in rows if r["part"] > 0}
    assert split_docs == {i for i, n in enumerate(sizes) if n + 1 > 512} | {9001}
    parts = Counter(r["doc"] for r in rows)
    assert all(tokens[i] == n + parts[i] for i, n in enumerate(sizes)) and len({(r["doc"], r["part"]) for r in rows}) == len(rows)
    assert sum(load.values()) / (512 * len(load)) > 0.93
    assert packing.pack(docs.where("false"), "doc_id", "text").count() == 0


def test_whole_containers(spark):
    got = queries.p8_whole(spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else None
    assert got is None or got.first()["overfull"] == 0


# 9 -----------------------------------------------------------------------------------------------------------------
ITEM = "学徒甲第66次跟师傅去气瓶库学习受限空间作业，有人用导静电装置顶住门扇，外面的设备管理员推了89次。据此推断起重钢丝绳的失效概率属于哪一档。"


def test_passages_of_many_repeats():
    item = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    assert leakage.passages(item, (item[:15] + "龘" + item[16:] + "龘靐齉") * 100) == [(0, 30)]


def test_leaks(spark):
    other = ITEM.replace("气瓶库", "卸料平台").replace("66", "31").replace("导静电装置", "灭火器").replace("设备管理员", "焊工").replace("89", "12").replace("起重钢丝绳", "叉车")
    rows = [(1, PROSE + ITEM + PROSE), (2, PROSE + ITEM[: len(ITEM) * 6 // 10] + PROSE), (3, PROSE + ITEM[:12] + PROSE), (4, PROSE + other), (5, None), (6, ""), (7, ITEM.replace("学习", "学 习\n").replace("门扇", "门户")), (8, PROSE * 400 + ITEM)]
    docs = frame(spark, rows, "doc_id bigint, text string", "item string, term string, pos string")
    items = spark.createDataFrame([(11, ITEM), (12, None), (13, "")], "item_id bigint, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 11), (2, 11), (7, 11), (8, 11)}
    assert leakage.leaks(docs.where("false"), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leakage.leaks(docs, "doc_id", "text", items.where("false"), "item_id", "text").count() == 0


def test_short_items_and_exhaustive_search(spark, monkeypatch):
    rng = random.Random(8)
    words = "氨 制冷 机房 班前 检查 安全 阀门 记录 报告 主管 每日 通风 报警 泄漏 检测".split()
    passage = lambda n: "".join(rng.choice(words) for _ in range(n))
    items = [(1, "氨制冷机房的安全阀门检"), (2, "Close the main valve at noon."), (3, "阀"), (4, passage(30)), (5, passage(40)), (6, "——")]
    rows = [(1, PROSE + "氨制冷机房的安全阀门检" + PROSE), (2, "Then close the main valve at noon, please."), (3, PROSE)]
    for i in range(10, 60):  # parts of items with single characters replaced
        t = rng.choice(items[3:5])[1]
        part = list(t[rng.randint(0, 10) : rng.randint(len(t) // 3, len(t))])
        for k in range(rng.randint(0, 9), len(part), rng.randint(4, 12)):
            part[k] = "龘"
        rows.append((i, passage(20) + "".join(part) + passage(20)))
    docs, held = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    pairs_of = lambda **k: {(r["doc"], r["item"]) for r in leakage.leaks(docs, "doc_id", "text", held, "item_id", "text", **k).collect()}
    exact = pairs_of(exhaustive=True)
    assert {(1, 1), (2, 2)} <= exact and len(exact) > 10 and pairs_of(exact=True) == exact
    assert pairs_of() <= exact and len(pairs_of()) >= 0.99 * len(exact)
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 100)
    assert pairs_of(exact=True) == exact


# 10 ----------------------------------------------------------------------------------------------------------------
SAMPLES = [(f"你这个{w}，连{t}都不会用", "abuse") for w in ("蠢货", "废物", "白痴") for t in ("叉车", "吊篮", "压力表")]
SAMPLES += [(f"{g}都是蛆虫，就不该让他们进{p}", "hate") for g in ("外地人", "乡下佬", "残废") for p in ("喷漆间", "锅炉房", "污水井")]
SAMPLES += [(f"下班来我房间，{w}到天亮，加群看{v}", "sexual") for w in ("裸聊", "约炮", "包夜") for v in ("裸照", "床戏", "无码片")]
SAMPLES += [(f"{p}的{t}由{w}检查，并通知质量检验部。", "none") for p in ("喷漆间", "锅炉房", "外地来厂") for t in ("叉车", "吊篮", "压力表") for w in ("焊工", "残疾人", "安全员")]


def test_abuse(spark):
    model = abuse.train(spark.createDataFrame(SAMPLES, "text string, label string"), "text", "label")
    docs = frame(spark, [(1, "a", PROSE + "\n你这个废·物，连灭火器都不会用\n" + PROSE), (2, "a", PROSE), (3, None, None), (4, "b", ""), (5, "b", "外地人都是蛆 虫，就不该让他们进中控室"), (6, "b", "外地人和残疾人由焊工检查，并通知质量检验部。")], "doc_id bigint, source string, text string", "score string")
    scored = abuse.scores(docs, "doc_id", "source", "text", model).cache()
    assert {(r["doc"], r["kind"]) for r in scored.where(F.col("score") >= abuse.THRESHOLD).collect()} == {(1, "abuse"), (5, "hate")}
    rate = {(r["source"], r["kind"]): (r["documents"], r["found"]) for r in abuse.rates(scored).collect()}
    assert rate["a", "abuse"] == (2, 1) and rate["b", "hate"] == (3, 1) and rate[None, "sexual"] == (1, 0)
    assert abuse.scores(docs.where("false"), "doc_id", "source", "text", model).count() == 0


def test_identity_terms_barely_matter(spark):
    model = abuse.Model([(t, k) for t, k in SAMPLES])
    neutral = model.documents([f"{g}凭巡检日志办理住宿，由焊工检查。" for g in ("外地人", "残疾人", "农民工", "乡下佬")])[:, 2].tolist()
    assert max(neutral) < 0.5 and max(neutral) - min(neutral) < 0.3


@pytest.mark.parametrize("given_text, plain", [("王·八·蛋", "王八蛋"), ("害 群 之 马", "害群之马"), ("p1ece 0f trash", "piece of trash"), ("m o r o n", "moron"), ("5 kPa", "5 kpa")])
def test_undisguise(given_text, plain):
    assert abuse.undisguise(given_text) == plain
