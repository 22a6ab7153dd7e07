"""Problem 5: statistics of each document's text, and whether it is prose, a list, a table or junk.

Statistics are counted per document (numpy and compiled patterns in Arrow batches) with the share of common character
pairs taken from the whole corpus. Exact ranks per language come from one range-partitioned sort of every page's values
of every statistic: each partition numbers its rows, offsets are the totals of the partitions before it. A profile of a
kind names statistics and, for each, a level; the level's quantile is the share of the language's pages at least as
unusual. A page meets a profile if none of its tails is larger than those of the levels (which is so if no value is more
usual than its level). Its outlier score for a profile combines the tails of all that sets the profile apart by their
geometric mean, as a mean of -ln; of all profiles it meets the one with the highest score gives the kind. Prose is what
meets none.

Defined results: null and blank texts have no statistics and no kind; ties share one rank (the tail includes them);
a language with few documents has exact ranks too, over those documents; of equal scores the first profile counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq.common import materialise
from strataq.llm import lm
from strataq.llm.mojibake import USUAL

_END = re.compile(r"[。；！？.!?;…：:][\"”’）)\]]?[ \t]*(?:\n|\Z)")
_MARKER = re.compile(r"(?m)^[ \t　]*(?:[（(〔]?[一二三四五六七八九十百]+[)）、.．]|[（(]?\d{1,3}(?:[.．]\d{1,3})*[)）、.．:]?[ \t　]|[（(]?\d{1,3}[)）、.．](?!\d)|[（(]?[a-zA-Z]{1,4}[)）.]|[□■●◆▲※○★·•▪◦*–—①-⑳>»☐-])[ \t　]*[^\s|][^\n|]*$")
_DOTS = re.compile(r"(?m)(?:\.{3,}|…+|(?:\. ?\.? ?){3,}|·{3,}|_{3,}|\t+)[ \t]*\d+[ \t]*$")
_CELLS = re.compile(r"(?m)^(?:[^\n|]*\|[^\n|]*\|[^\n]*|[^\n\t]*\t[^\n]*|[^\n]*\S {3,}\S[^\n]*)$")
_VALUE = re.compile(r"(?m)^[ \t]*(?:[+±-]?\d[\d.,:/-]*|[—–/-]|[A-Za-zμΩ℃°/³²%]{1,6}|[待查合格不]{2,3})[ \t]*$")
_LATIN = re.compile(r"\b[A-Za-zÀ-ɏ][a-zà-ɏ]+\b")
_LONG_WORD = re.compile(r"\S{30,}")
_SYMBOL = re.compile(r"[^\w\s，。；：！？、（）,.;:!?()\"'“”‘’%℃°±³²/-]")
_USUAL = np.zeros(0x10001, dtype=bool)
for _c in USUAL:
    _USUAL[ord(_c)] = True

STATS = ("n_chars", "n_words", "n_lines", "mean_word", "symbol_ratio", "end_share", "common_share", "sentence_rate", "item_share", "cell_share", "value_share", "variety", "odd_share", "letter_share", "layout", "lead")
#: profile: kind, and its statistics with the level and +1 if large values are the unusual ones, -1 if small ones are.
PROFILES = {
    "repeats": ("junk", {"variety": (-1, 0.12)}),
    "odd signs": ("junk", {"odd_share": (1, 0.251)}),
    "unknown pairs": ("junk", {"common_share": (-1, 0.499)}),
    "symbols": ("junk", {"sentence_rate": (-1, 0.3), "symbol_ratio": (1, 0.4)}),
    "long words": ("junk", {"sentence_rate": (-1, 0.3), "mean_word": (1, 20.0)}),
    "items": ("list", {"sentence_rate": (-1, 0.3), "item_share": (1, 0.6), "lead": (1, 0.0)}),
    "cells": ("table", {"sentence_rate": (-1, 0.3), "cell_share": (1, 0.5), "lead": (-1, -1e-9)}),
    "fragments": ("junk", {"sentence_rate": (-1, 0.3), "letter_share": (-1, 0.35), "layout": (-1, 0.6)}),
}
KINDS = ("list", "table", "junk")
#: What most profiles share; it can't tell them apart, so it has to be met but isn't scored.
GATE = "sentence_rate"


def _column_purity(lines: list[str]) -> float:
    """How much better last characters agree down columns of one cell a line (best of 2 to 7) than over all lines."""
    sig = ["9" if x[-1].isdigit() else x[-1] for x in lines]
    share = lambda part: max(part.count(s) for s in set(part)) / len(part) if part else 0.0
    whole, best = share(sig), 0.0
    for k in range(2, 8):
        if len(lines) % k == 0 and len(lines) >= 4 * k:
            body = sig[k:]
            best = max(best, sum(share(body[i::k]) for i in range(k)) / k)
    return best - whole


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the texts, a NUL after each; where each starts, and its length."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return lm.codes("\x00".join(texts) + "\x00"), np.cumsum(sizes + 1) - sizes - 1, sizes


#: Characters of texts that are counted at once.
BLOCK = 1 << 20


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _members(pattern: re.Pattern) -> np.ndarray:
    """Which code points below 0x10000 are matched by the pattern of one character; a last False for the others."""
    out = np.zeros(0x10001, dtype=bool)
    out[[m.start() for m in pattern.finditer("".join(map(chr, range(0x10000))))]] = True
    return out


_IS_SPACE, _IS_SYMBOL = _members(re.compile(r"\s")), _members(_SYMBOL)


def _within(mask: np.ndarray, by: int) -> np.ndarray:
    """mask moved by so many places to the right, or to the left if negative."""
    out = np.zeros_like(mask)
    if by > 0:
        out[by:] = mask[:-by]
    else:
        out[:by] = mask[-by:]
    return out


def _sentences(c: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where sentences end: a full-width mark after five characters without a break, an ASCII mark straight after a word.

    Five with the mark; the ASCII mark comes before a space, a quotation mark, a bracket or the end. Texts as flat() gives them.
    """
    wide = (c == 0x3002) | (c == 0xFF01) | (c == 0xFF1F) | (c == 0xFF1B)
    stop = wide | (c == 10)
    out = wide.copy()
    for k in range(1, 5):
        out &= ~_within(stop, k)
    lower = (c >= 97) & (c <= 122)
    end = np.zeros(len(c), dtype=bool)
    end[starts + sizes] = True
    after = _IS_SPACE[np.minimum(c, 0x10000)] | (c == 34) | (c == 0x201D) | (c == 41) | (c == 0x2019) | end
    out |= ((c == 46) | (c == 33) | (c == 63)) & _within(lower, 1) & _within(lower, 2) & _within(after, -1)
    for k in range(4):  # four characters have to stand before a wide mark
        at = (starts + k)[sizes > k]
        out[at] &= ~wide[at]
    return out


def prose_flags(texts: list[str]) -> np.ndarray:
    """Whether each text has sentences enough, and few unusual characters."""
    out = []
    for part in blocks(texts):
        c, starts, sizes = flat(part)
        marks = np.add.reduceat(_sentences(c, starts, sizes).astype(np.int64), starts)
        odd = np.add.reduceat((~_USUAL[np.minimum(c, 0x10000)]).astype(np.int64), starts) - 1  # the NUL after each
        out.append((sizes > 0) & (marks * 100 >= 0.3 * sizes) & (odd / np.maximum(sizes, 1) <= 0.25))
    return np.concatenate(out) if out else np.zeros(0, dtype=bool)


def _words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a word or number starts, and the characters of words and numbers; a number takes one point and the digits after it."""
    letter = (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122) | (c >= 0xC0) & (c <= 0x24F) | (c >= 0x400) & (c <= 0x4FF)
    digit = (c >= 48) & (c <= 57)
    begins, inside = letter & ~_within(letter, 1), letter | digit
    runs = np.flatnonzero(digit & ~_within(digit, 1))
    if len(runs):
        ends = np.flatnonzero(digit & ~_within(digit, -1)) + 1
        linked = np.append(False, (c[ends[:-1]] == 46) & (ends[:-1] + 1 == runs[1:]))
        i = np.arange(len(runs))
        second = (i - np.maximum.accumulate(np.where(linked, 0, i))) % 2 == 1
        begins[runs[~second]] = True
        inside[runs[second] - 1] = True
    return begins, inside


def _counted(texts: list[str], common: np.ndarray) -> np.ndarray:
    """Per text: Han, kana, Cyrillic, unusual characters; pairs of two characters of words, and how many of them are common;
    words and numbers, and their characters; ends of sentences, symbols, letters of scripts without case or Cyrillic, Latin letters; variety."""
    if not texts:
        return np.zeros((0, 13))
    c, starts, sizes = flat(texts)
    a, b = c[:-1], c[1:]
    digits = (a >= 48) & (a < 58) & (b >= 46) & (b < 58)
    inner = (a > 32) & (b > 32) & ~digits
    seen = inner & common[lm.pair_bucket(a, b).astype(np.int64)]
    pad = lambda x: np.append(x, False)
    low = np.minimum(c, 0x10000)
    odd = ~_USUAL[low] & (c != 0)
    begins, inside = _words(c)
    han, kana, cyrillic = (c >= 0x3400) & (c <= 0x9FFF), (c >= 0x3040) & (c < 0x3100), (c >= 0x400) & (c < 0x500)
    latin = (c >= 65) & (c <= 90) | (c >= 97) & (c <= 122) | (c >= 0xC0) & (c <= 0x24F)
    symbol = _IS_SYMBOL[low]
    for i in np.flatnonzero(c > 0xFFFF):
        symbol[i] = bool(_SYMBOL.match(chr(c[i])))
    symbol[starts + sizes] = False  # the NUL after each
    masks = (han, kana, cyrillic, odd, pad(inner), pad(seen), begins, inside, _sentences(c, starts, sizes), symbol, han | kana | cyrillic, latin)
    return np.column_stack([*(np.add.reduceat(m.astype(np.int64), starts) for m in masks), _varieties(c, starts, sizes)])


#: Characters of a window within which pairs are compared, and the pairs that make a window fully varied.
WINDOW, VARIED = 400, 120


def _varieties(c: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct adjacent pairs over the pairs there are (VARIED at most), as the mean of all windows of each text."""
    windows = np.maximum(1, -(-(sizes - 1) // WINDOW))
    base = np.cumsum(windows) - windows
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    i = np.arange(len(c)) - starts[text]
    pair = np.flatnonzero(i < sizes[text] - 1)
    key = (base[text[pair]] + i[pair] // WINDOW) << 42 | c[pair].astype(np.int64) << 21 | c[pair + 1]
    key.sort()
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] if len(key) else key) >> 42, minlength=int(windows.sum()))
    of = np.repeat(np.arange(len(sizes)), windows)
    at = (np.arange(len(of)) - base[of]) * WINDOW
    length = np.minimum(WINDOW + 1, sizes[of] - at)
    keep = (at == 0) | (length >= WINDOW // 4)  # others are too short to say anything by themselves
    share = np.minimum(1.0, np.maximum(1, distinct) / np.maximum(1, np.minimum(length - 1, VARIED)))
    return np.bincount(of[keep], share[keep]) / np.bincount(of[keep])


def _variety(text: str) -> float:
    return float(_varieties(*flat([text]))[0])


def statistics(text: str, common: np.ndarray, counted: np.ndarray | None = None) -> tuple:
    """lang and the statistics of a non-blank text, in the order of STATS; counted: its row of _counted."""
    *counts, variety = (_counted([text], common)[0] if counted is None else counted).tolist()
    han, kana, cyrillic, odd, inner, seen, n_latin, latin, sentences, symbols, letters, cased = map(int, counts)
    n = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    k = max(1, len(lines))
    lang = "ja" if kana * 4 > han and kana else "zh" if han * 3 >= latin and han else "ru" if cyrillic * 2 > latin else "en"
    n_words = n_latin + han + kana
    share = seen / inner if inner else 0.0
    items = len(_MARKER.findall(text)) if k > 1 else 0  # one line is no list
    dots = len(_DOTS.findall(text)) if ".." in text or "……" in text or ". ." in text or "\t" in text else 0
    cells = len(_CELLS.findall(text)) if sentences * 60 < n else sum(x.count("|") > 1 for x in lines) if "|" in text else 0
    if sentences * 100 < n and cells * 2 < k and k >= 3:  # one count of separators down the page
        for each in ([x.count(",") - x.count(", ") for x in lines], [x.count(";") + x.count("；") for x in lines]):
            top = max(set(each), key=each.count) if each else 0
            if top and each.count(top) >= 0.8 * k:
                cells = each.count(top)
    values = len(_VALUE.findall(text))
    if sentences * 100 < n and max(items, dots) * 2 < k:
        # Lines without marks: cells one below the other, or items of a list.
        if cells * 2 < k and sum(len(x) <= 40 for x in lines) * 10 >= k * 8 and k >= 4:
            if values * 100 >= 8 * k or k >= 8 and _column_purity([x.strip() for x in lines]) > 0.35:
                cells = k
            else:
                items = k
    mean_word = (latin + han + kana) / max(1, n_words)
    if n_words < 3 or not han and _LONG_WORD.search(text):
        mean_word = max(mean_word, n / max(1, len(text.split())))
    solid = max(1, n - text.count(" ") - text.count("\n") - text.count("\t"))
    letters = (letters + (sum(map(len, _LATIN.findall(text))) if cased else 0)) / solid
    item_share, cell_share = min(1.0, max(items, dots) / k), min(1.0, cells / k)
    return (lang, float(n), float(n_words), float(len(lines)), mean_word, symbols / n, len(_END.findall(text)) / k, share, 100.0 * sentences / n,
            item_share, cell_share, values / k, variety, odd / n, min(1.0, letters), max(item_share, cell_share), item_share - cell_share)


def common_pairs(counts: np.ndarray) -> np.ndarray:
    """Which pair buckets are common: above the share of 2 in a million pairs, and seen more than twice."""
    pairs = counts[: 1 << lm.PAIR_BITS]
    return pairs > max(2, 2e-6 * pairs.sum())


def measure(df: DataFrame, id_col: str, text_col: str, counts: np.ndarray | None = None) -> DataFrame:
    """(rid, lang, the statistics of STATS) of every non-blank text."""
    common = common_pairs(lm.count_corpus(df, [text_col]) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t and not t.isspace()]
            rows = [statistics(t, common, row) for part in blocks([texts[i] for i in keep]) for t, row in zip(part, _counted(part, common))]
            cols = [pa.array([r[0] for r in rows], pa.string())] + [pa.array([r[j + 1] for r in rows], pa.float64()) for j in range(len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *cols], names=["rid", "lang", *STATS])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("rid"), text_col).mapInArrow(run, f"rid {id_type}, lang string, " + ", ".join(f"{s} double" for s in STATS))


#: The most usual value a bounded statistic can have, with its sign: all documents are at least as unusual, so its tail is 1.
_BOUND = {("variety", -1): -1.0, ("odd_share", 1): 0.0, ("common_share", -1): -1.0, ("symbol_ratio", 1): 0.0, ("item_share", 1): 0.0, ("cell_share", 1): 0.0, ("letter_share", -1): -1.0, ("layout", -1): -1.0}


def _levels() -> dict[tuple[str, int], float]:
    """(statistic, sign) of all profiles: the least value * sign that is sorted; below lie only values whose tail is 1."""
    return {(s, sign): float(np.nextafter(_BOUND[s, sign], np.inf)) if (s, sign) in _BOUND else -np.inf for _, stats in PROFILES.values() for s, (sign, _) in stats.items()}


def _name(stat: str, sign: int) -> str:
    return ("+" if sign > 0 else "-") + stat


def _under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows in order of stat, lang and value how many rows of the partition with that stat and lang have a smaller value."""
    key, value, count, under = None, 0.0, 0, 0  # of the last row; rows of its key so far, and those below its value
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        lang = b.column(1).dictionary_encode()
        stat, code, v = b.column(0).to_numpy(), lang.indices.to_numpy(), b.column(2).to_numpy()
        names = lang.dictionary.to_pylist()
        new_key = np.append(True, (stat[1:] != stat[:-1]) | (code[1:] != code[:-1]))
        new_run = new_key | np.append(True, v[1:] != v[:-1])
        at = np.arange(n)
        out = np.maximum.accumulate(np.where(new_run, at, 0)) - np.maximum.accumulate(np.where(new_key, at, 0))
        if (stat[0], names[code[0]]) == key:  # the key of the batch before goes on
            same = np.cumsum(new_key) == 1
            out[same] += count
            if v[0] == value:
                out[np.cumsum(new_run) == 1] = under
        else:
            count = 0
        start = int(np.flatnonzero(new_key)[-1])
        count, key, value, under = (count if start == 0 else 0) + n - start, (stat[-1], names[code[-1]]), v[-1], int(out[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "under"])


def ranked(stats: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(stat, lang, value, the columns carried, tail) of every document and statistic: the exact share of the language's documents at least as unusual.

    stat is the number in _levels(), value is multiplied by the sign. One sort by ranges of (stat, lang, value, rid), so
    that a value that most documents share is spread over partitions; offsets are the totals of the partitions before,
    and a value that runs over several partitions starts where it does in the first of them.
    """
    each = F.array_compact(F.array(*[F.when(F.col(s) * sign >= least, F.struct(F.lit(i).alias("stat"), (F.col(s) * sign + 0.0).alias("value"))) for i, ((s, sign), least) in enumerate(_levels().items())]))  # no negative zero
    rows = stats.select("lang", "rid", *carried, F.explode(each).alias("x")).select("x.stat", "lang", "x.value", "rid", *carried)
    order = ["stat", "lang", "value", "rid"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    placed = materialise(sorted_rows.mapInArrow(_under, shape + ", under bigint"))
    # A row for each statistic, language and partition.
    edges = materialise(placed.groupBy("stat", "lang", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("under").alias("hi_under")))
    group = W.partitionBy("stat", "lang")
    edges = edges.withColumn("before", F.sum("n").over(group.orderBy("part")) - F.col("n")).withColumn("of", F.sum("n").over(group))
    ends = edges.select("stat", "lang", F.col("hi").alias("lo"), F.col("part").alias("earlier"), (F.col("before") + F.col("hi_under")).alias("start"))
    spans = edges.join(ends, ["stat", "lang", "lo"]).where("earlier < part").groupBy("stat", "lang", "part").agg(F.min("start").alias("start"))
    docs = stats.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))  # one row a language
    known = edges.select("stat", "lang", "part", "lo", "before", "of").join(F.broadcast(spans), ["stat", "lang", "part"], "left").join(F.broadcast(docs), "lang")
    below = F.when(F.col("value") == F.col("lo"), F.coalesce("start", "before")).otherwise(F.col("before") + F.col("under"))
    return placed.join(F.broadcast(known), ["stat", "lang", "part"]).select("stat", "lang", "value", "rid", *carried, ((F.col("of") - below) / F.col("docs")).alias("tail"))


def tail_table(stats: DataFrame) -> DataFrame:
    """(stat, lang, value, tail): exact share of the language's documents at least as unusual as value, for every value there is.

    stat has its sign before it, and value is multiplied by the sign. The most usual value possible has no row: its tail is 1.
    """
    names = F.array(*[F.lit(_name(s, sign)) for s, sign in _levels()])
    return ranked(stats).select(F.get(names, F.col("stat")).alias("stat"), "lang", "value", "tail").distinct()


def scores(stats: DataFrame, every: bool = False) -> DataFrame:
    """(rid, score_list, score_table, score_junk, kind) of the documents that meet a profile, or of all; stats is materialised.

    A profile's score is the mean of -ln tail over the statistics that set it apart (the geometric mean of its tails, so
    that none is favoured for having more of them); a kind's is the best of its profiles. Of the profiles a document
    meets, the one with the best score gives the kind.
    """
    number = {key: i for i, key in enumerate(_levels())}
    met = F.lit(0)
    for p, (_, needs) in enumerate(PROFILES.values()):
        ok = F.lit(True)
        for stat, (sign, level) in needs.items():
            ok = ok & (F.col(stat) * sign >= sign * level)
        met = met + F.when(ok, 1 << p).otherwise(0)
    marked = stats.withColumn("met", met)
    tails = ranked(marked, ("met",))
    if not every:  # the ranks count all documents; those that meet no profile have no kind
        tails = tails.where("met > 0")
    u, score = -F.log("tail"), {}
    for p, (name, (_, needs)) in enumerate(PROFILES.items()):
        own = [number[s, sign] for s, (sign, _) in needs.items() if s != GATE]
        score[name] = (F.sum(F.when(F.col("stat").isin(own), u).otherwise(0.0)) / len(own)).alias(f"p{p}")
    each = tails.groupBy("rid", "met").agg(*score.values())
    best = F.array_max(F.array(*[F.when(F.col("met").bitwiseAND(1 << p) > 0, F.struct(F.col(f"p{p}").alias("score"), F.lit(-p).alias("no"), F.lit(kind).alias("kind"))) for p, (kind, _) in enumerate(PROFILES.values())]))
    of_kind = [F.greatest(F.lit(0.0), *[F.col(f"p{p}") for p, (kind, _) in enumerate(PROFILES.values()) if kind == k]).alias(f"score_{k}") for k in KINDS]
    return each.select("rid", *of_kind, best["kind"].alias("kind"))


def kinds(df: DataFrame, id_col: str, text_col: str, counts: np.ndarray | None = None) -> DataFrame:
    """(rid, lang, statistics, score_list, score_table, score_junk, kind) of every non-blank text; a page without an unusual value has scores of 0."""
    stats = materialise(measure(df, id_col, text_col, counts))
    joined = stats.join(scores(stats, every=True), "rid", "left")
    return joined.select(*stats.columns, *[F.coalesce(f"score_{k}", F.lit(0.0)).alias(f"score_{k}") for k in KINDS], F.coalesce("kind", F.lit("prose")).alias("kind"))


def found(df: DataFrame, id_col: str, text_col: str, counts: np.ndarray | None = None) -> DataFrame:
    """(rid, kind) of the texts that aren't prose."""
    return scores(materialise(measure(df, id_col, text_col, counts))).select("rid", "kind")
