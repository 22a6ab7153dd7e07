"""Problem 1: text that looks the same but differs in its characters, brought to one form.

Texts are cut into segments; only segments with an odd character are exploded to positioned code points, which are
joined (broadcast: a few thousand rows made from the Unicode database, whatever the input) with the decomposition and
look-alike mappings. Every letter of such a segment is decomposed in full; combining marks are put in canonical order by
class and recomposed step by step with the primary composites (syllables of jamo by their arithmetic), and strings are
rebuilt from segments. Everything else is its own normal form and passes by untouched, so the result covers the whole text.

Defined results: null entries are no cases and stay null; a word wholly in another alphabet stays as it is, a Greek or
Cyrillic look-alike inside a word with Latin letters (or of both alphabets) is replaced; unit and list signs, dashes
and full-width punctuation stay. Repeated entries are each reported.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq.common import materialise

# Greek and Cyrillic letters that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "АВЕЅІЈКМНОРСТХаеорсухіѕјһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον",
    "ABESIJKMHOPCTXaeopcyxisjhdqw" "ABEZHIKMNOPTYXov",
))
# Armenian and Cherokee letters, and Latin letters of other use, that look like usual Latin ones.
ARMENIAN = dict(zip("ՕՍՏԼօսոհց", "OUSLounhg"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃᎡ", "ABCDEGHiJKLMPSTVWZR"))
LATIN_ALIKE = dict(zip("ɑɡıʟ", "agiL"))
# Simplified CJK radicals that the Unicode database leaves without a mapping.
RADICALS = dict(zip("⻅⻆⻉⻋⻌⻓⻔⻘⻙⻚⻛⻜⻝⻢⻥⻦⻧⻨⻩⻬⻮⻰⻳⺟⺠⺩⺫⺬⺮⺳⺶⺼⺾⻁⻄⻊⻗", "见角贝车辶长门青韦页风飞食马鱼鸟卤麦黄齐齿龙龟母民王目示竹网羊肉艹虎西足雨"))
# Signs that are usual here although the database has a compatibility form for them, and hyphens.
USUAL_SIGNS = set("℃℉№℡™Ωμ³²¹±℅㎡㎏㎜㎝㎞㏄％＋＝＜＞～｜＃＆＠＊＄")
HYPHENS = "‐‑‒−﹣－"
_INVISIBLE = [0xAD, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
_RANGES = [(0xA0, 0xA0), (0xAD, 0xAD), (0xB5, 0xB5), (0x2B0, 0x2FF), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x52F), (0x61C, 0x61C), (0x115F, 0x1160), (0x1F00, 0x1FFF), (0x1680, 0x1680), (0x17B4, 0x17B5), (0x180E, 0x180E), (0x2000, 0x2012), (0x202A, 0x202F), (0x205F, 0x206F), (0x20D0, 0x20FF), (0x2100, 0x214F), (0x2212, 0x2212), (0x24B6, 0x24E9), (0x2E80, 0x2FDF), (0x3000, 0x3000), (0x3164, 0x3164), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0x132, 0x133), (0x13F, 0x140), (0x149, 0x149), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x531, 0x586), (0x13A0, 0x13F5), (0xFB13, 0xFB4F), (0xFB50, 0xFDFF), (0xFE50, 0xFE62), (0xFE70, 0xFEFC), (0xFF66, 0xFFDC), (0x1F130, 0x1F149), (0xFE00, 0xFE0F), (0xFE63, 0xFE63), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0xFFA0, 0xFFA0), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F)]
_FULL_PUNCTUATION = set("！（），：；？［］｛｝＂＇｀＾＿＼")


_FOREIGN = {"greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),), "armenian": ((0x531, 0x586),), "cherokee": ((0x13A0, 0x13F5),)}
#: Vowels and finals of conjoining jamo follow their consonant like marks; their classes only keep them in order.
_VOWELS, _FINALS = range(0x1161, 0x1176), range(0x11A8, 0x11C3)


def combining(c: str) -> int:
    return 301 if ord(c) in _VOWELS else 302 if ord(c) in _FINALS else unicodedata.combining(c)


def mappings() -> list[tuple[int, str, str]]:
    """(code point, kind, target) by rule from the Unicode database; targets are decomposed where a mark may follow them."""
    alike = HOMOGLYPHS | ARMENIAN | CHEROKEE
    cps = {cp for lo, hi in _RANGES for cp in range(lo, hi + 1)}
    every = range(0xA0, 0x20000)
    cps |= {cp for cp in every if not 0xD800 <= cp < 0xE000 and unicodedata.normalize("NFC", chr(cp)) != chr(cp)} | {cp for cp in every if combining(chr(cp))} | {ord(c) for c in LATIN_ALIKE}
    rows = []
    for cp in sorted(cps):
        c = chr(cp)
        if c in USUAL_SIGNS or c in _FULL_PUNCTUATION:
            continue
        flat = unicodedata.normalize("NFKC", c)
        foreign = next((k for k, spans in _FOREIGN.items() if any(lo <= cp <= hi for lo, hi in spans)), "")
        letters = "".join(alike.get(x, x) for x in unicodedata.normalize("NFD", c))
        if cp in _INVISIBLE:
            rows.append((cp, "drop", ""))
        elif unicodedata.category(c) == "Zs":
            rows.append((cp, "space", " "))
        elif c in HYPHENS:
            rows.append((cp, "hyphen", "-"))
        elif combining(c):
            rows.append((cp, "mark", unicodedata.normalize("NFD", c)))
        elif c in RADICALS:
            rows.append((cp, "map", RADICALS[c]))
        elif c in LATIN_ALIKE:
            rows.append((cp, "map", LATIN_ALIKE[c]))
        elif foreign:
            rows.append((cp, foreign, unicodedata.normalize("NFC", letters) if letters[0] < "ɐ" else ""))
        elif flat != c:
            rows.append((cp, "map", {"µ": "μ"}.get(c, flat)))
    return rows


def decompositions() -> list[tuple[int, str]]:
    """Precomposed letters and what they are made of; usual as they stand, but a mark that follows has to find its place."""
    return [(cp, d) for cp in range(0xC0, 0x20000) if not 0xAC00 <= cp < 0xE000 for d in (unicodedata.normalize("NFD", chr(cp)),) if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(cp)]


def composites() -> dict[str, str]:
    """Primary composites: a starter and one mark, and the letter they make."""
    out = {}
    for cp, _ in decompositions():
        pair = "".join(chr(int(x, 16)) for x in unicodedata.decomposition(chr(cp)).split())
        if len(pair) == 2:
            out[pair] = chr(cp)
    return out


def _escape(lo: int, hi: int) -> str:
    return rf"\x{{{lo:X}}}-\x{{{hi:X}}}"


def _odd_class() -> str:
    """Java class of the characters that have a mapping."""
    cps = sorted(m[0] for m in mappings())
    runs, start = [], cps[0]
    for a, b in zip(cps, [*cps[1:], 1 << 30]):
        if b != a + 1:
            runs.append(_escape(start, a))
            start = b
    return "".join(runs)


#: The first test is cheap and fails for nearly every character.
ODD = "(?=[^\\x00-\\x7f\\x{4E00}-\\x{9FFF}\\x{FF0C}\\x{3001}\\x{3002}\\x{FF08}\\x{FF09}])[" + _odd_class() + "]"
#: Words: runs of anything but ASCII non-letters, Han, and full-width marks.
_PLAIN = "\\x00-@\\x{5B}-`{-\\x9f\\x{3001}-\\x{303F}\\x{3400}-\\x{9FFF}\\x{FF01}\\x{FF08}\\x{FF09}\\x{FF0C}\\x{FF1A}\\x{FF1B}\\x{FF1F}"
_WORD = f"[^{_PLAIN}]+"
_CUT = f"(?<=[{_PLAIN}])(?=[^{_PLAIN}])|(?<=[^{_PLAIN}])(?=[{_PLAIN}])"


#: A class of characters of 16 bits is a table lookup in Python; the others are a second, rare test.
_PYTHON_ODD = re.compile("[" + "".join(re.escape(chr(m[0])) for m in mappings() if m[0] < 0x10000) + "]")
_ASTRAL_ODD = frozenset(chr(m[0]) for m in mappings() if m[0] >= 0x10000)
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _is_odd(text: str | None) -> bool:
    return text is not None and not text.isascii() and (_PYTHON_ODD.search(text) is not None or any(c in _ASTRAL_ODD for c in _ASTRAL.findall(text)))


def odd_rows(df: DataFrame, text_col: str, odd: bool = True) -> DataFrame:
    """The rows whose text holds a character with a mapping (or those whose text holds none); one scan in Arrow batches (a Java class of so many ranges is slow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([_is_odd(t) == odd for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _parts(text: str) -> list[tuple[str, int]]:
    return [(c, combining(c)) for c in unicodedata.normalize("NFD", text) if not 0xAC00 <= ord(c) < 0xD7A4] if text else []


def _table(spark: SparkSession) -> DataFrame:
    """(cp, kind, target, own, parts): kind 'letter' are precomposed ones; own and parts are the decomposed character and target."""
    named = {cp: (kind, target) for cp, kind, target in mappings()}
    rows = [(cp, kind, target, _parts(chr(cp)), _parts(target)) for cp, (kind, target) in named.items()]
    rows += [(cp, "letter", chr(cp), _parts(chr(cp)), _parts(chr(cp))) for cp, _ in decompositions() if cp not in named]
    return F.broadcast(spark.createDataFrame(rows, "cp int, kind string, target string, own array<struct<c: string, ccc: int>>, parts array<struct<c: string, ccc: int>>"))


def _segments(entries: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return entries.where(F.col(text_col).rlike(ODD)).select(*keys, F.posexplode(F.split(text_col, _CUT)).alias("seg_no", "seg"))


def _words(entries: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return entries.where(F.col(text_col).rlike(ODD)).select(*keys, F.posexplode(F.regexp_extract_all(text_col, F.lit(_WORD), F.lit(0))).alias("seg_no", "seg"))


def code_points(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Positioned code points of the odd segments, each with what it becomes, decomposed (`to`), and whether it changed."""
    mapping = _table(segments.sparkSession)
    at = [*keys, "seg_no"]
    odd = segments.where(F.col("seg").rlike(ODD))
    # split on "" gives UTF-16 units in Java; code points come from a regular expression
    points = odd.select(*at, F.posexplode(F.regexp_extract_all("seg", F.lit("(?s)."), F.lit(0))).alias("i", "ch"))
    points = points.withColumn("cp", F.when(F.length("ch") == 1, F.expr("conv(hex(encode(ch, 'UTF-32')), 16, 10)").cast("int")))
    joined = points.join(mapping, "cp", "left")
    w = W.partitionBy(*at).orderBy("i")
    word = F.sum(F.when(F.col("kind").isin("space", "hyphen"), 1).otherwise(0)).over(w)
    joined = joined.withColumn("word", word)
    whole = W.partitionBy(*at, "word")
    base = F.coalesce(F.try_element_at("own", F.lit(1))["c"], F.col("ch"))  # of a precomposed letter
    latin = F.max(base.rlike("[A-Za-zÀ-ɏ]") | ((F.col("kind") == "map") & F.col("target").rlike("[A-Za-z]"))).over(whole)
    alphabets = reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("kind") == k, 1)).over(whole), F.lit(0)) for k in _FOREIGN])
    foreign = F.col("kind").isin(*_FOREIGN)
    swap = foreign & (F.col("target") != "") & (F.coalesce(latin, F.lit(False)) | (alphabets > 1))
    to = F.when(F.col("kind").isNull(), F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))).when(foreign & ~swap, F.col("own")).otherwise(F.col("parts"))
    changed = F.col("kind").isin("drop", "space", "hyphen", "map", "mark") | F.coalesce(swap, F.lit(False))
    return joined.select(*at, "i", to.alias("to"), F.coalesce(changed, F.lit(False)).alias("changed"))


def _composed(cluster: Column) -> Column:
    """A starter and its marks (structs with c and ccc) in canonical order, composed step by step; a mark is blocked by one of its class or a higher one."""
    table = F.from_json(F.lit(json.dumps(composites())), "map<string, string>")
    number = lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
    made = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    start = F.struct(F.lit("").alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        s = a["starter"]
        vowel = (x["ccc"] == 301) & s.rlike("^[\u1100-\u1112]$")
        final = (x["ccc"] == 302) & s.rlike("^[\uac00-\ud7a3]$") & ((F.when(s.rlike("^[\uac00-\ud7a3]$"), number(s)) - 0xAC00) % 28 == 0)
        one = F.when(vowel, made(0xAC00 + ((number(s) - 0x1100) * 21 + number(x["c"]) - 0x1161) * 28)).when(final, made(number(s) + number(x["c"]) - 0x11A7)).otherwise(F.try_element_at(table, F.concat(s, x["c"])))
        one = F.when((x["ccc"] > 0) & (a["rest"] == "") | (a["last"] < x["ccc"]), one)
        first = (s == "") & (a["rest"] == "")
        return F.struct(
            F.when(first, x["c"]).otherwise(F.coalesce(one, s)).alias("starter"),
            F.when(first | one.isNotNull(), a["rest"]).otherwise(F.concat(a["rest"], x["c"])).alias("rest"),
            F.when(first | one.isNotNull(), a["last"]).otherwise(x["ccc"]).alias("last"),
        )

    return F.when(F.size(cluster) == 1, cluster[0]["c"]).otherwise(F.aggregate(cluster, start, step, lambda a: F.concat(a["starter"], a["rest"])))


def find(entries: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Keys of the entries that hold an invisible or look-alike character."""
    return code_points(_words(entries, keys, text_col), keys).where("changed").select(*keys).distinct()


def normalise(entries: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, normal: every entry in the one consistent form. Only entries with an odd character are taken apart and move."""
    at = [*keys, "seg_no"]
    asked = entries.select(*keys, text_col)
    odd = materialise(odd_rows(asked, text_col))
    segments = _segments(odd, keys, text_col)
    flat = code_points(segments, keys).select(*at, "i", F.posexplode("to").alias("j", "x")).select(*at, "i", "j", "x.c", "x.ccc")
    cluster = F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(W.partitionBy(*at).orderBy("i", "j"))
    clusters = flat.withColumn("cl", cluster).groupBy(*at, "cl").agg(F.sort_array(F.collect_list(F.struct("ccc", "i", "j", "c"))).alias("cluster"))
    whole = clusters.select(*at, "cl", _composed(F.transform("cluster", lambda x: F.struct(x["c"].alias("c"), x["ccc"].alias("ccc")))).alias("out"))
    fixed = whole.groupBy(*at).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cl", "out"))), lambda x: x["out"]), "").alias("fixed"))
    joined = segments.join(fixed, at, "left").withColumn("fixed", F.when(F.col("seg").rlike(ODD), F.coalesce("fixed", F.lit(""))).otherwise(F.col("seg")))
    rebuilt = joined.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "fixed"))), lambda x: x["fixed"]), "").alias("normal"))
    return odd_rows(asked, text_col, odd=False).select(*keys, F.col(text_col).alias("normal")).unionByName(rebuilt)


def key_point_entries(eval_items: DataFrame) -> DataFrame:
    return eval_items.select(F.lit("eval_items").alias("table_name"), "row_id", F.posexplode("key_points").alias("pos", "txt"))


def page_entries(pages: DataFrame) -> DataFrame:
    return pages.select(F.lit("page_docs").alias("table_name"), "row_id", F.lit(-1).alias("pos"), F.col("page_content").alias("txt"))

