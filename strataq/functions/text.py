"""Scalar functions on text columns, all JVM-side. Null in gives null out unless a docstring says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataq import settings as S


def clean_text(t: Column) -> Column:
    """CRLF and CR to LF; three or more LF to two; each line stripped on the right; then the whole stripped."""
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"(?m)(?:(?!\n){S.WHITESPACE})+$", "")
    return strip(t)


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"^{S.WHITESPACE}+|{S.WHITESPACE}+$(?!\n)", "")


def without_space(t: Column) -> Column:
    return F.regexp_replace(t, S.WHITESPACE, "")


def cjk_ratio(t: Column) -> Column:
    """Han characters over non-white characters; 0 for null or blank."""
    n = F.length(without_space(t))
    return F.when(n > 0, F.regexp_count(t, F.lit("[一-鿿]")) / n).otherwise(0.0)


def is_garbled(t: Column, least: float = S.DEFAULT.quality.min_cjk_ratio) -> Column:
    """Null or blank, or a ratio strictly below `least`."""
    return F.coalesce(F.length(without_space(t)), F.lit(0)).eqNullSafe(0) | (cjk_ratio(t) < least)


def fragment_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(S.FRAGMENT))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(S.TOKEN), F.lit(0))


def sentences(t: Column) -> Column:
    """Sentences with their closing mark; empty pieces dropped."""
    return F.filter(F.regexp_extract_all(t, F.lit(S.SENTENCE), F.lit(0)), lambda s: s != "")


def section_title(t: Column) -> Column:
    """First title pattern, in order, found in the first 60 characters; else the first 24 of the first line."""
    head = F.regexp_replace(F.substring(t, 1, 60), "\n", " ")
    found = [F.nullif(F.regexp_extract(head, p, 0), F.lit("")) for p in S.TITLES]
    return F.coalesce(*found, F.substring(F.regexp_extract(t, r"^[^\n]*", 0), 1, 24))


def normalise_marks(t: Column) -> Column:
    """Without white space; full-width digits and listed marks half-width; dashes as hyphens."""
    t = F.translate(without_space(F.coalesce(t, F.lit(""))), "０１２３４５６７８９％（），；：！？", "0123456789%(),;:!?")
    return F.translate(t, "～－—‑–", "-----")


def number_of(run: Column) -> Column:
    """A run of Chinese numerals as digits: a unit multiplies the pending digit (or 1), a digit replaces it; 0 stays as it was."""
    plain = F.translate(run, "〇壹两贰叁肆伍陆柒捌玖", "零一二二三四五六七八九")
    unit = lambda c: F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).when(c == "万", 10000).when(c == "亿", 100000000).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("num"))

    def step(a: Column, c: Column) -> Column:
        u = unit(c)
        digit = (F.instr(F.lit("零一二三四五六七八九"), c) - 1).cast("bigint")
        return F.struct(F.when(u.isNull(), a["total"]).otherwise(a["total"] + F.greatest(a["num"], F.when(a["num"] == 0, F.lit(1).cast("bigint")).otherwise(a["num"])) * u).alias("total"), F.when(u.isNull(), digit).otherwise(F.lit(0).cast("bigint")).alias("num"))

    n = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), start, step, lambda a: a["total"] + a["num"])
    return F.when(n == 0, run).otherwise(n.cast("string"))


def normalise_for_match(t: Column) -> Column:
    """normalise_marks, then numeral runs (cut at 8) as digits where the next character is a counting unit; null as ''."""
    s = normalise_marks(t)
    parts = F.regexp_extract_all(s, F.lit(f"{S.NUMBER_RUN}|[^〇零一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖]+"), F.lit(0))
    runs = lambda p, i: F.when(p.rlike(f"^{S.NUMBER_RUN}$") & F.substring(F.coalesce(F.try_element_at(parts, i + 2), F.lit("")), 1, 1).rlike(f"[{S.UNIT_GATE}]"), number_of(p)).otherwise(p)
    return F.array_join(F.transform(parts, runs), "")


def point_hits(points: Column, text: Column) -> Column:
    """One flag per non-blank point: is its normalised form inside the (already normalised) text?"""
    kept = F.filter(points, lambda p: F.length(without_space(p)) > 0)
    return F.transform(kept, lambda p: text.contains(normalise_for_match(p)))


def coverage(points: Column, text: Column) -> Column:
    """Share of the points found; 0 where there is no point."""
    hits = point_hits(points, normalise_for_match(text))
    n = F.size(hits)
    return F.when(n > 0, F.size(F.filter(hits, lambda h: h)) / n).otherwise(0.0)


def category_of(doc_type: Column, text: Column, question: Column) -> Column:
    numbered = text.rlike(r"[0-9]+\s*(m|mm|米|dB|%|倍|日|小时|年|人)")
    base = F.when((doc_type == "table") | numbered, "参数查阅").when(text.rlike("隐患|判定|危险"), "隐患判定").otherwise("制度查询")
    return F.when(text.rlike(r"图\s*[0-9]") & question.contains("图"), "图纸解读").otherwise(base)


def metadata_string(cols: list[str]) -> Column:
    """name=value of the columns that aren't null, in the order of their names."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in sorted(cols)]
    return F.array_join(F.array_compact(F.array(*parts)), ";")


def accept_ocr(page: Column, ocr: Column) -> Column:
    """The cleaned OCR text if it is neither empty nor garbled, else the page's own."""
    got = clean_text(F.coalesce(ocr, F.lit("")))
    return F.when((got != "") & ~is_garbled(got), got).otherwise(page)


def needs_tables(size_bytes: Column, pages: Column, most_mb: float = S.DEFAULT.quality.table_mb, most_pages: int = S.DEFAULT.quality.table_pages) -> Column:
    """Whether tables are looked for in a PDF: not above a size or a number of pages."""
    return (size_bytes <= most_mb * 1024 * 1024) & (pages <= most_pages)


def embedding_text(t: Column) -> Column:
    """What an embedding model is sent: lone surrogates as question marks, null and empty text as one blank."""
    return F.coalesce(F.nullif(F.regexp_replace(t, r"\p{Cs}", "?"), F.lit("")), F.lit(" "))


def path_category(rel_path: Column) -> Column:
    """The first folder of a relative path, the root's name for a file in the root, another for null (outside)."""
    return F.when(rel_path.isNull(), "外部").when(rel_path.contains("/"), F.substring_index(rel_path, "/", 1)).otherwise("根目录")


def any_of(t: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [t.contains(w) for w in words])


def cache_key(kind: str, normalised: Column, mode: Column, prefix: str = S.DEFAULT.cache_prefix) -> Column:
    return F.concat(F.lit(f"{prefix}:{kind}:"), F.substring(F.sha1(F.concat_ws("|", normalised, mode)), 1, 20))
