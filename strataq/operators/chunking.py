"""Tables as text, and structure-aware chunking: folds over arrays inside one row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.functions import text as T


def rows_to_markdown(rows: Column, caption: Column) -> Column:
    """An array of rows of cells as a markdown table under a caption line; null where nothing is left.

    Rows whose cells are all null or empty go first; cells are stripped, newlines become blanks; short rows are
    padded; an empty cell shows as one blank.
    """
    shown = lambda r: F.transform(r, lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")))
    kept = F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != "")), shown)
    width = F.array_max(F.transform(kept, lambda r: F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
    lines = F.transform(kept, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(pad(r), lambda c: F.when(c == "", " ").otherwise(c)), " | "), F.lit(" |")))
    head = F.when(F.coalesce(caption, F.lit("")) == "", "【表格】").otherwise(F.concat(F.lit("【表格："), T.strip(caption), F.lit("】")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    return F.when(F.size(kept) > 0, F.concat_ws("\n", head, F.element_at(lines, 1), rule, F.nullif(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"), F.lit(""))))


def table_to_markdown(rows: DataFrame, keys: list[str], order: str, cells: Column, caption: Column) -> DataFrame:
    """keys, markdown: rows of a table, in order, as a markdown table; tables without a filled cell are left out."""
    kept = rows.withColumn("_cells", cells).where(F.exists("_cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    grouped = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_cells").alias("c")))).alias("rows"), F.min(caption).alias("cap"))
    return grouped.select(*keys, rows_to_markdown(F.transform("rows", lambda r: r["c"]), F.col("cap")).alias("markdown"))


def pack_rows(lines: Column, head_length: Column, limit: int = S.DEFAULT.chunking.table_max) -> Column:
    """Part number (from 0) of every data line: a part is closed when the next line would pass the limit."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("part"), F.lit(0).alias("used"))

    def step(a: Column, x: Column) -> Column:
        n = F.length(x)
        flush = (a["used"] > 0) & (head_length + a["used"] + n > limit)
        part = F.when(flush, a["part"] + 1).otherwise(a["part"])
        return F.struct(F.concat(a["out"], F.array(part)).alias("out"), part.alias("part"), (F.when(flush, 0).otherwise(a["used"]) + n + 1).alias("used"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def table_parts(t: Column, limit: int = S.DEFAULT.chunking.table_max) -> Column:
    """A markdown table in parts of at most limit characters, each under the caption, header and rule; a longer row has its own part.

    Tables within the limit stay whole. Null where there is no header to repeat: such text is split as prose.
    """
    lines = F.split(t, "\n")
    bars = F.filter(lines, lambda x: x.startswith("|"))
    first = F.element_at(lines, 1)
    cap = F.when(first.startswith("【"), first).otherwise("")
    header, rule = F.try_element_at(bars, F.lit(1)), F.try_element_at(bars, F.lit(2))
    data = F.slice(bars, 3, F.greatest(F.size(bars) - 2, F.lit(0)))
    part_of = pack_rows(data, F.length(cap) + F.length(header) + F.length(rule) + 4, limit)
    head = F.concat_ws("\n", F.nullif(cap, F.lit("")), header, rule)
    pieces = F.transform(F.sequence(F.lit(0), F.array_max(part_of)), lambda p: F.concat_ws("\n", head, F.array_join(F.filter(data, lambda x, i: F.element_at(part_of, i + 1) == p), "\n")))
    return F.when(F.length(t) <= limit, F.array(t)).when(F.size(bars) >= 3, pieces)


def structure_units(t: Column) -> Column:
    """Text cut before every line that starts a section; stripped, blanks dropped; the whole text if nothing is left."""
    cut = F.split(t, r"\n+(?=(?:" + "|".join(S.SECTION_STARTS) + "))")
    units = F.filter(F.transform(cut, T.strip), lambda u: u != "")
    return F.when(F.size(units) > 0, units).otherwise(F.array(T.strip(t)))


def greedy_pack(units: Column, size: int = S.DEFAULT.chunking.size) -> Column:
    """Units joined by newlines as long as they stay within size, each counted with a newline; a unit above size stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(a: Column, u: Column) -> Column:
        n, b = F.length(u), F.length(a["buf"])
        flushed = F.when(b > 0, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"])
        long = n > size
        full = (b + 1 + n + 1 > size) & (b > 0)  # every unit counts with its newline
        return F.struct(
            F.when(long, F.concat(flushed, F.array(u))).when(full, flushed).otherwise(a["done"]).alias("done"),
            F.when(long, "").when(full | (b == 0), u).otherwise(F.concat(a["buf"], F.lit("\n"), u)).alias("buf"),
        )

    return F.aggregate(units, start, step, lambda a: F.when(F.length(a["buf"]) > 0, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))


def sentence_pack(sentences: Column, size: int = S.DEFAULT.chunking.size, overlap: int = S.DEFAULT.chunking.overlap) -> Column:
    """Sentences joined without separator up to size; a new buffer starts with the last `overlap` characters of the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(a: Column, s: Column) -> Column:
        full = (F.length(a["buf"]) > 0) & (F.length(a["buf"]) + F.length(s) > size)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]).alias("done"), F.when(full, F.concat(F.right(a["buf"], F.lit(overlap)), s)).otherwise(F.concat(a["buf"], s)).alias("buf"))

    return F.aggregate(sentences, start, step, lambda a: F.when(F.length(a["buf"]) > 0, F.concat(a["done"], F.array(a["buf"]))).otherwise(a["done"]))


def hard_windows(t: Column, size: int = S.DEFAULT.chunking.size, overlap: int = S.DEFAULT.chunking.overlap) -> Column:
    """Windows of `size` every size - overlap characters for texts above one and a half sizes; else the text itself."""
    n = F.length(t)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.substr(t, i + 1, F.lit(size)))
    return F.when(n * 2 > size * 3, windows).otherwise(F.array(t))


def split_long_unit(unit: Column) -> Column:
    """A unit above the chunk size: paragraphs stripped, cut into sentences, packed with overlap, then hard windows."""
    paragraphs = F.filter(F.transform(F.split(unit, "\n"), T.strip), lambda p: p != "")
    sents = F.flatten(F.transform(paragraphs, T.sentences))
    return F.flatten(F.transform(sentence_pack(sents), lambda c: hard_windows(c)))


def chunk_text(t: Column, size: int = S.DEFAULT.chunking.size) -> Column:
    """array<struct<title, content>> of a text page: sections, merged while short, long ones cut at sentences."""
    packed = greedy_pack(structure_units(t), size)
    return F.flatten(F.transform(packed, lambda u: F.transform(F.when(F.length(u) > size, split_long_unit(u)).otherwise(F.array(u)), lambda c: F.struct(T.section_title(u).alias("title"), c.alias("content")))))


def chunk_id(source: Column, page: Column, index: Column, content: Column) -> Column:
    """First 16 hex digits of SHA-256 over source:page:index:first 256 characters; a null page reads None."""
    return F.substring(F.sha2(F.concat_ws(":", source, F.coalesce(page.cast("string"), F.lit("None")), index.cast("string"), F.substring(content, 1, 256)), 256), 1, 16)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunk rows with index, title and id: tables in parts that repeat their header, everything else by structure."""
    filled = docs.where(F.col("page_content").isNotNull() & (T.strip(F.col("page_content")) != ""))
    parts = F.when(F.col("doc_type") == "table", table_parts(F.col("page_content")))
    cut = filled.select("row_id", "source", "page", "page_content", parts.alias("parts"))
    out = ["row_id", "source", "page", "chunk_index"]
    tables = cut.where("parts is not null").select("row_id", "source", "page", F.posexplode("parts").alias("chunk_index", "content")).select(*out, F.lit("表格").alias("section_title"), "content")
    text = cut.where("parts is null").select("row_id", "source", "page", F.posexplode(chunk_text(F.col("page_content"))).alias("chunk_index", "c")).select(*out, F.col("c.title").alias("section_title"), F.col("c.content").alias("content"))
    both = text.unionByName(tables)
    return both.withColumn("chunk_id", chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("content")))
