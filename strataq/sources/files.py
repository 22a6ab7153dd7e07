"""Files as document rows: one scan of a folder, parsers by suffix, a cache of parsed files.

PDF text, OCR and the old binary Office formats need an engine that isn't here: such files come out as rows of
`failed` with the reason, never silently. A parser of one's own is a function (path, bytes) -> rows, given by suffix.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from itertools import groupby
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq import settings as S
from strataq.common import numbered
from strataq.functions.text import path_category
from strataq.operators.chunking import rows_to_markdown

SCHEMA = "path string, page int, total_pages int, doc_type string, has_table boolean, sheet string, page_content string, error string"
Rows = list[dict]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """(path, rel_path, file_name, category, mtime, size) of the supported files under root; no content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    rows = f.select("path", rel.alias("rel_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*S.SUPPORTED) & ~F.col("file_name").isin(*exclude)).withColumn("category", path_category(F.col("rel_path")))


def decode(raw: bytes) -> str:
    """UTF-8, else GB 18030, else UTF-8 without what doesn't fit."""
    for enc in ("utf-8", "gb18030"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "ignore")


def parse_text(path: str, raw: bytes) -> Rows:
    text = decode(raw)
    return [{"page_content": text, "doc_type": "markdown" if path.lower().endswith(".md") else "text"}] if text.strip() else []


def parse_docx(path: str, raw: bytes) -> Rows:
    """Body order: runs of paragraphs (headings on lines of their own) between tables, and the cells of each table."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))

    def line(e) -> str:
        style = e.find(f"{_W}pPr/{_W}pStyle")
        heading = style is not None and "heading" in style.get(f"{_W}val", "").lower()
        return ("\n## " if heading else "") + words(e).strip() if words(e).strip() else ""

    out: Rows = []
    for kind, run in groupby((e for e in body if e.tag in (f"{_W}p", f"{_W}tbl")) if body is not None else (), key=lambda e: e.tag):
        if kind == f"{_W}p":
            text = "\n".join(filter(None, map(line, run))).strip()
            out += [{"page_content": text, "doc_type": "text"}] if text else []
        else:
            out += [{"cells": [[words(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")], "doc_type": "table", "has_table": True} for e in run]
    return out


def parse_xlsx(path: str, raw: bytes) -> Rows:
    """The cells of every sheet, with the sheet's name in the caption."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out: Rows = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
        target = rels.get(sheet.get(f"{_R}id"), "").lstrip("/")
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_X}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_X}c"):
                at = 0
                for ch in re.sub(r"\d", "", c.get("r", "")):
                    at = at * 26 + ord(ch) - 64
                cells += [None] * max(0, at - 1 - len(cells))
                v = c.find(f"{_X}v")
                kind = c.get("t")
                cells.append("".join(t.text or "" for t in c.iter(f"{_X}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text)
            rows.append(cells)
        name = sheet.get("name", "")
        out.append({"cells": rows, "caption": f"工作表 {name}", "doc_type": "table", "has_table": True, "sheet": name})
    return out


def _missing(path: str, raw: bytes) -> Rows:
    raise ValueError(f"no parser for .{path.rsplit('.', 1)[-1]}")


PARSERS: dict[str, Callable[[str, bytes], Rows]] = {"txt": parse_text, "md": parse_text, "docx": parse_docx, "xlsx": parse_xlsx, "pdf": _missing, "doc": _missing, "xls": _missing}


_PARSED = "path string, page int, total_pages int, doc_type string, has_table boolean, sheet string, page_content string, error string, cells array<array<string>>, caption string"


def load(spark: SparkSession, root: str, parsers: dict[str, Callable[[str, bytes], Rows]] | None = None) -> DataFrame:
    """SCHEMA rows of all supported files; a file that fails is one row with `error` and no content.

    Parsers give texts or cells; tables are written as text by the plan, and empty ones are left out.
    """
    use = {**PARSERS, **(parsers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*use) & ~F.col("path").endswith("/README.md"))
    names = [x.split()[0] for x in _PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: Rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows = use[path.rsplit(".", 1)[-1].lower()](path, raw)
                    out += [{"path": path, "page": None, "total_pages": len(rows), **r} for r in rows]
                except Exception as e:  # one bad file must not end the scan
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([[r.get(c) for c in names] for r in out], columns=names, dtype=object)

    parsed = files.mapInPandas(run, _PARSED)
    content = F.when(F.col("cells").isNull(), F.col("page_content")).otherwise(rows_to_markdown(F.col("cells"), F.col("caption")))
    kept = parsed.withColumn("page_content", content).where("page_content is not null or error is not null")
    return kept.select(*[x.split()[0] for x in SCHEMA.split(", ")])


def batch_report(loaded: DataFrame, root: str) -> DataFrame:
    """(category, files, failed, rows) by first folder: what a batch of folders gave; a failed file costs nothing but itself."""
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    one = loaded.groupBy("path").agg(F.max(F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("bad"), F.count("page_content").alias("rows")).withColumn("category", path_category(rel))
    return one.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("failed"), F.sum("rows").alias("rows"))


def write_json(df: DataFrame, path: str) -> None:
    """A dataset, manifest or report as JSON lines, one file a partition; written whole or not at all."""
    df.write.mode("overwrite").json(path)


def unparsed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) key isn't in the cache of parsed files; with the key."""
    key = F.sha1(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")))
    return files.withColumn("cache_key", key).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items of a JSON file that holds a list, or an object with `items`."""
    raw = spark.read.text(path, wholetext=True)
    item = "struct<id:string,question:string,answer:string,key_points:array<string>,source_file:string,section:string,source_chunk_id:string,match_terms:array<string>,category:string,is_seed:boolean>"
    rows = F.coalesce(F.from_json("value", f"struct<items:array<{item}>>")["items"], F.from_json("value", f"array<{item}>"))
    return raw.select(F.inline(rows))


def report(summary: DataFrame, title: str) -> DataFrame:
    """(line_no, line) of a markdown report of a summary, one line a row after the head; in the order of its columns."""
    cells = F.array_join(F.transform(F.array(*[F.col(c).cast("string") for c in summary.columns]), lambda c: F.coalesce(c, F.lit(""))), " | ")
    body = numbered(summary.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")), [F.col("line").asc()]).select((F.col("n") + 4).alias("line_no"), "line")
    head = [(1, f"# {title}"), (2, ""), (3, "| " + " | ".join(summary.columns) + " |"), (4, "|" + "---|" * len(summary.columns))]
    return summary.sparkSession.createDataFrame(head, "line_no bigint, line string").unionByName(body)
