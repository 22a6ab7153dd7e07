"""Problem 7: items above a size limit cut into pieces at natural boundaries, with overlap.

Range processing: an item is cut into ranges of `range_size` code points with a halo of one character on both sides;
each range lists its boundaries, the boundary tables are stitched by a running maximum per item, and pieces are
emitted by offset from the range and its left halo alone. Files are read by byte ranges in the same way, with code
point offsets from a prefix sum of the ranges' lengths. No step needs a whole item in one place.

Defined results: null and empty texts and items within the limit give no pieces; a stretch without a boundary longer
than the limit is cut at exactly the limit; consecutive pieces of one item share `overlap` code points.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataq.common import numbered_within
from strataq.llm import lm

#: Natural boundaries lie after these marks, and after a full stop before whitespace.
_MARK_CODES = np.array([ord(c) for c in "\n。；！？;!?"], dtype=np.uint32)
_SPACE_CODES = np.array([*range(9, 14), 32, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000], dtype=np.uint32)
RANGE_SIZE = 65_536


def boundary_ends(text: str) -> np.ndarray:
    """Offsets after each natural boundary of a text."""
    c = lm.codes(text)
    marks = np.isin(c, _MARK_CODES)
    stops = np.flatnonzero(c[:-1] == ord("."))
    stops = stops[np.isin(c[stops + 1], _SPACE_CODES)]
    marks[stops] = True
    return np.flatnonzero(marks) + 1


def _ranges(items: DataFrame, left: int, right: int, range_size: int) -> DataFrame:
    """items exploded to `at` and `part`: ranges with halos, cut before they are exploded, so that no row carries a whole item."""
    part = lambda at: F.struct(at.alias("at"), F.substr(F.col("txt"), at - F.least(at, F.lit(left)) + 1, F.least(at, F.lit(left)) + F.lit(range_size + right)).alias("part"))
    others = [c for c in items.columns if c != "txt"]
    return items.select(*others, F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(range_size)), part)).alias("r")).select(*others, "r.at", "r.part")


def boundary_table(df: DataFrame, id_col: str, text_col: str, limit: int, range_size: int = RANGE_SIZE) -> DataFrame:
    """One row per range of an item above the limit: its offset, length, first and last boundary, longest inner stretch."""
    items = df.where(F.length(text_col) > limit).select(F.col(id_col).alias("item"), F.length(text_col).alias("n"), F.col(text_col).alias("txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, last, inner = [], [], []
            for at, part in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ends = boundary_ends(part) + at - min(at, 1)
                ends = ends[(ends > at) & (ends <= at + range_size)]  # one at the right halo is the neighbour's
                first.append(int(ends[0]) if len(ends) else None)
                last.append(int(ends[-1]) if len(ends) else None)
                inner.append(int(np.diff(ends).max()) if len(ends) > 1 else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(inner, pa.int32())], names=["item", "n", "at", "first_end", "last_end", "inner_max"])

    id_type = df.schema[id_col].dataType.simpleString()
    return _ranges(items, 1, 1, range_size).mapInArrow(run, f"item {id_type}, n int, at int, first_end int, last_end int, inner_max int")


def longest_stretch(df: DataFrame, id_col: str, text_col: str, limit: int, range_size: int = RANGE_SIZE) -> DataFrame:
    """(item, n, longest): the longest stretch between neighbouring boundaries of each item above the limit."""
    t = boundary_table(df, id_col, text_col, limit, range_size)
    alone = t.where(f"n <= {range_size}").select("item", "n", F.greatest("inner_max", F.coalesce("first_end", "n"), F.col("n") - F.coalesce("last_end", F.lit(0))).alias("longest"))
    w = W.partitionBy("item").orderBy("at")
    before = F.coalesce(F.last("last_end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = t.where(f"n > {range_size}").withColumn("before", before)
    last = F.col("n") - F.coalesce("last_end", "before")  # counts only in the last range; an upper one there is a true stretch
    tail = F.when(F.col("at") + range_size >= F.col("n"), last).otherwise(0)
    stitched = many.groupBy("item", "n").agg(F.max(F.greatest("inner_max", F.coalesce(F.col("first_end") - F.col("before"), F.lit(0)), tail)).alias("longest"))
    return alone.unionByName(stitched)


def _last_boundary(text: str, lo: int, hi: int) -> int:
    """Largest boundary offset in (lo, hi] of text, or hi."""
    for i in range(hi, lo, -1):
        c = text[i - 1]
        if c in "\n。；！？;!?" or c == "." and text[i : i + 1].isspace():
            return i
    return hi


def cut_offsets(text: str, start: int, stop: int, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces covering text[start:stop], each at most limit long; pieces after the first reach back by overlap."""
    at = start
    while at < stop:
        lo = max(0, at - overlap)
        if stop - lo <= limit:
            yield lo, stop
            return
        # The newest boundary within reach that brings at least one new character.
        to = _last_boundary(text, at, lo + limit)
        yield lo, to
        at = to


def _emit(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, title, at, halo, size, last, text, alone in zip(b["item"], b["title"], b["at"], b["halo"], b["size"], b["last"], b["part"], b["alone"]):
                # A range starts where its left neighbour's pieces end: at the last boundary of the neighbour's last `limit`.
                start = _last_boundary(text, max(0, halo - limit), halo) if at else 0
                stop = len(text) if last else _last_boundary(text, max(start, halo + size - limit), halo + size)
                base = at - halo
                out += [(item, title, base + a, text[a:z], i if alone else None) for i, (a, z) in enumerate(cut_offsets(text, start, stop, limit, overlap))]
            yield pd.DataFrame(out, columns=["item", "title", "offset", "piece", "no"]).astype({"no": "Int32"})

    return run


def split_items(df: DataFrame, id_col: str, text_col: str, title: Column, limit: int = 450, overlap: int = 80, range_size: int = RANGE_SIZE) -> DataFrame:
    """(item, title, piece_no, offset, piece) of every item above the limit."""
    items = df.where(F.length(text_col) > limit).select(F.col(id_col).alias("item"), title.alias("title"), F.length(text_col).alias("n"), F.col(text_col).alias("txt"))
    halo = limit + overlap
    ranges = _ranges(items, halo, 1, range_size).select("item", "title", "at", F.least("at", F.lit(halo)).alias("halo"), F.least(F.lit(range_size), F.col("n") - F.col("at")).alias("size"), (F.col("at") + range_size >= F.col("n")).alias("last"), "part", (F.col("n") <= range_size).alias("alone"))
    id_type = df.schema[id_col].dataType.simpleString()
    pieces = ranges.mapInPandas(_emit(limit, overlap), f"item {id_type}, title string, offset bigint, piece string, no int")
    # Pieces of an item that is one range are numbered where they are cut; those of longer items by ranges of offsets.
    alone = pieces.where("no is not null").withColumn("piece_no", F.col("no").cast("bigint")).drop("no")
    long = numbered_within(pieces.where("no is null").drop("no"), "item", [F.col("offset").asc()]).withColumn("piece_no", F.col("n") - 1).drop("n")
    return alone.unionByName(long)


def split_files(spark: SparkSession, paths: list[str], limit: int = 450, overlap: int = 80, range_bytes: int = 4 << 20) -> DataFrame:
    """(path, offset, piece) of UTF-8 files on one file system that all workers reach (a path or URI), read by byte ranges; offsets are in code points.

    The listing (a few numbers a file) is the only thing made on the driver; bytes are read by the workers alone.
    """
    where = fs.FileSystem.from_uri(os.path.abspath(paths[0]) if "://" not in paths[0] else paths[0])[0] if paths else None
    bare = lambda p: p.split("://", 1)[-1] if "://" in p and not p.startswith("file:") else p.removeprefix("file://")
    sizes = {p: info.size for p, info in zip(paths, where.get_file_info([bare(p) for p in paths]))} if paths else {}
    ranges = [(p, a, min(range_bytes, n - a), n) for p, n in sizes.items() for a in range(0, n, range_bytes)]
    df = spark.createDataFrame(ranges, "path string, at bigint, size bigint, total bigint").repartition(max(1, min(len(ranges), 10_000)), "path", "at")
    halo = 4 * (limit + overlap) + 4

    def load(path: str, a: int, z: int) -> bytes:
        with where.open_input_file(bare(path)) as f:
            return f.read_at(z - a, a)

    def aligned(raw: bytes, i: int) -> int:
        while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
            i += 1
        return i

    def measure(batches):
        for b in batches:
            n = []
            for p, a, s, t in zip(b["path"], b["at"], b["size"], b["total"]):
                raw = load(p, a, min(t, a + s + 4))
                n.append(len(raw[aligned(raw, 0) if a else 0 : aligned(raw, s)].decode("utf-8", "replace")))
            yield b.assign(n=n)

    table = df.mapInPandas(measure, df.schema.simpleString()[7:-1].replace(":", " ") + ", n bigint")
    w = W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("cp_at", F.coalesce(F.sum("n").over(w), F.lit(0)))

    def emit(batches):
        for b in batches:
            out = []
            for p, a, s, t, cp in zip(b["path"], b["at"], b["size"], b["total"], b["cp_at"]):
                lo = max(0, a - halo)
                raw = load(p, lo, min(t, a + s + 8))
                first = aligned(raw, 0) if lo else 0
                here, end = aligned(raw, a - lo) if a else 0, aligned(raw, a - lo + s)
                left, text = raw[first:here].decode("utf-8", "replace"), raw[first : aligned(raw, end + 4)].decode("utf-8", "ignore")
                size = len(raw[here:end].decode("utf-8", "replace"))
                h = len(left)
                start = _last_boundary(text, max(0, h - limit), h) if a else 0
                stop = h + size if a + s >= t else _last_boundary(text, max(start, h + size - limit), h + size)
                out += [(p, cp - h + x, text[x:z]) for x, z in cut_offsets(text, start, stop, limit, overlap)]
            yield pd.DataFrame(out, columns=["path", "offset", "piece"])

    return table.mapInPandas(emit, "path string, offset bigint, piece string")
