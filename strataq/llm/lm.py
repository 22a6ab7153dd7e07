"""A character bigram language model over a whole corpus, in a table of fixed size.

Counts are kept by hash in 2^20 buckets for pairs and 2^16 for single characters, so the model has one size (under
6 MB) however large the corpus is, and may be sent to every worker. Partitions count with numpy; Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS, CHAR_BITS = 20, 16
SIZE = (1 << PAIR_BITS) + (1 << CHAR_BITS)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) ^ b.astype(np.uint64) * np.uint64(0x85EBCA6B)) * np.uint64(0xC2B2AE35) >> np.uint64(17)) & np.uint64((1 << PAIR_BITS) - 1)


def char_bucket(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) & np.uint64((1 << CHAR_BITS) - 1)) + np.uint64(1 << PAIR_BITS)


def count_corpus(df: DataFrame, cols: list[str], encodings: tuple[str, ...] = ()) -> np.ndarray:
    """Counts of all characters and adjacent pairs of the columns, null texts aside; a vector of SIZE numbers.

    For each encoding 2^16 counts of adjacent bytes follow, of the texts written in it (characters it lacks are left out).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_of(encodings), dtype=np.int64)
        for b in batches:
            for col in b.columns:
                add_counts(total, [t for t in col.to_pylist() if t], encodings)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return gathered(df.select(*cols).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")), encodings)


def size_of(encodings: tuple[str, ...]) -> int:
    return SIZE + (len(encodings) << 16)


def add_counts(total: np.ndarray, texts: list[str], encodings: tuple[str, ...]) -> None:
    if not texts:
        return
    c = codes("\x00".join(texts))
    total[:SIZE] += np.bincount(char_bucket(c).view(np.int64), minlength=SIZE)
    total[:SIZE] += np.bincount(pair_bucket(c[:-1], c[1:]).view(np.int64), minlength=SIZE)
    whole = "\n".join(texts) if encodings else ""
    for i, enc in enumerate(encodings):
        raw = np.frombuffer(whole.encode(enc, "ignore"), dtype=np.uint8).astype(np.int64)
        total[SIZE + (i << 16) : SIZE + (i + 1 << 16)] += np.bincount(raw[:-1] << 8 | raw[1:], minlength=1 << 16)


def gathered(counts: DataFrame, encodings: tuple[str, ...] = ()) -> np.ndarray:
    """(bucket, n) as a vector."""
    got = counts.toArrow()  # at most size_of(encodings) rows, whatever the corpus
    out = np.zeros(size_of(encodings), dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


class Bigrams:
    """log P(next | char), smoothed towards the single character; characters of `known` alone count as seen."""

    def __init__(self, counts: np.ndarray, floor: float = 1e-7):
        self.n = max(1, int(counts[1 << PAIR_BITS : SIZE].sum()))
        self.counts = counts
        self.floor = floor

    def scores(self, text: str, known: np.ndarray | None = None) -> np.ndarray:
        """log-probability of each character of text given the one before it."""
        c = codes(text)
        if not len(c):
            return np.zeros(0)
        uni = self.counts[char_bucket(c).astype(np.int64)] / self.n
        if known is not None:
            ok = known[np.minimum(c, len(known) - 1)]
            uni = np.where(ok, uni, 0)
        p = 0.1 * uni
        if len(c) > 1:
            pair = self.counts[pair_bucket(c[:-1], c[1:]).astype(np.int64)]
            first = self.counts[char_bucket(c[:-1]).astype(np.int64)]
            cond = pair / np.maximum(first, 1)
            if known is not None:
                cond = np.where(ok[1:] & ok[:-1], cond, 0)
            p[1:] += 0.9 * cond
            p[0] *= 10
        else:
            p *= 10
        return np.log(np.maximum(p, self.floor))
