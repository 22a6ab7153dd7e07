"""Problem 9: passages of held-out test items inside the documents of a training corpus.

A distributed positional inverted index: terms are character n-grams of normalised text (4 of Han, 8 of alphabets, fewer
for an item that is shorter). Document frequencies are counted over the whole corpus, and postings (term, document,
position) are stored of every test item's rarest terms; lists are intersected per document and item. A document that
holds a tenth of them is a candidate (a document with half of an item held two fifths at least where this was measured,
and recall against the exhaustive search is tested). With `exact` the bound is a proven one instead: whoever covers enough of
an item holds at least one term in every n + 1 covered characters, and leaving out some of the most common terms lowers
that number by as many. Candidates are compared in full: exact runs that follow each other at nearly one offset chain
into passages (phrase and proximity matches), and an item leaked if passages cover at least half of its text.

Test items go to the workers in blocks of at most `BLOCK_BYTES` of text; a block is one scan.

Defined results: null and empty texts hold nothing, and items without letters or digits are never held; a chain breaks
where more than a single character differs or a whole number was replaced; a passage counts from MIN_HAN or MIN_LATIN
characters on, or from half of an item that is shorter than twice that; an item is reported once per document.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.common import materialise, small
from strataq.llm import lm

HAN_GRAM, LATIN_GRAM = 4, 8
#: Share of an item's terms, rarest first, that is indexed; share of those that a candidate holds; share of the text that passages cover.
RARE_SHARE, CANDIDATE_SHARE, COVER = 0.5, 0.1, 0.5
#: Least lengths of a passage, and the most characters that may differ between two runs of it.
MIN_HAN, MIN_LATIN, MAX_GAP = 16, 40, 1
#: Bytes of test items that one scan looks for.
BLOCK_BYTES = 16 << 20
_ALNUM = np.array([chr(i).isalnum() for i in range(1 << 16)])
_FILTER_BITS = 22


def normalised_codes(texts: list[str]) -> np.ndarray:
    """Letters and digits of the texts, in one form and lower case, as code points; a zero ends each text."""
    c = lm.codes(unicodedata.normalize("NFKC", "\x00".join(texts) + "\x00").lower())
    keep = _ALNUM[np.minimum(c, 0xFFFF)] | (c == 0)
    wide = np.flatnonzero(c > 0xFFFF)
    if len(wide):
        keep[wide] = [chr(x).isalnum() for x in c[wide].tolist()]
    return c[keep]


def normalise(text: str) -> str:
    """Letters and digits only, in one form and lower case."""
    return normalised_codes([text.replace("\x00", "")])[:-1].tobytes().decode("utf-32-le")


def is_han(text: str) -> bool:
    c = lm.codes(text)
    return len(c) > 0 and float((c >= 0x3040).mean()) > 0.3


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a code array, vectorised."""
    if len(c) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ c[k : len(c) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def gram_size(item: str) -> int:
    """Of a normalised item."""
    return min(len(item), HAN_GRAM if is_han(item) else LATIN_GRAM)


def least_terms(length: int, n: int, cover: float) -> int:
    """How many terms of an item of this length any document shares that covers `cover` of it."""
    return max(1, -(-int(np.ceil(cover * length)) // (n + MAX_GAP)))


def item_terms(items: dict[int, str]) -> list[tuple[int, int, int]]:
    """(term, item, position) of every normalised item; terms as signed 64-bit hashes."""
    out = []
    for item, s in items.items():
        if s:
            h = gram_hashes(lm.codes(s), gram_size(s)).view(np.int64)
            out += [(int(t), item, i) for i, t in enumerate(h)]
    return out


class _Finder:
    """Finds the given terms (sorted hashes of n-grams of these sizes) in batches of texts, all at once."""

    def __init__(self, terms: np.ndarray, sizes: list[int]):
        self.terms, self.sizes = terms, sizes
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[self._slot(terms)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, index into the terms) of every hit."""
        keep = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        c = normalised_codes([texts[i].replace("\x00", "") for i in keep]) if len(keep) else np.zeros(0, dtype=np.uint32)
        ends = np.flatnonzero(c == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        rows, pos, term = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n in self.sizes:
            h = gram_hashes(c, n).view(np.int64)
            at = np.flatnonzero(self.maybe[self._slot(h)])
            k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
            real = self.terms[k] == h[at]
            at, k = at[real], k[real]
            doc = np.searchsorted(ends, at)
            inside = at + n <= ends[doc] if len(at) else np.zeros(0, dtype=bool)
            rows.append(keep[doc[inside]])
            pos.append(at[inside] - starts[doc[inside]])
            term.append(k[inside])
        return np.concatenate(rows), np.concatenate(pos), np.concatenate(term)


def document_frequency(docs: DataFrame, text_col: str, terms: np.ndarray, sizes: list[int]) -> np.ndarray:
    """In how many documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df = _Finder(terms, sizes), np.zeros(len(terms), dtype=np.int64)
        for b in batches:
            rows, _, k = find(b.column(0).to_pylist())
            df += np.bincount(np.unique(rows * len(terms) + k) % len(terms), minlength=len(terms))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["k", "n"])

    got = docs.select(text_col).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most one row a test term
    out = np.zeros(len(terms), dtype=np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def postings(docs: DataFrame, id_col: str, text_col: str, terms: np.ndarray, sizes: list[int]) -> DataFrame:
    """The positional index of the given terms: (term, doc, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(terms, sizes)
        for b in batches:
            rows, pos, k = find(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(terms[k]), b.column(0).take(pa.array(rows)), pa.array(pos.astype(np.int32))], names=["term", "doc", "pos"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"term bigint, doc {id_type}, pos int")


def passages(item: str, doc: str) -> list[tuple[int, int]]:
    """(start, end) in the normalised item of the passages that the normalised document holds."""
    n = gram_size(item)
    if not n:
        return []
    least = max(n, min(MIN_HAN if is_han(item) else MIN_LATIN, -(-len(item) // 2)))
    where: dict[str, list[int]] = defaultdict(list)
    for i in range(len(item) - n + 1):
        where[item[i : i + n]].append(i)
    runs: list[list[int]] = []  # [start in item, end, offset]
    active: dict[int, list[int]] = {}
    for p in range(len(doc) - n + 1):
        for i in where.get(doc[p : p + n], ()):
            r = active.get(p - i)
            if r and r[1] == i + n - 1:
                r[1] = i + n
            else:
                r = [i, i + n, p - i]
                active[p - i] = r
                runs.append(r)
    runs.sort()
    best: list[tuple[int, int]] = []  # (length of the chain so far, its start)
    chains: list[tuple[int, int]] = []
    at: dict[int, list[int]] = defaultdict(list)  # runs so far by offset; those of one offset end in the order of their starts
    for k, (a, z, off) in enumerate(runs):
        score, start, last = z - a, a, k  # of equal chains the one with the latest run before
        for o in range(off - MAX_GAP, off + MAX_GAP + 1):
            for j in reversed(at.get(o, ())):
                y = runs[j][1]
                if a - y > MAX_GAP:
                    break
                if -n <= a - y and z > y and (a <= y or not _number_lost(item, y, a)):
                    new = best[j][0] + z - y
                    if new > score or new == score and last < j < k:
                        score, start, last = new, best[j][1], j
        at[off].append(k)
        best.append((score, start))
        chains.append((start, z))
    covered = sorted(c for c in chains if c[1] - c[0] >= least)
    merged: list[tuple[int, int]] = []
    for a, z in covered:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
        else:
            merged.append((a, z))
    return merged


def _number_lost(item: str, a: int, z: int) -> bool:
    """Whether item[a:z] holds a number of two digits or more as a whole."""
    k = a
    while k < z:
        if item[k].isdigit():
            e = k
            while e < len(item) and item[e].isdigit():
                e += 1
            if (k == 0 or not item[k - 1].isdigit()) and e <= z and e - k >= 2:
                return True
            k = e
        k += 1
    return False


def candidates(docs: DataFrame, id_col: str, text_col: str, normal: dict[int, str], cover: float, exact: bool = False) -> DataFrame:
    """(doc, item): documents that share enough terms with an item to be compared with it."""
    spark = docs.sparkSession
    entries = item_terms(normal)
    if not entries:
        return spark.createDataFrame([], f"doc {docs.schema[id_col].dataType.simpleString()}, item bigint")
    terms, sizes = np.unique(np.array([e[0] for e in entries], dtype=np.int64)), sorted({gram_size(s) for s in normal.values() if s})
    frequency = document_frequency(docs, text_col, terms, sizes)
    by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for (t, item, i), k in zip(entries, np.searchsorted(terms, np.array([e[0] for e in entries], dtype=np.int64))):
        by_item[item].append((int(frequency[k]), t, i))
    rare = []
    for item, es in by_item.items():
        if exact:
            least = least_terms(len(normal[item]), gram_size(normal[item]), cover)
            kept, need = len(es) - least // 2, least - least // 2  # the most common terms aren't intersected; so many fewer are needed
        else:
            kept = max(3, int(RARE_SHARE * len(es)))
            need = max(1, int(CANDIDATE_SHARE * min(kept, len(es))))
        rare += [(t, item, i, need) for n, t, i in sorted(es)[:kept] if n]
    wanted = materialise(spark.createDataFrame(rare or [], "term bigint, item bigint, ipos int, need int"))
    index = materialise(postings(docs, id_col, text_col, np.unique(np.array([r[0] for r in rare] or [0], dtype=np.int64)), sizes))
    lined = index.join(small(wanted), "term").groupBy("doc", "item", "need").agg(F.count_distinct("ipos").alias("k"))
    return lined.where("k >= need").select("doc", "item")


def _leaks_of(docs: DataFrame, id_col: str, text_col: str, normal: dict[int, str], cover: float, exact: bool, exhaustive: bool) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("txt"))
    if exhaustive:
        asked = texts.select("doc", "txt", F.array(*[F.lit(i).cast("bigint") for i in normal]).alias("items"))
    else:
        pairs = candidates(docs, id_col, text_col, normal, cover, exact)
        asked = texts.join(small(materialise(pairs.groupBy("doc").agg(F.collect_list("item").alias("items")))), "doc")  # at most the block's items a document

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, (text, items) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                s = normalise(text or "")
                for item in items:
                    t = normal[item]
                    share = sum(z - a for a, z in passages(t, s)) / max(1, len(t))
                    if share >= cover:
                        out.append((d, item, share))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["doc", "item", "covered"])

    return asked.select("doc", "txt", "items").mapInArrow(verify, f"doc {id_type}, item bigint, covered double").distinct()


def leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, cover: float = COVER, exact: bool = False, exhaustive: bool = False) -> DataFrame:
    """(doc, item, covered): every document that holds at least `cover` of an item's text.

    exact takes every document that the bound allows for a candidate; exhaustive compares every document with every item, without the index: what recall is measured against.
    """
    named = items.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = None
    for k in range(blocks):
        rows = named.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES of text
        part = _leaks_of(docs, id_col, text_col, {r[0]: normalise(r[1]) for r in rows}, cover, exact, exhaustive)
        found = part if found is None else found.unionByName(part)
    return found
