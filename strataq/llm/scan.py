"""Problem 2: noise in text from scanned pages.

Learning, over all pages: counts of words and of character trigrams. A word's candidates are complete: a Levenshtein
automaton (distance 2) runs over a trie of the vocabulary; candidates are ranked by what optical confusion costs and
how common they are. Han text has no words to cut: the automaton there is one substitution, intersected with the
trigrams by their three contexts (left, both sides, right), and context ranks: a character is misread if a context in
which another character stands nearly always has it instead, and its pair of characters is confused all over the
corpus (two contexts agreeing at least `MIN_PAIR` times). A second pass puts the learned pairs back, neighbours
together, and takes a character for misread where the trigrams around it are so far more common (`restored`); that
needs no context, so neighbours misread together and rare words are seen too. Running headers are lines at the head or foot that recur in
their file after folding confused characters; page numbers are shapes at the head or foot. `repair` removes the
furniture, joins broken words, puts the likely characters back and reflows lines into paragraphs.

All tables that workers receive have sizes bounded by shares (an entry of the contexts needs a fixed share of all counts),
by blocks (the vocabulary is searched VOCABULARY words at a time) or a fixed size (the bitmap of the second pass, whose
hits are joined with the exact counts).

Defined results: null and blank pages and pages without running prose have no noise. Distinct pages are counted for
headers, so a page loaded twice counts once; a page without a number counts by its text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.common import materialise, small
from strataq.llm import lm
from strataq.llm.quality import blocks, prose_flags

#: Entries of context tables need this share of all counts (and an absolute least count).
SHARE = 2e-6
MIN_WORD, MIN_CONTEXT, DOMINANCE, MIN_PAIR = 3, 15, 0.85, 3
HEADER_PAGES = 3
#: Words that one trie holds.
VOCABULARY = 500_000
#: So many times rarer than its true word a misread word of letters alone has to be.
RARER = 3
#: Log of how many times more common the trigrams around a character have to be with the learned pairs put back.
EVIDENCE = 2.0
_BITS = 22
#: Trigrams a worker holds before it counts them.
HELD = 1 << 21

# What optical recognition takes for what (seen form, true form).
CONFUSED = (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("1", "l"), ("!", "i"), ("|", "l"), ("0", "o"), ("c", "e"), ("e", "c"), ("5", "s"), ("8", "b"), ("i", "l"), ("l", "i"), ("h", "b"), ("b", "h"), ("f", "t"), ("n", "u"), ("u", "n"), ("9", "g"), ("6", "b"))

_BREAK = re.compile(r"([A-Za-zÀ-ɏ0-9!]+)(?:-|¬|‐|­)[ \t]*\n[ \t]*([A-Za-zà-ɏ0-9!]+)")
_MAYBE_BREAK = re.compile(r"[-¬‐­][ \t]*\n")
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ0-9!|]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9!|]*")
_COMPOUND = re.compile(r"[A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)+")
_INNER = re.compile(r"[a-z][0-9!|](?=[a-z])|^[0-9!|][a-z]{3,}|[a-z]{3,}[0-9|]$|[A-Z][0-9!|](?=[a-z])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9À-ɏ.\-/])(?=[\dlOISBZ|!.]*\d)(?=[\dlOISBZ|!.]*[lOISBZ|!])[\dlOISBZ|!]+(?:\.[\dlOISBZ|!]+)?(?![A-Za-z0-9!])")
_D = r"(?:[\dlOОISBZ|!]{1,4}|[ivxlc]{1,8})"
_PAGE_SHAPE = rf"(?:[—–\-·•~]\s*{_D}\s*[—–\-·•~]|第\s*{_D}\s*[页贝]\s*(?:[,，/]?\s*共\s*{_D}\s*[页贝])?|P[ao]g[ec]\s*{_D}(?:\s*[o0][ft]\s*{_D})?|{_D}\s*/\s*{_D})"
_PAGE_ALONE = re.compile(rf"^\s*(?:{_PAGE_SHAPE}|(?=[^\d]*[\dlO])[\dlOISB]{{1,4}}|[ivxlc]{{1,8}})\s*$")
_PAGE_BESIDE = re.compile(rf"^\s*(?:(?P<h1>\S.*?)(?:\s+{_PAGE_SHAPE}|\s*\|\s+{_D}|\s{{2,}}(?:[\dlO]{{1,4}}|[ivxlc]{{1,8}}))|(?:{_PAGE_SHAPE}\s+|{_D}\s+\|\s*|(?:[\dlO]{{1,4}}|[ivxlc]{{1,8}})\s{{2,}})(?P<h2>\S.*?))\s*$")
#: Letters where a printed page number has digits: after its words, before a total, or beside a digit.
_PAGE_MISREAD = re.compile(r"(?:第|共|[Pp][ao]g[ec]|\s[o0]f)\s*\d*[lOОISBZ|!]+\d*(?!\w)|\d[lOОISBZ]|[lOОISBZ]\d|(?<!\w)[lOОISBZ]+\s*/\s*\d|\d\s*/\s*[lOОISBZ]+(?!\w)")
_UNSEEN = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)} | {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)}
_UNSEEN_CHAR = re.compile("[\u00a0\u00ad\u2007\u2009\u200b-\u200f\u202f\u2060\u3000\ufeff]")
#: A page number leaves one of these at the start or the end of the line.
_NUMBER_FIRST, _NUMBER_LAST = frozenset("—–-·•~第P0123456789lOISBZivxc|!"), frozenset("—–-·•~页贝0123456789lOОISBZivxc|!")
#: A digit beside what it is misread as; without it no number is misread.
_NEAR_DIGIT = re.compile(r"\d\.?[lOISBZ|!]|[lOISBZ|!]\.?\d")
_HEADING = re.compile(r"^\s*(?:第\s*[一二三四五六七八九十百零〇0-9lO]+\s*[章节条篇]|\d+(?:\.\d+)*[)）.、\s]|[|【（(□■●◆▲·•*①-⑳])")
_SENTENCE_MARKS = frozenset("。；！？，、;!?")
_HAN_GAP = re.compile("(?<=[一-鿿，。；：！？、（）])[ \n]+(?=[一-鿿，。；：！？、（）])")
_M21 = (1 << 21) - 1


def is_prose(text: str) -> bool:
    return bool(prose_flags([text])[0])


def _wide(c: np.ndarray) -> np.ndarray:
    return (c >= 0x4E00) & (c <= 0x9FFF) | (c > 0x2000) & (c < 0x3100) | (c == 10) | (c > 0xFF00)


def trigram_keys(texts: list[str]) -> np.ndarray:
    c = lm.codes("\n\x00".join(_HAN_GAP.sub("", t) for t in texts)).astype(np.int64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    w = _wide(c)
    ok = w[:-2] & w[1:-1] & w[2:]
    return ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[ok]


def joined(text: str) -> str:
    """The text with words put together that were broken at line ends."""
    return _BREAK.sub(r"\1\2", text) if _MAYBE_BREAK.search(text) else text


def words_of(text: str) -> list[str]:
    whole = joined(text)
    return _TOKEN.findall(whole) + (_COMPOUND.findall(whole) if "-" in whole else [])


def count_forms(pages: DataFrame, text_col: str, encodings: tuple[str, ...] = ()) -> DataFrame:
    """(tri, word, bucket, n): counts of wide trigrams and of words over all pages of running prose, and those of lm.count_corpus over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        total = np.zeros(lm.size_of(encodings), dtype=np.int64)
        held: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            both, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)

        for b in batches:
            filled = [t for t in b.column(0).to_pylist() if t]
            lm.add_counts(total, filled, encodings)
            for part in blocks([t for t, ok in zip(filled, prose_flags(filled).tolist()) if ok]):
                for t in part:
                    words.update(words_of(t))
                held.append(trigram_keys(part))
                if sum(map(len, held)) > max(HELD, 2 * len(keys)):
                    keys, counts = merged()
        if held:
            keys, counts = merged()
        at = np.flatnonzero(total)
        for part in ((pa.array(keys), None, None, pa.array(counts)), (None, pa.array(list(words), pa.string()), None, pa.array(list(words.values()), pa.int64())), (None, None, pa.array(at.astype(np.int32)), pa.array(total[at]))):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part[3]), kind) if x is None else x for x, kind in zip(part, (pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["tri", "word", "bucket", "n"])

    got = pages.select(text_col).mapInArrow(run, "tri bigint, word string, bucket int, n bigint")
    return got.groupBy("tri", "word", "bucket").agg(F.sum("n").alias("n"))


class Lookup:
    """Exact integer map in arrays: one slot a key by multiplicative hashing, keys that collide in a sorted rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(8 * max(1, len(keys))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.full = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=bool)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.full[slot[rest]] = True
        self.rest_keys, self.rest_values = keys[rest], values[rest]

    def _slot(self, q: np.ndarray) -> np.ndarray:
        return ((q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, q: np.ndarray) -> np.ndarray:
        """The value of each key, 0 where there is none."""
        slot = self._slot(q)
        out = np.where(self.keys[slot] == q, self.values[slot], 0)
        if len(self.rest_keys):
            at = np.flatnonzero(self.full[slot] & (out == 0))
            i = np.minimum(np.searchsorted(self.rest_keys, q[at]), len(self.rest_keys) - 1)
            out[at] = np.where(self.rest_keys[i] == q[at], self.rest_values[i], 0)
        return out


class Contexts:
    """The contexts in which one character nearly always stands, left, on both sides, right."""

    def __init__(self, forms: DataFrame):
        tri = forms.where("tri is not null")
        total = tri.agg(F.sum("n")).first()[0] or 0
        least = max(MIN_CONTEXT, SHARE * total)
        a, b, c = F.shiftright("tri", 42), F.shiftright("tri", 21).bitwiseAND(_M21), F.col("tri").bitwiseAND(_M21)
        self.tables = {}
        for name, ctx, ch in (("left", F.shiftleft(a, 21).bitwiseOR(b), c), ("mid", F.shiftleft(a, 21).bitwiseOR(c), b), ("right", F.shiftleft(b, 21).bitwiseOR(c), a)):
            top = tri.select(ctx.alias("ctx"), ch.alias("ch"), "n").groupBy("ctx").agg(F.sum("n").alias("total"), F.max(F.struct("n", "ch")).alias("top"))
            got = top.where((F.col("total") >= least) & (F.col("top.n") >= DOMINANCE * F.col("total"))).select("ctx", F.col("top.ch").alias("ch")).toArrow()  # at most 1/SHARE rows
            self.tables[name] = Lookup(got["ctx"].to_numpy().astype(np.int64), got["ch"].to_numpy().astype(np.int64))

    def _look(self, name: str, q: np.ndarray) -> np.ndarray:
        return self.tables[name].get(q)

    def events(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, seen, likely, contexts that agree) of Han characters that no context expects."""
        flat = [_HAN_GAP.sub("", t) for t in texts]
        if not flat:
            return
        ends = np.cumsum([len(t) + 3 for t in flat])
        c = lm.codes("\x00\x00\x00".join(flat) + "\x00\x00\x00").astype(np.int64)
        pad = np.concatenate([[0, 0], c, [0, 0]])
        p2, p1, c0, n1, n2 = pad[:-4], pad[1:-3], pad[2:-2], pad[3:-1], pad[4:]
        # Where one context expects the character that stands there, the others needn't be looked up.
        at = np.flatnonzero((c0 >= 0x4E00) & (c0 <= 0x9FFF))
        mid = self._look("mid", p1[at] << 21 | n1[at])
        keep = mid != c0[at]
        at, mid = at[keep], mid[keep]
        right = self._look("right", n1[at] << 21 | n2[at])
        keep = right != c0[at]
        at, mid, right = at[keep], mid[keep], right[keep]
        left = self._look("left", p2[at] << 21 | p1[at])
        likely = np.where(mid > 0, mid, np.where(right > 0, right, left))
        keep = (left != c0[at]) & (likely >= 0x4E00) & (likely <= 0x9FFF)
        at, mid, right, left, likely = at[keep], mid[keep], right[keep], left[keep], likely[keep]
        votes = (left == likely).astype(int) + (mid == likely) + (right == likely)
        yield from zip(np.searchsorted(ends, at, "right").tolist(), c0[at].tolist(), likely.tolist(), votes.tolist())


class Trie:
    """A vocabulary as a trie, searched by a Levenshtein automaton: every word within `k` edits is found."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = (w, n)

    def within(self, word: str, k: int) -> Iterator[tuple[str, int, int]]:
        """(word, count, distance); a state of the automaton is the row of distances to the prefixes of `word`."""
        stack = [(self.root, tuple(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if row[-1] <= k:
                        yield (*child, row[-1])
                    continue
                new = [row[0] + 1]
                for i, seen in enumerate(word):
                    new.append(min(row[i] + (seen != ch), row[i + 1] + 1, new[i] + 1))
                if min(new) <= k:
                    stack.append((child, tuple(new)))


def confusion_cost(seen: str, true: str) -> float:
    """Least cost to read `true` as `seen`: 0.3 for a known confusion, 1 for any other edit."""
    m, n = len(seen), len(true)
    d = [[1e9] * (n + 1) for _ in range(m + 1)]
    d[0][0] = 0.0
    for i in range(m + 1):
        for j in range(n + 1):
            v = d[i][j]
            if v > 2:
                continue
            if i < m and j < n:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], v + (seen[i] != true[j]))
            if i < m:
                d[i + 1][j] = min(d[i + 1][j], v + 1)
            if j < n:
                d[i][j + 1] = min(d[i][j + 1], v + 1)
            for s, t in CONFUSED:
                if seen.startswith(s, i) and true.startswith(t, j):
                    x, y = i + len(s), j + len(t)
                    d[x][y] = min(d[x][y], v + 0.3)
    return d[m][n]


def misread_words(forms: DataFrame, block: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(word, true) of the words that are optical confusions of a far more common one; and the vocabulary (its most common part).

    The vocabulary is every word seen MIN_WORD times. It is searched in blocks of at most VOCABULARY words, a trie each,
    so that no candidate is missed however many words there are.
    """
    block = VOCABULARY if block is None else block
    words = forms.where("word is not null").select("word", "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    vocabulary = words.where((F.col("n") >= MIN_WORD) & F.col("word").rlike("^[A-Za-zÀ-ɏ-]{2,}$"))
    blocks = max(1, -(-vocabulary.count() // block))
    solid = {r[0]: r[1] for r in (vocabulary if blocks == 1 else vocabulary.orderBy(F.desc("n"), "word").limit(block)).collect()}  # at most `block` rows
    common = vocabulary.where(~F.col("word").contains("-") & (F.length("word") >= 3)).groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("m"))
    odd = words.where((F.length("word") >= 4) & ~F.col("word").contains("-"))
    # What its own lower-case form counts decides whether a word is odd at all; joined, so that no worker needs all words.
    odd = materialise(odd.withColumn("low", F.lower("word")).join(common.withColumnRenamed("m", "own"), "low", "left").select("word", "low", "n", F.coalesce("own", F.lit(0)).alias("own")).repartition("word"))

    def search(lower: dict[str, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(lower)
            for b in batches:
                out: list[tuple[str, str, float, int]] = []
                for w, low, n, own in zip(*(b.column(k).to_pylist() for k in range(4))):
                    inner = bool(_INNER.search(w))
                    if not inner and (own > 3 * n or own * 200 > total):
                        continue
                    best = (1.0, 0, "")
                    for v, m, _ in trie.within(low, 2):
                        if v != low and m >= (n if inner else RARER * max(n, own)):
                            best = min(best, (confusion_cost(low, v), -m, v))
                    if best[0] < 1.0:
                        out.append((w, best[2], best[0], -best[1]))
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=["word", "true", "cost", "m"])

        return run

    found = None
    for k in range(blocks):
        lower = {r[0]: r[1] for r in common.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == k).collect()}  # about `block` rows
        part = odd.mapInArrow(search(lower), "word string, true string, cost double, m bigint")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("word").agg(F.min_by("true", F.struct("cost", -F.col("m"), "true")).alias("true"))
    return materialise(best), solid


def edge_lines(text: str) -> list[tuple[int, str]]:
    """(index, line) of the first three and last three lines that aren't blank."""
    lines = text.split("\n")
    at = range(len(lines))
    first = list(islice((i for i in at if lines[i] and not lines[i].isspace()), 3))
    last = list(islice((i for i in reversed(at) if lines[i] and not lines[i].isspace()), 3))
    return [(i, lines[i].translate(_UNSEEN) if _UNSEEN_CHAR.search(lines[i]) else lines[i]) for i in sorted({*first, *last})]


def ends_sentence(line: str) -> bool:
    """Whether a line ends in a mark of a sentence, a point or comma only after two letters."""
    t = line.rstrip()
    return t[-1:] in _SENTENCE_MARKS if t[-1:] not in (".", ",") else len(t) > 2 and t[-2].isascii() and t[-2].islower() and t[-3].isascii() and t[-3].islower()


def without_page_number(line: str) -> tuple[str, bool]:
    """The line without a printed page number, and whether it had one."""
    bare = line.strip()
    if not bare or bare[0] not in _NUMBER_FIRST and bare[-1] not in _NUMBER_LAST and not bare[0].isdigit() and not bare[-1].isdigit():
        return line, False
    if _PAGE_ALONE.match(line):
        return "", True
    m = _PAGE_BESIDE.match(line)
    if m and len(m["h1"] or m["h2"]) >= 4:
        return (m["h1"] or m["h2"]).rstrip(" |"), True
    return line, False


def observe(pages: DataFrame, id_col: str, source_col: str, page_col: str, text_col: str, contexts: Contexts, solid: set[str]) -> DataFrame:
    """(rid, source, page, what, a, b, n): everything noticed on a page; lines at its edges for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, numbers = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            out: list[tuple] = []
            proses: list[tuple] = []
            texts = [t or "" for t in b.column(3).to_pylist()]
            for i, (text, prose) in enumerate(zip(texts, prose_flags(texts).tolist())):
                if not text or text.isspace():
                    continue
                at = numbers[i] if numbers[i] is not None else -zlib.crc32(text.encode("utf-8", "replace")) - 1
                for _, line in edge_lines(text):
                    rest, numbered = without_page_number(line)
                    if numbered and prose:
                        out.append((i, at, "page_number", "", "", 1))
                        if _PAGE_MISREAD.search(line):
                            out.append((i, at, "number", "", "", 1))
                    if len(rest.strip()) >= 4 and not ends_sentence(rest) and not _HEADING.match(rest):
                        out.append((i, at, "line", rest.strip(), "", int(prose)))
                if not prose:
                    continue
                if _MAYBE_BREAK.search(text) and any((m[1] + "-" + m[2]) not in solid for m in _BREAK.finditer(text)):
                    out.append((i, at, "hyphen", "", "", 1))
                if _NEAR_DIGIT.search(text) and _NUMBER.search(text):
                    out.append((i, at, "number", "", "", 1))
                out += [(i, at, "word", w, "", 1) for w in set(_TOKEN.findall(joined(text))) if w not in solid and len(w) >= 4]
                proses.append((i, at, text))
            events: dict[tuple[int, int, int], int] = {}
            for k, c, true, votes in contexts.events([t for _, _, t in proses]):
                events[k, c, true] = max(votes, events.get((k, c, true), 0))
            out += [(*proses[k][:2], "han", chr(c), chr(true), votes) for (k, c, true), votes in events.items()]
            cols = [list(x) for x in zip(*out)] if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array([sources[i] for i in cols[0]], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int32())], names=["rid", "source", "page", "what", "a", "b", "n"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.coalesce(F.col(source_col), F.lit("")), F.col(page_col).cast("bigint"), F.col(text_col)).mapInArrow(run, f"rid {id_type}, source string, page bigint, what string, a string, b string, n int")


def confused_pairs(seen: DataFrame) -> list[tuple[str, str]]:
    """Han pairs (seen, true) confused all over the corpus: at most one a seen character, which most of its events name."""
    each = seen.where("what = 'han'").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).alias("sure"))
    of = each.groupBy("a").agg(F.sum("pages").alias("all"))
    good = each.where(f"sure >= {MIN_PAIR} and sure >= 0.15 * pages").join(of, "a").where("pages > 0.5 * all")
    return [(r["a"], r["b"]) for r in good.select("a", "b").collect()]


def restored_forms(forms: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(tri, n, m, mask): trigrams with a confused character; the count of the most common form with any of the pairs put back, and where."""
    true = _true_codes(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tri, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            chars = [tri >> 42, tri >> 21 & _M21, tri & _M21]
            back = [true[np.minimum(c, 0xFFFF)] for c in chars]
            for mask in range(1, 8):
                ok = np.logical_and.reduce([back[k] > 0 for k in range(3) if mask >> k & 1])
                x, y, z = (back[k][ok] if mask >> k & 1 else chars[k][ok] for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(tri[ok]), pa.array(n[ok]), pa.array(x << 42 | y << 21 | z), pa.array(np.full(int(ok.sum()), mask, dtype=np.int32))], names=["tri", "n", "fixed", "mask"])

    wide = forms.where("tri is not null").select("tri", "n")
    every = wide.mapInArrow(run, "tri bigint, n bigint, fixed bigint, mask int")
    counted = every.join(wide.select(F.col("tri").alias("fixed"), F.col("n").alias("m")), "fixed", "left").select("tri", "n", F.coalesce("m", F.lit(0)).alias("m"), "mask")
    return counted.groupBy("tri", "n").agg(F.max(F.struct("m", F.col("mask"))).alias("best")).select("tri", "n", "best.m", "best.mask")


def _true_codes(pairs: list[tuple[str, str]]) -> np.ndarray:
    true = np.zeros(1 << 16, dtype=np.int64)
    for a, b in pairs:
        true[ord(a)] = ord(b)
    return true


def _bucket(tri: np.ndarray) -> np.ndarray:
    return ((tri.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def restored(pages: DataFrame, id_col: str, text_col: str, forms: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(rid, tri, k): trigrams on pages of running prose whose k-th character (from 0) is misread, by counts with the learned pairs put back.

    Every trigram around the character votes: with the log of how many times more common its restored form is, or
    against it with the log of its own count.
    """
    id_type = pages.schema[id_col].dataType.simpleString()
    if not pairs:
        return pages.sparkSession.createDataFrame([], f"rid {id_type}, tri bigint, k int")
    best = materialise(restored_forms(forms, pairs))
    better = (F.col("m") >= MIN_WORD) & (F.col("m") > F.col("n"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(b.column(0).to_numpy())))], names=["bucket"])

    marked = np.zeros(1 << _BITS, dtype=bool)
    marked[best.where(better).select("tri").mapInArrow(buckets, "bucket bigint").distinct().toArrow()["bucket"].to_numpy()] = True  # at most 2^_BITS rows
    packed, true, confused = np.packbits(marked), _true_codes(pairs), frozenset(a for a, _ in pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(packed).astype(bool)
        for b in batches:
            texts = [t if t and not confused.isdisjoint(t) else "" for t in b.column(1).to_pylist()]
            flat = [_HAN_GAP.sub("", t) if t else "" for t in texts]
            ends = np.cumsum([len(t) + 3 for t in flat])
            c = np.concatenate([[0, 0], lm.codes("\x00\x00\x00".join(flat) + "\x00\x00\x00").astype(np.int64), [0, 0]])
            at = np.flatnonzero(true[np.minimum(c, 0xFFFF)])
            w = _wide(c)
            tri = np.stack([c[at - k] << 42 | c[at - k + 1] << 21 | c[at - k + 2] for k in range(3)])
            whole = np.stack([w[at - k] & w[at - k + 1] & w[at - k + 2] for k in range(3)])
            odd = np.flatnonzero((whole & hit[_bucket(tri)]).any(axis=0))
            page = np.searchsorted(ends, at[odd] - 2, "right")
            asked = np.unique(page).tolist()
            prose = dict(zip(asked, prose_flags([texts[i] for i in asked]).tolist()))
            keep = np.array([prose[i] for i in page.tolist()], dtype=bool)
            odd, page = odd[keep], page[keep]
            k, j = np.nonzero(whole[:, odd])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(page[j])), pa.array(at[odd[j]]), pa.array(k.astype(np.int32)), pa.array(tri[k, odd[j]])], names=["rid", "place", "k", "tri"])

    asked = pages.select(F.col(id_col), F.col(text_col))
    # The place is one in its batch; a page stands in one batch only.
    votes = asked.mapInArrow(run, f"rid {id_type}, place bigint, k int, tri bigint").join(best, "tri")
    own = better & F.expr("shiftright(mask, k) & 1 = 1")
    log = F.when(own, F.log((F.col("m") + 0.5) / (F.col("n") + 0.5))).otherwise(-F.log((F.col("n") + 0.5) / 0.5))
    judged = votes.groupBy("rid", "place").agg(F.round(F.sum(log), 6).alias("sum"), F.collect_set(F.when(own, F.struct("tri", "k"))).alias("places"))  # at most three
    return judged.where(F.col("sum") >= EVIDENCE).select("rid", F.explode("places").alias("p")).select("rid", "p.tri", "p.k").distinct()


def _folded(line, pairs: list[tuple[str, str]]):
    """A line without spaces, case and confusable characters: what reading differences leave alone."""
    s = F.lower(F.regexp_replace(line, r"(?U)[\s|]+", ""))
    if pairs:
        s = F.translate(s, "".join(p[0] for p in pairs), "".join(p[1] for p in pairs))
    for a, b in (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w")):
        s = F.regexp_replace(s, a, b)
    return F.translate(s, "01!|i58ecо", "ollllsbcco")


def headers(seen: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(rid, source, a): edge lines that at least HEADER_PAGES pages of their file carry, small differences apart."""
    lines = seen.where("what = 'line'").select("rid", "source", "page", "a", "n", _folded(F.col("a"), pairs).alias("sig")).where("length(sig) >= 4")
    counted = materialise(lines.groupBy("source", "sig").agg(F.count_distinct("page").alias("pages")))
    seeds = counted.where(f"pages >= {HEADER_PAGES}").select("source", "sig")
    # Others match a seed if they share its first, middle or last three characters and differ in a sixth at most.
    blocks = lambda c: F.array(F.concat(F.lit("<"), F.substr(c, F.lit(1), F.lit(3))), F.concat(F.lit(">"), F.right(c, F.lit(3))), F.concat(F.lit("="), F.substr(c, F.floor(F.length(c) / 2).cast("int"), F.lit(3))))
    near = (
        counted.where(f"pages < {HEADER_PAGES}").select("source", F.col("sig").alias("other"), F.explode(blocks(F.col("sig"))).alias("block"))
        .join(seeds.select("source", F.col("sig").alias("seed"), F.explode(blocks(F.col("sig"))).alias("block")), ["source", "block"])
        .where(F.levenshtein("other", "seed") <= F.greatest(F.lit(1), F.ceil(F.length("seed") / 6))).select("source", F.col("other").alias("sig")).distinct()
    )
    return lines.join(seeds.unionByName(near), ["source", "sig"], "left_semi").select("rid", "source", "a", "n")


def learn(pages: DataFrame, id_col: str, source_col: str, page_col: str, text_col: str, encodings: tuple[str, ...] = ()):
    """Everything the corpus teaches: observations, confused Han pairs, misread words, contexts, misread trigrams, counts."""
    every = materialise(count_forms(pages, text_col, encodings))
    forms, counts = every.where("bucket is null"), lm.gathered(every.where("bucket is not null").select("bucket", "n"), encodings)
    contexts = Contexts(forms)
    words, solid = misread_words(forms)
    common = pages.sparkSession.createDataFrame([(w,) for w in solid], "word string")
    bad = {r[0] for r in words.join(common, "word", "left_semi").select("word").collect()}  # no more than the vocabulary
    keep = {w for w in solid if w not in bad}
    seen = materialise(observe(pages, id_col, source_col, page_col, text_col, contexts, keep))
    pairs = confused_pairs(seen)
    return seen, pairs, words, contexts, restored(pages, id_col, text_col, forms, pairs), counts


def noise(pages: DataFrame, id_col: str, source_col: str, page_col: str, text_col: str, encodings: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """Distinct (rid, noise) of the pages with running prose; and the counts of lm.count_corpus, which come out of the same scan."""
    seen, pairs, words, _, again, counts = learn(pages, id_col, source_col, page_col, text_col, encodings)
    plain = seen.where("what in ('hyphen', 'page_number', 'number')").select("rid", F.when(F.col("what") == "number", "misread").otherwise(F.col("what")).alias("noise"))
    good = F.array(*[F.lit(a + b) for a, b in pairs]) if pairs else F.array().cast("array<string>")
    han = seen.where("what = 'han'").where(F.array_contains(good, F.concat("a", "b"))).select("rid", F.lit("misread").alias("noise"))
    han = han.unionByName(again.select("rid", F.lit("misread").alias("noise")))
    latin = seen.where("what = 'word'").join(small(words).select(F.col("word").alias("a")), "a").select("rid", F.lit("misread").alias("noise"))
    head = headers(seen, pairs).where("n = 1").select("rid", F.lit("header").alias("noise"))
    return plain.unionByName(han).unionByName(latin).unionByName(head).distinct(), counts


def repair(pages: DataFrame, id_col: str, source_col: str, page_col: str, text_col: str) -> DataFrame:
    """(rid, repaired): pages of running prose without page furniture, words joined and put right, reflowed."""
    seen, pairs, words, contexts, again, _ = learn(pages, id_col, source_col, page_col, text_col)
    drop = headers(seen, pairs).groupBy("rid").agg(F.collect_set("a").alias("drop"))  # at most six lines a page
    fix = seen.where("what = 'word'").join(small(words).select(F.col("word").alias("a"), "true"), "a").groupBy("rid").agg(F.map_from_entries(F.collect_set(F.struct("a", "true"))).alias("fix"))
    put = again.groupBy("rid").agg(F.collect_set(F.struct("tri", "k")).alias("put"))
    good = set(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, (text, lines, fixes, places) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                if text and is_prose(text):
                    keep.append(i)
                    out.append(_repaired(text, set(lines or ()), dict(fixes or ()), good, contexts, [(p["tri"], p["k"]) for p in places or ()]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.string())], names=["rid", "repaired"])

    id_type = pages.schema[id_col].dataType.simpleString()
    joined = pages.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt")).join(drop, "rid", "left").join(fix, "rid", "left").join(put, "rid", "left")
    return joined.select("rid", "txt", "drop", "fix", "put").mapInArrow(run, f"rid {id_type}, repaired string")


def _repaired(text: str, drop: set[str], fixes: dict[str, str], good: set[tuple[str, str]], contexts: Contexts, put: list[tuple[int, int]]) -> str:
    gone = set()
    for i, line in edge_lines(text):
        rest, numbered = without_page_number(line)
        if not rest.strip() or rest.strip() in drop:
            gone.add(i)
    lines = [x for i, x in enumerate(text.split("\n")) if i not in gone]
    body = joined("\n".join(lines))
    body = _TOKEN.sub(lambda m: _like(m[0], fixes[m[0]]) if m[0] in fixes else m[0], body)
    body = _NUMBER.sub(lambda m: m[0].translate(str.maketrans("lIO!|SBZ", "11011582")), body)
    flat = _HAN_GAP.sub("", body)
    wrong = [(c, t) for _, c, t, _ in contexts.events([flat]) if (chr(c), chr(t)) in good]
    if wrong or put:
        chars, true_of = list(flat), dict(good)
        for at, seen, true in _event_places(flat, contexts):
            if (seen, true) in good:
                chars[at] = true
        for tri, k in put:
            form = chr(tri >> 42) + chr(tri >> 21 & _M21) + chr(tri & _M21)
            at = flat.find(form)
            while at >= 0:
                chars[at + k] = true_of[form[k]]
                at = flat.find(form, at + 1)
        flat = "".join(chars)
    out = ""
    for line in flat.split("\n"):  # a line that doesn't end a sentence goes on in the next one
        out += line if not out else ("\n" if _PARAGRAPH_END.search(out) or _HEADING.match(line) or len(out.rsplit("\n", 1)[-1]) < 20 else " ") + line.lstrip()
    return out


_PARAGRAPH_END = re.compile(r"[。！？；.!?:：][\"”’）)]*\s*$")


def _like(seen: str, true: str) -> str:
    return true.capitalize() if seen[:1].isupper() else true


def _event_places(text: str, contexts: Contexts) -> Iterator[tuple[int, str, str]]:
    c = lm.codes(text).astype(np.int64)
    pad = np.concatenate([[0, 0], c, [0, 0]])
    p2, p1, c0, n1, n2 = pad[:-4], pad[1:-3], pad[2:-2], pad[3:-1], pad[4:]
    left, mid, right = contexts._look("left", p2 << 21 | p1), contexts._look("mid", p1 << 21 | n1), contexts._look("right", n1 << 21 | n2)
    likely = np.where(mid > 0, mid, np.where(right > 0, right, left))
    for i in np.flatnonzero((likely > 0) & (left != c0) & (mid != c0) & (right != c0)):
        yield int(i), chr(c0[i]), chr(likely[i])
