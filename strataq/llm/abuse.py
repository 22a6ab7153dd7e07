"""Problem 10: abusive, hateful or sexual content, scored per document and kind.

A softmax classifier over sentences, trained here on the labelled snippets (a bounded sample: at most
`MAX_SAMPLES` rows). Counterfactual regularisation: identity terms in labelled sentences are swapped for others and
differences of the scores are penalised, so that naming a group neither raises nor lowers a score. Disguises
(marks or spaces between characters, digits and asterisks for letters) are undone before features are taken.
Documents are cut into clauses over their whole text; every run of up to `WINDOW` clauses is scored, and the score of
a kind is the maximum.

Defined results: null and blank texts score 0; copies score alike; sources are rated over all their documents, a null
source among them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import lm

KINDS = ("none", "abuse", "hate", "sexual")
MAX_SAMPLES = 20_000
L2, COUNTERFACTUAL, STEPS, RATE = 1e-4, 1.0, 300, 1.0
#: Consecutive clauses that are scored together.
WINDOW = 3
THRESHOLD = 0.5

# Terms that name groups of people, neutral and derogatory alike.
IDENTITY = {
    "zh": ["外地人", "乡下佬", "乡下人", "残废", "残疾人", "女人", "老女人", "娘娘腔", "信教的", "单亲家的", "南边来的", "北边来的", "外国佬", "外国人", "农民工", "少数民族", "移民", "老年人", "单亲家庭", "外地"],
    "en": ["migrants", "foreigners", "cripples", "disabled people", "unbelievers", "old hags", "island people", "women", "immigrants", "believers", "farmers", "elderly people", "refugees"],
}
_GAP = r"[·•*_.\-~|+^/\\\s]"
_BETWEEN_HAN = re.compile(rf"(?<=[㐀-鿿]){_GAP}{{1,3}}(?=[㐀-鿿])")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9*] ){2,}[a-z0-9*](?![a-z0-9])")
_LEET = str.maketrans("01345780@$", "oieastboas")
_TOKEN = re.compile(r"[a-z0-9*@$']+")
_HAN = re.compile(r"[㐀-鿿]+")
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf") + "]")
_CLAUSE = re.compile(r"[，。！？!?；;\n]+|(?<=[a-z]{2})\.(?=[\s\"”]|$)|,\s")
_WRAP = re.compile(r"(?<=[㐀-鿿]{2})[ \t]*\n[ \t]*(?=[㐀-鿿])")


def undisguise(text: str, words: frozenset[str] = frozenset()) -> str:
    """One form: compatibility characters, lower case, nothing between the characters of a word, letters for digits."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = _FORMAT.sub("", t)
    if _BETWEEN_HAN.search(t):
        t = _BETWEEN_HAN.sub("", t)
    if _SPACED.search(t):
        t = _SPACED.sub(lambda m: m[0].replace(" ", ""), t.replace("   ", "\x00")).replace("\x00", " ")

    def letters(m: re.Match) -> str:
        w = m[0]
        if not re.search("[a-z]", w) or not re.search("[0-9*@$]", w):
            return w
        w = w.translate(_LEET)
        if "*" in w:
            p = re.compile(re.escape(w).replace(r"\*", "[a-z]"))
            w = next((x for x in sorted(words) if p.fullmatch(x)), w)
        return w

    return _TOKEN.sub(letters, t) if re.search(r"[0-9*@$]", t) else t


_LATIN = re.compile("[a-z*']")


def latin_features(sentence: str) -> set[str]:
    tokens = re.findall(r"[a-z*']+", sentence)
    return {"w:" + w for w in tokens} | {"b:" + a + " " + b for a, b in zip(tokens, tokens[1:])}


def features(sentence: str) -> set[str]:
    """Han n-grams up to 3, words and pairs of words; of an undisguised sentence."""
    out = latin_features(sentence)
    for run in _HAN.findall(sentence):
        for n in (1, 2, 3):
            out.update(run[i : i + n] for i in range(len(run) - n + 1))
    return out


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text) if c and not c.isspace()]


class Rows:
    """Rows of 0 and 1 as the places of the ones, each row scaled to length 1; a last column is 1 in every row."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        lengths = np.array([len(r) + 1 for r in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), lengths)
        self.col = np.array([c for r in rows for c in (*r, width - 1)], dtype=np.int64)
        self.value = (1 / np.sqrt(np.maximum(1, lengths)))[self.row].astype(np.float32)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=w[self.col, k] * self.value, minlength=self.n) for k in range(w.shape[1])], 1).astype(np.float32)

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.col, weights=g[self.row, k] * self.value, minlength=self.width) for k in range(g.shape[1])], 1).astype(np.float32)


class Model:
    def __init__(self, samples: list[tuple[str, str]]):
        rough = [undisguise(t) for t, _ in samples]
        self.words = frozenset(w for t, (_, k) in zip(rough, samples) if k != "none" for w in re.findall("[a-z]{3,}", t))
        clean = [undisguise(t, self.words) for t, _ in samples]
        feats = [features(t) for t in clean]
        names = sorted(set().union(*feats)) if feats else []
        self.index = {f: i for i, f in enumerate(names)}
        y = np.array([KINDS.index(k) for _, k in samples], dtype=np.int64)
        swaps = [(i, s) for i, t in enumerate(clean) for s in self._swapped(t)]
        x = Rows([[self.index[a] for a in f] for f in feats], len(names) + 1)
        z = Rows([[self.index[a] for a in features(s) if a in self.index] for _, s in swaps], len(names) + 1)
        self.w = self._train(x, y, z, np.array([i for i, _ in swaps], dtype=np.int64))
        # Han n-grams are looked up by hash: sorted hashes and their places, one table for each length.
        self.grams = {}
        for n in (1, 2, 3):
            own = [f for f in names if len(f) == n and _HAN.fullmatch(f)]
            h = np.array([_hashes(lm.codes(f), n)[0] for f in own], dtype=np.uint64)
            order = np.argsort(h)
            self.grams[n] = (h[order], np.array([self.index[f] for f in own], dtype=np.int64)[order])

    @staticmethod
    def _swapped(text: str) -> list[str]:
        out = []
        for terms in IDENTITY.values():
            held = max((t for t in terms if t in text), key=len, default=None)
            if held:
                out += [text.replace(held, other) for other in terms if other != held]
        return out

    @staticmethod
    def _train(x, y, z, pair) -> np.ndarray:
        n, w = x.n, np.zeros((x.width, len(KINDS)), dtype=np.float32)
        if not n:
            return w
        target = np.eye(len(KINDS), dtype=np.float32)[y]
        weight = (n / (len(KINDS) * np.maximum(1, target.sum(0))))[y][:, None].astype(np.float32)
        m = np.zeros_like(w)
        for _ in range(STEPS):
            s = x.times(w)
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.transposed_times((p - target) * weight) / n
            if z.n:  # scores of a sentence and its counterfactuals should agree
                diff = z.times(w) - s[pair]
                g += COUNTERFACTUAL * (z.transposed_times(diff) - x.transposed_times(_sum_by(diff, pair, n))) / z.n
            m = 0.9 * m + g + L2 * w
            w -= RATE * m
        return w

    def clauses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the weights of its features, number of features) of each clause; n-grams of all clauses are taken at once."""
        clean = [undisguise(t, self.words) for t in texts]
        total, count = np.zeros((len(texts), len(KINDS))), np.zeros(len(texts), dtype=np.int64)
        c = lm.codes("\x00".join(clean) + "\x00")
        of = np.cumsum(c == 0) - (c == 0)  # the clause of each character
        han = (c >= 0x3400) & (c <= 0x9FFF)
        for n in (1, 2, 3):
            if len(c) < n:
                continue
            ok = np.logical_and.reduce([han[k : len(c) - n + 1 + k] for k in range(n)])
            h, mine = _hashes(c, n)[ok], of[: len(c) - n + 1][ok]
            order = np.lexsort((h, mine))
            h, mine = h[order], mine[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (mine[1:] != mine[:-1])
            h, mine = h[new], mine[new]
            count += np.bincount(mine, minlength=len(texts))
            keys, place = self.grams[n]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                for k in range(len(KINDS)):
                    total[:, k] += np.bincount(mine[hit], weights=self.w[place[at[hit]], k], minlength=len(texts))
        for i, t in enumerate(clean):
            if _LATIN.search(t):
                f = latin_features(t)
                count[i] += len(f)
                words = [x for x in f if x[:2] == "w:"]
                if len(words) < 3 or sum(x in self.index for x in words) * 3 >= len(words):  # else another language of the alphabet
                    total[i] += self.w[[self.index[x] for x in f if x in self.index]].sum(0)
        return total, count

    def documents(self, texts: list[str]) -> np.ndarray:
        """Largest probabilities of KINDS over the runs of up to WINDOW clauses of each text; wrapped lines are read with and without their ends."""
        out = np.zeros((len(texts), len(KINDS)))
        parts: list[str] = []
        doc: list[int] = []  # of each clause; a reading of a text is a run of equal numbers
        owner: list[int] = []
        for i, t in enumerate(texts):
            for reading in (t, _WRAP.sub("", t)) if t and _WRAP.search(t) else (t,) if t else ():
                cs = clauses(reading)
                parts += cs
                doc += [len(owner)] * len(cs)
                owner.append(i)
        if not parts:
            return out
        once = {c: k for k, c in enumerate(dict.fromkeys(parts))}
        total, count = self.clauses(list(once))
        at = np.array([once[c] for c in parts])
        reading, owner_of = np.array(doc), np.array(owner)[doc]
        sums, counts = np.concatenate([np.zeros((1, len(KINDS))), np.cumsum(total[at], 0)]), np.concatenate([[0], np.cumsum(count[at])])
        for k in range(1, WINDOW + 1):
            if len(parts) < k:
                break
            s = (sums[k:] - sums[:-k] + self.w[-1]) / np.sqrt(counts[k:] - counts[:-k] + 1)[:, None]
            p = np.exp(s - s.max(1, keepdims=True))
            whole = reading[k - 1 :] == reading[: len(parts) - k + 1]
            np.maximum.at(out, owner_of[k - 1 :][whole], (p / p.sum(1, keepdims=True))[whole])
        return out


def _hashes(c: np.ndarray, n: int) -> np.ndarray:
    """One number for each n-gram of code points below 2^21; no two share one."""
    h = np.zeros(max(0, len(c) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = h << np.uint64(21) | c[k : len(c) - n + 1 + k].astype(np.uint64)
    return h


def _sum_by(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    np.add.at(out, keys, rows)
    return out


def train(samples: DataFrame, text_col: str, label_col: str) -> Model:
    """Fitted on at most MAX_SAMPLES labelled rows, a quarter of each label, by the order of their digests."""
    named = samples.where(F.col(text_col).isNotNull()).select(text_col, label_col)
    rows = [r for k in KINDS for r in named.where(F.col(label_col) == k).orderBy(F.md5(text_col), text_col).limit(MAX_SAMPLES // len(KINDS)).collect()]
    return Model([(r[0], r[1]) for r in rows])


def scores(docs: DataFrame, id_col: str, source_col: str, text_col: str, model: Model) -> DataFrame:
    """(doc, source, kind, score) for every document and kind."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.documents(b.column(2).to_pylist())[:, 1:]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(s[:, i]) for i in range(len(KINDS) - 1)]], names=["doc", "source", *KINDS[1:]])

    wide = docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), text_col).mapInArrow(run, f"doc {id_type}, source string, " + ", ".join(f"{k} double" for k in KINDS[1:]))
    return wide.select("doc", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS[1:]])).alias("x")).select("doc", "source", "x.*")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, kind, documents, found, rate) over all documents of each source."""
    found = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0))
    return scored.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("documents"), found.alias("found"), (found / F.count(F.lit(1))).alias("rate"))
