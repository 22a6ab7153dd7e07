"""Problem 4: text that was decoded with the wrong character encoding.

An unknown code-page swap is a substitution cipher per source: each symbol shown (a character, or a row or cell code of a
wrong page of two bytes a character) stands for one byte of the true text. Stretches are grouped first: the groups are
pairs of pages (bytes were written in `true`, read as `wrong`), some applied twice, and how common each is in a source
is learned by EM from the likelihood of its stretches. The table from symbols to bytes is then learned by EM from the
symbol pairs of a group against the byte pairs of the corpus in the true encoding; the page only starts it. A source
whose pairs disagree with what all sources teach learns its own. Stretches that no pair of pages explains are learned
from nothing, for their source: as bytes of each true encoding and as letters of each alphabet of the corpus, and taken
if the table saves more than it costs. Tables are applied with translate(), and a stretch counts if what it becomes is
likelier than what it was. Units that lost a byte are read by their prefix and context.

The language is learned from the first field: short fields that many rows share, such as file names, would teach
their own damage.

Defined results: null and empty fields are never cases; a field is a case if at least one stretch is more probably
deciphered than clean, restorable or not (lost bytes show as U+FFFD in the restored text). Repeated ids give one row
each field.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.common import materialise, small
from strataq.llm import cipher, lm

#: (name, encodings to write the shown text in, in turn; encodings to read the bytes in, in turn). "latin" writes
#: Windows-1252 where it can and the same-numbered control characters elsewhere.
SWAPS = (
    ("utf8-latin", ("latin",), ("utf-8",)),
    ("utf8-latin-twice", ("latin", "latin"), ("utf-8", "utf-8")),
    ("utf8-cp1251", ("cp1251x",), ("utf-8",)),
    ("utf8-koi8", ("koi8-r",), ("utf-8",)),
    ("utf8-cp437", ("cp437",), ("utf-8",)),
    ("utf8-macroman", ("mac-roman",), ("utf-8",)),
    ("utf8-gbk", ("gb18030",), ("utf-8",)),
    ("utf8-big5", ("cp950",), ("utf-8",)),
    ("utf8-sjis", ("cp932",), ("utf-8",)),
    ("utf8-euckr", ("cp949",), ("utf-8",)),
    ("gbk-latin", ("latin",), ("gb18030",)),
    ("gbk-cp1251", ("cp1251x",), ("gb18030",)),
    ("gbk-big5", ("cp950",), ("gb18030",)),
    ("gbk-sjis", ("cp932",), ("gb18030",)),
    ("gbk-euckr", ("cp949",), ("gb18030",)),
    ("big5-gbk", ("gb18030",), ("cp950",)),
    ("big5-latin", ("latin",), ("cp950",)),
    ("sjis-latin", ("latin",), ("cp932",)),
    ("sjis-gbk", ("gb18030",), ("cp932",)),
    ("cp1251-latin", ("latin",), ("cp1251",)),
    ("koi8-cp1251", ("cp1251x",), ("koi8-r",)),
    ("cp1251-koi8", ("koi8-r",), ("cp1251",)),
)
CLASSES = ("clean", *(s[0] for s in SWAPS), "lost")


def _usual() -> set[str]:
    """Characters of ordinary text here: ASCII, first-level GB 2312 Han (by rule), usual marks, accented Latin, Cyrillic."""
    han = {bytes((a, b)).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)} - {""}
    marks = "，。；：！？、（）《》【】“”‘’—–…·•℃Ωμ³²±×÷°①②③④⑤⑥⑦⑧⑨⑩㎡％§●■◆▲□※○★－～「」『』〔〕　"
    latin = {chr(c) for c in range(0xC0, 0x100)} - {"×", "÷"}
    cyrillic = {chr(c) for c in range(0x410, 0x450)} | {"Ё", "ё"}
    return {chr(c) for c in range(0x20, 0x7F)} | {"\n", "\r", "\t"} | han | set(marks) | latin | cyrillic


USUAL = _usual()
#: A trigger is anything unusual but look-alikes and invisible characters, runs of accented Latin, or an accented or Cyrillic letter beside a mark or the other script.
_PLAIN = {chr(c) for a, z in ((0x2000, 0x200F), (0x2010, 0x2012), (0x2060, 0x2060), (0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0x300, 0x36F)) for c in range(a, z + 1)} | set("\u00a0\u00ad\u202f\ufeffµ¬")
TRIGGER = re.compile("[^" + re.escape("".join(sorted(USUAL | _PLAIN))) + "]|[À-ÿ]{2}|[À-ÿА-яЁё][±°³²·×÷§•–—…“”‘’]|[À-ÿ][А-яЁё]|[А-яЁё][À-ÿ]|[a-zA-Z][А-яЁё]|[А-яЁё][‘’“”–—…]|[ÂÃ][^a-zA-Z]")
#: A stretch ends at a mark that garbling would not have left alone.
_STOP = re.compile(r"[，。；：！？、（）《》【】\n\t|]+")
_KNOWN = np.zeros(0x10001, dtype=bool)
for _c in USUAL:
    _KNOWN[ord(_c)] = True
LOST = "\ufffd"
_KNOWN[0xFFFD] = True
#: A byte that fits no letter under a class is kept as U+F700 + byte; log-probabilities of such a byte, and of U+FFFD itself.
_BAD = 0xF700
_BAD_LOGP, _LOST_LOGP = -16.0, -3.0
#: A class must beat `clean` by this much (natural log) to be a candidate at all.
MARGIN = 4.0


def _keep_bytes(e: UnicodeError) -> tuple[str, int]:
    return "".join(chr(_BAD + b) for b in e.object[e.start : e.end]), e.end


def _mark_chars(e: UnicodeError) -> tuple[bytes, int]:
    return b"\x1a" * (e.end - e.start), e.end


codecs.register_error("strataq_bytes", _keep_bytes)
codecs.register_error("strataq_mark", _mark_chars)
_CP1252 = {ord(c.decode("cp1252")): c for c in (bytes((b,)) for b in range(0x80, 0xA0)) if c not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d")}
_TO_LATIN = {k: chr(v[0]) for k, v in _CP1252.items()}


def _encode(text: str, enc: str, lost: str) -> bytes:
    text = text.replace(LOST, lost)
    if enc == "latin":
        return text.translate(_TO_LATIN).encode("latin-1", "strataq_mark")
    if enc == "cp1251x":  # the two numbers that Windows-1251 lacks or shows as spaces
        return b"\x98".join(part.encode("cp1251", "strataq_mark") for part in text.split("\x98"))
    if lost != "\x1a":
        return _PAIR_LEAD.join(part.encode(enc, "strataq_mark") for part in text.split(lost))
    return text.encode(enc, "strataq_mark")


#: In encodings of two bytes a lost byte takes the next one with it; it is written as a lead byte of rare letters.
_PAIR_LEAD = b"\x81"
_PAIRED = ("gb18030", "cp950", "cp932")


def _decipher_fast(text: str, swap: tuple) -> tuple[str, int]:
    """The stretch read under a swap, with U+FFFD for what fits no letter; and how many characters the wrong encoding doesn't have."""
    missing = 0
    for write, read in zip(swap[1], swap[2]):
        if write == "latin":
            raw = text.translate(_TO_LATIN).encode("latin-1", "replace")
        elif write == "cp1251x":
            raw = b"\x98".join(part.encode("cp1251", "replace") for part in text.split("\x98"))
        elif read in _PAIRED and write != "koi8-r":
            raw = _PAIR_LEAD.join(part.encode(write, "replace") for part in text.split(LOST))
        else:
            raw = text.encode(write, "replace")
        missing += raw.count(b"?") - text.count("?")
        text = raw.decode(read, "replace")
    return text, missing


def log_likelihood(text: str, model: lm.Bigrams, clean: bool = False) -> float:
    s, c = model.scores(text, _KNOWN), lm.codes(text)
    return float(np.where(c == 0xFFFD, _BAD_LOGP if clean else _LOST_LOGP, np.where((c >= _BAD) & (c < _BAD + 256) | (c == 0x1A), _BAD_LOGP, s)).sum())


_WIDE = re.compile("[\u0370-\u03ff\u0e00-\u0e7f\u1100-\u11ff\u2460-\uffff]")


_PLAUSIBLE = np.ones(0x10001, dtype=bool)
_PLAUSIBLE[[ord(c) for c in USUAL | _PLAIN]] = False
_PLAUSIBLE[[*range(0xC0, 0x100), *range(0x410, 0x450), 0x401, 0x451]] = True


def plausible(texts: list[str | None]) -> np.ndarray:
    """Which texts hold a character that every match of TRIGGER needs: an unusual one, an accented or a Cyrillic letter."""
    sizes = np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))
    if not len(sizes):
        return np.zeros(0, dtype=bool)
    c = lm.codes("\n".join(t or "" for t in texts) + "\n")
    return np.logical_or.reduceat(_PLAUSIBLE[np.minimum(c, 0x10000)], np.cumsum(sizes) - sizes)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of parts worth a try, between marks that garbling can't leave: any trigger but a few rare Han."""
    if not TRIGGER.search(text):
        return
    at = 0
    for m in [*_STOP.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at and TRIGGER.search(text, at, end):
            hits = TRIGGER.findall(text, at, end)
            if len(hits) >= 0.15 * (end - at) or not all("\u4e00" <= h[0] <= "\u9fff" for h in hits):
                if _WIDE.search(text, at, end):
                    yield at, end
                else:  # words of alphabets stand alone
                    for w in re.finditer(r"[^ ]+", text[at:end]):
                        if TRIGGER.search(text, at + w.start(), at + w.end()):
                            yield at + w.start(), at + w.end()
        at = m.end() if m else end


_SCRIPTS = {w: re.compile(p) for w, p in {
    "latin": "[\u0080-\u00ff\u0152-\u0192\u02c6\u02dc\u2013-\u2122]", "cp1251x": "[\u0080-\u00bf\u0401-\u0491\u2013-\u2122]", "koi8-r": "[\u0080-\u00bf\u0401-\u0491\u2219-\u25a0]",
    "cp437": "[\u0080-\u00ff\u0192\u0393-\u03c6\u207f-\u25a0]", "mac-roman": "[\u0080-\u00ff\u0131-\u02dd\u2013-\u25ca\uf8ff\ufb01\ufb02]",
    "gb18030": "[\u2010-\u33ff\u4e00-\u9fff\ue000-\ue864\uff01-\uffe5\u0391-\u0451]", "cp950": "[\u2010-\u33ff\u4e00-\u9fff\ue000-\uf8ff\uff01-\uffe5\u0391-\u0451\u02c7-\u02d9]",
    "cp932": "[\uff61-\uff9f\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5e\u2010-\u266f\u0391-\u0451]", "cp949": "[\uac00-\ud7a3\u3000-\u33ff\u4e00-\u9fff\uf900-\ufa0b]",
}.items()}
_NON_ASCII = re.compile("[^\x00-\x7f\ufffd]")
#: What a deciphered stretch must gain: letters and the marks that wrong decoding damages.
_GAIN = np.zeros(0x10001, dtype=bool)
for _c in USUAL:
    _GAIN[ord(_c)] = _c > "\x7f" and _c not in "①②③④⑤⑥⑦⑧⑨⑩●■◆▲□※○★"
#: Mean log-probability that the gained characters need; typographic marks and accented letters are rare by themselves.
_GAINED_LOGP, _MARK_LOGP = -8.5, -14.5
_MARKS = np.zeros(0x10001, dtype=bool)
_MARKS[[ord(c) for c in "“”‘’–—…°±²³·•éöüÅÑåäÉÖÜñèà"]] = True


def class_scores(obs: str, model: lm.Bigrams) -> list[float] | None:
    """log-likelihood under each class, or None if no class comes near."""
    clean = log_likelihood(obs, model, clean=True)
    odd = max(1, len(_NON_ASCII.findall(obs)))
    out = [clean]
    fits: dict[str, bool] = {}
    for swap in SWAPS:
        wrong = swap[1][0]
        if wrong not in fits:
            fits[wrong] = len(_SCRIPTS[wrong].findall(obs)) >= 0.75 * odd
        if not fits[wrong]:
            out.append(-1e9)
            continue
        text, missing = _decipher_fast(obs, swap)
        lost = text.count(LOST) + missing
        if lost > 0.5 * len(text):
            out.append(-1e9)
            continue
        c = lm.codes(text)
        low = np.minimum(c, 0x10000)
        gain = _GAIN[low]
        n = int(gain.sum())
        if not n or lost > 2 * n:
            out.append(-1e9)
            continue
        s = np.where(c == 0xFFFD, _BAD_LOGP, model.scores(text, _KNOWN))
        good = text != obs and s[gain].mean() > (_MARK_LOGP if _MARKS[low[gain]].all() else _GAINED_LOGP)
        out.append(float(s.sum()) + _BAD_LOGP * missing if good else -1e9)
    # Bytes replaced before they were decoded again: the replacement sign itself, as such or written out.
    signs = sum(obs.count(x) for x in "锟斤拷\ufffd")
    out.append(-1.2 * signs - 12.0 * (odd - signs) - 5.0 * (len(obs) - odd) if "锟斤拷" in obs or LOST in obs else -1e9)
    return out if max(out[1:]) > clean + MARGIN else None


_NARROW = re.compile("[\u0080-\u024f\u0400-\u052f\u2010-\u2122]")
_SWITCH = re.compile("(?<=[\u4e00-\u9fff\ue000-\uf8ff\uff01-\uffef])(?=[\u0080-\u024f\u0400-\u052f])|(?<=[\u0080-\u024f\u0400-\u052f\u2010-\u2122])(?=[\u4e00-\u9fff\ue000-\uf8ff\uff01-\uffef])")


def scored_parts(text: str, model: lm.Bigrams) -> Iterator[tuple[int, int, list[float] | None]]:
    """The stretches of a text with their scores; one that fits no class is tried again by script."""
    for a, z in stretches(text):
        ll = class_scores(text[a:z], model)
        if not ll:  # the garbled part alone, where clean text follows without a mark
            hits = [m.start() for m in TRIGGER.finditer(text, a, z)]
            if len(hits) >= 3 and hits[-1] - hits[0] < 0.8 * (z - a):
                for start in {max(a, hits[0] - 1), hits[0]}:
                    part = class_scores(text[start : hits[-1] + 1], model)
                    if part:
                        yield start, hits[-1] + 1, part
                        break
                else:
                    part = None
                if part:
                    continue
        if ll or len(_NARROW.findall(text, a, z)) < 4:
            yield a, z, ll
            continue
        at = a
        for m in [*_SWITCH.finditer(text, a, z), None]:
            end = m.start() if m else z
            if end > at and TRIGGER.search(text, at, end):
                ll = class_scores(text[at:end], model)
                if ll or end - at < 24:
                    yield at, end, ll
                else:
                    yield from _halves(text, at, end, model)
            at = end


def _halves(text: str, a: int, z: int, model: lm.Bigrams) -> Iterator[tuple[int, int, list[float] | None]]:
    """Parts of a stretch that changes its encoding somewhere inside one script, halved down to 24 characters."""
    ll = class_scores(text[a:z], model)
    if ll or z - a < 48:
        yield a, z, ll
    else:
        yield from _halves(text, a, (a + z) // 2, model)
        yield from _halves(text, (a + z) // 2, z, model)


#: True encodings whose byte pairs are always counted over the corpus; those of the other classes where such a class shows.
TRUE, RARE = ("utf-8", "gb18030"), ("cp950", "cp932", "cp1251", "koi8-r")
#: Wrong pages that hold two bytes a character: their characters are read as row and cell codes, two symbols each.
_TWO_BYTE = ("gb18030", "cp950", "cp932", "cp949")
#: Stands for a lost character among row and cell codes.
_GONE = "Ā"
#: Deciphered pairs that the language has to know, and distinct letters that a cipher without a known page has to show.
CIPHER_KNOWN, CIPHER_LETTERS = 0.9, 8
#: Observations that one symbol of the starting table counts for.
START_WEIGHT = 10.0
#: What a source's own table has to gain over the pooled one for each symbol it reads otherwise (natural log; some six unknown pairs).
OWN_COST = 60.0
_SYMBOL = re.compile("[ -ԯ֐-๿‐-⏿─-◿-ﬁﬂ\u0080-\u009f]")
_NOT_SYMBOL = re.compile("[ᄀ-ᇿ⺀-퟿豈-﫿＀-￯]")
#: Alphabets by script; those the corpus uses are candidates for ciphers of one symbol a letter.
_SCRIPT_RANGES = {"latin": (0xC0, 0x24F), "greek": (0x391, 0x3CE), "cyrillic": (0x401, 0x45F), "armenian": (0x531, 0x586), "hebrew": (0x5D0, 0x5EA), "arabic": (0x621, 0x64A), "thai": (0xE01, 0xE4E), "kana": (0x3041, 0x30FE)}


def base_class(cls: str) -> str:
    """The class whose table deciphers it: a swap applied twice has the table of the single one."""
    return cls.removesuffix("-twice")


_SWAP = {s[0]: s for s in SWAPS}


def symbols(obs: str, cls: str) -> str:
    """A stretch as symbols: its characters, or the row and cell codes of a page of two bytes (as characters below U+0100)."""
    write = _SWAP[cls][1][0]
    if write not in _TWO_BYTE:
        return obs.replace(LOST, _GONE)
    return _GONE.join(part.encode(write, "strataq_mark").decode("latin-1").replace("\x1a", _GONE) for part in obs.split(LOST))


def _page(cls: str, syms: str) -> str:
    """What the class's page has for the symbols, as bytes; _GONE where it has nothing."""
    write = _SWAP[cls][1][0]
    if write in _TWO_BYTE:
        return syms
    return "".join(_GONE if s == _GONE or raw == b"\x1a" else raw.decode("latin-1") for s in syms for raw in (_encode(s, write, "\x1a"),))


def read_symbols(syms: str, cls: str, table: dict[int, str]) -> str:
    """The plain text: symbols become bytes by translate(), bytes are read in the true encoding; what fits no letter stays marked."""
    swap = _SWAP[base_class(cls)]
    lost = "\x81" if swap[2][0] in _PAIRED and swap[1][0] in _TWO_BYTE else "\x1a"
    text = syms
    for _ in range(len(_SWAP[cls][1])):
        out, at = [], 0
        for m in [*_NOT_SYMBOL.finditer(text), None] if swap[1][0] not in _TWO_BYTE else [None]:  # clean characters of other kinds stay
            raw = "".join(c if c <= "\xff" else lost for c in text[at : m.start() if m else None].translate(table))
            out += [raw.encode("latin-1").decode(swap[2][0], "strataq_bytes"), m[0] if m else ""]
            at = m.end() if m else 0
        text = "".join(out)
    return text


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, cls, x, y, n) of the adjacent symbols of stretches, at least one of them not ASCII."""
    for b in batches:
        seen: dict[tuple[str, str, str, str], int] = {}
        for source, cls, obs in zip(*(b.column(i).to_pylist() for i in range(3))):
            syms = symbols(obs, cls) if cls in _SWAP else obs
            for x, y in zip(syms, syms[1:]):
                if (x > "\x7f" or y > "\x7f") and x != _GONE and y != _GONE and not _NOT_SYMBOL.match(x) and not _NOT_SYMBOL.match(y):
                    seen[source, cls, x, y] = seen.get((source, cls, x, y), 0) + 1
        cols = list(zip(*seen)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(seen.values(), pa.int64())], names=["source", "cls", "x", "y", "n"])


def _counted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[str, np.ndarray]:
    """The symbols in order, and the matrix of their pair counts; x and y are code points."""
    syms = np.unique(np.concatenate([x, y]))
    m = np.zeros((len(syms), len(syms)))
    np.add.at(m, (np.searchsorted(syms, x), np.searchsorted(syms, y)), n)
    return "".join(map(chr, syms.tolist())), m


def byte_bigrams(counts: np.ndarray, enc: str) -> np.ndarray:
    """Adjacent bytes of the corpus in an encoding; pairs of ASCII, which say nothing about a cipher, aside."""
    if len(counts) < lm.size_of((*TRUE, *RARE)) and enc in RARE:
        return np.zeros((256, 256))
    i = (*TRUE, *RARE).index(enc)
    m = counts[lm.SIZE + (i << 16) : lm.SIZE + (i + 1 << 16)].reshape(256, 256).astype(float)
    m[:128, :128] = 0
    return m


def _pinned(syms: str) -> np.ndarray:
    return np.array([ord(s) if s < "\x80" else -1 for s in syms])


def learn_page(syms: str, m: np.ndarray, cls: str, counts: np.ndarray, start: dict[int, str] | None = None) -> str:
    """The byte of each symbol, learned by EM from symbol pairs, started from the class's page or from a table already learned."""
    bigrams = byte_bigrams(counts, _SWAP[cls][2][0])
    guess = syms.translate(start) if start else _page(cls, syms)
    n = len(syms)
    b = np.zeros((256, n + 1))  # the last symbol stands for those not seen here
    for i, g in enumerate(guess):
        if g <= "\xff":
            b[ord(g), i] = 1.0
    b[b.sum(1) == 0, n] = 1.0
    post, _ = cipher.learn(np.pad(m, (0, 1)), bigrams, np.append(_pinned(syms), -1), 128, b, START_WEIGHT, rounds=12)
    return "".join(map(chr, post[:, :n].argmax(0)))


def _alphabets(counts: np.ndarray) -> list[tuple[str, list[str], np.ndarray]]:
    """(name, letters with ASCII first, bigrams) of the scripts that make up at least 1e-5 of the corpus."""
    out = []
    total = max(1, counts[1 << lm.PAIR_BITS : lm.SIZE].sum())
    for name, (lo, hi) in _SCRIPT_RANGES.items():
        own = [chr(c) for c in range(lo, hi + 1) if counts[(1 << lm.PAIR_BITS) + c] > 0 and chr(c).isalpha() and (name != "latin" or chr(c) in USUAL)]
        if not own or sum(int(counts[(1 << lm.PAIR_BITS) + ord(c)]) for c in own) < 1e-5 * total:
            continue
        letters = [chr(c) for c in range(128)] + own
        c = np.array([ord(x) for x in letters], dtype=np.uint32)
        m = counts[lm.pair_bucket(np.repeat(c, len(c)), np.tile(c, len(c))).astype(np.int64)].reshape(len(c), len(c)).astype(float)
        m[:128, :128] = 0
        if name == "latin":  # accented letters side by side are mostly damage themselves
            m[128:, 128:] = 0
        out.append((name, letters, m))
    return out


def learn_cipher(syms: str, m: np.ndarray, counts: np.ndarray, alphabets: list) -> tuple[str, str] | None:
    """(encoding or '', plain letter or byte of each symbol) of a source whose page is unknown, learned from nothing; None if nothing fits.

    Candidates are the bytes of each true encoding and the letters of each alphabet of the corpus. The best has to save
    more than its table costs (the log of the letters for each symbol), and its pairs have to be known to the language.
    """
    free = [i for i, s in enumerate(syms) if s > "\x7f"]
    if len(free) < CIPHER_LETTERS or m.sum() < len(free):  # no table could save what it costs
        return None
    ends = m.sum(0) + m.sum(1)
    best: tuple[float, tuple[str, str] | None] = (0.0, None)
    held = {ord(s) for s in syms if s < "\x80"}
    candidates = [(enc, [chr(c) for c in range(256)], byte_bigrams(counts, enc)) for enc in TRUE]
    for name, letters, bigrams in [*candidates, *(("", a[1], a[2]) for a in alphabets)]:
        # Letters that the corpus doesn't use, and ASCII that the source doesn't show, stand for nothing here.
        seen = [k for k in range(len(letters)) if (k in held if k < 128 else bigrams[k].any() or bigrams[:, k].any())]
        if len(free) > len(seen) - len(held):
            continue
        letters, bigrams = [letters[k] for k in seen], bigrams[np.ix_(seen, seen)]
        place = {c: k for k, c in enumerate(letters)}
        pinned = np.array([place[s] if s < "\x80" else -1 for s in syms])
        # A short run shows whether the language could know the pairs at all.
        table = cipher.learn(m, bigrams, pinned, len(held), rounds=20, restarts=1)[0].argmax(0)
        if (m * (bigrams[table][:, table] > 0)).sum() < 0.6 * m.sum():
            continue
        post, fit = cipher.learn(m, bigrams, pinned, len(held), rounds=60, restarts=4)
        table = post.argmax(0)
        known = (m * (bigrams[table][:, table] > 0)).sum() / max(1.0, m.sum())
        plain = "".join(letters[k] for k in table)
        # Without a table every symbol is drawn from all of its sort alike.
        gain = m.sum() * fit + ends[free].sum() * np.log(len(free)) + (ends.sum() - ends[free].sum()) * np.log(96) - len(free) * np.log(len(letters))
        changed = sum(plain[i] != syms[i] for i in free)
        if known >= CIPHER_KNOWN and len({plain[i] for i in free}) >= CIPHER_LETTERS and changed > len(free) / 2 and gain > best[0]:
            best = (gain, (name, plain))
    return best[1]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of one (source, cls) in sorted pair rows; symbols as code points."""
    key: tuple[str, str] | None = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joined() -> tuple[str, str, np.ndarray, np.ndarray, np.ndarray]:
        x, y, n = held[0] if len(held) == 1 else (np.concatenate(c) for c in zip(*held))
        return *key, x, y, n

    for b in batches:
        if not b.num_rows:
            continue
        source, cls = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        s, c = source.indices.to_numpy(), cls.indices.to_numpy()
        names, kinds = source.dictionary.to_pylist(), cls.dictionary.to_pylist()
        x, y, n = lm.codes("".join(b.column(2).to_pylist())), lm.codes("".join(b.column(3).to_pylist())), b.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (c[1:] != c[:-1])) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if (names[s[a]], kinds[c[a]]) != key:
                if held:
                    yield joined()
                key, held = (names[s[a]], kinds[c[a]]), []
            held.append((x[a:z], y[a:z], n[a:z]))
    if held:
        yield joined()


_TABLE = "source string, cls string, enc string, src string, dst string"


def learn_tables(stretches: DataFrame, counts: np.ndarray) -> tuple[dict[str, tuple[str, str]], DataFrame]:
    """Tables symbol -> byte: pooled ones by class (what all sources teach), and those of the sources that teach otherwise.

    A page only starts the EM. Stretches without a class (cls '') are a cipher of their source, learned from nothing.
    """
    once = stretches.where("cls <> 'lost' and cls not like '%-twice'").select("source", "cls", "obs").distinct()  # copies are one piece of evidence
    pairs = materialise(once.mapInArrow(_pair_rows, "source string, cls string, x string, y string, n bigint").groupBy("source", "cls", "x", "y").agg(F.sum("n").alias("n")))
    # All sources together: at most the pairs of 256 codes, or of a page's characters, for each class.
    pooled: dict[str, tuple[str, str]] = {}
    mean: dict[str, float] = {}
    everywhere = pairs.where("cls <> ''").groupBy("cls", "x", "y").agg(F.sum("n").alias("n")).toPandas()
    for cls, g in everywhere.groupby("cls"):
        syms, m = _counted(lm.codes("".join(g["x"])), lm.codes("".join(g["y"])), g["n"].to_numpy())
        pooled[cls] = (syms, learn_page(syms, m, cls, counts))
        mean[cls] = float((m * np.log(_joint(pooled[cls][1], byte_bigrams(counts, _SWAP[cls][2][0])))).sum() / max(1.0, m.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabets = _alphabets(counts)
        bigrams = {c: byte_bigrams(counts, _SWAP[c][2][0]) for c in pooled}
        log = {c: np.log(_joint(t[1], bigrams[c])) for c, t in pooled.items()}
        place = {c: lm.codes(t[0]) for c, t in pooled.items()}
        out = []
        for source, cls, x, y, n in _groups(batches):
            if not cls:
                syms, m = _counted(x, y, n)
                found = learn_cipher(syms, m, counts, alphabets)
                if found:
                    out.append((source, cls, found[0], syms, found[1]))
                continue
            at = place[cls]
            shared = float(np.dot(log[cls][np.searchsorted(at, x), np.searchsorted(at, y)], n))
            if mean[cls] * n.sum() - shared > OWN_COST:  # as the pairs of all sources fit, there is something to gain
                syms, m = _counted(x, y, n)
                table = dict(zip(map(ord, pooled[cls][0]), pooled[cls][1]))
                own = learn_page(syms, m, cls, counts, table)
                changed = sum(a != b for a, b in zip(own, syms.translate(table)))
                if changed and float((m * np.log(_joint(own, bigrams[cls]))).sum()) - shared > OWN_COST * changed:
                    out.append((source, cls, _SWAP[cls][2][0], syms, own))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["source", "cls", "enc", "src", "dst"])

    own = pairs.repartition("source").sortWithinPartitions("source", "cls").mapInArrow(run, _TABLE)
    return pooled, materialise(own)


def _joint(plain: str, bigrams: np.ndarray) -> np.ndarray:
    at = [ord(c) for c in plain]
    return cipher.smoothed(bigrams)[np.ix_(at, at)]


def _whole(parts: Iterator[tuple[int, int, list[float] | None]]) -> Iterator[tuple[int, int, list[float] | None]]:
    """Parts without a class that follow each other are one again: units of several symbols aren't cut."""
    last = None
    for a, z, ll in parts:
        if last and not last[2] and not ll and last[1] == a:
            last = (last[0], z, None)
            continue
        if last:
            yield last
        last = (a, z, ll)
    if last:
        yield last


def _score_batches(fields: list[str], counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lm.Bigrams(counts)
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            ids, sources = b.column(0), b.column(1)
            for k, field in enumerate(fields):
                texts = b.column(2 + k).to_pylist()
                for i in np.flatnonzero(plausible(texts)).tolist():
                    text = texts[i]
                    if text:
                        for a, z, ll in _whole(scored_parts(text, model)):
                            if ll or _is_cipher_text(text, a, z):
                                for col, v in zip(out, (ids[i].as_py(), sources[i].as_py(), field, a, z, text[a:z], ll)):
                                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], ids.type), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.string()), pa.array(out[6], pa.list_(pa.float64()))], names=["rid", "source", "field", "start", "stop", "obs", "ll"])

    return run


def _is_cipher_text(text: str, a: int, z: int) -> bool:
    return len(_SYMBOL.findall(text, a, z)) >= 4 and not _NOT_SYMBOL.search(text, a, z)


def _posterior() -> Column:
    joint = F.zip_with("ll", F.coalesce("prior", F.array(*[F.lit(1.0 / len(CLASSES))] * len(CLASSES))), lambda x, p: x + F.log(p))
    return F.transform(joint, lambda x: F.exp(F.greatest(x - F.array_max(joint), F.lit(-700.0))))


def classes(found: DataFrame, rounds: int = 2) -> DataFrame:
    """found with `cls`: the page pair that groups a stretch with others, by EM per source over how common each is there."""
    now = found.withColumn("prior", F.lit(None).cast("array<double>"))
    for _ in range(rounds):  # expectation, then maximisation per source, smoothed by all sources
        post = now.withColumn("w", _posterior()).withColumn("w", F.expr("transform(w, x -> x / aggregate(w, 0D, (a, y) -> a + y))"))
        sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(CLASSES))]
        by_source = post.groupBy("source").agg(*sums)
        total = by_source.agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(CLASSES))])
        each = F.array(*[F.col(f"s{i}") for i in range(len(CLASSES))])
        overall = F.array(*[(F.col(f"t{i}") + 1) for i in range(len(CLASSES))])
        size = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        prior = F.zip_with(each, overall, lambda s, t: (s + 5 * t / size(overall)) / (size(each) + 5))
        priors = materialise(by_source.crossJoin(F.broadcast(total)).select("source", prior.alias("prior")))  # total is one row
        now = found.join(small(priors), "source", "left")
    best = now.withColumn("w", _posterior()).withColumn("k", F.array_position("w", F.array_max("w")) - 1)
    names = F.array(*[F.lit(c) for c in CLASSES])
    return best.where("k > 0").select("rid", "source", "field", "start", "stop", "obs", F.element_at(names, F.col("k").cast("int") + 1).alias("cls"), F.element_at("ll", 1).alias("clean"))


def decided(df: DataFrame, id_col: str, source_col: str, fields: list[str], counts: np.ndarray | None = None, fill: bool = True) -> DataFrame:
    """(rid, field, start, stop, cls, plain) of the stretches that read better deciphered by a learned table than as they stand.

    counts: those of lm.count_corpus with the encodings TRUE. fill: whether units that lost a byte are guessed in plain. cls is the class, or `cipher` for a table learned from nothing.
    """
    counts = lm.count_corpus(df, fields[:1], TRUE) if counts is None else counts
    id_type = df.schema[id_col].dataType.simpleString()
    shape = f"rid {id_type}, source string, field string, start int, stop int, obs string, ll array<double>"
    found = df.select(F.col(id_col).alias("rid"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), *fields).mapInArrow(_score_batches(fields, counts), shape)
    every = materialise(found)
    unknown = every.where("ll is null").select("rid", "source", "field", "start", "stop", "obs", F.lit("").alias("cls"), F.lit(0.0).alias("clean"))
    asked = materialise(classes(every.where("ll is not null")).unionByName(unknown))
    shown = {_SWAP[r[0]][2][0] for r in asked.select("cls").distinct().collect() if r[0] in _SWAP}  # at most the classes
    rare = tuple(e for e in RARE if e in shown)
    if rare:
        counts = np.concatenate([counts, np.zeros(len(RARE) << 16, dtype=np.int64)])
        extra = lm.count_corpus(df, fields[:1], rare)[lm.SIZE :].reshape(len(rare), -1)
        for e, row in zip(rare, extra):
            counts[lm.SIZE + ((*TRUE, *RARE).index(e) << 16) :][: 1 << 16] = row
    pooled, own = learn_tables(asked, counts)
    tabled = asked.withColumn("base", F.regexp_replace("cls", "-twice$", "")).join(small(own.withColumnRenamed("cls", "base")), ["source", "base"], "left").where("cls <> '' or src is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = lm.Bigrams(counts), _letter_table(counts) if fill else {}
        shared = {c: dict(zip(map(ord, t[0]), t[1])) for c, t in pooled.items()}
        for b in batches:
            keep, plains, names = [], [], []
            for i, (cls, obs, clean, enc, src, dst) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4, 10)))):
                if cls == "lost":
                    plain, better = obs, True
                elif cls:
                    base = base_class(cls)
                    table = dict(zip(map(ord, src), dst)) if src else shared.get(base, {})
                    rough = read_symbols(symbols(obs, base), cls, table)
                    better = log_likelihood(rough, model) > clean
                    plain = filled(rough, cls, model, letters) if better and fill else rough
                else:
                    plain = obs.translate(dict(zip(map(ord, src), dst)))
                    if enc:
                        plain = plain.replace(LOST, "\x1a").encode("latin-1", "replace").decode(enc, "replace").replace("\x1a", LOST)
                    # The table holds for the source as a whole; a stretch escapes it only if it is clearly likelier as it stands.
                    better = log_likelihood(plain, model) > log_likelihood(obs, model, clean=True) - MARGIN
                if better:
                    keep.append(i)
                    plains.append(plain)
                    names.append(cls or "cipher")
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(4)), pa.array(names, pa.string()), pa.array(plains, pa.string())], names=["rid", "field", "start", "stop", "cls", "plain"])

    return tabled.select("rid", "field", "start", "stop", "cls", "obs", "clean", "enc", "src", "dst").mapInArrow(run, f"rid {id_type}, field string, start int, stop int, cls string, plain string")


def affected(df: DataFrame, id_col: str, source_col: str, fields: list[str], counts: np.ndarray | None = None) -> DataFrame:
    """Distinct (rid, field) of the fields that hold a wrongly decoded stretch."""
    return decided(df, id_col, source_col, fields, counts, fill=False).select("rid", "field").distinct()


def _letter_table(counts: np.ndarray) -> dict[bytes, list[tuple[str, int]]]:
    """For units that lost their last byte: the letters a UTF-8 prefix may stand for, with their corpus counts."""
    table: dict[bytes, list[tuple[str, int]]] = {}
    for c in USUAL:
        raw = c.encode("utf-8")
        n = int(counts[int(lm.char_bucket(lm.codes(c))[0])])
        if len(raw) == 3 and n:
            table.setdefault(raw[:2], []).append((c, n))
            table.setdefault(raw[:1], []).append((c, n))
    return table


_CUT = re.compile(f"([{chr(_BAD + 0x80)}-{chr(_BAD + 0xFF)}]{{1,2}})[?\x1a]?")


def filled(text: str, cls: str, model: lm.Bigrams, table: dict) -> str:
    """A deciphered stretch; a unit that lost a byte becomes the letter its bytes and neighbours make likeliest."""

    def fill(m: re.Match) -> str:
        options = table.get(bytes(ord(c) - _BAD for c in m.group(1)), [])
        if not options:
            return LOST
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        return max(options, key=lambda o: model.scores(before + o[0] + after, _KNOWN)[1 if before else 0 :].sum())[0]

    text = _CUT.sub(fill, text) if cls.startswith("utf8") else text
    return text.translate({_BAD + b: LOST for b in range(256)} | {0x1A: LOST})


def restore(df: DataFrame, id_col: str, source_col: str, fields: list[str]) -> DataFrame:
    """(rid, field, cls, restored) of the affected fields: the text with every decided stretch deciphered."""
    parts = materialise(decided(df, id_col, source_col, fields))
    # The stretches of one field of one row: bounded by the length of that text.
    per_field = parts.groupBy("rid", "field").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "cls", "plain"))).alias("parts"))
    # Only the texts in question move.
    texts = df.select(F.col(id_col).alias("rid"), *fields).join(small(parts.select("rid").distinct()), "rid", "left_semi")
    long = texts.select("rid", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "txt"))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, ps in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                for p in reversed(ps):
                    text = text[: p["start"]] + p["plain"] + text[p["stop"] :]
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["+".join(sorted({p["cls"] for p in ps})) for ps in b.column(3).to_pylist()], pa.string()), pa.array(out, pa.string())], names=["rid", "field", "cls", "restored"])

    return long.join(per_field, ["rid", "field"]).select("rid", "field", "txt", "parts").mapInArrow(run, f"rid {id_type}, field string, cls string, restored string")
