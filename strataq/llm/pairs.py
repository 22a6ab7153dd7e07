"""Problem 6: defective answers of question-answer pairs, each with its type of defect.

Truncation: a pushdown parser follows fences, markup, brackets, quotations and list marks; an answer without a final mark is
judged by how often, over all answers, its last characters end a sentence or go on. Copies: greedy string tiling of
the answer with the question. Language: script and function-word checks. Refusal: a grammar of who refuses what.

Defined results: one defect at most, in the order empty, refusal, copy, language, truncated; a null question with an
answer can be none but empty, refusal or truncated; repeated pairs are each reported.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Answers without content.
PLACEHOLDERS = {"", "无", "略", "空", "暂无", "待补充", "待定", "待填", "未填", "暂缺", "答", "见附件", "null", "none", "nil", "na", "nan", "tbd", "todo", "tba", "unknown", "undefined", "answer", "a", "x", "xx", "xxx"}
# Function words that tell languages of the Latin script apart.
FUNCTION_WORDS = {
    "en": set("the of and to in is for on that with be by must should no are at an or not it before after if who how".split()),
    "de": set("der die das und ist nicht den von zu mit werden wird auf für bei vor dem ein eine sind alle oder".split()),
    "fr": set("le la les des et est pas une du dans pour sur avec ne sont au aux par".split()),
    "es": set("el los las y es no una del en para por con son al se que lo".split()),
}
#: Words after which a sentence has to go on.
_OPEN_WORDS = re.compile(r"(?:应当?|必须|须|由|并|且|与|及|或|在|经|的|将|对|把|被|以|向|为|同时|防止|不得|方可|\b(?:the|a|an|and|or|of|to|with|for|by|in|on|at|is|are|be|than|that|which|must|should|shall|will|may|when|if|unless|because|since|from|into))$", re.I)
_FINAL = re.compile(r"[。！？.!?…；;]['\"”’）)\]】』」]*$|[”】』」]$|```$")
_ZH_REFUSAL = re.compile(
    r"(?:我|本人|本助手|本模型|本系统|作为[^，。]{0,8}(?:助手|模型|AI))[^。！？]{0,16}?(?:不能|无法|不便|不会|没有权限|无权|难以|拒绝)[^。！？]{0,8}?(?:回答|作答|答复|讨论|提供|解答|评论|协助|帮助|给出)"
    r"|(?:抱歉|对不起|不好意思|遗憾)[^。！？\w]{1,2}[^。！？]{0,14}?(?:无法|不能|不便|没有找到|未找到|找不到|没有相关|难以|无可)[^。！？]{0,24}"
    r"|恕(?:难|不|我)[^。]{0,6}(?:答|告|从命|能)|不作(?:回答|答复|评论)|无可奉告|不予(?:回答|答复|置评)"
    r"|(?:问题|内容|请求)[^。]{0,6}超出了?(?:我|本|系统)[^。]{0,8}(?:范围|权限|能力)"
    r"|(?:现有|检索|已有|提供的)?(?:资料|结果|文档|上下文|知识库)[^。！？]{0,6}(?:不足|没有|未|缺乏|找不到)[^。！？]{0,16}(?:回答|作答|答复|依据|相关|内容|信息)[^。！？]{0,10}$"
)
_EN_REFUSAL = re.compile(
    r"\b(?:I|we|this assistant|the assistant)\b[^.!?]{0,30}?(?:can(?:no|')t|cannot|can not|am not able|are not able|unable|won['’]t|will not|must decline|not allowed|am not permitted|may not|don['’]t have)[^.!?]{0,16}?(?:answer|help|provide|discuss|comment|assist|say|share|offer|guidance|information)"
    r"|\bsorry\b[^.!?]{0,40}?(?:outside|beyond|can(?:no|['’])t|unable|not able|no information)|\b(?:outside|beyond) (?:what I|my|the scope)|\bno (?:relevant )?(?:passage|information|document|source)s? (?:was|were) found\b[^.!?]{0,40}(?:answer|say)"
    r"|\bas an? (?:AI|assistant|language model)\b[^.!?]{0,40}?(?:not|can['’]?t|unable)",
    re.I,
)
_SCRIPTS = (("zh", re.compile("[㐀-鿿]")), ("ja", re.compile("[぀-ヿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ko", re.compile("[가-힯]")), ("latin", re.compile("[A-Za-zÀ-ɏ]")))
_PAIRS = {"（": "）", "【": "】", "《": "》", "“": "”", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}"}
_CLOSERS = {v: k for k, v in _PAIRS.items()}
_LIST_MARK = re.compile(r"(?m)(?:^|(?<=[\s；;。：:]))[（(]?(?:\d{1,3}|[a-zA-Z]|[一二三四五六七八九十]{1,3})[)）]")
BITS = 20


def _units(text: str) -> list[str]:
    """Han and kana one by one, words of alphabets whole, marks one by one."""
    return re.findall(r"[A-Za-zÀ-ɏЀ-ӿ']+|\d+(?:\.\d+)?|\S", text)


def is_short(text: str, units: list[str]) -> bool:
    """A phrase rather than sentences: few units and no mark that ends a sentence."""
    return len(units) <= 16 and not re.search(r"[。！？；!?]|[a-z]\.", text)


class _Hashes(dict):
    """Hash of a unit, all digits alike; kept as long as there aren't too many."""

    def __missing__(self, unit: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[unit] = zlib.crc32(re.sub(r"\d", "0", unit).encode("utf-8", "replace"))
        return h


_HASH = _Hashes()
_IDEOGRAPH = re.compile("[㐀-鿿぀-ヿ]")


def _tail_keys(h: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Bucket of the tail that ends at each unit, the text's start filled with zeros: three units at an ideograph, else two."""
    one = np.concatenate([[0], h[:-1]])
    two = np.where(wide, np.concatenate([[0, 0], h[:-2]])[: len(h)], 0)
    x = (two.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ one.astype(np.uint64)
    x = (x * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h.astype(np.uint64)
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def tail_key(units: list[str]) -> int:
    last = units[-3:]
    return int(_tail_keys(np.array([_HASH[u] for u in last], dtype=np.int64), np.array([bool(_IDEOGRAPH.match(u)) for u in last]))[-1])


_ENDS = frozenset("。！？.!?；;")


def count_tails(answers: DataFrame) -> np.ndarray:
    """Hashed counts over all answers of [tails anywhere, tails that end a sentence or a short answer]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << BITS, dtype=np.int64)
        for b in batches:
            flat: list[str] = []
            closes: list[int] = []  # last units of short answers
            for text in b.column(0).to_pylist():
                if text:
                    u = _units(text)
                    flat += u
                    if u and is_short(text, u):
                        closes.append(len(flat) - 1)
                    flat += ("", "")  # nothing reaches over
            if not flat:
                continue
            h = np.array([_HASH[u] if u else 0 for u in flat], dtype=np.int64)
            first = np.array([ord(u[0]) if u else 0 for u in flat], dtype=np.int64)
            # Units that start with a letter or a digit are words; of the others some end sentences.
            word = np.array([u[:1].isalnum() for u in flat])
            wide = (first >= 0x3400) & (first <= 0x9FFF) | (first >= 0x3040) & (first <= 0x30FF)
            ends = np.append(np.array([u in _ENDS for u in flat[1:]], dtype=bool), False)
            ends[closes] = True
            k = _tail_keys(h, wide)
            total[: 1 << BITS] += np.bincount(k[word], minlength=1 << BITS)
            total[1 << BITS :] += np.bincount(k[word & ends], minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "n"])

    got = answers.mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * 2^20 rows
    out = np.zeros(2 << BITS, dtype=np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


_TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)((?:\s[^<>]*)?)>|<[A-Za-z][\w-]*(?:\s[^<>]*)?$")
_VOID = frozenset("area base br col hr img input link meta wbr".split())


def open_constructs(text: str) -> list[str]:
    """What a pushdown parser still has open at the end: fences, markup, brackets and quotations; list marks are skipped.

    A straight quotation mark opens where none is open and no letter or digit stands before it (inches, apostrophes).
    A closing tag closes what was opened inside it.
    """
    stack: list[str] = []
    for i, part in enumerate(text.split("```")):
        if i % 2:
            continue  # inside a fence
        part = _LIST_MARK.sub(" ", part)
        at = 0
        tags = {m.start(): m for m in _TAG.finditer(part)} if "<" in part else {}
        while at < len(part):
            m, c = tags.get(at), part[at]
            if m:
                name = (m[2] or "").lower()
                if not m[2]:
                    stack.append("<")  # ends inside a tag
                elif m[1]:
                    if f"<{name}>" in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
                elif name not in _VOID and not m[3].endswith("/"):
                    stack.append(f"<{name}>")
                at = m.end()
                continue
            if c == '"':
                if '"' in stack:
                    del stack[len(stack) - 1 - stack[::-1].index('"') :]
                elif not part[at - 1 : at].isalnum():
                    stack.append(c)
            elif c in _PAIRS:
                stack.append(c)
            elif c in _CLOSERS and stack and stack[-1] == _CLOSERS[c]:
                stack.pop()
            at += 1
    return stack + ["```"] * (text.count("```") % 2)


def is_truncated(answer: str, counts: np.ndarray) -> bool:
    text = answer.strip()
    left = open_constructs(text)
    if "```" in left:
        return True
    if re.search(r"[，、,：:（(“《「\-—]$", text) or re.search(r"(?:^|[\n；;])\s*[（(]?\d{1,2}[)）.、]$", text):
        return True
    if _FINAL.search(text) or not text:
        return False
    if left:
        return True
    units = _units(text)
    if re.fullmatch(r"[±<>≤≥约]?\s*\d+(?:\.\d+)?\s*\S{0,6}", text):
        return False
    if _OPEN_WORDS.search(text):
        return True
    if not units[-1][0].isalnum():
        return False
    if re.search(r"(?:应当?|必须|须|需要|不得|及时|有责任|方可|可以|能够|进行)[㐀-鿿]$", text):
        return True  # half of a verb
    k = tail_key(units)
    seen, ends = counts[k], counts[(1 << BITS) + k]
    if is_short(text, units):
        return False
    return ends / max(1, seen - 1) < 0.01  # the answer itself was counted once


def tile(question: str, answer: str, least: int = 3) -> tuple[int, int]:
    """Greedy string tiling: (characters of the answer outside tiles, characters of the question inside).

    Longest common substrings are taken first; answer characters belong to one tile, the question may be used again.
    """
    q = np.frombuffer(question.encode("utf-32-le", "replace"), dtype=np.uint32)
    a = np.frombuffer(answer.encode("utf-32-le", "replace"), dtype=np.uint32)
    free, used = np.ones(len(a), dtype=bool), np.zeros(len(q), dtype=bool)
    while len(a) and len(q):
        best = (least - 1, 0, 0)
        row = np.zeros(len(a) + 1, dtype=np.int64)
        for i in range(len(q)):
            row[1:] = np.where((a == q[i]) & free, row[:-1] + 1, 0)
            j = int(row.argmax())
            if row[j] > best[0]:
                best = (int(row[j]), i + 1, j)
        size, qi, aj = best
        if size < least:
            break
        free[aj - size : aj] = False
        used[qi - size : qi] = True
    return int(free.sum()), int(used.sum())


def is_copy(question: str, answer: str) -> bool:
    q, a = (re.sub(r"[\W_]", "", s.lower()) for s in (question, answer))
    if not q or not a or len(a) < 0.7 * len(q):
        return False
    grams = {q[i : i + 3] for i in range(len(q) - 2)}
    frame = 8 if re.search("[㐀-鿿]", a) else 18
    # A character in no trigram of the question is in no tile: with too many of them tiling can be left out.
    alone, reach = 0, 0
    for i in range(len(a)):
        if a[i : i + 3] in grams:
            reach = i + 3
        alone += i >= reach
        if alone > frame:
            return False
    outside, covered = tile(q, a)
    return outside <= frame and covered >= 0.8 * len(q)


def language(text: str) -> str:
    """Script, or the language among those of the Latin script; '' where there is too little to tell."""
    n = {name: len(p.findall(text)) for name, p in _SCRIPTS}
    cjk = n["zh"] + n["ja"]
    if n["ja"] >= 2 and n["ja"] * 5 > cjk:
        return "ja"
    if cjk * 3 >= n["latin"] and cjk >= n["ru"] and cjk:
        return "zh"
    if n["ko"] > n["latin"]:
        return "ko"
    if n["ru"] > n["latin"]:
        return "ru"
    words = [w.lower() for w in re.findall(r"[A-Za-zÀ-ɏ]+", text)]
    hits = {k: sum(w in v for w in words) for k, v in FUNCTION_WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] >= 2 or hits[best] and len(words) <= 6 or len(words) >= 3:
        return best if hits[best] else "latin"
    return ""


def defect_of(question: str | None, answer: str | None, counts: np.ndarray) -> str | None:
    text = (answer or "").strip()
    bare = re.sub(r"[\W_]", "", text.lower())
    if bare in PLACEHOLDERS:
        return "empty"
    if _ZH_REFUSAL.search(text) or _EN_REFUSAL.search(text):
        return "refusal"
    if question and is_copy(question, text):
        return "copy"
    if question and question.strip():
        want, got = language(question), language(text)
        if want and got and want != got and not (got == "latin" and want in FUNCTION_WORDS):
            return "language"
    return "truncated" if is_truncated(text, counts) else None


def defects(df: DataFrame, id_col: str, question_col: str, answer_col: str, counts: np.ndarray) -> DataFrame:
    """(rid, defect) of every defective pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect_of(q, a, counts) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.string())], names=["rid", "defect"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), question_col, answer_col).mapInArrow(run, f"rid {id_type}, defect string")
