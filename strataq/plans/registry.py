"""A query is a function of (spark, folder); its SQL, where there is one, is given at registration."""

from __future__ import annotations

from collections.abc import Callable

from strataq.settings import UNIT_GATE
from strataq.settings import WHITESPACE as WS

#: SQL fragments shared by queries: text without white space, and stripped text.
NOSPACE = lambda c: f"regexp_replace({c}, '{WS}', '', 'g')"
STRIP = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
CJK = lambda c: f"(CASE WHEN length({NOSPACE(c)}) > 0 THEN length(regexp_replace({c}, '[^一-鿿]', '', 'g'))::DOUBLE / length({NOSPACE(c)}) ELSE 0.0 END)"
GARBLED = lambda c: f"(coalesce(length({NOSPACE(c)}), 0) = 0 OR {CJK(c)} < 0.4)"
TOKENS = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+|[一-鿿]')"

_RUN = "〇零一二两三四五六七八九十百千万亿壹贰叁肆伍陆柒捌玖"


def _number(t: str) -> str:
    chars = f"list_transform(string_split(translate({t}, '〇壹两贰叁肆伍陆柒捌玖', '零一二二三四五六七八九'), ''), lambda c: {{'t': 0::BIGINT, 'n': 0::BIGINT, 'c': c}})"
    fold = f"""list_reduce(list_prepend({{'t': 0::BIGINT, 'n': 0::BIGINT, 'c': ''}}, {chars}), lambda a, x: CASE WHEN instr('十百千万亿', x.c) > 0
        THEN {{'t': a.t + (CASE WHEN a.n = 0 THEN 1 ELSE a.n END) * ([10, 100, 1000, 10000, 100000000]::BIGINT[])[instr('十百千万亿', x.c)], 'n': 0::BIGINT, 'c': x.c}}
        ELSE {{'t': a.t, 'n': (instr('零一二三四五六七八九', x.c) - 1)::BIGINT, 'c': x.c}} END)"""
    return f"(CASE WHEN ({fold}).t + ({fold}).n = 0 THEN {t} ELSE (({fold}).t + ({fold}).n)::VARCHAR END)"


def MATCH(c: str) -> str:  # noqa: N802
    """SQL of strataq.functions.text.normalise_for_match."""
    marks = f"translate(translate({NOSPACE(f"coalesce({c}, '')")}, '０１２３４５６７８９％（），；：！？', '0123456789%(),;:!?'), '～－—‑–', '-----')"
    parts = f"regexp_extract_all({marks}, '[{_RUN}]{{1,8}}|[^{_RUN}]+')"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN regexp_full_match(p, '[{_RUN}]{{1,8}}') AND regexp_matches(substr(coalesce(({parts})[i + 1], ''), 1, 1), '[{UNIT_GATE}]') THEN {_number('p')} ELSE p END), '')"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
