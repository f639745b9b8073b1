"""Pieces of DuckDB SQL that state the text functions a second time."""

from __future__ import annotations

from corvane.functions.text import MIN_TOKEN, STEM, folded_stopwords

_STOP = ", ".join(f"'{w}'" for w in folded_stopwords())


def fold(x: str) -> str:
    return f"strip_accents(replace(replace(lower({x}), 'đ', 'd'), 'ð', 'd'))"


def terms(x: str) -> str:
    """Distinct content terms, in order."""
    words = f"regexp_extract_all({fold(f'coalesce({x}, {chr(39) * 2})')}, '[\\p{{L}}\\p{{N}}]+')"
    telling = f"list_filter({words}, lambda w: length(w) >= {MIN_TOKEN} AND NOT regexp_full_match(w, '\\p{{N}}+') AND w NOT IN ({_STOP}))"
    return f"list_sort(list_distinct({telling}))"


def match(a: str, b: str) -> str:
    least = f"least(length({a}), length({b}))"
    k = f"greatest({STEM}, {least} - 1)"
    return f"({a} = {b} OR ({least} >= {STEM} AND left({a}, CAST({k} AS BIGINT)) = left({b}, CAST({k} AS BIGINT))))"


def matched(q: str, t: str) -> str:
    return f"list_filter({q}, lambda a: len(list_filter({t}, lambda b: {match('a', 'b')})) > 0)"


def overlap(q: str, t: str) -> str:
    return f"CASE WHEN len({q}) > 0 THEN len({matched(q, t)}) / len({q}) ELSE 0 END"
