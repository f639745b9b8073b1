"""Edit-based similarity of short strings: plain functions and the Arrow UDFs that apply them to columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one row of bits for each letter."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a stretch of the longer one of its length, or cut by an end."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    stretches = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, s) for s in stretches)


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def _set_ratio(a: str, b: str, ratio) -> float:
    one, two = set(a.split()), set(b.split())
    both = " ".join(sorted(one & two))
    left, right = (" ".join(filter(None, (both, " ".join(sorted(x))))) for x in (one - two, two - one))
    if both and (left == both or right == both):
        return 100.0
    return max(ratio(left, right), *((ratio(both, left), ratio(both, right)) if both else (0.0, 0.0)))


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios: whole strings; words in order of the alphabet and as sets, weighed less; parts of strings of
    unlike lengths, weighed less still. 0 if either is empty."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    x, y = _sorted_words(a), _sorted_words(b)
    if unlike < 1.5:
        return max(best, 0.95 * indel_ratio(x, y), 0.95 * _set_ratio(a, b, indel_ratio))
    weight = 0.9 if unlike <= 8 else 0.6
    return max(best, weight * partial_ratio(a, b), 0.95 * weight * partial_ratio(x, y), 0.95 * weight * _set_ratio(a, b, partial_ratio))


def prefix_distance(token: str, word: str) -> int:
    """The fewest edits (a swap of neighbours is one) that turn token into a beginning of word."""
    before: list[int] = []
    row = list(range(len(word) + 1))
    for i, c in enumerate(token, 1):
        new = [i]
        for j, d in enumerate(word, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == word[j - 2] and token[i - 2] == d:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return min(row)


def edit_budget(token: str) -> int:
    """Edits that a token may be off by: none for short ones and numbers, two for long ones."""
    return 0 if len(token) < 4 or token.isdigit() else 1 if len(token) < 8 else 2


def tolerates(query: str, text: str) -> bool:
    """Whether text holds every token of query, as a part or as a beginning of a word within its budget. Both are folded."""
    words = text.split()
    return all(t in text or (budget := edit_budget(t)) and any(prefix_distance(t, w) <= budget for w in words) for t in query.split())


def _bags(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """How often each of 32 classes of letters stands in each different string, and the rows' numbers among those."""
    number, kinds = pd.factorize(texts)
    letters = [np.frombuffer(x.encode("utf-32-le"), np.uint32) % 32 for x in kinds]
    row = np.repeat(np.arange(len(kinds)), [len(x) for x in letters])
    bags = np.bincount(row * 32 + np.concatenate([*letters, np.zeros(0, np.uint32)]).astype(np.int64), minlength=32 * len(kinds))
    return bags.reshape(-1, 32).astype(np.int32), number


def may_reach(a: pd.Series, b: pd.Series, least: pd.Series) -> np.ndarray:
    """Whether the letters that two strings share allow a weighted ratio of least; false only where they don't.

    No more letters can stand in a common subsequence than both have. Strings of like lengths are weighed as wholes, or have a common
    word; of unlike ones the shorter is compared with a stretch no longer than itself, at a weight of 0.9 at most.
    """
    (x, i), (y, j) = _bags(a), _bags(b)
    common = np.empty(len(i), np.int64)
    for low in range(0, len(i), 65536):
        common[low : low + 65536] = np.minimum(x[i[low : low + 65536]], y[j[low : low + 65536]]).sum(axis=1)
    la, lb = x.sum(axis=1)[i], y.sum(axis=1)[j]
    short, long = np.minimum(la, lb), np.maximum(la, lb)
    words = pd.Series([not set(p.split()).isdisjoint(q.split()) for p, q in zip(a, b, strict=True)], dtype=bool).to_numpy()
    like = 200.0 * common / np.maximum(la + lb, 1)
    stretch = 0.9 * 200.0 * common / np.maximum(short + common, 1)
    return words | (np.where(long < 1.5 * short, like, np.maximum(like, stretch)) >= least.to_numpy() - 1e-6)


@pandas_udf(DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(BooleanType())
def tolerates_udf(query: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([tolerates(q or "", t or "") for q, t in zip(query, text, strict=True)])
