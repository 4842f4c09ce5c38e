"""Similarity of names by their longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.lower(s), r"[^a-z0-9]+"), lambda x: x != "")


def sorted_tokens(s: Column) -> Column:
    return F.array_join(F.array_sort(tokens(s)), " ")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """indel_ratio of one pair."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def set_ratio(a: str, b: str) -> float:
    """token_set_ratio of one pair."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join([both, *rest] if both else rest) for rest in (sorted(x - y), sorted(y - x)))
    if both and both in (one, two):
        return 100.0
    return max(ratio(one, two), ratio(both, one), ratio(both, two)) if both else ratio(one, two)


#: Letters that one machine word holds, and different ones that a batch's tables are laid out for.
WORD, SYMBOLS = 64, 256


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Letters as small numbers from 1 on, a row for each text filled with 0; lengths; how many different ones there are."""
    size = np.array([len(t) for t in texts], np.int64)
    symbols, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    out = np.zeros((len(texts), max(1, size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat + 1
    return out, size, len(symbols)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs of each pair, all pairs of a batch at once: one step for each letter of the longest text."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int64)
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)])
    codes, size, k = _codes([*a, *b])
    la, lb = size[:n], size[n:]
    if la.max() > WORD or k >= SYMBOLS:
        return np.array([lcs(x, y) for x, y in zip(a, b)], np.int64)
    rows, held = np.arange(n), np.zeros((n, k + 1), np.uint64)
    for j in range(la.max()):
        held[rows, codes[:n, j]] |= np.uint64(1 << j)
    held[:, 0] = 0  # beyond a text's end
    full = np.where(la == WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(la, WORD - 1).astype(np.uint64)) - np.uint64(1))
    row = full.copy()
    for j in range(lb.max(initial=0)):
        hit = row & held[rows, codes[n:, j]]
        row = ((row + hit) | (row - hit)) & full
    return la - np.bitwise_count(row)


def most_in_common(a: list[str], b: list[str]) -> np.ndarray:
    """Letters that each pair has in common in any order: no subsequence is longer."""
    n = len(a)
    codes, _, k = _codes([*a, *b])
    if k >= SYMBOLS:
        return np.minimum([len(x) for x in a], [len(y) for y in b])
    place = np.arange(2 * n)[:, None] * (k + 1) + codes
    held = np.bincount(place.reshape(-1), minlength=2 * n * (k + 1)).reshape(2 * n, k + 1)[:, 1:]
    return np.minimum(held[:n], held[n:]).sum(1)


def ratios(a: pd.Series, b: pd.Series, cutoff: float = 0.0) -> pd.Series:
    """200 x LCS / (length of a + length of b), null below the cutoff; 100 for two empty texts, null if one is null."""
    out = pd.Series(np.nan, index=a.index)
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.float64)
    value = np.full(len(x), 100.0)
    some = total > 0
    if cutoff:
        some &= 200.0 * most_in_common(x, y) >= cutoff * total if x else some
        value[(total > 0) & ~some] = np.nan
    at = np.flatnonzero(some)
    value[at] = 200.0 * lcs_lengths([x[i] for i in at], [y[i] for i in at]) / total[at]
    value[value < cutoff] = np.nan
    out[known] = value
    return out


def indel_ratio(a: Column, b: Column, cutoff: float = 0.0) -> Column:
    """200 x LCS / (length of a + length of b), null below the cutoff; 100 for two empty strings, null if one is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return ratios(x, y, cutoff)

    return F.pandas_udf(run, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the common tokens, these and the rest of a, and these and the rest of b; a subset gives 100.

    a and b are strings of sorted tokens. The common tokens begin both others, so their own ratios follow from lengths.
    """
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")) for c in (a, b))
    both = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    rest = lambda p, q: F.array_join(F.array_sort(F.array_except(p, q)), " ")
    one, two = (F.trim(F.concat_ws(" ", both, rest(p, q))) for p, q in ((x, y), (y, x)))
    of = lambda whole: 200.0 * F.length(both) / (F.length(both) + F.length(whole))
    score = F.greatest(indel_ratio(one, two), F.when(both != "", F.greatest(of(one), of(two))).otherwise(0.0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((both != "") & ((both == one) | (both == two)), 100.0).otherwise(score)


def pairs_of_letters(s: Column) -> Column:
    """Neighbouring letters of a string, each with how many times it has stood before, so that all differ."""
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: s.substr(i, F.lit(2)))
    return F.transform(one, lambda x, i: F.concat(x, F.size(F.filter(F.slice(one, F.lit(1), i), lambda y: y == x)).cast("string")))
