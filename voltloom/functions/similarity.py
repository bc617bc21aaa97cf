"""Similarity of short texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs whose blocks are looked for at once, and the length from which ``SequenceMatcher`` leaves out frequent letters.
TOGETHER, POPULAR = 2_048, 200


def gestalt(left: str | None, right: str | None) -> float:
    """Matching-blocks ratio; 0 where a side is missing or empty. The order of the sides matters."""
    return SequenceMatcher(None, left, right).ratio() if left and right else 0.0


def _coded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters behind one another as code points, and where each text begins (and the last one ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def _parts(letters: np.ndarray, low: np.ndarray, high: np.ndarray, fill: int) -> np.ndarray:
    """A column of letters for each span, filled up."""
    low, high = low.astype(np.int32), high.astype(np.int32)
    places = np.arange(int((high - low).max()), dtype=np.int32)[:, None]
    inside = low + places
    return np.where(inside < high, letters[np.minimum(inside, len(letters) - 1)], letters.dtype.type(fill))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and beginnings of the longest common block of each column of letters; of equal ones the first in ``a``, then in ``b``."""
    rows, width = len(a), len(b)
    bits = max(1, (max(rows, width) - 1).bit_length())
    # a size and its place in one number: larger sizes first, then earlier ends
    kind = np.uint16 if 3 * bits < 16 else np.uint32
    last = (1 << 2 * bits) - 1
    run, best = np.zeros((width, a.shape[1]), kind), np.zeros(a.shape[1], kind)
    ends = (last - np.arange(width, dtype=kind))[:, None]
    for i in range(rows):
        run[1:] = run[:-1]
        run[0] = 0
        run += 1
        run *= b == a[i]
        best = np.maximum(best, ((run << 2 * bits) + (ends - kind(i << bits))).max(axis=0))
    size = (best >> 2 * bits).astype(np.int64)
    place = last - (best & kind(last)).astype(np.int64)
    return size, (place >> bits) - size + 1, (place & (1 << bits) - 1) - size + 1


def gestalts(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``gestalt`` of many pairs of texts: the longest blocks of all pairs at once, then those on both sides of them."""
    (one, a), (two, b) = _coded(left), _coded(right)
    total = np.diff(a) + np.diff(b)
    plain = (np.diff(a) > 0) & (np.diff(b) > 0)
    long = np.maximum(np.diff(a), np.diff(b)) >= POPULAR
    # two letters that no text has fill up the columns
    fill = 0xFE if max(one.max(initial=0), two.max(initial=0)) < 0xFE else 0x110000
    if fill == 0xFE:
        one, two = one.astype(np.uint8), two.astype(np.uint8)
    matches, pair = np.zeros(len(total), np.int64), np.flatnonzero(plain & ~long)
    spans = np.stack([a[pair], a[pair + 1], b[pair], b[pair + 1]])
    while len(pair):
        order = np.argsort(((spans[1] - spans[0]) * POPULAR + spans[3] - spans[2]).astype(np.uint16), kind="stable")
        pair, spans = pair[order], spans[:, order]
        rest = []
        for k in range(0, len(pair), TOGETHER):
            p, (al, ah, bl, bh) = pair[k : k + TOGETHER], spans[:, k : k + TOGETHER]
            size, i, j = _longest(_parts(one, al, ah, fill), _parts(two, bl, bh, fill + 1))
            np.add.at(matches, p, size)
            for lows, highs in (((al, bl), (al + i, bl + j)), ((al + i + size, bl + j + size), (ah, bh))):
                more = (size > 0) & (lows[0] < highs[0]) & (lows[1] < highs[1])
                rest.append((p[more], np.stack([lows[0], highs[0], lows[1], highs[1]])[:, more]))
        pair, spans = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest], axis=1)
    made = np.where(plain, 2.0 * matches / np.maximum(total, 1), 0.0)
    for k in np.flatnonzero(long).tolist():
        made[k] = gestalt(left[k], right[k])
    return made


def _word_forms(left: str | None, right: str | None) -> tuple[str, str, str] | None:
    """The shared words, and each side's shared words with its own; nothing where a side has no words."""
    a, b = set((left or "").split()), set((right or "").split())
    if not a or not b:
        return None
    both = " ".join(sorted(a & b))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (a - b, b - a))
    return both, one, two


def _may_reach(both: str, one: str, two: str, least: float) -> bool:
    """Shared words are the beginning of both sides, and the sides have no more in common than their letters."""
    letters = sum(min(one.count(c), two.count(c)) for c in set(one))
    return 200.0 * max(letters / (len(one) + len(two)), len(both) / (len(both) + min(len(one), len(two)))) >= least - 1e-9


def token_set(left: str | None, right: str | None, least: float = 0.0) -> float:
    """Best ratio, 0 to 100, among the shared words and each side's shared words with its own; what cannot reach ``least`` is 0."""
    forms = _word_forms(left, right)
    if forms is None:
        return 0.0
    both, one, two = forms
    if both and (one == both or two == both):
        return 100.0
    return 100.0 * max(gestalt(x, y) for x, y in ((both, one), (both, two), (one, two))) if _may_reach(both, one, two, least) else 0.0


def token_sets(left: Sequence[str], right: Sequence[str], least: float = 0.0) -> np.ndarray:
    """``token_set`` of many pairs of texts."""
    made = np.zeros(len(left))
    rows, forms = [], []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        parts = _word_forms(x, y)
        if parts is not None and _may_reach(*parts, least):
            rows.append(k)
            forms.append(parts)
    both, one, two = map(list, zip(*forms, strict=True)) if forms else ([], [], [])
    made[rows] = 100.0 * np.maximum(np.maximum(gestalts(both, one), gestalts(both, two)), gestalts(one, two))
    return made


def _distinct(ratios: Callable[[list[str], list[str]], np.ndarray], left: pd.Series, right: pd.Series) -> pd.Series:
    """The ratios of a batch, each pair of texts worked out once."""
    pairs = [(x or "", y or "") for x, y in zip(left, right, strict=True)]
    known = dict.fromkeys(pairs)
    known = dict(zip(known, ratios([p[0] for p in known], [p[1] for p in known]).tolist(), strict=True))
    return pd.Series([known[p] for p in pairs], dtype="float64")


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return _distinct(gestalts, left, right)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gestalt_ratios(*texts: pd.Series) -> pd.Series:
    """The ratios of the first two columns, of the next two, and so on."""
    left, right = (pd.concat(texts[k::2], ignore_index=True) for k in (0, 1))
    return pd.Series(list(_distinct(gestalts, left, right).to_numpy().reshape(len(texts) // 2, -1).T))


def token_set_ratio(left: str | Column, right: str | Column, least: float = 0.0) -> Column:
    """``token_set`` of two columns; what cannot reach ``least`` may be 0."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return _distinct(lambda x, y: token_sets(x, y, least), left, right)

    return ratio(left, right)
