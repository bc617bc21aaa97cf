"""Hashed word shingles of whole texts, straight from Arrow buffers, a bounded slice at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WORDS = 5
#: Bytes whose words are hashed at a time; a word as long or longer is hashed by itself.
_SEGMENT = 1 << 17
#: Bytes of texts whose shingles are made at a time (one text at least).
_SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: A byte's number in a hash: A-Z count as a-z.
_NUMBER = np.arange(1, 257, dtype=np.uint64)
_NUMBER[0x41:0x5B] += np.uint64(0x20)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for the places of a segment."""
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_SEGMENT, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and the last ends; null rows are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _words(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of the bytes ``edges[0]`` to ``edges[-1]``; no word goes over an edge."""
    power, inverse = _power_tables()
    hashes, starts = [], []
    at, until = int(edges[0]), int(edges[-1])
    while at < until:
        end = min(at + _SEGMENT, until)
        piece = raw[at:end]
        white = _WHITE[piece]
        cut = np.zeros(len(piece) + 1, bool)  # a text begins here
        inner = edges[np.searchsorted(edges, at) : np.searchsorted(edges, end, "right")]
        cut[inner - at] = True
        if end < until and not cut[-1] and not _WHITE[raw[end]]:
            # the last word goes on beyond the segment: leave it to the next one
            stop = max([0, *(np.flatnonzero(white)[-1:] + 1).tolist(), *np.flatnonzero(cut)[-1:].tolist()])
            if stop == 0:  # one word of a segment or more
                end = int(edges[np.searchsorted(edges, at, "right")])
                for a in range(at, end, _SEGMENT):
                    blank = np.flatnonzero(_WHITE[raw[a : min(end, a + _SEGMENT)]])
                    if len(blank):
                        end = a + int(blank[0])
                        break
                whole = hashlib.blake2b(digest_size=8)
                for a in range(at, end, _SEGMENT):
                    whole.update(_NUMBER[raw[a : min(end, a + _SEGMENT)]].astype(np.uint16))
                hashes.append(np.frombuffer(whole.digest(), np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
            end, piece, white, cut = at + stop, piece[:stop], white[:stop], cut[: stop + 1]
        before = np.concatenate([[True], white[:-1]]) | cut[:-1]
        after = np.concatenate([white[1:], [True]]) | cut[1:]
        start = np.flatnonzero(~white & before)
        stop = np.flatnonzero(~white & after) + 1
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_NUMBER[piece] * power[: len(piece)], out=sums[1:])
        hashes.append(mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64)))
        starts.append(start + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sequences(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts in order: all shingle hashes in text order, and each text's number of them.

    Words are lower-cased in A-Z and parted by ASCII white space. A text with
    fewer words has its whole sequence as one shingle; a null text or one
    without words has none. Repeats within a text are kept.
    """
    raw, at = _buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _SLICE, "right")) - 1)
        edges = at[first : last + 1]
        word, start = _words(raw, edges)
        until = np.searchsorted(start, edges[1:])
        per_text = np.diff(until, prepend=0)
        count = np.where(per_text >= words, per_text - words + 1, np.minimum(per_text, 1))
        begin = np.repeat(until - per_text - (np.cumsum(count) - count), count) + np.arange(count.sum())
        reach = np.repeat(np.minimum(per_text, words), count)
        padded = np.concatenate([word, np.zeros(words, np.uint64)])
        out = reach.astype(np.uint64)
        short = bool((per_text < words).any())
        for k in range(words):
            here = padded[begin + k]
            if short:
                here[reach <= k] = 0
            out *= np.uint64(0xD6E8FEB86659FD93)
            out = mix(out + here)
        yield out, count
        first = last


def distinct(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and how many they are. ``hashes`` is reordered."""
    edges = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[edges[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return hashes[fresh], kept[edges[1:]] - kept[edges[:-1]]


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text, made a slice at a time."""
    for hashes, count in shingle_sequences(texts, words):
        flat, n = distinct(hashes, count)
        edges = np.concatenate([[0], np.cumsum(n)]).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield flat[a:b]
