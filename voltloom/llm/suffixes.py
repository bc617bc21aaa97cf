"""Order of suffixes by deep-shallow sorting, many at a time.

Suffixes are places in a byte array. Multikey quicksort orders them by one
eight-byte key after the other, going on only with runs of equal keys, down to a
shallow depth. What still ties there shares a long prefix, and reading on key by
key would read the same bytes again and again: such groups are ordered by blind
tries. A trie takes one suffix of its group as a leaf and hangs every other one
at the place where it leaves that leaf: a node is known by its depth and the
byte that branches there, the bytes between nodes are not looked at again. The
suffixes under one node form a group with a longer common prefix, which is
ordered in the same way. All groups take a step at once, in arrays.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a key of the quicksort, and keys read before tries take over.
_KEY, _SHALLOW = 8, 3


def keys_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number that sorts as they do; ``raw`` has 7 spare bytes at its end."""
    return np.ndarray(len(raw) - 7, ">u8", raw, 0, (1,))


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First member and size of each run of equal values."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(group)))


def _tries(raw: np.ndarray, at: np.ndarray, group: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``at`` inside their groups, and which begin a new class; members of a group lie together and share ``known`` bytes."""
    place = np.arange(len(at))  # of each suffix in the result
    begins = np.zeros(len(at), bool)
    begins[_runs(group)[0]] = True
    open_ = np.arange(len(at))  # suffixes in groups not yet ordered, in the order of their places
    base = np.repeat(*_runs(group))  # the first place of each one's group
    shared = np.full(len(at), known)
    while len(open_):
        first, size = _runs(base[open_])
        several = np.repeat(size > 1, size)
        open_ = open_[several]
        if not len(open_):
            break
        first, size = _runs(base[open_])
        leaf = np.repeat(at[open_[first]], size)
        low = min(int(shared[open_].min()), depth - 1)
        span = np.arange(low, depth)
        mine, its = raw[at[open_][:, None] + span], raw[leaf[:, None] + span]
        differ = mine != its
        leaves = differ.argmax(axis=1)
        row = np.arange(len(open_))
        equal = ~differ[row, leaves]
        byte, other = mine[row, leaves].astype(np.int64), its[row, leaves]
        # smaller ones leave the leaf earlier the smaller they are, then the leaf's own class, then larger ones, the nearest first
        branch = np.where(equal, depth, np.where(byte < other, leaves + low, 2 * depth + 1 - (leaves + low)))
        byte[equal] = 0
        by = np.lexsort((byte, branch, base[open_]))
        spots = place[open_]  # ascending, since open_ is in the order of places
        open_, branch, byte, equal, depth_left = open_[by], branch[by], byte[by], equal[by], leaves[by] + low
        place[open_] = spots
        key = np.stack([base[open_], branch, byte])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        begins[spots[new]] = True
        base[open_] = spots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        shared[open_] = depth_left + 1
        open_ = open_[~equal]  # one class is settled
    order = np.empty(len(at), np.int64)
    order[place] = np.arange(len(at))
    return order, begins


def sort_suffixes(raw: np.ndarray, at: np.ndarray, depth: int, *, shallow: int = _SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes of ``raw`` that begin at ``at`` by their first ``depth`` bytes.

    Returns the order (indices into ``at``) and, for each suffix in that order,
    whether it differs from the one before it within ``depth`` bytes. All
    suffixes have ``depth`` bytes; ``raw`` has 7 spare bytes at its end.
    """
    keys = keys_at(raw)
    order = np.arange(len(at))
    begins = np.zeros(len(at), bool)
    begins[:1] = True
    known = 0
    while known < min(depth, shallow * _KEY):
        group = np.cumsum(begins)
        first, size = _runs(group)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order, begins
        key = keys[at[order[tied]] + known]
        if depth - known < _KEY:
            key = key >> np.uint64(8 * (_KEY - (depth - known)))
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied[by]]
        key = key[by]
        differ = np.concatenate([[True], (key[1:] != key[:-1])])
        begins[tied] |= differ
        known += _KEY
    if known < depth:
        group = np.cumsum(begins)
        first, size = _runs(group)
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if len(tied):
            by, fresh = _tries(raw, at[order[tied]], group[tied], known, depth)
            order[tied] = order[tied[by]]
            begins[tied] |= fresh
    return order, begins
