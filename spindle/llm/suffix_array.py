"""Suffix arrays by induced sorting, whole-array steps in NumPy.

Suffixes are classified S or L, the leftmost-S (LMS) substrings are sorted by inducing from their first bytes and named,
the string of names is sorted (rank doubling, the array form of the recursion), and the order of the LMS suffixes
induces all others. Inducing goes through the characters once up for L and once down for S; the
entries of one character's bucket that are known are handled together, and those they add to the same bucket in
the next step, so a character takes as many steps as its longest run.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last (the sentinel) is S."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])  # the sentinel is unique, so every position has one at or after it
        s[:-1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, chars: int) -> np.ndarray:
    """Suffix array from LMS suffixes in the given order (order of suffixes if that is theirs)."""
    n = len(t)
    size = np.bincount(t, minlength=chars)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int32)
    ramp = np.arange(n, dtype=np.int32)
    present = np.flatnonzero(size)
    # LMS entries by character, in order
    first = t[lms]
    by = np.argsort(first, kind="stable")
    sorted_lms = lms[by]
    lo = np.searchsorted(first[by], np.arange(chars + 1))
    head = start.astype(np.int32)  # next free place of each bucket's L part

    def push_l(found: np.ndarray) -> None:
        j = found[found > 0] - 1
        j = j[~s[j]]
        if not len(j):
            return
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        cnt = np.bincount(c, minlength=chars)
        sa[(head - (np.cumsum(cnt) - cnt))[c] + ramp[:len(j)]] = j
        head[:] += cnt

    for c in present:
        done = start[c]
        while done < head[c]:
            upto = head[c]
            push_l(sa[done:upto])
            done = upto
        if lo[c] < lo[c + 1]:
            push_l(sorted_lms[lo[c]:lo[c + 1]])
    tail = end.astype(np.int32)  # behind the next free place of each bucket's S part

    def push_s(found: np.ndarray) -> None:  # found in descending order of suffixes
        j = found[found > 0] - 1
        j = j[s[j]]
        if not len(j):
            return
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        cnt = np.bincount(c, minlength=chars)
        sa[(tail - 1 + np.cumsum(cnt) - cnt)[c] - ramp[:len(j)]] = j
        tail[:] -= cnt

    sa[0] = n - 1  # the sentinel; no suffix induces it
    tail[t[n - 1]] = 0
    for c in present[::-1]:
        done = end[c]
        if c == t[n - 1]:
            push_s(sa[:1])
            continue
        while done > tail[c]:
            downto = tail[c]
            push_s(sa[downto:done][::-1])
            done = downto
        push_s(sa[start[c]:head[c]][::-1])
    return sa


def _rank_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names whose last is unique and least."""
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        if int(rank.max()) == n - 1:
            return np.argsort(rank)
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a small-alphabet string whose last character is unique and least."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.uint16)  # at most 65,536 characters, which sort by radix
    chars = int(t.max()) + 1
    s = _types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(np.int32)
    if len(lms) < 2:
        return _induce(t, s, lms, chars)
    sa = _induce(t, s, lms, chars)
    mark = np.zeros(n, bool)
    mark[lms] = True
    order = sa[mark[sa]]  # LMS substrings in order
    # names: equal neighbours have the same length and the same characters
    index = np.empty(n, np.int32)
    index[lms] = np.arange(len(lms))
    stop = np.append(lms[1:], n - 1)
    length = stop[index[order]] - order + 1
    same = np.zeros(len(order), bool)
    pending = np.flatnonzero(length[1:] == length[:-1]) + 1
    offset = 0
    while len(pending):
        ended = length[pending] <= offset
        same[pending[ended]] = True
        pending = pending[~ended]
        pending = pending[t[order[pending] + offset] == t[order[pending - 1] + offset]]
        offset += 1
    name = np.cumsum(~same) - 1
    if name[-1] == len(order) - 1:
        return _induce(t, s, order, chars)
    names = np.empty(len(lms), np.int64)
    names[index[order]] = name
    return _induce(t, s, lms[_rank_names(names)], chars)


def permuted_common_prefixes(t: np.ndarray, positions: np.ndarray, most: int) -> np.ndarray:
    """For positions in suffix order: common prefix length of each with the one before it, ``most`` at most. The characters
    are bytes; ``most`` of them follow every position. Compared eight at a time."""
    out = np.zeros(len(positions), np.int64)
    if len(positions) < 2:
        return out
    pad = np.concatenate([t.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.zeros(len(t), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | pad[i:i + len(t)]
    active = np.arange(1, len(positions))
    for off in range(0, most, 8):
        a, b = word[positions[active] + off], word[positions[active - 1] + off]
        differ = a ^ b
        equal = differ == 0
        rest = differ[~equal]
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):  # equal leading bytes
            lead += (rest >> np.uint64(64 - 8 * k)) == 0
        out[active[~equal]] = np.minimum(off + lead, most)
        active = active[equal]
        if not len(active):
            break
    out[active] = most
    return out
