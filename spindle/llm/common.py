"""Shared helpers of the training-data operators: tables, worker state, Arrow text buffers, word hashes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one NumPy step; larger documents are cut at white space.
BLOCK_BYTES = 1 << 19

BUCKETS = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: the word pattern of the result contracts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_buckets(df: DataFrame, hits: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key's bucket has a hit (or none: left_anti): a filter before a shuffle join that keeps every match.
    At most BUCKETS numbers are broadcast, however many hits there are."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    return df.join(F.broadcast(hits.select(bucket.alias("__b")).distinct()), bucket == F.col("__b"), how)


def _store() -> dict:
    return sys.modules.setdefault("_spindle_worker_state", types.ModuleType("_spindle_worker_state")).__dict__


def per_worker(key: str, make: Callable):
    """A model kept in the Python process between tasks, also when the calling function was pickled by value. A process
    holds one model: making another lets go of the one before."""
    store = _store()
    if store.get("model", (None,))[0] != key:
        store.pop("model", None)
        store["model"] = (key, make())
    return store["model"][1]


def drop_model() -> None:
    """Let go of the model of an earlier stage before a stage that needs the memory for its data."""
    _store().pop("model", None)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string or binary column; NULL counts as empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
        if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
            return string_buffers(col.cast(pa.large_string()))
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, width, n + 1, col.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows whose bytes stay under the limit (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LF = np.zeros(256, bool)
_LF[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, kept between tasks."""
    kept = _store().setdefault("powers", {"n": 0})
    if kept["n"] < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        up = np.full(size, _P, np.uint64)
        down = np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        kept["n"], kept["up"], kept["down"] = size, np.cumprod(up), np.cumprod(down)
    return kept["up"][:n], kept["down"][:n]


def _hash_piece(raw: np.ndarray, cuts: np.ndarray, lower: bool, between: np.ndarray = _SPACE):
    space = between[raw]
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    first = cuts[cuts < len(raw)]
    start[first] = word[first]
    end = word.copy()
    end[:-1] &= space[1:]
    last = cuts[(cuts > 0) & (cuts <= len(raw))] - 1
    end[last] = word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        return np.empty(0, np.uint64), s, e
    up, down = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * up, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    return mix64(h ^ ((e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), s, e


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than space and TAB to CR) of each row, and the number
    of words per row. Works through the bytes in steps of BLOCK_BYTES, cut at white space."""
    h, s, _ = run_hashes(raw, offsets, lower, _SPACE)
    return h, np.diff(np.searchsorted(s, offsets))


def line_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lines with a word (cut at LF only) of each row, and their number per row."""
    h, s, e = run_hashes(raw, offsets, False, _LF)
    inked = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~_SPACE[raw], out=inked[1:])
    ok = inked[e] > inked[s]
    return h[ok], np.diff(np.searchsorted(s[ok], offsets))


def run_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray):
    """Hashes, starts and ends of the runs of bytes without a separator; no run crosses a row."""
    out, starts, ends = [], [], []
    size, a = len(raw), 0
    while a < size:
        b = min(size, a + BLOCK_BYTES)
        while b < size:  # move the cut to white space or a row boundary, so that no word is cut
            gap = np.flatnonzero(between[raw[b:b + 4096]])
            nxt = offsets[np.searchsorted(offsets, b)]
            if nxt - b <= (gap[0] if len(gap) else 4096):
                b = int(nxt)
                break
            if len(gap):
                b += int(gap[0])
                break
            b += 4096
        b = min(b, size)
        lo, hi = np.searchsorted(offsets, a), np.searchsorted(offsets, b, side="right")
        h, s, e = _hash_piece(raw[a:b], np.unique(offsets[lo:hi] - a), lower, between)
        out.append(h)
        starts.append(s + a)
        ends.append(e + a)
        a = b
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(starts), np.concatenate(ends)


def windows(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row and their row; rows of fewer words give none."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = h[:len(h) - k + 1].copy()
    for j in range(1, k):
        acc = mix64(acc * _P + h[j:len(h) - k + 1 + j])
    row = np.repeat(np.arange(len(counts)), counts)
    ok = row[:len(acc)] == row[k - 1:]
    return acc[ok], row[:len(acc)][ok]
