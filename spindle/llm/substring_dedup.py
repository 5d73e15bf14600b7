"""Removal of repeated byte strings of a given length, by suffix arrays of content-defined shards.

Every window of LENGTH bytes belongs to the least hashed GRAM inside it, so equal windows belong to equal grams wherever
they are. Consecutive windows of one gram form a segment. Equal segments are merged first (partial
minima per block, then per gram), each standing for all its copies; grams with one segment are done. The distinct
segments of the other grams are sharded by gram, and the suffix array of each shard (induced sorting) with its permuted
common prefixes finds the windows that occur more than once. The first occurrence stays; every other one is reported.
A gram with very many distinct segments is split by window instead, so no shard grows with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import _BYTE, _powers, blocks, drop_model, in_buckets, mix64, string_buffers, table
from spindle.llm.suffix_array import permuted_common_prefixes, suffix_array
from spindle.session import materialize

LENGTH = 100
GRAM = 32
SHARD_BYTES = 1 << 20  # bytes sorted at a time
HOT = 4_000  # distinct segments of a gram from which its windows are split over all shards
PIECE = 1 << 19  # windows of a long text handled at a time

_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, first window start in the raw bytes, number of windows, gram hash, segment hash) of all windows of the rows."""
    n = len(raw)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    g = mix64((total[gram:] - total[:-gram]) * down[:n - gram + 1])
    low = np.uint64((1 << 22) - 1)
    least = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[:len(least) - (width - done)], least[width - done:])
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(len(size)), size)[:len(least)]
    s = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][row_of])
    if not len(s):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p = (least[s] & low).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    first, count = s[at], np.diff(np.append(at, len(s)))
    a = g[p[at]]
    z = (total[first + count - 1 + length] - total[first]) * down[first]
    z = mix64(z ^ (_SALT * ((p[at] - first) * 256 + count).astype(np.uint64)))
    return row_of[first], first, count, a, z


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of a few bytes of text."""
    up, down = _powers(len(data) + 1)
    out = []
    for values in (_BYTE, mix64(_BYTE ^ _SALT)):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:len(data)], out=total[1:])
        out.append(mix64((total[length:] - total[:-length]) * down[:len(data) - length + 1]).view(np.int64))
    return out[0], out[1]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, start) pairs as (doc, first start, number of consecutive starts)."""
    o = np.lexsort((start, doc))
    doc, start = doc[o], start[o]
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    doc, start = doc[new], start[new]
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(edge)
    return doc[at], start[at], np.diff(np.append(at, len(doc)))


def shard_repeats(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, texts: list[bytes], length: int):
    """Windows of the segments of one shard that occur earlier in it, as runs (doc, start, n)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    t = data.astype(np.uint16) + 2
    t[base + sizes] = 1  # behind each segment
    sa = suffix_array(np.append(t, np.uint16(0)))
    begins = np.zeros(len(t) + 1, np.int32)
    begins[base] += 1
    np.add.at(begins, base + counts, -1)
    sa = sa[np.cumsum(begins)[sa] > 0]  # windows only: the first ``counts`` places of each segment
    plcp = permuted_common_prefixes(data, sa, length)
    seg = np.searchsorted(base, sa, side="right") - 1
    doc, start = docs[seg], starts[seg] + sa - base[seg]
    o = np.lexsort((start, doc))
    step = np.ones(len(o), bool)
    step[1:] = (doc[o[1:]] != doc[o[:-1]]) | (start[o[1:]] != start[o[:-1]])
    rank = np.empty(len(o), np.int64)
    rank[o] = np.cumsum(step)
    heads = np.flatnonzero(plcp < length)
    least = np.minimum.reduceat(rank, heads)
    again = rank != np.repeat(least, np.diff(np.append(heads, len(rank))))
    return _runs(doc[again], start[again])


def _segment_rows(df: DataFrame, length: int) -> DataFrame:
    """Rows (kind, k, a, z, doc, start, n): kind 0 the first of equal segments in a block, kind 1 windows that occur earlier."""
    def run(batches):
        import pyarrow as pa

        def rows(ids, row, start, count, a, z):
            doc = ids[row]
            o = np.lexsort((start, doc, z, a))
            doc, start, count, a, z = doc[o], start[o], count[o], a[o], z[o]
            new = np.ones(len(o), bool)
            new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            keep = new | (doc != doc[head]) | (start != start[head])
            kind = (~new).astype(np.int32)[keep]
            doc, start, count, a, z = doc[keep], start[keep], count[keep], a[keep].view(np.int64), z[keep].view(np.int64)
            k = np.where(kind == 0, a, mix64(doc.view(np.uint64) + start.astype(np.uint64) * _SALT).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(k), pa.array(a), pa.array(np.where(kind == 0, z, 0)), pa.array(doc),
                 pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["kind", "k", "a", "z", "doc", "start", "n"])

        drop_model()
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            raw, off = string_buffers(b.column("text"))
            for lo, hi in blocks(off, PIECE):
                if off[hi] - off[lo] <= PIECE or hi - lo > 1:
                    row, first, count, a, z = segments(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], length, GRAM)
                    if len(row):
                        yield rows(ids[lo:hi], row, first - (off[lo:hi] - off[lo])[row], count, a, z)
                    continue
                text = raw[off[lo]:off[hi]]
                for at in range(0, max(1, len(text) - length + 1), PIECE):  # one long text, by pieces that overlap
                    part = text[at:at + PIECE + length - 1]
                    row, first, count, a, z = segments(part, np.array([0, len(part)]), length, GRAM)
                    if len(row):
                        yield rows(ids[lo:hi], row, first + at, count, a, z)

    return df.mapInArrow(run, "kind int, k long, a long, z long, doc long, start int, n int")


def _merge_rows(rows: DataFrame) -> DataFrame:
    """Rows (role, a, doc, start, n) from segment rows brought together by gram and ordered: role 0 windows that occur earlier,
    role 1 distinct segments of grams that have several. Holds one segment between batches."""
    def run(batches):
        import pyarrow as pa

        last = None  # (a, z, doc, start, n of the current segment, whether the gram has others)
        for b in batches:
            kind, a, z, doc, start, n = (b.column(c).to_numpy() for c in ("kind", "a", "z", "doc", "start", "n"))
            out = [(np.zeros(int((kind == 1).sum()), np.int32), a[kind == 1], doc[kind == 1], start[kind == 1], n[kind == 1])]
            o = kind == 0
            a, z, doc, start, n = a[o], z[o], doc[o], start[o], n[o]
            if len(a):
                if last is not None:  # the segment under way goes first again
                    a, z, doc, start, n = (np.concatenate([np.array([v], x.dtype), x]) for v, x in zip(last[:5], (a, z, doc, start, n), strict=True))
                new_a = np.ones(len(a), bool)
                new_a[1:] = a[1:] != a[:-1]
                new = new_a.copy()
                new[1:] |= z[1:] != z[:-1]
                at = np.flatnonzero(new)
                head = at[np.cumsum(new) - 1]
                again = ~new & ((doc != doc[head]) | (start != start[head]))
                out.append((np.zeros(int(again.sum()), np.int32), a[again], doc[again], start[again], n[again]))
                firsts = new_a[at]  # among heads: first of its gram
                more = ~firsts
                more[:-1] |= ~firsts[1:]
                if last is not None and last[5]:
                    more[0] = False  # went out with the batch before
                    if len(at) > 1 and not firsts[1]:
                        more[1] = True
                send = at[more]
                out.append((np.ones(len(send), np.int32), a[send], doc[send], start[send], n[send]))
                h = at[-1]
                sent = bool(more[-1]) or (len(at) == 1 and last is not None and last[5])
                last = (a[h], z[h], doc[h], start[h], n[h], sent)
            role, a, doc, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (role, a, doc, start.astype(np.int32), n.astype(np.int32))],
                                             names=["role", "a", "doc", "start", "n"])

    dealt = rows.repartition("k").sortWithinPartitions("kind", "a", "z", "doc", "start")
    return dealt.mapInArrow(run, "role int, a long, doc long, start int, n int")


def _shards(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Rows (doc, start, n): repeated windows among the distinct segments of each gram."""
    segs = found.where("role = 1").drop("role")
    hot = segs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("a", F.lit(True).alias("hot"))
    listed = segs.join(hot, "a", "left").groupBy("doc").agg(
        F.collect_list(F.struct("a", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segs"))
    texts = in_buckets(docs, segs, "doc").join(listed, "doc")

    def cut(batches):
        import pyarrow as pa

        def batch(k, doc, start, n, h, data):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()),
                                               pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(data, pa.binary())],
                                              names=["k", "doc", "start", "n", "h", "data"])

        for b in batches:
            raw, off = string_buffers(b.column("text"))
            lists = b.column("segs")
            flat = lists.flatten()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            a, start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "start", "n"))
            hots = flat.field("hot").to_numpy(zero_copy_only=False)
            ids = b.column("doc").to_numpy()
            rows, size = ([], [], [], [], [], []), 0
            for i in range(len(ids)):
                base = off[i]
                for j in range(at[i], at[i + 1]):
                    data = raw[base + start[j]:base + start[j] + n[j] - 1 + length]
                    if hots[j]:  # windows go by their own hash, without text
                        h1, h2 = window_hashes(data, length)
                        for w in range(n[j]):
                            for x, v in zip(rows, (h1[w], ids[i], start[j] + w, 0, h2[w], None), strict=True):
                                x.append(v)
                    else:
                        for x, v in zip(rows, (a[j], ids[i], start[j], n[j], 0, data.tobytes()), strict=True):
                            x.append(v)
                    size += len(data)
                if size > 1 << 20:
                    yield batch(*rows)
                    rows, size = ([], [], [], [], [], []), 0
            yield batch(*rows)

    pieces = texts.select("doc", "text", "segs").mapInArrow(cut, "k long, doc long, start int, n int, h long, data binary")
    if not hot.isEmpty():
        pieces = materialize(pieces, "sub-pieces")
    cold = pieces.where("data IS NOT NULL").repartition("k").sortWithinPartitions("k")

    def sort(batches):
        import pyarrow as pa

        def result():
            d, s, n = shard_repeats(np.array(docs_, np.int64), np.array(starts, np.int64), np.array(counts, np.int64), texts_, length)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))],
                                              names=["doc", "start", "n"])

        drop_model()
        docs_, starts, counts, texts_, size, last = [], [], [], [], 0, None
        for b in batches:
            for k, d, s, n, t in zip(*(b.column(c).to_pylist() for c in ("k", "doc", "start", "n", "data")), strict=True):
                if k != last and size >= SHARD_BYTES:
                    yield result()
                    docs_, starts, counts, texts_, size = [], [], [], [], 0
                last = k
                docs_.append(d)
                starts.append(s)
                counts.append(n)
                texts_.append(t)
                size += len(t)
        if texts_:
            yield result()

    out = cold.mapInArrow(sort, "doc long, start int, n int")
    if hot.isEmpty():
        return out
    win = pieces.where("data IS NULL").select("k", "h", "doc", "start")
    first = win.groupBy("k", "h").agg(F.min(F.struct("doc", "start")).alias("f"))
    rest = win.join(first, ["k", "h"]).where("struct(doc, start) <> f").select("doc", "start", F.lit(1).alias("n"))
    return out.unionByName(rest)


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (doc, start, n): the windows of ``length`` bytes beginning at start .. start + n - 1 (from 0) occur earlier, in a text
    with a smaller id or before in the same text. Ids are integers and identify texts: rows that share an id must have equal texts
    (``ValueError`` otherwise) and count once; rows with a NULL id come last, as one document. NULL counts as empty."""
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    h = F.xxhash64("text")
    if not docs.groupBy("doc").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").isEmpty():
        raise ValueError(f"rows that share {id_col} have different texts")
    found = materialize(_merge_rows(_segment_rows(docs, length)), "sub-segments")
    return materialize(found.where("role = 0").select("doc", "start", "n").unionByName(_shards(found, docs, length)), "sub-windows")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                   whole_characters: bool = False) -> DataFrame:
    """The columns of ``df`` with ``kept`` (binary: the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    Texts shorter than ``length``, NULL and empty ones keep all their bytes (NULL: none). An empty table stays empty.
    ``ValueError`` if a result column is there already. Only texts that lose bytes, and those whose bucket they share, are shuffled.
    ``whole_characters``: a character that loses a byte goes whole, so ``kept`` is UTF-8."""
    if clash := {"kept", "n_bytes", "n_removed", "n_spans", "doc", "__spans"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    windows = repeated_windows(df, id_col, text, length)
    docs = df.withColumn("doc", F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)))
    spans = windows.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("__spans"))
    kind = "array<struct<start:int,n:int>>"
    hit = in_buckets(docs, windows, "doc").join(spans, "doc", "left").select(*df.columns, F.col("__spans").cast(kind).alias("__spans"))
    free = in_buckets(docs, windows, "doc", "left_anti").select(*df.columns, F.lit(None).cast(kind).alias("__spans"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, spans in zip(b.column(text), b.column("__spans"), strict=True):
                data = (t.as_py() or "").encode()
                if not spans.is_valid or not len(spans):
                    out.append((data, len(data), 0, 0))
                    continue
                v = spans.values
                start, n = v.field("start").to_numpy(), v.field("n").to_numpy()
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, start, 1)
                np.add.at(step, start + n - 1 + length, -1)
                gone = np.cumsum(step[:-1]) > 0
                if whole_characters:
                    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
                    gone = (np.bincount(char, gone, minlength=1) > 0)[char]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((kept, len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())))
            rest = b.drop_columns(["__spans"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3))],
                names=[*rest.schema.names, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = df.withColumns({"kept": F.lit(b""), "n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"),
                             "n_spans": F.lit(0).cast("long")}).schema
    return hit.mapInArrow(run, schema).unionByName(free.mapInArrow(run, schema))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """For tests: a set of all windows, in order."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\x01" * length
            else:
                seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
