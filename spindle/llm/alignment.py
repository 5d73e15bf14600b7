"""Alignment of the tokens of two tokenizers over the same text.

Both tokenizers give each document as runs of bytes. ``pandas.merge_asof``, keyed by document, finds for each token start the token
of the other side that covers it; the union of both directions is the set of overlapping pairs (of two
overlapping ranges one begins inside the other). Where the two tokens of such a pair end together, both sequences are cut:
the tokens between two cuts are a group, the smallest unit that both sides spell alike.

Id pairs are counted over the corpus by documents. Documents are taken in shards of about ``SHARD`` bytes of text, staged once:
a row per document with its distinct pairs as numbers into the shard's pair list, and a row per shard with that list and the
number of documents of each pair. Only the shards' lists are exploded, summed and joined; each shard gets its pairs back
with their totals in a cogroup, so no task depends on the size of a group of copies or on how common a token is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bpe import PATTERN, byte_alphabet
from spindle.llm.common import per_worker, table
from spindle.session import materialize

SHARD = 8 << 20  # bytes of text of a shard, about; one document at least
BLOCK = 1 << 20  # bytes of text aligned in one step; one document at least
MEMO = 300_000  # words remembered per worker, and at most CHARS characters; then the memory is started anew
CHARS = 8_000_000
WORD = 200  # characters of a word up to which the plainer of two equal encoders takes it

_WORDS = re.compile(r" *[^ ]+(?:(?<=[^\S ])(?: *[^ ]+| +))*| +")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def read_files(paths: tuple[str, str]) -> tuple[str, bytes, bytes]:
    """A digest of the two vocabulary files and the files (0.5 to 2 MB, of fixed size)."""
    a, b = (open(p, "rb").read() for p in paths)
    return hashlib.sha256(a + b).hexdigest(), a, b


class Side:
    """One tokenizer: the bytes of each id, and the ids of words, remembered.

    Words are runs of spaces with the text behind them. Neither tokenizer has a token that holds a space behind
    another character, so words are encoded apart; a break that is not a space joins its neighbours into one word, as its tokens
    may depend on both.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.encode = encode
        self.length = np.array([len(b) for b in token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.offset = np.append(0, np.cumsum(self.length))
        self.bytes = token_bytes

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        n = self.length[ids]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offset[ids], n)
        return self.flat[at]


def byte_side(raw: bytes) -> Side:
    """A byte-level vocabulary of the tokenizers library; words are given with their spaces."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_str(raw.decode())
    tok.encode_special_tokens = True
    tok.no_padding()
    tok.no_truncation()
    alphabet = byte_alphabet()
    vocab = tok.get_vocab(with_added_tokens=True)
    spelled = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        spelled[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
    specials = set(json.loads(raw)["model"]["vocab"]) ^ set(vocab)
    ranks = {spelled[i]: i for t, i in vocab.items() if t not in specials}
    merged = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in json.loads(raw)["model"]["merges"]]
    fast = None
    if merged == sorted(merged) and len(ranks) == len(vocab) - len(specials):  # ids in merge order are ranks
        fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(words: list[str]) -> list[list[int]]:
        if fast is None:
            return [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]
        out = [fast(w) if len(w) <= WORD else None for w in words]  # its time grows with the square of a run's length
        long = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(long, tok.encode_batch_fast([words[i] for i in long], add_special_tokens=False)):
            out[i] = e.ids
        return out

    return Side(encode, spelled)


def piece_side(raw: bytes) -> Side:
    """A sentencepiece model that puts a space before the text: words lose their first space, which the model adds."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    space = "▁"
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search(f"[^{space}]{space}", p) for p in pieces):
        raise ValueError("a piece holds a space behind another character: words cannot be encoded apart")
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(space, " ").encode() for i, p in enumerate(pieces)]
    alone = sp.piece_to_id(space)

    def encode(words: list[str]) -> list[list[int]]:
        out = sp.encode([w[1:] for w in words], num_threads=1)
        return [[alone] if w == " " else ids for w, ids in zip(words, out)]

    return Side(encode, spelled)


class Pair:
    """Both sides and the words met before, with the ids of each side end to end."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.parts: list[list[np.ndarray]] = [[], []]
        self.sizes: list[list[np.ndarray]] = [[], []]
        self.tables: list = [None, None]

    def learn(self, words: list[str]) -> None:
        for k, side in enumerate(self.sides):
            ids = side.encode(words)
            self.sizes[k].append(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.parts[k].append(np.fromiter(chain.from_iterable(ids), np.int32))
            self.tables[k] = None

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.tables[k] is None:
            self.parts[k], self.sizes[k] = [np.concatenate(self.parts[k])], [np.concatenate(self.sizes[k])]
            sizes = self.sizes[k][0]
            self.tables[k] = self.parts[k][0], sizes, np.cumsum(sizes) - sizes
        return self.tables[k]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, tokens per text) of the texts for each side."""
        words = [_WORDS.findall(t) for t in texts]
        number, new = self.number, []
        if len(number) > MEMO or self.chars > CHARS:
            self.reset()
            number = self.number
        for w in set(chain.from_iterable(words)):
            if w not in number:
                number[w] = len(number)
                self.chars += len(w)
                new.append(w)
        if new:
            self.learn(new)
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        of = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(per_text.sum()))
        row = np.repeat(np.arange(len(texts)), per_text)
        out = []
        for k in (0, 1):
            flat, sizes, first = self._table(k) if number else (np.empty(0, np.int32), *[np.empty(0, np.int64)] * 2)
            n = sizes[of]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of], n)
            out.append((flat[at], np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)))
        return out


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Positions (a, b) of overlapping tokens. Both frames hold (doc, start, end), sorted by start; starts of
    different documents may be equal or not, the key ``doc`` keeps them apart."""
    a, b = (x.assign(pos=np.arange(len(x))) for x in (a, b))
    down = pd.merge_asof(a, b, on="start", by="doc", suffixes=("", "_o"))  # the b token that covers each a start
    up = pd.merge_asof(b, a, on="start", by="doc", suffixes=("", "_o"))
    down = down[["pos", "pos_o"]].set_axis(["a", "b"], axis=1).dropna().astype("int64")
    up = up[["pos_o", "pos"]].set_axis(["a", "b"], axis=1).dropna().astype("int64")
    # tokens that begin together meet in both directions
    begins = a["start"].to_numpy()[up["a"]] == b["start"].to_numpy()[up["b"]]
    return pd.concat([down, up[~begins]], ignore_index=True)


class Aligned:
    """The tokens of some documents: ids, document, and group of each token; groups are numbered through."""

    def __init__(self, ids: list[np.ndarray], doc: list[np.ndarray], group: list[np.ndarray], docs: int):
        self.ids, self.doc, self.group, self.docs = ids, doc, group, docs


def align(pair: Pair, texts: list[str]) -> Aligned:
    """Tokens and groups of texts (with their leading space). Texts that a side does not spell byte for byte have none."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    sides = pair.tokens(texts)
    good = np.fromiter((len(t) > 1 for t in texts), bool, n)  # the empty text is its leading space
    whole = np.frombuffer(b"".join(raw), np.uint8)
    size = np.fromiter(map(len, raw), np.int64, n)
    for side, (ids, counts) in zip(pair.sides, sides):
        spelled = np.bincount(np.repeat(np.arange(n), counts), weights=side.length[ids], minlength=n).astype(np.int64)
        if (spelled == size).all():
            differs = np.flatnonzero(side.spell(ids) != whole)
            good[np.searchsorted(np.cumsum(size), differs, side="right")] = False
        else:  # compare one by one
            ends = np.cumsum(counts)
            for i in range(n):
                if spelled[i] != size[i] or side.spell(ids[ends[i] - counts[i]:ends[i]]).tobytes() != raw[i]:
                    good[i] = False
    base = np.cumsum(size) - size
    out_ids, out_doc, frames = [], [], []
    for side, (ids, counts) in zip(pair.sides, sides):
        doc = np.repeat(np.arange(n), counts)
        if not good.all():
            keep = good[doc]
            ids, doc = ids[keep], doc[keep]
        length = side.length[ids]
        # the bytes of left-out documents count too, so that starts grow from document to document
        start = np.cumsum(length) - length + (base - np.cumsum(size * good) + size * good)[doc]
        out_ids.append(ids)
        out_doc.append(doc)
        frames.append(pd.DataFrame({"doc": doc, "start": start, "end": start + length}))
    met = overlaps(*frames)
    end_a, end_b = frames[0]["end"].to_numpy(), frames[1]["end"].to_numpy()
    a, b = met["a"].to_numpy(), met["b"].to_numpy()
    together = end_a[a] == end_b[b]
    group = []
    for end, last in ((end_a, a[together]), (end_b, b[together])):
        closes = np.zeros(len(end), np.int64)
        closes[last] = 1
        group.append(np.cumsum(closes) - closes)
    return Aligned(out_ids, out_doc, group, n)


def _weighted(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order, and how often each occurs."""
    key, n = np.unique(group.astype(np.int64) << 20 | ids, return_counts=True)
    return key >> 20, (key & ((1 << 20) - 1)).astype(np.int64), n


def links(al: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, a << 20 | b, occurrence pairs), one row per document and linked id pair."""
    ga, a, na = _weighted(al.ids[0], al.group[0])
    gb, b, nb = _weighted(al.ids[1], al.group[1])
    lo, hi = np.searchsorted(gb, ga, side="left"), np.searchsorted(gb, ga, side="right")
    m = hi - lo  # ids of the other side in the group
    left = np.repeat(np.arange(len(ga)), m)
    right = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
    doc_of = np.zeros(int(al.group[0][-1]) + 1 if len(al.group[0]) else 0, np.int64)
    doc_of[al.group[0]] = al.doc[0]
    doc, pair, times = doc_of[ga[left]], a[left] << 20 | b[right], na[left] * nb[right]
    order = np.argsort(doc << 40 | pair)  # a block has fewer than 2^23 documents
    doc, pair, times = doc[order], pair[order], times[order]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))) if len(doc) else np.empty(0, np.int64)
    return doc[head], pair[head], np.add.reduceat(times, head) if len(head) else times


def group_texts(al: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2`` per document; '' without tokens."""
    ids, group, doc = np.concatenate(al.ids), np.concatenate(al.group), np.concatenate(al.doc)
    side = np.repeat([0, 1], [len(x) for x in al.ids])
    order = np.argsort(group, kind="stable")  # a before b inside a group, each in text order
    ids, group, doc, side = ids[order], group[order], doc[order], side[order]
    new_group = np.append(group[1:] != group[:-1], True)[:len(ids)]
    new_side = np.append(side[1:] != side[:-1], True)[:len(ids)]
    last = np.append(doc[1:] != doc[:-1], True)[:len(ids)]
    mark = np.where(last, 3, np.where(new_group, 2, np.where(new_side, 1, 0)))
    joined = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), pa.array([",", "|", ";", ""]).take(pa.array(mark)), "")
    ends = np.searchsorted(doc, np.arange(al.docs + 1), side="left")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), joined), "").to_pylist()


def _worker(raw) -> Pair:
    digest, a, b = raw.value
    return per_worker("alignment-" + digest, lambda: Pair(byte_side(a), piece_side(b)))


def _cut(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b


def groups(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, out: str = "token_groups") -> DataFrame:
    """``docs`` with an array column of the groups in order: the ids of both sides and the byte range in the text with its
    leading space. NULL and empty texts, and those that a side does not spell byte for byte, have none.

    Repeated rows are aligned one by one; an empty table stays empty. ``ValueError`` if the column exists.
    """
    if out in docs.columns:
        raise ValueError(f"the input already has a column {out}")
    raw = docs.sparkSession.sparkContext.broadcast(read_files(paths or default_paths()))
    kind = "array<struct<a:array<int>,b:array<int>,start:bigint,end:bigint>>"

    def run(batches):
        for batch in batches:
            pair, texts, found = _worker(raw), batch.column(text).to_pylist(), []
            for x, y in _cut(batch.column(text), BLOCK):
                al = align(pair, [" " + (t or "") for t in texts[x:y]])
                for d in range(y - x):
                    rows, at = [], 0
                    (ia, ga), (ib, gb) = (((al.ids[k][al.doc[k] == d]), al.group[k][al.doc[k] == d]) for k in (0, 1))
                    for g in np.unique(ga):
                        ids = ia[ga == g]
                        size = int(pair.sides[0].length[ids].sum())
                        rows.append({"a": ids.tolist(), "b": ib[gb == g].tolist(), "start": at, "end": at + size})
                        at += size
                    found.append(rows)
            arrow = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast(kind)).schema)


_STAGED = ("shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pair array<int>, times array<long>, a array<int>, b array<int>, docs array<long>")


def _staged(docs: DataFrame, id: str, text: str, raw, size: int, block: int) -> DataFrame:
    """A row per document (``pair``: numbers into the shard's list, ``times``: links) and a row per shard (``a``, ``b``, ``docs``)."""

    def shard_rows(number, parts):
        pairs = np.concatenate([p[1] for p in parts])
        known, of, n = np.unique(pairs, return_inverse=True, return_counts=True)
        at = 0
        for rows, own, _, ends, times in parts:
            take = of[at:at + len(own)].astype(np.int32)
            at += len(own)
            m = len(rows["doc_id"])
            none = [pa.nulls(m, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, number)), rows["doc_id"], *(pa.array(rows[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                 pa.array(rows["sha"], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(take)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times)), *none], names=names)
        one = pa.array([0, len(known)], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.nulls(1, pa.string()),
             pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
             pa.ListArray.from_arrays(one, pa.array((known >> 20).astype(np.int32))),
             pa.ListArray.from_arrays(one, pa.array((known & ((1 << 20) - 1)).astype(np.int32))),
             pa.ListArray.from_arrays(one, pa.array(n.astype(np.int64)))], names=names)

    names = [c.split(" ")[0] for c in _STAGED.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        pair = _worker(raw)
        number, held, parts = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            texts = batch.column(1)
            for x, y in _cut(texts, block):
                some = [" " + (t or "") for t in texts.slice(x, y - x).to_pylist()]
                al = align(pair, some)
                doc, own, times = links(al)
                m = y - x
                count = lambda d, w=None: np.bincount(d, weights=w, minlength=m).astype(np.int64)
                held_groups = np.unique(al.group[0], return_index=True)[1]
                rows = {"doc_id": batch.column(0).slice(x, m), "n_a": count(al.doc[0]), "n_b": count(al.doc[1]),
                        "n_groups": count(al.doc[0][held_groups]), "n_links": _sums(times, doc, m),
                        "sha": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in group_texts(al)]}
                parts.append((rows, own, None, np.searchsorted(doc, np.arange(m + 1)), times))
                held += sum(map(len, some))
                if held >= size:
                    yield from shard_rows(number, parts)
                    number, held, parts = number + 1, 0, []
        if parts:
            yield from shard_rows(number, parts)

    return docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _STAGED)


def _sums(values: np.ndarray, doc: np.ndarray, m: int) -> np.ndarray:
    """Exact sums of 64-bit values per document (rows in document order)."""
    total = np.append(0, np.cumsum(values.astype(np.int64)))
    ends = np.searchsorted(doc, np.arange(m + 1))
    return total[ends[1:]] - total[ends[:-1]]


def pair_counts(lists: DataFrame) -> DataFrame:
    """Rows (a, b, docs, best): the number of documents of each linked id pair, and whether no pair of the same a has more."""
    pairs = lists.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.a", "p.b", "p.docs")
    totals = pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    top = totals.groupBy("a").agg(F.max("docs").alias("top"))
    return totals.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None,
               size: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per row of ``docs``.

    NULL and empty texts, and texts that a side does not spell byte for byte, have zeros and ''. Repeated rows and rows with a NULL id count
    as documents of their own; an empty table gives no rows; other columns are not read.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_files(paths or default_paths()))
    staged = materialize(_staged(docs, id, text, raw, size, block), "alignment")
    lists = staged.where("a IS NOT NULL").select("shard", "a", "b", "docs")
    totals = pair_counts(lists)
    asked = lists.select("shard", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p")).select("shard", "pos", "p.a", "p.b")
    answers = asked.join(totals, ["a", "b"]).select(F.col("shard").alias("to"), "pos", "docs", "best")
    rows = staged.where("a IS NULL").drop("a", "b", "docs")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        docs_of, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = right.column("pos").to_numpy()
        docs_of[at] = right.column("docs").to_numpy()
        best[at] = right.column("best").to_numpy()
        left = left.combine_chunks()
        m = left.num_rows
        pair = pc.list_flatten(left.column("pair")).to_numpy()
        times = pc.list_flatten(left.column("times")).to_numpy()
        doc = np.repeat(np.arange(m), pc.list_value_length(left.column("pair")).to_numpy())
        keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*(left.column(c) for c in keep), pa.array(_sums(times * best[pair], doc, m)),
                         pa.array(_sums(times * docs_of[pair], doc, m)), left.column("groups_sha256")],
                        names=[*keep, "n_best", "count_sum", "groups_sha256"])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("shard").cogroup(answers.groupBy("to")).applyInArrow(finish, out)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(table(spark, sf_dir, "documents"))
