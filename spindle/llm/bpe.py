"""Byte-level BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

Sufficient lookahead. Run the merges of two texts ``w x`` and ``w y`` side by side, rank by rank, and let
the frontier be the end of the common prefix of their token sequences; it starts at ``|w|``. A rule
``u|v`` moves it only if ``v`` begins at the frontier in just one run, and then by ``|u|``. A later rule
``u'|v'`` that moves it again has a higher rank, and its ``v'`` begins where ``u`` began: so ``u`` lies on the
chain of left parts of ``v'`` (``v'``, its left part, that one's left part, ...). Hence the frontier moves by
the heaviest chain of such rules at most, a dynamic program over the ranks (:meth:`Merges.lookahead`).
Tokens that end at least that many bytes before the end of what was read stay whatever follows.

The text is cut into pieces by the vocabulary's split pattern, whose matches are final two characters
later. Ordinary pieces are encoded whole (a bounded memo of pieces); a run longer than ``LONG`` characters
is streamed through a window of at most ``2 * lookahead + LONG`` bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import per_worker, table

#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LONG = 1024  # characters of a piece from which it is streamed
CHUNK = 1 << 16  # characters read at a time
MEMO = 400_000  # pieces remembered per worker


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in own}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return out


class Merges:
    """A byte-level merge list: token bytes by id, rank and result of each pair, special tokens."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.single = [0] * 256
        for c, b in alphabet.items():
            self.single[b] = vocab[c]
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, tuple[int, int]] = {}  # left * 2^20 + right -> (rank, merged id)
        made = set(self.single)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if u not in made or v not in made or w in made:
                raise ValueError(f"merge {rank} uses a part that no earlier merge makes, or makes a token twice")
            made.add(w)
            self.parts[w] = (u, v)
            self.pairs[u << 20 | v] = (rank, w)
        self.text = {i: str(i) for i in self.bytes}

    def left_chain(self, t: int) -> Iterator[int]:
        while True:
            yield t
            if t not in self.parts:
                return
            t = self.parts[t][0]

    def lookahead(self) -> int:
        """Bytes after a token's end that settle it (see the module text)."""
        best: dict[int, int] = {}
        most = 0
        for u, v in self.parts.values():  # in rank order
            w = len(self.bytes[u]) + max((best.get(s, 0) for s in self.left_chain(v)), default=0)
            if w > best.get(u, 0):
                best[u] = w
                most = max(most, w)
        return most

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece: merges by rank, from the left."""
        ids = [self.single[b] for b in piece]
        if len(ids) > 64:
            return self._encode_long(ids)
        get = self.pairs.get
        while len(ids) > 1:
            rank, at, new = 1 << 30, -1, -1
            a = ids[0]
            for i in range(1, len(ids)):
                b = ids[i]
                m = get(a << 20 | b)
                if m is not None and m[0] < rank:
                    rank, new = m
                    at = i
                a = b
            if at < 0:
                break
            ids[at - 1:at + 1] = [new]
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := self.pairs.get(ids[i] << 20 | ids[i + 1]))]
        heap = [(r, i, w) for r, w, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, w = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n or self.pairs.get(ids[i] << 20 | ids[j], (-1,))[0] != r:
                continue
            ids[i], ids[j], nxt[i] = w, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if m := self.pairs.get(w << 20 | ids[nxt[j]]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if prv[i] >= 0 and (m := self.pairs.get(ids[prv[i]] << 20 | w)):
                heapq.heappush(heap, (m[0], prv[i], m[1]))
        return [t for t in ids if t >= 0]


class Memo(dict):
    """Pieces already encoded; emptied when full."""

    def __init__(self, merges: Merges, most: int = MEMO):
        super().__init__()
        self.merges, self.most = merges, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.merges.encode(piece.encode()))
        if len(self) >= self.most:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Text chunks in, final tokens out; holds a bounded rest of the text between the calls."""

    pattern = regex.compile(PATTERN)  # once, not for every text
    runs = {k: regex.compile(v) for k, v in {"L": r"\p{L}+", "N": r"\p{N}+", "S": r"\p{White_Space}+",
                                             "O": r"[^\p{White_Space}\p{L}\p{N}]+"}.items()}

    def __init__(self, merges: Merges, memo: Memo | None = None, long: int = LONG, look: int | None = None):
        self.merges = merges
        self.memo = memo if memo is not None else Memo(merges)
        self.long = long
        self.look = merges.lookahead() if look is None else look
        self.specials = sorted(merges.special, key=len, reverse=True)
        self.rest = ""  # text not yet cut into final pieces
        self.run: str | None = None  # class of a long piece that is under way
        self.window = b""  # its bytes that are not final

    def held(self) -> int:
        return len(self.rest) + len(self.window)

    def feed(self, chunk: str) -> list[int]:
        self.rest += chunk
        out: list[int] = []
        while self.specials:
            at, s = min(((p, s) for s in self.specials if (p := self.rest.find(s)) >= 0), default=(-1, ""))
            if at < 0:
                break
            after = self.rest[at + len(s):]
            self.rest = self.rest[:at]
            out += self._take(True)
            out.append(self.merges.special[s])
            self.rest = after
        hold = max((k for s in self.specials for k in range(1, len(s)) if self.rest.endswith(s[:k])), default=0)
        tail = self.rest[len(self.rest) - hold:] if hold else ""
        self.rest = self.rest[:len(self.rest) - hold] if hold else self.rest
        out += self._take(False, bool(hold))
        self.rest += tail
        return out

    def finish(self) -> list[int]:
        return self._take(True)

    def _stream(self, data: bytes, end: bool) -> list[int]:
        out: list[int] = []
        step = self.look + self.long
        for a in range(0, max(1, len(data)), step):
            self.window += data[a:a + step]
            if end and a + step >= len(data):
                out += self.merges.encode(self.window) if self.window else []
                self.window = b""
            elif len(self.window) > 2 * self.look:
                used = 0
                for t in self.merges.encode(self.window):
                    size = len(self.merges.bytes[t])
                    if used + size > len(self.window) - self.look:
                        break
                    out.append(t)
                    used += size
                self.window = self.window[used:]
        return out

    def _take(self, end: bool, held: bool = False) -> list[int]:
        """Tokens of the final part of ``rest``; ``end``: nothing follows."""
        out: list[int] = []
        while self.rest or (end and self.run):
            if self.run:
                m = self.runs[self.run].match(self.rest)
                n = m.end() if m else 0
                over = n < len(self.rest) or end
                if self.run == "S" and not (over and n == len(self.rest)):
                    n = max(0, n - 1)  # the last space of a run may belong to what follows
                out += self._stream(self.rest[:n].encode(), over)
                self.rest = self.rest[n:]
                if not over:
                    break
                self.run = None
                if not self.rest:
                    break
                continue
            pieces = self.pattern.findall(self.rest)
            size = len(self.rest)
            if not end:
                while pieces and size + 2 > len(self.rest):  # a match is final two characters later
                    size -= len(pieces.pop())
            out += chain.from_iterable(map(self.memo.__getitem__, pieces)) if max(
                map(len, pieces), default=0) <= self.long else chain.from_iterable(
                self.memo[p] if len(p) <= self.long else self._whole(p) for p in pieces)
            self.rest = self.rest[size:]
            if end or len(self.rest) <= self.long:
                break
            piece = self.pattern.match(self.rest).group()
            if len(piece) <= self.long:
                break
            last = piece[-2]
            self.run = next(k for k, p in self.runs.items() if p.match(last))
            if self.run != "S" and self.rest[0] == " ":  # the space that opens the piece
                self.window, self.rest = b" ", self.rest[1:]
        return out

    def _whole(self, piece: str) -> list[int]:
        data, out = piece.encode(), []
        step = self.look + self.long
        for a in range(0, len(data), step):
            out += self._stream(data[a:a + step], a + step >= len(data))
        return out


class Decoder:
    """Token ids in, text out: bytes of unfinished characters (three at most) wait for the next call."""

    def __init__(self, merges: Merges):
        self.of = merges.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file (a fixed size, 1.5 MB here), read once on the driver and broadcast."""
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def worker_merges(raw) -> tuple[Merges, Memo, int]:
    def make():
        m = Merges(raw.value)
        return m, Memo(m), m.lookahead()

    return per_worker(f"merges-{hashlib.md5(raw.value).hexdigest()}", make)


def encode_text(text: str | None, merges: Merges, memo: Memo, look: int) -> Iterator[list[int]]:
    """Token ids of a text, by chunks."""
    if not text:
        return
    enc = Encoder(merges, memo, look=look)
    for a in range(0, len(text), CHUNK):
        yield enc.feed(text[a:a + CHUNK])
    yield enc.finish()


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with an array column of token ids of ``text``.

    NULL and empty texts give an empty array; repeated rows are encoded one by one; an empty table stays
    empty. ``ValueError`` if ``df`` already has the column ``ids``.
    """
    if ids in df.columns:
        raise ValueError(f"the input already has a column {ids}")
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            merges, memo, look = worker_merges(raw)
            out = [list(chain.from_iterable(encode_text(t, merges, memo, look))) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, ids])

    return df.mapInArrow(run, df.withColumn(ids, F.array().cast("array<int>")).schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids; a NULL array gives an empty text, broken UTF-8 gives U+FFFD."""
    if text in df.columns:
        raise ValueError(f"the input already has a column {text}")
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            merges, _, _ = worker_merges(raw)
            out = []
            for row in b.column(ids).to_pylist():
                dec = Decoder(merges)
                out.append(dec.feed(row or []) + dec.finish())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text])

    return df.mapInArrow(run, df.withColumn(text, F.lit("").cast("string")).schema)


def round_trip(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` added to ``df``, both ways by chunks.

    Ids and decoded text go chunk by chunk from the encoder to the decoder and into running digests, so
    a document needs the memory of a chunk besides its own text. NULL counts as empty.
    """
    raw = df.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_path()))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            merges, memo, look = worker_merges(raw)
            counts, of_ids, of_text = [], [], []
            for t in b.column(text):
                n, dec = 0, Decoder(merges)
                a, d = hashlib.sha256(), hashlib.sha256()
                for ids in encode_text(t.as_py(), merges, memo, look):
                    if ids:
                        a.update((("," if n else "") + ",".join(map(merges.text.__getitem__, ids))).encode())
                        d.update(dec.feed(ids).encode())
                        n += len(ids)
                d.update(dec.finish().encode())
                counts.append(n)
                of_ids.append(a.hexdigest())
                of_text.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=[*b.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = df.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit("").cast("string"),
                             "decoded_sha256": F.lit("").cast("string")}).schema
    return df.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
