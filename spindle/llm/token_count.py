"""Token counts by a compiled finite-state transducer over bytes, chunk by chunk.

Transducer. The last token of the encoding of every prefix of a piece follows from that of shorter prefixes:
``s`` ends the prefix that ends with it if the pair (last token before ``s``, ``s``) is one the merges
leave alone, and exactly one ``s`` is. A state therefore holds the longest suffix that can still become
part of a longer token, and for each position in it the last token and the token count relative to the
present one, where a longer token could begin. A transition on a byte is annotated with the change of the count; the annotations along a piece
add up to its number of tokens. States are compiled from the merge list when first reached and kept in a
table of bounded size (started anew when full).

Chunks. A change from a non-space to a space always ends a piece, whatever came before. So the map of a
chunk (entry state -> count and exit state) is: the bytes up to the first such place, which need the entry
state; a number for the middle; the bytes after the last such place, which are the exit state. Maps compose
associatively, and a work-efficient prefix scan composes those of a document.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bpe import PATTERN, Merges, default_path, read_vocabulary
from spindle.llm.common import per_worker, table

CHUNK = 32_768  # characters
STATES = 400_000  # compiled states kept per worker
MEMO = 400_000  # pieces whose count is remembered per worker

ChunkMap = tuple[str, int | None, str]  # head, tokens between, tail; None: no certain boundary inside


class Counts(dict):
    """Counts of whole pieces met before; emptied when full."""

    def __init__(self, machine: CountTransducer, most: int):
        super().__init__()
        self.machine, self.most = machine, most

    def __missing__(self, piece: str) -> int:
        n = self.machine.piece(piece.encode())
        if len(piece) < 100:
            if len(self) >= self.most:
                self.clear()
            self[piece] = n
        return n


class CountTransducer:
    def __init__(self, merges: Merges, most_states: int = STATES, most_pieces: int = MEMO):
        self.merges, self.most_states = merges, most_states
        self.token = {b: i for i, b in merges.bytes.items() if i not in merges.special.values()}
        self.prefixes = {b[:k] for b in self.token for k in range(1, len(b))} | {b""}
        self.single: dict[int, bool] = {}
        self.pair: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")
        self.inner = regex.compile(r"\P{White_Space}\p{White_Space}")
        self.inner_last = regex.compile(r"(?r)\P{White_Space}\p{White_Space}")
        self.memo = Counts(self, most_pieces)
        self._start_over()

    def _start_over(self) -> None:
        self.cells: dict[tuple[int, int], tuple[int, int]] = {}  # equal (token, count) pairs are kept once
        self.states: dict[tuple, int] = {}
        self.of: list[tuple] = []
        self.go: dict[int, tuple[int, int]] = {}  # state * 256 + byte -> (state, change of the count)
        self._state((b"", ((-1, 0),)))

    def _state(self, key: tuple) -> int:
        n = self.states.setdefault(key, len(self.of))
        if n == len(self.of):
            self.of.append(key)
        return n

    def _stands(self, before: int, t: int) -> bool:
        """Whether the merges leave ``before``, ``t`` (or ``t`` alone) as they are."""
        of = self.merges.bytes
        if before < 0:
            if t not in self.single:
                self.single[t] = self.merges.encode(of[t]) == [t]
            return self.single[t]
        k = before << 20 | t
        if k not in self.pair:
            if len(self.pair) > 500_000:
                self.pair.clear()
            self.pair[k] = self.merges.encode(of[before] + of[t]) == [before, t]
        return self.pair[k]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, tails = self.of[state]
        read = suffix + bytes([byte])
        for k in range(len(read)):
            t = self.token.get(read[k:])
            if t is not None and self._stands(tails[k][0], t):
                break
        else:
            raise AssertionError("no last token")
        count = tails[k][1] + 1
        tails = (*tails, (t, count))
        k = next(k for k in range(len(read) + 1) if read[k:] in self.prefixes)
        keep, prefixes = self.cells.setdefault, self.prefixes
        to = self._state((read[k:], tuple(
            keep((x := (v[0], v[1] - count)), x) if v and read[j:] in prefixes else None
            for j, v in enumerate(tails[k:], k))))
        self.go[state << 8 | byte] = to, count
        return to, count

    def piece(self, data: bytes) -> int:
        state = n = 0
        go = self.go
        for b in data:
            step = go.get(state << 8 | b)
            state, d = step if step is not None else self._compile(state, b)
            n += d
        if len(self.of) > self.most_states:
            self._start_over()
        return n

    def _pieces(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.pattern.findall(text)))

    def count(self, text: str) -> int:
        """Tokens of a whole text, special strings as the library takes them (one token each)."""
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + (self._pieces(text[at:m.start()]) if m.start() > at else 0)
            at = m.end()
        return n + (self._pieces(text[at:] if at else text) if at < len(text) else 0)

    def chunk_map(self, text: str) -> ChunkMap:
        first = self.inner.search(text)
        if not first:
            return text, None, ""
        a, b = first.start() + 1, self.inner_last.search(text).start() + 1
        return text[:a], self.count(text[a:b]) if b > a else 0, text[b:]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2])

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Maps of all prefixes: neighbours are composed, their scan is taken, the odd places are filled in."""
        if len(maps) < 2:
            return list(maps)
        up = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(up[i // 2] if i % 2 else self.compose(up[i // 2 - 1], maps[i]))
        return out

    def total(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of all chunks together, the last of :meth:`scan`: neighbours are composed, then their neighbours. A count needs only
        this one; where chunks are one unresolved run, the other prefixes would hold its text a number of times that grows with it."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def apply(self, m: ChunkMap) -> int:
        """Count of a text whose map is ``m``: entry at the start of the text, nothing after it."""
        return self.count(m[0]) + (0 if m[1] is None else m[1] + self.count(m[2]))


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns of ``df`` except ``text``, with ``n_bytes`` and ``n_tokens`` (long) of each row's text.

    NULL and empty texts have 0 of both. Rows are counted one by one, also repeated ones. ``ValueError`` if
    a result column is there already. Texts are not shuffled: chunk maps are made where the text is read, and
    only maps (of texts longer than a chunk, with their unresolved ends) are brought together.
    """
    if clash := {"n_bytes", "n_tokens", "__row", "__part", "__mid", "__head", "__tail"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    vocabulary = read_vocabulary(path or default_path())
    raw = df.sparkSession.sparkContext.broadcast(vocabulary)
    name = f"counts-{hashlib.md5(vocabulary).hexdigest()}"
    keep = [c for c in df.columns if c != text]
    numbered = df.withColumns({"__row": F.monotonically_increasing_id(),
                               "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    inner = "__part int, __head string, __mid long, __tail string"
    kept = numbered.drop(text).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), inner])

    def machine() -> CountTransducer:
        return per_worker(name, lambda: CountTransducer(Merges(raw.value)))

    def maps(batches):
        import pyarrow as pa

        for b in batches:
            tr = machine()
            at, part, head, mid, tail = [], [], [], [], []
            for i, v in enumerate(b.column(text)):
                t = v.as_py() or ""
                if len(t) <= chunk:
                    rows = [("", tr.count(t), "")]
                else:
                    rows = [tr.chunk_map(t[a:a + chunk]) for a in range(0, len(t), chunk)]
                for k, (h, m, e) in enumerate(rows):
                    at.append(i)
                    part.append(k)
                    head.append(h)
                    mid.append(m)
                    tail.append(e)
            rest = b.drop_columns([text]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(part, pa.int32()), pa.array(head, pa.string()), pa.array(mid, pa.int64()),
                 pa.array(tail, pa.string())], names=[*rest.schema.names, "__part", "__head", "__mid", "__tail"])

    def compose(batches):
        import pyarrow as pa

        open_rows: list[ChunkMap] = []
        last = None  # one-row batch of the document under way

        def close():
            tr = machine()
            n = tr.apply(tr.total(open_rows))
            return pa.RecordBatch.from_arrays([*last.columns, pa.array([n], pa.int64())],
                                              names=[*last.schema.names, "n_tokens"])

        for b in batches:
            rows = b.column("__row").to_pylist()
            trio = list(zip(b.column("__head").to_pylist(), b.column("__mid").to_pylist(),
                            b.column("__tail").to_pylist(), strict=True))
            plain = b.drop_columns(["__part", "__head", "__mid", "__tail"])
            firsts, counts = [], []
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j] == rows[i]:
                    j += 1
                if last is not None and last.column("__row")[0].as_py() == rows[i]:
                    open_rows += trio[i:j]
                else:
                    if last is not None:
                        yield close()
                        last = None
                    if j < len(rows):
                        tr = machine()
                        firsts.append(i)
                        counts.append(tr.apply(tr.total(trio[i:j])) if j - i > 1 or trio[i][1] is None or trio[i][0]
                                      or trio[i][2] else trio[i][1])
                    else:
                        last, open_rows = plain.slice(i, 1), trio[i:j]
                i = j
            if firsts:
                part = plain.take(pa.array(firsts, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())],
                                                 names=[*part.schema.names, "n_tokens"])
        if last is not None:
            yield close()

    out = numbered.mapInArrow(maps, schema).repartition("__row").sortWithinPartitions("__row", "__part")
    final = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long"])
    return out.mapInArrow(compose, final).select(*keep, "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 512)
