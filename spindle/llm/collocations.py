"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word opens one window of up to five words, padded behind the end of its piece. A phrase of
k words occurs once for each window that begins with it, so the windows, sorted, give all shorter phrases as runs of equal
prefixes; no n-gram is exploded.

Windows end before a word that occurs too rarely for any candidate, and the words that stay are numbered by frequency, so that a window is
one or two long numbers. Words are the only thing windows are cut by, and only those far too rare (``RARE``): what a closer cut leaves,
by frequent pairs or longer runs above all, grows much faster than the text, as ever more of them reach the fixed number of occurrences.

A window is dealt by its first two words, or where these are among the most common ones by as many more as it takes to reach another
(``HOT``); what such a task finds of shorter phrases is a part, and the parts are summed. Texts are taken in shards of about ``SHARD``
bytes, staged once as word numbers of the shard. So no task depends on the size of a language, a source or a group of copies.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.common import table
from spindle.session import materialize

ORDER = 5  # words of a window
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases reported per language
SALTS = 64  # keys over which the phrases of a language are dealt
SHARD = 16 << 20  # bytes of text of a shard, about; one document at least
HOT = 256  # a word with this part of all words or more is too common to deal windows by
BLOCK = 1 << 19  # windows looked at together
RARE = 8  # a word ends windows if it occurs less often than this part of what a candidate needs

CUTS = r"[.,;:!?\n\x0B\x0C\r]"  # fixed value: the piece ends of the result contract
GAPS = r"[ \t]+"  # fixed value: the word gaps of the result contract

_SHARDS = "shard long, lang string, words array<string>, seq binary"


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and their numbers of words per piece (pieces without words are left out)."""
    parts = pc.list_flatten(pc.split_pattern_regex(pc.ascii_lower(texts), CUTS))
    lists = pc.split_pattern_regex(parts, GAPS)
    words = pc.list_flatten(lists)
    piece = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    inked = pc.greater(pc.binary_length(words), 0)
    piece = piece[inked.to_numpy(zero_copy_only=False)]
    counts = np.bincount(piece, minlength=len(parts)) if len(piece) else np.zeros(0, np.int64)
    return words.filter(inked), counts[counts > 0]


def _shard(texts: pa.Array) -> tuple[pa.Array, bytes]:
    """The distinct words of some texts, and all their words as numbers into them, -1 behind each piece."""
    words, counts = _pieces(texts)
    coded = words.dictionary_encode()
    seq = np.full(len(words) + len(counts), -1, np.int32)
    ends = np.cumsum(counts + 1)
    inside = np.ones(len(seq), bool)
    inside[ends - 1] = False
    seq[inside] = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, zstandard.ZstdCompressor(level=1).compress(seq.tobytes())


def _shards(docs: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """Rows (shard, lang, words, seq): the words of the documents of one language in one run of rows, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}  # language -> texts
        total = 0

        def flush():
            nonlocal number, total
            for name, parts in held.items():
                words, seq = _shard(pa.concat_arrays(parts))
                if len(words):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), pa.array([name], pa.string()),
                         pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                         pa.array([seq], pa.binary())], names=["shard", "lang", "words", "seq"])
                    number += 1
            held.clear()
            total = 0
            _give_back()

        for b in batches:
            texts, langs = b.column(0).cast(pa.large_string()), b.column(1)
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < len(texts):
                before = int(ends[a - 1]) if a else 0
                e = max(a + 1, int(np.searchsorted(ends, before + size - total, side="right")))
                part, part_langs = texts.slice(a, e - a), langs.slice(a, e - a)
                for name in pc.unique(part_langs):
                    held.setdefault(name.as_py(), []).append(part.filter(pc.equal(part_langs, name)))
                total += int(ends[e - 1]) - before
                a = e
                if total >= size:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("l"))
    return rows.mapInArrow(run, _SHARDS)


def _give_back() -> None:
    """Return freed memory to the system: a worker waits between stages, while the JVM beside it sorts."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _numbers(seq: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(seq.as_py()), np.int32)


def _words(shards: DataFrame) -> DataFrame:
    """Rows (shard, lang, word, i, n): the words of each shard, their numbers and occurrences in it."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("words")[i].values
                seq = _numbers(b.column("seq")[i])
                n = np.bincount(seq[seq >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(b.column("shard")[i], len(words)), pa.repeat(b.column("lang")[i], len(words)), words.cast(pa.string()),
                     pa.array(np.arange(len(words), dtype=np.int32)), pa.array(n.astype(np.int64))],
                    names=["shard", "lang", "word", "i", "n"])
                _give_back()

    return shards.mapInArrow(run, "shard long, lang string, word string, i int, n long")


def _vocabulary(own: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Rows (lang, word, f, id): the words of ``least`` occurrences or more, numbered from 1 by falling frequency, and their number."""
    f = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    ranked = f.orderBy(F.desc("f"), "lang", "word").withColumn("_at", F.monotonically_increasing_id())
    ranked = materialize(ranked, "collocation-vocabulary")
    first, size = [], 0
    part = F.shiftright("_at", 33)  # a row for each sorted part, not for each word
    for r in sorted(ranked.groupBy(part.alias("part")).agg(F.count("*").alias("words")).collect()):
        first += [F.lit(r.part), F.lit(size + 1)]
        size += r.words
    start = F.create_map(*first)[part] if first else F.lit(1)
    return ranked.select("lang", "word", "f", (start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id")), size


class Code:
    """How windows of word numbers below 2 ** ``bits`` are kept: ``per`` of them in one long, the first highest; 0 behind the end."""

    def __init__(self, size: int, order: int):
        self.order, self.bits = order, max(1, size.bit_length())
        self.per = 63 // self.bits
        self.names = [f"a{j}" for j in range(-(-order // self.per))]

    def _shift(self, j: int) -> int:
        return self.bits * (self.per - 1 - j % self.per)

    def pack(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        out = [np.zeros(len(columns[0]), np.int64) for _ in self.names]
        for j, c in enumerate(columns):
            out[j // self.per] |= c.astype(np.int64) << self._shift(j)
        return out

    def unpack(self, longs: list[np.ndarray]) -> list[np.ndarray]:
        return [(longs[j // self.per] >> self._shift(j) & (1 << self.bits) - 1).astype(np.int32) for j in range(self.order)]

    def word(self, j: int) -> Column:
        return F.shiftright(self.names[j // self.per], self._shift(j)).bitwiseAND(F.lit((1 << self.bits) - 1))

    def keys(self, hot: int) -> list[Column]:
        """What a window is dealt by: its words up to the first above ``hot``, two at least."""
        out = [self.word(j) for j in range(min(2, self.order))]
        common = F.lit(True)
        for j in range(2, self.order):
            common = F.greatest(*(self.word(i) for i in range(j))) <= hot
            out.append(F.when(common, self.word(j)).otherwise(0))
        return out


def _windows(shards: DataFrame, ids: DataFrame, code: Code) -> DataFrame:
    """Rows (a0 .., n): the cut windows of two words or more of each shard, with their number of occurrences in each ``BLOCK`` of it.
    ``ids`` has rows (to, i, id) for the words of a shard, 0 or none for those that are too rare."""
    schema = pa.schema([*((c, pa.int64()) for c in code.names), ("n", pa.int64())])
    most = BLOCK

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        number = np.zeros(left.column("known")[0].as_py() + 1, np.int32)  # the last one for the ends of pieces, -1
        number[right.column("i").to_numpy()] = right.column("id").to_numpy()
        seq = np.append(number[_numbers(left.column("seq")[0])], np.zeros(code.order, np.int32))
        on = seq > 0
        every = np.flatnonzero(on[:-1] & on[1:])
        parts = [schema.empty_table()]
        for a in range(0, len(every), most):
            starts = every[a:a + most]
            columns, go = [], np.ones(len(starts), bool)
            for k in range(code.order):
                go = go & on[starts + k]
                columns.append(np.where(go, seq[starts + k], 0))
            grouped = pa.table([pa.array(x) for x in code.pack(columns)], names=code.names)
            grouped = grouped.group_by(code.names, use_threads=False).aggregate([([], "count_all")])
            parts.append(pa.table([*(grouped.column(c) for c in code.names), grouped.column("count_all").cast(pa.int64())], schema=schema))
        _give_back()
        return pa.concat_tables(parts)

    out = ", ".join(f"{c} long" for c in code.names) + ", n long"
    texts = shards.select("shard", F.size("words").alias("known"), "seq")
    return texts.groupBy("shard").cogroup(ids.groupBy("to")).applyInArrow(run, out)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _prefixes(windows: DataFrame, code: Code, hot: int, least: int) -> DataFrame:
    """Rows (ids, f): the phrases of two words or more that begin ``least`` windows or more. Those of words up to ``hot`` alone are in
    parts and of any number, but for the longest: their windows are in several tasks."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last window of the block before
        held = {k: (np.zeros(k, np.int32), 0) for k in range(2, code.order + 1)}  # the run of equal prefixes that is not over

        def rows(k: int, ids: np.ndarray, f: np.ndarray):
            part = (ids <= hot).all(axis=1) if k < code.order else np.zeros(len(ids), bool)
            stay = (ids[:, -1] > 0) & (part | (f >= least))
            ids, f = ids[stay], f[stay]
            ends = pa.array(np.arange(0, k * len(f) + 1, k, dtype=np.int32))
            if len(f):
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(ids.ravel())), pa.array(f)], names=["ids", "f"])

        for block in _blocks(batches, most):
            words = code.unpack([block.column(c).to_numpy() for c in code.names])
            n = block.column("n").to_numpy()
            new = np.zeros(len(n), bool)
            for k in range(1, code.order + 1):
                w = words[k - 1]
                new[1:] |= w[1:] != w[:-1]
                new[0] |= last is None or w[0] != last[k - 1]
                if k == 1:
                    continue
                starts = np.flatnonzero(new)
                ids, f = held[k]
                f += int(n[:starts[0] if len(starts) else len(n)].sum())
                if len(starts):
                    runs = np.stack([x[starts] for x in words[:k]], axis=1)
                    sums = np.add.reduceat(n, starts)
                    yield from rows(k, np.concatenate([ids[None], runs[:-1]]), np.append(f, sums[:-1]))
                    ids, f = runs[-1], int(sums[-1])
                held[k] = ids, f
            last = [int(w[-1]) for w in words]
        for k, (ids, f) in held.items():
            yield from rows(k, ids[None], np.array([f], np.int64))

    dealt = windows.repartition(*code.keys(hot)).sortWithinPartitions(*code.names)
    parts = dealt.mapInArrow(run, "ids array<int>, f long")
    return parts.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, order: int = ORDER,
                  size: int = SHARD) -> DataFrame:
    """Rows (lang, k, phrase, f): each phrase of k <= ``order`` words that occurs ``least`` times or more in a language, its words
    joined by spaces, and with k = 0 the number of all words of the language.

    A-Z is lower-cased. NULL and empty texts have no words, a NULL language is ``und``; repeated rows count one by one; an empty table
    gives no rows; other columns are not read.
    """
    shards = materialize(_shards(docs, text, lang, size), "collocation-shards")
    own = materialize(_words(shards), "collocation-words")
    totals = own.groupBy("lang").agg(F.sum("n").alias("f"))
    vocabulary, known = _vocabulary(own, max(1, least // RARE))
    rows = [totals.select("lang", F.lit(0).alias("k"), F.lit("").alias("phrase"), "f"),
            vocabulary.where(F.col("f") >= least).select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f")]
    if order > 1:
        code = Code(known, order)
        all_words = own.agg(F.sum("n").alias("n")).first().n or 0
        hot = vocabulary.where(F.col("f") * HOT >= all_words).count()
        # words without a number stay in: with the others alone the rows would grow faster than the text; no vocabulary passes the driver
        ids = own.join(vocabulary.hint("merge"), ["lang", "word"], "left").select(
            F.col("shard").alias("to"), "i", F.coalesce("id", F.lit(0)).alias("id"))
        found = _prefixes(_windows(shards, materialize(ids, "collocation-ids"), code), code, hot, least)
        found = materialize(found, "collocation-prefixes")
        named = found.select("ids", "f", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
        named = named.groupBy("ids", "f").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
        rows.append(named.select("lang", F.size("ids").alias("k"), F.concat_ws(" ", F.col("w.word")).alias("phrase"), "f"))
    return materialize(reduce(DataFrame.unionByName, rows), "collocation-counts")


def _big(c: str | Column) -> Column:
    return F.col(c).cast("decimal(18,0)") if isinstance(c, str) else c.cast("decimal(18,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, order: int = ORDER,
                 size: int = SHARD) -> DataFrame:
    """Rows (lang, phrase, k, cut, a, l, r, n, score): the phrases of 2 to ``order`` words with a >= ``least`` occurrences that no
    longer phrase of at least as many occurrences contains, with the cut into two parts of the lowest
    ``floor(1000 a n / (l r))`` (equal scores: the shortest first part). Odd rows as in :func:`phrase_counts`.

    A phrase that occurs as often as a longer one around it occurs as often as those in between, so the phrases
    longer by one word decide. Scores are exact: products are decimals of 38 digits.
    """
    return scored(phrase_counts(docs, text, lang, least, order, size))


def scored(counts: DataFrame) -> DataFrame:
    """The scores of :func:`collocations` from the rows of :func:`phrase_counts`."""
    phrases = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, n: F.concat_ws(" ", F.slice("words", start, n))
    shorter = phrases.where("k > 2").select(
        "lang", F.explode(F.array(part(1, F.col("k") - 1), part(2, F.col("k") - 1))).alias("phrase"), F.col("f").alias("over"))
    covered = shorter.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    stay = phrases.join(covered, ["lang", "phrase"], "left").where("over IS NULL OR over < f")
    cuts = stay.select("lang", "phrase", "k", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(1, F.col("cut")).alias("left"),
                       part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda name, f: counts.where("k > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    rows = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    # a language may hold most of the phrases: its total goes to SALTS keys
    n = n.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(n, ["lang", "_salt"])
    rows = rows.withColumn("_x", _big(F.col("a") * 1000) * _big("n")).withColumn("_y", _big("l") * _big("r"))
    best = rows.withColumn("score", F.expr("_x div _y")).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "b.cut", "a", "b.l", "b.r", "n", "b.score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``."""
    found = collocations(table(spark, sf_dir, "documents"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part of a language first, so that no task sorts more than SALTS * TOP phrases of one
    found = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("_r") <= TOP)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= TOP)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _grams(k: int) -> str:
    words = [f"w{i}" for i in range(1, k + 1)]
    return f"""SELECT lang, {k} AS k, concat_ws(' ', {", ".join(words)}) AS phrase, count(*) AS f FROM win
               WHERE w{k} IS NOT NULL GROUP BY ALL"""


_LEADS = ", ".join(f"lead(w1, {i}) OVER (PARTITION BY pid ORDER BY i) AS w{i + 1}" for i in range(1, ORDER))

OP12_SQL = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS pid,
                  list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM texts),
words AS (SELECT lang, pid, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces),
win AS (SELECT lang, w1, {_LEADS} FROM words),
f AS MATERIALIZED ({" UNION ALL ".join(_grams(k) for k in range(1, ORDER + 1))}),
often AS MATERIALIZED (SELECT row(lang, phrase) AS key, f FROM f WHERE f >= {LEAST}),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
inner_parts AS (
  SELECT lang, a AS over, array_to_string(w[s:s + m - 1], ' ') AS phrase
  FROM cand, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(s)),
covered AS (SELECT lang, phrase, max(over) AS over FROM inner_parts GROUP BY lang, phrase),
stay AS (SELECT c.* FROM cand AS c LEFT JOIN covered AS v USING (lang, phrase)
         WHERE v.over IS NULL OR CAST(100 AS HUGEINT) * v.over < CAST(100 AS HUGEINT) * c.a),
cuts AS (SELECT lang, phrase, a, cut, row(lang, array_to_string(w[1:cut], ' ')) AS lk, row(lang, array_to_string(w[cut + 1:], ' ')) AS rk
         FROM stay, unnest(range(1, k)) AS t(cut)),
lefts AS MATERIALIZED (SELECT c.*, x.f AS l FROM cuts AS c JOIN often AS x ON x.key = c.lk),
both_parts AS MATERIALIZED (SELECT c.*, y.f AS r FROM lefts AS c JOIN often AS y ON y.key = c.rk),
scored AS (
  SELECT lang, phrase, a, cut, l, r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score
  FROM both_parts JOIN total USING (lang)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS p FROM scored),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, CAST(phrase AS BLOB)) AS rank,
                  phrase, a, l, r, n, score FROM best WHERE p = 1)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
