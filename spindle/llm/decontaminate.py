"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become sequences of 64-bit word hashes. Fixed masks over SPAN words ignore some positions; the hashes
of the kept words of every benchmark window are joined with those of every document window. Positions that all masks
keep are probed first, so the masks are applied to windows that pass (none is lost by that). Around a hit, the diagonal of the
document against the whole item is scored (+1 a word that agrees, -2 one that does not) and the best segment
decides, so substitutions are tolerated. Items of SPAN to SMALL words are also met by every six words in a row, which any segment that
counts has. Shorter items are looked up whole, as words and, in scripts without spaces, characters.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import table

SPAN = 13
#: Positions kept by each mask. Any position of an item of more than SMALL words is ignored by a mask or outside in some window.
MASKS = ["1101100110111", "1110010111011", "1011101001111"]
KEPT = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
COMMON = sorted(set.intersection(*map(set, KEPT)))  # 0, 11, 12
MISS = -2
LEAST = 10  # score of the best segment from which an overlap counts
SLICE_WORDS = 200_000  # benchmark words broadcast at a time (about 60 bytes of seeds each); larger sets take several passes

BLOCK = 4096  # windows of a text that are looked up at a time, so that a long text's hits are not held all at once, each with the text

SMALL = 15  # a segment of so few words that scores LEAST has one miss at most, so RUN words in a row agree
RUN = 6
PREFIXES = [8, 4, 2, 1]  # words that begin a short item and are looked up, as many as it has

WORDS = r"[\p{L}\p{N}]+"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Words, but every character of a script without spaces is one.
UNITS = rf"[{_UNSPACED}&&[\p{{L}}\p{{N}}\p{{M}}]]|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"


def words(text: str, pattern: str = WORDS) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))


def hashed(text: str, pattern: str = WORDS) -> Column:
    return F.transform(words(text, pattern), lambda w: F.xxhash64(w))


def _window(h: str, pos: str, kept: list[int]) -> Column:
    """Hash of the kept words of the window of ``h`` that begins at ``pos`` (from 0)."""
    return F.xxhash64(*(F.element_at(h, (F.col(pos) + 1 + k).cast("int")) for k in kept))


def _starts(h: str) -> Column:
    return F.when(F.size(h) >= SPAN, F.sequence(F.lit(0), F.size(h) - SPAN)).otherwise(F.array().cast("array<int>"))


def _blocks(texts: DataFrame, margin: int) -> DataFrame:
    """Rows (__doc, __first, __h, __own, __many): texts (__doc, __h) in blocks. A block holds the words from place __first on; windows that
    begin at its __many words from __own on are its own, and ``margin`` more words stand around them as far as the text has them."""
    step = max(BLOCK, margin)
    n = F.size("__h")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def block(at: Column) -> Column:
        first = F.greatest(at - margin, F.lit(0))
        return F.struct(first.alias("first"), F.slice("__h", first + 1, F.lit(step + 2 * margin)).alias("h"), (at - first).alias("own"))

    return texts.select("__doc", F.explode(F.transform(starts, block)).alias("b")).select(
        "__doc", F.col("b.first").alias("__first"), F.col("b.h").alias("__h"), F.col("b.own").alias("__own"), F.lit(step).alias("__many"))


def _windows(left: DataFrame, kept: list[int], name: str) -> DataFrame:
    """Windows of blocks: place __p in __h and the hash ``name`` of the kept words."""
    shift = [F.slice("__h", F.col("__own") + (k + 1), F.col("__many")).alias(f"w{k}") for k in kept]
    windows = left.select("__doc", "__first", "__h", "__own", F.posexplode(F.arrays_zip(*shift)).alias("__i", "w"))
    return windows.where(F.col(f"w.w{kept[-1]}").isNotNull()).select(
        "__doc", "__first", "__h", (F.col("__own") + F.col("__i")).alias("__p"), F.xxhash64(*(F.col(f"w.w{k}") for k in kept)).alias(name))


def _agree(kept: list[int], back: int = 0) -> Column:
    """Whether document and item agree in the kept words of the windows ``back`` words before __p and __q; False outside of either."""
    same = [F.get("__h", F.col("__p") + (k - back)) == F.get("__ih", F.col("__q") + (k - back)) for k in kept]
    return F.coalesce(functools.reduce(Column.__and__, same), F.lit(False))


def _scored(hits: DataFrame) -> DataFrame:
    """Best segments from LEAST on, for hits (__doc, __first, __h, __p, __item, __ih, __q). Of the document goes on only what the item is
    laid on. Each explode holds one row; it keeps the cut before and the score behind it from being computed again or later."""
    d = F.col("__p") - F.col("__q")
    low = F.greatest(F.lit(0), -d)
    laid = F.struct(F.slice("__h", (d + low + 1).cast("int"), F.size("__ih")).alias("part"),
                    F.slice("__ih", (low + 1).cast("int"), F.size("__ih")).alias("item"), (F.col("__first") + d + low).alias("at"))
    cut = hits.select("__doc", "__item", F.explode(F.array(laid)).alias("l"))
    return cut.select("__doc", "__item", F.explode(F.array(segment(F.col("l.part"), F.col("l.item"), F.col("l.at")))).alias("s")).where(
        F.col("s.score") >= LEAST)


def segment(part: Column, item: Column, at: Column) -> Column:
    """Best segment (score, words, agreeing words, first word in the document) of an item's words laid on those of a document from ``at`` on."""
    pairs = F.zip_with(part, item, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(-1)))
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("len"), F.lit(0).alias("same"), F.lit(0).alias("at"), F.lit(0).alias("score"),
                    F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0).alias("start"))

    def step(s: Column, x: Column) -> Column:
        run = s["run"] + F.when(x == 1, 1).otherwise(MISS)
        on = (run > 0) & (x >= 0)
        length, same = s["len"] + 1, s["same"] + F.when(x == 1, 1).otherwise(0)
        better = on & (run > s["score"])
        return F.struct(F.when(on, run).otherwise(0).alias("run"), F.when(on, length).otherwise(0).alias("len"),
                        F.when(on, same).otherwise(0).alias("same"), (s["at"] + 1).alias("at"),
                        F.when(better, run).otherwise(s["score"]).alias("score"), F.when(better, length).otherwise(s["n"]).alias("n"),
                        F.when(better, same).otherwise(s["hits"]).alias("hits"),
                        F.when(better, s["at"] + 1 - length).otherwise(s["start"]).alias("start"))

    best = F.aggregate(pairs, zero, step)
    return F.struct(best["score"].alias("score"), best["n"].alias("n_overlap"), best["hits"].alias("n_matched"),
                    (best["start"] + at).cast("long").alias("doc_start"))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", short: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, n_matched, n_overlap, score, doc_start), one for each document and item that overlap: its best segment.

    NULL and empty texts and texts of fewer than SPAN words overlap with nothing; with ``short``, items of fewer than SPAN words overlap
    with texts of any length that hold their whole sequence of UNITS (case and punctuation aside). Ids that repeat are one document or item (the best of
    their segments counts). Empty tables give no rows. Items that do not fit one broadcast are taken in slices, a pass each."""
    items = benchmark.select(F.col(item_id).alias("__item"), hashed(item_text).alias("__ih")).where(F.size("__ih") >= SPAN)
    small = items.where(F.size("__ih") <= SMALL)
    total, n_small, longest = items.agg(F.sum(F.size("__ih")), F.count_if(F.size("__ih") <= SMALL), F.max(F.size("__ih"))).first()
    slices = 1 + (total or 0) // SLICE_WORDS
    left = _blocks(docs.select(F.col(doc_id).alias("__doc"), hashed(text).alias("__h")), longest or SPAN)
    found = None
    for k in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("__item"), F.lit(slices)) == k)
        one = _pass(left, part)
        found = one if found is None else found.unionByName(one)
    few = -(-n_small * SMALL // SLICE_WORDS)  # slices of the small items, none if there are none
    for k in range(few):
        part = small if few == 1 else small.where(F.pmod(F.xxhash64("__item"), F.lit(few)) == k)
        found = found.unionByName(_small(left, part))
    if short:
        found = _short(found, docs.select(F.col(doc_id).alias("__doc"), hashed(text, UNITS).alias("__h")), benchmark.select(
            F.col(item_id).alias("__item"), hashed(item_text, UNITS).alias("__ih"), F.size(words(item_text)).alias("__n")))
    best = F.max(F.struct("s.score", "s.n_matched", F.negative("s.doc_start").alias("back"), "s.n_overlap")).alias("b")
    out = found.groupBy("__doc", "__item").agg(best)
    return out.select(F.col("__doc").alias(doc_id), F.col("__item").alias(item_id), F.col("b.n_matched").cast("long").alias("n_matched"),
                      F.col("b.n_overlap").cast("long").alias("n_overlap"), F.col("b.score").cast("long").alias("score"),
                      F.negative("b.back").alias("doc_start"))


def _pass(left: DataFrame, items: DataFrame) -> DataFrame:
    starts = items.withColumn("__q", F.explode(_starts("__ih")))
    probe = starts.select(_window("__ih", "__q", COMMON).alias("__common")).distinct()
    seeds = starts.select("__item", "__q", F.explode(F.array(*(
        F.struct(F.lit(m).alias("mask"), _window("__ih", "__q", kept).alias("seed")) for m, kept in enumerate(KEPT)))).alias("s")).select(
        "__item", "__q", F.col("s.mask").alias("__mask"), F.col("s.seed").alias("__seed"))
    near = _windows(left, COMMON, "__common").join(F.broadcast(probe), "__common", "left_semi")
    masked = near.select("__doc", "__first", "__h", "__p", F.explode(F.array(*(
        F.struct(F.lit(m).alias("mask"), _window("__h", "__p", kept).alias("seed")) for m, kept in enumerate(KEPT)))).alias("s"))
    hits = masked.join(F.broadcast(seeds), (F.col("s.seed") == F.col("__seed")) & (F.col("s.mask") == F.col("__mask"))).join(
        F.broadcast(items.select(F.col("__item").alias("__i2"), "__ih")), F.col("__item").eqNullSafe(F.col("__i2")))
    # one hit of a run on a diagonal is enough: the first, by the first mask that meets it
    met = functools.reduce(Column.__or__, [(F.col("__mask") > m) & _agree(kept) for m, kept in enumerate(KEPT[:-1])] + [_agree(kept, 1) for kept in KEPT])
    return _scored(hits.where(~met))


def _in_a_row(left: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """Places __p of the texts where the ``n`` words of a seed (hash __seed) stand in a row, with the columns of the seed."""
    # the probe has no condition, so it is compiled with the windows and only hits are copied out with their whole text
    near = _windows(left, list(range(n)), "__seed").join(F.broadcast(seeds.select("__seed").distinct()), "__seed", "left_semi")
    return near.join(F.broadcast(seeds), "__seed")


def _small(left: DataFrame, items: DataFrame) -> DataFrame:
    at = items.withColumn("__q", F.explode(F.sequence(F.lit(0), F.size("__ih") - RUN)))
    seeds = at.select("__item", "__ih", "__q", _window("__ih", "__q", list(range(RUN))).alias("__seed"))
    return _scored(_in_a_row(left, seeds, RUN).where(~_agree([0], 1)))  # the first hit of a run


def _short(found: DataFrame, left: DataFrame, items: DataFrame) -> DataFrame:
    """``found`` with the places of whole items of fewer than SPAN words: their first words are met, then all are compared."""
    n = F.size("__ih")
    items = items.where((F.col("__n") < SPAN) & (n > 0)).drop("__n").withColumn(
        "__k", F.coalesce(*(F.when(n >= k, F.lit(k)) for k in PREFIXES)))
    total, lengths, longest = items.agg(F.sum(n), F.sort_array(F.collect_set("__k")), F.max(n)).first()
    if not lengths:
        return found
    left = _blocks(left, longest)
    slices = 1 + total // SLICE_WORDS
    for i in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("__item"), F.lit(slices)) == i)
        for k in lengths:
            seeds = part.where(F.col("__k") == k).select("__item", "__ih", F.xxhash64(*(F.get("__ih", F.lit(j)) for j in range(k))).alias("__seed"))
            hits = _in_a_row(left, seeds, k).where(F.slice("__h", F.col("__p") + 1, n) == F.col("__ih"))
            found = found.unionByName(hits.select("__doc", "__item", F.struct(
                n.alias("score"), n.alias("n_overlap"), n.alias("n_matched"), (F.col("__first") + F.col("__p")).cast("long").alias("doc_start")).alias("s")))
    return found


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def oracle(docs: str = "documents", items: str = "benchmark") -> str:
    """The same rows by DuckDB: words compared as text, prefix sums along each diagonal."""
    kept = lambda m: " AND ".join(f"a.w[p + {k}] = b.w[q + {k}]" for k in KEPT[m])
    key = lambda m, w, at: "concat_ws(' ', " + ", ".join(f"{w}[{at} + {k}]" for k in KEPT[m]) + ")"
    seeds = " UNION ALL ".join(
        f"SELECT doc_id, item_id, p - q AS d FROM (SELECT doc_id, p, {key(m, 'w', 'p')} AS s FROM dw) JOIN "
        f"(SELECT item_id, q, {key(m, 'w', 'q')} AS s FROM iw) USING (s)" for m in range(len(MASKS)))
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH dt AS (SELECT doc_id, regexp_extract_all({low}, '{WORDS}') AS w FROM {docs}),
it AS (SELECT item_id, regexp_extract_all({low}, '{WORDS}') AS w FROM {items}),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS p FROM dt WHERE len(w) >= {SPAN}),
iw AS (SELECT item_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS q FROM it WHERE len(w) >= {SPAN}),
hit AS (SELECT DISTINCT doc_id, item_id, d FROM ({seeds})),
al AS (SELECT h.doc_id, h.item_id, h.d, g.q, (dt.w[h.d + g.q] = it.w[g.q])::INT AS same
       FROM hit h JOIN dt USING (doc_id) JOIN it USING (item_id), unnest(range(1, len(it.w) + 1)) AS g(q)
       WHERE h.d + g.q BETWEEN 1 AND len(dt.w)),
ps AS (SELECT *, sum(CASE same WHEN 1 THEN 1 ELSE {MISS} END) OVER u AS c, sum(same) OVER u AS m
       FROM al WINDOW u AS (PARTITION BY doc_id, item_id, d ORDER BY q)),
pair AS (SELECT b.doc_id, b.item_id, b.d, a.q AS q0, b.q AS q1,
                b.c - a.c + CASE a.same WHEN 1 THEN 1 ELSE {MISS} END AS score, b.m - a.m + a.same AS n_matched
         FROM ps a JOIN ps b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.d = b.d AND a.q <= b.q
         WHERE a.same = 1 AND b.same = 1),
diag AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY score DESC, q1, q0 DESC) AS k FROM pair),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, n_matched DESC, d + q0) AS r
         FROM diag WHERE k = 1 AND score >= {LEAST})
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(q1 - q0 + 1 AS BIGINT) AS n_overlap, CAST(score AS BIGINT) AS score,
       CAST(d + q0 - 1 AS BIGINT) AS doc_start
FROM best WHERE r = 1
"""


OP10_SQL = oracle()
