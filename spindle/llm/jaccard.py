"""Jaccard self-join of word n-gram sets by vertical partitioning of the global n-gram order, and its components.

1. Texts with equal sets are one class (a 128-bit signature that does not depend on order); classes are joined.
2. The order of the n-grams (by hash) is cut into fragments. The first fragments are counted by themselves: per fragment,
   n-grams that only one class has, and these partial counts are summed per class. A class with more of them than
   the threshold leaves can have no link and goes; the rest of its order is never made.
3. For the others all fragments are written, counted likewise, and the classes that now go leave again. N-grams are ranked by the number of classes that have them; the rarest of
   each class, as many as the threshold cannot do without, are its keys, and a link shares a key.
4. Candidates are verified fragment by fragment: partial overlaps are counted separately and summed per pair.
   In a key's group every member is first compared with a few pivots, so members of one
   component need not be compared with each other; then members of different components are, all that
   their lengths, the places of the key in their orders (a pair must overlap by m n-grams, so it shares one among the first
   n - m + 1 of each) and the triangle inequality (over the distances to the first pivot) leave. No link between components is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import blocks, drop_model, in_buckets, mix64, string_buffers, table, windows, word_hashes
from spindle.llm.graph import components
from spindle.session import materialize

FRAGMENT = 750_000  # n-grams of a fragment, about; the number of fragments follows from the data
BUCKET = 50_000  # classes whose partial counts are summed in one call, about
HELD = 300_000  # n-grams gathered before they are cut into fragments
PARTS = 4  # fragments in which the overlap of a pair is counted

_TAG = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes ordered by (row, hash), their row, and their number per row. A-Z count as a-z.
    A row of 1 to k-1 words has one shingle, the whole sequence; a row without words has none."""
    n = len(offsets) - 1
    h, counts = word_hashes(raw, offsets, lower=True)
    win, row = windows(h, counts, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])
        extra = np.empty(len(short), np.uint64)
        for size in range(1, k):  # rows of so many words, all at once
            at = np.flatnonzero(counts[short] == size)
            start = first[short[at]]
            acc = mix64(h[start] ^ np.uint64(int(_TAG) * size % 2**64))
            for j in range(1, size):
                acc = mix64(acc * _TAG + h[start + j])
            extra[at] = acc
        win, row = np.concatenate([win, extra]), np.concatenate([row, short])
    order = np.lexsort((win, row))
    win, row = win[order], row[order]
    if len(win):
        new = np.ones(len(win), bool)
        new[1:] = (win[1:] != win[:-1]) | (row[1:] != row[:-1])
        win, row = win[new], row[new]
    return win, row, np.bincount(row, minlength=n).astype(np.int64)


def signatures(win: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set."""
    ends = np.cumsum(counts)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(win) + 1, np.uint64)
        np.cumsum(mix64(win ^ np.uint64(salt)), out=total[1:])
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


def _batches(batches, text: str, k: int):
    """Blocks of an Arrow stream: (rows of the batch, hashes, row of each, counts, signatures)."""
    drop_model()
    for b in batches:
        raw, off = string_buffers(b.column(text))
        for lo, hi in blocks(off):
            win, row, counts = shingle_sets(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], k)
            yield b.slice(lo, hi - lo), win, row, counts, *signatures(win, counts)


def features(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Rows (id, n, sa, sb): the size and the signature of each text's set."""
    def run(batches):
        import pyarrow as pa

        for part, _, _, counts, sa, sb in _batches(batches, text, k):
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts), pa.array(sa), pa.array(sb)], names=["id", "n", "sa", "sb"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text).mapInArrow(run, f"id {kind}, n long, sa long, sb long")


def _cut(win: np.ndarray, key: np.ndarray, cuts: np.ndarray):
    """One Arrow batch (frag, h, key): hashes and keys below the last cut, a row for each fragment that has some."""
    import pyarrow as pa

    keep = win < cuts[-1]
    h, key = win[keep], key[keep]
    frag = np.searchsorted(cuts, h, side="right") - 1
    order = np.argsort(frag, kind="stable")
    h, key, at = h[order], key[order], np.searchsorted(frag[order], np.arange(len(cuts)))
    full = np.flatnonzero(np.diff(at))
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([h[at[f]:at[f + 1]].tobytes() for f in full], pa.binary()),
         pa.array([key[at[f]:at[f + 1]].tobytes() for f in full], pa.binary())], names=["frag", "h", "key"])


def _cuts(share: float, fragments: int) -> np.ndarray:
    return np.array([min(int(share * i / fragments * 2**64), 2**64 - 1) for i in range(fragments + 1)], dtype=np.uint64)


def _partial_counts(rows: DataFrame, classes: int) -> DataFrame:
    """Rows (sa, alone) from fragment rows: in each fragment the n-grams that only one class has are counted per class, and
    these partial counts travel as blobs, a row for each fragment and bucket of classes, to be summed per bucket."""
    buckets = np.uint64(1 + classes // BUCKET)

    def count(keys, tab):
        import pyarrow as pa

        h = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in tab.column("h")])
        key = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tab.column("key")])
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, key = h[new], key[new]
        edge = np.ones(len(h) + 1, bool)
        edge[1:-1] = h[1:] != h[:-1]
        own, n = np.unique(key[edge[1:] & edge[:-1]], return_counts=True)
        bucket = (mix64(own.view(np.uint64)) % buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, n, at = own[order], n[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(int(buckets) + 1))
        full = np.flatnonzero(np.diff(at))
        return pa.table({"bucket": full.astype(np.int32), "own": [own[at[f]:at[f + 1]].tobytes() for f in full],
                         "n": [n[at[f]:at[f + 1]].tobytes() for f in full]},
                        schema=pa.schema([("bucket", pa.int32()), ("own", pa.binary()), ("n", pa.binary())]))

    def total(keys, tab):
        import pyarrow as pa

        own = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tab.column("own")])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in tab.column("n")])
        sa, at = np.unique(own, return_inverse=True)
        return pa.table({"sa": sa, "alone": np.bincount(at, n, len(sa)).astype(np.int64)})

    parts = rows.groupBy("frag").applyInArrow(count, "bucket int, own binary, n binary")
    return parts.groupBy("bucket").applyInArrow(total, "sa long, alone long")


def _alone_in_texts(df: DataFrame, text: str, k: int, share: float, fragments: int, classes: int) -> DataFrame:
    """Rows (sa, alone): how many n-grams of the first ``share`` of the order only this class has."""
    cuts = _cuts(share, fragments)

    def emit(batches):
        held, size = [], 0
        for _, win, row, counts, sa, _ in _batches(batches, text, k):
            first = np.zeros(len(counts), bool)  # one row of each class and block is enough
            first[np.unique(sa, return_index=True)[1]] = True
            keep = first[row] & (win < cuts[-1])
            held.append((win[keep], sa[row[keep]]))
            size += int(keep.sum())
            if size > HELD:
                yield _cut(*map(np.concatenate, zip(*held, strict=True)), cuts)
                held, size = [], 0
        if held:
            yield _cut(*map(np.concatenate, zip(*held, strict=True)), cuts)

    return _partial_counts(df.select(text).mapInArrow(emit, "frag int, h binary, key binary"), classes)


def _alone_in_sets(frags: DataFrame, fragments: int, classes: int) -> DataFrame:
    """The same over the whole order, from the sets that are left."""
    cuts = _cuts(1.0, fragments)

    def emit(batches):
        for b in batches:
            sizes = b.column("part").value_lengths().to_numpy()
            win = b.column("part").flatten().to_numpy().view(np.uint64)
            key = np.repeat(b.column("sa").to_numpy(), sizes)
            for a in range(0, len(win), HELD):
                yield _cut(win[a:a + HELD], key[a:a + HELD], cuts)

    return _partial_counts(frags.select("sa", "part").mapInArrow(emit, "frag int, h binary, key binary"), classes)


def _fragments(df: DataFrame, reps: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """Rows (id, sa, frag, part): the sets of the classes, each cut into PARTS fragments of the order (empty ones left out)."""
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.int64())
        for b, win, row, counts, sa, _ in _batches(batches, "text", k):
            ok = b.column("sa").to_numpy() == sa
            cell = row * PARTS + (win >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
            at = np.searchsorted(cell, np.arange(len(counts) * PARTS + 1))
            full = np.flatnonzero(np.diff(at))
            full = full[ok[full // PARTS]]
            if not len(full):
                continue
            values = np.concatenate([win[at[c]:at[c + 1]] for c in full]).view(np.int64)
            sizes = np.concatenate([[0], np.cumsum(at[full + 1] - at[full])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(full // PARTS)), pa.array(sa[full // PARTS]), pa.array((full % PARTS).astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(sizes), pa.array(values)).cast(kind)], names=["id", "sa", "frag", "part"])

    kind = df.schema[id_col].dataType.simpleString()
    docs = in_buckets(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), reps, "id")
    docs = docs.join(reps.select("id", "sa"), "id").dropDuplicates(["id"])  # repeated rows
    return docs.mapInArrow(run, f"id {kind}, sa long, frag int, part array<long>")


def _verify(pairs: DataFrame, frags: DataFrame, num: int, den: int) -> DataFrame:
    """The partial overlaps of the pairs (a, na, b, nb), summed: rows (a, b, d, link) with the distance 1 - |a & b| / |a | b|."""
    a = frags.select(F.col("id").alias("a"), "frag", F.col("part").alias("pa"))
    b = frags.select(F.col("id").alias("b"), "frag", F.col("part").alias("pb"))
    partial = pairs.join(a, "a").join(b, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    both = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    union = F.col("na") + F.col("nb") - F.col("o")
    return both.select("a", "b", (1 - F.col("o") / union).alias("d"), (F.col("o") * den >= union * num).alias("link"))


def class_links(df: DataFrame, feats: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes (sa, sb, n, id, copies) with the smallest id of each, and links (a, b) between ids of classes
    that span the components of all links."""
    classes = materialize(feats.where("n > 0 AND id IS NOT NULL").groupBy("sa", "sb", "n").agg(
        F.min("id").alias("id"), F.count("*").alias("copies")), "jac-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    kind = classes.schema["id"].dataType.simpleString()
    none = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    if not total:
        return classes, none
    spare = F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}")  # n-grams a class may have alone
    share = min(1.0, 2.5 * (den - num) / den)
    n = classes.count()
    alone = _alone_in_texts(df, text, k, share, 1 + int(total * share / FRAGMENT), n)
    few = lambda left: left.where(F.coalesce("alone", F.lit(0)) <= spare).select("id", "sa", "n")
    alive = materialize(few(classes.join(alone, "sa", "left")), "jac-alive")
    frags = materialize(_fragments(df, alive, id_col, text, k), "jac-fragments")
    rest = alive.agg(F.sum("n"), F.count("*")).first()
    alive = materialize(few(alive.join(_alone_in_sets(frags, 1 + (rest[0] or 0) // FRAGMENT, rest[1]), "sa", "left")), "jac-alive")
    frags = materialize(in_buckets(frags, alive, "id").join(alive.select("id"), "id", "left_semi").select("id", "frag", "part"), "jac-fragments")
    grams = frags.select("id", F.explode("part").alias("h"))
    common = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(common, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("r"))
    keyed = ranked.join(alive.select("id", "n"), "id").withColumn("s", F.size("r").cast("long"))
    keep = F.greatest(F.lit(0), spare + 1 - (F.col("n") - F.col("s"))).cast("int")
    # at: place of the key in the class's order, lone n-grams first
    index = keyed.select("id", "n", "s", F.posexplode(F.slice("r", F.lit(1), keep)).alias("p", "g")).select(
        "id", "n", "s", F.col("g.h").alias("h"), (F.col("n") - F.col("s") + F.col("p")).alias("at"), F.lit(None).cast("double").alias("d"))
    index = materialize(index, "jac-index")
    links, seen, comp = none, None, None
    # members against pivots: the one that shares most, a hashed choice, the longest; then members of different components
    of = lambda *order: F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), "id", "n", "s", "at", "comp", "d")
    central = of(F.col("s") - F.col("n"), F.col("n"), F.xxhash64("id"))
    hashed = of(F.xxhash64("id"))
    longest = of(F.col("s"), F.col("n"), F.xxhash64("id"))
    far = 1 - num / den + 1e-9
    for step, pivot in enumerate([central, hashed, longest, None]):
        here = index.withColumn("comp", F.col("id")) if comp is None else index.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        mixed = here.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
        here = here.join(mixed, "h")
        if pivot is not None:
            side = here.groupBy("h").agg(F.max(pivot).alias("p")).select(
                "h", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat"), F.col("p.comp").alias("pc"), F.col("p.d").alias("pd"))
        else:  # all but the largest component of each key against every member
            sizes = here.groupBy("h", "comp").agg(F.count("*").alias("c"))
            main = sizes.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m")).select("h", F.col("m.comp").alias("main"))
            side = here.join(main, "h").where("comp <> main").select("h", F.col("id").alias("pid"), F.col("n").alias("pn"),
                                                                    F.col("at").alias("pat"), F.col("comp").alias("pc"), F.col("d").alias("pd"))
        least = F.expr(f"({num} * (n + pn) + {num + den - 1}) div {num + den}")
        met = here.join(side, "h").where("comp <> pc").where(
            (F.least("n", "pn") * den >= F.greatest("n", "pn") * num) & (F.col("at") <= F.col("n") - least) & (F.col("pat") <= F.col("pn") - least)
            & F.coalesce(F.abs(F.col("d") - F.col("pd")) <= far, F.lit(True)))
        first = F.col("id") < F.col("pid")
        met = met.select("h", "id", "pid", F.when(first, F.col("id")).otherwise(F.col("pid")).alias("a"), F.when(first, F.col("n")).otherwise(F.col("pn")).alias("na"),
                         F.when(first, F.col("pid")).otherwise(F.col("id")).alias("b"), F.when(first, F.col("pn")).otherwise(F.col("n")).alias("nb"))
        met = materialize(met, f"jac-met{step}") if step == 0 else met
        cand = met.select("a", "na", "b", "nb").distinct()
        if seen is not None:
            cand = cand.join(seen, ["a", "b"], "left_anti")
        cand = materialize(cand, f"jac-pairs{step}")
        if cand.isEmpty():
            continue
        seen = cand.select("a", "b") if seen is None else seen.unionByName(cand.select("a", "b"))
        verified = materialize(_verify(cand, frags, num, den), f"jac-verified{step}")
        links = links.unionByName(verified.where("link").select("a", "b"))
        if step < 3:
            comp = components(links)
        if step == 0:  # distances to the key's pivot: two members whose distances differ by more than a link's are no link
            dist = met.join(verified.select("a", "b", "d"), ["a", "b"]).select("h", "id", "d", "pid")
            known = dist.select("h", "id", "d").unionByName(dist.select("h", F.col("pid").alias("id"), F.lit(0.0).alias("d")).distinct())
            index = materialize(index.drop("d").join(known, ["h", "id"], "left"), "jac-index")
    return classes, links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (id, n_shingles, component_id) for each row: the size of its set, and the smallest id reachable by links, where two
    texts link if ``den * |intersection| >= num * |union|``.

    NULL, empty and wordless texts have no shingles and are components of their own. Repeated rows and equal sets are linked.
    NULL ids are never the smallest. ``ValueError`` if one id has texts with different sets. An empty table has no rows. Other columns of ``df`` are not read."""
    feats = materialize(features(df, id_col, text, k), "jac-features")
    whole = F.xxhash64("sa", "sb", "n")
    twice = feats.where("id IS NOT NULL").groupBy("id").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo <> hi").first()
    if twice is not None:
        raise ValueError(f"{id_col} {twice['id']} has two different texts")
    classes, links = class_links(df, feats, id_col, text, k, num, den)
    comp = components(links)
    named = classes.join(comp, "id", "left").where("copies > 1 OR comp IS NOT NULL").select(
        "sa", "sb", "n", F.coalesce("comp", "id").alias("comp"))
    out = feats.join(named, ["sa", "sb", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90)


def oracle(k: int = 3, num: int = 90, den: int = 100) -> str:
    """DuckDB: shingles as text, overlaps of all pairs that share one, components by recursion."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + {k - 1}), ' ') AS s FROM w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS g(p)
      WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * o >= {num} * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) c ON c.x = d.doc_id
"""


OP6_SQL = oracle()
