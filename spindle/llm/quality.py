"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Base measures and a fixed base rule come first. Then each measure's ratio is counted in integer steps per
(language, source): a histogram sketch whose cells are exact below 2048 steps and then grow with the value (11 leading bits, so
an octave has 1024 cells, and quantiles are off by less than 0.1 percent), whose merge is the sum of the counts, so partial
sums do the work and a hot source is no single task. The sketches of a language's sources merge into that of
the language, and those into one for all, which stand in for groups of too few documents. Quartiles read off
the sketches give upper and lower fences, which are joined to the documents and decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import blocks, line_hashes, string_buffers, table, windows, word_hashes
from spindle.session import materialize

#: Ratio per measure: numerator, denominator, steps per unit, least distance of the fence from the median, in steps.
#: The fence itself follows each group's quartiles; the least distance only keeps groups without spread from losing rows.
MEASURES = {
    "word_length": ("word_chars", "n_words", 20, 50),
    "symbols": ("n_symbols", "n_words", 100, 20),
    "dup_lines": ("n_dup_lines", "n_lines", 100, 50),
    "repeats": ("n_repeat_words", "n_words", 100, 15),  # below the base rule's 20, so that a group's quartiles can decide
}
LOWER = {"word_length"}  # measures with a lower fence as well
SPREAD = 6  # quartile distances between quartile and fence
BITS = 11  # leading bits of a step that a sketch keeps
LEAST_DOCS = 50  # documents a group needs for fences of its own
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True  # fixed value: the symbols of the result contract
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_FIRST = (np.arange(256) & 0xC0) != 0x80


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _repeated(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries occur again in their row."""
    order = np.lexsort((h, row))
    a, r = h[order], row[order]
    same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def measure_rows(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    h, counts = word_hashes(raw, offsets, lower=False)
    lines, per_row = line_hashes(raw, offsets)
    line_row = np.repeat(np.arange(n), per_row)
    pairs = np.lexsort((lines, line_row))
    a, r = lines[pairs], line_row[pairs]
    dup = np.bincount(r[1:][(a[1:] == a[:-1]) & (r[1:] == r[:-1])], minlength=n) if len(a) else np.zeros(n, np.int64)
    win, row = windows(h, counts, WINDOW)
    again = _repeated(win, row)
    first = np.concatenate([[0], np.cumsum(counts)])
    per = np.maximum(counts - WINDOW + 1, 0)
    start = np.arange(len(win)) - np.repeat(np.cumsum(per) - per, per) + first[row] if len(win) else np.empty(0, np.int64)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, start[again], 1)
    np.add.at(step, start[again] + WINDOW, -1)
    return {"n_words": counts.astype(np.int64), "word_chars": _sums(_NOT_SPACE[raw] & _FIRST[raw], offsets),
            "n_symbols": _sums(_SYMBOL[raw], offsets), "n_lines": per_row.astype(np.int64),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": _sums(np.cumsum(step[:-1]) > 0, first)}


BASE = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``df`` except ``text``, with the base measures (long). NULL and empty texts measure 0."""
    if clash := set(BASE) & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw, off = string_buffers(b.column(text))
            rest = b.drop_columns([text])
            for lo, hi in blocks(off):
                m = measure_rows(raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[c], pa.int64()) for c in BASE)],
                                                 names=[*part.schema.names, *BASE])

    schema = df.drop(text).withColumns({c: F.lit(0).cast("long") for c in BASE}).schema
    return df.mapInArrow(run, schema)


def _step(name: str):
    """The ratio in whole steps, of any size: what is compared with the fences."""
    num, den, steps, _ = MEASURES[name]
    return F.expr(f"({steps} * {num}) div greatest({den}, 1)").cast("long")


def _cell(step):
    """The lower edge of a step's cell: its BITS leading bits."""
    cut = F.greatest(F.length(F.bin(step)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", step, cut), cut).cast("long")


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """Histogram sketches: rows (by, measure, step, n), one per cell that occurs."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _cell(_step(m)).alias("step")) for m in MEASURES)))
    return (measured.select(*by, cells.alias("c")).groupBy(*by, "c.measure", "c.step").agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "step").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, measure, total, low, high): quartiles (first step whose cumulative count reaches q of the total) and fences."""
    key = Window.partitionBy(*by, "measure")
    c = sketch.withColumns({"cum": F.sum("n").over(key.orderBy("step")), "total": F.sum("n").over(key)})
    q = lambda p, name: F.min(F.when(F.col("cum") * 4 >= F.col("total") * p, F.col("step"))).alias(name)
    least = F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v[3]))))[F.col("measure")]
    out = c.groupBy(*by, "measure", "total").agg(q(1, "q1"), q(2, "q2"), q(3, "q3"))
    iqr = F.col("q3") - F.col("q1")
    return out.select(*by, "measure", "total",
                      F.when(F.col("measure").isin(*LOWER), F.least(F.col("q1") - SPREAD * iqr, F.col("q2") - least)).alias("low"),
                      F.greatest(F.col("q3") + SPREAD * iqr, F.col("q2") + least).alias("high"))


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds ``base_failed`` and ``kept``. NULL languages and sources form groups of their own."""
    group = [lang, source]
    ok = measured.withColumn("base_failed", F.expr(
        "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    own = materialize(sketches(ok.where("NOT base_failed"), group), "quality-sketch")
    by_lang = merge(own, [lang])
    levels = [(fences(own, group), group, "s"), (fences(by_lang, [lang]), [lang], "l"), (fences(merge(by_lang, []), []), [], "a")]
    out = ok
    for f, by, tag in levels:  # one row per group with the fences of all measures
        wide = f.groupBy(*by).agg(F.max("total").alias(f"__total_{tag}"), *(
            F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"__{m}_{side}_{tag}") for m in MEASURES for side in ("low", "high")))
        if by:
            right = wide.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in wide.columns if c not in by))
            out = out.join(right, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left").drop(*(f"__{c}" for c in by))
        else:
            out = out.join(F.broadcast(wide.withColumn("__one", F.lit(1))), F.lit(1) == F.col("__one"), "left").drop("__one")
    fits = F.lit(True)
    for m in MEASURES:
        pick = lambda side: F.coalesce(*(F.when(F.col(f"__total_{t}") >= (LEAST_DOCS if t != "a" else 1), F.col(f"__{m}_{side}_{t}")) for t in "sla"))  # noqa: E731, B023
        fits = fits & F.coalesce(_step(m) <= pick("high"), F.lit(True))
        if m in LOWER:
            fits = fits & F.coalesce(_step(m) >= pick("low"), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & fits).select(*measured.columns, "base_failed", "kept")


def filter_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Measures, base rule and verdict of every row: the columns of ``df`` except ``text``, the base measures,
    ``base_failed`` and ``kept``. NULL and empty texts fail the base rule. Repeated rows are judged alike, and
    each counts in the sketches. An empty table stays empty. The measures are written once and read twice."""
    if clash := {"base_failed", "kept"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    return judge(materialize(base_measures(df, text), "quality"), lang, source)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = filter_quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same rows by DuckDB: measures over unnested words and lines, fences from order statistics of each group."""
    word = r"[^\x20\x09-\x0D]+"
    cells = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, ({steps} * {num}) // greatest({den}, 1) AS step FROM m"
        for m, (num, den, steps, _) in MEASURES.items())
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[3]}" for m, v in MEASURES.items()) + " END"
    low = "CASE WHEN measure IN (" + ", ".join(f"'{m}'" for m in sorted(LOWER)) + f") THEN least(q1 - {SPREAD} * (q3 - q1), q2 - {least}) END"

    cell = f"(step >> greatest(length(bin(step)) - {BITS}, 0)) << greatest(length(bin(step)) - {BITS}, 0)"

    def level(name: str, by: list[str]) -> str:
        key = ", ".join([*by, "measure"])
        return f"""{name} AS (SELECT {key}, total, {low} AS low, greatest(q3 + {SPREAD} * (q3 - q1), q2 + {least}) AS high FROM (
  SELECT {key}, total, min(step) FILTER (rn * 4 >= total) AS q1, min(step) FILTER (rn * 4 >= total * 2) AS q2, min(step) FILTER (rn * 4 >= total * 3) AS q3
  FROM (SELECT {key}, step, row_number() OVER (PARTITION BY {key} ORDER BY step) AS rn, count(*) OVER (PARTITION BY {key}) AS total
        FROM (SELECT * REPLACE ({cell} AS step) FROM c WHERE NOT base_failed)) GROUP BY {key}, total))"""

    pick = lambda x: f"coalesce(CASE WHEN s.total >= {LEAST_DOCS} THEN s.{x} END, CASE WHEN l.total >= {LEAST_DOCS} THEN l.{x} END, a.{x})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '{word}') AS w FROM d),
wc AS (SELECT doc_id, sum(length(x)) AS word_chars FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY doc_id),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ') AS s FROM w, unnest(range(1, len(w) - {WINDOW - 2})) AS g(p) WHERE len(w) >= {WINDOW}),
rep AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM rep, unnest(range({WINDOW})) AS g(k) GROUP BY doc_id),
m0 AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
c AS ({cells}),
{level("s", ["lang", "source"])},
{level("l", ["lang"])},
{level("a", [])},
v AS (SELECT c.doc_id, bool_and(coalesce(c.step <= {pick("high")}, true) AND coalesce(c.step >= {pick("low")}, true)) AS fits
      FROM c LEFT JOIN s ON s.lang IS NOT DISTINCT FROM c.lang AND s.source IS NOT DISTINCT FROM c.source AND s.measure = c.measure
      LEFT JOIN l ON l.lang IS NOT DISTINCT FROM c.lang AND l.measure = c.measure LEFT JOIN a ON a.measure = c.measure GROUP BY c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fits AS kept
FROM m JOIN v USING (doc_id)
"""


OP4_SQL = oracle()
