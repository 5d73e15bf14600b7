"""Toxic passages as maximal-scoring segments of token log-odds, aggregated by extreme-value calibration.

Training counts the tokens of the labelled training rows, each once a row (partial sums, all rows), and takes the log-odds of
the two classes with an informative Dirichlet prior, the pooled counts scaled to a share of themselves. Tokens whose log-odds are
significantly positive form the lexicon (with stems of tokens, which stand for forms not seen); every other token scores a negative drift, solved so that the mean score of
clean text is negative. One linear scan finds all maximal-scoring segments. Under
clean text the best of n tokens scores above s with probability 1 - exp(-K n exp(-lambda s)); lambda solves
E[exp(lambda score)] = 1 on clean training text and K is fitted there. A document's evidence is the
surprise of its segments, and a monotone logistic curve fitted on the training rows maps it to a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.common import table
from spindle.session import materialize

PRIOR = 0.1  # pseudo-counts of the prior in each class, as a share of all counts
LEAST_Z = 3.0  # significance of a lexicon token
TRAIN_ROWS = 200_000  # sample bound: labelled rows trained on, about (by a hash of the id where there are more)
LEXICON = 50_000  # model size bound: the most significant tokens
STEMS = (4, 6)  # letters of the stems that longer tokens are also counted under, so inflected forms share evidence
DRIFT = -0.15  # score of a token outside the lexicon, at most
LEAST_MEAN = -0.02  # mean score of clean text, at most
MOST = 6.0  # largest score of a token
PREDICT = 0.7  # fixed value: score from which a text is predicted toxic

_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}']+")
TOKEN_JAVA = r"[\p{L}\p{M}\p{N}']+"


@dataclass(frozen=True)
class Segment:
    start: int  # first token
    end: int  # behind the last
    score: float


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[Segment]:
    """All maximal-scoring segments (linear time): tokens ``at`` have positive scores, all others ``drift``.

    Each segment is kept with the cumulative score before it and behind it; a new one is merged with the nearest
    earlier one that begins lower, if it also ends lower."""
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, left sum, right sum, nearest with a lower left sum
    total, last = 0.0, -1
    for p, s in zip(at, score, strict=True):
        total += drift * (p - last - 1)
        left, right, start = total, total + s, p
        total, last = right, p
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, p + 1, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [Segment(a, b, r - le) for a, b, le, r, _ in stack]


class Values(dict):
    """Scores of tokens met before (None: outside the lexicon); emptied when full."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> float | None:
        get = self.lexicon.get
        found = [v for k in (0, *STEMS) if (k == 0 or len(token) > k) and (v := get(token[:k] + "-" if k else token)) is not None]
        if len(self) >= self.most:
            self.clear()
        value = self[token] = max(found, default=None)
        return value


@dataclass
class Model:
    lexicon: dict[str, float]
    drift: float
    lam: float
    k: float
    slope: float
    middle: float

    def segments(self, text: str | None) -> tuple[int, list[Segment]]:
        tokens = _TOKEN.findall((text or "").lower())
        if not hasattr(self, "values"):
            self.values = Values(self.lexicon)
        hits = [(i, v) for i, v in enumerate(map(self.values.__getitem__, tokens)) if v is not None]
        return len(tokens), maximal_segments([i for i, _ in hits], [v for _, v in hits], self.drift)

    def evidence(self, n: int, segments: list[Segment]) -> float:
        """Surprise (nats) of the segments together: the least chance, over r, that the r best segments of clean text of n
        tokens sum to as much. With x = lambda s - ln(K n) and t the sum of the r largest x, that chance is
        exp(-t) t^(r-1) / (r! (r-1)!); choosing r costs a factor 2^r."""
        if not segments:
            return 0.0
        norm = math.log(self.k * max(n, 1))
        best = t = 0.0
        for r, x in enumerate(sorted((self.lam * s.score - norm for s in segments), reverse=True), 1):
            t += x
            if t <= 0 or x < -norm:
                break
            if r == 1:
                chance = -math.log(max(-math.expm1(-math.exp(-t)), 1e-300))
            else:
                chance = t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, chance - r * math.log(2))
        return best

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * (evidence - self.middle)))))


def _longer(k: int):
    return lambda t: F.length(t) > k


def _stem(k: int):
    return lambda t: F.concat(F.substring(t, 1, k), F.lit("-"))


def token_counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """Rows (token, toxic, clean): numbers of labelled rows with the token, over all of them."""
    words = rows.where(F.col(label).isin(0, 1)).select(
        F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_JAVA), F.lit(0))).alias("w"), label)
    stems = (F.array_distinct(F.transform(F.filter("w", _longer(k)), _stem(k)))
             for k in STEMS)
    tokens = words.select(F.explode(F.concat("w", *stems)).alias("token"), label)
    return tokens.groupBy("token").agg(F.sum(F.col(label).cast("long")).alias("toxic"),
                                       F.sum((1 - F.col(label)).cast("long")).alias("clean"))


def solved_drift(positive: float, other: float) -> float:
    """The score of a token outside the lexicon: DRIFT, or what makes the mean score of clean text ``LEAST_MEAN`` where the lexicon's tokens are so
    common in it (mean ``positive`` over all its tokens, a share ``other`` outside the lexicon) that DRIFT would not."""
    return min(DRIFT, (LEAST_MEAN - positive) / max(other, 1e-6))


def fit_lexicon(counts: DataFrame) -> tuple[dict[str, float], dict[float, float], float]:
    """Log-odds with the Dirichlet prior of the tokens that are significantly toxic, at most LEXICON of them, how often each
    score occurs in the clean rows (share by score), and the drift."""
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = float(total[0] or 0), float(total[1] or 0)
    if not toxic or not clean:
        return {}, {}, DRIFT
    prior = (F.col("toxic") + F.col("clean")) * PRIOR
    weight = (toxic + clean) * PRIOR
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (toxic + weight - a)) - F.log(b / (clean + weight - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    # equal significance is cut off by the token itself
    top = counts.select("token", "clean", odds.alias("odds"), z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(
        F.desc("z"), "token").limit(LEXICON)
    lexicon, rates, other = {}, {}, 1.0
    for r in top.collect():
        value = lexicon[r.token] = min(MOST, r.odds)
        rates[value] = rates.get(value, 0.0) + r.clean / clean
        other -= r.clean / clean
    drift = solved_drift(sum(v * p for v, p in rates.items()), other)
    return lexicon, {**rates, drift: other}, drift


def _calibrate(rates: dict[float, float]) -> float:
    """Root lambda > 0 of sum p(s) exp(lambda s) = 1 over the scores of clean text."""
    def f(x: float) -> float:
        return sum(p * math.exp(x * s) for s, p in rates.items()) - 1.0

    hi = 0.01
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(lo, 1e-6)


def fit(rows: DataFrame, text: str = "text", label: str = "toxic") -> Model:
    """Model of the labelled rows (label 0 or 1; other labels and NULL are ignored).

    Without both classes the model knows no toxic token and scores every text the same, below 0.5. The driver gets the
    lexicon (LEXICON tokens at most) and histograms of bounded size; all labelled rows are counted."""
    counts = materialize(token_counts(rows, text, label), "tox-counts")
    lexicon, rates, drift = fit_lexicon(counts)
    if not lexicon:
        return Model({}, DRIFT, 1.0, 1.0, 1.0, 1.0)
    lam = _calibrate(rates)
    raw = Model(lexicon, drift, lam, 1.0, 1.0, 0.0)

    def tops(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t, y in zip(b.column(text).to_pylist(), b.column(label).to_pylist(), strict=True):
                m, segs = raw.segments(t)
                best = max((s.score for s in segs), default=0.0)
                out.append((y, m * math.exp(-min(lam * best, 700.0)) if best > 0 else None))
            yield pa.RecordBatch.from_pydict({"y": [x[0] for x in out], "e": [x[1] for x in out]},
                                             schema=pa.schema([("y", pa.int32()), ("e", pa.float64())]))

    labelled = rows.where(F.col(label).isin(0, 1)).select(text, F.col(label).cast("int").alias(label))
    # K from the clean rows: -log of the share of rows without a segment of that chance, at the median of their best
    e = labelled.where(F.col(label) == 0).mapInArrow(tops, "y int, e double").agg(
        F.percentile_approx(F.when(F.col("e").isNotNull(), F.col("e")), 0.5, 1000), F.count("e"), F.count("*")).first()
    k = min(1.0, max(1e-4, -math.log(max(1e-9, 1 - 0.5 * (e[1] / e[2]))) / e[0])) if e[2] and e[1] and e[0] else 1.0
    known = Model(lexicon, drift, lam, k, 1.0, 0.0)

    def evidences(batches):
        import pyarrow as pa

        for b in batches:
            ev = [round(min(known.evidence(*known.segments(t)), 200.0) * 4) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column(label), "e": pa.array(ev, pa.int32())})

    hist = labelled.mapInArrow(evidences, "y int, e int").groupBy("e").agg(
        F.sum("y").alias("pos"), F.count("*").alias("n")).orderBy("e").collect()  # 801 rows at most
    x = np.array([r.e / 4 for r in hist])
    pos, cnt = np.array([float(r.pos) for r in hist]), np.array([float(r.n) for r in hist])
    slope, middle = _logistic(x, pos, cnt)
    return Model(lexicon, drift, lam, k, slope, middle)


def _logistic(x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic curve by damped Newton steps, with a weak pull towards slope 0; slope is kept positive."""
    a, b = 0.1, -0.1 * float(np.average(x, weights=n))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([np.sum((pos - n * p) * x) - 0.01 * a, np.sum(pos - n * p) - 0.01 * b])
        h = np.array([[np.sum(w * x * x) + 0.01, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.01]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, float(np.abs(d).max())))
        a, b = a + d[0], b + d[1]
        if float(np.abs(d).max()) < 1e-7:
            break
    a = max(float(a), 1e-3)
    return a, float(-b / a)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The documents with their labels, about TRAIN_ROWS of them where there are more: so few that the labels are
    broadcast and no text is shuffled. ``labels`` has one row per id; NULL ids have no label."""
    known = labels.where(F.col(id_col).isNotNull())
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * TRAIN_ROWS / n))
    return docs.join(F.broadcast(known), id_col)


def score_rows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``df`` except ``text``, with ``score`` (0 to 1), ``predicted`` (score >= 0.7) and ``segments``
    (start token, end token, score of each significant passage).

    NULL and empty texts have no segments and the score of no evidence. Texts are scored row by row, whole."""
    if clash := {"score", "predicted", "segments"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shipped.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            scores, spans = [], []
            for t in b.column(text):
                n, segs = m.segments(t.as_py())
                scores.append(m.score(m.evidence(n, segs)))
                spans.append([{"start": s.start, "end": s.end, "score": s.score} for s in segs
                              if m.k * max(n, 1) * math.exp(-min(m.lam * s.score, 700.0)) < 0.5])
            rest = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT) for s in scores], pa.int32()),
                 pa.array(spans, kind)], names=[*rest.schema.names, "score", "predicted", "segments"])

    schema = df.drop(text).withColumns({
        "score": F.lit(0.0), "predicted": F.lit(0),
        "segments": F.array().cast("array<struct<start:int,end:int,score:double>>")}).schema
    return df.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = materialize(labelled_sample(docs.where("NOT held_out"), labels, "doc_id").select("text", "toxic"), "tox-train")
    out = score_rows(docs, fit(train))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"))
