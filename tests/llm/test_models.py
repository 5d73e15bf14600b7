"""Language identification, toxicity and quality: held-out accuracy, brute force on small inputs, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, empty, odd
from conftest import SMOKE

from spindle.llm import langid, quality, toxicity
from spindle.llm.common import blocks, string_buffers

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    got = langid.op5_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = odd(spark)
    dicts = langid.dictionaries(langid.sample(docs))
    assert set(dicts) == {"en", "es", "fr"}  # de has no letters
    rows = {r.doc_id: r for r in langid.identify(docs, dicts).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 and rows[i].rejected for i in (1, 2, 3, 9))
    assert rows[6].lang_pred == "es" and len(rows[6]) == 19
    assert langid.identify(empty(spark), dicts).count() == 0
    none = langid.dictionaries(langid.sample(empty(spark)))
    assert none == {} and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(docs.withColumnRenamed("n", "score"), dicts)


def test_language_sample_is_not_thinned_by_copies(spark):
    text = """CASE WHEN id < 400 THEN concat('distinct text number ', id) WHEN id < 8000 THEN 'one text copied many times'
              WHEN id < 8400 THEN concat('texto distinto ', id) WHEN id < 12000 THEN NULL ELSE concat('0 ', id) END"""
    docs = spark.range(16000).selectExpr(f"{text} AS text", "IF(id < 8000, 'en', 'es') AS lang")
    pieces = langid.sample(docs)
    assert len(set(pieces)) == len(pieces) == 2 * langid.DICT_PIECES
    assert all(sum(la == x for la, _ in pieces) == langid.DICT_PIECES for x in ("en", "es"))


def test_language_sample_widens_a_short_range(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("concat('text number ', id) AS text", "'en' AS lang")
    monkeypatch.setattr(langid.F, "approx_count_distinct", lambda c: langid.F.count(c) * 1000)
    assert len(langid.sample(docs)) == langid.DICT_PIECES


def brute_segments(s):
    """All maximal-scoring segments by their recursive definition."""
    best = max(((sum(s[i:j]), i - j, -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return brute_segments(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(s[j:])]


def test_maximal_segments_are_those_of_the_definition():
    r = random.Random(1)
    for _ in range(300):
        s = [r.choice([-1.0, -1.0, -1.0, 2.625, 1.25, 0.8125]) for _ in range(r.randint(0, 14))]
        at = [i for i, x in enumerate(s) if x > 0]
        got = toxicity.maximal_segments(at, [s[i] for i in at], -1.0)
        want = brute_segments(s)
        assert [round(sum(s[x.start:x.end]), 6) for x in got] == [round(sum(s[a:b]), 6) for a, b in want]
        assert all(abs(sum(s[x.start:x.end]) - x.score) < 1e-9 for x in got)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op7_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in pos) / len(pos) > 0.6 and sum(r.predicted for r in neg) / len(neg) < 0.03


def test_toxicity_odd_rows(spark):
    bad = [("calm words here and there " * 3, 0)] * 30 + [("vile slur vile you slur vile", 1)] * 20 + [(None, 1), ("", 0), ("x", None), ("y", 7)]
    model = toxicity.fit(spark.createDataFrame(bad, "text string, toxic int"))
    assert "vile" in model.lexicon and "calm" not in model.lexicon
    rows = [*ODD, (20, "well " * 300 + "vile slur vile slur vile " + "well " * 300, "en", "s")]
    got = {r.doc_id: r for r in toxicity.score_rows(odd(spark, rows), model).collect()}
    assert got[20].score > 0.7 > got[7].score and got[1].score == got[2].score < 0.7
    assert got[20].segments[0].start == 300 and got[20].segments[0].end == 305
    assert toxicity.score_rows(empty(spark), model).count() == 0
    none = toxicity.fit(spark.createDataFrame([("a", 0)], "text string, toxic int"))
    assert not none.lexicon and {r.predicted for r in toxicity.score_rows(odd(spark), none).collect()} == {0}


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c, covered = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force():
    r = random.Random(4)
    texts = [t for _, t, _, _ in ODD] + ["".join(r.choice(["a", "b ", "é", "\n", " ", "#", "\x0b", "a b a b "]) for _ in range(r.randint(0, 60))) for _ in range(600)]
    raw, off = string_buffers(pa.array(texts))
    for limit in (1, 500, 1 << 21):
        got = []
        for a, b in blocks(off, limit):
            m = quality.measure_rows(raw[off[a]:off[b]], off[a:b + 1] - off[a])
            got += list(zip(*(m[c].tolist() for c in quality.BASE), strict=True))
        assert got == [brute_measures(t or "") for t in texts]


def test_quality_odd_rows_and_merging(spark):
    got = quality.filter_quality(odd(spark)).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 4, 5, 9, 10))
    assert quality.filter_quality(empty(spark)).count() == 0
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of"], 40)) + (" #" * 30 if i % 50 == 0 else ""), "en", f"s{i % 2}") for i in range(300)]
    kept = {x.doc_id: x.kept for x in quality.filter_quality(odd(spark, rows)).collect()}
    base = quality.base_measures(odd(spark, rows)).withColumn("base_failed", quality.F.lit(False))
    assert not any(kept[i] for i in range(0, 300, 50)) and sum(kept.values()) > 200
    parts = quality.sketches(base, ["lang", "source"])
    key = lambda df: sorted(map(tuple, df.select("lang", "measure", "step", "n").collect()))
    assert key(quality.merge(parts, ["lang"])) == key(quality.sketches(base, ["lang"]))


def test_smoke_queries_return_every_document(spark):
    n = spark.read.parquet(f"{SMOKE}/documents.parquet").count()
    for q in (langid.op5_language_id, toxicity.op7_toxicity, quality.op4_quality):
        assert q(spark, SMOKE).count() == n


def test_long_words_are_judged_by_their_own_spread(spark):
    """Texts without spaces: mean word lengths from 125 to 1175 code points are their group's ordinary spread; one of 60,000 is not."""
    rows = [(i, " ".join(chr(0x4E00 + (i * 7 + k) % 500) * (125 + i * 1050 // 200) for k in range(12)), "zh", "web") for i in range(200)]
    rows += [(1000 + i, " ".join(chr(0x4E00 + k) * (55 + i) for k in range(12)), "zh", "web") for i in range(10)]
    rows.append((2000, " ".join("x" * 60_000 for _ in range(1)) + " a b c d e f g h i", "zh", "web"))
    rows.append((2001, " ".join(chr(0x5E00 + k) * 60_000 for k in range(12)), "zh", "web"))
    out = {r.doc_id: r for r in quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in out.values())
    assert all(out[i].kept for i in range(200)) and all(out[1000 + i].kept for i in range(10))
    assert not out[2001].kept


def test_sketch_cells_hold_eleven_bits(spark):
    from pyspark.sql import functions as F

    steps = [0, 1, 2047, 2048, 2049, 4095, 4099, 123_456_789, (1 << 62) + 12345]
    got = [r.c for r in spark.createDataFrame([(i, s) for i, s in enumerate(steps)], "i int, s long").orderBy("i").select(quality._cell(F.col("s")).alias("c")).collect()]
    assert got == [s >> max(s.bit_length() - 11, 0) << max(s.bit_length() - 11, 0) for s in steps]
    assert all(s - c <= s / 1024 for s, c in zip(steps, got))


def test_repeats_below_the_base_rule_can_be_rejected(spark):
    r = random.Random(3)
    text = lambda again: " ".join([*(f"w{r.randint(0, 10**9)}" for _ in range(200 - again)), *(["five words said once more"] * (again // 5))])
    rows = [(i, text(0), "en", "web") for i in range(100)] + [(1000, text(35), "en", "web")]
    out = {x.doc_id: x for x in quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not out[1000].base_failed and not out[1000].kept and all(out[i].kept for i in range(100))


def test_language_pieces_cover_the_whole_text(spark):
    late = "1234 5678 " * 400 + "der fluss ist lang und das haus ist alt " * 200 + "ende"
    rows = [(late, "de"), ("kurz und gut", "de"), ("+++ " * 1000, "xx")]
    got = langid.sample(spark.createDataFrame(rows, "text string, lang string"))
    assert [la for la, _ in got] == ["de", "de"]
    piece = max((p for _, p in got), key=len)
    assert 1400 <= len(piece) <= langid.PIECE + langid.WINDOWS and piece.startswith("der fluss") and piece.endswith("ende")
    assert "kurz und gut" in [p for _, p in got]


def test_drift_keeps_the_mean_of_clean_text_negative():
    assert toxicity.solved_drift(0.01, 0.99) == toxicity.DRIFT
    for positive, other in ((0.5, 0.8), (2.0, 0.3)):
        drift = toxicity.solved_drift(positive, other)
        assert drift < toxicity.DRIFT and positive + other * drift == pytest.approx(toxicity.LEAST_MEAN)
        rates = {positive / (1 - other): 1 - other, drift: other}
        lam = toxicity._calibrate(rates)
        assert sum(p * np.exp(lam * v) for v, p in rates.items()) == pytest.approx(1, abs=1e-3) and lam > 0
