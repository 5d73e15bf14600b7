"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import pytest
from cases import ODD, empty, odd

from spindle.llm import collocations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, least, order=5):
    """{(lang, phrase): (k, cut, a, l, r, n, score)}"""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, order + 1):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    cand = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    out = {}
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        inside = any(q[0] == lang and len(q) > len(p) and c >= a and
                     any(q[1 + s:1 + s + len(w)] == w for s in range(len(q) - len(p) + 1)) for q, c in cand.items())
        if inside:
            continue
        score, cut, l, r = min(((1000 * a * n[lang]) // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])])
                               for k in range(1, len(w)))
        out[(lang, " ".join(w))] = (len(w), cut, a, l, r, n[lang], score)
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "phrase", "k", "cut", "a", "l", "r", "n", "score").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


def texts(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "city", "Ünï", "the", "of", "x" * 60, "a", "B", "日本語", " "] + [f"w{i}" for i in range(40)]
    gap = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ! ", "\x0b"]
    fixed = ["new york city hall of", "the same form letter again and again", "a a a a a a a a"]
    out = []
    for _ in range(n):
        s = "".join(r.choice(words) + r.choice(gap) for _ in range(r.randint(0, 40)))
        out.append((s + r.choice(fixed) * r.randint(0, 2), r.choice(["en", "de", None, ""])))
    return out


@pytest.mark.parametrize("least,size,order", [(3, 1 << 24, 5), (5, 300, 5), (2, 5000, 3), (4, 700, 2)])
def test_equals_brute_force(spark, least, size, order):
    docs = texts(250, least) + [("one form letter for all of you, my friends", "en")] * 30 + [(None, "en"), ("", None)]
    df = spark.createDataFrame(docs, "text string, lang string").repartition(4)
    assert got(collocations.collocations(df, least=least, size=size, order=order)) == brute(docs, least, order)


def test_odd_rows(spark):
    rows = [*ODD, *((90 + i, "a b c d e f g", "en", "s") for i in range(3))]
    found = got(collocations.collocations(odd(spark, rows), least=3))
    assert found == brute([(r[1], r[2]) for r in rows], 3)
    assert ("en", "a b c d e") in found
    assert got(collocations.collocations(empty(spark), least=1)) == {}


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", big), ("en", 2, "a b", big - 1)]
    counts = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    (r,) = collocations.scored(counts).collect()
    assert (r.a, r.l, r.r, r.n) == (big - 1, 2 * big, big, 10 * big)
    assert r.score == 1000 * (big - 1) * 10 * big // (2 * big * big)


def test_windows_are_cut_without_losing_a_count(spark):
    docs = texts(120, 9)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    all_counts = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(df, least=1).collect()}
    for least in (2, 7):
        some = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(df, least=least, size=500).collect()}
        assert some == {p: f for p, f in all_counts.items() if f >= least or p[1] == ""}


@pytest.mark.parametrize("hot,block", [(1, 1), (12, 50), (10**6, 7)])
def test_parts_of_phrases_of_common_words_are_summed(spark, monkeypatch, hot, block):
    docs = texts(120, 4)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "BLOCK", block)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert got(collocations.collocations(df, least=9, size=2000)) == brute(docs, 9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_rows_between_the_stages_grow_with_the_text(spark, monkeypatch):
    made, windows, materialize = Counter(), collocations._windows, collocations.materialize

    def counted(*args):
        out = windows(*args)
        made["windows"] += out.count()
        return out

    def written(df, name):
        out = materialize(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(collocations, "_windows", counted)
    monkeypatch.setattr(collocations, "materialize", written)
    r, sizes = random.Random(5), []
    for n in (40, 200):  # every word is frequent in both, every pair in the larger one only
        made.clear()
        docs = [(" ".join(r.choices("abcdefghijkl", k=40)), "en") for _ in range(n)]
        df = spark.createDataFrame(docs, "text string, lang string").repartition(2)
        counts = {(x.lang, x.phrase): x.f for x in collocations.phrase_counts(df, least=30, size=800).collect()}
        assert (len(counts) > 100) == (n == 200)
        sizes.append(dict(made))
    assert sizes[0]["windows"] > 500
    assert all(v < 1000 or v <= 7 * sizes[0].get(name, 0) for name, v in sizes[1].items()), sizes
