"""N-gram join, substring removal, licences, decontamination and the pipeline against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from cases import ODD, empty, odd
from conftest import SMOKE
from tokenizers import Tokenizer

import corpus_pipeline
from spindle.llm import bpe, decontaminate, graph, jaccard, langid, licenses, substring_dedup
from spindle.llm.suffix_array import permuted_common_prefixes, suffix_array


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, num, den=100):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and den * len(s & t) >= num * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=12):
    """Groups around a base: copies with few and many edits, chains of edits, exact copies, and unrelated texts."""
    r, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 140))]
        text = base
        for _ in range(r.randint(1, 40)):
            text = list(base if r.random() < 0.6 else text)
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text) if r.random() < 0.9 else " ".join(text).upper())
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, k, num, monkeypatch):
    monkeypatch.setattr(jaccard, "FRAGMENT", 2000)
    rows = near_copies(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k=k, num=num).collect()}
    assert got == brute_components(rows, k, num)


def test_component_odd_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd(spark), k=3, num=90).collect()]
    want = brute_components([(i, t) for i, t, _, _ in ODD], 3, 90)
    assert len(got) == len(ODD) and all(want[i] == (n, c) for i, n, c in got if i is not None)
    assert [c for i, n, c in got if i is None] == [None] and want[8][1] == 7
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (95, 100), (200, 200)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 90: 90, 95: 90, 100: 90}


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    for _ in range(400):
        t = [r.randint(1, r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 60))] + [0]
        assert suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(400)), np.uint8)
    at = np.array(sorted(range(300), key=lambda i: bytes(data[i:i + 100])))
    lcp = permuted_common_prefixes(data, at, 100)
    for k in range(1, 300):
        a, b = bytes(data[at[k]:at[k] + 100]), bytes(data[at[k - 1]:at[k - 1] + 100])
        assert lcp[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def repeats(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdeé ") for _ in range(r.randint(90, 260))) for _ in range(6)]
    rows = []
    for _ in range(60):
        rows.append("".join(r.choice(passages) if r.random() < 0.4 else "".join(r.choice("xyzw ") for _ in range(r.randint(0, 200)))
                            for _ in range(r.randint(0, 5))))
    rows += ["q" * 400, "ab" * 300, "ab" * 120, rows[3], rows[3], "q" * 99, "q" * 100, ""]
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [4000, 1])
def test_removed_bytes_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "PIECE", 300)
    rows = repeats(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substring_dedup.remove_repeats(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == substring_dedup.brute_force(rows)


def test_substring_odd_rows(spark):
    one_id = [r for r in ODD if r[0] is not None]
    got = substring_dedup.remove_repeats(odd(spark, ODD).drop("start", "n")).collect()
    assert len(got) == len(ODD)
    want = substring_dedup.brute_force(list(dict.fromkeys((r[0], r[1]) for r in one_id)))
    assert all(want[r.doc_id][:3] == (r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id is not None)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"))
    text = "".join(chr(0x100 + i) for i in range(60)) + "a"
    cut = substring_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, "x" + text), (3, chr(0x141) + text[2:])], "doc_id long, text string"), whole_characters=True)
    rows = {r.doc_id: bytes(r.kept).decode() for r in cut.collect()}
    assert rows[1] == text and rows[2] == "x" and rows[3] in ("", chr(0x141))  # U+0141 and U+0101 share their last byte


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
       " * documentation files (the \"Software\"), to deal in the Software without restriction, including without\n"
       " * limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of\n"
       " * the Software, and to permit persons to whom the Software is furnished to do so, subject to the following\n"
       " * conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or\n"
       "substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n"
       "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE\nAND NONINFRINGEMENT.")


def test_licences(spark):
    rows = [(1, MIT), (2, "text\nReleased under the MIT License.\nmore"), (3, "# LICENSED under CC by-nc 4.0."), (4, "Licensed under the Weird License."),
            (5, "MIT License\nAll rights reserved."), (6, "Licensed under CC BY 4.0. Released under the MIT License. Released under the MIT License."),
            (7, None), (8, ""), (9, LONG := "words and words. " * 60_000 + "MIT License")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [["MIT"], ["MIT"], ["CC-BY-NC-4.0"], [], ["MIT"], ["MIT", "CC-BY-4.0"], [], [], ["MIT"]]
    assert got[1].sentence_ids == ["mit_grant", "mit_notice", "mit_asis"] and got[5].unmatched == ["reserved"]
    assert got[4].n_unknown_mentions == 1 and got[9].n_sentences == 60_001 and len(LONG) > 10**6
    assert licenses.scan(odd(spark)).count() == len(ODD) and licenses.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd(spark).withColumnRenamed("n", "n_known"))


def test_licences_wrapped_among_other_lines(spark):
    def header(mark):
        body = [x.removeprefix(" * ").strip() for x in MIT.split("\n")]
        return "\n".join(f"{mark} {x}".rstrip() for x in ["Copyright (c) 2020 X", "", *body])

    gpl = ("This program is free software{} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published"
           " by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\nThis program is")
    rows = [(i, header(m)) for i, m in enumerate((" *", "#", "//"))]
    rows += [(3, "Copyright (C) 2020 X\n" + gpl.format(":", ",", 3)), (4, "prog.c - a thing\nCopyright (C) 2020 X\n" + gpl.format(";", ";", 2)),
             (5, "Copyright X\nMIT License\nmore words\nfollow"), (6, "words before permission is hereby granted,\n" + MIT[35:])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].sentence_ids == ["mit_grant", "mit_notice", "mit_asis"] and got[i].licences == ["MIT"] for i in range(3))
    assert all(got[i].n_sentences == 4 for i in range(3))
    assert [got[i].licences for i in (3, 4, 5)] == [["GPL-3.0-or-later"], ["GPL-2.0-or-later"], ["MIT"]]
    assert got[5].n_sentences == 4 and "mit_grant" not in got[6].sentence_ids


def test_decontamination(spark, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([13, 20, 40, 15, 12, 0])] + [(None, None), (9, "same " * 30)]
    filler = lambda n: " ".join(word() for _ in range(n))
    sub = items[2][1].split()
    sub[7], sub[21] = "changed", "changed"
    docs = [(1, f"{filler(30)} {items[1][1]} {filler(9)}"), (2, filler(300)), (3, items[0][1].upper().replace(" ", ", ")), (4, " ".join(sub)),
            (5, f"{filler(3)} {' '.join(items[2][1].split()[:14])} {filler(3)}"), (6, f"{filler(3)} {' '.join(items[2][1].split()[:9])} {filler(3)}"),
            (7, items[4][1]), (8, None), (9, ""), (10, f"{items[3][1]} {items[3][1]}"), (1, filler(20)), (11, "same " * 50), (None, items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda: sorted((x.doc_id or 0, x.item_id, x.n_matched) for x in decontaminate.overlaps(d, b).collect())
    got = pairs()
    assert got == [(0, 1, 20), (1, 1, 20), (3, 0, 13), (4, 2, 38), (5, 2, 14), (10, 3, 15), (11, 9, 30)]
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 20)
    assert pairs() == got
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(d, none).count() == 0 and decontaminate.overlaps(odd(spark), b).count() == 0
    assert decontaminate.overlaps(empty(spark), b).count() == 0


def test_decontamination_of_short_items(spark, monkeypatch):
    cjk, thai = "中国的首都是哪里？请回答。", "ประเทศไทยมีกี่จังหวัด"
    items = [(0, "What is the capital of France?"), (1, "Why?"), (2, cjk), (3, " ".join(f"w{i}" for i in range(12))), (4, "..."), (5, None), (6, thai)]
    docs = [(1, "quiz: what IS the capital, of france and more"), (2, "what is the capital of spain"), (3, f"以下问题{cjk}谢谢"), (4, "because; why not"),
            (5, " ".join(f"w{i}" for i in range(12))), (6, "中国的首都是北京。"), (7, None), (8, f"x{thai}y"), (9, " ".join(f"w{i}" for i in range(11)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lambda: sorted((r.doc_id, r.item_id, r.doc_start) for r in decontaminate.overlaps(d, b, short=True).collect())
    want = got()
    assert want == [(1, 0, 1), (3, 2, 4), (4, 1, 1), (5, 3, 0), (8, 6, 1)]
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 10)
    assert got() == want


def test_decontamination_tolerates_changes_in_items_of_13_to_15_words(spark):
    items = {n: [f"a{n}x{i}" for i in range(n)] for n in (13, 14, 15)}
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    docs, want = [], set()
    for n, w in items.items():
        for i in range(n):
            for j in range(i, n):
                same = [0 if k in (i, j) else 1 for k in range(n)]
                best = max(sum(1 if x else -2 for x in same[s:e]) for s in range(n) for e in range(s + 1, n + 1))
                docs.append((len(docs), "f1 f2 " + " ".join(x if ok else "changed" for x, ok in zip(w, same, strict=True)) + " f3"))
                if best >= decontaminate.LEAST:
                    want.add((docs[-1][0], n, best))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.overlaps(d, b).collect()} == want


def joined_with_items(df):
    """(rows, columns) of the joins that lay items on documents, after df.collect()."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        columns = {node.output().apply(i).name() for i in range(node.output().size())}
        if kind == "BroadcastHashJoinExec" and "__ih" in columns:
            out.append((node.metrics().apply("numOutputRows").value(), columns))
    return out


def test_decontamination_lays_an_item_once_on_a_run_of_hits(spark):
    """600 equal words meet the item at every place by every mask: far more hits than words, and each held the whole text."""
    d = spark.createDataFrame([(1, "same " * 600), (2, "same " * 29)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "same " * 30), (8, "same " * 14)], "item_id long, text string")
    df = decontaminate.overlaps(d, b)
    rows = [n for n, _ in joined_with_items(df)]
    assert rows and sum(rows) <= 4 * 629
    assert sorted(tuple(r) for r in df.collect()) == [(1, 7, 30, 30, 30, 0), (1, 8, 14, 14, 14, 0), (2, 7, 29, 29, 29, 0), (2, 8, 14, 14, 14, 0)]


def test_decontamination_in_blocks_equals_whole_texts(spark, monkeypatch):
    """Items whole and in part, as long as a block and shorter, across its borders; words that repeat; short items; ids that repeat."""
    r = random.Random(11)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 6)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([16, 20, 33, 61, 17, 40])] + [(6, "oh no " * 12), (6, "oh no " * 9)]
    docs = []
    for i in range(40):
        parts = [[word() for _ in range(r.randint(0, 70))]]
        for _ in range(3):
            w = r.choice(items)[1].split()
            cut = w[r.randint(0, 4):len(w) - r.randint(0, 4)]
            parts += [[word() if r.random() < 0.05 else x for x in cut], [word() for _ in range(r.randint(0, 30))]]
        docs.append((i, " ".join(x for p in parts for x in p)))
    docs += [(40, None), (41, ""), (42, "oh no " * 50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:-1], "item_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE b (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", docs)
    con.executemany("INSERT INTO b VALUES (?, ?)", items[:-1])
    want = sorted(con.execute(decontaminate.oracle("d", "b")).fetchall())
    more = spark.createDataFrame([*items, (20, "oh"), (21, "no oh no"), (22, "aa b")], "item_id long, text string")
    get = lambda x, short=False: sorted(tuple(r) for r in decontaminate.overlaps(d, x, short=short).collect())
    whole = get(more, True)
    assert len(want) > 60 and get(b) == want and len(whole) > len(want)
    for block in (1, 64):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert get(b) == want and get(more, True) == whole


def test_pipeline_equals_brute_force(spark):
    """Each stage again in plain Python (decontamination in DuckDB), on the smallest tables."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.Classifier(langid.dictionaries(langid.sample(docs)))
    left = {}
    for i, r in rows.items():
        pred, margin, _ = model.predict(r.text)
        if pred != langid.UNKNOWN and margin >= langid.MARGIN:
            left[i] = r.text
    comp = brute_components(sorted(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if comp[i][1] == i}
    seen, cut = set(), {}
    for i, t in sorted(left.items()):
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\x01" * 100
            seen.add(w)
        chars, p = [], 0
        for ch in t:
            n = len(ch.encode())
            if not any(gone[p:p + n]):
                chars.append(ch)
            p += n
        if not any(gone) or re.search(r"[^\x20\x09-\x0D]", "".join(chars)):
            cut[i] = "".join(chars)
    import pandas as pd

    con = duckdb.connect()
    con.register("d", pd.DataFrame({"doc_id": list(cut), "text": list(cut.values())}))
    con.execute(f"CREATE VIEW b AS SELECT * FROM read_parquet('{SMOKE}/benchmark.parquet')")
    leaks = {x[0] for x in con.execute(decontaminate.oracle("d", "b")).fetchall()}
    library = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t in cut.items():
        if i not in leaks:
            n = library.encode(t, add_special_tokens=False).ids
            want[i] = (t, len(t), len(n), hashlib.sha256(",".join(map(str, n)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.text, r.n_chars if r.text != rows[r.doc_id].text else len(r.text), r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in corpus_pipeline.run(spark, SMOKE).collect()}
    assert got == want and 0 < len(want) < len(rows) and leaks


def test_pipeline_stages_take_odd_rows(spark):
    for docs, least in ((odd(spark), 1), (empty(spark), 0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SMOKE)
            if k < 4:
                assert docs.columns == corpus_pipeline.COLUMNS, name
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) >= least and not {1, 2, 3, 9, None} & set(ids)


def test_one_id_with_two_texts_is_refused(spark):
    from spindle.llm import jaccard

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (2, "another text of its own kind here"), (2, words + " more")]
    with pytest.raises(ValueError, match="doc_id 2 has two different texts"):
        jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same = [(1, words), (2, words), (2, words), (None, "x y"), (None, "z")]
    assert jaccard.jaccard_components(spark.createDataFrame(same, "doc_id long, text string")).count() == 5


BSD3 = """Copyright (c) 2012, {holder}
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

    * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{endorse}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""


def test_licences_of_named_holders_and_listed_identifiers(spark):
    endorse = ("    * Neither the name of {holder} nor the names of its\n      contributors may be used to endorse or promote products derived from\n"
               "      this software without specific prior written permission.\n")
    texts = [(BSD3.format(holder=h, endorse=endorse.format(holder=h)), "BSD-3-Clause")
             for h in ("Google Inc.", "the copyright holder", "The Regents of the University, Ltd. and others", "<organization>")]
    texts += [(BSD3.format(holder="x", endorse=""), "BSD-2-Clause"), ("// SPDX-License-Identifier: MIT", "MIT"),
              ("# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "GPL-2.0-or-later"),
              ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
               "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
              ("Neither the name of the game nor its rules are known.", "")]
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    got = {r.doc_id: ",".join(r.licences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}
