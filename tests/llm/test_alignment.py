"""Cross-tokenizer alignment against both libraries and a plain walk over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from cases import ODD, empty, odd
from conftest import SMOKE
from tokenizers import Tokenizer

from spindle.llm import alignment

PARTS = ["a", "b", "é", " ", "  ", "\n", "\r\n", "\r", "'s", "'ll", "1", "23", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "ing", "the", "!", "***",
         "日本", "\x1c", "\x85", "\xa0", "ñ", "​", "\U0001F600", "aaaa", "----", "\t", "²", " ", "\x00", ");\r", "token", " tokens", "　"]


class Brute:
    def __init__(self):
        a, b = alignment.default_paths()
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes = [alignment.byte_side(open(a, "rb").read()).bytes, alignment.piece_side(open(b, "rb").read()).bytes]

    def ids(self, text):
        if not text:
            return [], []
        out = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if any(b"".join(self.bytes[k][i] for i in out[k]) != whole for k in (0, 1)):
            return [], []
        return out

    def groups(self, text):
        ends, ids = [], self.ids(text)
        for k in (0, 1):
            at, mine = 0, []
            for i in ids[k]:
                at += len(self.bytes[k][i])
                mine.append(at)
            ends.append(mine)
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = i, j
            while i < len(ends[0]) and ends[0][i] <= cut:
                i += 1
            while j < len(ends[1]) and ends[1][j] <= cut:
                j += 1
            out.append((list(ids[0][x:i]), list(ids[1][y:j])))
        return out

    def table(self, docs):
        found = [(d, self.groups(t)) for d, t in docs]
        held, top = Counter(), defaultdict(int)
        for _, gs in found:
            held.update({(x, y) for a, b in gs for x in a for y in b})
        for (x, _), n in held.items():
            top[x] = max(top[x], n)
        out = []
        for d, gs in found:
            met = [(x, y) for a, b in gs for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
            out.append((d, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(met),
                        sum(held[p] == top[p[0]] for p in met), sum(held[p] for p in met),
                        hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(r):
    return (r[0] is None, str(r))


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=key)


def random_texts(n, seed, most=30):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_words_encode_as_whole_texts(brute):
    pair = alignment.Pair(*(f(open(p, "rb").read()) for f, p in zip((alignment.byte_side, alignment.piece_side), alignment.default_paths())))
    texts = random_texts(3000, 1) + ["x" * 3000, "ab" * 2000, " " * 700 + "x" + " " * 300, "日本語の" * 300, "a\n \n  b\r\n \r c  \n"]
    (a, na), (b, nb) = pair.tokens([" " + t for t in texts])
    ends_a, ends_b = na.cumsum(), nb.cumsum()
    for i, t in enumerate(texts):
        assert a[ends_a[i] - na[i]:ends_a[i]].tolist() == brute.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
        if t and "▁" not in t:
            assert b[ends_b[i] - nb[i]:ends_b[i]].tolist() == brute.b.encode(t), repr(t)


def test_memory_of_words_starts_anew(brute, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 50)
    pair = alignment.Pair(*(f(open(p, "rb").read()) for f, p in zip((alignment.byte_side, alignment.piece_side), alignment.default_paths())))
    for t in random_texts(200, 5):
        (a, _), _ = pair.tokens([" " + t])
        assert a.tolist() == brute.a.encode(" " + t, add_special_tokens=False).ids


@pytest.mark.parametrize("size,block", [(1 << 23, 1 << 20), (200, 60)])
def test_statistics_equal_brute_force(spark, brute, size, block):
    texts = random_texts(300, 2) + ["", None, "with ▁ inside", "same text here"] + ["same text here"] * 5
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(alignment.statistics(df, size=size, block=block)) == sorted(brute.table(docs), key=key)


def test_odd_rows(spark, brute):
    assert got(alignment.statistics(odd(spark))) == sorted(brute.table([r[:2] for r in ODD]), key=key)
    assert got(alignment.statistics(empty(spark))) == []


def test_query_on_whole_table(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    assert got(alignment.op11_alignment(spark, SMOKE)) == sorted(brute.table(docs), key=key)


def test_groups_give_ids_and_byte_ranges(spark, brute):
    docs = list(enumerate(random_texts(60, 4) + ["", "▁"]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for r in alignment.groups(df).collect():
        assert [(list(g.a), list(g.b)) for g in r.token_groups] == brute.groups(r.text)
        whole = (" " + r.text).encode()
        for g in r.token_groups:
            assert b"".join(brute.bytes[1][i] for i in g.b) == whole[g.start:g.end]
    with pytest.raises(ValueError):
        alignment.groups(alignment.groups(df))
