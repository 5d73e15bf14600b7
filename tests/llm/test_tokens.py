"""BPE transducer, decoder and counting transducer against the tokenizers library."""

import hashlib
import random

import pytest
from cases import ODD, empty, odd
from conftest import SMOKE
from tokenizers import Tokenizer

from spindle.llm import bpe, token_count

PARTS = ["a", "b", "é", " ", "  ", "\n", "'s", "'ll", "1", "23", "<|endoftext|>", "<|end", "ing", "the", "!", "***", "日本", "\x1c", "\x85",
         " ", "ñ", "​", "\U0001F600", "aaaa", "----", "\t", "²", "़"]


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_vocabulary(bpe.default_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


RUNS = ["a" * 9000, " " * 9000 + "x", "-=" * 3000, "the" * 3000, "日本" * 2000, "\n \t" * 3000]


def test_streaming_encoder_equals_library(merges, library):
    memo, look = bpe.Memo(merges), merges.lookahead()
    for text in random_texts(1500, 0) + RUNS:
        want = ids(library, text)
        for chunk, long in ((1 << 16, 1024), (1, 3), (7, 5)):
            if len(text) > 1000 and chunk < 10:
                chunk, long = 501, 8
            enc, got = bpe.Encoder(merges, memo, long=long, look=look), []
            for a in range(0, len(text), chunk):
                got += enc.feed(text[a:a + chunk])
                assert enc.held() <= 2 * look + 4 * (long + chunk) + 64
            assert got + enc.finish() == want, repr(text[:80])


def test_lookahead_settles_tokens(merges):
    r, look = random.Random(3), merges.lookahead()
    assert 0 < look < 5000
    words = "".join(r.choice("etaoinshr") for _ in range(4 * look)).encode()
    for tail in (b"", b"ing", b"xyz", b"e" * 50):
        whole, cut, settled = merges.encode(words + tail), 0, []
        for t in merges.encode(words):
            cut += len(merges.bytes[t])
            if cut > len(words) - look:
                break
            settled.append(t)
        assert whole[:len(settled)] == settled


def test_improper_merge_list_is_refused():
    raw = b'{"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["ab b", "a b"]}}'
    with pytest.raises((ValueError, KeyError)):
        bpe.Merges(raw)


def test_incremental_decoder(merges, library):
    for text in random_texts(300, 5):
        t, dec, out = ids(library, text), bpe.Decoder(merges), ""
        for i in t:
            out += dec.feed([i])
        assert out + dec.finish() == library.decode(t, skip_special_tokens=False) == text
    broken = [merges.single[0xE6], merges.single[0x41], merges.single[0xFF]]
    dec = bpe.Decoder(merges)
    assert dec.feed(broken) + dec.finish() == library.decode(broken, skip_special_tokens=False)


def test_query_round_trip(spark, library):
    rows = {r.doc_id: r for r in bpe.op2_bpe(spark, SMOKE).collect()}
    for d in spark.read.parquet(f"{SMOKE}/documents.parquet").collect():
        t, r = ids(library, d.text or ""), rows[d.doc_id]
        assert r.n_tokens == len(t)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, t)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(t, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, library):
    full = bpe.decode(bpe.encode(odd(spark).select("doc_id", "text", "n", "start")))
    got = full.collect()
    assert len(got) == len(ODD) and full.columns[:4] == ["doc_id", "text", "n", "start"]
    assert all(r.decoded == (r.text or "") and r.token_ids == ids(library, r.text or "") for r in got)
    assert bpe.round_trip(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd(spark), ids="n")
    counted = token_count.count_tokens(odd(spark), chunk=1000)
    assert "text" not in counted.columns and len(counted.columns) == 16
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted.collect()) == sorted(
        (r[0] or 0, len((r[1] or "").encode()), len(ids(library, r[1] or ""))) for r in ODD)
    assert token_count.count_tokens(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(odd(spark).withColumnRenamed("n", "n_tokens"))


def test_transducer_and_chunk_maps(merges, library):
    tr = token_count.CountTransducer(merges, most_states=2000, most_pieces=500)
    for text in random_texts(1200, 1) + RUNS:
        want = len(ids(library, text))
        assert tr.count(text) == want
        for size in (3, 11) if len(text) < 1000 else (700,):
            maps = [tr.chunk_map(text[a:a + size]) for a in range(0, len(text), size)] or [("", 0, "")]
            scans = tr.scan(maps)
            assert tr.apply(scans[-1]) == want
            left = maps[0]
            for m, s in zip(maps[1:], scans[1:], strict=True):  # the scan is that of a loop
                left = tr.compose(left, m)
                assert tr.apply(left) == tr.apply(s)


def test_count_query(spark, library):
    rows = {r.doc_id: r for r in token_count.op9_token_counts(spark, SMOKE).collect()}
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(ids(library, d.text or ""))
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


def test_total_is_the_last_of_the_scan_and_keeps_little(merges):
    """A text without white space stays unresolved to its end: composing it holds its text a few times, whatever its length."""
    import tracemalloc

    tr = token_count.CountTransducer(merges)
    for text in random_texts(30, 8) + ["x y " * 500, "ab" * 700]:
        maps = [tr.chunk_map(text[a:a + 50]) for a in range(0, len(text), 50)] or [("", 0, "")]
        assert tr.total(maps) == tr.scan(maps)[-1]
    peaks = []
    for n in (200_000, 800_000):
        maps = [tr.chunk_map(("Zq7#" * (n // 4))[a:a + 1000]) for a in range(0, n, 1000)]
        tracemalloc.start()
        tr.total(maps)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0]


def test_patterns_are_compiled_once_for_all_texts(merges, library, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a pattern was compiled for a text")

    monkeypatch.setattr(bpe.regex, "compile", refuse)
    memo, look = bpe.Memo(merges), merges.lookahead()
    for text in ["the cat's 23 hats", "a" * 3000]:
        assert [t for part in bpe.encode_text(text, merges, memo, look) for t in part] == ids(library, text)
