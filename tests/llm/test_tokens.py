"""Token counts and BPE ids against the libraries, on made-up and given texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lotwise.llm import bpe_codec, token_counts

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
ATOMS = ["a", "the", " ", "  ", "\n", "\t", "é", "É", "ﬁ", "①", "😀", "<s>", "▁", "x", "==", "--", "1", "23", " the", "ing",
         "\r", "\r\n", "0000", "aaaa", "　", "中", "の", "\x00", "    ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL",
         "\x1c", "\x85", "\xa0", "Σ", "İ", "é", "́", "ß", "²", "ªº", "ǅ", "​", "ʰ", "\xad", "’", "—"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [
        "", " ", "a" * 5000, " " * 3001, "=" * 1000, "\r" * 999, "ab" * 3000, " a" * 200, "xyz" * 1000 + " " * 500]


def test_piece_counts(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert token_counts.PieceCounter(PIECE).tokens(texts) == [len(x) for x in sp.encode(texts)]


def test_piece_counts_with_a_tiny_cache(texts, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 10)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    own = token_counts.PieceCounter(PIECE)
    assert [own.tokens([t])[0] for t in texts[:500]] == [len(x) for x in sp.encode(texts[:500])]


def test_word_bpe_ids_and_text(texts):
    own, lib = bpe_codec.ForcedBoundaryCodec(WORD), Tokenizer.from_file(WORD)
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_cuts_are_certain():
    own = bpe_codec.ForcedBoundaryCodec(WORD)
    word = "zxqjthevvvking"
    parts = own.fragments([word])
    assert b"".join(parts) == word.encode() + b"\xff" and len(parts) > 1
    whole = own._merged([own.symbol_id[s] for s in own.symbols(word.encode() + b"\xff")])
    assert b"".join(map(own.fragment_ids, parts)) == np.array(whole, "<u4").tobytes()


def test_word_bpe_with_a_tiny_cache(texts, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_FRAGMENTS", 3)
    own, lib = bpe_codec.ForcedBoundaryCodec(WORD), Tokenizer.from_file(WORD)
    for t in texts[:500]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "Hello World", 5), (4, "x", 5), (4, "x", 5), (5, "w" * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    counts = token_counts.token_counts(df, PIECE, limit=10)
    got = sorted(map(tuple, counts.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=repr)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    n = lambda t: len(sp.encode(t))
    assert got == sorted([(i, len(t or ""), n(t or ""), n(t or "") > 10) for i, t, _ in rows], key=repr)
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe_codec.encode_documents(df, WORD).collect()}
    assert ids[1] == ids[2] == ([], "") and ids[None][1] == "hello</w> world</w>" and ids[4][1] == "x</w>"
    assert token_counts.token_counts(df.limit(0), PIECE).count() == 0
    assert bpe_codec.round_trip_digests(df.limit(0), WORD).count() == 0


def test_queries_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp, lib = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)
    got = token_counts.op10_token_counts(spark, sf).collect()
    assert len(got) == len(texts) and all(r.n_tokens == len(sp.encode(texts[r.doc_id])) for r in got)
    for r in bpe_codec.op6_forced_bpe(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
