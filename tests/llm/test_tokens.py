"""Byte-level BPE against the tiktoken library, and token files against the tokenizers library."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tagmill.llm import bytebpe, tokenstore
from tagmill.llm.pieces import Memo, PieceEncoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.ByteBPE.from_file(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=" \n\t\x1c\x85\xa0　aabcet's.,1²é$"), st.text(alphabet="ab", min_size=50, max_size=400)))
def test_same_ids_as_the_library(bpe, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encode(text) == library.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)).decode() == text


def test_very_long_pre_tokens(bpe, library):
    rng = random.Random(1)
    for text in ("a" * 30_000, "ab" * 10_000, "".join(rng.choices("abcdefgh", k=40_000)), "=" * 9_000 + "\n" * 3_000):
        assert bpe.encode(text) == library.encode_ordinary(text)


def test_memo_forgets():
    memo = Memo(str.upper, 2)
    assert [memo[x] for x in "abcdeab"] == list("ABCDEAB")
    assert len(memo) <= 2 and len(memo.old) <= 2


@pytest.mark.parametrize("bits", [4, 6, 12])
def test_table_of_pieces(bits):
    """Also with tables that are too small for what comes at once."""
    rng = random.Random(bits)
    table = PieceEncoder(lambda parts, first: [np.frombuffer((("" if first else " ") + p).encode(), np.uint8).astype("<u4").tobytes() for p in parts], bits)
    parts = ["a", "bb", "é", " ", "  ", "\n", "longer word", "c\0", "c"]
    for _ in range(200):
        texts = ["".join(rng.choice([*parts, "x" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 8))]
        ids, counts = table.encode(texts)
        assert counts.tolist() == [len(t.encode()) for t in texts]
        assert ids.astype(np.uint8).tobytes() == "".join(texts).encode()


def _docs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a word", "x"), (3, "a word", "x"), (4, "long " * 20_000, "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_tokens STRING")


def test_documents(spark, library):
    got = bytebpe.encode_documents(_docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = library.encode_ordinary("long " * 20_000)
    assert by[4].n_tokens == len(ids) and by[4].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert by[4].decoded_sha256 == hashlib.sha256(b"long " * 20_000).hexdigest()
    assert bytebpe.encode_documents(_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(2, 4))
def test_grammar_round_trip(ids, least):
    ids = np.array(ids, np.uint32)
    symbols, rules = tokenstore.repair(ids, 4, min_count=least, rounds=30)
    assert (tokenstore.Grammar(rules, 4).expand(symbols.astype(np.int64)) == ids).all()
    row = {"base": 4, "width": symbols.dtype.itemsize, "symbols": symbols.tobytes(), "rules": rules.tobytes(), "lengths": tokenstore.rule_lengths(rules, 4).tobytes()}
    for a in range(0, len(ids) + 1, 37):
        for b in range(a, len(ids) + 1, 53):
            assert (tokenstore.decode_range(row, a, b) == ids[a:b]).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300))
def test_grammar_to_the_end(ids):
    """One pair at a time until none occurs twice without overlap; every rule is used."""
    symbols, rules = tokenstore.repair(np.array(ids, np.uint32), 4, **tokenstore.TO_THE_END)
    assert tokenstore.Grammar(rules, 4).expand(symbols.astype(np.int64)).tolist() == ids
    pairs = list(zip(symbols.tolist(), symbols.tolist()[1:], strict=False))
    twice = {p for i, p in enumerate(pairs) if p in pairs[i + (2 if p[0] == p[1] else 1) :]}
    assert not twice
    assert set(range(4, 4 + len(rules))) <= {*symbols.tolist(), *rules.ravel().tolist()}


def test_grammar_of_large_ids():
    ids = np.tile(np.array([70_000, 1, 80_000], np.uint32), 500)
    symbols, rules = tokenstore.repair(ids, 90_000, min_count=2)
    assert len(symbols) < 100 and symbols.dtype == np.uint32
    assert (tokenstore.Grammar(rules, 90_000).expand(symbols.astype(np.int64)) == ids).all()


def test_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/shards"
    monkeypatch.setattr(tokenstore, "SHARD_TOKENS", 50)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    tokenstore.write_shards(_docs(spark), tokenizer, 2, path)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read_shards(spark, path).collect())
    t = tokenizers.Tokenizer.from_file(tokenizer)
    want, start = [], 0
    for doc, text in sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in _docs(spark).collect()):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    exact = f"file://{tmp_path}/exact"
    tokenstore.write_shards(_docs(spark).filter("doc_id < 4 OR doc_id IS NULL"), tokenizer, 2, exact, grammar=tokenstore.TO_THE_END)
    assert sorted(r.ids_crc32 for r in tokenstore.read_shards(spark, exact).collect()) == sorted(c for a, _, _, c in want if a != 4)
    some = spark.createDataFrame([(3,), (4,), (1,), (None,), (99,)], "x BIGINT")
    ids = sorted(((r.doc_id if r.doc_id is not None else -1), len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in tokenstore.read_documents(spark, path, some).collect())
    assert ids == [(a, n, c) for a, _, n, c in want if a in (-1, 1, 3, 4)]
    empty = f"file://{tmp_path}/none"
    tokenstore.write_shards(_docs(spark).limit(0), tokenizer, 2, empty)
    assert tokenstore.read_shards(spark, empty).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab,.;é1 \n'<|>endoftxs_-\t\x00", max_size=60))
def test_pieces_encode_as_the_whole(text):
    encoder, _ = tokenstore._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_strings_of_special_tokens(spark, tmp_path):
    """They are ids of their own wherever they stand, as in the library."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(tokenizer)
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "<|endoftext|", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    path = f"file://{tmp_path}/shards"
    tokenstore.write_shards(docs, tokenizer, 2, path)
    want = [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes()) for x in texts]
    assert t.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 286]
    assert [r.ids_crc32 for r in tokenstore.read_shards(spark, path).orderBy("doc_id").collect()] == want
