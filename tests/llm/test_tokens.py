"""Encoders against the public libraries, on odd rows and on random texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arenalytics.llm import bpe, token_counts, token_files
from arenalytics.session import shared_folder
from tests.llm.conftest import odd_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aB é'strevlmd  \n\t12٣ñ中　\x1c!?.,'’é😀'▁<|endoftext|>İΣ\x85\xa0²"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), max_size=5))
def test_byte_bpe_random(library, texts):
    ids, counts = bpe.encode_texts(texts, RANKS)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert counts.tolist() == [len(library.encode_ordinary(t)) for t in texts]


def test_scan_crosses_blocks(library):
    text = "it's " * 400 + "x" * 3000 + " " * 700 + "'s're"
    assert bpe.encode_texts([text, "", text], RANKS)[0].tolist() == library.encode_ordinary(text) * 2


def test_merge_long_pieces_like_short_ones():
    ranks, rng = bpe.load_ranks(RANKS), random.Random(1)
    for _ in range(50):
        piece = bytes(rng.choice(b"theanding") for _ in range(rng.randint(2, 60)))
        if piece not in ranks:
            assert bpe._merge_long(piece, ranks) == bpe.merge(piece, ranks)


def test_byte_bpe_odd_rows(odd, library):
    coded = bpe.encode(odd, RANKS)
    back = bpe.decode(coded, RANKS).collect()
    want = sorted((str(i), (t or "").encode()) for i, t in odd_rows())
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == want
    for row in coded.collect():
        offsets = np.frombuffer(row.offsets, "<u4")
        assert len(offsets) == row.n_tokens == len(row.ids) // 4
        assert not len(offsets) or offsets[0] == 0
    assert sum(r.n_tokens for r in back) == sum(len(library.encode_ordinary(t or "")) for _, t in odd_rows())


def test_empty_tables(spark, none):
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    assert token_counts.token_counts(none, PIECES).count() == 0
    path = shared_folder(spark, "no-ids")
    token_files.write_ids(none, WORDS, path)
    assert token_files.read_ids(spark, path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text("ab  \n\n▁é中\t</s>unk", max_size=40))
def test_piece_counts_random(text):
    want = len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))
    assert sum(token_counts.lengths(PIECES, token_counts.pre_tokens(text))) == want


def test_piece_counts_odd_rows(odd):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in odd_rows())
    got = token_counts.token_counts(odd, PIECES, limit=10).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)


def test_frequent_table_does_not_change_counts(odd, monkeypatch):
    whole = sorted(map(tuple, token_counts.token_counts(odd.where("doc_id is not null"), PIECES).collect()))
    monkeypatch.setattr(token_counts, "frequent_lengths", lambda *a: {})
    assert sorted(map(tuple, token_counts.token_counts(odd.where("doc_id is not null"), PIECES).collect())) == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 63).flatmap(lambda b: st.integers(0, (1 << b) + 1)), max_size=200))
def test_packing_round_trip(values):
    assert token_files.unpack(token_files.pack(np.array(values, np.uint64))).tolist() == values


def test_packing_escapes_and_density():
    values = np.array([2**64 - 1, 0, 2**60 - 1, 2**60, 5], np.uint64)
    assert token_files.unpack(token_files.pack(values)).tolist() == values.tolist()
    assert len(token_files.pack(np.zeros(6000, np.uint64))) == 8 * (2 + 100)


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_word_ids_random(text):
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_files.encode_texts([text], WORDS)[0], "<u4").tolist() == want


def test_token_files_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    path = shared_folder(spark, "ids")
    token_files.write_ids(odd, WORDS, path)
    tokenizer = Tokenizer.from_file(WORDS)
    code = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    rows = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in odd_rows()], key=lambda i: -1 if i is None else i)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == sorted((str(i), code(t)) for i, t in odd_rows())
    position = 0
    for row in rows:
        assert row.start == position and row.n_tokens == len(row.ids) // 4
        position += row.n_tokens
    sums = {(r.start, r.ids_crc32) for r in token_files.read_ids(spark, path, each="crc32").collect()}
    assert sums == {(r.start, zlib.crc32(bytes(r.ids))) for r in rows}
