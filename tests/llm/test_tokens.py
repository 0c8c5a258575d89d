import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import bpe
from corvane.llm.common import safe_pieces
from corvane.llm.token_counts import count_tokens

random.seed(1)
ODD = ["", None, "  a  b", "don't  '  x\x1c!\x1c\x85 y", "<|endoftext|> a<|endoftext|>", "x" * 3000, "abab" * 800 + " 12² Ⅷ", "\n\n a\r\n b \t", "漢字 かな　漢 字", "é é​ 👩‍👩‍👧 a", "'s'S 're  'll", "word " * 30_000]
ODD += ["".join(random.choice(" \n\t\r\x0b\x1c 　ab'st12!.é漢́") for _ in range(random.randint(1, 40))) for _ in range(300)]
ODD += ["word\xa0 next " * 2000, "漢字かな，한국。" * 4000, "漢" * 20_000, "a,b.c!(d)" * 3000, "x\xa0" * 3000 + " y", "don't," * 500, "\u0301a\u0301," * 400]
ODD += ["".join(random.choice("ab漢，,.。!'(é\u0301\xa0　 \n1") for _ in range(2000)) for _ in range(30)]
ODD += ODD[:12]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, 7) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, n_tokens int")


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_the_librarys(docs, name):
    model = Tokenizer.from_file(P.path(name))
    got = {r.doc_id: r for r in count_tokens(docs, P.path(name)).collect()}
    for i, t in enumerate(ODD):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t


def test_sentencepiece_counts(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i] == len(model.encode(t or "")) for i, t in enumerate(ODD))


def test_bpe_is_the_librarys_and_comes_back(docs, library):
    df = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)
    got = {r.doc_id: r for r in df.collect()}
    for i, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded == (t or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(df, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert all(again[i] == (t or "").encode() for i, t in enumerate(ODD))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_texts_are_cut():
    assert len(safe_pieces("word\xa0 next " * 2000)) >= 2000 and len(safe_pieces("漢字かな，" * 4000)) >= 3999
    assert max(map(len, safe_pieces("a\xa0 b " * 5000))) < 8


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_pieces_concatenate(text):
    assert "".join(safe_pieces(text)) == text
