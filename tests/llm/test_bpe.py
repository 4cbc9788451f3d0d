import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from treeline.llm import tokens
from treeline.llm.bpe import Decoder, Encoder, Vocabulary, tokenizer_file

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


def other(v):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    v = Vocabulary.load(tokenizer_file(request.param))
    return Encoder(v), other(v), Decoder(v)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_same_ids_as_merging(pair, text):
    e, o, d = pair
    assert e.encode(text) == o.encode_ordinary(text)
    assert d.decode(e.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="ab \n\t'stTh0é文=-", max_size=60))
def test_same_ids_on_dense_alphabets(pair, text):
    e, o, _ = pair
    assert e.encode(text) == o.encode_ordinary(text)


def test_long_runs_and_new_letters(pair):
    e, o, d = pair
    r = random.Random(1)
    for text in ("a" * 5000, " " * 5000, "=-" * 3000, "文" * 3000, "\n" * 999, "₝s ՘'s", "<|endoftext|>", "x\u0000y", "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000))):
        assert e.encode(text) == o.encode_ordinary(text)
        assert d.decode(e.encode(text)) == text
    long = "ab cd" * 250_000
    assert e.encode(long) == o.encode_ordinary(long)


def test_small_caches_change_nothing(monkeypatch):
    from treeline.llm import bpe

    monkeypatch.setattr(bpe, "MOST_PIECES", 2)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 2)
    v = Vocabulary.load(tokenizer_file("byte_bpe_50k.tiktoken"))
    text = "several different words vazanor qxzzy, mirkel 12345 \\alpha_{77}"
    assert Encoder(v).encode(text) == other(v).encode_ordinary(text)


def test_decoder_rejects_unknown_ids(pair):
    d = pair[2]
    with pytest.raises(ValueError):
        d.decode([len(d.vocabulary.tokens)])
    with pytest.raises(ValueError):
        d.decode([-1])
    assert d.decode(None) is None and d.decode([]) == "" and d.decode_bytes(np.zeros(0)) == b""


def test_corpus_with_null_empty_and_repeated_texts(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "Hello wörld", "x"), (4, "Hello wörld", "x"), (None, "a", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    o = other(Vocabulary.load(tokenizer_file("byte_bpe_50k.tiktoken")))
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted([(i, o.encode_ordinary(t or "")) for i, t, _ in data], key=repr)
    back = tokens.decode_corpus(tokens.encode_corpus(df, "doc_id", "text"), "doc_id")
    assert rows(back) == sorted([(i, t or "") for i, t, _ in data], key=repr)
    sizes = tokens.count_tokens(df, ["doc_id"], "text")
    assert rows(sizes) == sorted([(i, len(o.encode_ordinary(t or ""))) for i, t, _ in data], key=repr)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_bytes_that_are_not_text(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text")
    got = tokens.encode_corpus(df, "doc_id", "text").first().ids
    assert list(got) == other(Vocabulary.load(tokenizer_file("byte_bpe_50k.tiktoken"))).encode_ordinary("a�b")
