"""Token ids against the public library, both ways of merging, and odd texts."""

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cardmill.llm import tokenizer as T

OWN = T.Encoder(T.load_ranks(T.vocabulary_path()), T.word_pattern())
LIBRARY = tiktoken.Encoding("own", pat_str=T.word_pattern(), mergeable_ranks=OWN.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library(text):
    assert OWN.encode(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh", min_size=1, max_size=120).map(str.encode))
def test_both_merges_agree(word):
    assert OWN._merge_short(word) == OWN._merge_long(word)


def test_long_words_and_round_trip():
    for text in ("a" * 5000, "xyzzy" * 300, "é€" * 400, " " * 999 + "x", "<|endoftext|>"):
        ids = OWN.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert LIBRARY.decode(ids) == text


def test_rows(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "Hi", "x"), (1, "Hello world", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    made = sorted((r.doc_id or 0, r.ids) for r in T.encode_texts(docs).collect())
    hello = LIBRARY.encode_ordinary("Hello world")
    assert made == [(0, LIBRARY.encode_ordinary("Hi")), (1, hello), (1, hello), (2, []), (3, [])]
    assert {(r.doc_id, r.n_tokens) for r in T.count_tokens(docs, ["doc_id"]).collect()} == {(1, len(hello)), (2, 0), (3, 0), (None, 1)}
    assert T.encode_texts(docs.limit(0)).count() == 0
