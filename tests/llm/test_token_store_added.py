"""Ids against the library as it is loaded, with the strings of added tokens in texts."""

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelcast.llm import token_store as S

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_end_of_text_in_a_text():
    assert 50256 in ids("a <|endoftext|> b")
    assert np.frombuffer(S.encoder(PATH).encode(["a <|endoftext|> b"])[0], "<u4").tolist() == ids("a <|endoftext|> b")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab 'st1.\n\té\u00a0\u3000", "<|endoftext|>", "  ", "don't", "!?", "<|"]), max_size=60).map("".join))
def test_like_the_untouched_library(text):
    assert np.frombuffer(S.encoder(PATH).encode([text])[0], "<u4").tolist() == ids(text)
