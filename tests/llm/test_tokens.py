"""Merges of byte strings against the library and against the rule itself."""

import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gatherum.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tree():
    return bpe.TreeBpe(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def by_the_rule(ranks, data):
    parts = [bytes([b]) for b in data]
    while True:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not options:
            return [ranks[p] for p in parts]
        _, i = min(options)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.one_of(st.binary(min_size=1, max_size=90), st.text("abeinrst ", min_size=1, max_size=120).map(str.encode), st.text("aA", min_size=1, max_size=80).map(str.encode)))
@settings(max_examples=300, deadline=None)
def test_merges_follow_the_rule(tree, data):
    want = by_the_rule(tree.rank, data)
    assert tree.merged(data) == want == tree._merged_long([data[i : i + 1] for i in range(len(data))])
    assert tree._encode_bytes(data) == want


def test_every_token_is_its_own_encoding(tree, library):
    rng = random.Random(1)
    for token in rng.sample(sorted(tree.rank), 3000):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert tree.encode(text) == library.encode_ordinary(text)


def test_long_runs(tree, library):
    for text in ("a" * 40_000, "=" * 9_999, "ha" * 7_000, "é" * 5_000):
        assert tree.encode(text) == library.encode_ordinary(text)
