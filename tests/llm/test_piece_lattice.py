"""Segmentations over the whole lattice: no piece is cut off by units, whatever its characters."""

import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from textloom.llm.piece_sampling import Sampler, decode_ids, piece_model, span_keys


@pytest.fixture(scope="module")
def model():
    return piece_model(public_tokenizers.path("piece_bpe_32k.model"), 1.0)


def weight(model, piece):
    points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero(model.keys == span_keys(points, len(piece))[0])
    return float(model.weights[at[0]]) if len(at) else 0.0


def shares(model, text):
    """The share of every segmentation of the text, by trying all cuts."""
    want = {}
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        parts = tuple(text[a:b] for a, b in zip(at, at[1:]))
        if w := float(np.prod([weight(model, p) for p in parts])):
            want[parts] = w
    return {parts: w / sum(want.values()) for parts, w in want.items()}


def test_every_piece_is_in_one_unit(model):
    sampler = Sampler(model)
    pieces = [model.bytes_of[i].decode() for i in model.ids]
    assert sampler._units(pieces)[0] == pieces


@pytest.mark.parametrize("text", ["a (b);  c", '",  -- x', "    (x)", " the"])
def test_shares_with_punctuation_and_spaces(model, text):
    n = 40_000
    found = Counter(tuple(model.bytes_of[i].decode() for i in x) for x in Sampler(model).sample([text] * n, np.arange(n), 1))
    want = shares(model, text)
    assert set(found) <= set(want)
    for parts, p in want.items():
        assert abs(found[parts] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_units_of_any_length(model):
    """Long runs are one unit; their sums do not vanish, and runs of spaces use the pieces of many spaces."""
    texts = [" " * 3_000, "ab" * 2_000, "-" * 1_500]
    found = Sampler(model).sample(texts, np.arange(3), 5)
    assert [decode_ids(model, x.tolist()).decode() for x in found] == texts
    assert max(len(model.bytes_of[i]) for i in found[0]) > 1
