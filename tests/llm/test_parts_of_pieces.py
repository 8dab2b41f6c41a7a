"""Words and the stops after them are encoded apart, each different one once, with the ids of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from stallwise.llm import tokens
from stallwise.llm.arrowtext import NOT_SPACE, slices, spelled, words

TEXTS = [
    None, "", "...", "Ab., cd.", "ÄB. Äb, i̇. İx", "é. é, é.", "x........ y,.,.,.,. ,., .a ,b.", "Σ. ΑΣ. aΣ, 東京. 東京、",
    "1.5, 2., 3.a. (ab). [c],", "A" * 100 + ".", "İ. K, ß.", "x . 　y. z", ".", " a\n", "it's. IT'S,", "ﬁ. Ａ．",
]


def parts_of(texts: list) -> list[list[bytes]]:
    (slice_,) = slices(pa.array(texts, type=pa.string()), tokens.SLICE)
    data, lengths, first = tokens.parted(slice_.data, words(slice_, NOT_SPACE))
    codes, different = spelled(data, NOT_SPACE, lengths)
    spelled_out = [different[c].as_py() for c in codes.tolist()]
    return [spelled_out[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def test_stops_are_parted_from_letters_and_digits():
    assert parts_of(["Ab., X... Äb. É, (C). 1.5, ......z"]) == [
        [b"ab", b".,"], [b"x", b"..."], ["Äb".encode(), b"."], ["É,".encode()], [b"(c)."], [b"1.5", b","], [b"......z"],
    ]
    assert parts_of(["a" + "." * 50 + " ,,,,,,,,"]) == [[b"a", b"." * 50], [b",,,,,,,,"]]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:2], [" ", None, "a."]])
def test_ids_are_those_of_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary())
    (slice_,) = slices(pa.array(texts, type=pa.string()), tokens.SLICE)
    flat, counts = tokens.Encoder("word_bpe_49k.json").encode(slice_)
    got = [ids.tolist() for ids in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, tokens.END_ID] for t in texts]
