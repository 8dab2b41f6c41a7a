"""Words that sums of powers modulo 2^64 cannot tell apart."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from stallwise.llm import arrowtext, cover, quality, tokens, trie  # noqa: E402

SCHEMA = "doc_id bigint, text string"


def thue_morse(size: int, letters: str) -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(size))


PAIRS = [(thue_morse(n, "ab"), thue_morse(n, "ba")) for n in (64, 256, 512, 1024, 2048, 8192)]


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_hashes_differ(pair):
    texts = next(arrowtext.slices(pa.array([" ".join(pair)])))
    found = arrowtext.words(texts, arrowtext.NOT_SPACE)
    one, two = arrowtext.span_hashes(texts.data, found.start, found.end)
    assert one != two


def test_results(spark):
    tail = " ".join(f"w{k}" for k in range(34))
    rows = []
    for k, (u, v) in enumerate(PAIRS):
        rows += [(4 * k, f"{u} one two three"), (4 * k + 1, f"{v} one two three"), (4 * k + 2, f"{u} {tail} x{k}"), (4 * k + 3, f"{v} {tail} y{k}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in trie.linked_documents(docs).collect()) == sorted(brute.linked(rows))
    found = {r["doc_id"]: r["n_removed"] for r in cover.duplicate_words(docs).collect()}
    assert not any(found.values())


@pytest.mark.parametrize("pair", PAIRS, ids=lambda p: str(len(p[0])))
def test_token_ids(pair):
    text = f"{pair[0]} {pair[1]} and {pair[1]} {pair[0]}"
    ids, counts = tokens.encoder("word_bpe_49k.json").encode(next(arrowtext.slices(pa.array([text]))))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*plain, 1] and counts.tolist() == [len(plain) + 1]


def test_slots_differ():
    u, v = PAIRS[-1]
    slots = [next(iter([s for s, _ in quality.ngrams(next(arrowtext.slices(pa.array([t]))))][-1:])) for t in (u, v)]
    assert slots[0].tolist() != slots[1].tolist()
