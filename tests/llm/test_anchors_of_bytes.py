"""Work of the search for repeated bytes that does not show in its rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from stallwise.llm import arrowtext, repeats, suffix


def letters(chance: random.Random, n: int) -> str:
    return "".join(chance.choices("abcdefghij ", k=n))


def texts_of(*texts: str) -> arrowtext.Texts:
    return next(arrowtext.slices(pa.array(texts, type=pa.large_string())))


def test_anchors_go_on_over_the_edges_of_blocks(monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 256)
    chance = random.Random(31)
    shared = letters(chance, 3000)
    a = suffix.byte_anchors(texts_of(shared, letters(chance, 77) + shared))
    found = [set(zip(a.hash[a.row == r], a.context[a.row == r], strict=True)) for r in (0, 1)]
    # Only the first and the last context of the shorter text may end early.
    assert len(found[0] - found[1]) <= 2
    for r, n in ((0, 3000), (1, 3077)):
        first, last = a.first[a.row == r], a.last[a.row == r]
        assert first[0] == 0 and last[-1] == n - suffix.LENGTH and (first[1:] == last[:-1] + 1).all()
        place = a.place[a.row == r]
        assert (first <= place).all() and (place + suffix.RUN <= first + suffix.LENGTH).all()
        assert (np.diff(place) != 0).all()


def test_anchors_without_contexts_are_the_same():
    chance = random.Random(32)
    texts = texts_of("", letters(chance, 99), letters(chance, 100), "", letters(chance, 70_000), "ü" * 200)
    with_contexts, without = suffix.byte_anchors(texts), suffix.byte_anchors(texts, contexts=False)
    for column in ("row", "ordinal", "place", "hash", "first", "last"):
        assert (getattr(with_contexts, column) == getattr(without, column)).all()
    assert set(without.row.tolist()) == {2, 4, 5} and not without.context.any()


def test_long_windows_have_anchors_too(monkeypatch):
    chance = random.Random(33)
    shared = letters(chance, 90_000)
    texts = texts_of(shared, letters(chance, 10) + shared)
    a = suffix.byte_anchors(texts, length=80_000)
    assert set(a.hash[a.row == 0]) <= set(a.hash[a.row == 1])


def test_groups_in_order_are_not_sorted_again(monkeypatch):
    sorted_items = []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_items.append(len(keys[0])) or lexsort(keys))
    raw = np.frombuffer(letters(random.Random(34), 100).encode() * 500, dtype=np.uint8)
    begin = np.arange(0, len(raw), 100)
    alive, group = suffix.equal_suffixes(np.zeros(len(begin), dtype=np.int64), raw, begin, 100)
    assert sorted(alive.tolist()) == list(range(500)) and not group.any()
    assert sum(sorted_items) == 0


def test_small_packed_texts_come_together_and_long_ones_alone():
    chance = random.Random(35)
    texts = [letters(chance, n) for n in [50] * 100 + [3000] + [50] * 3]
    packed = pa.array([repeats.pack(t.encode()) for t in texts], type=pa.binary())
    batch = pa.RecordBatch.from_arrays([packed, pa.array(range(len(texts)))], names=["packed", "id"])
    slices = list(repeats.unpacked(batch.slice(1), 0, limit=5000))
    assert [len(t) for t, _ in slices] == [99, 4]
    slices = list(repeats.unpacked(batch, 0, limit=1000))
    assert [len(t) for t, _ in slices] == [20] * 5 + [1, 3]
    ids = [i for _, (column,) in slices for i in column.to_pylist()]
    assert ids == list(range(len(texts)))
    assert [t.text(r).decode() for t, _ in slices for r in range(len(t))] == texts


def test_lists_of_a_part_of_a_column():
    column = pa.array([[1, 2], None, [], [3, None], [4]], type=pa.list_(pa.int32())).slice(1, 3)
    assert [x.tolist() for x in repeats.lists(column)] == [[], [], [3, repeats.MISSING]]
    row, values = repeats.flat(column)
    assert row.tolist() == [2, 2] and values.tolist() == [3, repeats.MISSING]
    again = repeats.listed(np.array([3, 4]), np.array([0, 0, 2]), np.array([False, True, True]))
    assert again.to_pylist() == [None, [], [3, 4]]
