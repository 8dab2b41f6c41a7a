"""Vector codes against plain Lloyd rounds."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from stallwise.llm import dual_tree

SCHEMA = "vec_id bigint, embedding array<float>, label int, _row string, error string, code int"


def plain(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> list[tuple]:
    """Every distance of every round, in whole numbers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max(len(r[1]) for r in rows) // parts) * parts
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    w = width // parts
    cut = [[v[w * p : w * p + w] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p: int, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        met = defaultdict(list)
        for c in cut:
            for p in range(parts):
                met[p, nearest(p, c[p])[1]].append(c[p])
        for (p, k), own in met.items():
            books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    of_label = defaultdict(int)
    for r, f in zip(rows, found, strict=True):
        of_label[r[2]] += sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [
        (r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), of_label[r[2]], digest)
        for r, f in zip(rows, found, strict=True)
    ]


def report(spark, rows: list[tuple], pieces: int = 3) -> list[tuple]:
    df = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], SCHEMA).repartition(pieces)
    return sorted((tuple(r) for r in dual_tree.code_report(df).collect()), key=str)


def vectors(seed: int, n: int, width: int, spread: float) -> list[tuple]:
    chance = np.random.default_rng(seed)
    values = (chance.normal(0, spread, (n, width)) * 4096 // 512 / 8).astype(np.float32)  # a coarse grid: many ties
    return [(int(i), values[i].tolist(), int(i) % 3 if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "width", "spread"), [(10, 16, 1.0), (300, 64, 0.01), (150, 24, 3.0)])
def test_codes(spark, n, width, spread):
    rows = vectors(n, n, width, spread)
    assert report(spark, rows) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 60, 16, 1.0)
    rows += [rows[20]] * 40  # a row given many times
    rows += [(None, [0.5] * 16, None), (None, None, 1), (900, [nan] * 16, 1), (901, [1.0, inf], 1), (902, [None] * 16, 2)]
    rows += [(903, [], 2), (904, [1.0, -2.0, 0.25], None), (-5, [0.5] * 11, 7)]
    assert report(spark, rows) == sorted(plain(rows), key=str)


def test_nothing_to_code(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []
    assert [r[:3] for r in report(spark, [(1, [], 1)])] == [(1, "00" * 8, 0)]


def test_components_that_do_not_fit(spark):
    with pytest.raises(Exception, match="would not fit"):
        report(spark, [(1, [1e9] * 8, 1)])


def test_whole_nodes_are_assigned_without_looking_at_their_parts():
    chance = np.random.default_rng(2)
    centres = chance.integers(-90_000, 90_000, (16, 16))
    rows = centres[chance.integers(0, 16, 1500)] + chance.integers(-20, 20, (1500, 16))
    forest = dual_tree.Forest.built(rows, 8)
    books = centres.reshape(16, 8, 2).transpose(1, 0, 2).copy()
    uncertain = 0
    for part, entries in enumerate(books):
        uncertain += sum(len(np.unique(node)) for node, _, level in dual_tree.walk(forest, part, entries) if level < 0)
    leaves = 8 * (len(forest.levels[-1]) - 1)
    assert uncertain < leaves / 2
