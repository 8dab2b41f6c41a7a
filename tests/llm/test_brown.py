"""Class-based scores against plain sums over tokens, with the classes that were learnt."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import brown

SCHEMA = "doc_id bigint, text string, lang string, row bigint, codes int, word string"
END = None


def tokens(text: str | None) -> list:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)], END]


def learns(doc: int | None) -> bool:
    return zlib.crc32(str("" if doc is None else doc).encode()) % 5 != 1


def known_as(word: bytes) -> bytes:
    return word if len(word) <= 64 else word[:31] + b" " + hashlib.sha256(word).digest()


def plain(rows: list[tuple], classes: dict[bytes, int], n_classes: int, unknown: int) -> tuple[list[tuple], float]:
    """Scores by the definition, and the greatest departure of the probabilities after a token from 1."""
    lessons = [tokens(t) for d, t in rows if learns(d)]
    count = Counter(w for text in lessons for w in text)
    n, v = sum(count.values()), len(count)

    def of(word) -> int:
        if word is END:
            return 0 if n else unknown
        return classes[known_as(word)] if count[word] else unknown

    moves = np.zeros((n_classes, n_classes))
    for text in lessons:
        for a, b in zip([END, *text], text):
            moves[of(a), of(b)] += 1
    size, words = np.zeros(n_classes), np.zeros(n_classes)
    for w, c in count.items():
        size[of(w)] += c
        words[of(w)] += 1
    words[unknown] += 1
    share = (size + 0.5 * words) / (n + 0.5 * (v + 1))

    def chance(a: int, b: int) -> float:
        seen = (moves[a, b] + brown.PRIOR * share[b]) / (moves[a].sum() + brown.PRIOR)
        return (1 - brown.PLAIN) * seen + brown.PLAIN * share[b]

    def within(word, g: int) -> float:
        return (count[word] + 0.5) / (size[g] + 0.5 * words[g])

    symbols = [*count, b"never seen"]
    odd = max(abs(sum(chance(a, of(w)) * within(w, of(w)) for w in symbols) - 1) for a in range(n_classes))
    out = []
    for d, t in rows:
        text = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in text)
        score = sum(math.log10(chance(of(a), of(b)) * within(b, of(b))) for a, b in zip([END, *text], text))
        out.append((d, not learns(d), len(text), sum(count[w] > 0 for w in text), n, base, score))
    return out, odd


def corpus(seed: int, n: int) -> list[tuple]:
    """Two languages of two kinds of words in turn, some words in one text only."""
    chance = random.Random(seed)
    rows = []
    for d in range(n):
        language = "pq"[d % 2]
        words = []
        for k in range(chance.choice([0, 5, 30, 60])):
            words.append(f"{language}{'ab'[k % 2]}{int(chance.random() ** 3 * 40)}")
            if chance.random() < 0.05:
                words.append(f"once{chance.randrange(10**6)}")
        rows.append((d, " ".join(words)))
    rows += [(None, None), (None, "PA1 pb2"), (n, "x" * 300 + " Pa1 " + "x" * 299), (n + 1, "x" * 300), (n + 1, "x" * 300), (n + 2, " \n"), (n + 3, "é 9 ? É")]
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "en", 1, 2, "w") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("common", "moved"), [(1000, 1000), (40, 16), (0, 0)])
def test_scores(spark, common, moved):
    rows = corpus(common, 120)
    out, model = brown.scored(frame(spark, rows), brown.teaches(F.col("doc_id")), common_words=common, moved_words=moved, n_classes=8)
    classes = {bytes(r["word"]): r["class"] for r in brown.word_classes(model).collect()}
    expected, odd = plain(rows, classes, 8, model.unknown)
    assert odd < 1e-9
    found = out.select("doc_id", ~F.col("teaches"), "n_tokens", "n_known", F.lit(model.tokens), "base_score", "score").collect()
    found, expected = (sorted(map(tuple, r), key=str) for r in (found, expected))
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected, strict=True):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9)


def test_words_of_a_kind_share_classes_and_held_out_texts_become_likelier(spark):
    rows = corpus(3, 400)
    out, model = brown.scored(frame(spark, rows), brown.teaches(F.col("doc_id")), n_classes=8)
    held = out.filter(~F.col("teaches")).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.9 * held[1]
    classes = [(bytes(r["word"])[:2], r["class"], r["n"]) for r in brown.word_classes(model).collect()]
    of_kind = {kind: Counter() for kind in (b"pa", b"pb", b"qa", b"qb")}
    for kind, cls, n in classes:
        if kind in of_kind:
            of_kind[kind][cls] += n
    first = [c.most_common(1)[0] for c in of_kind.values()]
    assert len({cls for cls, _ in first}) == 4
    assert sum(n for _, n in first) > 0.6 * sum(sum(c.values()) for c in of_kind.values())


def test_an_exchange_is_worth_what_the_likelihood_gains():
    chance = np.random.default_rng(1)
    rest = chance.integers(0, 50, (7, 7))
    before, after, twice = chance.integers(0, 9, 7), chance.integers(0, 9, 7), 3

    def value(g: int) -> float:
        moves = rest.copy()
        moves[:, g] += before
        moves[g] += after
        moves[g, g] += twice
        return brown.likelihood(moves)

    best = max(range(1, 7), key=value)
    assert brown.best_class(rest, before, after, twice, 1 if best != 1 else 2) == best
    assert brown.best_class(rest, before, after, twice, best) == best


def test_nothing_to_learn_from(spark):
    held = [d for d in range(40) if not learns(d)]
    rows = [(d, "some words") for d in held]
    out, _ = brown.scored(frame(spark, rows), brown.teaches(F.col("doc_id")))
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in out.collect()] == [(3, 0, 0.0, pytest.approx(0))] * len(held)
    assert brown.language_report(frame(spark, [])).collect() == []


def test_same_on_every_run_and_layout(spark):
    rows = corpus(5, 80)
    one = brown.language_report(frame(spark, rows)).collect()
    two = brown.language_report(frame(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: tuple(x if not isinstance(x, float) else round(x, 6) for x in r)
    assert sorted(map(key, one), key=str) == sorted(map(key, two), key=str)
