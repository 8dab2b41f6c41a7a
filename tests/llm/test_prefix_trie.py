"""Nodes of the conversation trie against plain sets of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from stallwise.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, words int"


def nodes(paths: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members = defaultdict(list)
    for conv_id, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv_id)
    children, below = defaultdict(int), defaultdict(lambda: [0, 0])
    for prefix in members:
        if prefix:
            children[prefix[:-1]] += 1
    for prefix, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        for d in range(len(prefix) + 1):
            below[prefix[:d]][0] += not children[prefix]
            below[prefix[:d]][1] += (len(own) - 1) * words
    rows = []
    for prefix, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(own), len(prefix), parent, len(own), children[prefix], *below[prefix], digest))
    return sorted(rows, key=str)


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    def digest(r: tuple) -> str:
        return hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32]

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def conversations(seed: int, n: int) -> list[tuple]:
    chance = random.Random(seed)
    says = [" ".join("word" for _ in range(chance.randrange(6))) + f" {k % 7}" for k in range(20)]
    common = [("user", "hello there friend"), ("assistant", "how can I help"), ("user", "thanks")]
    rows = []
    for c in range(n):
        turns = [(chance.choice(["user", "assistant"]), chance.choice(says)) for _ in range(chance.randrange(5))]
        if c % 3 == 0:  # a third are equal, others share their beginning
            turns = common + (turns if c % 2 else [])
        rows += [(c, t, role, text) for t, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_nodes(spark, partitions):
    rows = conversations(int(partitions), 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(prefix_trie.prefix_report(frame(spark, rows))) == nodes(rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pieces_and_a_small_skeleton(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    monkeypatch.setattr(prefix_trie, "SKELETON", 5)
    rows = conversations(9, 200)
    assert found(prefix_trie.prefix_report(frame(spark, rows))) == nodes(rebuilt(rows))


def test_odd_rows(spark):
    long = "ab c " * 50_000
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 20, 21) for t in range(30)]  # one beginning
    rows += [(None, 0, "user", "nobody"), (40, None, None, None), (40, 1, None, ""), (40, 1, "", None), (41, 0, "user", "a b")]
    rows += [(42, None, "user", "null first"), (42, -5, "user", "second"), (-7, 0, "user", "x"), (-20, 0, "user", "base")]
    rows += [(43, 0, "user", long), (63, 0, "user", long), (63, 0, "user", long), (44, 0, "use", "rx"), (45, 0, "user", "x")]
    rows += [(46, 3, "b", "tie"), (46, 3, "a", "tie")]
    assert found(prefix_trie.prefix_report(frame(spark, rows))) == nodes(rebuilt(rows))


def test_conversations_without_turns_are_members_of_the_root(spark):
    # 1 and 3 lose their only turn, and their base is absent.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 5, 6, 7)]
    paths = rebuilt(rows)
    assert any(not p for p in paths.values())
    assert found(prefix_trie.prefix_report(frame(spark, rows))) == nodes(paths)


def test_no_conversations(spark):
    assert found(prefix_trie.prefix_report(frame(spark, []))) == []
    assert found(prefix_trie.prefix_report(frame(spark, [(None, 1, "user", "x")]))) == []


def test_plain_paths(spark):
    rows = [(1, 0, "u", "a b"), (1, 1, "v", "c"), (2, 0, "u", "a b")]
    paths = prefix_trie.plain_paths(frame(spark, rows))
    expected = nodes({1: [("u", "a b"), ("v", "c")], 2: [("u", "a b")]})
    assert found(prefix_trie.prefix_nodes(spark, paths)) == expected
