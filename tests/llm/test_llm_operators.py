"""Each operator against a plain version, on odd rows and on random ones."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

from stallwise.llm import (  # noqa: E402
    arrowtext,
    components,
    cover,
    decontamination,
    mixing,
    pii,
    quality,
    secret_scan,
    suffix,
    tokens,
    topk,
    trie,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, _row string, score double, items string"


def prose(chance: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{chance.randrange(vocabulary):03d}{'.' if chance.random() < 0.1 else ''}" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, periodic and odd texts."""
    chance = random.Random(seed)
    passage = prose(chance, 50)
    docs: list[str | None] = [None, "", "  \n\t ", "one", "One", "two words", "é" * 300, "ab" * 400, ("same word " * 90).strip()]
    base = [prose(chance, chance.choice([3, 40, 120, 300])) for _ in range(25)]
    docs += base + base[:8]
    for text in base[:14] * 2:
        words = text.split(" ")
        for _ in range(max(1, len(words) // chance.choice([20, 60, 150]))):
            words[chance.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    docs += [f"{prose(chance, 30)} {passage} {prose(chance, 20)}" for _ in range(6)]
    docs.append(f"{passage}\n{passage} {passage[:200]}")
    docs.append(" ".join(base[k] for k in range(12)) + "x" * 5000)
    docs += ["Ünïcode straße " + passage.upper(), "日本語 " * 60 + passage]
    chance.shuffle(docs)
    return list(enumerate(docs))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, None, f"s{i % 4}" if i % 5 else None, None, 7, "r", 0.5, "x") for i, t in rows], DOCS)
    return rows, df.repartition(3)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def empty(spark, schema: str = DOCS):
    return spark.createDataFrame([], schema)


def test_shingle_components(docs):
    rows, df = docs
    assert rows_of(trie.linked_documents(df)) == brute.linked(rows)


def test_shingle_components_of_many_near_copies(spark):
    chance = random.Random(3)
    base = prose(chance, 90)
    rows = []
    for i in range(150):
        words = base.split(" ")
        for _ in range(chance.choice([0, 1, 1, 2, 3])):
            words[chance.randrange(len(words))] = f"edit{chance.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(chance, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(trie.linked_documents(df)) == brute.linked(rows)


def test_shingle_components_with_repeated_and_missing_ids(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "A B C D E"), (None, "q r s t"), (7, "q r s t"), (None, "z z"), (5, "other text here now"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(trie.linked_documents(df)) == brute.linked(rows)
    left = sorted(tuple(r) for r in trie.one_of_each(df).select(F.coalesce("doc_id", F.lit(-1)), "text").fillna("").collect())
    assert left == [(-1, "z z"), (5, "a b c d e"), (5, "other text here now"), (7, "q r s t"), (9, "")]


def test_lone_texts_with_a_common_passage_take_one_round(spark, monkeypatch):
    chance = random.Random(5)
    passage = " ".join(f"line{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(10))) for i in range(150)]
    base = prose(chance, 80)
    rows += [(200 + i, f"{base} end{i}") for i in range(6)]
    calls, plain = [], trie.verified
    monkeypatch.setattr(trie, "verified", lambda *args: calls.append(1) or plain(*args))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(trie.linked_documents(df)) == brute.linked(rows)
    assert len(calls) <= 2


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_candidates_by_band_are_all_that_sizes_allow(spark, percent):
    chance = random.Random(percent)
    rows = []
    for node in range(160):
        n = chance.choice([1, 2, 3, 7, 19, 20, 21, 40, chance.randrange(1, 400)])
        rows.append((chance.randrange(3), node, n, chance.randrange(n - -(-percent * n // 100) + 1), chance.randrange(20)))
    entries = spark.createDataFrame(rows, "gram bigint, node bigint, n bigint, before bigint, label bigint")
    join = trie.Join.__new__(trie.Join)
    join.percent = percent
    wanted = [
        (a, b)
        for g, a, n, i, x in rows
        for h, b, m, j, y in rows
        if g == h and x != y and min(n - i, m - j) >= -(-percent * (n + m) // (100 + percent))
    ]
    assert sorted(tuple(r) for r in join.candidates(entries, entries).collect()) == sorted(wanted) and wanted
    everything = sum(g == h for g, *_ in rows for h, *_ in rows)
    assert len(wanted) <= join.possible(entries, entries) < everything
    assert join.possible(entries.limit(0), entries) == 0


def test_walk_finds_what_comparing_each_finds():
    chance = random.Random(8)
    base = [chance.randrange(10**6) for _ in range(60)]
    sets = []
    for _ in range(80):
        own = set(base[: chance.randrange(30, 60)]) | {chance.randrange(10**6) for _ in range(chance.randrange(12))}
        sets.append(np.array(sorted(own), dtype=np.uint64))
    probe = np.array(sorted(set(base[:50])), dtype=np.uint64)
    wanted = [100 * len(np.intersect1d(probe, s)) >= 85 * len(np.union1d(probe, s)) for s in sets]
    assert trie.walk(probe, sets, 85) == wanted and any(wanted) and not all(wanted)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 120)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    least = {i: 10 for i in range(11, 41)} | {i: 3 for i in range(100, 140)}
    assert {r["node"]: r["label"] for r in found.collect()} == least


def vectors(seed: int = 2) -> list[tuple]:
    chance = random.Random(seed)
    rows: list[tuple] = [(i, [round(chance.uniform(-1, 1), 2) for _ in range(6)]) for i in range(160)]
    rows += [(i, [0.5] * 6) for i in range(200, 260)]
    rows += [(300, None), (350, []), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (500, [float("inf")] * 6)]
    return rows + [(550, [1.0, 2.0]), (551, [3.0, 1.0]), (None, [0.1] * 6)]


@pytest.mark.parametrize("block", [1, 4096])
def test_top_k(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    assert sorted(rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, block=block))) == brute.nearest(rows)


def test_top_k_of_large_components_is_exact(spark):
    chance = random.Random(4)
    rows = [(i, [float(chance.randrange(-(10**5), 10**5)) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert sorted(rows_of(topk.search_report(df))) == brute.nearest(rows)


ITEMS = [(1, "w001 w002 w003"), (2, None), (3, ""), (None, "one"), (4, "One"), (4, "two, words!"), (4, "two, words!")]


@pytest.mark.parametrize("block", [60, 10**6])
def test_contamination(spark, docs, block):
    rows, df = docs
    chance = random.Random(1)
    items = ITEMS + [(10, prose(chance, 50)), (11, rows[20][1]), (12, "Ünïcode straße")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contamination(df, benchmark, ["doc_id"], block_bytes=block)
    judged = decontamination.judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), "contaminated"
    )
    assert rows_of(judged) == brute.contamination(rows, items)


def test_contamination_keeps_repeated_rows_and_needs_no_items(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one"), (2, "two")], "item_id bigint, text string")
    assert [r["n_hit"] for r in decontamination.judged(decontamination.contamination(df, items, block_bytes=3)).collect() if r["doc_id"]] == [2, 2]
    assert decontamination.contamination_report(df, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("crowded", [1, 3000])
def test_repeated_bytes(spark, docs, crowded, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    assert rows_of(suffix.duplicate_bytes(df)) == brute.cut_bytes(rows)


def test_radix_sort_of_suffixes_finds_equal_strings():
    chance = np.random.default_rng(6)
    raw = chance.integers(97, 99, 3000).astype(np.uint8)
    begin = np.arange(len(raw) - 40)
    alive, group = suffix.equal_suffixes(np.zeros(len(begin), dtype=np.int64), raw, begin, 12)
    strings = [raw[b : b + 12].tobytes() for b in begin]
    repeated = {b for b in begin if strings.count(strings[b]) > 1}
    assert set(alive.tolist()) == repeated
    for g in np.unique(group):
        assert len({strings[b] for b in alive[group == g]}) == 1


def test_long_texts_are_cut_into_blocks_alike(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 256)
    chance = random.Random(12)
    shared = prose(chance, 300)
    rows = [(1, prose(chance, 50) + shared), (2, prose(chance, 77) + shared + prose(chance, 9))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    # One text per slice, as beyond a megabyte.
    monkeypatch.setattr(arrowtext.slices, "__defaults__", (1,))
    assert rows_of(suffix.duplicate_bytes(df)) == brute.cut_bytes(rows)


def test_repeated_words(docs):
    rows, df = docs
    assert rows_of(cover.duplicate_words(df)) == brute.cut_words(rows)


def test_repeated_rows_lose_every_window(spark):
    text = prose(random.Random(9), 60)
    rows = [(1, text), (1, text), (None, prose(random.Random(10), 60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(cover.duplicate_words(df)) == brute.cut_words(rows)


def test_cover_meets_at_every_distance():
    members = np.flatnonzero(cover.COVER)
    assert {(a - b) % cover.PERIOD for a in members for b in members} == set(range(cover.PERIOD))


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_report(documents, labels).join(labels, "doc_id").filter("held_out").cache()
    assert rows.filter(F.col("quality") == F.col("predicted")).count() >= 0.99 * rows.count()
    assert rows.filter("quality = 1 and predicted = 0").count() <= 0.005 * rows.count()


def test_quality_of_odd_rows(spark, docs):
    _, df = docs
    none = empty(spark, "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.quality_report(df, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id bigint, quality int")
    rows = quality.quality_report(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_token_files_round_trip(spark, docs, tmp_path):
    rows, df = docs
    path = str(tmp_path / "tokens")
    tokens.write_tokens(df, path)
    encoder = tokens.encoder("word_bpe_49k.json").tokenizer
    start, wanted = 0, []
    for doc, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tokens.token_report(spark, path).collect()) == wanted
    one = tokens.read_tokens(spark, path).filter("doc_id = 20").collect()
    assert [*encoder.encode(rows[20][1] or "", add_special_tokens=False).ids, 1] == one[0]["ids"]


def test_token_files_of_repeated_and_missing_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (1, None)], "doc_id bigint, text string")
    tokens.write_tokens(df, str(tmp_path / "t"))
    rows = tokens.token_report(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [(r["doc_id"], r["start"]) for r in rows] == [(None, 0), (1, 2), (2, 3), (2, 5)]


def test_encoding_piecewise_equals_encoding_whole():
    encoder = tokens.Encoder("word_bpe_49k.json")
    chance = random.Random(5)
    letters = "abcxyzABCÉéßÄöçœŁšǅİıű'.,!?-0159_@#日"
    texts = [" ".join("".join(chance.choices(letters, k=chance.randint(1, 9))) for _ in range(30)) for _ in range(120)]
    texts += ["H̱ḏ K̂ it's 'sup.. <|endoftext|>.x 3., x'll", " a b\x1fc.\x85 ", ".,., ,", ""]
    found = []
    for part in arrowtext.slices(pa.array(texts), 700):
        flat, counts = encoder.encode(part)
        found += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert found == [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


PERSONAL = [
    "a@b.c@d.e, x.y+z@mail-1.example.com. @no.one me@ at@x 1.2.3.4.5 999.1.1.1 01.002.3.4",
    "4539 1488 0343 6467 and 4539148803436468, +1 (811) 555-3281 +12 +1 2 3 4 5 6 7 8 9 0",
    "1" * 5000 + "." + "2" * 300 + "." * 40 + "+" + "5 " * 2000,
    "a" * 20000 + "@" + "b" * 10,
    "日本 me@example.org 192.168.0.1",
    None,
    "",
]


def test_base_personal_data():
    for text in PERSONAL:
        base, everything = pii.found(text or "")
        assert pii.written(base) == brute.personal(text)
        assert set(base) <= set(everything)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("é mail jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("ip １９２.１６８.1.7 x", "ip", "１９２.１６８.1.7"),
        ("to jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call plus one two oh two five five five oh one two three now", "phone", "plus one two oh two five five five oh one two three"),
        ("card four one one one one one one one one one one one one one one one ok", "card", " ".join(["four"] + ["one"] * 15)),
    ],
)
def test_disguises_are_mapped_back(text, kind, part):
    _, spans = pii.found(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, part)]


def test_clean_prose_has_no_disguised_data():
    for text in ("we met at dot com times; one two three", "one (two) at (noon) dot", "Ёлка и дом", "call me at home. dot dot dot"):
        assert pii.found(text) == ([], [])


def test_pii_report(spark, docs):
    rows, df = docs
    assert pii.pii_report(df).count() == len(rows)
    one = spark.createDataFrame([(1, PERSONAL[0], "x")], "doc_id bigint, text string, base string")
    assert pii.pii_report(one).first()["n_email"] == 2


def test_forest_on_held_out_findings(spark):
    chance = random.Random(0)
    rows = [(i, prose(chance, 80)) for i in range(400)]
    forest, pairs = secret_scan.trained(spark.createDataFrame(rows, "doc_id bigint, text string"))
    right = total = 0
    for k in range(400, 900):
        for text, finding, label in secret_scan.planted(prose(chance, 60), random.Random(k)):
            right += (forest.score(secret_scan.features(text, finding, pairs)) >= 0.5) == bool(label)
            total += 1
    assert total > 900 and right >= 0.97 * total


def test_secret_report(spark, docs):
    rows, df = docs
    assert secret_scan.secret_report(df).count() == len(rows)
    text = 'so token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and password: changeme-test-1'
    more = df.select("doc_id", "text").unionAll(spark.createDataFrame([(999, text)], "doc_id bigint, text string"))
    found = secret_scan.secret_report(more).filter("doc_id = 999").first()
    assert (found["n_candidates"], found["n_secrets"]) == (2, 1) and text[12:52] in text and found["spans"] == "assigned:12:52"


def test_mix_meets_its_targets(spark):
    chance = random.Random(11)
    rows = [(i, prose(chance, chance.randrange(60)), chance.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    df = spark.createDataFrame(rows + [(None, "x y", "a"), (None, None, "a"), (7, "", "z")], "doc_id bigint, text string, source string")
    mixed = mixing.mix_report(df).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    sums: dict[tuple, int] = {}
    for r in mixed:
        key = (r["source_size"], r["target"])
        sums[key] = sums.get(key, 0) + r["taken"]
    assert all(abs(target - taken) <= 1 and target <= 3 * size for (size, target), taken in sums.items())
    assert abs(sum(sums.values()) - sum(r["size"] for r in mixed)) <= 5
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
    whole = mixing.copies(mixing.mixed(df), df.columns)
    assert whole.columns == df.columns
    assert whole.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r["taken"] for r in mixed)


def test_mix_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, "q")], "doc_id bigint, text string, source string, size int, _source string")
    row = mixing.mixed(df).first()
    assert (row["size"], row["_source"], row["target"]) == (2, "q", 2.0)


def test_empty_tables(spark, tmp_path):
    none = empty(spark)
    labels = empty(spark, "doc_id bigint, quality int, toxic int")
    items = empty(spark, "item_id bigint, text string")
    tokens.write_tokens(none, str(tmp_path / "none"))
    for df in (
        trie.linked_documents(none),
        trie.one_of_each(none),
        topk.search_report(empty(spark, "vec_id bigint, embedding array<float>, label int")),
        decontamination.contamination_report(none, items),
        suffix.duplicate_bytes(none),
        quality.quality_report(none, labels),
        tokens.token_report(spark, str(tmp_path / "none")),
        pii.pii_report(none),
        secret_scan.secret_report(none),
        mixing.mix_report(none),
        cover.duplicate_words(none),
    ):
        assert df.collect() == []
