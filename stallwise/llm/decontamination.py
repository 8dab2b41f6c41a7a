"""Find benchmark passages in documents by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of an item; an item of
fewer words is one pattern.  A cursor stands on a possible window of a text and
looks up the block of its last two words in a shift table: the least distance
from that block to the end of a pattern, so most cursors skip nearly a window.
Where the distance is 0, the pair of last and first block selects a bucket of
patterns, and only those are compared, word by word and then byte by byte.
All cursors of a slice of texts move in lockstep.

Patterns are held for a block of the benchmark of at most ``BLOCK_BYTES`` of
text at a time, whatever the size of the benchmark: each further block is one
more pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.llm import arrowtext as at

WINDOW = 13
BLOCK_BYTES = 2_000_000
#: Cursors: windows per segment of a text.
SEGMENT = 512
TABLE_BITS = 20
#: A document is contaminated if 20 times its hit words reach its words.
SHARE = 20


class Patterns:
    """Shift table and buckets of patterns of one length."""

    def __init__(self, length: int, found: dict[bytes, set[str]]):
        self.length = length
        self.block = min(2, length)
        self.texts = list(found)
        self.items = [sorted(found[text]) for text in self.texts]
        hashes = np.array([self._hashes(text) for text in self.texts], dtype=np.uint64).reshape(-1, length)
        blocks = np.stack([self.blocks(row) for row in hashes])
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, dtype=np.int32)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, self.slot(blocks[:, j]), blocks.shape[1] - 1 - j)
        keys = at.join_hashes(blocks[:, -1], blocks[:, 0])
        order = np.argsort(keys, kind="stable")
        self.keys, self.hashes, self.order = keys[order], hashes[order], order

    @staticmethod
    def _hashes(text: bytes) -> np.ndarray:
        found = text.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = ends - [len(w) for w in found]
        return at.span_hashes(np.frombuffer(text, dtype=np.uint8), starts, ends)

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        return at.grams(hashes, self.block)

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def candidates(self, blocks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First words of the windows where the shift table can't exclude a pattern."""
        m, last = self.length, self.length - self.block
        first, stop = offsets[:-1], offsets[1:] - m + 1
        first, stop = first[stop > first], stop[stop > first]
        pieces = -(-(stop - first) // SEGMENT)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at_word = np.repeat(first, pieces) + nth * SEGMENT
        stop = np.minimum(at_word + SEGMENT, np.repeat(stop, pieces))
        slots, found = self.slot(blocks), []
        while len(at_word):
            jump = self.shift[slots[at_word + last]]
            found.append(at_word[jump == 0])
            at_word = at_word + np.maximum(jump, 1)
            inside = at_word < stop
            at_word, stop = at_word[inside], stop[inside]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def occurrences(self, data: np.ndarray, words: at.Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of a first word and a pattern that stands there."""
        if len(hashes) < self.length:
            return
        blocks = self.blocks(hashes)
        places = self.candidates(blocks, words.offsets)
        keys = at.join_hashes(blocks[places + self.length - self.block], blocks[places])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for place, a, b in zip(places[high > low], low[high > low], high[high > low], strict=True):
            window = hashes[place : place + self.length]
            for k in range(a, b):
                if np.array_equal(self.hashes[k], window):
                    spans = zip(words.start[place : place + self.length], words.end[place : place + self.length], strict=True)
                    pattern = int(self.order[k])
                    if b" ".join(data[s:e].tobytes() for s, e in spans) == self.texts[pattern]:
                        yield int(place), pattern


def patterns_of(items: Iterable[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """Patterns by length, from pairs of item id and text."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        for texts in at.slices(pa.array([text], type=pa.string())):
            data = at.LOWER[texts.data]
            w = at.words(texts, at.ALNUM, data)
            own = [data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
            length = min(window, len(own))
            for k in range(len(own) - length + 1 if own else 0):
                found.setdefault(length, {}).setdefault(b" ".join(own[k : k + length]), set()).add(item)
    return [Patterns(length, found[length]) for length in sorted(found)]


def search(texts: at.Texts, patterns: list[Patterns]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Words per row; ranges of hit words and items by row, for rows that have some."""
    data = at.LOWER[texts.data]
    words = at.words(texts, at.ALNUM, data)
    hashes = at.span_hashes(data, words.start, words.end)
    ranges: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for group in patterns:
        for place, k in group.occurrences(data, words, hashes):
            row = int(words.row[place])
            begin = place - int(words.offsets[row])
            mine = ranges.setdefault(row, [])
            if mine and mine[-1][0] <= begin <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(mine[-1][1], begin + group.length))
            else:
                mine.append((begin, begin + group.length))
            items.setdefault(row, set()).update(group.items[k])
    return words.counts(), ranges, items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_from", T.ArrayType(T.LongType())),
        T.StructField("hit_to", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(docs: DataFrame, columns: list[str], text: str, patterns: list[Patterns], all_rows: bool) -> DataFrame:
    """``columns`` of the rows with what one block of patterns finds; without ``all_rows``, of rows with hits."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    schema = T.StructType([docs.schema[c] for c in columns] + FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(columns))
            for texts in at.slices(column):
                counts, ranges, items = search(texts, shared.value)
                rows = range(len(texts)) if all_rows else sorted(ranges)
                spans = [merged(ranges.get(r, ())) for r in rows]
                carried = [c.slice(texts.first, len(texts)).take(pa.array(rows, type=pa.int64())) for c in batch.columns[: len(columns)]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *carried,
                        pa.array(counts[list(rows)], type=pa.int64()),
                        pa.array([[a for a, _ in s] for s in spans], type=pa.list_(pa.int64())),
                        pa.array([[b for _, b in s] for s in spans], type=pa.list_(pa.int64())),
                        pa.array([sorted(items.get(r, ())) for r in rows], type=pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text)).mapInArrow(run, schema)


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``block_bytes``; the driver holds one block at a time."""
    wanted = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    wanted = wanted.filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes)
    for k in range(n):
        block = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in block.distinct().collect()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    columns: list[str] | None = None,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``columns`` of every document with ``n_words``, ``hit_from``, ``hit_to`` and ``items``.

    Words are lower-cased in A-Z.  ``hit_from`` and ``hit_to`` list maximal
    ranges of hit words, from 0, end exclusive; ``items`` the ids (as strings,
    sorted) of items with an occurring window.  NULL and empty texts have no
    words; items with a NULL id or without words match nothing; an item given
    twice, even with two texts, is one id.  Repeated documents are kept as they
    are.  An empty benchmark hits nothing.
    """
    columns = docs.columns if columns is None else columns
    # What is carried need not tell rows apart, so their findings are put together by the text too.
    same_text = F.struct(F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), same_text.alias("_key"), F.col(text).alias("_text"))
    blocks = benchmark_blocks(benchmark, item, item_text, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs, columns, text, patterns_of(first, window), True)
    found = [
        _scan(keyed, ["_row", "_key"], "_text", patterns_of(block, window), k == 0)
        for k, block in enumerate(chain([first, second], blocks))
    ]
    return _united(found)


def _united(found: list[DataFrame]) -> DataFrame:
    """The findings of several blocks put together by row; only rows with hits come from the later ones."""
    parts = [
        df.select(
            "_row", "_key", "n_words", F.lit(1 if k == 0 else 0).alias("_times"),
            F.arrays_zip("hit_from", "hit_to").alias("_hits"), "items",
        )
        for k, df in enumerate(found)
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    together = together.groupBy("_row", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("_times").alias("_times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits")))).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    grown = F.aggregate(
        "_hits",
        F.expr("cast(array() as array<struct<hit_from:bigint,hit_to:bigint>>)"),
        lambda out, h: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["hit_to"] >= h["hit_from"]),
            F.concat(
                F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["hit_from"].alias("hit_from"),
                        F.greatest(F.element_at(out, -1)["hit_to"], h["hit_to"]).alias("hit_to"),
                    )
                ),
            ),
        ).otherwise(F.concat(out, F.array(h))),
    )
    return (
        together.withColumn("_hits", grown)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        .select(
            "_row.*", "n_words", F.col("_hits.hit_from").alias("hit_from"), F.col("_hits.hit_to").alias("hit_to"), "items"
        )
    )


def judged(found: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``."""
    n_hit = F.aggregate(
        F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("long"), lambda total, n: total + n
    )
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: hit words, items with occurring windows, and the verdict."""
    found = judged(contamination(docs, benchmark, ["doc_id"]))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
