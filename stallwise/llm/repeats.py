"""Steps that both searches for repeated windows share.

A window is a run of ``length`` units (words or bytes) of one text.  Every window
holds an anchor: a shorter run at a chosen place.  An anchor serves a range of
windows, and what these span is its context.

1. Anchors are counted by hash, with the least and greatest hash of their context.
   Most occur once and are done with.  Where all contexts are equal, all windows
   served are repeated, and nothing has to be compared.
2. Documents with other repeated anchors are put aside with their text
   (compressed), and the caller compares the windows of these anchors.
3. What was found is brought back to the documents, and the bytes or words that
   are left make the result.

Frequent anchors are counted in the map tasks before the shuffle, and joined back
by a join that Spark can split.  Intermediate tables go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at
from stallwise.llm.folders import kept
from stallwise.operators.joins import spread_join

#: What lists of whole numbers hold for NULL, and the rank of a NULL id.
MISSING = -(1 << 63)
NULL_ID = MISSING + 1


@dataclass
class Anchors:
    """Anchors of some rows in order: row, number and place in the row, hash, context hash, and the windows served."""

    row: np.ndarray
    ordinal: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    context: np.ndarray
    first: np.ndarray
    last: np.ndarray


def numbered(rows: np.ndarray) -> np.ndarray:
    """The number of each entry within its row; rows come in ascending order."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows, "left")


def anchors_where(texts: at.Texts, wanted: np.ndarray, anchors: Callable[[at.Texts], Anchors]) -> Anchors:
    """The anchors of some of the rows only."""
    rows = np.flatnonzero(wanted)
    parts = [texts.data[texts.offsets[r] : texts.offsets[r + 1]] for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    found = anchors(at.Texts(texts.first, np.concatenate(parts) if parts else texts.data[:0], offsets))
    found.row = rows[found.row]
    return found


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``range_hashes`` gets the hash of any range."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = at._powers(size)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def range_hashes(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return at.mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, rank (NULL first), text, and a number for the row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumns(
        {"own": F.coalesce("doc_id", F.lit(NULL_ID)), "row_key": F.xxhash64("doc_id", "text")}
    )


def batches_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[at.Texts, list[pa.Array]]]:
    """Slices of the texts, each with the other columns."""
    for texts in at.slices(batch.column(column)):
        rest = [c.slice(texts.first, len(texts)) for k, c in enumerate(batch.columns) if k != column]
        yield texts, rest


def repeated_anchors(
    rows: DataFrame, anchors: Callable[[at.Texts], Anchors], places: Callable[[at.Texts], Anchors] | None = None
) -> DataFrame:
    """Per document with repeated anchors: their numbers, and the least rank where all contexts are equal.

    ``leasts`` holds NULL where contexts differ.  ``places`` may give the same
    anchors without their contexts.
    """
    of_places = places or anchors

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, (own,) in batches_of(batch, 0):
                a = anchors(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.as_long(a.hash)), pa.array(at.as_long(a.context)), own.take(pa.array(a.row))],
                    names=["hash", "context", "own"],
                )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, (keys,) in batches_of(batch, 0):
                a = of_places(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.as_long(a.hash)), keys.take(pa.array(a.row)), pa.array(a.ordinal.astype(np.int32))],
                    names=["hash", "row_key", "ordinal"],
                )

    groups = rows.select("text", "own").mapInArrow(counted, "hash bigint, context bigint, own bigint")
    groups = groups.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"), F.min("own").alias("least")
    )
    repeated = groups.filter(F.col("n") > 1).select("hash", F.when(F.col("a") == F.col("b"), F.col("least")).alias("least"))
    repeated = kept(repeated, "anchors")
    places = rows.select("text", "row_key").mapInArrow(placed, "hash bigint, row_key bigint, ordinal int")
    met = spread_join(places, repeated, "hash", "inner")
    return met.groupBy("row_key").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "least"))).alias("marks")
    ).select("row_key", F.col("marks.ordinal").alias("ordinals"), F.col("marks.least").alias("leasts"))


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Every document with its marks, if it has some."""
    return spread_join(rows, marks, "row_key", "left")


def pack(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def packed(texts: at.Texts, wanted: np.ndarray) -> list[bytes | None]:
    """The wanted texts, packed; None for the others."""
    writer = zstandard.ZstdCompressor(level=1)
    return [writer.compress(texts.text(r)) if w else None for r, w in enumerate(wanted.tolist())]


def unpacked(batch: pa.RecordBatch, column: int, limit: int = at.SLICE_BYTES) -> Iterator[tuple[at.Texts, list[pa.Array]]]:
    """Slices of packed texts, each with the other columns; ``limit`` bytes, or one longer text, are unpacked at a time."""
    reader = zstandard.ZstdDecompressor()
    stored = batch.column(column).to_pylist()
    first, size, texts = 0, 0, []
    for k, text in enumerate(stored):
        length = zstandard.frame_content_size(text)
        if texts and size + length > limit:
            part = batch.slice(first, k - first)
            yield from batches_of(part.set_column(column, "text", pa.array(texts, type=pa.large_string())), column)
            first, size, texts = k, 0, []
        texts.append(reader.decompress(text).decode("utf-8"))
        size += length
    if texts:
        part = batch.slice(first)
        yield from batches_of(part.set_column(column, "text", pa.array(texts, type=pa.large_string())), column)


def lists(column: pa.Array) -> list[np.ndarray]:
    """A column of lists of whole numbers; NULL is empty, NULL items are ``MISSING``."""
    bounds = column.offsets.to_numpy()
    # A slice of a column still has the items of all of it.
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0]).cast(pa.int64()).fill_null(MISSING).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    none = values[:0]
    bounds = (bounds - bounds[0]).tolist()
    return [values[a:b] if v else none for a, b, v in zip(bounds[:-1], bounds[1:], valid, strict=True)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of lists of whole numbers in one array of its own, and the row of each; NULL items are ``MISSING``."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.int64()).fill_null(MISSING).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), values.copy()


def listed(values: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A column of lists from their items one after the other; NULL where not ``valid``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=pa.array(~valid))
