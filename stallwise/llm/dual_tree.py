"""Vector codes by Lloyd's algorithm over two trees.

Components become integers, vectors are cut into parts of equal width, and every
part position has a codebook of a few entries.  A round gives each part the
nearest entry and moves each entry to the mean of its parts, rounded down.

The parts of some thousand rows form a forest, one tree per position: a node is a
box with the number and the sum of the parts in it.  It is built once and written
to the shared folder; every round and the last assignment read it.  The entries
of a position form a small tree of boxes too.  Both are walked together, a level
at a time: of a pair of nodes the least and greatest distance are known, and an
entry node that is farther from a part node than another surely is goes out.  A
part node that is left with one entry goes to it whole, by its stored sum;
leaves that stay uncertain compare their parts one by one.  Everything is integer
arithmetic, so ties and results are exact.

A round sends ``positions * entries`` sums to the driver, whatever the number of
rows, and gives as many entries to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm.folders import kept
from stallwise.operators.aggregates import with_group_totals

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Rows of one forest, and parts in a leaf at most.
FOREST = 2048
LEAF = 16
#: Components up to here have squared distances and sums within 64 bits.
LARGEST = 1 << 27

FOREST_FIELDS = "n int, width int, order binary, points binary, low binary, high binary, sums binary"


def usable(vector: Column) -> Column:
    """Not NULL, and no component NULL, NaN or infinite; an empty vector is usable."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """One row of ``width`` whole numbers per vector; shorter vectors are filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}: its squares would not fit into 64 bits")
    out = np.zeros((len(vectors), width), dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, column] = values
    return out


def levels(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Where the nodes of each level begin among ``n`` sorted places, halved until ``leaf`` remain, and the end."""
    out = [np.array([0, n])]
    while n and np.diff(out[-1]).max() > leaf:
        edges = out[-1]
        out.append(np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2])))
    return out


class Forest:
    """Trees over the parts of some rows, one per position, equal in shape; nodes are numbered level by level.

    ``order[p]`` lists the rows by place in the tree of position ``p``,
    ``points[p]`` their parts; ``low``, ``high`` and ``sums`` are per node.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums
        self.levels = levels(order.shape[1])

    @classmethod
    def built(cls, rows: np.ndarray, parts: int) -> Forest:
        n, width = len(rows), rows.shape[1] // parts
        points = np.ascontiguousarray(rows.reshape(n, parts, width).transpose(1, 0, 2))
        order = np.tile(np.arange(n), (parts, 1))
        shape = levels(n)
        tree = np.arange(parts)[:, None]
        boxes = []
        for k, edges in enumerate(shape):
            begin, count = edges[:-1], np.diff(edges)
            low = np.minimum.reduceat(points, begin, axis=1)
            high = np.maximum.reduceat(points, begin, axis=1)
            boxes.append((low, high, np.add.reduceat(points, begin, axis=1)))
            if k + 1 < len(shape) and width:
                widest = np.repeat((high - low).argmax(axis=2), count, axis=1)
                value = np.take_along_axis(points, widest[:, :, None], axis=2)[:, :, 0]
                node = np.repeat(np.arange(len(begin)), count)
                by_value = np.lexsort((value.ravel(), np.tile(node, parts), np.repeat(tree.ravel(), n))).reshape(parts, n)
                by_value -= tree * n
                order = np.take_along_axis(order, by_value, axis=1)
                points = np.take_along_axis(points, by_value[:, :, None], axis=1)
        low, high, sums = (np.concatenate([b[i] for b in boxes], axis=1) for i in range(3))
        return cls(order, points, low, high, sums)


class EntryTree:
    """The entries of one codebook as a tree of boxes: inner nodes are split at the middle of the widest component."""

    def __init__(self, entries: np.ndarray):
        self.low, self.high, self.left, self.right, self.entry = [], [], [], [], []
        self._grow(entries, np.arange(len(entries)))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.left, self.right, self.entry = np.array(self.left), np.array(self.right), np.array(self.entry)

    def _grow(self, entries: np.ndarray, own: np.ndarray) -> int:
        node = len(self.low)
        points = entries[own]
        self.low.append(points.min(axis=0))
        self.high.append(points.max(axis=0))
        self.left.append(-1)
        self.right.append(-1)
        self.entry.append(own[0] if len(own) == 1 else -1)
        if len(own) > 1:
            widest = int((self.high[node] - self.low[node]).argmax()) if points.shape[1] else 0
            by_value = own[np.argsort(points[:, widest], kind="stable")] if points.shape[1] else own
            half = len(own) // 2
            self.left[node] = self._grow(entries, by_value[:half])
            self.right[node] = self._grow(entries, by_value[half:])
        return node


def pair_bounds(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes."""
    gap = np.maximum(0, np.maximum(b_low - a_high, a_low - b_high))
    reach = np.maximum(b_high - a_low, a_high - b_low)
    return (gap * gap).sum(axis=-1), (reach * reach).sum(axis=-1)


def walk(forest: Forest, part: int, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Nodes of one tree with the entry that is nearest to all their parts, and uncertain (leaf, entry) pairs.

    Yields ``(nodes, entries, level)`` with level -1 for the uncertain pairs.
    """
    tree = EntryTree(entries)
    node, other = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    first = 0
    for level, edges in enumerate(forest.levels):
        # Entry nodes are opened as far as this level needs to tell them apart, then part nodes are halved.
        while True:
            low, high = forest.low[part, first + node], forest.high[part, first + node]
            least, most = pair_bounds(low, high, tree.low[other], tree.high[other])
            bound = np.full(len(edges) - 1, np.iinfo(np.int64).max)
            np.minimum.at(bound, node, most)
            near = least <= bound[node]
            node, other = node[near], other[near]
            open_ = tree.entry[other] < 0
            if not open_.any():
                break
            node = np.concatenate([node[~open_], node[open_], node[open_]])
            other = np.concatenate([other[~open_], tree.left[other[open_]], tree.right[other[open_]]])
        left = np.bincount(node, minlength=len(edges) - 1)
        sure = left[node] == 1
        yield node[sure], tree.entry[other[sure]], level
        node, other = node[~sure], other[~sure]
        if level + 1 == len(forest.levels):
            yield node, tree.entry[other], -1
            return
        below = forest.levels[level + 1]
        # A node of one place is not halved further: its level below holds it once.
        a = np.searchsorted(below, edges[node], "left")
        b = np.searchsorted(below, edges[node + 1], "left")
        n_below = b - a
        node = np.repeat(a, n_below) + np.arange(int(n_below.sum())) - np.repeat(np.cumsum(n_below) - n_below, n_below)
        other = np.repeat(other, n_below)
        first += len(edges) - 1


def settled(forest: Forest, part: int, node: np.ndarray, entry: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of uncertain leaves, the nearest of the leaf's entries for each (ties to the lower), and its distance."""
    edges = forest.levels[-1]
    by_leaf = np.lexsort((entry, node))
    node, entry = node[by_leaf], entry[by_leaf]
    count = (edges[1:] - edges[:-1])[node]
    pair = np.repeat(np.arange(len(node)), count)
    place = np.repeat(edges[node], count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    step = forest.points[part, place] - entries[entry[pair]]
    distance = (step * step).sum(axis=1)
    best = np.lexsort((entry[pair], distance, place))
    place, distance, found = place[best], distance[best], entry[pair][best]
    head = np.flatnonzero(np.diff(place, prepend=-1))
    return place[head], found[head], distance[head]


def tally(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the parts that are nearest to each entry: whole nodes by their stored sums."""
    counts = np.zeros(books.shape[:2], dtype=np.int64)
    sums = np.zeros_like(books)
    first = np.cumsum([0, *[len(e) - 1 for e in forest.levels]])
    for part, entries in enumerate(books):
        for node, entry, level in walk(forest, part, entries):
            if level >= 0:
                np.add.at(counts[part], entry, np.diff(forest.levels[level])[node])
                np.add.at(sums[part], entry, forest.sums[part, first[level] + node])
            elif len(node):
                place, found, _ = settled(forest, part, node, entry, entries)
                np.add.at(counts[part], found, 1)
                np.add.at(sums[part], found, forest.points[part, place])
    return counts, sums


def codes(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the entry of every part, and the sum of the squared distances."""
    parts, n = forest.order.shape
    code, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
    for part, entries in enumerate(books):
        own = np.zeros(n, dtype=np.int64)
        for node, entry, level in walk(forest, part, entries):
            if level >= 0:
                begin, count = forest.levels[level][node], np.diff(forest.levels[level])[node]
                place = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                own[place] = np.repeat(entry, count)
            elif len(node):
                place, found, _ = settled(forest, part, node, entry, entries)
                own[place] = found
        step = forest.points[part] - entries[own]
        code[forest.order[part], part] = own
        error[forest.order[part]] += (step * step).sum(axis=1)
    return code, error


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _forests(batches: Iterator[pa.RecordBatch], carried: int, parts: int) -> Iterator[tuple[Forest, pa.RecordBatch]]:
    """Forests from written rows; the columns after them hold the carried rows as one list."""
    for batch in batches:
        for k in range(batch.num_rows):
            n, width, *blobs = [batch.column(c)[k].as_py() for c in range(7)]
            order, points, low, high, sums = (np.frombuffer(b, dtype=np.int32 if i < 4 else np.int64) for i, b in enumerate(blobs))
            nodes = sum(len(e) - 1 for e in levels(n))
            shaped = lambda a, m: a.astype(np.int64).reshape(parts, m, width)
            yield (
                Forest(order.reshape(parts, n), shaped(points, n), shaped(low, nodes), shaped(high, nodes), shaped(sums, nodes)),
                batch.column(carried).slice(k, 1).flatten(),
            )


def planted(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """The forests of all rows (columns ``_row``, ``_vector``), written to the shared folder."""
    whole = rows.schema["_row"].dataType

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, FOREST):
                some = batch.slice(a, FOREST)
                f = Forest.built(integers(some.column(1), width, scale), parts)
                blobs = [f.order.astype(np.int32), *[x.astype(np.int32) for x in (f.points, f.low, f.high)], f.sums]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([some.num_rows], type=pa.int32()),
                        pa.array([width // parts], type=pa.int32()),
                        *[pa.array([_bytes(x)], type=pa.binary()) for x in blobs],
                        pa.ListArray.from_arrays(pa.array([0, some.num_rows], type=pa.int32()), some.column(0)),
                    ],
                    names=["n", "width", "order", "points", "low", "high", "sums", "rows"],
                )

    return kept(rows.mapInArrow(build, f"{FOREST_FIELDS}, rows array<{whole.simpleString()}>"), "forests")


def first_books(rows: DataFrame, key: str, width: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the rows with the smallest ids as codebooks: positions, entries, components.

    Rows without an id come last; equal ids in order of their vectors.
    """
    first = rows.orderBy(F.col(f"_row.{key}").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    vectors = pa.array([list(r[0]) for r in first], type=pa.list_(pa.float64()))
    return integers(vectors, width, scale).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def moved(forests: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry without parts stays."""
    shared = forests.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros_like(books)
        for forest, _ in _forests(batches, 7, parts):
            n, s = tally(forest, shared.value)
            counts += n
            sums += s
        slots = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots.astype(np.int32)),
                pa.array(counts.ravel()[slots]),
                pa.array(sums.reshape(parts * entries, width)[slots].tolist(), type=pa.list_(pa.int64())),
            ],
            names=["slot", "n", "sums"],
        )

    each = forests.mapInArrow(run, "slot int, n bigint, sums array<bigint>")
    # Decimals: sums over any number of rows are exact.
    total = [F.sum(F.col("sums")[w].cast("decimal(38,0)")).alias(f"s{w}") for w in range(width)]
    out = books.copy()
    for row in each.groupBy("slot").agg(F.sum("n").alias("n"), *total).collect():  # positions * entries rows
        out[row["slot"] // entries, row["slot"] % entries] = [int(row[f"s{w}"]) // row["n"] for w in range(width)]
    shared.unpersist()
    return out


def compressed(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Every usable row (``_row``) with ``code`` and ``error``, and the codebooks.

    Rows whose vector is NULL or holds a NULL, NaN or infinite component are
    dropped; all others stay, also repeated ones and those without an id.  Shorter
    vectors are filled up with zeros to the greatest length, rounded up to a
    multiple of ``parts``.  With fewer rows than ``entries`` the codebooks are
    smaller.  A component beyond ``LARGEST / scale`` is an error.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = vectors.select(F.struct("*").alias("_row"), F.col(f"`{vector}`").cast("array<double>").alias("_vector"))
    rows = rows.filter(usable(F.col("_vector")))
    longest = rows.agg(F.max(F.size("_vector"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    books = first_books(rows, key, width, parts, entries, scale)
    forests = planted(rows, width, parts, scale)
    if books.shape[1]:
        for _ in range(rounds):
            books = moved(forests, books)
    shared = forests.sparkSession.sparkContext.broadcast(books)
    schema = rows.select("_row").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest, own in _forests(batches, 7, parts):
            code, error = codes(forest, shared.value)
            text = code.tobytes().hex()
            digits = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [own, pa.array([text[i : i + digits] for i in range(0, len(text), digits)]), pa.array(error)], names=schema.names
            )

    return forests.mapInArrow(run, schema), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame) -> DataFrame:
    """Codes and errors of all rows, the error of all rows of the same label beside each."""
    rows, books = compressed(vectors)
    rows = rows.select("_row.vec_id", "_row.label", "code", "error")
    rows = with_group_totals(rows, ["label"], label_error=F.sum("error"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
