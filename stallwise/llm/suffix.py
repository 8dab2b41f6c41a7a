"""Remove bytes of repeated strings by a depth-limited radix sort of suffixes.

Only suffixes that can be equal through ``length`` bytes are sorted.  Each window
of that length holds an anchor: of its runs of ``RUN`` bytes the one whose first
eight have the least hash, the leftmost of equals.  So equal windows have equal anchors at equal
places, and suffixes whose anchor occurs once, or whose whole surroundings are
the same wherever it occurs, are decided by counting anchors.

The suffixes around the remaining anchors are sorted most significant digit
first: the anchor and the distance to it are the first digits, by which they are
spread over the tasks, and then eight bytes at a time up to the length, dropping
what stands alone after each pass.  Groups that are left are the repeated
windows.  An anchor with more than ``CROWDED`` different surroundings is not
gathered in a task; its windows are counted by hash instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at
from stallwise.llm import repeats
from stallwise.llm.folders import kept
from stallwise.operators.joins import spread_join

LENGTH = 100
RUN = 32
#: Places that are looked at together, so that what is held for each stays in a core's cache.
BLOCK = 1 << 15
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Different surroundings of an anchor that a task may hold, and those sorted together.
CROWDED = 3000
TOGETHER = 8000


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, read as a number."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def anchor_places(data: np.ndarray, length: int) -> np.ndarray:
    """The anchor of the window that begins at each place; texts are not told apart."""
    serve, n = length - RUN + 1, max(0, len(data) - length + 1)
    block = max(BLOCK, length)
    # A run and its place within the block share a number, so that the least of a window is its leftmost least run.
    bits = (block + serve).bit_length()
    kind = np.uint32 if bits <= 16 else np.uint64
    low_bits = kind((1 << bits) - 1)
    numbers = np.arange(block + serve, dtype=kind)
    out = np.empty(n, dtype=np.int64)
    for low in range(0, n, block):
        part = data[low : low + block + length - 1]
        # A run is chosen by its first eight bytes.
        least = words_at(part)[: len(part) - RUN + 1] * _SPREAD
        if kind is np.uint32:
            least = (least >> np.uint64(32)).astype(kind)
        least &= ~low_bits
        least |= numbers[: len(least)]
        done = 1
        while done < serve:
            step = min(done, serve - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        np.add(least & low_bits, low, out=out[low : low + block], casting="unsafe")
    return out


def run_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the run at each place."""
    words = words_at(data)
    out = words[place]
    for k in range(8, RUN, 8):
        out = at.join_hashes(out, words[place + k])
    return out


def context_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes of each context; contexts come in ascending order and are shorter than two windows."""
    out = np.empty(len(first), dtype=np.uint64)
    block = max(BLOCK, length)
    cuts = np.searchsorted(first, np.arange(0, len(data) + block, block))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        low = k * block
        prefix = repeats.prefix_hashes(at._BYTE[data[low : low + block + 2 * length]])
        out[a:b] = repeats.range_hashes(prefix, first[a:b] - low, stop[a:b] - low)
    return out


def byte_anchors(texts: at.Texts, length: int = LENGTH, contexts: bool = True) -> repeats.Anchors:
    """The anchors of some texts; without ``contexts``, these are not hashed and all 0."""
    edges, data = texts.offsets, texts.data
    # No window begins in the last bytes of a text.
    rows = np.flatnonzero(np.diff(edges) >= length)
    begin, stop = edges[rows], edges[rows + 1] - length + 1
    if not len(rows):
        none = np.zeros(0, dtype=np.int64)
        return repeats.Anchors(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    places = anchor_places(data, length)
    new = np.ones(len(places), dtype=bool)
    np.not_equal(places[1:], places[:-1], out=new[1:])
    new[begin] = True
    first = np.flatnonzero(new)
    k = np.searchsorted(begin, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(places)), stop[k]) - 1
    used = (k >= 0) & (first <= last)
    k, first, last = k[used], first[used], last[used]
    place, row = places[first], rows[k]
    if contexts:
        context = context_hashes(data, first, last + length, length)
        context = at.join_hashes(context, ((place - first) * length + (last - first)).astype(np.uint64))
    else:
        context = np.zeros(len(first), dtype=np.uint64)
    low = edges[row]
    return repeats.Anchors(row, repeats.numbered(row), place - low, run_hashes(data, place), context, first - low, last - low)


def digits(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as one number, most significant first."""
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    out = np.zeros(len(raw), dtype=np.uint64)
    for k in range(8):
        out |= padded[k : k + len(raw)] << np.uint64(8 * (7 - k))
    return out


def equal_suffixes(first_digit: np.ndarray, raw: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort of the strings that begin at ``begin``: those with equals, and the group of each."""
    number = digits(raw)
    alive = np.argsort(first_digit, kind="stable")
    digit = first_digit[alive]
    new = np.ones(len(alive), dtype=bool)
    new[1:] = digit[1:] != digit[:-1]
    for depth in [*range(0, length - 8, 8), length - 8]:
        group = np.cumsum(new) - 1
        digit = number[begin[alive] + depth]
        differs = np.zeros(len(alive), dtype=bool)
        differs[1:] = ~new[1:] & (digit[1:] != digit[:-1])
        # A group with one digit throughout is in order.
        mixed = np.zeros(len(alive), dtype=bool)
        mixed[group[differs]] = True
        moved = np.flatnonzero(mixed[group])
        order = moved[np.lexsort((digit[moved], group[moved]))]
        alive[moved], digit[moved] = alive[order], digit[order]
        new[1:] |= digit[1:] != digit[:-1]
        several = ~(new & np.append(new[1:], True))
        alive, new = alive[several], new[several]
        if not len(alive):
            break
    return alive, np.cumsum(new) - 1


def settle(contexts: pa.Table, length: int) -> pa.RecordBatch:
    """The least rank of every window of some contexts, in runs; contexts of an anchor come together."""
    texts = next(at.slices(contexts.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()), 1 << 40))
    back, least = contexts.column("back").to_numpy(), contexts.column("least").to_numpy()
    anchor, n = contexts.column("hash").to_numpy(), contexts.column("n").to_numpy()
    served = np.diff(texts.offsets) - length + 1
    row = np.repeat(np.arange(len(served)), served)
    place = np.arange(len(row)) - np.repeat(np.cumsum(served) - served, served)
    _, group = np.unique(anchor, return_inverse=True)
    first_digit = group[row] * (2 * length) + (back[row] - place + length)
    alive, equal = equal_suffixes(first_digit, texts.data, texts.offsets[row] + place, length)
    ranks = least[row]
    if len(alive):
        bounds = np.flatnonzero(np.diff(equal, prepend=-1))
        best = np.minimum.reduceat(ranks[alive], bounds)
        ranks[alive] = best[np.searchsorted(equal[bounds], equal)]
    shared = n > 1
    shared[row[alive]] = True
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(ranks, prepend=0) != 0))
    runs = np.bincount(row[new], minlength=len(served))
    offsets = pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32))
    batch = pa.RecordBatch.from_arrays(
        [
            contexts.column("hash").combine_chunks(),
            contexts.column("context").combine_chunks(),
            pa.ListArray.from_arrays(offsets, pa.array(place[new].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(ranks[new])),
        ],
        names=["hash", "context", "run_from", "run_rank"],
    )
    return batch.filter(pa.array(shared))


SETTLED = "hash bigint, context bigint, run_from array<int>, run_rank array<bigint>"


def sorted_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """Sort the suffixes around anchors that have few different surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                held.append(batch.slice(first, TOGETHER))
                count += held[-1].num_rows
                if count >= TOGETHER:
                    table = pa.Table.from_batches(held)
                    hashes = table.column("hash").to_numpy()
                    # The last anchor may go on in the next batch.
                    stop = int(np.searchsorted(hashes, hashes[-1], "left"))
                    if stop:
                        yield settle(table.slice(0, stop), length)
                    held = table.slice(stop).combine_chunks().to_batches()
                    count = sum(b.num_rows for b in held)
        if count:
            yield settle(pa.Table.from_batches(held), length)

    return contexts.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, SETTLED)


def counted_contexts(contexts: DataFrame, length: int) -> DataFrame:
    """The same for crowded anchors: every window by itself, by a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = pa.Table.from_batches([batch.slice(first, TOGETHER)])
                texts = next(at.slices(part.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()), 1 << 40))
                served = np.diff(texts.offsets) - length + 1
                row = np.repeat(np.arange(len(served)), served)
                place = np.arange(len(row)) - np.repeat(np.cumsum(served) - served, served)
                begin = texts.offsets[row] + place
                distance = (part.column("back").to_numpy()[row] - place).astype(np.uint64)
                anchor = part.column("hash").to_numpy().view(np.uint64)[row]
                h1, h2 = (
                    at.join_hashes(at.join_hashes(x, distance), anchor) for x in window_hashes(texts.data, begin, length)
                )
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at.as_long(h1)),
                        pa.array(at.as_long(h2)),
                        pa.array(place.astype(np.int32)),
                        *[part.column(c).combine_chunks().take(take) for c in ("hash", "context", "least")],
                    ],
                    names=["h1", "h2", "place", "hash", "context", "least"],
                )

    windows = contexts.mapInArrow(run, "h1 bigint, h2 bigint, place int, hash bigint, context bigint, least bigint")
    best = windows.groupBy("h1", "h2").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("n"))
    met = spread_join(windows.drop("least"), best.filter(F.col("n") > 1).drop("n"), ["h1", "h2"], "inner")
    found = met.groupBy("hash", "context").agg(F.map_from_entries(F.collect_list(F.struct("place", "best"))).alias("_best"))
    found = found.withColumnsRenamed({"hash": "_hash", "context": "_context"})
    rows = contexts.select("hash", "context", "least", "n", (F.octet_length("bytes") - length).alias("last"))
    rows = rows.join(found, (F.col("hash") == F.col("_hash")) & (F.col("context") == F.col("_context")), "left")
    rows = rows.filter((F.col("n") > 1) | F.col("_best").isNotNull()).withColumn("run_from", F.sequence(F.lit(0), F.col("last")))
    ranks = F.transform("run_from", lambda j: F.coalesce(F.try_element_at("_best", j), "least"))
    return rows.select("hash", "context", "run_from", ranks.alias("run_rank"))


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    return [
        repeats.range_hashes(repeats.prefix_hashes(at.mix(at._BYTE[data] ^ np.uint64(seed))), starts, starts + length)
        for seed in (5, 17)
    ]


def removed_runs(edges: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal removed runs begin and end; none goes on in the next text."""
    begins, ends = removed.copy(), removed.copy()
    begins[1:] &= ~removed[:-1]
    ends[:-1] &= ~removed[1:]
    inner = edges[(edges > 0) & (edges < len(removed))]
    begins[inner] = removed[inner]
    ends[inner - 1] = removed[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def reports(texts: at.Texts, removed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of every text the removed bytes, the runs of them, and the digest of the rest."""
    edges = texts.offsets
    stays = np.zeros(len(removed) + 1, dtype=np.int64)
    np.cumsum(~removed, out=stays[1:])
    bounds = stays[edges]
    left = memoryview(np.ascontiguousarray(texts.data[~removed]))
    digests = [hashlib.sha256(left[a:b]).hexdigest() for a, b in pairwise(bounds.tolist())]
    return np.diff(edges) - np.diff(bounds), np.diff(np.searchsorted(begins, edges)), digests


def again(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes stand before in the same row."""
    order = np.lexsort((hashes, row))
    r, h = row[order], hashes[order]
    out = np.zeros(len(order), dtype=bool)
    out[order[1:]] = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    return out


FIRST = (
    "doc_id bigint, row_key bigint, own bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "packed binary, covered array<int>, open array<int>, twice boolean"
)


def duplicate_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, and a digest of the rest.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document of a smaller id, or before it in the same one.  NULL
    texts are empty; texts shorter than ``length`` keep all.  A NULL id is
    smaller than any other.  Rows with the same id are not earlier than each
    other, and rows with the same id and text are judged as one document.  An
    empty table gives no rows.
    """
    if length < RUN + 8:
        raise ValueError(f"strings need at least {RUN + 8} bytes")

    def anchors(texts: at.Texts) -> repeats.Anchors:
        return byte_anchors(texts, length)

    def placed(texts: at.Texts) -> repeats.Anchors:
        return byte_anchors(texts, length, contexts=False)

    rows = repeats.documents(docs, key, text)
    marks = repeats.repeated_anchors(rows, anchors, placed)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, (ids, keys, own, ordinals, leasts) in repeats.batches_of(batch, 0):
                a = repeats.anchors_where(texts, ordinals.is_valid().to_numpy(zero_copy_only=False), placed)
                bounds, edges = np.searchsorted(a.row, np.arange(len(texts) + 1)), texts.offsets
                row, mine = repeats.flat(ordinals)
                # A row given twice has each of its anchors twice.
                mark, kept_marks = np.unique(bounds[row] + mine, return_index=True)
                row, mine, least = row[kept_marks], mine[kept_marks], repeats.flat(leasts)[1][kept_marks]
                mixed = least == repeats.MISSING
                same = ~mixed
                # In the first document, the first of the equal places stays.
                gone = mark[same][(least[same] < own.to_numpy()[row[same]]) | again(row[same], a.hash[mark[same]])]
                low = edges[a.row[gone]]
                removed = at.covered(low + a.first[gone], low + a.last[gone] + length, len(texts.data))
                begins, ends = removed_runs(edges, removed)
                n_open = np.bincount(row[mixed], minlength=len(texts))
                pending = n_open > 0
                twice = np.zeros(len(texts), dtype=bool)
                twice[row[mixed][again(row[mixed], a.hash[mark[mixed]])]] = True
                n_removed, n_spans, digests = reports(texts, removed, begins)
                of = np.searchsorted(edges, begins, "right") - 1
                covered = (np.stack([begins, ends], axis=1) - edges[of][:, None])[pending[of]].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        keys,
                        own,
                        pa.array(np.diff(edges)),
                        pa.array(n_removed, mask=pending),
                        pa.array(n_spans, mask=pending),
                        pa.array([None if p else d for p, d in zip(pending.tolist(), digests, strict=True)], type=pa.string()),
                        pa.array(repeats.packed(texts, pending), type=pa.binary()),
                        repeats.listed(covered, np.where(pending, 2 * n_spans, 0), pending),
                        repeats.listed(mine[mixed], n_open, pending),
                        pa.array(twice),
                    ],
                    names=[c.split()[0] for c in FIRST.split(", ")],
                )

    seen = repeats.with_marks(rows, marks).select("text", "doc_id", "row_key", "own", "ordinals", "leasts")
    seen = kept(seen.mapInArrow(first_look, FIRST), "suffix")
    pending = seen.filter(F.col("packed").isNotNull())

    def open_anchors(places: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, (opened, keys, own) in repeats.unpacked(batch, 0):
                    a = anchors(texts)
                    bounds = np.searchsorted(a.row, np.arange(len(texts) + 1))
                    row, mine = repeats.flat(opened)
                    mine += bounds[row]
                    first, last = a.first[mine], a.last[mine]
                    columns = [pa.array(at.as_long(a.hash[mine])), pa.array(at.as_long(a.context[mine]))]
                    if places:
                        names = ["hash", "context", "row_key", "first", "last"]
                        columns += [keys.take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                    else:
                        names = ["hash", "context", "own", "back", "bytes"]
                        low, raw = texts.offsets[row], texts.data
                        strings = [raw[x:y].tobytes() for x, y in zip(low + first, low + last + length, strict=True)]
                        columns += [
                            own.take(pa.array(row)),
                            pa.array((a.place[mine] - first).astype(np.int32)),
                            pa.array(strings, type=pa.binary()),
                        ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return run

    texts_of = pending.select("packed", "open", "row_key", "own")
    contexts = texts_of.mapInArrow(open_anchors(False), "hash bigint, context bigint, own bigint, back int, bytes binary")
    contexts = contexts.groupBy("hash", "context", "back", "bytes").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("n"))
    contexts = kept(contexts, "contexts")
    crowded = contexts.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWDED).select("hash")
    settled = sorted_contexts(spread_join(contexts, crowded, "hash", "left_anti"), length).unionAll(
        counted_contexts(spread_join(contexts, crowded, "hash", "left_semi"), length)
    )
    places = texts_of.mapInArrow(open_anchors(True), "hash bigint, context bigint, row_key bigint, first int, last int")
    found = places.join(
        settled.withColumnsRenamed({"hash": "_hash", "context": "_context"}),
        (F.col("hash") == F.col("_hash")) & (F.col("context") == F.col("_context")),
    )
    # Runs of windows of a document, one list after the other.
    found = found.groupBy("row_key").agg(F.collect_list(F.struct("first", "last", "run_from", "run_rank")).alias("_found"))
    found = found.select(
        "row_key",
        F.flatten(F.transform("_found", lambda x: F.transform(x["run_from"], lambda j: x["first"] + j))).alias("run_from"),
        F.flatten(
            F.transform(
                "_found",
                lambda x: F.transform(
                    F.concat(F.slice(x["run_from"], 2, F.size(x["run_from"])), F.array(x["last"] - x["first"] + 1)),
                    lambda j: x["first"] + j,
                ),
            )
        ).alias("run_to"),
        F.flatten(F.transform("_found", lambda x: x["run_rank"])).alias("run_rank"),
    )
    joined = repeats.with_marks(pending.select("packed", "doc_id", "row_key", "own", "n_bytes", "covered", "twice"), found)

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, (ids, sizes, own, twice, edges, froms, tos, ranks) in repeats.unpacked(batch, 0):
                bounds = texts.offsets
                low = bounds[:-1]
                row, covered = repeats.flat(edges)
                covered += low[row]
                row, begin = repeats.flat(froms)
                end, rank = low[row] + repeats.flat(tos)[1], repeats.flat(ranks)[1]
                begin += low[row]
                gone = rank < own.to_numpy()[row]
                parts = [(covered[::2], covered[1::2]), (begin[gone], end[gone] + length - 1)]
                stays = np.bincount(row[~gone], minlength=len(texts)) > 0
                first_run = np.searchsorted(row, np.arange(len(texts) + 1))
                for r in np.flatnonzero(stays & twice.to_numpy(zero_copy_only=False)):
                    # This document is the first: of equal windows in it, the first stays.
                    runs = slice(first_run[r], first_run[r + 1])
                    here = ~gone[runs]
                    begins, ends = begin[runs][here] - low[r], end[runs][here] - low[r]
                    own_starts = np.flatnonzero(at.covered(begins, ends, int(bounds[r + 1] - low[r])))
                    h1, h2 = window_hashes(texts.data[low[r] : bounds[r + 1]], own_starts, length)
                    order = np.lexsort((own_starts, h2, h1))
                    equal = np.zeros(len(order), dtype=bool)
                    equal[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
                    later = low[r] + own_starts[order][equal]
                    parts.append((later, later + length))
                removed = at.covered(*(np.concatenate(x) for x in zip(*parts, strict=True)), len(texts.data))
                n_removed, n_spans, digests = reports(texts, removed, removed_runs(bounds, removed)[0])
                yield pa.RecordBatch.from_arrays(
                    [ids, sizes, pa.array(n_removed), pa.array(n_spans), pa.array(digests, type=pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    report = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    finished = joined.select("packed", "doc_id", "n_bytes", "own", "twice", "covered", "run_from", "run_to", "run_rank")
    done = seen.filter(F.col("packed").isNull()).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionAll(finished.mapInArrow(last_look, report))
