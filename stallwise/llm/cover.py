"""Remove repeated word windows, found through difference-cover anchors.

Words of a text are numbered from 0.  Only runs of words that begin at cover
positions are hashed: numbers whose remainder by ``PERIOD`` is in ``COVER``.  The
cover's differences hit every remainder, so wherever two equal windows begin, at
some common offset below the period both have an anchor, and the anchors are
equal, as they lie inside the windows.

An anchor that occurs once takes part in nothing.  Where an anchor's surroundings
(all windows around it) are the same everywhere, each of those windows is
repeated.  Only around the other anchors are windows hashed and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at
from stallwise.llm import repeats
from stallwise.llm.folders import kept
from stallwise.operators.joins import spread_join

WINDOW = 35
#: A perfect difference set: each remainder by 21 is the difference of two members.
PERIOD = 21
COVER = np.isin(np.arange(PERIOD), [3, 6, 7, 12, 14])


def word_anchors(texts: at.Texts, words: at.Words, hashes: np.ndarray, window: int) -> repeats.Anchors:
    run = window - PERIOD + 1
    n = words.counts()[words.row]
    place = np.arange(len(hashes)) - words.offsets[words.row]
    chosen = np.flatnonzero(COVER[place % PERIOD] & (place + run <= n) & (n >= window))
    first = np.maximum(place[chosen] - (PERIOD - 1), 0)
    last = np.minimum(place[chosen], n[chosen] - window)
    used = first <= last
    chosen, first, last = chosen[used], first[used], last[used]
    base = words.offsets[words.row[chosen]]
    prefix = repeats.prefix_hashes(hashes)
    context = repeats.range_hashes(prefix, base + first, base + last + window)
    context = at.join_hashes(context, ((place[chosen] - first) * PERIOD + (last - first)).astype(np.uint64))
    row = words.row[chosen]
    found = at.grams(hashes, run)[chosen] if len(chosen) else hashes[:0]
    return repeats.Anchors(row, repeats.numbered(row), place[chosen], found, context, first, last)


def hashed(texts: at.Texts) -> tuple[at.Words, np.ndarray]:
    words = at.words(texts, at.NOT_SPACE)
    return words, at.span_hashes(texts.data, words.start, words.end)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window."""
    return tuple(
        repeats.range_hashes(repeats.prefix_hashes(at.mix(hashes ^ np.uint64(seed))), starts, starts + window) for seed in (11, 29)
    )


def expanded(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, each once, in order."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    inside = at.covered(first, last + 1, int(last.max()) + 1)
    return np.flatnonzero(inside)


def kept_words(texts: at.Texts, words: at.Words, row: int, drop: np.ndarray) -> str:
    """The digest of the words that stay, one space between them."""
    low, high = words.offsets[row], words.offsets[row + 1]
    start, size = words.start[low:high][~drop], (words.end - words.start)[low:high][~drop] + 1
    stops = np.cumsum(size)
    if not len(stops):
        return hashlib.sha256(b"").hexdigest()
    places = np.repeat(start - (stops - size), size) + np.arange(stops[-1])
    out = texts.data[np.minimum(places, len(texts.data) - 1)]
    out[stops - 1] = 0x20
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


FIRST = "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept_sha256 string, packed binary, covered array<int>, open array<int>"


def duplicate_words(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, how many are removed, and a digest of the others.

    NULL and empty texts have no words, and texts shorter than a window keep
    theirs.  Rows are documents of their own, also those with a NULL or repeated
    id; a row given twice loses every window.  An empty table gives no rows.
    """
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")

    def anchors(texts: at.Texts) -> repeats.Anchors:
        return word_anchors(texts, *hashed(texts), window)

    rows = repeats.documents(docs, key, text)
    marks = repeats.repeated_anchors(rows, anchors)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finish documents whose repeated anchors need no comparison; put the others aside."""
        for batch in batches:
            for texts, (ids, keys, ordinals, leasts) in repeats.batches_of(batch, 0):
                words = at.words(texts, at.NOT_SPACE)
                n = words.counts()
                a = repeats.anchors_where(texts, ordinals.is_valid().to_numpy(zero_copy_only=False), anchors)
                bounds = np.searchsorted(a.row, np.arange(len(texts) + 1))
                out = {name: [] for name in ("removed", "sha", "packed", "covered", "open")}
                own_ordinals, own_leasts = repeats.lists(ordinals), repeats.lists(leasts)
                for r in range(len(texts)):
                    drop, opened = np.zeros(n[r], dtype=bool), np.zeros(0, dtype=np.int64)
                    if len(own_ordinals[r]):
                        at_anchor = bounds[r] + own_ordinals[r]
                        same = own_leasts[r] != repeats.MISSING
                        settled, mixed = at_anchor[same], at_anchor[~same]
                        drop = at.covered(a.first[settled], a.last[settled] + window, n[r])
                        opened = expanded(a.first[mixed], a.last[mixed])
                    pending = len(opened) > 0
                    out["removed"].append(None if pending else int(drop.sum()))
                    out["sha"].append(None if pending else kept_words(texts, words, r, drop))
                    out["packed"].append(repeats.pack(texts.text(r)) if pending else None)
                    out["covered"].append(np.flatnonzero(np.diff(drop, prepend=False, append=False)).tolist() if pending else None)
                    out["open"].append(np.flatnonzero(np.diff(np.isin(np.arange(n[r] + 1), opened), prepend=False)).tolist() if pending else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        keys,
                        pa.array(n),
                        pa.array(out["removed"], type=pa.int64()),
                        pa.array(out["sha"], type=pa.string()),
                        pa.array(out["packed"], type=pa.binary()),
                        pa.array(out["covered"], type=pa.list_(pa.int32())),
                        pa.array(out["open"], type=pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "row_key", "n_words", "n_removed", "kept_sha256", "packed", "covered", "open"],
                )

    seen = repeats.with_marks(rows, marks).select("text", "doc_id", "row_key", "ordinals", "leasts")
    seen = kept(seen.mapInArrow(first_look, FIRST), "cover")
    pending = seen.filter(F.col("packed").isNotNull())

    def windows(places: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, (edges, keys) in repeats.unpacked(batch, 0):
                    words, hashes = hashed(texts)
                    starts = [expanded(e[::2], e[1::2] - 1) for e in repeats.lists(edges)]
                    row = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
                    own = np.concatenate(starts)
                    h1, h2 = window_hashes(hashes, words.offsets[row] + own, window)
                    columns = [pa.array(at.as_long(h1)), pa.array(at.as_long(h2))]
                    if places:
                        columns += [keys.take(pa.array(row)), pa.array(own.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "row_key", "start"][: len(columns)])

        return run

    texts_of = pending.select("packed", "open", "row_key")
    counts = texts_of.mapInArrow(windows(False), "h1 bigint, h2 bigint").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    repeated = counts.filter(F.col("n") > 1).select("h1", "h2")
    found = spread_join(
        texts_of.mapInArrow(windows(True), "h1 bigint, h2 bigint, row_key bigint, start int"), repeated, ["h1", "h2"], "inner"
    )
    found = found.groupBy("row_key").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    joined = repeats.with_marks(pending.select("packed", "doc_id", "row_key", "n_words", "covered"), found)

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, (ids, totals, edges, starts) in repeats.unpacked(batch, 0):
                words = at.words(texts, at.NOT_SPACE)
                n = words.counts()
                removed, digests = [], []
                for r, (e, s) in enumerate(zip(repeats.lists(edges), repeats.lists(starts), strict=True)):
                    drop = at.covered(e[::2], e[1::2], n[r]) | at.covered(s, s + window, n[r])
                    removed.append(int(drop.sum()))
                    digests.append(kept_words(texts, words, r, drop))
                yield pa.RecordBatch.from_arrays(
                    [ids, totals, pa.array(removed), pa.array(digests)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    report = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    finished = joined.select("packed", "doc_id", "n_words", "covered", "starts").mapInArrow(last_look, report)
    return seen.filter(F.col("packed").isNull()).select("doc_id", "n_words", "n_removed", "kept_sha256").unionAll(finished)
