"""Quality of documents by supervised subword embeddings.

A text is the mean of learned vectors of its hashed n-grams: words, pairs of
neighbouring words, and runs of two to four bytes that don't reach over a word's
edges by more than one.  A softmax layer turns the mean into a probability.

Vectors and layer are trained together by stochastic gradient descent in numpy,
on a bounded, balanced sample of labelled documents (``SAMPLE`` of each label,
by hash of the id).  Scoring needs only the layer's answer to each vector, one
number per n-gram, which is a table of ``BUCKETS`` numbers for any corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at

#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 1500
#: Slots of hashed n-grams: one half for bytes, one for words.
BITS = 16
BUCKETS = 1 << (BITS + 1)
DIMENSIONS = 8
#: Steps of gradient descent, whatever the size of the sample.
STEPS = 12_000
RATE = 0.5
#: Every fold but this one of three may teach.
HELD_OUT = 1
#: The slot of a pair of equal words.
REPEATED = BUCKETS - 1

Model = tuple[np.ndarray, float]


def ngrams(texts: at.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of n-grams in order of place, and where those of each row begin; one pair per kind."""
    data, edges = texts.data, texts.offsets
    n = len(data)
    space = ~at.NOT_SPACE[data]
    plain = np.where(space, np.uint8(32), data).astype(np.uint32)
    packed, inner = plain, np.zeros(n, dtype=bool)
    for size in (2, 3, 4):
        if n < size:
            break
        packed = packed[:-1] | plain[size - 1 :] << np.uint32(8 * (size - 1))
        inner = inner[:-1] | (space[size - 2 : -1] if size > 2 else False)
        usable = ~inner
        for back in range(1, size):
            stops = edges[1:] - back
            usable[stops[(stops >= 0) & (stops < len(usable))]] = False
        places = np.flatnonzero(usable)
        slots = (packed[places] * np.uint32(0x9E3779B1) + np.uint32((size * 0x85EBCA6B) & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        yield slots.astype(np.int64), np.searchsorted(places, edges)
    words = at.words(texts, at.NOT_SPACE)
    hashes = at.span_hashes(data, words.start, words.end)
    shift = np.uint64(64 - BITS)
    yield (hashes >> shift).astype(np.int64) + (1 << BITS), words.offsets
    if len(hashes) > 1:
        together = np.flatnonzero(words.row[1:] == words.row[:-1])
        pairs = (at.join_hashes(hashes[together], hashes[together + 1]) >> shift).astype(np.int64) + (1 << BITS)
        pairs[hashes[together] == hashes[together + 1]] = REPEATED
        yield pairs, np.searchsorted(together, words.offsets)


def scores(texts: at.Texts, model: Model) -> np.ndarray:
    """The probability of the better label for each row; of the layer alone without n-grams."""
    table, bias = model
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for slots, bounds in ngrams(texts):
        sums = np.concatenate([[0.0], np.cumsum(table[slots])])
        total += sums[bounds[1:]] - sums[bounds[:-1]]
        count += np.diff(bounds)
    return np.round(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30))), 6)


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit vectors and layer; the result answers with one number per slot."""
    bags = []
    for text in texts:
        slice_ = next(at.slices(pa.array([text], type=pa.string()), limit=1 << 40))
        found = np.concatenate([slots for slots, _ in ngrams(slice_)] or [np.zeros(0, dtype=np.int64)])
        slots, counts = np.unique(found, return_counts=True)
        bags.append((slots.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    chance = np.random.default_rng(7)
    vectors = chance.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    epochs = -(-STEPS // len(bags))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in chance.permutation(len(bags)):
            slots, share = bags[k]
            rate = RATE * (1 - done / steps)
            mean = share @ vectors[slots]
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            back = layer @ error
            layer -= rate * np.outer(mean, error)
            bias -= np.float32(0.1 * rate) * error
            # A mean of thousands of n-grams moves little; the step is scaled to the bag.
            vectors[slots] -= (rate * len(slots) * share / max(1.0, float(np.sqrt(len(slots)))))[:, None] * back
            done += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(key: Column) -> Column:
    """The fold that is never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit a model on the sample: at most ``SAMPLE`` documents of either label, trained in one task."""
    usable = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    # A label given twice counts once; one that contradicts itself teaches nothing.
    usable = usable.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other"))
    usable = usable.filter(F.col("_label") == F.col("_other"))
    usable = usable.select("_id", "_label", F.md5(F.col("_id").cast("string")).alias("_order"))
    # Each task gives its first rows of a label, so no label is gathered.
    first = [usable.filter(F.col("_label") == label).orderBy("_order", "_id").limit(SAMPLE) for label in (0, 1)]
    chosen = first[0].unionAll(first[1])
    found = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")  # at most 2 * SAMPLE ids
    )
    found = found.groupBy("_id", "_label", "_order").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        marks: list[int] = []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            texts += [t or "" for t in batch.column(1).to_pylist()]
        table, bias = train(texts, marks) if texts else (np.zeros(BUCKETS, dtype=np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()]), pa.array([bias])], names=["table", "bias"])

    ordered = found.select("_label", "_text", "_order").repartition(1).sortWithinPartitions("_order", "_label")
    rows = ordered.select("_label", "_text").mapInArrow(fit, "table binary, bias double").collect()
    if not rows:  # a plan that Spark knows to be empty has no task
        return np.zeros(BUCKETS, dtype=np.float32), 0.0
    return np.frombuffer(rows[0]["table"], dtype=np.float32), rows[0]["bias"]


def scored(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with ``score``: how likely the better label is, 0 to 1.

    NULL and empty texts get what the layer answers to no n-grams at all.  Rows
    are kept as they are; without labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in at.slices(batch.column(len(columns))):
                carried = [c.slice(texts.first, len(texts)) for c in batch.columns[: len(columns)]]
                yield pa.RecordBatch.from_arrays([*carried, pa.array(scores(texts, shared.value))], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text)).mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its fold, score and predicted label."""
    rows = scored(docs, fitted(docs, labels), ["doc_id"])
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
