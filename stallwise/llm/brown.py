"""Language-model scores by Brown classes: words are put into classes by exchange, classes follow one another.

The probability of a word after another is that of its class after the other's
class, times that of the word within its class.  Both are smoothed so that
without evidence the result is the smoothed frequency of the word, and so that
the known words, the end of a text and one symbol for all unknown words together
have probability 1 after every word.

1. Words of the training texts are counted.  The ``COMMON`` most frequent ones
   are few enough to give to every task; a longer word stands there by a digest.
2. Texts become numbers: the rank of a common word, or a place in the text's own
   list of other words.  Later steps read this table.
3. Exchange: each round counts, over all training texts, the classes before and
   after the ``MOVED`` most frequent words, a table of ``MOVED`` by twice
   ``CLASSES`` numbers whatever the corpus; all other words are in classes by
   form.  Words are dealt to tasks in blocks, and a task moves each of its words
   to the class that raises the likelihood most, one after another, as distributed
   exchange clustering does.  A round that lowers the likelihood is taken back and
   ends the search.
4. Every other word goes to the class that fits all its neighbours best: the
   exchange step of a word of little weight, which is not allowed to make the
   transitions that it is judged by.  Common ones have a table of neighbours as in
   3; the rest (each has at most one ``COMMON``-th of all tokens, so none is a
   frequent key) are gathered by word.
5. Their classes and counts are brought back to the texts, transitions of classes
   are counted over all training texts, and texts are scored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at
from stallwise.llm.folders import kept

#: Words that every task knows, at most.
COMMON = 1 << 16
#: Words that are moved in rounds, at most.
MOVED = 1 << 13
CLASSES = 32
ROUNDS = 6
#: A longer word is known by its first bytes and a digest, of this length together.
LONGEST = 64
#: Words in a block of counts.
BLOCK = 1024
#: Bytes of text handled at once.
SLICE = 4 << 20
#: How many transitions the frequency of a class counts for, and the share that always goes by frequency.
PRIOR = 32.0
PLAIN = 0.1
#: The class of the end of a text, and what follows from the first byte of a word for its first class.
END = 0
FORMS = np.full(256, 4, dtype=np.uint8)
FORMS[:128], FORMS[48:58], FORMS[97:123] = 3, 1, 2

ENCODED = "row bigint, doc_id bigint, teaches boolean, codes array<int>, rare array<binary>"


def teaches(key: Column, folds: int = 5, held: int = 1) -> Column:
    """All folds but one teach; rows without an id count as an empty id."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds != held


def spelled(texts: at.Texts) -> tuple[at.Words, np.ndarray, pa.Array]:
    """The words of some texts, which of the different ones each is, and these, told apart by their bytes."""
    data = at.LOWER[texts.data]
    found = at.words(texts, at.NOT_SPACE, data)
    size = found.end - found.start
    which, different = at.spelled(data, at.NOT_SPACE, size)
    if (size > LONGEST).any():
        different = pa.array([_short(w) for w in different.to_pylist()], type=pa.large_binary())
    return found, which, different


def _short(word: bytes) -> bytes:
    if len(word) <= LONGEST:
        return word
    # A space in it, which no plain word has.
    return word[: LONGEST - 33] + b" " + hashlib.sha256(word).digest()


def vocabulary(rows: DataFrame) -> DataFrame:
    """Every word of the training texts and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in at.slices(batch.column(0), SLICE):
                _, which, different = spelled(texts)
                n = np.bincount(which, minlength=len(different))
                yield pa.RecordBatch.from_arrays([different.cast(pa.binary()), pa.array(n)], names=["word", "n"])

    counts = rows.filter("teaches").select("text").mapInArrow(count, "word binary, n bigint")
    return kept(counts.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def most_common(words: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """At most ``most`` of the most frequent words, in order, with their counts.

    Counts are parted at sixteenths of a power of two, and whole parts are taken
    from the top: which words these are depends on nothing but the counts.
    """
    if most <= 0:
        return pa.array([], type=pa.large_binary()), np.zeros(0, dtype=np.int64)
    part = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(words.groupBy(part.alias("part")).count().collect(), reverse=True)  # some hundred rows
    total, least = 0, None
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        least = row["part"]
    if least is None:
        return pa.array([], type=pa.large_binary()), np.zeros(0, dtype=np.int64)
    rows = sorted(((-r["n"], bytes(r["word"])) for r in words.filter(part >= least).collect()))  # at most ``most`` rows
    return pa.array([w for _, w in rows], type=pa.large_binary()), np.array([-n for n, _ in rows], dtype=np.int64)


def encoded(rows: DataFrame, common: pa.Array) -> DataFrame:
    """Texts as ranks of common words from 1, and ``-1 - k`` for the k-th of the text's own other words."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for texts in at.slices(batch.column(2), SLICE):
                found, which, different = spelled(texts)
                rank = pc.index_in(different, value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                codes = rank[which] + 1 if len(rank) else np.zeros(0, dtype=np.int32)
                rare = np.flatnonzero(codes == 0)
                listed, place = np.unique(found.row[rare] * max(1, len(different)) + which[rare], return_inverse=True)
                first = np.searchsorted(listed, np.arange(len(texts) + 1) * max(1, len(different)))
                codes[rare] = -1 - (place - first[found.row[rare]])
                own = different.take(pa.array(listed % max(1, len(different)))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(texts))),
                        *[c.slice(texts.first, len(texts)) for c in batch.columns[:2]],
                        pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(codes, type=pa.int32())),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), own),
                    ],
                    names=["row", "doc_id", "teaches", "codes", "rare"],
                )
                row += len(texts)

    return kept(rows.select("doc_id", "teaches", "text").mapInArrow(run, ENCODED), "encoded")


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where the rows of a list column begin in its flattened values, and the end."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _first_bytes(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_binary())
    _, ends, raw = words.buffers()
    begin = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words)]
    return np.frombuffer(raw, dtype=np.uint8)[begin] if len(words) else np.zeros(0, dtype=np.uint8)


@dataclass
class Stream:
    """Texts one after the other, an end before the first and after each: codes, and classes by place.

    ``own`` tells the place of every other word in the flattened lists, -1 elsewhere.
    """

    codes: np.ndarray
    classes: np.ndarray
    own: np.ndarray


def stream(codes: pa.Array, rare: pa.Array, classes: np.ndarray) -> Stream:
    """``classes`` by rank, the end first; the class of another word follows from its form."""
    bounds, first = _bounds(codes), _bounds(rare)
    flat = codes.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(codes)), np.diff(bounds))
    own = np.where(flat < 0, first[rows] - 1 - flat, -1)
    flat = np.concatenate([[0], np.insert(flat, bounds[1:], 0)])
    own = np.concatenate([[-1], np.insert(own, bounds[1:], -1)])
    found = classes[np.maximum(flat, 0)]
    other = own >= 0
    found[other] = FORMS[_first_bytes(rare.flatten())][own[other]]
    return Stream(flat, found, own)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts, dtype=np.int64).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.int64)


def neighbours(texts: DataFrame, classes: np.ndarray, n: int, n_classes: int) -> tuple[DataFrame, np.ndarray]:
    """Per block of the first ``n`` words the classes before and after each, and how often it follows itself; all transitions.

    A task adds up its texts in one table and gives it in blocks, which are added
    up by block: what is moved depends on the number of tasks, not on the texts.
    """
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    wide = 2 * n_classes + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = shared.value
        blocks = -(-(n + 1) // BLOCK)
        table = np.zeros(blocks * BLOCK * wide, dtype=np.int64)
        moves = np.zeros(n_classes * n_classes, dtype=np.int64)
        for batch in batches:
            s = stream(batch.column(0), batch.column(1), cls)
            step = s.classes.astype(np.int64)
            moves += np.bincount(step[:-1] * n_classes + step[1:], minlength=len(moves))
            place = s.codes.astype(np.int64) * wide
            counted = (s.codes > 0) & (s.codes <= n)
            left, right = counted[1:], counted[:-1]
            twice = (s.codes[1:] == s.codes[:-1]) & left
            for keys in (place[1:][left] + step[:-1][left], place[:-1][right] + n_classes + step[1:][right], place[1:][twice] + 2 * n_classes):
                table += np.bincount(keys, minlength=len(table))
        table = table.reshape(blocks, -1)
        full = np.flatnonzero(table.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *full], type=pa.int32()), pa.array([_packed(moves), *[_packed(table[b]) for b in full]], type=pa.binary())],
            names=["block", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = _unpacked(data.as_py())
                if own == block:
                    total += counts
                    continue
                if block is not None:
                    done.append((block, _packed(total)))
                block, total = own, counts.copy()
        if block is not None:
            done.append((block, _packed(total)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in done], type=pa.int32()), pa.array([d for _, d in done], type=pa.binary())], names=["block", "counts"]
        )

    parts = texts.select("codes", "rare").mapInArrow(count, "block int, counts binary")
    pieces = -(-(n + 1) // BLOCK)
    sums = parts.repartition(pieces, "block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    sums = kept(sums, "neighbours")
    moves = sums.filter("block = -1").first()
    shared.unpersist()
    if moves is None:
        return sums, np.zeros((n_classes, n_classes), dtype=np.int64)
    return sums.filter("block >= 0"), _unpacked(bytes(moves["counts"])).reshape(n_classes, n_classes)


def _weight(counts: np.ndarray) -> np.ndarray:
    """x log x, 0 for 0."""
    return counts * np.log(np.maximum(counts, 1))


def likelihood(moves: np.ndarray) -> float:
    """What of the log likelihood depends on the classes."""
    return float(_weight(moves).sum() - _weight(moves.sum(axis=0)).sum() - _weight(moves.sum(axis=1)).sum())


def best_class(rest: np.ndarray, before: np.ndarray, after: np.ndarray, twice: int, now: int) -> int:
    """The class that a word fits best; ``rest`` are the transitions without it.  Ties: where it is, then the lowest."""
    plain = _weight(rest)
    into = _weight(rest + before[:, None]) - plain
    out = _weight(rest + after[None, :]) - plain
    gain = into.sum(axis=0) - np.diagonal(into) + out.sum(axis=1) - np.diagonal(out)
    own = np.diagonal(rest)
    gain += _weight(own + before + after + twice) - _weight(own)
    follows, leads = rest.sum(axis=0), rest.sum(axis=1)
    gain -= _weight(follows + before.sum() + twice) - _weight(follows)
    gain -= _weight(leads + after.sum() + twice) - _weight(leads)
    gain[END] = -np.inf
    best = int(gain.argmax())
    return now if gain[now] >= gain[best] else best


def in_blocks(blocks: DataFrame, classes: np.ndarray, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """New classes, one block of words at a time: ``judge`` gets their table and their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _unpacked(data.as_py()).reshape(BLOCK, -1)
                ranks = np.arange(block * BLOCK, (block + 1) * BLOCK)
                own = judge(table, ranks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], type=pa.int32()), pa.array([own.astype(np.uint8).tobytes()], type=pa.binary())],
                    names=["block", "classes"],
                )

    out = classes.copy()
    for row in blocks.mapInArrow(run, "block int, classes binary").collect():  # one byte per word
        first = row["block"] * BLOCK
        own = np.frombuffer(row["classes"], dtype=np.uint8)[: len(out) - first]
        out[first : first + len(own)] = own
    return out


def exchanged(blocks: DataFrame, moves: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """One round over the first ``n`` words: word by word, on the task's own copy of the transitions."""
    n_classes = len(moves)
    shared = blocks.sparkSession.sparkContext.broadcast((moves, classes))

    def judge(table: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        rest, known = shared.value[0].copy(), shared.value[1]
        own = np.zeros(len(ranks), dtype=np.int64)
        here = ranks < len(known)
        own[here] = known[ranks[here]]
        for k in np.flatnonzero((ranks > 0) & (ranks <= n)):
            now, twice = int(own[k]), int(table[k, -1])
            before, after = table[k, :n_classes].copy(), table[k, n_classes:-1].copy()
            before[now] -= twice
            after[now] -= twice
            rest[:, now] -= before
            rest[now] -= after
            rest[now, now] -= twice
            own[k] = new = best_class(np.maximum(rest, 0), before, after, twice, now)
            rest[:, new] += before
            rest[new] += after
            rest[new, new] += twice
        return own

    return in_blocks(blocks, classes, judge)


def fitting(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a transition from, and to, each class (rows) is worth to a word in each class (columns)."""
    odds = np.log(moves + 0.5)
    into = odds - np.log(moves.sum(axis=0) + 0.5 * len(moves))[None, :]
    out = odds.T - np.log(moves.sum(axis=1) + 0.5 * len(moves))[None, :]
    into[:, END] = out[:, END] = -np.inf
    return into, out


def clustered(texts: DataFrame, forms: np.ndarray, n_moved: int, n_classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the common words, the end first, and the transitions by which the last of them were placed.

    ``forms`` are the classes by form.  The first ``n_moved`` words are moved in rounds.
    """
    n = min(n_moved, len(forms))
    classes = np.concatenate([[END], np.arange(n) % (n_classes - 1) + 1, forms[n:]]).astype(np.uint8)
    best, found, most = classes, np.zeros((n_classes, n_classes), dtype=np.int64), -np.inf
    for k in range(rounds + 1):
        blocks, moves = neighbours(texts, classes, n, n_classes)
        value = likelihood(moves)
        if value <= most and k:
            break
        best, found, most = classes, moves, value
        if k < rounds and n:
            classes = exchanged(blocks, moves, classes, n)
    if len(forms) > n:
        into, out = fitting(found)
        blocks, _ = neighbours(texts, best, len(forms), n_classes)

        def judge(table: np.ndarray, ranks: np.ndarray) -> np.ndarray:
            fits = table[:, :n_classes] @ np.maximum(into, -1e9) + table[:, n_classes:-1] @ np.maximum(out, -1e9)
            own = fits[:, 1:].argmax(axis=1) + 1
            known = ranks <= n
            own[known] = best[ranks[known]]
            return own

        best = in_blocks(blocks, best, judge)
    return best, found


def placed(texts: DataFrame, classes: np.ndarray, moves: np.ndarray) -> DataFrame:
    """Every word that is not common, of the training texts, with its count and class."""
    n_classes = len(moves)
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    into, out = fitting(moves)
    worth = (into[:, None, :] + out[None, :, :]).reshape(n_classes * n_classes, n_classes)
    tables = texts.sparkSession.sparkContext.broadcast(worth)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = batch.column(1).flatten()
            s = stream(batch.column(0), batch.column(1), shared.value)
            at_ = np.flatnonzero(s.own >= 0)
            pair = s.classes[at_ - 1].astype(np.int64) * n_classes + s.classes[at_ + 1]
            yield pa.RecordBatch.from_arrays([rare.take(pa.array(s.own[at_])), pa.array(pair.astype(np.int16))], names=["word", "pair"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, n = None, None, 0
        for batch in batches:
            words, pair = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(words):
                continue
            new = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False) if len(words) > 1 else np.zeros(0, dtype=bool)
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            sums = np.add.reduceat(tables.value[pair], first, axis=0)
            counts = np.diff(np.append(first, len(words)))
            heads = words.take(pa.array(first)).to_pylist()
            if heads[0] == last:
                sums[0] += total
                counts[0] += n
            elif last is not None:
                heads, sums, counts = [last, *heads], np.vstack([total, sums]), np.append(n, counts)
            last, total, n = heads[-1], sums[-1].copy(), int(counts[-1])
            yield _classed(heads[:-1], counts[:-1], sums[:-1])
        if last is not None:
            yield _classed([last], np.array([n]), total[None, :])

    found = texts.select("codes", "rare").mapInArrow(occurrences, "word binary, pair smallint")
    by_word = found.repartition("word").sortWithinPartitions("word", "pair")
    return kept(by_word.mapInArrow(choose, "word binary, n bigint, class int"), "classes")


def _classed(words: list[bytes], counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    chosen = sums.argmax(axis=1) if len(words) else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [pa.array(words, type=pa.binary()), pa.array(counts.astype(np.int64)), pa.array(chosen.astype(np.int32))],
        names=["word", "n", "class"],
    )


@dataclass
class Model:
    """Words with classes, and the counts that probabilities are made of."""

    common: pa.Array
    counts: np.ndarray  # by rank, the end first
    classes: np.ndarray
    others: DataFrame  # word, n, class
    tokens: int
    n_words: int
    class_tokens: np.ndarray
    class_words: np.ndarray  # the symbol for unknown words included
    unknown: int

    @property
    def end(self) -> int:
        """The end is a symbol like others; without training texts it is unknown."""
        return END if self.tokens else self.unknown

    def within(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the probability of words in their classes."""
        return np.log10((counts + 0.5) / (self.class_tokens[classes] + 0.5 * self.class_words[classes]))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.n_words + 1)))

    def transitions(self, moves: np.ndarray) -> np.ndarray:
        """log10 of the probability of classes after classes; by frequency where nothing was seen."""
        share = (self.class_tokens + 0.5 * self.class_words) / (self.tokens + 0.5 * (self.n_words + 1))
        odds = (moves + PRIOR * share) / (moves.sum(axis=1, keepdims=True) + PRIOR)
        return np.log10(np.maximum((1 - PLAIN) * odds + PLAIN * share, 1e-300))


def fitted(rows: DataFrame, common_words: int, moved_words: int, n_classes: int, rounds: int) -> tuple[Model, DataFrame]:
    """The model of the training texts (columns ``doc_id``, ``text``, ``teaches``), and all texts encoded."""
    if not 6 <= n_classes <= 128:
        raise ValueError("between 6 and 128 classes: the end, four forms of words, and more")
    words = vocabulary(rows)
    common, counts = most_common(words, common_words)
    texts = encoded(rows, common)
    lessons = texts.filter("teaches")
    n_texts = lessons.count()
    classes, moves = clustered(lessons, FORMS[_first_bytes(common)], moved_words, n_classes, rounds)
    others = placed(lessons, classes, moves)
    counts = np.concatenate([[n_texts], counts])
    tokens, n_words, single = (np.zeros(n_classes, dtype=np.int64) for _ in range(3))
    np.add.at(tokens, classes, counts)
    np.add.at(n_words, classes, counts > 0)
    np.add.at(single, classes, counts == 1)
    by_class = others.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("single"))
    for row in by_class.collect():  # one row per class
        tokens[row["class"]] += row["n"]
        n_words[row["class"]] += row["words"]
        single[row["class"]] += row["single"]
    single[END] = -1
    unknown = int(single.argmax())  # where most words are that were met only once
    model = Model(common, counts, classes, others, int(tokens.sum()), int(n_words.sum()), tokens, n_words.copy(), unknown)
    model.class_words[unknown] += 1
    return model, texts


def word_classes(model: Model) -> DataFrame:
    """Every known word (long ones by digest) with its count and class."""
    spark = model.others.sparkSession
    rows = zip(model.common.to_pylist(), model.counts[1:].tolist(), model.classes[1:].tolist(), strict=True)
    return spark.createDataFrame(list(rows), "word binary, n bigint, class int").unionAll(model.others)


def in_classes(model: Model, texts: DataFrame) -> DataFrame:
    """Texts as sequences of classes, with all sums that need no transitions."""
    spark = texts.sparkSession
    places = texts.select("row", F.posexplode("rare").alias("k", "word"))
    met = places.join(model.others, "word", "left").select("row", F.struct("k", "class", "n").alias("found"))
    met = met.groupBy("row").agg(F.collect_list("found").alias("found"))
    whole = texts.select("row", "doc_id", "teaches", "codes").join(met, "row", "left").drop("row")
    counts, classes = model.counts, model.classes.copy()
    classes[END] = model.end
    word, base = model.within(counts, classes), model.base(counts)
    # What a task needs of the model: tables by rank and by class.
    small = Model(model.common[:0], counts, classes, None, model.tokens, model.n_words, model.class_tokens, model.class_words, model.unknown)
    shared = spark.sparkContext.broadcast((small, word, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, word, base = shared.value
            bounds, first = _bounds(batch.column(2)), _bounds(batch.column(3))
            codes = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            found = batch.column(3).flatten()
            k, cls, n = (f.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for f in found.flatten())
            by_place = np.empty(len(k), dtype=np.int64)
            by_place[np.repeat(first[:-1], np.diff(first)) + k] = np.arange(len(k))
            cls, n = np.where(cls < 0, own.unknown, cls)[by_place], np.maximum(n, 0)[by_place]
            common = codes >= 0
            token_class, token_word, token_base = own.classes[np.maximum(codes, 0)], word[np.maximum(codes, 0)], base[np.maximum(codes, 0)]
            known = common.copy()
            if len(k):
                other = np.flatnonzero(~common)
                place = first[rows[other]] - 1 - codes[other]
                token_class[other] = cls[place]
                token_word[other] = own.within(n, cls)[place]
                token_base[other] = own.base(n)[place]
                known[other] = n[place] > 0
            size = batch.num_rows
            add = lambda values: np.bincount(rows, weights=values, minlength=size)
            sequence = np.insert(token_class, bounds[1:], own.classes[END]).astype(np.uint8)
            ends = bounds + np.arange(size + 1)
            raw = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sequence)])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    raw,
                    pa.array(np.diff(bounds) + 1),
                    pa.array(add(known).astype(np.int64) + int(own.tokens > 0)),
                    pa.array(add(token_base) + base[0]),
                    pa.array(add(token_word) + word[0]),
                ],
                names=["doc_id", "teaches", "classes", "n_tokens", "n_known", "base_score", "words_score"],
            )

    schema = "doc_id bigint, teaches boolean, classes binary, n_tokens bigint, n_known bigint, base_score double, words_score double"
    return kept(whole.mapInArrow(run, schema), "sequences")


def _classes(column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of a column of sequences as pairs (before, after) of classes; every sequence follows an end."""
    column = column.cast(pa.large_binary())
    _, ends, raw = column.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]].astype(np.int64)
    before = np.concatenate([[end], flat[:-1]])
    return before, flat


def class_moves(sequences: DataFrame, model: Model) -> np.ndarray:
    """Transitions of classes in the training texts."""
    n_classes, end = len(model.class_tokens), model.end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                before, after = _classes(batch.column(0), end)
                total += np.bincount(before * n_classes + after, minlength=len(total))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], names=["pair", "n"])

    out = np.zeros(n_classes * n_classes, dtype=np.int64)
    counts = sequences.filter("teaches").select("classes").mapInArrow(count, "pair int, n bigint")
    for row in counts.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # one row per pair of classes
        out[row["pair"]] = row["n"]
    return out.reshape(n_classes, n_classes)


def scored(
    docs: DataFrame,
    lessons: Column,
    key: str = "doc_id",
    text: str = "text",
    common_words: int = COMMON,
    moved_words: int = MOVED,
    n_classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Model]:
    """One row per text with scores (log10), and the model, learnt from rows where ``lessons`` holds.

    NULL texts are empty: only their end is scored.  Rows are kept as they are,
    repeated ones and those without an id too.  Without training texts every token
    is unknown, with probability 1.  No texts, no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), lessons.alias("teaches"))
    model, texts = fitted(rows, common_words, moved_words, n_classes, rounds)
    sequences = in_classes(model, texts)
    odds, end = model.transitions(class_moves(sequences, model)).ravel(), model.end
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    schema = (
        "doc_id bigint, teaches boolean, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_classes = round(len(shared.value) ** 0.5)
        for batch in batches:
            if not batch.num_rows:
                continue
            before, after = _classes(batch.column(2), end)
            n = batch.column(3).to_numpy()
            sums = np.add.reduceat(shared.value[before * n_classes + after], np.cumsum(n) - n)
            score = sums + batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *batch.columns[3:6], pa.array(score), pa.array(10 ** np.clip(-score / n, 0, 300))],
                names=["doc_id", "teaches", "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    return sequences.mapInArrow(run, schema), model


def language_report(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from four of five folds."""
    rows, model = scored(docs, teaches(F.col("doc_id")))
    return rows.select(
        "doc_id",
        (~F.col("teaches")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
