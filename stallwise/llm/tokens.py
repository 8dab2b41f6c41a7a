"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters.

Documents are put in ascending order of id, encoded, and written as ORC.  Each
file is one block of the order; a row holds the id, the block, its place in it,
and the ids.  ORC's integer run-length encoding packs the ids to their bit width,
stripes can be read in parallel, and the row index and a Bloom filter on doc_id
let a reader of single documents skip the rest (``spark.read.orc(path).filter``).

The tokenizer drops white space before anything else, so a text is encoded
piece by piece between ASCII white space, a word apart from the stops after it,
each distinct one of a slice of texts once, and a worker keeps the ids of recent
ones: the result is that of encoding the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.llm.arrowtext import LOWER, NOT_SPACE, Texts, Words, slices, spelled, words

END_ID = 1
SLICE = 4_000_000
#: Words that a worker remembers in each of two generations, and the longest of them.
REMEMBERED = 200_000
LONGEST = 64
FILE_SCHEMA = "doc_id bigint, block int, place bigint, n_tokens bigint, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(64 << 20),
    "compression": "lz4",
}

#: How byte-level vocabularies write bytes: printable ones as themselves, the others as letters from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {byte: 256 + k for k, byte in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}

#: Full stops and commas; ASCII letters and digits.
STOP, ASCII_ALNUM = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
STOP[[*b".,"]] = True
ASCII_ALNUM[48:58] = ASCII_ALNUM[65:91] = ASCII_ALNUM[97:123] = True

_encoders: dict[str, Encoder] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """What was made of recent keys, in two generations of bounded size."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def all(self, keys: Iterable[bytes], make: Callable[[list[bytes]], list[bytes]]) -> dict[bytes, bytes | None]:
        """The values of different keys, in their order; missing ones are made together."""
        young, old = self.young, self.old
        found = {key: young.get(key) for key in keys}
        again = {key: old[key] for key, value in found.items() if value is None and key in old}
        young |= again
        found |= again
        missing = [key for key, value in found.items() if value is None]
        for key, value in zip(missing, make(missing), strict=True):
            found[key] = value
            if len(key) <= LONGEST:
                young[key] = value
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return found


def parted(data: np.ndarray, pieces: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces cut into parts that the tokenizer always parts: a word, and the stops after it, if a letter or digit is before them.

    Gives the bytes, ASCII parts in lower case, the length of every part, and the first part of every piece and of none.
    """
    start, end = pieces.start, pieces.end
    cut = end.copy()
    left = np.arange(len(end))
    for _ in range(4):
        left = left[(cut[left] > start[left]) & STOP[data[cut[left] - 1]]]
        cut[left] -= 1
    for k in left.tolist():  # long runs of stops
        cut[k] = start[k] + len(data[start[k] : cut[k]].tobytes().rstrip(b".,"))
    whole = (cut == start) | ~ASCII_ALNUM[data[cut - 1]]
    cut[whole] = end[whole]
    two = cut < end
    first = np.concatenate([[0], np.cumsum(1 + two)])
    lengths = np.empty(first[-1], dtype=np.int64)
    lengths[first[:-1]] = cut - start
    lengths[first[1:][two] - 1] = (end - cut)[two]
    lowered = LOWER[data]
    beyond = np.flatnonzero(data > 127)
    if len(beyond):  # words with other bytes are left to the tokenizer as they are
        mixed = np.unique(np.searchsorted(start, beyond, side="right") - 1)
        sizes = end[mixed] - start[mixed]
        at = np.repeat(start[mixed] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        lowered[at] = data[at]
    return lowered, lengths, first


class Encoder:
    """A tokenizer that remembers the ids of recent words."""

    def __init__(self, name: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.words = Recent()

    def fresh(self, new: list[bytes]) -> list[bytes]:
        """Ids of words.  Latin letters alone are one part to the tokenizer, which its model can take as it is."""
        out: dict[bytes, bytes | None] = {}
        tokenize = self.tokenizer.model.tokenize
        for word in new:
            text = word.decode("utf-8", "replace").lower()
            if text.isalpha() and (text.isascii() or max(text) < "\u0250"):
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [token.id for token in tokenize(text)]
                out[word] = pack(f"<{len(ids)}I", *ids)
            else:
                out[word] = None
        rest = [word for word, ids in out.items() if ids is None]
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for word, e in zip(rest, found, strict=True):
            out[word] = pack(f"<{len(e.ids)}I", *e.ids)
        return [out[word] for word in new]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows with their end ids, and the number of each row."""
        found = words(texts, NOT_SPACE)
        data, lengths, first = parted(texts.data, found)
        codes, different = spelled(data, NOT_SPACE, lengths)
        _, ends, letters = different.buffers()
        bounds = np.frombuffer(ends, dtype=np.int64)[: len(different) + 1].tolist()
        raw = letters.to_pybytes() if len(different) else b""
        parts = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        distinct = list(self.words.all(parts, self.fresh).values())
        table = np.frombuffer(b"".join(distinct), dtype="<i4")
        size = np.array([len(x) // 4 for x in distinct], dtype=np.int64)
        begin = np.cumsum(size) - size
        sizes = size[codes]
        stops = np.cumsum(sizes)
        at = np.repeat((begin[codes] - (stops - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        flat = table[at]
        del at
        ends = np.concatenate([[0], stops])[first[found.offsets[1:]]]
        counts = np.diff(ends, prepend=0) + 1
        return np.insert(flat, ends, END_ID), counts


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encoded(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the file format, in ascending order of id (NULL first), an end id after each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for texts in slices(batch.column(1), SLICE):
                flat, n = encoder(name).encode(texts)
                stops = np.cumsum(n)
                offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(np.full(len(n), block, dtype=np.int32)),
                        pa.array(place + stops - n),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.int32())),
                    ],
                    names=["doc_id", "block", "place", "n_tokens", "ids"],
                )
                place += int(stops[-1])

    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The text's hash breaks ties, so that repeated ids come in the same order on every run.
    return ordered.orderBy("doc_id", F.xxhash64("text")).mapInArrow(run, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, name: str = "word_bpe_49k.json") -> None:
    """Encode and write all documents to a new folder."""
    encoded(docs, name).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``start`` in the sequence of all ids, count and CRC-32 of its ids.

    NULL and empty texts have the end id alone; rows with a NULL id come first;
    repeated ids stand one after the other, in order of text.  No documents, no rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            stops = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4").tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(stops).astype(np.int64)), pa.array(crc, type=pa.int64())],
                names=["doc_id", "block", "place", "n_tokens", "ids_crc32"],
            )

    files = read_tokens(spark, path)
    rows = files.select("doc_id", "block", "place", "ids").mapInArrow(
        sums, "doc_id bigint, block int, place bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # A handful of bytes per file: where each block begins.
    blocks = files.groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = blocks.select(F.col("block").alias("_block"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    return rows.join(begins, F.col("block") == F.col("_block")).select(
        "doc_id", (F.col("_begin") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
