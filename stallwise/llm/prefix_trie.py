"""The trie of conversation prefixes, by a skeleton of splitters.

A conversation is a path: one digest of 16 bytes (of SHA-256) per turn, so equal
prefixes of paths are equal prefixes of conversations.  Paths are put in order
over range partitions, by path and id, so that equal conversations may lie in
several.  A prefix that occurs in two partitions is a prefix of the splitter
between them: the trie of the splitters' paths, the skeleton, is broadcast, at
most ``SKELETON`` nodes whatever the corpus.

1. Each sorted shard is read once with a stack of open prefixes.  A node outside
   the skeleton lies in one shard and is finished there, children and subtree
   included.
2. For a skeleton node the shard gives what it has of it: members, children and
   subtree sums of children outside the skeleton.  These are added up by node,
   and from the deepest skeleton node to the root.
3. The ids that end at a skeleton node are given in pieces of text, in order of
   shards, and hashed piece by piece, as a digest can be made in order only.

Splitters come from a sample, which decides about balance and not about results.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.folders import kept
from stallwise.llm.mixing import n_words

#: Bytes of a turn's digest in a path.
WIDTH = 16
#: Sampled conversations per shard, and turns per shard at most where they can be parted.
SAMPLED = 32
SHARD_TURNS = 500_000
#: Nodes of the skeleton at most: deeper splitters are cut to a common depth.
SKELETON = 100_000
#: Characters of ids in one piece.
PIECE = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

PATHS = "conv_id bigint, path binary, words array<bigint>"
FOUND = (
    "kind int, node int, parent int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, words bigint, shard int, piece int, text string"
)
NAMES = [field.split()[0] for field in FOUND.split(", ")]
FINISHED, PARTIAL, ENDS = 0, 1, 2
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string"
)
COLUMNS = [field.split()[0] for field in NODES.split(", ")]


def own_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order (NULL first, equal ones by digest) with digest and words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), n_words(text).alias("words")
    ).filter(F.col("conv_id").isNotNull())
    own = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    return turns.groupBy("conv_id").agg(own.alias("own"))


def path_of(turns: Column) -> list[Column]:
    digests = F.array_join(F.transform(turns, lambda t: t["digest"]), "")
    return [F.unhex(digests).alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def plain_paths(conversations: DataFrame) -> DataFrame:
    """Conversations as they are."""
    return own_turns(conversations).select("conv_id", *path_of(F.col("own")))


def rebuilt_paths(conversations: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversation ``c`` begins with turns of ``c - c % every`` in place of its own: CRC-32 of ``c`` modulo ``most + 1`` of them."""
    own = own_turns(conversations)
    heads = own.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("own", 1, most).alias("_head")
    )
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left").withColumn("_n", n)
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_n")), F.slice("own", 1, 0))
    turns = F.concat(head, F.slice("own", F.col("_n") + 1, F.size("own")))
    return met.select("conv_id", turns.alias("_turns")).select("conv_id", *path_of(F.col("_turns")))


class Skeleton:
    """Splitters, and the trie of their paths: node numbers by (number of the parent, digest), the root is 0."""

    def __init__(self, sample: list[tuple[bytes, int]], shards: int):
        sample = sorted(sample)
        weights, total = [], 0
        for path, _ in sample:
            total += 1 + len(path) // WIDTH
            weights.append(total)
        cuts = {bisect_right(weights, total * k // shards) for k in range(1, shards)}
        chosen = [sample[i] for i in sorted(cuts) if i < len(sample)]
        depth = self._depth([len(path) // WIDTH for path, _ in chosen])
        # A shorter path is as good a boundary; no id is less than the least.
        shorter = [(p, c) if len(p) <= depth * WIDTH else (p[: depth * WIDTH], -(1 << 63)) for p, c in chosen]
        self.splitters = sorted(set(shorter))
        self.nodes: dict[tuple[int, bytes], int] = {}
        self.parents, self.depths = [-1], [0]
        for path, _ in self.splitters:
            node = 0
            for at in range(0, len(path), WIDTH):
                step = (node, path[at : at + WIDTH])
                if step not in self.nodes:
                    self.nodes[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(self.depths[node] + 1)
                node = self.nodes[step]

    @staticmethod
    def _depth(depths: list[int]) -> int:
        """The greatest depth at which all splitters together have at most ``SKELETON`` nodes."""
        low, high = 1, max(depths, default=1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(min(d, middle) for d in depths) <= SKELETON else (low, middle - 1)
        return low


class Open:
    """A prefix on the stack."""

    __slots__ = ("below", "children", "ends", "least", "leaves", "members", "node", "pieces", "saved", "size", "words")

    def __init__(self, node: int, words: int):
        self.node, self.words = node, words
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.below: list[tuple] = []
        self.ends, self.pieces, self.size = None, 0, 0


class Shard:
    """Reads sorted paths of one shard and gives rows of ``FOUND``."""

    def __init__(self, number: int, skeleton: dict[tuple[int, bytes], int], put: Callable[[tuple], None]):
        self.number, self.skeleton, self.put = number, skeleton, put
        self.stack, self.path = [Open(0, 0)], b""

    def read(self, conv_id: int, path: bytes, words: list[int]) -> None:
        depth, shared = len(path) // WIDTH, 0
        longest = min(depth, len(self.stack) - 1)
        while shared < longest and path[shared * WIDTH : (shared + 1) * WIDTH] == self.path[shared * WIDTH : (shared + 1) * WIDTH]:
            shared += 1
        while len(self.stack) - 1 > shared:
            self.close()
        for at in range(shared, depth):
            node = self.stack[-1].node
            if node >= 0:
                node = self.skeleton.get((node, path[at * WIDTH : (at + 1) * WIDTH]), -1)
            self.stack.append(Open(node, words[at]))
        self.path = path
        self.end(self.stack[-1], conv_id)

    def end(self, top: Open, conv_id: int) -> None:
        top.members += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        if top.node < 0:
            if top.ends is None:
                top.ends = hashlib.sha256(b"%d" % conv_id)
            else:
                top.ends.update(b",%d" % conv_id)
        else:
            text = str(conv_id)
            top.ends = top.ends or []
            top.ends.append(text)
            top.size += len(text) + 1
            if top.size >= PIECE:
                self.piece(top)

    def piece(self, top: Open) -> None:
        if top.ends:
            self.put((ENDS, top.node, *[None] * 10, self.number, top.pieces, ",".join(top.ends)))
            top.ends, top.size, top.pieces = [], 0, top.pieces + 1

    def close(self) -> None:
        top = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        depth = len(self.stack)
        for conv_id, *rest in top.below:
            self.put((FINISHED, None, None if top.node < 0 else top.node, conv_id, depth + 1, None if top.node >= 0 else top.least, *rest, *[None] * 4))
        if above is not None:
            above.members += top.members
            above.least = top.least if above.least is None else min(above.least, top.least)
        if top.node >= 0:
            self.piece(top)
            self.put((PARTIAL, top.node, None, top.least, depth, None, top.members, top.children, top.leaves, top.saved, None, top.words, *[None] * 3))
            return
        leaves = top.leaves if top.children else 1
        saved = top.saved + (top.members - 1) * top.words
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        row = (top.least, top.members, top.children, leaves, saved, top.ends.hexdigest() if top.ends else NO_ENDS)
        if above.node < 0:
            above.below.append(row)
        else:  # whose own id only the reduction knows
            self.put((FINISHED, None, above.node, row[0], depth, None, *row[1:], *[None] * 4))

    def finish(self) -> None:
        while self.stack:
            self.close()


def shards_of(paths: DataFrame) -> int:
    turns = paths.agg(F.sum(F.size("words"))).first()[0] or 0
    return max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))


def skeleton_of(paths: DataFrame, shards: int) -> Skeleton | None:
    """Splitters for so many shards from a sample by hash of the id; None without conversations."""
    n = paths.count()
    if not n:
        return None
    share = min(10_000, -(-10_000 * SAMPLED * shards // n))
    sample = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(10_000)) < share).select("path", "conv_id")
    return Skeleton([(bytes(r["path"]), r["conv_id"]) for r in sample.collect()], shards)


def in_shards(paths: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """Paths in order, each shard in a partition."""
    splitters = paths.sparkSession.sparkContext.broadcast(skeleton.splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
            shard = [bisect_right(splitters.value, key) for key in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, type=pa.int32())], names=["conv_id", "path", "words", "shard"])

    dealt = paths.mapInArrow(deal, f"{PATHS}, shard int")
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


def searched(sorted_paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished nodes, parts of skeleton nodes, and pieces of the ids that end at these."""
    nodes = sorted_paths.sparkSession.sparkContext.broadcast(skeleton.nodes)
    kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard: Shard | None = None

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            ids, paths, words, numbers = (c.to_pylist() for c in batch.columns)
            for conv_id, path, counts, number in zip(ids, paths, words, numbers, strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                    shard = Shard(number, nodes.value, rows.append)
                shard.read(conv_id, path, counts)
                if len(rows) >= 8192:
                    yield batch_of()
        if shard is not None:
            shard.finish()
        if rows:
            yield batch_of()

    return sorted_paths.mapInArrow(run, FOUND)


def ends_of_skeleton(pieces: DataFrame) -> DataFrame:
    """The digest of the ids of each skeleton node; a task holds one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own == node:
                    digest.update(b"," + text.encode())
                    continue
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(text.encode())
        if digest is not None:
            done.append((node, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in done], type=pa.int32()), pa.array([d for _, d in done], type=pa.string())], names=["node", "ends"]
        )

    ordered = pieces.select("node", "shard", "piece", "text").repartition("node").sortWithinPartitions("node", "shard", "piece")
    return ordered.mapInArrow(run, "node int, ends string")


def skeleton_rows(found: DataFrame, skeleton: Skeleton) -> dict[int, list]:
    """Skeleton nodes by number: parts added up by node, then subtrees from the deepest node to the root."""
    parts = found.filter(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words")
    )
    ends = {r[0]: r[1] for r in ends_of_skeleton(found.filter(F.col("kind") == ENDS)).collect()}  # at most SKELETON rows
    rows = {r[0]: list(r)[1:] for r in parts.collect()}
    out: dict[int, list] = {}
    for node in sorted(rows, reverse=True):
        least, members, children, leaves, saved, words = rows[node]
        leaves = leaves if children else 1
        saved += (members - 1) * words
        parent = skeleton.parents[node]
        if parent >= 0:
            above = rows[parent]
            above[2] += 1
            above[3] += leaves
            above[4] += saved
        out[node] = [least, skeleton.depths[node], rows[parent][0] if parent >= 0 else None, members, children, leaves, saved, ends.get(node, NO_ENDS)]
    return out


def prefix_nodes(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the paths (columns of ``PATHS``, ids different), the empty one included.

    Without paths there is no row.  A path is held whole by one row, as a text
    is, at some 30 bytes a turn.
    """
    paths = kept(paths, "paths")
    shards = shards_of(paths)
    skeleton = skeleton_of(paths, shards)
    if skeleton is None:
        return spark.createDataFrame([], NODES)
    found = kept(searched(in_shards(paths, skeleton, shards), skeleton), "nodes")
    rows = skeleton_rows(found, skeleton)
    tops = spark.createDataFrame([(n, *row) for n, row in rows.items()], f"node int, {NODES}")
    # At most SKELETON rows of two numbers.
    owners = F.broadcast(tops.select(F.col("node").alias("parent"), F.col("conv_id").alias("_owner")))
    finished = found.filter(F.col("kind") == FINISHED).drop("node").join(owners, "parent", "left")
    finished = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_owner"))
    return finished.select(*COLUMNS).unionAll(tops.select(*COLUMNS))


def prefix_report(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations.  Rows without conv_id belong to none; equal rows are turns of their own."""
    return prefix_nodes(conversations.sparkSession, rebuilt_paths(conversations))
