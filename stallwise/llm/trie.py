"""Join of n-gram sets by Jaccard similarity, with prefix trees, and its components.

Two similar sets share an n-gram among the first few of each (the prefix), in any
order that is the same everywhere, and the fewer sets an n-gram is in, the earlier
it stands.  N-grams of one set alone lead nowhere.  Counting all n-grams of all
texts is dear, so it is done twice: first in an order where a quarter of them,
chosen by hash, comes before the others, so that only this quarter is counted in
nearly all texts.  Most sets turn out to have too many n-grams alone and drop
out.  Then all n-grams of the sets that are left are counted.

Equal sets are one node.  What is left is joined in rounds.  In every round each
prefix n-gram names one of its nodes, and that node is compared with the
others under the n-gram that aren't known to be connected with it: their sets
form a trie, most common n-grams first, and the named node's set walks it.  Sets
below a branch share its overlap, and a branch is left when what remains of its
lengths can't reach the threshold.  Rounds end when few pairs are open; then all
open pairs are compared in the same way.  So no link between different
components is missed, and large groups of near copies never make all pairs.

How many n-grams come before the shared one bounds the size of a similar set from
above, and the threshold does from below.  Sizes are cut into narrow bands, and an
entry meets only the bands it can have partners in.  Pairs of other sizes are
neither looked at nor taken for open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm import arrowtext as at
from stallwise.llm import repeats
from stallwise.llm.components import closer, components
from stallwise.llm.folders import kept
from stallwise.operators.joins import spread_join

GRAM = 4
#: Similarity of linked sets, in hundredths.
PERCENT = 85
#: N-grams below this hash are counted.
COUNTED = 1 << 62
#: Sets in a trie, and possible pairs per entry at which rounds end.
BRANCHES = 256
FEW = 64
ROUNDS = 6
#: The greatest size of a band is so many times the least.
BAND = 1.05


class Sets:
    """The sets of some rows: ascending hashes of different n-grams, row after row."""

    def __init__(self, texts: at.Texts, gram: int):
        data = at.LOWER[texts.data]
        words = at.words(texts, at.NOT_SPACE, data)
        hashes = at.span_hashes(data, words.start, words.end)
        n = words.counts()
        found, rows = [at.grams(hashes, gram)], [words.row[: max(0, len(hashes) - gram + 1)]]
        whole = words.offsets[1:][rows[0]] - np.arange(len(rows[0])) >= gram
        found, rows = [found[0][whole]], [rows[0][whole]]
        for size in range(1, gram):
            short = np.flatnonzero(n == size)
            if len(short):
                found.append(at.grams(hashes, size, seed=size)[words.offsets[short]])
                rows.append(short)
        gram_hash, row = np.concatenate(found), np.concatenate(rows)
        if len(found) > 1:
            order = np.argsort(row, kind="stable")
            gram_hash, row = gram_hash[order], row[order]
        edges = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            gram_hash[start:stop].sort()
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (gram_hash[1:] != gram_hash[:-1])
        self.grams, self.row = gram_hash[new], row[new]
        self.offsets = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.n = np.diff(self.offsets)
        prefix = repeats.prefix_hashes(self.grams)
        self.node = repeats.range_hashes(prefix, self.offsets[:-1], self.offsets[1:])
        sums = np.concatenate([[0], np.cumsum(self.grams < np.uint64(COUNTED))])
        self.first = sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def prefix(self, percent: int) -> np.ndarray:
        return self.n - -(-percent * self.n // 100) + 1

    def given(self, percent: int) -> np.ndarray:
        """Those of the n-grams that each set makes known: the first quarter, or its prefix if that is longer."""
        most = np.maximum(self.first, np.minimum(self.prefix(percent), self.n))
        return np.arange(len(self.grams)) - self.offsets[self.row] < most[self.row]


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent))


def band(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(BAND)).cast("int")


def walk(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Which sets are similar to the probe, by one walk through their trie.

    Sets are written in one order, the most common n-gram first, and sorted, so
    that they follow each other as the leaves of their trie do.  ``counts`` holds
    the overlap at every depth of the current path.
    """
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    values, codes, times = np.unique(everything, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(values))
    shared = np.empty(len(values), dtype=bool)
    shared[rank] = np.isin(values, probe, assume_unique=True)
    bounds = np.cumsum(sizes)[:-1]
    paths = [np.sort(p) for p in np.split(rank[codes], bounds)]
    order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">i8").tobytes())
    linked = [False] * len(sets)
    counts, last, dead = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    for k in order:
        path, size = paths[k], int(sizes[k])
        most = min(len(path), len(last))
        differ = np.flatnonzero(path[:most] != last[:most])
        depth = int(differ[0]) if len(differ) else most
        if dead is not None and depth >= dead[0] and size <= dead[1]:
            continue  # below a branch that was left, and no longer than what was tried there
        need = -(-percent * (len(probe) + size) // (100 + percent))
        before = counts[: depth + 1]
        counts = np.concatenate([before, before[-1] + np.cumsum(shared[path[depth:]])])
        last, dead = path, None
        if counts[-1] >= need:
            linked[k] = True
        else:
            # Where even full agreement from here on would be too little, the branch ends.
            hopeless = np.flatnonzero(counts + (size - np.arange(size + 1)) < need)
            if len(hopeless) and min(size, len(probe)) >= need:
                dead = (int(hopeless[0]), size)
    return linked


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar enough."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BRANCHES).alias("_tries"))
    dealt = spread_join(pairs, many, "a", "inner").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("_tries")).alias("tree")
    )
    wanted = dealt.select("a", "tree", F.lit(1).alias("leaf"), F.col("b").alias("node")).unionAll(
        dealt.select("a", "tree").distinct().select("a", "tree", F.lit(0).alias("leaf"), F.col("a").alias("node"))
    )
    loaded = spread_join(wanted, sets, "node", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, nodes, held = None, None, [], []

        def tried() -> pa.RecordBatch:
            marks = walk(probe, held, percent) if held else []
            links = [b for b, mark in zip(nodes, marks, strict=True) if mark]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(links), type=pa.int64()), pa.array(links, type=pa.int64())], names=["a", "b"]
            )

        for batch in batches:
            a, tree, leaf, node = (batch.column(k).to_pylist() for k in range(4))
            for k in range(batch.num_rows):
                if (a[k], tree[k]) != key:
                    if key is not None:
                        yield tried()
                    key, probe, nodes, held = (a[k], tree[k]), None, [], []
                grams = np.frombuffer(batch.column(4)[k].as_py(), dtype=np.uint64)
                if leaf[k]:
                    nodes.append(node[k])
                    held.append(grams)
                else:
                    probe = grams
        if key is not None:
            yield tried()

    grouped = loaded.select("a", "tree", "leaf", "node", "grams").repartition("a", "tree").sortWithinPartitions("a", "tree", "leaf", "node")
    return grouped.mapInArrow(run, "a bigint, b bigint")


class Join:
    """One join: tables of sets and prefix n-grams, and the rounds over them."""

    def __init__(self, docs: DataFrame, gram: int, percent: int, key: str, text: str):
        self.percent, self.gram = percent, gram
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.rows = self.rows.withColumn("row_key", row_key("doc_id", "text"))
        self.base = kept(self._base(), "sets")

    def _base(self) -> DataFrame:
        """Per document: the size of its set, its node, and how many of its n-grams are of the first quarter."""
        gram = self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, (ids, keys) in repeats.batches_of(batch, 0):
                    sets = Sets(texts, gram)
                    node = pa.array(at.as_long(sets.node), mask=sets.n == 0)
                    yield pa.RecordBatch.from_arrays(
                        [ids, keys, pa.array(sets.n), node, pa.array(sets.first)],
                        names=["doc_id", "row_key", "n", "node", "first"],
                    )

        schema = "doc_id bigint, row_key bigint, n bigint, node bigint, first bigint"
        return self.rows.select("text", "doc_id", "row_key").mapInArrow(run, schema)

    def _given(self, nodes: bool) -> DataFrame:
        gram, percent = self.gram, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, _ in repeats.batches_of(batch, 0):
                    sets = Sets(texts, gram)
                    given = sets.given(percent)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at.as_long(sets.grams[given])), pa.array(at.as_long(sets.node[sets.row[given]]))],
                        names=["gram", "node"],
                    )

        return self.rows.select("text").mapInArrow(run, "gram bigint, node bigint")

    def promising(self) -> DataFrame:
        """Nodes that have, by the first count, an n-gram in their prefix that others have too."""
        counts = self._given(False).groupBy("gram").agg(
            F.count(F.lit(1)).alias("times"), F.min("node").alias("x"), F.max("node").alias("y")
        )
        common = kept(counts.filter(F.col("x") != F.col("y")).select("gram", "times"), "grams")
        met = spread_join(self._given(True), common, "gram", "inner")
        late = (F.col("gram") < 0) | (F.col("gram") >= COUNTED)
        met = met.select("node", F.struct(late.alias("late"), "times", "gram").alias("entry"))
        listed = met.groupBy("node").agg(F.sort_array(F.collect_set("entry")).alias("entries"))
        known = self.base.filter(F.col("node").isNotNull()).groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"))
        listed = listed.join(known, "node")
        early = F.size(F.filter("entries", lambda e: ~e["late"]))
        listed = listed.withColumn("alone", F.col("first") - early)
        late = F.exists("entries", lambda e: e["late"])
        return listed.filter(late | ((early > 0) & (F.col("alone") < self.length()))).select("node")

    def length(self) -> Column:
        """How many n-grams a prefix has."""
        return F.col("n") - F.ceil(self.percent * F.col("n") / 100) + 1

    def prefixes(self, sets: DataFrame) -> DataFrame:
        """Prefix n-grams that several of the sets have: n-gram, node, its size, how many n-grams come before it, and how many it has alone."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    part = batch.slice(first, 256)
                    raw = [x.as_py() for x in part.column(1)]
                    row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                    grams = np.frombuffer(b"".join(raw), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), part.column(0).take(pa.array(row))], names=["gram", "node"])

        every = sets.select("node", "grams").mapInArrow(run, "gram bigint, node bigint")
        common = every.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > 1)
        met = spread_join(every, kept(common, "counts"), "gram", "inner")
        listed = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("entries"))
        listed = listed.join(sets.select("node", (F.octet_length("grams") / 8).cast("long").alias("n")), "node")
        listed = listed.withColumn("alone", F.col("n") - F.size("entries")).filter(F.col("alone") < self.length())
        inside = F.slice("entries", F.lit(1), (self.length() - F.col("alone")).cast("int"))
        spread = listed.select("node", "n", "alone", F.posexplode(inside).alias("k", "entry"))
        return spread.select("node", "n", "alone", F.col("entry.gram").alias("gram"), (F.col("alone") + F.col("k")).alias("before"))

    def sets(self, nodes: DataFrame) -> DataFrame:
        """The sets of some nodes, from one document of each."""
        gram = self.gram
        chosen = self.base.groupBy("node").agg(F.min("row_key").alias("row_key"))
        chosen = chosen.join(nodes, "node", "left_semi").select("row_key").distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, _ in repeats.batches_of(batch, 0):
                    sets = Sets(texts, gram)
                    own = [sets.grams[a:b].tobytes() for a, b in zip(sets.offsets[:-1], sets.offsets[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(at.as_long(sets.node)), pa.array(own)], names=["node", "grams"])

        found = spread_join(self.rows, chosen, "row_key", "left_semi").select("text").mapInArrow(run, "node bigint, grams binary")
        return found.groupBy("node").agg(F.min("grams").alias("grams"))

    def listed(self, entries: DataFrame) -> DataFrame:
        """The entries, once per band of the sizes that sets similar to theirs can have."""
        least = F.ceil(self.percent * F.col("n") / 100)
        most = F.floor((100 + self.percent) * (F.col("n") - F.col("before")) / self.percent) - F.col("n")
        some = entries.withColumns({"_least": least, "_most": most}).filter(F.col("_least") <= F.col("_most"))
        return some.withColumn("band", F.explode(F.sequence(band(F.col("_least")), band(F.col("_most"))))).drop("_least", "_most")

    def possible(self, left: DataFrame, right: DataFrame) -> float:
        """How many pairs ``candidates`` looks at: those under one n-gram and in one band."""
        sides = self.listed(left).select("gram", "band", F.lit(1).alias("p"), F.lit(0).alias("q")).unionAll(
            right.select("gram", band(F.col("n")).alias("band"), F.lit(0).alias("p"), F.lit(1).alias("q"))
        )
        met = sides.groupBy("gram", "band").agg(F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
        return met.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0

    def candidates(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs under one n-gram that may be similar: by size, and by what can follow the n-gram."""
        renamed = self.listed(left).select(*[F.col(c).alias(f"p_{c}") for c in ("gram", "node", "n", "before", "label", "band")])
        need = least_overlap(F.col("n"), F.col("p_n"), self.percent)
        same = F.col("gram").eqNullSafe(F.col("p_gram")) & (F.col("band") == F.col("p_band"))
        met = right.withColumn("band", band(F.col("n"))).join(renamed, same).filter(
            (F.col("label") != F.col("p_label"))
            & (F.col("n") - F.col("before") >= need)
            & (F.col("p_n") - F.col("p_before") >= need)
        )
        return met.select(F.col("p_node").alias("a"), F.col("node").alias("b"))

    def links(self) -> DataFrame:
        """Enough links to connect all that is connected: pairs of nodes ``a`` and ``b``."""
        sets = kept(self.sets(kept(self.promising(), "promising")), "grams")
        prefixes = kept(self.prefixes(sets), "prefixes")
        found, labels = None, None
        for turn in range(ROUNDS + 1):
            entries = prefixes.withColumn("label", F.col("node"))
            if labels is not None:
                entries = spread_join(prefixes, labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            # N-grams whose nodes are all connected have nothing more to say.
            by_label = entries.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("m"))
            totals = by_label.groupBy("gram").agg(
                F.sum("m").alias("m"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label"))["label"].alias("main")
            )
            open_grams = kept(totals.filter(F.col("labels") > 1), "open")
            nodes = open_grams.agg(F.sum("m")).first()[0]
            if not nodes:
                break
            entries = kept(spread_join(entries, open_grams.select("gram", "main"), "gram", "inner"), "entries")
            # Of two nodes that aren't connected, one at least is outside the main component.
            apart = entries if turn == 0 else entries.filter(F.col("label") != F.col("main"))
            last = turn == ROUNDS or (turn > 0 and self.possible(apart, entries) <= FEW * nodes)
            if last:
                open_pairs = self.candidates(apart, entries).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            else:
                # The node with the fewest n-grams of its own comes first, then others at random, outside the main component.
                chance = F.xxhash64("node", F.lit(turn))
                rank = F.struct(F.col("alone") if turn == 0 else F.lit(0), chance, "node", "n", "before", "label")
                named = apart.groupBy("gram").agg(F.min(rank).alias("p")).select("gram", "p.node", "p.n", "p.before", "p.label")
                open_pairs = self.candidates(named, entries)
            new = kept(verified(kept(open_pairs.distinct(), "pairs"), sets, self.percent), "links")
            found = new if found is None else found.unionAll(new)
            if last:
                break
            found = closer(found)
            labels = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        if found is None:
            return self.rows.sparkSession.createDataFrame([], "a bigint, b bigint")
        return found


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string"))


def _grouped(docs: DataFrame, gram: int, percent: int, key: str, text: str) -> DataFrame:
    """Per document: id, row key, size, and the label of its component (NULL without n-grams)."""
    join = Join(docs, gram, percent, key, text)
    labels = components(join.links())
    return spread_join(join.base, labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def linked_documents(
    docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``n_shingles``, and ``component_id``, the least id it is connected to.

    Words are lower-cased in A-Z; a text of fewer words than an n-gram is one
    n-gram as a whole.  NULL and empty texts have no n-grams and no links.
    Documents with equal sets are linked.  A row with a NULL id links like any
    other, but never names a component: its own is NULL if it has no other.
    Rows with the same id are rows of their own.  An empty table gives no rows.
    """
    rows = _grouped(docs, gram, percent, key, text)
    least = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    return spread_join(rows, least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def one_of_each(
    docs: DataFrame, gram: int = GRAM, percent: int = PERCENT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without near duplicates: of each component the row with the least id stays, NULL ids last.

    A row that is there twice stays once; rows without n-grams all stay.
    """
    rows = _grouped(docs, gram, percent, key, text)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    named = rows.filter(F.col("label").isNotNull()).groupBy("label").agg(first)
    alone = rows.filter(F.col("label").isNull()).select("row_key", F.lit(True).alias("bare")).distinct()
    keys = kept(named.select("first.row_key", F.lit(False).alias("bare")).unionAll(alone), "kept")
    keys = keys.groupBy(F.col("row_key").alias("_key")).agg(F.max("bare").alias("_bare"))
    whole = docs.select(F.struct("*").alias("_row"), row_key(key, text).alias("_row_key"))
    found = whole.join(keys, F.col("_row_key") == F.col("_key"))
    place = F.row_number().over(Window.partitionBy("_row_key").orderBy("_row_key"))
    return found.withColumn("_place", place).filter(F.col("_bare") | (F.col("_place") == 1)).select("_row.*")
