"""Self-join of documents on the Jaccard similarity of their word n-grams.

The document by n-gram matrix is taken in blocks of columns, the partitions of the n-gram hash.
Documents with equal sets are one row of it. Of a row only the part that a similarity of the threshold
must touch is kept: the n - ceil(t n) + 1 rarest n-grams, where those found in many documents of a
one-in-SAMPLE trial come last. Products of rows are summed by pair; a pair goes on only if the sizes
allow the threshold and its summed overlap plus what either row has left reaches the bound that follows
from the sizes. What goes on is verified on the whole sets.

Groups of near copies would give products of all their pairs. So each column with LARGE rows or more
first ties them to one of its rows, the first in one of ORDERS orders; the TIES ties of a row that look
closest by a sketch are verified, and rows that these links already join are not multiplied with one
another again, as no product among them can change a component. Frequent columns are kept only by rows
made of little else, which they gather in clusters; a cluster is multiplied in blocks of about
ROWS_A_BLOCK rows or SHINGLES_A_BLOCK n-grams, whole sets at a time, and a block gives only the links
that join components in it. Blocks of one component, and of sizes too far apart, are left out; the work on
the others grows with the square of a cluster. Sets count as equal if 64-bit sums over their n-grams are.

Defined results: a null text, or one without words, has an empty set and links with nothing; with
fewer words than n the whole sequence is the only n-gram; equal sets link; each row has its own set,
also where an identifier repeats or is null, and a component is named by the least identifier in it, or
by null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import released, remove, scratch, unused, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: One document in SAMPLE shows which n-grams are frequent: those in two or more of the trial's documents.
#: The MAX_FREQUENT most frequent are put last; any order gives the same result.
SAMPLE, MAX_FREQUENT = 16, 1 << 20
#: Rows from which a column is large, ties of a row that are verified, and the least similarity by the sketch for that.
LARGE, TIES, TIE = 12, 4, 0.5
SKETCH, ORDERS = 64, 4
ROWS_A_BLOCK, SHINGLES_A_BLOCK, COLUMNS_A_BLOCK = 512, 200_000, 4096
SALTS = 64
CACHE_WORDS = 200_000
SET_BYTES = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Hashes are ordered as unsigned, but stored as signed numbers; with this bit flipped those compare in the same order.
TOP_BIT = -(1 << 63)

_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a UTF-8 text; words lie between white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    size = min(n, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + w[k : len(w) - size + 1 + k]
    return np.unique(finished(h + np.uint64(size)))


def binary_texts(batch: pa.RecordBatch, k: int) -> list[bytes | None]:
    return batch.column(k).cast(pa.binary()).to_pylist()


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def all_shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t, n) for t in binary_texts(batch.slice(at, 500), 0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    return released(run, _known)


ROWS = "id long, key long, node long, n int, kept array<long>, frequent int, sketch binary"


def sketched(h: np.ndarray) -> bytes:
    """A byte of the least hash in each of SKETCH parts of the hash range."""
    at = np.searchsorted(h, np.arange(SKETCH, dtype=np.uint64) << np.uint64(58))
    return np.append(h, np.uint64(0))[at].astype(np.uint8).tobytes()


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, pivot and the share of equal bytes in their sketches."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).mean(axis=1) if batch.num_rows else [], pa.float64())], names=["node", "pivot", "alike"])


def kept_rows(shared, n: int, num: int, den: int):
    """Identifier, locator, row of the matrix, size of the set, and its kept n-grams, the last `frequent` of which are frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                nodes, sizes, kept, late, sketches = [], [], [], [], []
                for text in binary_texts(some, 1):
                    h = shingles(text, n)
                    sizes.append(len(h))
                    nodes.append(int(finished(h * MULTIPLIER + np.uint64(len(h))).sum().view(np.int64)) if len(h) else None)
                    keep = len(h) - -(-num * len(h) // den) + 1 if len(h) else 0
                    if len(frequent) and len(h):
                        common = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                        first = h[~common][:keep]
                        last = h[common][: keep - len(first)]
                    else:
                        first, last = h[:keep], h[:0]
                    kept.append(np.concatenate([first, last]))
                    late.append(len(last))
                    sketches.append(sketched(h))
                columns = [some.column(0), some.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists(kept), pa.array(late, pa.int32()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "node", "n", "kept", "frequent", "sketch"])

    return released(run, _known)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, salt, node), with those of a run together and in an order of its own: those that share h and salt with another, with the first node of their run, and whether the run is large.

    Rows with a salt of 0 or more are part of a column that is dealt over several runs, which is large, and all stay.
    Fewer than LARGE rows of the last run of a batch wait for the next; of a large run only its key and first node.
    """
    held = [np.zeros(0, np.int64)] * 3
    known: tuple[int, int, int] | None = None  # h, salt and first node of the last run, once it is large
    for batch in chain(batches, [None]):
        fresh = held if batch is None else [np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
        h, salt, node = fresh
        if not len(h):
            continue
        begins = np.ones(len(h), bool)
        begins[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(h)))
        pivot, seen = node[start], size.copy()
        if known is not None and known[:2] == (int(h[0]), int(salt[0])):
            pivot[0], seen[0] = known[2], LARGE
        large = (seen >= LARGE) | (salt[start] >= 0)
        upto = len(h) if batch is None or large[-1] else int(start[-1])
        held = [x[upto:] for x in fresh]
        known = (int(h[-1]), int(salt[-1]), int(pivot[-1])) if large[-1] else None
        keep = np.repeat(large | (size > 1), size)[:upto]
        columns = (h[:upto], salt[:upto], node[:upto], np.repeat(pivot, size)[:upto], np.repeat(large, size)[:upto])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["h", "salt", "node", "pivot", "large"])


def packed_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes() for t in binary_texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "packed"])

    return released(run, _known)


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the size of their sets' intersection, from a, b and both sets."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = np.concatenate([unpacked(x), unpacked(y)])
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["a", "b", "overlap"])


def block_links(num: int, den: int):
    """Of each group of rows (side, comp, node, packed): links between components that join them, as few as do."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, comp, node = (table.column(k).to_numpy() for k in ("side", "comp", "node"))
        sets = [unpacked(x) for x in table.column("packed").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times[column] > 1
        owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        overlap = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_A_BLOCK):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS_A_BLOCK])
            dense = np.zeros((len(sets), COLUMNS_A_BLOCK), np.float32)
            dense[owner[lo:hi], column[lo:hi] - at] = 1
            overlap += dense[left] @ dense[right].T
        total = size[left][:, None] + size[right][None, :]
        a, b = np.nonzero((overlap * (den + num) >= total * num) & (comp[left][:, None] != comp[right][None, :]))
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(left[a].tolist(), right[b].tolist(), strict=True):
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[x] = y
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def locator(id_: Column, text: Column) -> Column:
    """A hash that rows share only if both identifier and text are equal, nulls included."""
    return F.xxhash64(id_, F.coalesce(text, F.lit("")), id_.isNull())


def sizes_allow(na: Column, nb: Column, num: int, den: int) -> Column:
    return F.least(na, nb) * den >= F.greatest(na, nb) * num


def enough(overlap: Column, na: Column, nb: Column, num: int, den: int) -> Column:
    """overlap / union >= num / den, in whole numbers."""
    return overlap * (den + num) >= (na + nb) * num


class NgramJoin:
    """The join of one table; links and components are tables in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, threshold: tuple[int, int] = (NUMERATOR, DENOMINATOR)):
        self.spark, self.n, (self.num, self.den) = docs.sparkSession, n, threshold
        self.path = scratch(self.spark, "ngrams")
        id_ = F.col(id_col).cast("long")
        self.docs = docs.select(id_.alias("id"), F.col(text_col).alias("text"), locator(id_, F.col(text_col)).alias("key"))
        self._rows()
        self._columns()
        ties = self._ties()
        links = self._verified(ties, "ties")
        comps = components(links)
        more = self._verified(self._products(comps), "products")
        self._drop("entries")
        known = written(links.select("a", "b").unionByName(more.select("a", "b")), f"{self.path}/known")
        self.links = written(known.unionByName(self._clusters(components(known))), f"{self.path}/links")
        self.node_comps = components(self.links)
        self._drop("known", "columns", "clustered", "placed", "cluster-links", "clusters-sets", *(f"{name}{end}" for name in ("ties", "products") for end in ("", "-links")))

    def _drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            remove(self.spark, f"{self.path}/{name}")

    def _rows(self) -> None:
        trial = self.docs.filter(F.pmod(F.xxhash64("id", F.lit("trial")), F.lit(SAMPLE)) == 0).select("text")
        seen = trial.mapInArrow(all_shingles(self.n), "h long").groupBy("h").count().filter("count > 1")
        seen = written(seen, f"{self.path}/seen")
        # The least count that MAX_FREQUENT n-grams reach or exceed at most.
        least, total = 2, 0
        for r in seen.groupBy("count").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("count")).limit(MAX_FREQUENT).toLocalIterator():
            if total + r["k"] > MAX_FREQUENT:
                least = r["count"] + 1
                break
            total += r["k"]
        frequent = np.sort(np.array([r[0] for r in seen.filter(F.col("count") >= least).select("h").collect()], np.int64).view(np.uint64))
        shared = self.spark.sparkContext.broadcast(frequent)
        rows = self.docs.mapInArrow(kept_rows(shared, self.n, self.num, self.den), ROWS)
        self.rows = written(rows, f"{self.path}/rows")
        self._drop("seen")
        last = F.struct((F.col("frequent") > 0).alias("f"), F.element_at("kept", -1).bitwiseXOR(F.lit(TOP_BIT)).alias("h"))
        some = self.rows.filter("n > 0").select("node", "id", "key", "n", F.size("kept").alias("p"), last.alias("last"), "sketch", "kept", "frequent")
        least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("least")
        # Copies are one row from here on; Spark combines them on the map side.
        same = [F.first(c).alias(c) for c in ("n", "p", "last", "sketch", "kept", "frequent")]
        self.nodes = written(some.groupBy("node").agg(least, F.min("key").alias("key"), *same), f"{self.path}/nodes")
        self.rows = written(self.rows.select("id", "key", "node", "n"), f"{self.path}/narrow")
        self._drop("rows")

    def _columns(self) -> None:
        """Entries of columns with two rows or more, each tied to the first row of its run."""
        at = F.posexplode("kept").alias("pos", "h")
        entries = self.nodes.select("node", "frequent", "p", at)
        # A frequent column may hold a large part of all rows and is dealt over SALTS runs.
        salt = F.when(F.col("pos") >= F.col("p") - F.col("frequent"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(-1)).cast("long")
        # Rows with much in common come first in the same columns: such ties are few, and their number tells.
        first = F.xxhash64("node", F.pmod("h", F.lit(ORDERS)))
        dealt = entries.select("h", salt.alias("salt"), "node").repartition("h", "salt").sortWithinPartitions("h", "salt", first)
        self.columns = written(dealt.mapInArrow(released(runs), "h long, salt long, node long, pivot long, large boolean"), f"{self.path}/columns")

    def _ties(self) -> DataFrame:
        ties = self.columns.filter("large and node <> pivot").select("node", "pivot").unionByName(self._heads()).distinct()
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        ties = ties.join(side("node"), "node").join(side("pivot"), "pivot").filter(sizes_allow(F.col("n_node"), F.col("n_pivot"), self.num, self.den))
        judged = ties.select("node", "pivot", "s_node", "s_pivot").mapInArrow(released(alike), "node long, pivot long, alike double").filter(F.col("alike") >= TIE)
        # A row has a tie for each of its kept n-grams at most.
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("alike"), "pivot"))
        chosen = judged.withColumn("best", best).filter(F.col("best") <= TIES)
        return self._sized(chosen.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())

    def _heads(self) -> DataFrame:
        """node, pivot: the first rows of the runs of a column that is dealt over several, tied to the least of them."""
        first = self.columns.filter("salt >= 0").select("h", "salt", "pivot").distinct()
        least = first.groupBy("h").agg(F.min("pivot").alias("least"))
        return first.join(least, "h").filter("pivot <> least").select(F.col("pivot").alias("node"), F.col("least").alias("pivot")).distinct()

    def _sized(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"), F.col("last").alias(f"last_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def _products(self, comps: DataFrame) -> DataFrame:
        """Pairs of rows in different components whose summed overlap and sizes leave the threshold within reach.

        Only over columns that aren't frequent: pairs that share a frequent one are in a cluster.
        """
        entries = self.columns.filter("salt < 0").select("h", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        entries = written(entries, f"{self.path}/entries")
        groups = entries.select("h", "comp").distinct()
        several = groups.groupBy("h").count().filter("count > 1").select("h")
        groups = groups.join(several, "h")
        cross = groups.withColumnRenamed("comp", "ca").join(groups.withColumnRenamed("comp", "cb"), "h").filter("ca < cb")
        side = lambda x: entries.select("h", F.col("comp").alias(f"c{x}"), F.col("node").alias(x))
        pairs = cross.join(side("a"), ["h", "ca"]).join(side("b"), ["h", "cb"])
        counted = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        sized = self._sized(counted)
        # What the row whose kept part ends first has left is all that can still overlap.
        left = F.when(F.col("last_a") < F.col("last_b"), F.col("na") - F.col("pa")).otherwise(F.col("nb") - F.col("pb"))
        equal = F.col("last_a") == F.col("last_b")
        reach = F.col("c") + F.when(equal, F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))).otherwise(left)
        return sized.filter(sizes_allow(F.col("na"), F.col("nb"), self.num, self.den) & enough(reach, F.col("na"), F.col("nb"), self.num, self.den))

    def _clusters(self, comps: DataFrame) -> DataFrame:
        """a, b of links that join components among the rows that share frequent columns."""
        ties = self.columns.filter("salt >= 0 and node <> pivot").select("node", "pivot").unionByName(self._heads())
        clusters = components(ties.distinct(), "node", "pivot").withColumnRenamed("comp", "cluster")
        rows = clusters.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = rows.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("cluster")
        # A row's part of a block; sizes of one class may reach the threshold, as may those of neighbouring ones.
        part = F.greatest(F.lit(1 / ROWS_A_BLOCK), F.col("n") / SHINGLES_A_BLOCK).alias("part")
        class_ = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num)).alias("class")
        rows = rows.join(several, "cluster").join(self.nodes.select("node", "n", part, class_), "node")
        rows = written(rows.select("cluster", "comp", "node", "n", "part", "class"), f"{self.path}/clustered")
        # Components of a block or more have blocks of their own; the others share blocks by class of size.
        large = rows.groupBy("cluster", "comp").agg(F.ceil(F.sum("part")).alias("blocks")).filter("blocks > 1")
        dealt = rows.join(large, ["cluster", "comp"], "left")
        own = F.when(F.col("blocks").isNotNull(), F.col("comp"))
        shared = dealt.filter("blocks is null").groupBy("cluster", "class").agg(F.ceil(F.sum("part")).alias("shared"))
        number = F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.pmod(F.xxhash64("comp"), "shared"))
        block = F.xxhash64(own, F.when(own.isNull(), F.col("class")), number, own.isNull())
        placed = dealt.join(shared, ["cluster", "class"], "left").select("cluster", "comp", "node", "n", block.alias("block"))
        placed = written(placed, f"{self.path}/placed")
        sets = self._sets(placed.select("node").distinct(), "clusters")
        blocks = placed.groupBy("cluster", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
        near = f"x.most * {self.den} >= y.least * {self.num} and y.most * {self.den} >= x.least * {self.num}"
        pairs = blocks.alias("x").join(blocks.alias("y"), "cluster").filter(f"x.block <= y.block and not (x.lo = y.lo and x.hi = x.lo and y.hi = y.lo) and {near}")
        pairs = pairs.select("cluster", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
        sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(1).alias("side")))).otherwise(
            F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(2).alias("side"))))
        needed = pairs.select("cluster", "i", "j", F.inline(sides))
        tasks = placed.join(sets, "node").join(needed, ["cluster", "block"]).select("cluster", "i", "j", "side", "comp", "node", "packed")
        found = tasks.groupBy("cluster", "i", "j").applyInArrow(block_links(self.num, self.den), "a long, b long")
        return written(found, f"{self.path}/cluster-links")

    def _sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """node, packed: the whole sets of some rows, from their texts."""
        wanted = written(nodes.join(self.nodes, "node").select("node", "key"), f"{self.path}/{name}-wanted")
        # Rows with equal keys have the same text and are brought together before they meet the rows of the matrix.
        texts = marked(self.docs, wanted).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
        sets = written(texts.select("node", "text").mapInArrow(packed_sets(self.n), "node long, packed binary"), f"{self.path}/{name}-sets")
        self._drop(f"{name}-wanted")
        return sets

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """a, b, overlap, na, nb of the pairs that reach the threshold, on whole sets."""
        pairs = written(pairs.select("a", "b", "na", "nb"), f"{self.path}/{name}")
        sets = self._sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), name)
        side = lambda x: sets.select(F.col("node").alias(x), F.col("packed").alias(f"s{x}"))
        found = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(released(overlaps), "a long, b long, overlap long")
        found = written(found.join(pairs, ["a", "b"]).filter(enough(F.col("overlap"), F.col("na"), F.col("nb"), self.num, self.den)), f"{self.path}/{name}-links")
        self._drop(f"{name}-sets")
        return found

    def labelled(self) -> DataFrame:
        """id, n_shingles, component_id for every row of the table, its key, and whether it stands for its component."""
        named = self.nodes.join(self.node_comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = named.groupBy("comp").agg(F.min("least").alias("head"))
        by_node = written(named.join(least, "comp").select("node", "head"), f"{self.path}/by_node")
        out = self.rows.select("id", "key", "node", "n").join(by_node, "node", "left")
        stands = (F.col("n") == 0) | F.coalesce(F.col("key") == F.col("head.key"), F.lit(False))
        return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("head.id", "id").alias("component_id"), "key", stands.alias("stands"))


def marked(docs: DataFrame, wanted: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """docs without most of the rows whose key isn't wanted: a bitmap of hashed keys is broadcast, 32 MB at most."""
    n, bits = wanted.count(), 1 << 16
    while bits < min(8 * n, max_bits):
        bits *= 2
    spot = F.pmod(F.xxhash64("key"), F.lit(bits))
    bitmap = wanted.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bitmap"))
    placed = docs.withColumn("bucket", F.bitmap_bucket_number(spot)).withColumn("bit", F.bitmap_bit_position(spot)).join(F.broadcast(bitmap), "bucket")
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return placed.filter(F.expr(f"shiftright({byte}, cast(bit % 8 as int)) % 2 = 1")).select(*docs.columns)


def one_of_each(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with its least identifier. Rows without words, or without an identifier, stay."""
    key = locator(F.col(id_col).cast("long"), F.col(text_col))
    k, o = unused("key", docs.columns), unused("once", docs.columns)
    # Of rows with words that are equal in identifier and text, one stands for the others.
    once = (F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)
    kept = labelled.filter("stands and id is not null").groupBy(F.col("key").alias(k)).agg(once.alias(o))
    left = docs.withColumn(k, key).join(kept, k)
    if not kept.filter(F.col(o)).isEmpty():
        left = left.filter(~F.col(o)).unionByName(left.filter(F.col(o)).dropDuplicates([k]))
    return left.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
