"""Sharding by a k-d tree over metadata.

A node is split where its bytes, ordered by its widest dimension, reach the share of its left half.
The weighted medians come from histograms: each pass sums bytes by node and bucket of the order key,
keeps the bucket in which the median lies, and looks only into that bucket in the next pass, so no
row is sorted or moved and all nodes of a level share the passes. Ties of the dimension are ordered
by a hash of the text, so that equal texts lie side by side and a cut keeps them together while that
costs no more than the tolerance; a larger group is cut by a hash of the identifier.

Defined results: a null text has no bytes and one byte is added for every row, so empty rows count;
null metadata counts as 0; rows that repeat an identifier may be parted only if all their keys differ;
an empty table gives no rows. The tree has one node per split, so its size follows the number of
shards (MAX_LEAVES at most, beyond which a ValueError tells so), never that of the rows; a row finds its
node by an expression whose size doesn't depend on the tree. Columns beyond those named pass through
``shard_documents`` unread; one named shard_no is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, remove, scratch, written

MAX_LEAVES = 1 << 17
#: Order keys have 96 bits in three parts of 32: dimension, text hash, identifier hash.
PARTS, PART_BITS, DIGIT_BITS = 3, 32, 11
#: A median may miss its share by this part of the node's bytes, so as to keep equal texts together.
TOLERANCE = 0.002


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def low32(col: Column) -> Column:
    return col.bitwiseAND(F.lit((1 << PART_BITS) - 1))


def text_dimensions(text_col: str = "text") -> list[Column]:
    """Bytes, bytes beyond one a character, and white-space marks: equal texts have equal coordinates."""
    text = F.col(text_col)
    return [F.octet_length(text), F.octet_length(text) - F.char_length(text), F.regexp_count(text, F.lit(SPACE))]


def coordinates(id_col: str, text_col: str, dims: Sequence[Column]) -> list[Column]:
    """Size z, tie keys d1 and d2, and the dimensions k0, k1 ... as numbers from 0 to 2^32 - 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbers = [F.coalesce(d.cast("long"), F.lit(0).cast("long")) for d in dims]
    top = F.lit((1 << PART_BITS) - 1)
    return [
        byte_size(F.col(text_col)).alias("z"), low32(F.xxhash64(text)).alias("d1"), low32(F.xxhash64(F.col(id_col), F.lit("shard"))).alias("d2"),
        *[F.least(F.greatest(d, F.lit(0)), top).alias(f"k{i}") for i, d in enumerate(numbers)],
    ]


def numbers(values: Sequence[float], kind: str = "bigint") -> Column:
    """A constant array, which Spark folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Tree:
    """Boxes by number: the leaves below each, its dimension and cut once it is split, and its children; a leaf is its own child."""

    def __init__(self, leaves: int):
        self.leaves, self.first, self.depth = [leaves], [0], [0]
        self.dim, self.cut, self.low, self.high = [0], [(0,) * PARTS], [0], [0]

    def split(self, node: int, dim: int, cut: tuple[int, ...]) -> None:
        left = self.leaves[node] // 2
        self.dim[node], self.cut[node] = dim, cut
        self.low[node], self.high[node] = len(self.leaves), len(self.leaves) + 1
        for leaves, first in ((left, self.first[node]), (self.leaves[node] - left, self.first[node] + left)):
            here = len(self.leaves)
            self.leaves.append(leaves), self.first.append(first), self.depth.append(self.depth[node] + 1)
            self.dim.append(0), self.cut.append((0,) * PARTS), self.low.append(here), self.high.append(here)

    def open(self) -> list[int]:
        return [n for n, leaves in enumerate(self.leaves) if leaves > 1 and self.low[n] == n]

    def node(self, dims: int) -> Column:
        """The number of the box in which a row lies, found by a walk from the root."""
        if not max(self.depth):
            return F.lit(0).cast("long")
        dim, low, high = numbers(self.dim), numbers(self.low), numbers(self.high)
        cuts = [numbers([c[k] for c in self.cut]) for k in range(PARTS)]

        def step(at: Column, _: Column) -> Column:
            of = lambda values: F.get(values, at.cast("int"))
            below = F.lit(False)
            for part, cut in reversed([*zip(order_key(of(dim), dims), cuts, strict=True)]):
                below = (part < of(cut)) | ((part == of(cut)) & below)
            return F.when(below, of(low)).otherwise(of(high))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth))), F.lit(0).cast("long"), step)

    def shard(self, dims: int) -> Column:
        return F.get(numbers(self.first), self.node(dims).cast("int")).cast("int")


def order_key(dim: Column, dims: int) -> list[Column]:
    return [F.get(F.array(*[F.col(f"k{i}") for i in range(dims)]), dim.cast("int")), F.col("d1"), F.col("d2")]


def grow(rows: DataFrame, leaves: int, dims: int, tolerance: float = TOLERANCE) -> Tree:
    """The tree over rows of coordinates(). Each level takes one pass for the extents and a few for the medians."""
    tree = Tree(leaves)
    whole = rows.agg(*[F.min(f"k{i}").alias(f"a{i}") for i in range(dims)], *[F.max(f"k{i}").alias(f"b{i}") for i in range(dims)]).first()
    width = [max(1, (whole[f"b{i}"] or 0) - (whole[f"a{i}"] or 0)) for i in range(dims)]
    while todo := tree.open():
        labelled = rows.withColumn("node", tree.node(dims))
        # One row for each box comes back.
        found = labelled.groupBy("node").agg(F.sum("z").alias("z"), *[f(f"k{i}").alias(f"{x}{i}") for x, f in (("a", F.min), ("b", F.max)) for i in range(dims)]).collect()
        extents, state = {r["node"]: r for r in found}, {}
        for n in todo:
            r = extents.get(n)
            if r is None:  # no rows: any cut will do
                tree.split(n, 0, (0,) * PARTS)
                continue
            dim = max(range(dims), key=lambda i: ((r[f"b{i}"] - r[f"a{i}"]) / width[i], -i))
            share = tree.leaves[n] // 2 / tree.leaves[n]
            state[n] = {"dim": dim, "goal": r["z"] * share, "slack": r["z"] * tolerance, "before": 0, "part": 0, "prefix": (), "lo": r[f"a{dim}"], "hi": r[f"b{dim}"], "best": None}
        boxes = len(tree.leaves)
        while state:
            state = refine(labelled, tree, state, boxes, dims)
    return tree


def refine(labelled: DataFrame, tree: Tree, state: dict[int, dict], boxes: int, dims: int) -> dict[int, dict]:
    """One pass of histograms for all boxes of state; splits those whose median is near enough."""
    for s in state.values():
        s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // (1 << DIGIT_BITS)))
        s["p0"], s["p1"] = (*s["prefix"], 0, 0)[:2]
    of = lambda name, kind="bigint": F.get(numbers([state[n][name] if n in state else 0 for n in range(boxes)], kind), F.col("node").cast("int"))
    key, part = order_key(of("dim"), dims), of("part")
    value = F.get(F.array(*key), part.cast("int"))
    inside = (of("step") > 0) & value.between(of("lo"), of("hi")) & ((part < 1) | (key[0] == of("p0"))) & ((part < 2) | (key[1] == of("p1")))
    bucket = F.floor((value - of("lo")) / of("step"))
    counts = labelled.filter(inside).groupBy("node", bucket.alias("bucket")).agg(F.sum("z").alias("z"))
    # A box has at most 2^DIGIT_BITS buckets, whatever the number of documents; one row for each box comes back.
    upto = F.sum("z").over(Window.partitionBy("node").orderBy("bucket")) + of("before")
    at = F.struct("bucket", "z", upto.alias("upto"))
    judged = counts.select("node", at.alias("at")).withColumn("goal", of("goal", "double"))
    reached = judged.groupBy("node").agg(F.coalesce(F.min(F.when(F.col("at.upto") > F.col("goal"), F.col("at"))), F.max("at")).alias("at")).collect()
    left = {}
    for r in reached:
        s, at = state[r["node"]], r["at"]
        run = s["before"] = at["upto"] - at["z"]
        lo = s["lo"] + at["bucket"] * s["step"]
        hi = min(s["hi"], lo + s["step"] - 1)
        pad = (0,) * (PARTS - s["part"] - 1)
        # A cut before the bucket leaves goal - run too little on the left; one behind it, upto - goal too much.
        for miss, edge in ((abs(s["goal"] - run), lo), (abs(at["upto"] - s["goal"]), hi + 1)):
            if s["best"] is None or miss < s["best"][0]:
                s["best"] = (miss, (*s["prefix"], edge, *pad))
        if s["best"][0] <= s["slack"] or (lo == hi and s["part"] == PARTS - 1):
            tree.split(r["node"], s["dim"], s["best"][1])
            continue
        if lo == hi:
            s |= {"part": s["part"] + 1, "prefix": (*s["prefix"], lo), "lo": 0, "hi": (1 << PART_BITS) - 1}
        else:
            s |= {"lo": lo, "hi": hi}
        left[r["node"]] = s
    return left


def shard_documents(
    docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: Sequence[Column] | None = None,
    name: str = "shard_no",
) -> DataFrame:
    """docs with a column name, from 0; one that is there is replaced.

    Give the number of leaves, or target_bytes, from which it follows. The dimensions are expressions
    over docs, by default those of text_dimensions.
    """
    path = scratch(docs.sparkSession, "sharding")
    dims = text_dimensions(text_col) if dims is None else dims
    rows = written(docs.select(*coordinates(id_col, text_col, dims)), f"{path}/rows")
    if leaves is None:
        leaves = max(1, -(-(rows.agg(F.sum("z")).first()[0] or 0) // target_bytes))
    if leaves > MAX_LEAVES:
        raise ValueError(f"{leaves} shards; the tree is held on the driver, for {MAX_LEAVES} at most")
    tree = grow(rows, leaves, len(dims))
    remove(docs.sparkSession, path)
    kept = [c for c in docs.columns if c != name]
    placed = docs.select(F.struct(*kept).alias("row"), *coordinates(id_col, text_col, dims))
    return placed.select("row", tree.shard(len(dims)).alias("shard")).select("row.*", F.col("shard").alias(name))


def numbered(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with slot, gapless from 0 in each shard_no.

    A shard is dealt over hash buckets of the identifier; a row's slot is the number of rows in the
    buckets before its own, plus its place by identifier within it. Give it narrow rows: they are
    shuffled once. There are 256 buckets a shard at least, and 100,000 rows a bucket or fewer on average.
    """
    path = scratch(rows.sparkSession, "slots")
    rows = written(rows, f"{path}/rows")
    buckets = 256
    while buckets * 100_000 < rows.count():
        buckets *= 2
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), F.lit("slot")), F.lit(buckets)))
    counts = dealt.groupBy("shard_no", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard_no", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("shard_no", "bucket").orderBy(id_col)) - 1
    return dealt.withColumn("place", place).join(counts, ["shard_no", "bucket"]).withColumn("slot", F.col("first") + F.col("place")).drop("bucket", "place", "first")
