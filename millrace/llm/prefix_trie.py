"""The trie of conversations' prefixes, with what a prefix cache would save.

Turns become digests, positions are numbered without a task that holds a whole conversation, and every
prefix becomes a node, known by its digest. Digests chain within stretches of STRETCH turns; over the
stretches of longer conversations they are combined in doubling rounds, so that a long conversation takes
rounds by the logarithm of its length. Leaves and savings are summed over subtrees by pointer jumping:
each round adds what stands 2^k edges below a node and doubles its pointer.

Defined results: rows without conv_id belong to no conversation and are left out; turns that tie are put in
order of their digests, equal ones stand side by side; null roles and texts are empty; a conversation whose
turns all fall away is a member of the root alone; an empty table has no members and so no nodes; columns
beyond conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remove, scratch, written

#: Turns whose digests chain in one row.
STRETCH = 32
#: Conversations by hundreds share the first turns of the hundred's first one; that many at most, less one.
FAMILY, HEADS = 100, 6
#: Identifiers of one row on the way to a node's digest of members.
ENDS = 4096
#: 128 bits of SHA-256, as bytes.
DIGEST = "unhex(left(sha2({}, 256), 32))"


def digest_of(*parts: str) -> Column:
    return F.expr(DIGEST.format(f"concat({', '.join(parts)})"))


def numbered_turns(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, place from 1, digest, chars: each conversation's turns in order.

    Rows are dealt by ranges of (conversation, turn), so that a long conversation spans many partitions; a
    row's place is its number in its range plus the rows in ranges before. Only conversations that cross
    a boundary have such rows: fewer than there are partitions, so they are broadcast.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", digest_of("length(role)", "':'", "role", "text").alias("digest"), F.length("text").cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(salted.repartitionByRange(parts, "conv_id", *order, "salt").withColumn("part", F.spark_partition_id()).drop("salt"), f"{path}/ranged")
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    crossing = counts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n")).alias("all")).filter(F.size("all") > 1)
    before = F.expr("aggregate(filter(all, x -> x.part < one.part), 0L, (s, x) -> s + x.n)")
    offsets = crossing.select("conv_id", "all", F.explode("all").alias("one")).select("conv_id", F.col("one.part").alias("part"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).cast("long")
    placed = ranged.withColumn("place", place).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "chars")


def rebuilt(own: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, digest, chars, length of every rebuilt turn; and conv_id, length of every conversation.

    The first h turns come from the first conversation of the same hundred, h by a hash of the identifier.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    known = heads.groupBy("base").agg(F.count(F.lit(1)).alias("known"))
    convs = own.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = convs.join(known, "base", "left").withColumn("k", F.least("h", F.coalesce("known", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), f"{path}/convs")
    first = convs.filter("k > 0").join(heads, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "chars", "length")
    rest = own.join(convs, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars", "length")
    return first.unionByName(rest), convs.select("conv_id", "length")


def chained(start: str, items: str = "items") -> Column:
    """The running digests of a stretch, from start on."""
    step = DIGEST.format("concat(acc[size(acc) - 1], x.digest)")
    return F.expr(f"slice(aggregate({items}, array({start}), (acc, x) -> concat(acc, array({step}))), 2, size({items}))")


def prefixes(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, depth, key, parent, chars, ends: a row for each conversation and node on its path, but for the root.

    A key depends on the turns up to it alone: within a stretch digests chain from the key that ends the
    stretch before, and that key combines whole stretches by doubling.
    """
    item = F.struct("depth", "digest", "chars")
    stretch = F.floor((F.col("depth") - 1) / STRETCH)
    rows = written(turns.groupBy("conv_id", "length", stretch.alias("stretch")).agg(F.sort_array(F.collect_list(item)).alias("items")), f"{path}/stretches")
    whole = rows.filter(F.size("items") == STRETCH).select("conv_id", "stretch", F.element_at(chained("unhex('')"), -1).alias("upto"))
    whole = written(whole, f"{path}/whole0")
    reach, most = 1, whole.agg(F.max("stretch")).first()[0] or 0
    while reach <= most:
        earlier = whole.select("conv_id", (F.col("stretch") + reach).alias("stretch"), F.col("upto").alias("earlier"))
        joined = whole.join(earlier, ["conv_id", "stretch"], "left")
        whole = written(joined.select("conv_id", "stretch", F.when(F.col("earlier").isNull(), F.col("upto")).otherwise(digest_of("earlier", "upto")).alias("upto")), f"{path}/whole{reach}")
        reach *= 2
    start = whole.select("conv_id", (F.col("stretch") + 1).alias("stretch"), F.col("upto").alias("start"))
    rows = rows.join(whole, ["conv_id", "stretch"], "left").join(start, ["conv_id", "stretch"], "left").withColumn("start", F.coalesce("start", F.expr("unhex('')")))
    keys = rows.withColumn("keys", chained("start")).withColumn("keys", F.expr(f"IF(upto IS NULL, keys, concat(slice(keys, 1, {STRETCH - 1}), array(upto)))"))
    zipped = keys.select("conv_id", "length", F.explode(F.arrays_zip("items", "keys", F.expr("concat(array(start), slice(keys, 1, size(keys) - 1))").alias("parents"))).alias("x"))
    return zipped.select("conv_id", F.col("x.items.depth").alias("depth"), F.col("x.keys").alias("key"), F.col("x.parents").alias("parent"), F.col("x.items.chars").alias("chars"), (F.col("x.items.depth") == F.col("length")).alias("ends"))


def rolled_up(values: DataFrame, deepest: int, path: str) -> DataFrame:
    """key, leaves, saved summed over subtrees; values holds key, up (the parent's key, null at the root), leaves and saved.

    After round k a row holds the sums down to 2^k - 1 edges below it, and points 2^k edges up. What points
    to one node is summed on the map side first; looking up a pointer's pointer is a join whose many
    equal keys adaptive execution splits.
    """
    reach, now = 1, written(values, f"{path}/round0")
    while reach <= deepest:
        below = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = now.filter("up IS NOT NULL").select(F.col("key").alias("up"), F.col("up").alias("next"))
        more = lambda name: (F.col(name) + F.coalesce(f"more_{name}", F.lit(0))).alias(name)
        joined = now.join(below, "key", "left").select("key", "up", more("leaves"), more("saved"))
        now = written(joined.join(jump, "up", "left").select("key", F.col("next").alias("up"), "leaves", "saved"), f"{path}/round{reach}")
        reach *= 2
    return now.select("key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def hashed_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, block) with their members as text; one digest for each key. Holds one digest's state."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(members.encode())
            else:
                state.update(b"," + members.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of conv_id in ascending order. Rows of ENDS identifiers' range go to their key's task, which holds one at a time."""
    blocks = ends.groupBy("key", F.floor(F.col("conv_id") / ENDS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", F.array_join("ids", ",").alias("members"))
    return ordered.mapInArrow(hashed_members, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    path = scratch(spark, "trie")
    own = written(numbered_turns(conversations, path), f"{path}/own")
    turns, convs = rebuilt(own, path)
    on_path = written(prefixes(turns, path), f"{path}/prefixes")
    made = on_path.groupBy("key", "parent", "depth", "chars").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.expr("unhex('')").alias("key"), F.expr("CAST(NULL AS BINARY)").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    nodes = written(root.unionByName(made), f"{path}/nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), f"{path}/counted")
    values = nodes.select("key", F.col("parent").alias("up"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sums = rolled_up(values, nodes.agg(F.max("depth")).first()[0] or 0, path)
    last = on_path.filter("ends").select("key", "conv_id").unionByName(convs.filter("length = 0").select(F.expr("unhex('')").alias("key"), "conv_id"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(sums, "key").join(member_digests(last), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    result = written(found.join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), f"{path}-result")
    remove(spark, path)
    return result
