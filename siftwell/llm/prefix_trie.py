"""Prefix tries of conversations: which turns conversations share from their start, and what sharing them saves.

A conversation is a sequence of turns (role and text); each distinct sequence of first turns is a node.

* Texts stay where they are: a turn is shuffled as two 64-bit hashes and a number of bytes.  Turns are dealt by ranges of
  conversation and turn, so that a conversation of any length is numbered by many tasks, and a node's key, the hashes of its
  turns with their places, XORed, is a running sum whose blocks of ``BLOCK`` turns add up.
* Members of a node meet in partial aggregates, however many share a turn.  The numbers of those that end there are joined by
  4,096s first and hashed as a sorted stream, so no list of them is held.
* Nodes that one conversation alone reaches are a path, whose rollups are known: they count as a leaf of the node above and
  enter no trie.  The others form it.  Nodes with over ``SHARD_TURNS`` turns of members below are its upper levels; each node
  below hangs on the first light node of its path (found by pointer jumping), and such prefix shards are of bounded size.
  Shards become level-order (LOUDS) bitvectors and label arrays, whose rollups are sums from the last level to the first.
  Their tops add up by upper node, and the upper levels, some hundred thousand nodes at most at a time, are rolled up likewise.

Defined cases: rows without a conversation belong to none; a null role or text is empty; null turns come first, and turns of
equal numbers (repeated rows among them) are all kept, in the order of their hashes.  Texts of any length are read where they
are.  An empty table has no node, not even a root.  Other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Turns of members below a node up to which it is light; and nodes of upper levels that one task rolls up.
SHARD_TURNS, UPPER_NODES = 200_000, 200_000
#: Positions of one block of a running sum, as a power of two; ends of a node that are joined to one text, likewise.
BLOCK, ENDS = 12, 12
KEY, PARENT = ["k1", "k2"], ["p1", "p2"]


# --- Turns ------------------------------------------------------------------------------------------------------------


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, h1, h2, bytes)``: every turn's hashes and its place in its conversation, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = [F.col("turn").asc_nulls_first(), "h1", "h2"]
    parts = materialize(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    local = parts.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) - 1)
    # A part has at most one conversation that began before it, so this table has a row for each part at most.
    sizes = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).filter("before is not null").select("conv_id", "part", "before")
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "h1", "h2", "bytes")


def grafted(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``numbered`` turns of conversations that begin with up to ``most - 1`` turns of another, by the crc32 of their number.

    Conversation c takes the first h = crc32(c) % ``most`` turns of the largest multiple of ``every`` up to it, and its own after
    its first h.  All conversations of ``turns`` are there; those that have no turn left have one row without a place.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("long")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    convs = sizes.withColumns({"h": h, "base": base})
    n_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(n_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).select("conv_id", "base", "h", "taken", (F.col("n") <= F.col("h")).alias("none_left"))
    heads = turns.filter((F.pmod("conv_id", F.lit(every)) == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    first = convs.filter("conv_id <> base").join(heads, "base").filter("place < h").select("conv_id", "place", "h1", "h2", "bytes")
    own = turns.join(convs.select("conv_id", "base", "h", "taken"), "conv_id").filter("conv_id = base or place >= h")
    own = own.select("conv_id", F.when(F.col("conv_id") == F.col("base"), F.col("place")).otherwise(F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "bytes")
    nothing = convs.filter("none_left and taken = 0 and conv_id <> base").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("place", "h1", "h2", "bytes")])
    return first.unionByName(own).unionByName(nothing)


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, p1, p2, bytes, size)``: the node of each turn, the node above it, and the conversation's turns."""
    own = {"x1": F.xxhash64("place", "h1", "h2"), "x2": F.xxhash64("h2", "place", "h1")}
    rows = materialize(turns.filter("place is not null").select("conv_id", "place", "bytes", *[c.alias(n) for n, c in own.items()], F.shiftright("place", BLOCK).alias("block")), "rebuilt")
    within = Window.partitionBy("conv_id", "block").orderBy("place")
    local = rows.withColumns({"r1": F.bit_xor("x1").over(within), "r2": F.bit_xor("x2").over(within)})
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count("*").alias("n"))
    earlier, all_ = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in (1, 2)], F.sum("n").over(all_).alias("size"))
    key = lambda i: F.col(f"r{i}").bitwiseXOR(F.col(f"o{i}"))
    joined = local.join(blocks, ["conv_id", "block"])
    return joined.select("conv_id", (F.col("place") + 1).alias("depth"), *[key(i).alias(f"k{i}") for i in (1, 2)], *[key(i).bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "bytes", "size")


# --- Tries ------------------------------------------------------------------------------------------------------------


class Louds:
    """A forest in level order: for each node, a one for each child and a zero; before them, those of a node above all roots."""

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        """``parent``: place of each node's parent among the nodes as given, or -1."""
        n = len(parent)
        by = np.lexsort((label, parent))
        first = np.searchsorted(parent[by], np.arange(-1, n))
        counts = np.diff(np.append(first, n))  # of the children of node i - 1
        self.starts, level, order = [0], by[: counts[0]], []
        while len(level):
            order.append(level)
            self.starts.append(self.starts[-1] + len(level))
            c = counts[level + 1]
            level = by[np.repeat(first[level + 1] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        #: Place as given of each node in level order.
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        degrees = np.concatenate([counts[:1], counts[self.order + 1]])
        bits = np.ones(n + len(degrees), bool)
        bits[np.cumsum(degrees) + np.arange(len(degrees))] = False
        self.n_bits, self.bits = len(bits), np.packbits(bits)
        self.labels = label[self.order]

    def parents(self) -> np.ndarray:
        """In level order: a node is the one bit of its number, its parent the number of zeros before that, less one."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.n_bits))
        return ones - np.arange(len(ones)) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, of values in level order."""
        total, parent = values.copy(), self.parents()
        for a, b in zip(self.starts[-2:0:-1], self.starts[:1:-1], strict=True):
            np.add.at(total, parent[a:b], total[a:b])
        return total


def _rolled(table: pa.Table) -> pa.Table:
    t = table.to_pandas()
    places = pd.DataFrame({"p1": t["k1"], "p2": t["k2"], "at": np.arange(len(t))})
    parent = t[PARENT].merge(places, on=PARENT, how="left")["at"].fillna(-1).to_numpy(np.int64)
    trie = Louds(parent, (t["k1"] ^ t["p1"]).to_numpy())
    out = {c: np.empty(len(t), np.int64) for c in ("leaves", "saved")}
    for c, x in out.items():
        x[trie.order] = trie.rollup(t[c].to_numpy()[trie.order])
    return pa.table({"k1": table["k1"], "k2": table["k2"], **{c: pa.array(x) for c, x in out.items()}})


def _roll(nodes: DataFrame, group: Column) -> DataFrame:
    """``k1, k2, leaves, saved`` summed over subtrees within each group; roots hang on nodes outside, by other keys than any inside."""
    return nodes.select(*KEY, *[F.coalesce(p, F.lit(-1)).alias(p) for p in PARENT], "leaves", "saved", group.alias("group")).groupBy("group").applyInArrow(_rolled, "k1 long, k2 long, leaves long, saved long")


def _shard_tops(light: DataFrame) -> DataFrame:
    """``k1, k2, u1, u2``: the topmost light node above each (or itself), by pointer jumping."""
    cur = materialize(light.select(*KEY, *[F.when(F.col("p_light"), F.col(p)).otherwise(F.col(k)).alias(u) for p, k, u in (("p1", "k1", "u1"), ("p2", "k2", "u2"))]), "tops")
    while True:
        further = cur.select(*[F.col(k).alias(u) for k, u in (("k1", "u1"), ("k2", "u2"))], F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        cur = materialize(cur.join(further, ["u1", "u2"]).select(*KEY, F.col("v1").alias("u1"), F.col("v2").alias("u2"), ((F.col("u1") != F.col("v1")) | (F.col("u2") != F.col("v2"))).alias("moved")), "tops")
        if cur.filter("moved").limit(1).count() == 0:
            return cur.drop("moved")
        cur = cur.drop("moved")


def _added(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """Adds to ``leaves`` and ``saved`` what the tops ``below`` (with ``p1, p2``) sum up to."""
    sums = below.groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY)]).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    return nodes.join(sums, KEY, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")


def rollups(nodes: DataFrame, shard_turns: int = SHARD_TURNS, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """``k1, k2, leaves, saved`` over subtrees, of a written table of nodes ``k1, k2, p1, p2, depth, turns, leaves, saved`` with
    ``p_turns``, the turns of the node above; turns are those of members below, which never grow downwards."""
    total, n = nodes.agg(F.coalesce(F.max("turns"), F.lit(0)), F.count("*")).first()
    most = max(shard_turns, -(-total // upper_nodes))  # then no level has more than upper_nodes heavy nodes
    nodes = nodes.withColumns({"light": F.col("turns") <= most, "p_light": F.coalesce(F.col("p_turns") <= most, F.lit(False))})
    light = nodes.filter("light")
    bins = max(1, -(-n // shard_turns))
    out = materialize(_roll(light.join(_shard_tops(light), KEY), F.pmod(F.xxhash64("u1", "u2"), F.lit(bins)).cast("int")), "light")
    heavy = nodes.filter("not light")
    tops = light.filter("not p_light").select(*KEY, *PARENT).join(out, KEY)
    per_depth = heavy.groupBy("depth").count().orderBy(F.col("depth").desc()).collect()
    while per_depth:
        size, last = 0, per_depth[0]["depth"]
        while per_depth and size + per_depth[0]["count"] <= max(upper_nodes, per_depth[0]["count"]):
            size, first = size + per_depth[0]["count"], per_depth.pop(0)["depth"]
        band = materialize(_added(heavy.filter(F.col("depth").between(first, last)), tops), "band")
        done = materialize(_roll(band, F.lit(0)), "heavy")
        out = out.unionByName(done)
        tops = tops.unionByName(band.filter(F.col("depth") == first).select(*KEY, *PARENT).join(done, KEY))
    return out


def _streamed(batches):
    """The hash of each node's ends, from texts sorted by node and number."""
    key, sha, found = None, None, []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[], [], []]
        found.clear()
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=[*KEY, "ends_sha256"])

    for b in batches:
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if (k1, k2) == key:
                sha.update(b",")
            else:
                if key:
                    found.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256()
            sha.update(ids.encode())
        if len(found) > 10_000:
            yield batch()
    if key:
        found.append((*key, sha.hexdigest()))
    yield batch()


def _ends(ending: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` for ``(k1, k2, conv_id)``."""
    some = ending.groupBy(*KEY, F.shiftright("conv_id", ENDS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return some.repartition(*KEY).sortWithinPartitions(*KEY, "range").mapInArrow(_streamed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS, upper_nodes: int = UPPER_NODES) -> DataFrame:
    """The trie of ``(conv_id, place, h1, h2, bytes)``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` per node."""
    turns = materialize(turns, "rebuilt")
    rows = materialize(paths(turns), "paths")
    zero = F.lit(0).cast("long")
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")]
    nodes = rows.groupBy(*KEY).agg(*members, *[F.max(c).alias(c) for c in (*PARENT, "depth", "bytes")], F.sum(F.col("size") - F.col("depth") + 1).alias("turns"), F.count_if(F.col("depth") == F.col("size")).alias("n_ends"))
    sizes = turns.groupBy("conv_id").agg(F.count("place").alias("size"))
    root = sizes.agg(*members, F.sum(F.col("size") + 1).alias("turns"), F.count_if(F.col("size") == 0).alias("n_ends")).filter("n_convs > 0")
    root = root.withColumns({c: zero for c in (*KEY, "depth", "bytes")} | {c: F.lit(None).cast("long") for c in PARENT})
    nodes = materialize(nodes.unionByName(root), "nodes")
    ends = _ends(rows.filter("depth = size").select(*KEY, "conv_id").unionByName(sizes.filter("size = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")))

    shared = nodes.filter("n_convs > 1 or depth = 0")
    children = nodes.filter("depth > 0").groupBy(*[F.col(p).alias(k) for p, k in zip(PARENT, KEY)]).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    above = shared.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT)], F.col("conv_id").alias("p_conv"), F.col("turns").alias("p_turns"))
    inner = shared.join(children, KEY, "left").join(above, PARENT, "left").fillna(0, ["n_children", "n_single"])
    own = {"leaves": F.col("n_single") + F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": (F.col("n_convs") - 1) * F.col("bytes")}
    inner = materialize(inner.withColumns(own), "shared")
    totals = rollups(inner, shard_turns, upper_nodes)
    whole = inner.drop("leaves", "saved").join(totals, KEY).select(*KEY, "conv_id", "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs", "n_children", "leaves", "saved")
    # One conversation's own nodes: a path down to where it ends.
    single = nodes.filter("n_convs = 1 and depth > 0").join(above, PARENT, "left")
    single = single.select(*KEY, "conv_id", "depth", F.coalesce("p_conv", "conv_id").alias("parent_conv_id"), "n_convs", (F.lit(1) - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("leaves"), zero.alias("saved"))
    out = whole.unionByName(single).join(ends, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, graft: bool = True, **how) -> DataFrame:
    """The trie of a table ``conv_id, turn, role, text``, its conversations ``grafted`` first or as they are."""
    turns = materialize(numbered(conversations), "numbered")
    return prefix_trie(grafted(turns) if graft else turns, **how)
