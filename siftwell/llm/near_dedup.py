"""Near-duplicate documents by a chosen-path set similarity join.

Method.  Each document's set of word shingles is described by ``COORDINATES`` minwise tokens.  ``trees`` independent trees
branch the documents: the root of a tree parts them by one chosen minwise token, and every node that is still large parts
them again by tokens that a hash of its path chooses (``1 / threshold`` of them on average, so that a pair at the threshold
is expected to stay together on one branch at every depth).  Small nodes are compared exhaustively.  A pair at similarity s
stays together in a tree's first node with probability s: ten trees miss a pair at 0.8 with probability 0.2 ** 10.  Below a
large node a pair at the threshold stays together in one run of the branching with probability 0.58 after one round, 0.23 after
five, so each is branched ``COPIES`` times apart: ten trees then miss a pair that was never out of large nodes with probability
0.000005 after two rounds, 0.0008 after five.

Only components are asked for, so a node whose members are already connected needs no further comparison.  That keeps a
group of thousands of near copies from becoming all its pairs:

1. equal sets are one vertex;
2. in small nodes, the strongest spanning forest of the pairs whose minwise tokens agree enough; in large nodes, each member
   with two pivots, the second of which is the member most alike to the first and so lies near the middle of the node;
3. these links are confirmed on full sets; components;
4. nodes that still hold several components: all pairs across components; confirmed on full sets; components again.  A large
   node is branched further for that.  Where half of it is one component, which branching would copy to no use, where
   comparing is cheaper than copies (``MEDIUM``: some two thousand members), or where branching has not parted it in
   ``MAX_ROUNDS`` rounds, the members outside its largest component are compared with all of it exhaustively, block by block,
   on full sets.

The token filter before confirming passes pairs ``SIGMAS`` standard deviations below the threshold, so it misses one true
link in a thousand at the very threshold and fewer above.  All links meet ``100 * |A & B| >= percent * |A | B|`` on whole sets.

Hot groups: every join is between written tables, so that both its sides are plain exchanges and Spark can split the
partition of a set, or a component, that a third of all rows have.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; a text of fewer words than a
shingle has its whole sequence as one shingle; texts of any length are read whole; rows with one id are judged row by row, and
repeated rows are equal sets; null ids order after every other id, and a component of null ids alone has a null component_id;
an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import LAST_ID, id_and_text, materialize
from .components import connected_components

COORDINATES = 128
#: Standard deviations of the agreement of minwise tokens by which a pair may lie below the threshold.
SIGMAS = 3.1
#: Members up to which a node is compared exhaustively.
SMALL = 128
#: Members outside a node's largest component, times all its members, up to which it is compared exhaustively, block by block.
MEDIUM = 1 << 22
#: Branching steps between two counts of the nodes.
STEPS = 4
#: Counts of the nodes after which what is still large is compared block by block.
MAX_ROUNDS = 5
#: Runs of the branching below each large node, by different tokens.
COPIES = 4
#: Members of one block in the exhaustive comparison of a large node.
BLOCK = 256
SLAB = 2 << 20

_FACTOR = (np.random.default_rng(20240607).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slabs(batch, text: str = "text", most: int = SLAB):
    """Parts of an Arrow batch with about ``most`` bytes of text each (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's ``n``-word shingles, A to Z lower-cased."""
    buf, off = B.concat(texts)
    buf = _LOWER[buf]
    starts, ends, counts = B.words(buf, off)
    h = B.span_hash(buf, starts, ends - starts)
    first = np.concatenate([[0], np.cumsum(counts)])
    full, out = B.window_hash(h, n), []
    for i, c in enumerate(counts):
        a = first[i]
        out.append(B.distinct(full[a : a + c - n + 1]) if c >= n else B.window_hash(h[a : a + c], int(c), 7) if c else np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise tokens of non-empty sets: one row each, ``COORDINATES`` 32-bit numbers."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    sig = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        sig[:, i] = np.minimum.reduceat(((flat * _FACTOR[i]) >> np.uint64(32)).astype(np.uint32), start)
    return sig


_SKETCH = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("k", pa.int64()), ("sig", pa.binary())])


def _set_key(s: np.ndarray) -> int:
    """A 64-bit name of the set, from the sum of its items' hashes and their number."""
    total = int(B.mix(s * np.uint64(3)).sum()) + 0x9E3779B97F4A7C15 * len(s)
    return int(B.mix(np.array([total & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch):
                sets = shingle_sets(part.column("text"), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = [None] * len(sets)
                if full:
                    for i, row in zip(full, _signatures([sets[i] for i in full]), strict=True):
                        sig[i] = row.tobytes()
                yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array(sig, pa.binary())], schema=_SKETCH)

    return run


def _root_nodes(trees: int):
    """The first node of every tree: hash of the tree and the value of its token."""
    coordinate = np.random.default_rng(5).permutation(COORDINATES)[:trees]

    def run(batches):
        for b in batches:
            sig = _unpack(b.column("sig"))
            if not len(sig):
                continue
            node = B.mix(sig[:, coordinate].astype(np.uint64) + (np.arange(trees, dtype=np.uint64) + np.uint64(1) << np.uint64(40))).view(np.int64)
            yield pa.record_batch([pa.array(node.ravel()), pa.array(np.repeat(b.column("k").to_numpy(), trees))], names=["node", "k"])

    return run


def _unpack(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _children(threshold: float, copies: int):
    """``STEPS`` branching steps below each of a node's ``copies``: one chosen token, and a second one as often as ``1 / threshold`` asks."""
    second = int((1 / threshold - 1) * (1 << 32))

    def run(batches):
        for b in batches:
            sig = _unpack(b.column("sig"))
            node, row = np.repeat(b.column("node").to_numpy().view(np.uint64), copies), np.repeat(np.arange(b.num_rows), copies)
            if copies > 1:
                node = B.mix(node + (np.arange(len(node), dtype=np.uint64) % np.uint64(copies) << np.uint64(40)))
            for step in range(STEPS):
                pick = B.mix(node + np.uint64(0x1234567 + step))
                two = (pick >> np.uint64(32)) < second
                one = _step(node, pick % COORDINATES, sig, row)
                other = _step(node[two], (pick[two] + np.uint64(1) + (pick[two] >> np.uint64(8)) % (COORDINATES - 1)) % COORDINATES, sig, row[two])
                node, row = np.concatenate([one, other]), np.concatenate([row, row[two]])
            yield pa.record_batch([pa.array(node.view(np.int64)), b.column("k").take(pa.array(row)), b.column("root").take(pa.array(row))], names=["node", "k", "root"])

    return run


def _step(node, coordinate, sig, row):
    return B.mix(node * np.uint64(0x9E3779B97F4A7C15) + (coordinate.astype(np.uint64) << np.uint64(33)) + sig[row, coordinate.astype(np.int64)])


def least_agreement(threshold: float, sigmas: float = SIGMAS) -> int:
    return int(np.floor(COORDINATES * threshold - sigmas * np.sqrt(COORDINATES * threshold * (1 - threshold))))


def _agree(sig, n, i, j, percent):
    """Which pairs pass the size bound and the token filter, and how many tokens agree."""
    same = np.empty(len(i), np.int32)
    for a in range(0, len(i), 1 << 15):
        same[a : a + (1 << 15)] = (sig[i[a : a + (1 << 15)]] == sig[j[a : a + (1 << 15)]]).sum(1)
    big, small = np.maximum(n[i], n[j]), np.minimum(n[i], n[j])
    return (same >= least_agreement(percent / 100)) & (100 * small >= percent * big), same


def _pairs_in(starts, counts):
    """All pairs of positions within runs, in blocks of bounded size."""
    at = 0
    while at < len(starts):
        to = at + max(1, int(np.searchsorted(np.cumsum(counts[at:] * counts[at:]), 1 << 19, "right")))
        s, c = starts[at:to], counts[at:to]
        first = np.repeat(s, c) + B.window_offsets(c)
        reps = np.repeat(c, c) - 1 - B.window_offsets(c)
        i = np.repeat(first, reps)
        yield i, i + 1 + B.window_offsets(reps), np.repeat(np.repeat(np.arange(at, to), c), reps)
        at = to


def _node_pairs(percent: int, across: bool):
    """Candidate pairs of whole small nodes: the strongest spanning forest of each, or all pairs across components."""

    def run(key, table):
        table = table.sort_by([("node", "ascending"), ("k", "ascending")])
        node, k, n = (table.column(c).to_numpy() for c in ("node", "k", "n_shingles"))
        root = table.column("root").to_numpy()
        sig = _unpack(table.column("sig"))
        new = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        out_a, out_b = [], []
        for i, j, of in _pairs_in(new, np.diff(np.append(new, len(node)))):
            if across:
                far = root[i] != root[j]
                i, j, of = i[far], j[far], of[far]
            good, same = _agree(sig, n, i, j, percent)
            i, j, of, same = i[good], j[good], of[good], same[good]
            if not across and len(i):
                order = np.lexsort((-same, of))
                up: dict[int, int] = {}

                def find(x):
                    while (y := up.get(x, x)) != x:
                        x = y
                    return x

                pick = []
                for p in order.tolist():
                    x, y = find(int(i[p])), find(int(j[p]))
                    if x != y:
                        up[y] = x
                        pick.append(p)
                i, j = i[pick], j[pick]
            out_a.append(k[i])
            out_b.append(k[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def _stars(percent: int):
    """Members against the pivot of their block of a node: how many tokens agree, and whether the pair passes."""

    def run(key, table):
        table = table.sort_by([("node", "ascending"), ("part", "ascending"), ("is_pivot", "descending"), ("k", "ascending")])
        node, part, k, n = (table.column(c).to_numpy() for c in ("node", "part", "k", "n_shingles"))
        pivot = table.column("is_pivot").to_numpy()
        sig = _unpack(table.column("sig"))
        head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (part[1:] != part[:-1])]))
        of = np.repeat(head, np.diff(np.append(head, len(node))))
        i = np.flatnonzero(~pivot & pivot[of] & (k != k[of]))
        good, same = _agree(sig, n, i, of[i], percent)
        return pa.table({"node": node[i], "a": k[of[i]], "b": k[i], "same": same, "good": good})

    return run


def _star(members: DataFrame, pivots: DataFrame, percent: int, deals: int) -> DataFrame:
    """``(node, a, b, same, good)`` of every member with its node's pivot.

    Members stay in blocks of about ``BLOCK``, and each block gets a copy of the pivot, so a node with a third of all members
    is spread over as many blocks as it needs.  ``pivots``: the members that are pivots.
    """
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    columns = ["node", "part", "is_pivot", "k", "n_shingles", "sig"]
    rows = members.withColumn("part", F.pmod(F.xxhash64("k"), parts).cast("int")).withColumn("is_pivot", F.lit(False)).select(*columns)
    copies = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("is_pivot", F.lit(True)).select(*columns)
    deal = F.pmod(F.xxhash64("node", "part"), F.lit(deals)).cast("int")
    return rows.unionByName(copies).withColumn("deal", deal).groupBy("deal").applyInArrow(_stars(percent), "node long, a long, b long, same int, good boolean")


def _sets_of(n: int):
    def run(batches):
        for batch in batches:
            for part in slabs(batch):
                sets = shingle_sets(part.column("text"), n)
                yield pa.record_batch([part.column("k"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["k", "items"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirm(percent: int):
    def run(batches):
        for t in batches:
            pairs = zip(t.column("items_a").to_pylist(), t.column("items_b").to_pylist(), strict=True)
            keep = pa.array([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.record_batch([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    return run


def _blocks_compared(percent: int):
    """A block of outsiders against a block of members: one confirmed link per outsider and component at most."""

    def run(batches):
        for t in batches:
            a, b = [], []
            for few, many in zip(t.column("few").to_pylist(), t.column("many").to_pylist(), strict=True):
                rows = few + many
                sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, COORDINATES)
                n, root = (np.array([r[c] for r in rows]) for c in ("n_shingles", "root"))
                sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
                other = np.arange(len(few), len(rows))
                for i in range(len(few)):
                    j = other[root[other] != root[i]]
                    good, same = _agree(sig, n, np.full(len(j), i), j, percent)
                    j = j[good][np.argsort(-same[good], kind="stable")]
                    met = set()
                    for x in j.tolist():
                        if root[x] not in met and _linked(sets[i], sets[x], percent):
                            met.add(root[x])
                            a.append(rows[i]["k"])
                            b.append(rows[x]["k"])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _packed(rows: DataFrame, size: str, name: str) -> DataFrame:
    """Members of each node in blocks of about ``BLOCK``, as arrays."""
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col(size) / BLOCK)).alias("part")
    return rows.select("node", part, F.struct("k", "root", "n_shingles", "sig", "items").alias("r")).groupBy("node", "part").agg(F.collect_list("r").alias(name)).drop("part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept, n_equal`` (rows with the very same set).

    Also ``row``, a hash of the row's id and text, and ``root``, a number of the component, null for an empty set.
    """
    pairs = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text", F.lit(1)))
    sketch = materialize(pairs.mapInArrow(_sketch(shingle), "doc_id long, row long, n_shingles long, k long, sig binary"), "sketch")
    # Equal sets become one vertex.
    vertex = materialize(
        sketch.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "vertex",
    )
    facts = vertex.select("k", "n_shingles", "sig")
    nodes = vertex.select("k", "sig").mapInArrow(_root_nodes(trees), "node long, k long")
    # A table of its own, so that the join's sides are plain exchanges, whose large partitions Spark can split.
    size = materialize(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("k").alias("pivot")).filter("size > 1"), "sizes")
    nodes = materialize(nodes.join(size, "node"), "nodes")

    buckets = max(1, nodes.count() // 4_000)
    deal = F.expr(f"cast(pmod(node, {buckets}) as int)")
    small, large = nodes.filter(F.col("size") <= SMALL), nodes.filter(F.col("size") > SMALL)
    forest = small.join(facts, "k").select("node", "k", "n_shingles", "sig", F.lit(0).cast("long").alias("root"), deal.alias("deal")).groupBy("deal").applyInArrow(_node_pairs(percent, False), "a long, b long")
    members = materialize(large.join(facts, "k"), "members")
    deals = max(1, members.count() // 4_000)
    one = materialize(_star(members, members.filter("k = pivot"), percent, deals), "star")
    middle = one.groupBy("node").agg(F.max_by("b", F.struct("same", "b")).alias("k"))
    two = _star(members, members.join(middle, ["node", "k"]), percent, deals)
    star = one.unionByName(two).filter("good").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = materialize(forest.unionByName(star).distinct(), "links")

    links = _confirmed(first, _sets(pairs, vertex, _ends(first), shingle), percent)
    comp = connected_components(links)

    # Nodes that hold several components still.
    rooted = materialize(nodes.join(comp, "k", "left").select("node", "k", "size", F.coalesce("root", "k").alias("root")), "rooted")
    leaves, crowds = [], []
    cur = rooted
    for turn in range(MAX_ROUNDS + 1):
        # Of each node, how many rows each component has: mixed ones only.
        part = cur.groupBy("node", "root").agg(F.count("*").alias("c"))
        mixed = part.groupBy("node").agg(F.sum("c").alias("size"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("in_main"), F.count("*").alias("roots")).filter("roots > 1")
        mixed = materialize(mixed.select("node", "size", "main", "in_main"), "mixed")
        cur = materialize(cur.select("node", "k", "root").join(mixed, "node"), "mixed")
        leaves.append(cur.filter(F.col("size") <= SMALL))
        cur = cur.filter(F.col("size") > SMALL)
        dense = F.lit(turn == MAX_ROUNDS) | (2 * F.col("in_main") >= F.col("size")) | ((F.col("size") - F.col("in_main")) * F.col("size") <= MEDIUM)
        crowds.append(cur.filter(dense))
        cur = cur.filter(~dense)
        if cur.isEmpty():
            break
        cur = cur.join(facts.select("k", "sig"), "k").mapInArrow(_children(percent / 100, 1 if turn else COPIES), "node long, k long, root long")
        cur = materialize(cur, "children")  # read twice
    tested, crowd = _all(leaves), materialize(_all(crowds), "crowd")
    # Nodes of the very same members, from several trees or copies, are compared once.
    same = crowd.groupBy("node").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(k))").alias("x"), F.expr("bit_xor(xxhash64(k, 1))").alias("y"))
    crowd = crowd.join(same.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    across = tested.join(facts, "k").select("node", "k", "n_shingles", "sig", "root", deal.alias("deal")).groupBy("deal").applyInArrow(_node_pairs(percent, True), "a long, b long").distinct()
    more = materialize(across.join(first, ["a", "b"], "left_anti"), "links")
    found = [links]
    if not (more.isEmpty() and crowd.isEmpty()):
        sets = _sets(pairs, vertex, _ends(more).unionByName(crowd.select("k")).distinct(), shingle)
        found.append(_confirmed(more, sets, percent))
        whole = materialize(crowd.join(facts, "k").join(sets, "k").withColumn("outside", F.col("size") - F.col("in_main")), "crowd")
        blocks = _packed(whole.filter("root <> main"), "outside", "few").join(_packed(whole, "size", "many"), "node")
        found.append(materialize(blocks.select("few", "many").mapInArrow(_blocks_compared(percent), "a long, b long"), "confirmed"))
    if len(found) > 1:
        stars = comp.select(F.col("k").alias("a"), F.col("root").alias("b"))
        comp = connected_components(_all([stars, *found[1:]]))

    label = materialize(vertex.select("k", "least", "n_equal").join(comp, "k", "left").withColumn("root", F.coalesce("root", "k")), "label")
    low = materialize(label.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    label = materialize(label.join(low, "root").select("k", "root", "component_id", "n_equal"), "label")
    known = sketch.filter("k is not null").select("doc_id", "row", "n_shingles", "k").join(label, "k")
    alone = sketch.filter("k is null").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_equal"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_equal", "row", "root"]
    return known.select(*columns).unionByName(alone.select(*columns))


def row_key(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns of a row; rows that agree in them are taken for the same."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return [F.xxhash64(every), F.xxhash64(every, F.lit(7))]


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, trees: int = 10) -> DataFrame:
    """The rows of ``docs`` but one of each group of near duplicates: that with the smallest id.

    Null ids order last.  Of rows with one id, the one with the smallest hash of all its columns stays; of rows that are equal
    in every column one stays.  Rows of empty sets (null and empty texts, equal or not) all stay.  The columns of ``docs``
    come back as they are, whatever their names.
    """
    first, second = row_key(docs)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), first.alias("h"), second.alias("g"))
    # Each different row once, with its number: what is decided about it holds for all its copies.
    once = held.select(F.col("r").getField(id_col).cast("long").alias("doc_id"), F.col("r").getField(text_col).cast("string").alias("text"), "h", "g")
    found = materialize(near_duplicates(once.select("doc_id", "text"), "doc_id", "text", shingle, percent, trees).filter("root is not null").select(F.col("row").alias("of_row"), F.col("doc_id").alias("of_id"), "root").distinct(), "near")
    mine = once.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(1)).alias("row"), "doc_id", "h", "g")
    rows = materialize(mine.groupBy("row", "doc_id", "h", "g").agg(F.count("*").alias("copies")), "rows").join(found, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    rows = materialize(rows.select("doc_id", "h", "g", "copies", "root"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("at"), F.col("doc_id").isNull().alias("none"), "h", "g")).alias("m"))
    best = materialize(best.select("m.h", "m.g"), "best")
    kept = materialize(rows.join(best, ["h", "g"], "left_semi").select("h", "g", "copies"), "kept")
    empty = held.filter(~F.coalesce(F.col("r").getField(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("r")
    stay = held.join(kept, ["h", "g"])
    single = stay.filter("copies = 1").select("r").unionByName(empty)
    # Dealt anew, so that the join before may be split where very many rows are equal.
    several = stay.filter("copies > 1").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64))).repartition("h", "g", "part")
    several = several.groupBy("h", "g", "part").agg(F.first("r").alias("r")).groupBy("h", "g").agg(F.first("r").alias("r")).select("r")
    return single.unionByName(several).select("r.*")


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("k")).unionByName(links.select(F.col("b").alias("k"))).distinct()


def _confirmed(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that hold on the full sets."""
    full = links.join(sets.select(F.col("k").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("k").alias("b"), F.col("items").alias("items_b")), "b")
    return materialize(full.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")


def _sets(pairs: DataFrame, vertex: DataFrame, vertices: DataFrame, shingle: int) -> DataFrame:
    """``(k, items)``: the full sets of the vertices, made again from the text of one document of each."""
    reader = vertex.select("k", "row").join(vertices, "k", "left_semi")
    texts = pairs.join(reader, "row").dropDuplicates(["k"])
    return materialize(texts.select("k", "text").mapInArrow(_sets_of(shingle), "k long, items binary"), "sets")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
