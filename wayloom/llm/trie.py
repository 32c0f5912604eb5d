"""The prefix trie of conversations: every distinct beginning is a node.

A prefix is known by a digest of 128 bits: the XOR of two hashes of each of its turns and their places, which can be
summed from both sides of any cut, so a conversation of any length may lie in many tasks. A count-min sketch of all
digests, of a fixed size, screens them: where the least counter of a prefix is one, it stands in one conversation alone,
and so does all that follows. Such tails are nodes as they are. Only prefixes whose parent may be shared are shuffled
and grouped exactly.

A node's owner is its smallest member. An owner owns all nodes further down its own path, so sums over subtrees are sums
over members: each conversation brings what it owns to the nodes above its first own one. No walk from level to level
is needed, however deep the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.scan import running
from .common import materialise

#: A conversation begins with turns of the conversation whose number is the next lower multiple of this; of up to MOST.
STEP, MOST = 100, 5
#: Rows of the sketch, cells of a row at most and at least, and cells of a block.
ROWS, CELLS, LEAST_CELLS, CELL_BLOCK = 4, 1 << 20, 1 << 14, 1 << 16
#: Numbers of a piece of a joined list.
PIECE = 1 << 15
NODE = ["depth", "d1", "d2"]


def cells_of(batch: pa.RecordBatch, cells: int, names: tuple[str, str] = ("d1", "d2")) -> np.ndarray:
    """The place of each digest in each row of the sketch: ROWS arrays of places in all rows laid end to end."""
    x, y = (batch.column(c).to_numpy().view(np.uint64) for c in names)
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    return (((x + rows * (y | np.uint64(1))) >> np.uint64(20)) % np.uint64(cells) + rows * np.uint64(cells)).astype(np.int64)


def seen_twice(digests: DataFrame, cells: int) -> np.ndarray:
    """Which cells of the sketch of digests (d1, d2) have counted two or more, as one array of ROWS * cells truth values.

    Each task counts up to two in arrays of fixed size and sends their blocks; equal blocks are added up in one task
    each. The result, a bit for each cell, comes to the driver: half a megabyte at most.
    """
    size = min(CELL_BLOCK, ROWS * cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(ROWS * cells, bool), np.zeros(ROWS * cells, bool)
        for batch in batches:
            at, n = np.unique(cells_of(batch, cells), return_counts=True)
            twice[at[(n > 1) | once[at]]] = True
            once[at] = True
        full = [b for b in range(len(once) // size) if once[b * size : (b + 1) * size].any()]
        bits = lambda x: pa.array([np.packbits(x[b * size : (b + 1) * size]).tobytes() for b in full], pa.binary())
        yield pa.record_batch([pa.array(full, pa.int64()), bits(once), bits(twice)], ["block", "once", "twice"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if block in sums:
                    p, s = sums[block]
                    o, t = o | p, t | s | (o & p)
                sums[block] = (o, t)
        yield pa.record_batch([pa.array(sums, pa.int64()), pa.array([t.tobytes() for _, t in sums.values()], pa.binary())], ["block", "twice"])

    blocks = digests.mapInArrow(count, "block long, once binary, twice binary").repartition("block")
    found = np.zeros(ROWS * cells // 8, np.uint8)
    for block, bits in blocks.mapInArrow(add, "block long, twice binary").collect():  # ROWS * cells / 65536 rows at most
        found[block * size // 8 : (block + 1) * size // 8] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(found).astype(bool)


def screened(prefixes: DataFrame, n: int) -> DataFrame:
    """The n prefixes with `local`: whether the estimate of the parent is one, which proves both to be in one conversation alone."""
    cells = LEAST_CELLS
    while cells < min(CELLS, 4 * n):
        cells *= 2
    shared = prefixes.sparkSession.sparkContext.broadcast(np.packbits(seen_twice(prefixes.select("d1", "d2"), cells)))
    names = prefixes.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            alone = ~twice[cells_of(batch, cells, ("p1", "p2"))].all(axis=0)
            alone &= batch.column("depth").to_numpy() > 0
            yield pa.record_batch([*batch.columns, pa.array(alone)], [*names, "local"])

    return prefixes.mapInArrow(mark, StructType([*prefixes.schema, StructField("local", BooleanType())]))


def rebuilt(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv), all conversations, and (conv, depth, mark, size) of their rebuilt turns; depth counts from one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), mark.alias("mark"), F.char_length(text).cast("long").alias("size"))
    placed = materialise(running(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("mark")], {"at": F.lit(1)}))
    convs = placed.where("at = 1").select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST + 1)).cast("int").alias("h"))
    first = placed.where((F.col("at") <= MOST) & (F.col("conv") % STEP == 0))
    heads = first.groupBy(F.col("conv").alias("head")).agg(F.sort_array(F.collect_list(F.struct("at", "mark", "size"))).alias("turns"))
    convs = convs.withColumn("head", F.col("conv") - F.col("conv") % STEP).join(heads, "head", "left")
    convs = materialise(convs.select("conv", "h", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("h")).alias("turns")))
    begun = convs.select("conv", F.explode("turns").alias("t")).select("conv", F.col("t.at").alias("depth"), "t.mark", "t.size")
    own = placed.join(convs.select("conv", "h", F.size("turns").alias("n")), "conv").where("at > h")
    return convs.select("conv"), begun.unionByName(own.select("conv", (F.col("n") + F.col("at") - F.col("h")).alias("depth"), "mark", "size"))


def prefixes_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, d1, d2, p1, p2, size, end): for each conversation and depth the digest, the parent's, the size of the
    last text, and whether the conversation ends here; the root is the prefix of depth 0."""
    hashes = {"d1": F.xxhash64("depth", "mark"), "d2": F.xxhash64("mark", "depth", F.lit("second"))}
    path = running(turns, ["conv"], [F.col("depth")], {"length": F.lit(1)}, hashes)
    parent = lambda d: F.col(d).bitwiseXOR(hashes[d])
    rows = path.select("conv", "depth", "d1", "d2", parent("d1").alias("p1"), parent("d2").alias("p2"), "size", (F.col("depth") == F.col("length_total")).alias("end"))
    none = F.lit(0).cast("long")
    turned = rows.where("depth = 1").select("conv", F.lit(True).alias("turned"))
    root = convs.join(turned, "conv", "left").select("conv", none.alias("depth"), *(none.alias(c) for c in ("d1", "d2", "p1", "p2", "size")), F.col("turned").isNull().alias("end"))
    return rows.unionByName(root)


def joined_digests(ends: DataFrame) -> DataFrame:
    """(depth, d1, d2, ends_sha256) for ends (depth, d1, d2, conv): the hash of a node's numbers, ascending, comma-joined.

    SHA-256 reads a list in order, so the list of a node is hashed by one task; it is cut into sorted pieces by
    ranges of the whole table, so that this task streams pieces of bytes and never holds the numbers.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in NODE], axis=1)
            new = np.any(key[1:] != key[:-1], axis=1)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)] if len(key) else [0]
            cuts = [x for a, b in zip(cuts, cuts[1:]) for x in range(a, b, PIECE)]
            convs = batch.column("conv").to_pylist()
            text = [",".join(map(str, convs[a:b])) for a, b in zip(cuts, [*cuts[1:], len(key)])]
            at = pa.array(cuts, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in NODE), batch.column("conv").take(at), pa.array(text, pa.string())], [*NODE, "first", "piece"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    out += [(*node, state.hexdigest())] if node else []
                    node, state = key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], x, strict=True)) for x in out])
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*node, state.hexdigest()), strict=True))])

    cut = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    cut = cut.mapInArrow(pieces, "depth long, d1 long, d2 long, first long, piece string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashes, "depth long, d1 long, d2 long, ends_sha256 string")


def sha_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), as longs but for the hash.

    A conversation's turns come in the order of turn, null first, then of the SHA-256 of role and text; rows that repeat
    are turns of their own. Null roles and texts are empty; rows without a conversation are left out. A conversation
    whose head is absent or short, or that has no turn left, is a member of the root at least. An empty table has no
    node, not even a root. Other columns are ignored.
    """
    convs, turns = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    prefixes = materialise(prefixes_of(convs, turns))
    prefixes = materialise(screened(prefixes, prefixes.count()))
    shared = prefixes.where("not local")

    owner = F.min(F.struct("conv", "end")).alias("owner")
    ends = F.count_if("end").alias("n_ends")
    nodes = shared.groupBy(*NODE, "p1", "p2").agg(F.count("*").alias("n_convs"), F.max("size").alias("size"), owner, ends, F.min(F.when(F.col("end"), F.col("conv"))).alias("an_end"))
    nodes = nodes.select(*NODE, "p1", "p2", "n_convs", "n_ends", "an_end", F.col("owner.conv").alias("conv"), F.col("owner.end").alias("stops"), ((F.col("n_convs") - 1) * F.col("size")).alias("weight"))
    nodes = materialise(running(nodes, ["conv"], [F.col("depth").desc()], {"below": F.col("weight")}))

    leaf = F.max(((F.col("n_convs") == 1) | (F.col("n_ends") == F.col("n_convs"))).cast("long")).alias("leaf")
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("from"), F.max("below_total").alias("total"), leaf)
    owners = materialise(owners)
    brought = shared.select("conv", *NODE).join(owners, "conv").where(F.col("depth") < F.col("from"))
    brought = brought.groupBy(*NODE).agg(F.sum("total").alias("more_saved"), F.sum("leaf").alias("more_leaves"), F.count_if(F.col("from") == F.col("depth") + 1).alias("branches"))

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"))
    first = nodes.join(owners.select("conv", F.col("from").alias("depth")), ["conv", "depth"]).join(parents, ["depth", "p1", "p2"]).select(*NODE, "parent")
    lists = joined_digests(shared.where("end").join(nodes.where("n_ends > 1").select(*NODE), NODE))
    zero = lambda c: F.coalesce(c, F.lit(0))
    inner = nodes.join(owners.select("conv", "leaf"), "conv").join(brought, NODE, "left").join(first, NODE, "left").join(lists, NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), "n_convs",
        (zero("branches") + (~F.col("stops")).cast("long")).alias("n_children"), (zero("more_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("below") + zero("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", sha_of(F.coalesce(F.col("an_end").cast("string"), F.lit("")))).alias("ends_sha256"),
    )
    one = F.lit(1).cast("long")
    tails = prefixes.where("local").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (~F.col("end")).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), sha_of(F.when(F.col("end"), F.col("conv").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    return inner.unionByName(tails)
