"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint is given the vector i mod 7 + 1 of three bits. For each of the seven non-zero vectors v, a table
keys the fingerprints by those bits whose vector has an odd product with v. Two fingerprints that differ in two bits
always share a v that is orthogonal to both bits' vectors, so they meet in that table: no pair within the radius is
missed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import checkpoint, map_texts, materialise, numbered
from .components import components
from .linededup import mixed
from .links import apart, buckets, confirmed, in_filter, in_parts, linked, set_sketches, sets_may_reach, shingle_set, texts_of, word_hashes

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Near copies: fingerprints of distinct words, bits that one of them may differ in, words of a shingle, least similarity.
NEAR_PRINTS, NEAR_RADIUS, NEAR_SHINGLE, NEAR_SIMILARITY = 4, 4, 5, (80, 100)
#: Buckets of up to so many fingerprints are compared pair by pair; larger ones through common neighbours.
SMALL_BUCKET = 16


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as unsigned numbers."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def print_of(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list of hashes, signed: bit by bit what more than half of them have."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.int64)
    if sizes.any():
        flat = np.array([h for x in hashes for h in x], "<u8")
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        packed = np.packbits(2 * counts > sizes[full, None], axis=1, bitorder="little")
        out[full] = np.ascontiguousarray(packed).view("<i8")[:, 0]
    return out


def fingerprints() -> Callable[[list], list[tuple]]:
    """A function from texts (bytes) to (fingerprint,), a signed 64-bit integer."""

    def shingle_hashes(text: bytes | None) -> list[int]:
        words = text.lower().split() if text else []
        if len(words) < SHINGLE:
            return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
        return [xxh64_intdigest(s, SEED) for s in map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))]

    def of(texts: list) -> list[tuple]:
        return [(x,) for x in print_of([shingle_hashes(t) for t in texts]).tolist()]

    return of


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes (fp, node), one for each distinct fingerprint, that join all pairs within the radius.

    A bucket of more than SMALL_BUCKET fingerprints is not compared pair by pair: two fingerprints that differ in two
    bits have a common neighbour one bit away from each, so each is dealt to its neighbours among the bits that the
    table leaves open, and those that meet (65 at most) are linked to one of them. That is exact, and linear.
    """
    tables = F.array(*(F.struct(F.lit(v).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(masks())))
    rows = nodes.select("fp", "node", F.explode(tables).alias("t")).select("fp", "node", "t.table", "t.key")
    sizes = rows.groupBy("table", "key").count().where("count > 1")
    shared = rows.join(sizes, ["table", "key"])
    groups = shared.where(F.col("count") <= SMALL_BUCKET).groupBy("table", "key").agg(F.collect_list(F.struct("fp", "node")).alias("all"))
    near = groups.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    near = near.where((F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS))
    open_bits = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks()))
    flips = F.element_at(open_bits, F.col("table") + 1)
    around = shared.where(F.col("count") > SMALL_BUCKET).select("table", "key", "fp", "node", F.explode(flips).alias("flip"))
    around = around.groupBy("table", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.collect_set("node").alias("all"))
    around = around.where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).union(around).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs: 16 hex digits, and the smallest id that links lead to.

    A null text or one without words has fingerprint zero and is linked like any other. Rows that share an id count as
    one document with several fingerprints; rows without an id get a fingerprint and the component of equal
    fingerprints, but lead nowhere. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = checkpoint(map_texts(rows, fingerprints, "fp long"))
    nodes = checkpoint(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")))
    roots = components(links(nodes).union(shared_ids(prints, nodes)))
    found = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(found, "fp", "left").select(F.col("id").alias(id_col), fingerprint, "component_id")


def shared_ids(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between an id and the nodes of its fingerprints, for ids with several."""
    several = prints.groupBy("id").agg(F.count_distinct("fp").alias("n")).where("n > 1 and id is not null").select("id")
    return several.join(prints, "id").join(nodes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))


def near_prints() -> Callable[[list], list[tuple]]:
    """A function from texts (bytes) to (size, node, prints, bits): of the set of shingles of NEAR_SHINGLE words its size and
    a digest, null if empty; NEAR_PRINTS fingerprints of the distinct words; these and the set's sketch."""

    def of(texts: list) -> list[tuple]:
        words = word_hashes(texts)
        sets = [shingle_set(h, NEAR_SHINGLE) for h in words]
        distinct = [np.unique(h) for h in words]
        prints = np.stack([print_of([mixed(h + np.uint64(k)).tolist() for h in distinct]) for k in range(NEAR_PRINTS)], axis=1)
        bits = np.concatenate((prints.view(np.uint64), set_sketches(sets)), axis=1)
        return [(len(s), xxh3_128_digest(s.tobytes()), fps, bits[k].tobytes()) if len(s) else (0, None, fps, None) for k, (s, fps) in enumerate(zip(sets, prints.tolist(), strict=True))]

    return in_parts(of)


def near(x_size: np.ndarray, y_size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of sizes and bits how many bits agree in the nearest of their fingerprints, or -1 where all are too far
    apart or the sets cannot be similar."""
    agree = BITS - np.min([apart(x[:, k : k + 1], y[:, k : k + 1]) for k in range(NEAR_PRINTS)], axis=0)
    least = NEAR_SIMILARITY[0] / NEAR_SIMILARITY[1]
    open_ = (agree >= BITS - NEAR_RADIUS) & (np.minimum(x_size, y_size) >= least * np.maximum(x_size, y_size) - 1e-6)
    return np.where(open_ & sets_may_reach(least, x_size, y_size, x[:, NEAR_PRINTS:], y[:, NEAR_PRINTS:]), agree, -1)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their group, in docs' own columns.

    A group is what equal sets of shingles of NEAR_SHINGLE words, and links between such sets, join: fingerprints of single
    words that differ in NEAR_RADIUS bits or fewer, which covering masks find, and a Jaccard similarity of NEAR_SIMILARITY or more. The
    fingerprint finds pairs; what links them are their whole sets. Rows are told apart by themselves: the first row is
    that of the smallest id, null ids last, however many rows share it. Texts without words, null ones included, are no
    copies of each other and stay. An empty table gives an empty result.
    """
    rows = numbered(docs)
    text, number = F.col("doc")[text_col].cast("binary").alias("text"), F.xxhash64("row").alias("key")
    prints = materialise(map_texts(rows.select("row", number, F.col("doc")[id_col].alias("id"), text), near_prints, "size long, node binary, prints array<long>, bits binary"))
    one = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "key")).alias("one")
    nodes = prints.where("node is not null").groupBy("node").agg(one, F.min("size").alias("size"), F.min("prints").alias("prints"), F.min("bits").alias("bits"))
    nodes = materialise(nodes)
    key = lambda k, v, m: F.xxhash64(F.lit(k), F.lit(v), F.get("prints", F.lit(k)).bitwiseAND(F.lit(signed(m))))
    keys = F.explode(F.array(*(key(k, v, m) for k in range(NEAR_PRINTS) for v, m in enumerate(masks(NEAR_RADIUS)))))
    # many small tasks: each counts a bounded number of bands before its shuffle
    dealt = nodes.select("node", "prints").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    shared = buckets(dealt.select(keys.alias("band"), "node"))
    some = materialise(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    texts = texts_of(rows.select(F.col("row").alias("own"), number, text), some.select("node", F.col("one.row").alias("id"), "one.key"))
    roots = linked(shared, some.select("node", "size", "bits"), near, lambda pairs: confirmed(pairs, texts, NEAR_SHINGLE, NEAR_SIMILARITY))
    named = materialise(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "one"))
    heads = named.groupBy("root").agg(F.min("one").alias("head")).join(named, "root").select("node", F.col("head.row").alias("head"))
    later = materialise(prints.select("row", "key", "node").join(heads, "node").where("row <> head").select("row", "key"))
    # most rows meet no later row in the filter and stay without a shuffle
    marked = in_filter(rows.withColumn("key", number), "key", later.select("key"))
    stay = marked.where("not hit").select("doc").union(marked.where("hit").join(later.select("row"), "row", "left_anti").select("doc"))
    return stay.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
