"""Links between texts that share buckets and whose sets of shingles are similar: exact, without all pairs of a bucket.

Every member of a bucket is compared with the bucket's centre, its least member. Components form, and only what the
centres leave apart is compared further: a bucket's members outside the centre's component meet all its members, in
blocks of bounded size and as matrices of sketches; first a forest of the most promising pairs, then whatever is left. A sketch only rules pairs out; each link is confirmed on the whole sets of both texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import map_texts, materialise
from .components import components
from .linededup import FACTOR, FILTER_WORDS, bits_of, mixed

#: Members of a block, pairs that are compared and texts that are sketched at once.
BLOCK, PAIRS, PART = 512, 1 << 16, 512
#: Words of 64 bits of the sketch of a whole set.
SET_WORDS = 16

#: From sizes and sketches of the left and right sides of pairs to an estimate for each, negative where it is ruled out.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text the hashes of its words in order, lower-cased from A to Z."""
    known: dict[bytes, int] = {}
    hash_of = lambda w: known[w] if w in known else known.setdefault(w, xxh3_64_intdigest(w))
    return [np.array([hash_of(w) for w in text.lower().split()] if text else [], np.uint64) for text in texts]


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles of width words; fewer words make one shingle, none none."""
    n = max(1, len(h) - width + 1) if len(h) else 0
    run = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        run = mixed(run * np.uint64(FACTOR) + h[k : k + n])
    return np.unique(run)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    return [shingle_set(h, width) for h in word_hashes(texts)]


def parities(owner: np.ndarray, place: np.ndarray, rows: int, words: int) -> np.ndarray:
    """A row of words of 64 bits for each owner; each of its places turns one bit, so equal ones in pairs leave no trace."""
    counts = np.bincount(owner * (64 * words) + place, minlength=rows * 64 * words) & 1
    return np.packbits(counts.astype(np.uint8).reshape(rows, 64 * words), axis=1, bitorder="little").view(np.uint64)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SET_WORDS words for each set. Two sets differ in as many elements as their sketches in bits, or more."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return parities(owner, (h & np.uint64(64 * SET_WORDS - 1)).astype(np.int64), len(sets), SET_WORDS)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def sets_may_reach(least: float, x_size: np.ndarray, y_size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether set sketches leave a Jaccard similarity of least open: such sets differ in (x + y) (1 - least) / (1 + least) elements at most."""
    return apart(x, y) <= (x_size + y_size) * ((1 - least) / (1 + least)) + 1e-6


def buckets(keys: DataFrame) -> DataFrame:
    """(band, node, centre), written: those rows of keys (band, node), all distinct, whose band others share, with the least node of it.

    Bands are counted first; rows whose band is not shared are then dropped before their shuffle by a filter of fixed size.
    """
    shared = materialise(keys.groupBy("band").count().where("count > 1").select("band"))
    met = in_filter(keys, "band", shared).where("hit").select("band", "node").join(shared, "band")
    met = materialise(met)
    return materialise(met.join(met.groupBy("band").agg(F.min("node").alias("centre")), "band"))


def passing(pairs: DataFrame, sketches: DataFrame, near: Near) -> DataFrame:
    """Those of pairs (a, b) whose sketches (node, size, bits) do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
                keep = near(m, n, *(matrix(batch.column(c)) for c in ("s", "t"))) >= 0
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    both = pairs.join(sketches.toDF("a", "m", "s"), "a").join(sketches.toDF("b", "n", "t"), "b").select("a", "b", "m", "s", "n", "t")
    return both.mapInArrow(run, "a binary, b binary")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of words of 64 bits."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(len(column), -1)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of batches, sorted by key, in tables of whole groups."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        keys = rows.column(key).to_numpy()
        last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
        if last:
            yield rows.slice(0, last).combine_chunks()
        held = rows.slice(last).combine_chunks()
    if held is not None:
        yield held
    pa.default_memory_pool().release_unused()


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a before b, of all pairs within the runs of equal values of group; about PAIRS at once."""
    follow = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
    total, at = np.concatenate(([0], np.cumsum(follow))), 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, side="right")) - 1)
        a = np.repeat(np.arange(at, end), follow[at:end])
        yield a, a + 1 + np.arange(len(a)) - (total[at:end] - total[at]).repeat(follow[at:end])
        at = end


def joins(joined: dict, groups: list[int], lefts: list[int], rights: list[int]) -> Iterator[bool]:
    """For each pair in turn whether it joins what the pairs before it in its group, kept in joined, do not."""

    def top(x: tuple) -> tuple:
        while (up := joined.get(x, x)) != x:
            joined[x] = joined.get(up, up)
            x = up
        return x

    for g, a, b in zip(groups, lefts, rights, strict=True):
        x, y = top((g, a)), top((g, b))
        if x != y:
            joined[x] = y
        yield x != y


def unjoined(shared: DataFrame, sketches: DataFrame, roots: DataFrame, near: Near, forest: bool) -> DataFrame:
    """Pairs (a, b), written, of a bucket but of different components that sketches do not rule out.

    With forest, of the pairs of two blocks only those, the most promising first, that join components which the earlier
    ones leave apart: fewer than there are members. Blocks of the centre's component meet other blocks alone, so the
    work is the members left apart times the members.
    """
    rooted = shared.join(roots.toDF("node", "root"), "node", "left").join(roots.toDF("centre", "main"), "centre", "left")
    rooted = rooted.select("band", "node", F.coalesce("root", "node").alias("root"), F.coalesce("main", "centre").alias("main"))
    rooted = materialise(rooted.select("band", "node", "root", (F.col("root") != F.col("main")).alias("apart")))
    still = rooted.groupBy("band").agg(F.count_if("apart").alias("n"), F.count_if(~F.col("apart")).alias("m")).where("n > 0")
    met = rooted.join(still, "band").withColumns({"n": F.ceil(F.col("n") / BLOCK).cast("int"), "m": F.ceil(F.col("m") / BLOCK).cast("int")})
    hashed = F.xxhash64("node", F.lit(1))
    met = met.withColumn("block", F.when(F.col("apart"), F.pmod(hashed, "n")).otherwise(F.col("n") + F.pmod(hashed, "m")).cast("int"))
    met = met.join(sketches, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("apart"), F.col("n") + F.col("m")).otherwise(F.col("n")) - 1)))
    least, most = F.least("block", "other"), F.greatest("block", "other")
    met = met.select(F.xxhash64("band", least, most).alias("pair"), (least == most).alias("same"), "block", "root", "node", "size", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "pair"):
            group = np.concatenate(([0], np.cumsum(np.diff(rows.column("pair").to_numpy()) != 0)))
            block, same, size = (rows.column(c).to_numpy() for c in ("block", "same", "size"))
            root = rows.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
            bits, node = matrix(rows.column("bits")), rows.column("node").combine_chunks()
            joined: dict = {}
            for a, b in pairs_within(group):
                wanted = (root[a] != root[b]) & (same[a] | (block[a] != block[b]))
                a, b = a[wanted], b[wanted]
                score = near(size[a], size[b], bits[a], bits[b])
                open_ = np.flatnonzero(score >= 0)
                a, b = a[open_], b[open_]
                if forest and len(a):
                    order = np.argsort(-score[open_], kind="stable")
                    a, b = a[order], b[order]
                    new = np.fromiter(joins(joined, group[a].tolist(), root[a].tolist(), root[b].tolist()), bool, len(a))
                    a, b = a[new], b[new]
                if len(a):
                    yield pa.record_batch([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

    pairs = met.repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a binary, b binary")
    return materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def in_parts(of: Callable[[list], list[tuple]]) -> Callable[[list], list[tuple]]:
    """of, given PART values at once: what it keeps for each is not kept for a whole batch of short ones.

    Memory that Arrow holds for batches gone by is given back, as workers live on between tasks.
    """

    def all_of(values: list) -> list[tuple]:
        out = [row for at in range(0, len(values), PART) for row in of(values[at : at + PART])]
        pa.default_memory_pool().release_unused()
        return out

    return all_of


def packer() -> Callable[[list], list[tuple]]:
    pack = zstandard.ZstdCompressor(level=3).compress
    return in_parts(lambda texts: [(pack(t or b""),) for t in texts])


def in_filter(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows with `hit`: whether a filter of fixed size has the key, a long; it has all those of the one column of wanted, and may have others."""
    word = F.pmod(F.shiftright(key, 6), F.lit(FILTER_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    met = rows.withColumn("word", word).join(F.broadcast(bits_of(wanted)), "word", "left")
    return met.select(*rows.columns, (F.coalesce("bits", F.lit(0)).bitwiseAND(bit) != 0).alias("hit"))


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed), written: the compressed text of each of wanted (node, id, key) among rows (own, key, text), text a binary.

    key is a hash that a filter of fixed size knows, so that few other texts are shuffled.
    """
    some = in_filter(rows, "key", wanted.select("key")).where("hit").select("own", "key", "text")
    packed = map_texts(some, packer, "packed binary")
    met = packed.join(wanted, (packed["key"] == wanted["key"]) & packed["own"].eqNullSafe(wanted["id"]))
    return materialise(met.groupBy("node").agg(F.min("packed").alias("packed")))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b), written, whose sets of shingles of width words have share[1] * intersection >= share[0] * union."""
    least, whole = share

    def check() -> Callable[[list], list[tuple]]:
        unpack = zstandard.ZstdDecompressor().decompress

        def of(pairs: list) -> list[tuple]:
            packed = list(dict.fromkeys(t for p in pairs for t in (p["x"], p["y"])))
            sets = dict(zip(packed, shingle_sets([unpack(t) for t in packed], width), strict=True))
            out = []
            for p in pairs:
                x, y = sets[p["x"]], sets[p["y"]]
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append((whole * common >= least * (len(both) - common),))
            return out

        return in_parts(of)

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    both = both.select("a", "b", F.struct((F.octet_length("x") + F.octet_length("y")).alias("size"), "x", "y").alias("pair"))
    return materialise(map_texts(both, check, "similar boolean").where("similar").select("a", "b"))


def linked(shared: DataFrame, sketches: DataFrame, near: Near, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root), as components() gives them, of the links that confirm finds among pairs that share a bucket."""
    stars = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(confirm(materialise(passing(stars, sketches, near))))
    for forest in (True, False):
        pairs = unjoined(shared, sketches, roots, near, forest)
        if pairs.isEmpty():
            break
        roots = components(roots.toDF("a", "b").union(confirm(pairs)))
    return roots
