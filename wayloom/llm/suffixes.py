"""Exact removal of long repeated strings by a logarithmic family of sparse suffix arrays.

A string of LENGTH bytes is found by its anchor: of all places in it where PREFIX bytes follow, the one whose
fingerprint is smallest, leftmost first. Equal strings have equal anchors, so only suffixes that begin at anchors are
indexed, about one in 140 bytes. A batch's suffix array holds these suffixes in the order of their first HEAD bytes, then
of the fingerprint of their first PREFIX bytes; suffixes that agree in both are one run with their number. The batches
come one after another: before the next one, levels that hold as many batches merge into one, so that a suffix is merged
as often as the logarithm of the number of batches; then the new array is merge-scanned against that of each level for
runs that agree over PREFIX bytes. Suffixes that met are compared in full: all strings of one anchor at once where the
surroundings are equal, else string by string.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import map_texts, materialise

LENGTH, PREFIX, HEAD = 400, 128, 24
ORDER = ["head", "gram"]
#: Into how many batches the rows are parted at least, and what a batch of more takes.
LEAST_BATCHES, BATCH_BYTES = 4, 1 << 40
#: Places in a string of LENGTH bytes where PREFIX bytes follow.
PLACES = LENGTH - PREFIX + 1
#: A text goes through the arrays in stretches of about this many bytes.
STRETCH = 1 << 22
#: Up to so many different stretches of one anchor, of less than 2 * LENGTH bytes each, are compared many anchors at
#: a time; up to MIDDLE, 1.6 MB, one anchor at a time; more are spread out string by string.
FEW, MIDDLE = 64, 2048
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Fingerprints:
    """Fingerprints of all runs of PREFIX bytes, by differences of a running sum of powers modulo 2**64."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(400).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) < n:
            size = max(1 << 14, 1 << n.bit_length())
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE, np.uint64)]))
        total = np.cumsum(self.values[data] * self.powers[:n])
        h = total[PREFIX - 1 :].copy()
        h[1:] -= total[: n - PREFIX]
        h *= self.inverses[: n - PREFIX + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values, from minima towards both ends of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, gram, first, last): each anchor, its prefix's fingerprint, and the starts of the strings that it stands for."""
    h = prints.of(data)
    order = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    at = sliding_min(order, PLACES) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    at = at[first].astype(np.int64)
    return at, h[at], first, last


def stretches(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Stretches that share so much that each string has its anchor's neighbourhood whole in one of them."""
    if len(data) <= 2 * STRETCH:
        yield 0, data
        return
    for start in range(0, len(data) - LENGTH + 1, STRETCH):
        yield start, data[start : start + STRETCH + LENGTH - 1]


def suffixes_of() -> Callable[[list], list[tuple]]:
    """A function from texts (bytes) to (n_bytes, packed, suffixes): each suffix is (head, gram, surroundings, first, last)."""
    prints = Fingerprints()
    pack = zstandard.ZstdCompressor(level=3).compress
    names = ("head", "gram", "surroundings", "first", "last")

    def of(data: bytes | None) -> tuple:
        if data is None:
            return 0, None, []
        found = []
        for start, piece in stretches(data) if len(data) >= LENGTH else ():
            at, gram, first, last = anchors(np.frombuffer(piece, np.uint8), prints)
            bounds = zip(at.tolist(), gram.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True)
            for k, g, a, b in bounds:
                around = xxh64_intdigest(piece[a : b + LENGTH])
                found.append(dict(zip(names, (piece[k : k + HEAD], g, around - (around >> 63 << 64), a + start, b + start), strict=True)))
        return len(data), pack(data), found

    return lambda texts: [of(t) for t in texts]


class IndexFamily:
    """Levels of suffix arrays (head, gram, n), written in order; before a batch comes, no two hold as many batches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def merge(self) -> None:
        """Levels of equal size become one."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, x), (_, y) = self.levels.pop(), self.levels.pop()
            both = x.union(y).groupBy(*ORDER).agg(F.sum("n").alias("n"))
            self.levels.append((2 * size, materialise(both.sort(*ORDER))))

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Takes a batch in; returns (head, gram) of the runs that it holds twice, or that an earlier batch holds too."""
        self.merge()
        array = materialise(suffixes.groupBy(*ORDER).agg(F.count("*").alias("n")).sort(*ORDER))
        found = array.where("n > 1").select(*ORDER)
        for _, level in self.levels:
            found = found.union(array.join(level.hint("merge"), ORDER, "left_semi").select(*ORDER))
        self.levels.append((1, array))
        return found


def unpack(data: bytes | None) -> bytes:
    return b"" if data is None else zstandard.ZstdDecompressor().decompress(data)


def stretches_of() -> Callable[[list], list[tuple]]:
    """A function from (packed, todo) to (stretches,): the bytes of all strings of each anchor of todo."""

    def of(row: dict) -> tuple:
        data = unpack(row["packed"])
        return ([data[e["first"] : e["last"] + LENGTH] for e in row["todo"]],)

    return lambda rows: [of(r) for r in rows]


def hashes(stretch: bytes) -> list[int]:
    """Fingerprints of all strings of LENGTH bytes."""
    return [xxh64_intdigest(stretch[s : s + LENGTH]) for s in range(len(stretch) - LENGTH + 1)]


def shared_places(stretches: list[bytes]) -> list[list[int]]:
    """For each stretch the places of strings that others have too."""
    each = [hashes(s) for s in stretches]
    seen: Counter = Counter(h for hs in each for h in hs)
    return [[at for at, h in enumerate(hs) if seen[h] > 1] for hs in each]


def alike() -> Callable[[list], list[tuple]]:
    """A function from the stretches of one anchor to (found,): for each, the places of strings that others have too."""

    return lambda rows: [(shared_places(r["stretches"]),) for r in rows]


def alike_group(group: pa.Table) -> pa.Table:
    """(gram, surroundings, stretch) of one anchor to (gram, surroundings, at)."""
    places = pa.array(shared_places(group.column("stretch").to_pylist()), pa.list_(pa.int32()))
    return pa.table([group.column("gram"), group.column("surroundings"), places], ["gram", "surroundings", "at"])


def singly() -> Callable[[list], list[tuple]]:
    """A function from a stretch to (strings,), as signed numbers."""
    return lambda stretches: [([h - (1 << 63) for h in hashes(s)],) for s in stretches]


def indexed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_bytes, packed, suffixes), written: docs' rows, numbered, with their texts compressed."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kinds = "head: binary, gram: long, surroundings: long, first: long, last: long"
    return materialise(map_texts(rows, suffixes_of, f"n_bytes long, packed binary, suffixes array<struct<{kinds}>>"))


def repeated_spans(rows: DataFrame, batches: int) -> DataFrame:
    """(row, spans): for each text with repeats its stretches (first, last) of starts of strings that occur elsewhere too.

    Spans may touch or overlap.
    """
    entries = rows.select("row", F.explode("suffixes").alias("s")).select("row", "s.*")
    family, found = IndexFamily(), None
    for b in range(batches):
        met = family.add(entries.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == b))
        found = met if found is None else found.union(met)
    # written before the joins, so that no aggregation shares their shuffles and hot runs can be split
    found = materialise(found.distinct())
    shared = materialise(entries.join(found, ORDER).select("gram", "surroundings", "row", "first", "last"))
    # equal surroundings: all strings of the anchor repeat
    kinds = materialise(shared.groupBy("gram", "surroundings").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last")).alias("one")))
    several = materialise(kinds.groupBy("gram").count().where("count > 1"))
    todo = kinds.join(several, "gram").select("gram", "surroundings", "count", "one.*")
    lists = todo.groupBy("row").agg(F.collect_list(F.struct("gram", "surroundings", "count", "first", "last")).alias("todo"))
    packed = rows.select("row", "packed").join(lists, "row").select("todo", F.struct("packed", "todo").alias("row"))
    cut = map_texts(packed, stretches_of, "stretches array<binary>")
    cut = cut.select(F.explode(F.arrays_zip("todo", "stretches")).alias("e")).select("e.todo.gram", "e.todo.surroundings", "e.todo.count", F.col("e.stretches").alias("stretch"))
    cut = materialise(cut)
    # few stretches of an anchor are compared at once, in one task; many are spread out string by string
    few = cut.where(F.col("count") <= FEW).groupBy("gram").agg(F.collect_list(F.struct("stretch", "surroundings")).alias("all"))
    size = F.aggregate("all", F.lit(0), lambda acc, x: acc + F.octet_length(x["stretch"]))
    few = few.select("gram", "all.surroundings", F.struct(size.alias("size"), F.col("all.stretch").alias("stretches")).alias("row"))
    few = map_texts(few, alike, "found array<array<int>>").select("gram", F.explode(F.arrays_zip("surroundings", "found")).alias("e"))
    few = few.select("gram", "e.surroundings", F.col("e.found").alias("at"))
    middle = cut.where((F.col("count") > FEW) & (F.col("count") <= MIDDLE)).select("gram", "surroundings", "stretch")
    few = few.union(middle.groupBy("gram").applyInArrow(alike_group, "gram long, surroundings long, at array<int>"))
    few = few.where(F.size("at") > 0)
    many = map_texts(cut.where(F.col("count") > MIDDLE).select("gram", "surroundings", "stretch"), singly, "strings array<long>")
    many = materialise(many.select("gram", "surroundings", F.posexplode("strings").alias("at", "string")))
    again = materialise(many.groupBy("gram", "string").count().where("count > 1").select("gram", "string"))
    many = many.join(again, ["gram", "string"]).groupBy("gram", "surroundings").agg(F.sort_array(F.collect_set("at")).alias("at"))
    parts = few.union(many)
    verdict = kinds.where("n > 1").select("gram", "surroundings", F.lit(None).cast("array<int>").alias("at"))
    whole = kinds.where("n > 1").select("gram", "surroundings")
    verdict = materialise(verdict.union(parts.join(whole, ["gram", "surroundings"], "left_anti")))
    owners = shared.join(verdict, ["gram", "surroundings"])
    spans = F.when(F.col("at").isNull(), F.array(F.struct("first", "last"))).otherwise(
        F.transform("at", lambda a: F.struct((F.col("first") + a).alias("first"), (F.col("first") + a).alias("last")))
    )
    return owners.select("row", spans.alias("spans")).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cutter() -> Callable[[list], list[tuple]]:
    """A function from (packed, spans) to (n_bytes, n_removed, n_spans, kept)."""

    def cut(row: dict) -> tuple:
        data = np.frombuffer(unpack(row["packed"]), np.uint8)
        keep = np.ones(len(data) + 2, bool)
        for span in row["spans"] or ():
            keep[1 + span["first"] : 1 + span["last"] + LENGTH] = False
        runs = int(np.count_nonzero(keep[:-1] & ~keep[1:]))
        keep = keep[1:-1]
        return len(data), int(len(data) - keep.sum()), runs, data[keep].tobytes()

    return lambda rows: [cut(r) for r in rows]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row of docs: the bytes left when each byte that a repeated
    string of LENGTH bytes covers is gone.

    The rows come in LEAST_BATCHES batches, or in as many more as BATCH_BYTES each make; the result is the same for any
    number. A null text counts as empty; texts shorter than LENGTH lose nothing. Repeated rows are copies of each other,
    and lose all that LENGTH bytes can cover; so do rows with null ids. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = indexed(docs, id_col, text_col)
    if batches is None:
        batches = max(LEAST_BATCHES, -(-(rows.agg(F.sum("n_bytes")).first()[0] or 0) // BATCH_BYTES))
    spans = repeated_spans(rows, batches)
    left = rows.select("row", "id", "packed").join(spans, "row", "left").select("id", F.struct("packed", "spans").alias("row"))
    return map_texts(left, cutter, "n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
