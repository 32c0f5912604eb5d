"""Fuzzy line deduplication.

A line's shingles are all its runs of SHINGLE characters; case and outer white space do not count, and a shorter line
has equals alone. Each shingle is hashed once onto a ring of BANDS * ROWS sectors; the least hash of each sector is one
minimum, as likely to agree between two lines as their Jaccard similarity is high. Lines that agree in all the minima
of a band share a bucket. Every line of a bucket is compared with the bucket's centres, four of its lines, then, whatever these links have
not joined, with all the rest of the bucket, block by block behind a bound on the similarity; a pair counts by its exact
Jaccard similarity. Linked lines form components, and of each component the first line by document and place stays.

Texts are cut and hashed in Arrow batches with numpy, as are the pairs; see the README for why this is not done by
DataFrame functions alone. All grouping, joining and shuffling is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from .common import FILTER_WORDS, bits_of, in_bits, map_texts, materialise
from .components import components

SHINGLE, SIMILARITY = 9, 0.8
BANDS, ROWS = 7, 4
#: Lines are hashed in stretches of about this many characters, whose arrays stay in the processor's cache.
STRETCH = 1 << 14
#: Lines of a block, and words of 64 bits in the sketch that bounds a pair's similarity.
BLOCK, SKETCH = 256, 16
NONE = np.iinfo(np.uint64).max
#: The sector that each sector asks for its minimum when it is empty, turn by turn.
TURNS = 256
DONORS = np.random.default_rng(8).integers(0, BANDS * ROWS, (TURNS, BANDS * ROWS))
FACTOR = 0x9E3779B97F4A7C15


def normal(line: str) -> str:
    return line.strip().lower()


def mixed(h: np.ndarray) -> np.ndarray:
    """h with every bit spread over all the others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash): the hashes of all shingles of normal lines, with repeats, in order, and the line that each is of."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    x *= np.uint64(FACTOR)
    x ^= x >> np.uint64(32)
    if len(x) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run, width = x, 1
    while 2 * width <= SHINGLE:  # runs of 1, 2, 4, 8 characters, then the odd one
        run, width = run[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)) + run[width:], 2 * width
    for k in range(width, SHINGLE):
        run = run[: len(x) - k] * np.uint64(FACTOR) + x[k:]
    owner = np.repeat(np.arange(len(lines)), np.maximum(sizes - SHINGLE + 1, 0))
    ends = np.cumsum(sizes)
    over = ends[:, None] - np.arange(1, SHINGLE)  # where a run would leave its line
    whole = np.ones(len(x), bool)
    whole[over[over >= (ends - sizes)[:, None]]] = False
    return owner, mixed(run[whole[: len(run)]])


def stretches(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of lines of about STRETCH characters, and the number of the first line of each; a longer line is one by itself."""
    start, size = 0, 0
    for end, line in enumerate(lines, 1):
        size += len(line)
        if size >= STRETCH or end == len(lines):
            yield start, lines[start:end]
            start, size = end, 0


def shingle_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of shingle_hashes() without repeats, the hashes of each line sorted."""
    owner, h = shingle_hashes(lines)
    ends = np.searchsorted(owner, np.arange(len(lines) + 1)).tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], h[first]


def filled(minima: np.ndarray) -> np.ndarray:
    """minima with every empty sector given that of a full one, chosen by hashes of its own: as good as a minimum of its own.

    The hash of a minimum and of the sector that takes it is what counts, so that no two sectors are copies of each other.
    """
    out, full = minima.copy(), minima != NONE
    row, sector = np.nonzero(~full)
    some = full.any(axis=1)[row]
    row, sector = row[some], sector[some]
    for turn in range(TURNS):
        if not len(row):
            return out
        other = DONORS[turn, sector]
        met = full[row, other]
        out[row[met], sector[met]] = minima[row[met], other[met]]
        row, sector = row[~met], sector[~met]
    for k in range(minima.shape[1]):  # none met in so many turns: the next full one
        other = (sector + k) % minima.shape[1]
        met = full[row, other]
        out[row[met], sector[met]] = minima[row[met], other[met]]
        row, sector = row[~met], sector[~met]
    return out


def bands(lines: list[str]) -> np.ndarray:
    """The bands of normal lines of SHINGLE characters or more: a row of BANDS signed numbers for each."""
    sectors = BANDS * ROWS
    minima = np.full(len(lines) * sectors, NONE, np.uint64)
    for start, part in stretches(lines):
        owner, h = shingle_hashes(part)
        np.minimum.at(minima, (owner + start) * sectors + ((h >> np.uint64(32)) * np.uint64(sectors) >> np.uint64(32)).astype(np.int64), h)
    minima = filled(minima.reshape(len(lines), sectors))
    out = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(ROWS):  # the rows of a band lie far apart on the ring
            key = mixed(key * np.uint64(FACTOR) + minima[:, b + BANDS * r])
        out[:, b] = key
    return out.view(np.int64)


def line_hashes() -> Callable[[list], list[tuple]]:
    """A function from texts to (packed, his, los, signed): the text compressed, both hashes of each line, null for blank
    ones, and the bands of each line when it first stands in the batch."""
    pack = zstandard.ZstdCompressor(level=3).compress

    def of(texts: list) -> list[tuple]:
        out, new, seen = [], [], set()
        for text in texts:
            his, los, fresh = [], [], []
            for line in [] if text is None else text.split("\n"):
                line = normal(line)
                data = line.encode()
                hi = xxh64_intdigest(data, 42) if line else None
                his.append(None if hi is None else hi - (hi >> 63 << 64))
                lo = xxh3_64_intdigest(data) if line else None
                los.append(None if lo is None else lo - (lo >> 63 << 64))
                if len(line) >= SHINGLE and hi not in seen:
                    seen.add(hi)
                    fresh.append(len(new))
                    new.append((his[-1], line))
            out.append((None if text is None else pack(text.encode()), his, los, fresh))
        keys = bands([line for _, line in new]).tolist()
        return [(packed, his, los, [{"hi": new[i][0], "bands": keys[i]} for i in fresh]) for packed, his, los, fresh in out]

    return of


def numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, doc, packed, his, los, signed), written: docs' rows, numbered, with their other columns in doc."""
    others = [docs[c] for c in docs.columns if c != text_col]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*others, F.lit(0).alias("__")).alias("doc"), docs[text_col].alias("text"))
    return materialise(map_texts(rows, line_hashes, "packed binary, his array<long>, los array<long>, signed array<struct<hi: long, bands: array<long>>>"))


def bands_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("signed").alias("s")).select(F.col("s.hi").alias("line"), F.explode("s.bands").alias("band"))


def buckets(all_bands: DataFrame, one_order: bool = False) -> DataFrame:
    """(band, centres, line), written: those lines of all_bands (band, line) that share a band with another.

    The centres of a bucket are the first and the last of its lines in two orders that differ from bucket to bucket; with
    one_order, the first in an order that all buckets share, so that lines that meet in many have few centres.
    Rows whose band cannot be shared are dropped before the shuffle by a filter of fixed size.
    """
    sizes = all_bands.groupBy("band").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    sizes = materialise(sizes.where("lo < hi").select("band"))
    met = in_bits(all_bands, F.col("band"), bits_of(sizes)).where("may")
    shared = materialise(met.select("band", "line").join(sizes, "band").distinct())
    orders = [(F.lit(0).cast("long"), F.min)] if one_order else [(m, f) for m in (F.col("band"), F.shiftrightunsigned("band", 1)) for f in (F.min, F.max)]
    ends = [f(F.col("line").bitwiseXOR(m)).alias(f"c{k}") for k, (m, f) in enumerate(orders)]
    centres = F.array(*(F.col(f"c{k}").bitwiseXOR(m) for k, (m, _) in enumerate(orders)))
    return materialise(shared.join(materialise(shared.groupBy("band").agg(*ends)).select("band", centres.alias("centres")), "band"))


def picker(words: np.ndarray) -> Callable[[], Callable[[list], list[tuple]]]:
    """A function from (packed, his) to (found,): the lines (hi, raw) that pass the filter of bits_of()."""

    def pick() -> Callable[[list], list[tuple]]:
        unpack = zstandard.ZstdDecompressor().decompress

        def of(row: dict) -> tuple:
            if row["packed"] is None:
                return ([],)
            hi = np.array([h or 0 for h in row["his"]], np.int64)
            wanted = words.view(np.uint64)[(hi >> 6) % FILTER_WORDS] >> (hi & 63).astype(np.uint64) & np.uint64(1)
            if not wanted.any():
                return ([],)
            raw = unpack(row["packed"]).decode().split("\n")
            return ([{"hi": row["his"][i], "raw": raw[i]} for i in np.flatnonzero(wanted).tolist() if row["his"][i] is not None],)

        return lambda rows: [of(r) for r in rows]

    return pick


def sketches() -> Callable[[list], list[tuple]]:
    """A function from raw lines to (normal line, its second hash, number of shingles, sketch).

    Each shingle turns one bit of the sketch: two sets differ in as many shingles as bits, or more.
    """

    def of(raw: list) -> list[tuple]:
        lines = [normal(r) for r in raw]
        words, sizes = np.zeros(len(lines) * SKETCH, np.uint64), []
        for start, part in stretches(lines):
            owner, h = shingle_sets(part)
            place = (owner + start) * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64)
            np.bitwise_xor.at(words, place, np.uint64(1) << (h >> np.uint64(8) & np.uint64(63)))
            sizes += np.bincount(owner, minlength=len(part)).tolist()
        los = np.array([xxh3_64_intdigest(x.encode()) for x in lines], np.uint64).view(np.int64).tolist()
        return list(zip(lines, los, sizes, words.view(np.int64).reshape(len(lines), SKETCH).tolist(), strict=True))

    return of


def sketched(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hi, line, lo, size, sketch), written, for each line among nodes.

    A filter of fixed size, 8 MB, goes to the tasks, so that few other lines are shuffled.
    """
    words = np.zeros(FILTER_WORDS, np.int64)
    table = bits_of(nodes).toArrow()  # FILTER_WORDS rows at most
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(words)
    found = map_texts(rows.select(F.struct("packed", "his").alias("r")), lambda: picker(shared.value)(), "found array<struct<hi: long, raw: string>>")
    named = found.select(F.explode("found").alias("x")).select("x.*").join(nodes, F.col("hi") == F.col("line"), "left_semi")
    one = named.groupBy("hi").agg(F.min("raw").alias("raw"))
    return materialise(map_texts(one, sketches, "line string, lo long, size long, sketch array<long>"))


def similar_pairs() -> Callable[[list], list[tuple]]:
    """A function from pairs of normal lines to (similarity,), by their whole sets of shingles."""

    def of(pairs: list) -> list[tuple]:
        lines = list(dict.fromkeys(line for p in pairs for line in (p["x"], p["y"])))
        sets, out = {}, []
        for _, part in stretches(lines):
            owner, h = shingle_sets(part)
            sets |= zip(part, np.split(h, np.searchsorted(owner, np.arange(1, len(part)))), strict=True)
        for p in pairs:
            x, y = sets[p["x"]], sets[p["y"]]
            both = np.concatenate((x, y))
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append((common / (len(both) - common),))
        return out

    return of


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of pairs (a, b) with a Jaccard similarity of SIMILARITY or more."""
    texts = [lines.select(F.col("hi").alias(end), F.struct("line", "size", "sketch").alias(side)) for end, side in ("ax", "by")]
    both = pairs.join(texts[0], "a").join(texts[1], "b")
    words = ([F.get(f"{side}.sketch", F.lit(k)) for k in range(SKETCH)] for side in "xy")
    both = both.where(may_be_similar(*words, F.col("x.size"), F.col("y.size")))
    both = both.select("a", "b", F.struct(F.col("x.line").alias("x"), F.col("y.line").alias("y")).alias("pair"))
    return map_texts(both, similar_pairs, "similarity double").where(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b")


def may_be_similar(x: list[Column], y: list[Column], x_size: Column, y_size: Column) -> Column:
    """Whether the sketches x and y of two sets leave a similarity of SIMILARITY open."""
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)), F.lit(0))
    return apart <= (x_size + y_size) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6


def unjoined_pairs(shared: DataFrame, lines: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket that no links join yet and whose sketches leave a similarity of SIMILARITY open.

    Of two lines in different components, one is not in that of the bucket's centre: those lines are compared with all
    the others. Sets of x and y shingles in all that reach the similarity differ in
    (x + y) * (1 - SIMILARITY) / (1 + SIMILARITY) at most, so no such pair is missed. Every pair of blocks is a group of
    its own, and the join gives only the pairs that pass.
    """
    rooted = shared.join(roots.toDF("line", "root"), "line", "left").join(roots.toDF("centre", "main"), F.col("centres")[0] == F.col("centre"), "left")
    rooted = rooted.withColumn("centre", F.col("centres")[0]).select("band", "line", F.coalesce("root", "line").alias("root"), F.coalesce("main", "centre").alias("main"))
    rooted = materialise(rooted)
    open_buckets = rooted.groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("apart")).where("apart > 0 and n > 1")
    left = rooted.join(open_buckets.select("band", "n"), "band").join(lines.select(F.col("hi").alias("line"), "size", "sketch"), "line")
    left = materialise(left.select("band", "line", "root", "main", "n", "size", *(F.get("sketch", F.lit(k)).alias(f"w{k}") for k in range(SKETCH))))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("line", "band"), blocks).cast("int")).withColumn("last", blocks - 1)
    x = left.where("root <> main").withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0), "last"))).alias("x")
    y = left.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), "last"))).alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    met = (c("x", "band") == c("y", "band")) & (c("x", "i") == c("y", "i")) & (c("x", "j") == c("y", "j")) & (c("x", "root") != c("y", "root"))
    met = met & may_be_similar(*([c(side, f"w{k}") for k in range(SKETCH)] for side in "xy"), c("x", "size"), c("y", "size"))
    pairs = x.join(y, met).select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b"))
    return materialise(pairs.distinct())


def classes(rows: DataFrame) -> DataFrame:
    """(hi, lo, root), written: the lines that similar ones link, and the least line of their component."""
    shared = buckets(bands_of(rows))
    pairs = shared.select("line", F.explode("centres").alias("centre")).where("line <> centre")
    pairs = pairs.select(F.least("line", "centre").alias("a"), F.greatest("line", "centre").alias("b")).distinct()
    lines = sketched(rows, shared.select("line").distinct())
    roots = components(similar(pairs, lines))
    rest = unjoined_pairs(shared, lines, roots)
    if not rest.isEmpty():
        roots = components(roots.toDF("a", "b").union(similar(rest, lines)))
    roots = roots.union(roots.select("root", "root").distinct())
    return materialise(roots.join(lines, F.col("node") == F.col("hi")).select("hi", "lo", "root"))


def repeated_places(rows: DataFrame, id_col: str | None) -> DataFrame:
    """(row, gone): for each row the places of its lines that go: of a component all but the first by id, row and place."""
    place = F.posexplode(F.arrays_zip("his", "los")).alias("at", "x")
    order = [F.col("doc")[id_col]] if id_col else []
    own = [c.alias("id") for c in order] or [F.lit(0).alias("id")]
    every = rows.select("row", *own, place).select("row", "id", "at", F.col("x.his").alias("hi"), F.col("x.los").alias("lo")).where("hi is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "at")).alias("first")
    each = every.groupBy("hi", "lo").agg(F.count("*").alias("n"), first).join(classes(rows), ["hi", "lo"], "left").where("root is not null or n > 1")
    each = materialise(each.select("hi", "lo", F.coalesce("root", "hi").alias("k1"), F.when(F.col("root").isNull(), F.col("lo")).otherwise(0).alias("k2"), "first"))
    heads = each.groupBy("k1", "k2").agg(F.min("first").alias("head"))
    stays = each.join(heads, ["k1", "k2"]).select("hi", "lo", F.col("head.row").alias("stay_row"), F.col("head.at").alias("stay_at"))
    gone = every.select("row", "at", "hi", "lo").join(stays, ["hi", "lo"]).where((F.col("row") != F.col("stay_row")) | (F.col("at") != F.col("stay_at")))
    return gone.groupBy("row").agg(F.collect_list("at").alias("gone"))


def remover() -> Callable[[list], list[tuple]]:
    """A function from (packed, gone) to (text,), without the lines at the places gone."""
    unpack = zstandard.ZstdDecompressor().decompress

    def of(row: dict) -> tuple:
        if row["packed"] is None:
            return (None,)
        text = unpack(row["packed"]).decode()
        if not row["gone"]:
            return (text,)
        gone = set(row["gone"])
        return ("\n".join(line for at, line in enumerate(text.split("\n")) if at not in gone),)

    return lambda rows: [of(r) for r in rows]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in its own columns, each text without the lines that repeat an earlier one; other columns stay as they are.

    Lines are parted by line feeds; blank lines always stay. A text all of whose lines go becomes empty; a null text
    stays null. Rows are told apart by themselves, not by their ids: of repeated rows, or rows that share an id, one
    keeps the line. Null ids come last in the order. An empty table gives an empty result.
    """
    rows = numbered(docs, text_col)
    joined = rows.select("row", "doc", "packed").join(repeated_places(rows, id_col), "row", "left").select("doc", F.struct("packed", "gone").alias("r"))
    kept = map_texts(joined, remover, "text string")
    return kept.select(*(F.col("text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
