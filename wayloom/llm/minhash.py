"""MinHash near-dedup with odd sketches.

A document's set is that of its distinct shingles of five words. SAMPLES minima of it under as many hash functions make
its signature: BANDS bands of ROWS minima are bucket keys, so that two documents of Jaccard similarity J share none with
a probability of (1 - J ** ROWS) ** BANDS, 4e-7 at 0.85. All minima are folded into an odd sketch, a bitmap of ODD_WORDS
words in which each sample turns one bit: minima that two documents share cancel in the XOR of their sketches, and the
number x of bits left estimates J as 1 + n / (4 k) ln(1 - 2 x / n) for k samples and n bits, most precisely where J is
high. At 0.85 an estimate under FLOOR is more than six standard errors off. A second bitmap, of the whole set, bounds the
similarity from above. What both leave open is confirmed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import map_texts, materialise
from .linededup import FACTOR, mixed
from .links import apart, buckets, confirmed, in_parts, linked, parities, set_sketches, sets_may_reach, shingle_sets, texts_of

WORDS, SIMILARITY = 5, (85, 100)
SAMPLES, BANDS, ROWS, ODD_WORDS = 256, 20, 4, 8
FLOOR = 0.65
#: Elements whose minima are taken at once.
STEP = 1024
_RANDOM = np.random.default_rng(11)
XORS, ODDS = _RANDOM.integers(0, 1 << 32, SAMPLES, np.uint32), _RANDOM.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)


def signature(elements: np.ndarray) -> np.ndarray:
    """The SAMPLES minima of a set of 64-bit hashes."""
    x, least = (elements >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), STEP):
        np.minimum(least, ((x[at : at + STEP, None] ^ XORS) * ODDS).min(axis=0), out=least)
    return least


def band_keys(minima: np.ndarray) -> np.ndarray:
    """BANDS signed keys for each row of minima."""
    rows = minima[:, : BANDS * ROWS].reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = mixed(key * np.uint64(FACTOR) + rows[:, :, r])
    return key.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """ODD_WORDS words for each row of minima: the parity of the samples that fall on each bit."""
    place = mixed(minima.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) & np.uint64(64 * ODD_WORDS - 1)
    owner = np.repeat(np.arange(len(minima)), SAMPLES)
    return parities(owner, place.astype(np.int64).ravel(), len(minima), ODD_WORDS)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of two sets from their odd sketches; minus infinity where half the bits differ or more."""
    bits = 64 * ODD_WORDS
    left = 1 - 2 * apart(x, y) / bits
    return np.where(left > 0, 1 + bits / (4 * SAMPLES) * np.log(np.maximum(left, 1e-9)), -np.inf)


def near(x_size: np.ndarray, y_size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimate for pairs of sketches, an odd one and that of the set each; -1 where SIMILARITY is out of reach."""
    least = SIMILARITY[0] / SIMILARITY[1]
    found = estimate(x[:, :ODD_WORDS], y[:, :ODD_WORDS])
    open_ = (found >= FLOOR) & (np.minimum(x_size, y_size) >= least * np.maximum(x_size, y_size) - 1e-6)
    return np.where(open_ & sets_may_reach(least, x_size, y_size, x[:, ODD_WORDS:], y[:, ODD_WORDS:]), found, -1)


def signatures() -> Callable[[list], list[tuple]]:
    """A function from texts (bytes) to (size, node, bits, bands); node tells sets apart and is null for an empty one."""

    def of(texts: list) -> list[tuple]:
        sets = shingle_sets(texts, WORDS)
        minima = np.stack([signature(s) for s in sets])
        bits = np.concatenate((odd_sketches(minima), set_sketches(sets)), axis=1)
        keys = band_keys(minima).tolist()
        return [(len(s), xxh3_128_digest(s.tobytes()), bits[k].tobytes(), keys[k]) if len(s) else (0, None, None, []) for k, s in enumerate(sets)]

    return in_parts(of)


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of docs.

    Texts of equal sets, and sets whose Jaccard similarity is SIMILARITY or more, are linked; component_id is the
    smallest id that links lead to, kept whether it is the row's own. Null texts and texts without words have an empty
    set, linked with nothing, and are kept. Rows are told apart by themselves, not by their ids. A null id leads nowhere:
    its row has the component of what it is linked with, and is kept if that has no id at all. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    rows = materialise(map_texts(rows, signatures, "n_shingles long, node binary, bits binary, bands array<long>"))
    one = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key")).alias("one")
    nodes = rows.where("node is not null").groupBy("node").agg(one, F.min("bits").alias("bits"), F.min("n_shingles").alias("size"), F.min("bands").alias("bands"))
    nodes = materialise(nodes.select("node", "one.id", "one.key", "size", "bits", "bands"))
    shared = buckets(nodes.select(F.explode("bands").alias("band"), "node"))
    some = nodes.select("node", "id", "key", "size", "bits").join(shared.select("node").distinct(), "node", "left_semi")
    some = materialise(some)
    own = docs.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    texts = texts_of(own, some.select("node", "id", "key"))
    roots = linked(shared, some.select("node", "size", "bits"), near, lambda pairs: confirmed(pairs, texts, WORDS, SIMILARITY))

    named = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = materialise(named)
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    found = named.join(least, "root").select("node", "least")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    out = rows.select("id", "n_shingles", "node").join(found, "node", "left").select("id", "n_shingles", component.alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
