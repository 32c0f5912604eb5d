"""Spelling variants: words of a corpus that differ by a single edit, each led to its usual form.

Two words of which the longer has L code points differ by one inserted, deleted or replaced code point exactly if their
common prefix and suffix together reach L - 1. One of both then reaches L // 2, so all such pairs meet in a tile: the
words of length L or L - 1 with an equal prefix, or an equal suffix, of L // 2 code points. The words of a tile are
compared densely, block against block, as padded matrices of code points; a tile of any size is split into blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Shortest words, least occurrences, how many times more often a form stands than its variant.
LENGTH, TIMES, RATIO = 6, 5, 5
#: Of the occurrences whose hash this divides one code point is deleted.
SLIP = 199
#: A task sends on its counts when it holds so many words; words of a block; cells of a matrix of compared pairs.
HELD, BLOCK, CELLS = 200_000, 512, 4_000_000
#: Letters as bytes of Latin-1, and a space for any other.
LETTERS = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def slipped(doc_id: int | None, run: bytes) -> bytes:
    """run, a lower-cased run of letters in Latin-1, or it without one code point."""
    h = crc32((b"" if doc_id is None else b"%d" % doc_id) + b":" + (run if run.isascii() else run.decode("latin-1").encode()))
    at = h % len(run)
    return run if h % SLIP else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(word, n): how often each word of length code points or more stands in the texts, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def send() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in found]
            out = pa.record_batch([pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    runs = (text or "").encode("latin-1", "replace").translate(LETTERS).lower().split()
                    for word, n in Counter(runs).items():
                        if len(word) >= length and len(word := slipped(doc_id, word)) >= length:
                            found[word] += n
                    if len(found) >= HELD:
                        yield send()
        yield send()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words: DataFrame) -> DataFrame:
    """(longer, tile, i, j, block, suffix, word, n): the rows of words (word, n), once for each pair of blocks they are in."""
    size = F.char_length("word")
    end = lambda suffix, more: F.struct(
        F.lit(suffix).alias("suffix"), (size + more).alias("longer"),
        F.xxhash64(size + more, (F.right if suffix else F.left)(F.col("word"), ((size + more) / 2).cast("int")), F.lit(suffix)).alias("tile"),
    )
    ends = F.explode(F.array(*(end(suffix, more) for suffix in (False, True) for more in (0, 1))))
    rows = words.select("word", "n", ends.alias("e")).select("word", "n", "e.*")
    sizes = rows.groupBy("tile").agg(F.count("*").alias("m")).where("m > 1")
    met = rows.join(sizes, "tile").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("longer", "tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "suffix", "word", "n")


def matrix(words: list[bytes], width: int) -> np.ndarray:
    """The words' bytes as rows of width cells, padded with zeros."""
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def common_start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row how many cells x and y have in common before the first that differs."""
    differs = np.ones((len(x), x.shape[1] + 1), bool)
    np.not_equal(x, y, out=differs[:, :-1])
    return differs.argmax(axis=1)


def near_in(group: np.ndarray, block: np.ndarray, same: np.ndarray, suffix: np.ndarray, words: list[bytes], longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near words in a run of whole groups, all for the same longer length; every pair is in one group of its kind."""
    ahead, behind = matrix(words, longer), matrix([w[::-1] for w in words], longer)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.searchsorted(group, group, side="right")
    follow = ends - np.arange(len(words)) - 1  # rows of the group after each row
    total = np.concatenate(([0], np.cumsum(follow)))
    half, found, at, most = longer // 2, [], 0, max(1, CELLS // longer)
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        a = np.repeat(np.arange(at, end), follow[at:end])
        b = a + 1 + np.arange(len(a)) - (total[at:end] - total[at]).repeat(follow[at:end])
        wanted = (same[a] | (block[a] != block[b])) & (np.maximum(sizes[a], sizes[b]) == longer)
        a, b = a[wanted], b[wanted]
        shorter = np.minimum(sizes[a], sizes[b])
        start = np.minimum(common_start(ahead[a], ahead[b]), shorter)
        stop = np.minimum(common_start(behind[a], behind[b]), shorter)
        near = (start + stop >= longer - 1) & np.where(suffix[a], (start < half) & (stop >= half), start >= half)
        found.append((a[near], b[near]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n), in both directions: the pairs of words (word, n) that one edit parts."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Near words of whole groups of rows, sorted by the longer length and the group."""
        longer = rows.column("longer").to_numpy()
        cuts = np.flatnonzero(np.diff(longer)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(longer)], strict=True):
            part = rows.slice(start, end - start)
            if end - start < 2:
                continue
            group, block, same, suffix = (part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "block", "same", "suffix"))
            number = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
            a, b = near_in(number, block, same, suffix, [w.encode("latin-1") for w in part.column("word").to_pylist()], int(longer[start]))
            if len(a):
                word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
                x, y = np.concatenate((a, b)), np.concatenate((b, a))
                yield pa.record_batch([word.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            pair = rows.column("pair").to_numpy()
            last = int(np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))[-1])
            yield from compare(rows.slice(0, last))
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield from compare(held)

    rows = tiles(words).withColumn("pair", F.xxhash64("tile", "i", "j")).withColumn("same", F.col("i") == F.col("j"))
    rows = rows.select("longer", "pair", "block", "same", "suffix", "word", "n").repartition("pair").sortWithinPartitions("longer", "pair")
    return rows.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last form that forms lead to. Each round doubles the steps taken."""
    step = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = step.toDF("root", "next")
        joined = step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        joined = materialise(joined)
        step = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return step


def is_form(form_n: Column, n: Column) -> Column:
    return form_n >= RATIO * n


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the texts with LENGTH code points and TIMES occurrences or more.

    A word is a run of Latin letters, lower-cased from A to Z; some occurrences lose a code point (slipped). A word's
    form is the most frequent of its near words, of several as frequent the smallest, if it stands RATIO times as often
    as the word or more; its root is where forms lead. Null and empty texts have no words, rows that repeat count again,
    a null id is written as nothing before the colon. An empty table gives an empty result; other columns are ignored.
    """
    words = materialise(word_counts(docs, id_col, text_col).where(F.col("n") >= TIMES))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    usual = is_form(-F.col("best.less"), F.col("n"))
    all_words = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"),
    )
    all_words = materialise(all_words)
    lead = roots(all_words.where("form is not null").select("word", "form"))
    return all_words.join(lead, "word", "left").withColumn("root", F.coalesce("root", "word"))
