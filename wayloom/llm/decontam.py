"""Benchmark decontamination by a broadcast table of n-gram hashes, with DataFrame functions alone.

Every run of WINDOW words of a benchmark item is a window; a shorter item is one window. The windows' hashes are
broadcast, block by block if there are many; the texts' own windows are hashed in place, met with the table, and hits
are verified word for word before they count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bits_of, in_bits, lower_ascii, materialise, numbered

WINDOW = 13
#: Windows of a block; a block takes some 150 bytes a window in each executor.
BLOCK_WINDOWS = 400_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and anything outside ASCII, A-Z as a-z; none for a null text."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def window_starts(words: Column, n: int) -> Column:
    """0, 1, ... for each run of n words; empty if there are fewer."""
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def window_hashes(words: Column, n: int) -> Column:
    return F.transform(window_starts(words, n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))


def windows_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, n, gram): each window of each item, gram being its words joined by spaces."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(0), F.size("words") - n)
    cut = items.select("item", n.alias("n"), "words", F.explode(starts).alias("at"))
    return cut.select("item", "n", F.array_join(F.slice("words", F.col("at") + 1, F.col("n")), " ").alias("gram")).distinct()


def possible_hits(rows: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, n_words, start, n, gram): for each of rows (row, text) the windows that agree with a gram by their hash, and
    one row with null start.

    Windows travel as their hash and place alone; the words stay behind, so that the work grows with the text's length.
    """
    blocks = max(1, -(-grams.count() // BLOCK_WINDOWS))
    words = rows.select("row", words_of(F.col("text")).alias("words"))
    # the words come in as an argument: named in the function they might be cut out anew for each window
    windows = lambda w: F.struct(F.size(w).alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), *(window_hashes(w, n) for n in lengths)).alias("h"))
    every = words.select("row", F.explode(F.transform(F.array("words"), windows)).alias("w"))
    every = every.select("row", "w.n_words", F.posexplode("w.h").alias("k", "h"))
    start, before = F.lit(None).cast("int"), F.lit(1)
    for n in lengths:
        start = F.when(F.col("n") == n, F.col("k") - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - n + 1, F.lit(0))
    found = None
    for b in range(blocks):
        table = grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        met = every.join(F.broadcast(table), "h", "left").where(F.col("gram").isNotNull() | (F.col("k") == 0 if b == 0 else F.lit(False)))
        met = met.select("row", "n_words", start.alias("start"), "n", "gram")
        found = met if found is None else found.union(met)
    return found


def among(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows with may: false if row is not among some (row). Only rows that may be need to be shuffled to join some."""
    return in_bits(rows, F.xxhash64("row"), bits_of(some.select(F.xxhash64("row").alias("h"))))


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(row, n_words, n_hit, spans, items) for each of rows (row, text)."""
    windows = windows_of(benchmark, item_col, item_text_col)
    grams = windows.select("n", "gram").distinct().withColumn("h", F.xxhash64(F.split("gram", " ")))
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # 13 values at most
    possible = possible_hits(rows, grams, lengths)
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "n", "gram"))
    per = materialise(possible.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list(hit).alias("hits")))
    # word for word, against the texts of rows with hits
    hit_rows = per.where(F.size("hits") > 0).select("row", "hits")
    texts = among(rows, hit_rows.select("row")).where("may").join(hit_rows, "row").select("row", "hits", words_of(F.col("text")).alias("words"))
    # the words come in as an argument: named in the function they would be cut out anew for each hit
    same = lambda w: F.filter("hits", lambda x: F.array_join(F.slice(w, x["start"] + 1, x["n"]), " ") == x["gram"])
    sure = texts.select("row", F.get(F.transform(F.array("words"), same), F.lit(0)).alias("hits"))
    covered = F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    sure = materialise(sure.select("row", F.array_sort(F.array_distinct(covered)).alias("at"), F.array_distinct(F.transform("hits", lambda x: x["gram"])).alias("grams")))
    # hit runs of words: from a place that does not follow a hit one to a place that none follows
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    spans = sure.select("row", F.size("at").cast("long").alias("n_hit"), F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("n"))).alias("spans"))
    named = sure.select("row", F.explode("grams").alias("gram")).join(windows.select("item", "gram"), "gram")
    named = named.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = per.select("row", F.col("n_words").cast("long").alias("n_words")).join(spans, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<struct<start:int,n:int>>")
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for each row of docs.

    spans: the hit runs of words in order, (start, n), disjoint; n_hit: words in them; items: ids as strings, sorted.
    A null text has no words and no hits. Repeated rows, rows that share an id and rows without one each give a row of
    their own. With no benchmark items nothing is hit; an empty table gives an empty result; other columns are ignored.
    """
    rows = numbered(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).select("row", "doc.*")
    found = contaminated_rows(rows.select("row", "text"), benchmark, item_col, item_text_col)
    return rows.select("row", "id").join(found, "row").select(F.col("id").alias(id_col), "n_words", "n_hit", "spans", "items")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, in their own columns; each row is judged by its own text alone."""
    rows = numbered(docs)
    found = contaminated_rows(rows.select("row", F.col("doc")[text_col].alias("text")), benchmark, "item_id", "text")
    bad = materialise(found.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select("row"))
    marked = among(rows, bad)
    kept = marked.where("NOT may").union(marked.where("may").join(bad, "row", "left_anti").select(marked.columns))
    return kept.select(*(F.col("doc")[c].alias(c) for c in docs.columns))
