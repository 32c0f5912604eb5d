"""Document fingerprints by consistent weighted sampling, with DataFrame functions alone.

A text's terms are its words, weighted by how often they stand in it. For each of SAMPLES samples a term draws from its
own hash r and c, both gamma(2, 1), and b, uniform; with weight w it quantises t = floor(ln w / r + b) and competes
with ln a = ln c - r (t - b + 1). The term with the smallest a wins, and (term, t) is the sample. Two texts have equal
samples with a probability that is the generalised Jaccard similarity of their weights; the share of equal samples has a
standard error of sqrt(J (1 - J) / SAMPLES), 0.125 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered
from .decontam import words_of

#: Samples of a fingerprint.
SAMPLES = 16


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """A long that orders by a (31 bits) and ends in the hash of (term, t) (32 bits)."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda h, bit: (F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(0x1FFFFF)) + 0.5) / float(1 << 21)
    r = -F.ln(unit(x, 0) * unit(x, 21))
    log_c = F.ln(-F.ln(unit(y, 0) * unit(y, 21)))
    b = unit(y, 42)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1)
    rank = F.least(F.greatest((log_a + 100) * float(1 << 24), F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("long")
    return F.shiftleft(rank, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(term, t), 32))


def signatures(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """The keys of texts, no two rows of which share them, with samples, an array of SAMPLES longs.

    A text without words is one term itself.
    """
    words = words_of(F.col(text_col))
    rows = texts.select(*keys, F.col(text_col).alias("__text"), words.alias("__words"))
    own = F.array(F.xxhash64("__text"))
    hashed = rows.select(*keys, F.when(F.size("__words") > 0, F.sort_array(F.transform("__words", lambda w: F.xxhash64(w)))).otherwise(own).alias("__h"))
    at = F.filter(F.sequence(F.lit(0), F.size("__h") - 1), lambda i: (i == 0) | (F.get("__h", i) != F.get("__h", i - 1)))
    runs = hashed.select(*keys, "__h", at.alias("__at"))
    following = F.concat(F.slice("__at", 2, F.size("__at")), F.array(F.size("__h")))
    pairs = F.zip_with("__at", following, lambda i, j: F.struct(F.get("__h", i).alias("term"), (j - i).alias("weight")))
    terms = runs.select(*keys, F.explode(pairs).alias("__t")).select(*keys, F.col("__t.term").alias("term"), F.ln("__t.weight").alias("log_weight"))
    best = terms.groupBy(*keys).agg(*(F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"__s{k}") for k in range(SAMPLES)))
    return best.select(*keys, F.array(*(F.col(f"__s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(SAMPLES))).alias("samples"))


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def following(texts: DataFrame) -> DataFrame:
    """(row, id, n, next_row), written: each of texts (row, id, text) with its length and the row of the next one.

    The order is by id, descending, null ids last, equal ids by the hash of their text; the first row follows the last.
    Only ids are sorted. A part of the sorted rows knows all its neighbours but the first of the next part, and these
    firsts, one a part, are broadcast.
    """
    order = [F.col("id").desc_nulls_last(), "version", "row"]
    keys = texts.select("row", "id", F.char_length("text").alias("n"), F.xxhash64("text").alias("version"))
    parts = materialise(keys.orderBy(*order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*order)
    led = parts.select("row", "id", "n", "part", F.lead("row").over(inside).alias("after"), F.row_number().over(inside).alias("place"))
    whole = Window.partitionBy().orderBy("part")  # as many rows as parts
    first = led.where("place = 1").select("part", F.col("row").alias("first"))
    next_first = F.coalesce(F.lead("first").over(whole), F.first("first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = F.broadcast(first.select("part", next_first.alias("other")))
    return materialise(led.join(firsts, "part").select("row", "id", "n", F.coalesce("after", "other").alias("next_row")))


def plain_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text), written: docs' rows, numbered; a null text is empty."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return numbered(rows).select("row", "doc.id", "doc.text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of docs; a null text counts as empty."""
    texts = plain_texts(docs, id_col, text_col)
    signed = signatures(texts.select("row", "text"), ["row"], "text")
    return texts.select("row", "id").join(signed, "row").select(F.col("id").alias(id_col), as_text(F.col("samples")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    A null text counts as empty. Repeated rows and rows that share an id each give a row, next to each other in the
    order; null ids come last. One row alone follows itself. An empty table gives an empty result; other columns are
    ignored.
    """
    texts = plain_texts(docs, id_col, text_col)
    order = following(texts)
    own = texts.select("row", "text")
    third = F.floor(F.col("n") / 3).cast("int")
    heads = own.join(order.select(F.col("next_row").alias("row"), F.col("row").alias("before"), third.alias("third")), "row")
    heads = heads.select(F.col("before").alias("row"), F.substring("text", F.lit(1), F.col("third")).alias("head"), "third")
    both = own.join(heads, "row").withColumn("edit", F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("third")), "head"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edit").alias("t")))
    # the text's digest goes along as a key: rows dealt by row stay where they are
    rows = both.select("row", F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), F.explode(sides).alias("s")).select("row", "edited_sha256", "s.side", "s.t")
    each = signatures(rows, ["row", "edited_sha256", "side"], "t")
    sample_of = lambda side: F.max(F.when(F.col("side") == side, F.col("samples")))
    signed = materialise(each.groupBy("row", "edited_sha256").agg(sample_of(0).alias("text"), sample_of(1).alias("edit")))
    after = signed.select(F.col("row").alias("next_row"), F.col("text").alias("next_own"))
    out = order.join(signed, "row").join(after, "next_row")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("text")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edit")).alias("near_edited"), likeness(F.col("text"), F.col("next_own")).alias("near_next"),
    )
