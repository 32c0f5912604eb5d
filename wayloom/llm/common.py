"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scratch

#: Text is handed to the per-batch functions in runs of about this many bytes, so that a worker's memory is bounded
#: by it and by the longest single text.
CHUNK_BYTES = 2_000_000
#: Words of 64 bits in the broadcast filter; it has this many rows at most.
FILTER_WORDS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII text takes the fast path, where the general lower() does the same."""
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df in the shared folder named by spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch.folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new place in the shared scratch folder, and read back: a compact checkpoint."""
    return scratch.checkpoint(df, compression="zstd")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc), written: docs' rows in a struct, each with a number of its own, which recomputation cannot change."""
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[c] for c in docs.columns)).alias("doc")))


def word_and_bit(c: Column) -> tuple[Column, Column]:
    """The word of the filter that holds the long c, and the bit in it."""
    word = F.pmod(F.shiftright(c, 6), F.lit(FILTER_WORDS)).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))


def bits_of(ids: DataFrame) -> DataFrame:
    """(word, bits): a filter of fixed size on the one column of hashed longs of ids, FILTER_WORDS rows at most."""
    word, bit = word_and_bit(F.col(ids.columns[0]))
    return ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def in_bits(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """rows with may: false if key is not among the longs that bits_of() has seen. Nothing of rows is shuffled."""
    word, bit = word_and_bit(key)
    met = rows.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    return met.withColumn("may", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose column holds about CHUNK_BYTES.

    That column is a string, a binary, or a struct that begins with one or with its size in bytes.
    """
    sizes = batch.column(column)
    if pa.types.is_struct(sizes.type):  # the text or its size comes first in it
        sizes = sizes.field(0)
    if not pa.types.is_integer(sizes.type):
        sizes = pc.binary_length(sizes)
    start, size, lengths = 0, 0, sizes.to_pylist()
    for end, n in enumerate(lengths, 1):
        size += n or 0
        if size >= CHUNK_BYTES or end == len(lengths):
            yield batch.slice(start, end - start)
            start, size = end, 0


def map_texts(
    rows: DataFrame,
    text_function: Callable[[], Callable[[list], Iterable[tuple]]],
    result_schema: str,
) -> DataFrame:
    """Applies a function to the last column of rows, in chunks, and keeps the other columns before its results.

    text_function() is called once in each task and returns a function from a list of values (str, bytes or None)
    to one tuple of results for each of them.
    """
    kept = rows.columns[:-1]
    schema = rows.select(*kept).schema
    for field in rows.sparkSession.createDataFrame([], result_schema).schema:
        schema = schema.add(field)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    results = [arrow.field(i) for i in range(len(kept), len(arrow))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = text_function()
        for batch in batches:
            for part in slices(batch, len(kept)):
                out = list(zip(*apply(part.column(len(kept)).to_pylist()), strict=True))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
                columns += [pa.array(v, f.type) for v, f in zip(out, results, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                del out, columns
            pa.default_memory_pool().release_unused()  # workers live on between tasks

    return rows.mapInArrow(run, schema)
