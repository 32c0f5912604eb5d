"""A stream of page revisions, kept as a table of the latest of each wanted page.

The stream's state holds keys and times alone, and lets go of them when the watermark passes. Texts pass through, or
join a micro-batch's last revisions if the stream only names them: each micro-batch writes the last revision of every
page it names under its own number, so that a batch that runs again after a failure overwrites itself; every so often
the batches are folded into a base. The table is the base and the batches after it, read by highest revision.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import folder

COLUMNS = "title string, rev_no long, text string"
#: How far behind the latest event time a revision may come, and how many batches go into the next base.
DELAY, FOLD = "30 days", 16
#: Adds the column text to rows of revisions that name their texts.
AddText = Callable[[DataFrame], DataFrame]


def without_replays(revisions: DataFrame, wanted: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream revisions (title, rev_no, ts, text), cut down to wanted titles; a replayed revision comes once.

    Rows more than delay behind the latest ts are late for good and dropped; so is the memory of what came that long ago.
    """
    met = revisions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).join(wanted.select("title").distinct(), "title", "left_semi")
    return met.dropDuplicatesWithinWatermark(["title", "rev_no"])


def last_of(revisions: DataFrame, with_text: AddText = lambda last: last) -> DataFrame:
    """(title, rev_no, text) of the highest revision of each title, empty texts included; of equal numbers the least text.

    Numbers are found first, so that no aggregation carries the texts of older revisions. Where revisions name their
    texts instead of holding them, with_text adds the column text to the highest ones alone.
    """
    last = revisions.groupBy("title").agg(F.max("rev_no").alias("rev_no"))
    return with_text(revisions.join(last, ["title", "rev_no"])).groupBy("title", "rev_no").agg(F.min("text").alias("text"))


def _numbers(spark: SparkSession, place: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind below place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/{kind}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(re.search(rf"{kind}=(-?\d+)/", str(f.getPath()))[1]) for f in found or [])


def every_page(spark: SparkSession, place: str) -> DataFrame:
    """(title, rev_no, text) of the last revision of every page of the table at place, emptied pages included."""
    base = max(_numbers(spark, place, "base"), default=None)
    later = [n for n in _numbers(spark, place, "batch") if base is None or n > base]
    paths = [f"{place}/batch={n}" for n in later] + ([] if base is None else [f"{place}/base={base}"])
    return last_of(spark.read.schema(COLUMNS).parquet(*paths)) if paths else spark.createDataFrame([], COLUMNS)


def pages(spark: SparkSession, place: str) -> DataFrame:
    """every_page() but for pages whose last text is empty or null."""
    return every_page(spark, place).where("text <> ''")


def upsert(batch: DataFrame, number: int, place: str, fold: int = FOLD, with_text: AddText = lambda last: last) -> None:
    """Puts a micro-batch into the table at place; the same number again changes nothing."""
    spark = batch.sparkSession
    last_of(batch.withColumn("rev_no", F.col("rev_no").cast("long")), with_text).write.mode("overwrite").parquet(f"{place}/batch={number}")
    if (number + 1) % fold == 0:
        every_page(spark, place).write.mode("overwrite").parquet(f"{place}/base={number}")


def keep_table(fresh: DataFrame, place: str, checkpoint: str, fold: int = FOLD, with_text: AddText = lambda last: last) -> StreamingQuery:
    """Starts to keep the table at place up to date with what has come; one table belongs to one checkpoint."""
    writer = fresh.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: upsert(batch, number, place, fold, with_text)).start()


def run_to_end(revisions: DataFrame, wanted: DataFrame, delay: str = DELAY, with_text: AddText = lambda last: last) -> DataFrame:
    """pages() after all that the stream revisions holds now, in a new table in the shared folder."""
    spark = revisions.sparkSession
    place = f"{folder(spark)}/streams/{uuid.uuid4().hex}"
    keep_table(without_replays(revisions, wanted, delay), place, f"{place}-state", with_text=with_text).awaitTermination()
    return pages(spark, place)
