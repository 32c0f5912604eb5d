"""The stream of revisions: late and replayed rows, restarts, batches that run again."""

import datetime as dt

from pyspark.sql import functions as F

from wayloom.operators import lore
from wayloom.streaming import revisions as rv

DAY = dt.datetime(2024, 5, 1)
SCHEMA = "title string, rev_no long, ts timestamp, text string"


def row(title, number, day, text="text"):
    return (title, number, DAY + dt.timedelta(days=day), f"{text} {number}" if text else text)


FILES = [
    [row("a", 1, 0), row("a", 2, 1), row("b", 1, 1), row("unwanted", 9, 1), row("c", 5, 2)],
    [row("a", 2, 1), row("b", 3, 5), row("b", 2, 3), row("c", 4, 1), row("a", 1, 0)],
    [row("c", 6, 6, ""), row("b", 3, 5), row("d", 1, 6), row("d", 1, 6), row("a", 7, 4)],
    [row("c", 5, 2), row("e", 2, 7, None), row("e", 1, 7), row("b", 4, 8)],
]


def put(spark, folder, number):
    spark.createDataFrame(FILES[number], SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")


def start(spark, folder, place, fold=16):
    feed = spark.readStream.schema(f"{SCHEMA}, part int").option("maxFilesPerTrigger", 1).parquet(folder)
    wanted = spark.createDataFrame([(t,) for t in "abcdea"], "title string")
    query = rv.keep_table(rv.without_replays(feed, wanted, "30 days"), place, f"{place}-state", fold)
    query.awaitTermination()
    return query


def found(spark, place):
    return sorted(map(tuple, rv.pages(spark, place).collect()))


def want(n):
    """The same by plain rules."""
    last = {}
    for title, number, _, text in (r for rows in FILES[:n] for r in rows):
        if title != "unwanted" and number >= last.get(title, (0,))[0]:
            last[title] = (number, text)
    return sorted((t, *x) for t, x in last.items() if x[1])


def test_restart_gives_the_same_table(spark, tmp_path):
    folder, place = str(tmp_path / "feed"), str(tmp_path / "table")
    for n in (0, 1):
        put(spark, folder, n)
    start(spark, folder, place)
    assert found(spark, place) == want(2)
    for n in (2, 3):
        put(spark, folder, n)
    query = start(spark, folder, place)  # goes on where the first left off
    assert found(spark, place) == want(4)
    at_once = str(tmp_path / "at-once")
    start(spark, folder, at_once)
    assert found(spark, at_once) == want(4)
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert states and all(s["operatorName"] == "dedupeWithinWatermark" for s in states)


def test_batches_that_run_again_and_folding(spark, tmp_path):
    place = str(tmp_path / "table")
    assert found(spark, place) == []
    frames = [spark.createDataFrame(rows, SCHEMA).where(F.col("title") != "unwanted") for rows in FILES]
    for number, batch in enumerate(frames):
        rv.upsert(batch, number, place, fold=2)
        rv.upsert(batch, number, place, fold=2)
        assert found(spark, place) == want(number + 1)
    assert rv._numbers(spark, place, "base") == [1, 3]
    rv.upsert(frames[3], 3, place, fold=2)
    assert found(spark, place) == want(4)


def test_replays_cost_no_batch_a_row_and_late_rows_end(spark, tmp_path):
    folder, place = str(tmp_path / "feed"), str(tmp_path / "table")
    early = [row("a", 1, 0), row("a", 1, 0)]
    for number, rows in enumerate([early, [row("b", 1, 90)], [row("b", 2, 91)], [row("a", 9, 1), row("b", 2, 91)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")
    start(spark, folder, place)
    assert found(spark, place) == [("a", 1, "text 1"), ("b", 2, "text 2")]  # 89 days behind is later than the delay
    rows = spark.read.parquet(*(f"{place}/batch={n}" for n in rv._numbers(spark, place, "batch")))
    assert rows.count() == 3


def test_texts_join_the_last_revisions_alone(spark):
    """Revisions that name their texts: only the last ones ask for them."""
    keys = spark.createDataFrame([(t, n, f"{t}{n}") for t in "abc" for n in range(50)], "title string, rev_no long, name string")
    asked = spark.sparkContext.accumulator(0)

    def add(rows):
        asked.add(rows.count())
        return rows.withColumn("text", F.when(F.col("title") == "c", "").otherwise(F.concat(F.lit("text of "), "name")))

    assert sorted(map(tuple, lore.latest_revision(keys, add).collect())) == [("a", 49, "text of a49"), ("b", 49, "text of b49")]
    assert asked.value == 3


def test_texts_join_the_last_revisions_of_a_batch_alone(spark, tmp_path):
    rows = [("a", n, DAY) for n in range(40)] + [("b", 3, DAY), ("b", 3, DAY)]
    spark.createDataFrame(rows, "title string, rev_no long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema("title string, rev_no long, ts timestamp").parquet(str(tmp_path / "feed"))
    asked = spark.sparkContext.accumulator(0)

    def add(last):
        asked.add(last.count())
        return last.withColumn("text", F.concat(F.lit("text "), F.col("rev_no").cast("string")))

    got = rv.run_to_end(feed, spark.createDataFrame([("a",), ("b",)], "title string"), with_text=add)
    assert sorted(map(tuple, got.collect())) == [("a", 39, "text 39"), ("b", 3, "text 3")] and asked.value == 2
