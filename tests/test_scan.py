"""Running totals over sorted ranges, and what is numbered by them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayloom.functions.scan import running
from wayloom.operators.gazetteer import dedupe_slugs


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running_totals_of_keys_of_any_size(spark, hot):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randrange(40), k, rng.randrange(-5, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "key int, at int, v long").repartition(5)
    got = {r["at"]: (r.total, r.total_total, r.bits, r.bits_total) for r in running(df, ["key"], [F.col("at").desc()], {"total": F.col("v")}, {"bits": F.col("at")}).collect()}
    want, sums, bits = {}, Counter(), Counter()
    for key, at, v in sorted(rows, key=lambda r: -r[1]):
        sums[key] += v
        bits[key] ^= at
        want[at] = (key, sums[key], bits[key])
    assert got == {at: (s, sums[key], b, bits[key]) for at, (key, s, b) in want.items()}
    assert running(df.limit(0), ["key"], [F.col("at")], {"total": F.col("v")}).count() == 0


def test_slugs_of_thousands_without_a_name(spark):
    names = ["Unnamed"] * 4000 + ["King's Road", "Kings Road", "Élan", "Unnamed"]
    df = spark.createDataFrame(list(enumerate(names)), "place_idx int, name string").repartition(7)
    got = {r.place_idx: r.slug for r in dedupe_slugs(df).collect()}
    assert [got[k] for k in range(4000)] == ["unnamed"] + [f"unnamed-{k + 1}" for k in range(1, 4000)]
    assert got[4003] == "unnamed-4001" and len(set(got.values())) == len(names)
