"""Running totals and numbers over a sorted table of which no key or range has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import checkpoint


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """df with a running value for each name of sums and xors, and with <name>_total, the value of the whole key.

    The rows of a key run in the given order, which has to tell apart all rows that differ in what is summed. They are
    sorted into ranges over the whole table, so a key of any size is cut wherever a range ends; each range is summed by
    itself, then the values of the ranges before it are added. Only keys that more than one range holds need that: two
    for each range at most, so the table of offsets that is broadcast has a row or two for each partition. Null keys are
    a key like others.
    """
    values = [(n, c, F.sum, lambda a, b: a + b) for n, c in (sums or {}).items()]
    values += [(n, c, F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for n, c in (xors or {}).items()]
    own = [f"__scan_{n}_own" for n, *_ in values]
    ranged = df.select(*df.columns, *(c.cast("long").alias(f"__scan_{n}_own") for n, c, *_ in values))
    ranged = checkpoint(ranged.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("__scan_part", F.spark_partition_id()))

    here = Window.partitionBy("__scan_part", *keys)
    upto = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select(*df.columns, "__scan_part", *(f(o).over(upto).alias(n) for o, (n, _, f, _) in zip(own, values)), *(f(o).over(here).alias(f"{n}_total") for o, (n, _, f, _) in zip(own, values)))

    parts = ranged.groupBy(*keys, "__scan_part").agg(*(f(o).alias(o) for o, (_, _, f, _) in zip(own, values)))
    every = Window.partitionBy(*keys)
    before = every.orderBy("__scan_part").rowsBetween(Window.unboundedPreceding, -1)
    several = parts.withColumn("__scan_n", F.count("*").over(every)).where("__scan_n > 1")
    several = several.select(
        *(F.col(k).alias(f"__scan_key{i}") for i, k in enumerate(keys)), F.col("__scan_part").alias("__scan_at"),
        *(F.coalesce(f(o).over(before), F.lit(0)).alias(f"{o}_before") for o, (_, _, f, _) in zip(own, values)), *(f(o).over(every).alias(f"{o}_all") for o, (_, _, f, _) in zip(own, values)),
    )
    met = F.col("__scan_part") == F.col("__scan_at")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__scan_key{i}"))
    joined = local.join(F.broadcast(several), met, "left")
    out = []
    for n, _, _, plus in values:
        out += [plus(F.col(n), F.coalesce(f"__scan_{n}_own_before", F.lit(0))).alias(n), F.coalesce(f"__scan_{n}_own_all", f"{n}_total").alias(f"{n}_total")]
    return joined.select(*df.columns, *out)
