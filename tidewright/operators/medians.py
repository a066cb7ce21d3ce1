"""Exact medians of many groups without gathering any group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import cut, join_small

#: Log-scale histogram cells per octave; a cell is about a quarter per cent wide.
CELLS_PER_OCTAVE = 256


def log_cell(x: Column) -> Column:
    """A bigint that never decreases as ``x`` grows, equal for values within one narrow cell."""
    size = F.floor(F.log2(F.abs(x)) * CELLS_PER_OCTAVE).cast("bigint") + F.lit(1_000_000)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("bigint"))


def middle_cells(hist: DataFrame) -> DataFrame:
    """The cells of a histogram ``(k, m, cell, n)`` that hold the middle ranks of each (k, m):
    ``(hk, hm, hc, below, lo, hi)`` with the count below the cell and the two middle ranks."""
    by_cell = Window.partitionBy("k", "m").orderBy("cell")
    return (
        hist.withColumn("upto", F.sum("n").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("k", "m")))
        .withColumn("lo", F.expr("(total - 1) div 2")).withColumn("hi", F.expr("total div 2"))
        .where((F.col("upto") > F.col("lo")) & (F.col("upto") - F.col("n") <= F.col("hi")))
        .select(F.col("k").alias("hk"), F.col("m").alias("hm"), F.col("cell").alias("hc"), (F.col("upto") - F.col("n")).alias("below"), "lo", "hi")
    )


def middle_values(values: DataFrame, names: list[str], upper: bool = False) -> DataFrame:
    """``(k, names...)``: the medians, from the counted values ``(k, m, x, n, below, lo, hi)`` of the middle cells."""
    by_value = Window.partitionBy("k", "m").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("n").over(by_value) + F.min("below").over(Window.partitionBy("k", "m")))

    def at(i: int, rank: str) -> Column:
        return F.min(F.when((F.col("m") == i) & (F.col("upto") > F.col(rank)), F.col("x")))

    return ranked.groupBy("k").agg(*[(at(i, "hi") if upper else (at(i, "lo") + at(i, "hi")) / 2).alias(n) for i, n in enumerate(names)])


def exact_medians(df: DataFrame, key: str, values: dict[str, Column], upper: bool = False) -> DataFrame:
    """One row per ``key`` with the exact median of every expression in ``values``.

    Two passes: a histogram on a logarithmic grid, combined before the shuffle, finds the
    cell that holds the middle ranks; a second pass counts the distinct values of that cell
    alone. No task sees more than the histogram, or the one cell, of a group, so a key with
    most of the rows costs no more than another.

    Nulls and NaN are left out; a key whose values are all null gets a null median; a null
    key is a key like any other. The mean of the two middle values is given for even counts, or
    the larger of them with ``upper``.
    """
    names = list(values)
    long = df.select(
        F.col(key).alias("k"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("m"), values[n].cast("double").alias("x")) for i, n in enumerate(names)])),
    ).where(F.col("x").isNotNull() & ~F.isnan("x"))
    long = long.withColumn("cell", log_cell(F.col("x")))
    hit = cut(middle_cells(long.groupBy("k", "m", "cell").agg(F.count(F.lit(1)).alias("n"))))
    same = F.col("k").eqNullSafe(F.col("hk")) & (F.col("m") == F.col("hm")) & (F.col("cell") == F.col("hc"))
    inside = join_small(long, hit, same)
    counted = inside.groupBy("k", "m", "x").agg(F.count(F.lit(1)).alias("n"), F.min("below").alias("below"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    return middle_values(counted, names, upper).withColumnRenamed("k", key)


def exact_positions(df: DataFrame, key: str, value: Column, places: dict[str, str]) -> DataFrame:
    """One row per ``key`` with the values at given places of its sorted values: ``places`` names them by
    expressions of ``total``, the number of values, from 0. Two passes, as in ``exact_medians``; nulls and NaN
    are left out, a null key is a key like any other."""
    names = list(places)
    long = df.select(F.col(key).alias("k"), value.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("cell", log_cell(F.col("x")))
    by_cell = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    hist = long.groupBy("k", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(by_cell)).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = F.inline(F.array(*[F.struct(F.lit(i).alias("p"), F.expr(f"cast({places[n]} as bigint)").alias("rank")) for i, n in enumerate(names)]))
    hit = hist.select("k", "cell", "n", "upto", wanted).where("rank < upto and rank >= upto - n")
    hit = cut(hit.select(F.col("k").alias("hk"), F.col("cell").alias("hc"), "p", "rank", (F.col("upto") - F.col("n")).alias("below")))
    inside = join_small(long, hit, F.col("k").eqNullSafe(F.col("hk")) & (F.col("cell") == F.col("hc")))
    by_value = Window.partitionBy("k", "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = inside.groupBy("k", "p", "x").agg(F.count(F.lit(1)).alias("n"), F.min("below").alias("below"), F.min("rank").alias("rank")).withColumn("upto", F.sum("n").over(by_value) + F.col("below"))
    found = counted.where(F.col("upto") > F.col("rank"))
    return found.groupBy(F.col("k").alias(key)).agg(*[F.min(F.when(F.col("p") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])
