"""Exact quantiles of any number of groups, without a task that holds a group's values.

Approximate quantiles cut each group into some hundred ranges, counts of these say
exactly which range holds a wanted rank, and only that range is cut again. A range
shrinks by some hundred times a round, whatever the distribution, so a few rounds leave
ranges that are one value, or so few values that one task sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import kept_tables, materialize, temporary_tables
from .sizes import small

#: Ranges a round cuts a range into, accuracy of the cuts, and values that one task sorts.
RANGES, ACCURACY, FEW = 128, 5000, 20_000


def _narrowed(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks`` (g, name, k, low, high, before, m) with ranges that are cut once more. values: (g, name, v)."""
    cell = ["g", "name", "low", "high"]
    wide = small(ranks.select(*cell).distinct())
    inside = values.join(wide, ["g", "name"]).where("v >= low and v <= high")
    cuts = inside.groupBy(*cell).agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("cuts"))
    placed = values.join(small(materialize(cuts, "cuts")), ["g", "name"]).where("v >= low and v <= high").withColumn("i", F.expr("size(filter(cuts, c -> c < v))"))
    parts = placed.groupBy(*cell, "i").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
    parts = parts.withColumn("start", F.sum("n").over(Window.partitionBy(*cell).orderBy("i")) - F.col("n"))  # RANGES rows at most
    joined = ranks.join(parts, cell).where("k >= before + start and k < before + start + n")
    return joined.select("g", "name", "k", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("before") + F.col("start")).alias("before"), F.col("n").alias("m"))


def order_statistics(values: DataFrame, ranks: DataFrame, few: int = FEW) -> DataFrame:
    """(g, name, k, v): the value of rank k, from 0, among those of its group and name. values: (g, name, v), a table or a cheap scan; ranks: (g, name, k, low, high, before, m)."""
    done: list[DataFrame] = []
    state = ranks
    while True:
        state = materialize(state, "ranks")
        done.append(state.where(f"low = high or m <= {few}"))
        state = state.where(f"low < high and m > {few}")
        if state.isEmpty():
            break
        state = _narrowed(values, state)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    cell = ["g", "name", "low", "high"]
    open_ = found.where("low < high")
    inside = values.join(small(open_.select(*cell).distinct()), ["g", "name"]).where("v >= low and v <= high")
    inside = inside.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("v")) - 1)  # ``few`` rows at most
    sorted_ = open_.join(inside, cell).where("at = k - before").select("g", "name", "k", "v")
    return found.where("low = high").select("g", "name", "k", F.col("low").alias("v")).unionByName(sorted_)


def quantiles(rows: DataFrame, by: list[str], columns: dict[str, Column], wanted: list[float], few: int = FEW) -> DataFrame:
    """(by, name, q, value): quantiles with linear interpolation of each column, of its values that are not null.

    A group without values has no rows; null is a group like any other. NaN counts as the largest value."""
    spark = rows.sparkSession
    with temporary_tables(spark):
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()]))
        values = materialize(rows.select(F.struct(*by).alias("g"), each.alias("x")).select("g", "x.name", "x.v").where("v is not null"), "values")
        total = values.groupBy("g", "name").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        at = F.explode(F.array(*[F.lit(float(q)) for q in wanted])).alias("q")
        total = materialize(total.select("*", at).withColumn("at", (F.col("m") - 1) * F.col("q")), "totals")
        ends = total.withColumn("k", F.explode(F.array(F.floor("at"), F.ceil("at")))).select("g", "name", "k", "low", "high", F.lit(0).cast("bigint").alias("before"), "m").distinct()
        found = order_statistics(values, ends, few)
        pair = total.join(found, ["g", "name"]).where("k = floor(at) or k = ceil(at)")
        out = pair.groupBy("g", "name", "q", "at").agg(F.min_by("v", "k").alias("a"), F.max_by("v", "k").alias("b"))
        value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
        with kept_tables():
            return materialize(out.select(*[F.col(f"g.{c}").alias(c) for c in by], "name", "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(value).alias("value")), "quantiles")
