"""Demand history: predicates, prices, totals, gaps, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..sources.written import written


def business_demand(history: DataFrame, as_of: str, lookback: int) -> DataFrame:
    """Orders and forecast booked in [as_of - lookback, as_of); supply and what goes to other sites isn't business demand."""
    day = F.lit(as_of).cast("date")
    return history.where(F.col("kind").isin("order", "forecast") & F.col("booked").isNotNull() & (F.col("booked") >= F.date_sub(day, lookback)) & (F.col("booked") < day))


def selling_price(history: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Average selling price of the trailing months per item: value over units, items without units left out."""
    day = F.lit(as_of).cast("date")
    window = history.where((F.col("booked") >= F.add_months(day, -months)) & (F.col("booked") < day))
    sums = window.groupBy("item_id").agg(F.sum("qty").alias("units"), F.sum(rules.cents(F.col("price"))).alias("cents")).where("units > 0")
    return sums.select("item_id", "units", (F.col("cents") / 100).alias("value"), rules.unit_price(F.col("cents"), F.col("units")).alias("asp"))


def price_summary(prices: DataFrame) -> DataFrame:
    """Count, median and range of the prices."""
    return prices.agg(F.count("asp").alias("n"), F.median("asp").alias("median"), F.min("asp").alias("lowest"), F.max("asp").alias("highest"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows with a value and a positive weight; null without any."""
    good = value.isNotNull() & (weight > 0)
    return F.sum(F.when(good, value * weight)) / F.sum(F.when(good, weight))


def freshness(history: DataFrame, as_of: str) -> DataFrame:
    """Last booking per item and its age in days, none below 0."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.max("booked")))
    return history.groupBy("item_id").agg(F.max("booked").alias("last_booked"), age.alias("age_days"))


def period_ends(points: DataFrame) -> DataFrame:
    """Forecast points as spans: to the item's next date; the last by the upper median gap, else 7 days."""
    dates = points.groupBy("item_id", "due").agg(F.sum("qty").alias("qty"))
    nexts = dates.withColumn("end", F.lead("due").over(Window.partitionBy("item_id").orderBy("due")))
    days = nexts.where("end is not null").select("item_id", F.datediff("end", "due").alias("days"))
    own = Window.partitionBy("item_id")
    placed = days.select("item_id", "days", F.row_number().over(own.orderBy("days")).alias("at"), F.count("*").over(own).alias("n"))
    middle = placed.where("at = floor(n / 2) + 1").select("item_id", F.col("days").alias("gap"))
    gaps = dates.select("item_id").distinct().join(middle, "item_id", "left").select("item_id", F.coalesce("gap", F.lit(7)).alias("gap"))
    spans = nexts.join(gaps, "item_id")
    return spans.select("item_id", "due", F.coalesce("end", F.date_add("due", F.col("gap"))).alias("end"), "qty")


def pareto(totals: DataFrame, parts: int = 256) -> DataFrame:
    """Rank by quantity (ties by item), cumulative share of the whole and ABC class, without a sort of all rows in one task.

    Rows are cut into ranges of the quantity, of which only counts and sums meet in one
    task; ranks and running sums are taken within a range and moved by what lies above it.
    """
    order = [F.desc("qty"), "item_id"]
    cut = totals.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    cut = written(cut)  # read twice, and ranges must not be drawn anew
    all_parts = cut.groupBy("part").agg(F.count("*").alias("n"), F.sum("qty").alias("of"), F.max("qty").alias("top"))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = all_parts.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.coalesce(F.sum("of").over(above), F.lit(0.0)).alias("sum"), F.sum("of").over(Window.partitionBy()).alias("whole"))
    own = Window.partitionBy("part").orderBy(*order)
    ranked = cut.join(F.broadcast(starts), "part")  # as many rows as there are ranges
    share = F.round((F.col("sum") + F.sum("qty").over(own.rowsBetween(Window.unboundedPreceding, 0))) / F.col("whole"), 6)
    out = ranked.select("item_id", "qty", (F.col("before") + F.row_number().over(own)).alias("rank"), share.alias("share"))
    return out.withColumn("class", abc(F.col("share")))


def abc(share: Column) -> Column:
    return F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C")


def series_features(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Depth, gaps and value of each item's bookings, its class and the method that suits it."""
    window = business_demand(history, as_of, days)
    f = window.groupBy("item_id").agg(F.countDistinct("booked").alias("active_days"), F.min("booked").alias("first"), F.max("booked").alias("last"), F.sum("qty").alias("qty"))
    span = F.datediff("last", "first") + 1
    f = f.withColumn("span", span).withColumn("zero_ratio", F.round(1 - F.col("active_days") / span, 6)).withColumn("idle", F.datediff(F.lit(as_of).cast("date"), "last"))
    label = F.when(F.col("active_days") < 3, "cold_start").when(F.col("idle") > days / 3, "end_of_life").when(F.col("zero_ratio") >= 0.9, "intermittent").otherwise("regular")
    method = F.when(label == "cold_start", "MOVING_AVERAGE").when(label == "intermittent", "CROSTON").otherwise("AUTO")
    return f.select("item_id", "active_days", "span", "zero_ratio", "idle", "qty", label.alias("class"), method.alias("method"))
