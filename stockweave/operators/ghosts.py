"""Virtual series made of several items: the hand-over from one item to the next, and members that share a capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timegrid
from .actions import as_of


def hand_over(ghosts: DataFrame, stock: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each ghost's weights and stocks on all days from `first` to `last`: baseline, delta, delta_pct, none where a stock isn't known or there is no baseline.

    `ghosts` has ghost_id, outgoing, incoming (items), start, end, curve, weight_at_start, weight_at_end: the outgoing item's weight, the incoming one has the rest.
    `stock` (item_id, day, closing) holds from its day on. The baseline is what the outgoing item alone would have: its stock by its weight, or the
    incoming item's if it has no weight left.
    """
    days = ghosts.withColumn("day", F.explode(F.sequence(first, last)))
    out = timegrid.transition_weight(F.col("day"), F.col("start"), F.col("end"), F.col("curve"), F.col("weight_at_start"), F.col("weight_at_end"))
    days = days.select("ghost_id", "outgoing", "incoming", "day", out.alias("weight_outgoing"))
    for item, name in (("outgoing", "stock_outgoing"), ("incoming", "stock_incoming")):
        facts = stock.select(F.col("item_id").alias(item), "day", F.col("closing").alias(name))
        days = as_of(days, facts, [item], "day", name)
    w, a, b = F.col("weight_outgoing"), F.col("stock_outgoing"), F.col("stock_incoming")
    baseline = F.when(w > 0, a / w).when(b > 0, b).otherwise(0.0)
    known = a.isNotNull() & b.isNotNull() & (baseline > 0)
    days = days.withColumns({"weight_incoming": 1 - w, "baseline": F.when(known, baseline)}).withColumn("delta", a + b - F.col("baseline"))
    return days.withColumn("delta_pct", F.abs("delta") / F.col("baseline"))


def inconsistent(days: DataFrame, threshold: float = 0.1) -> DataFrame:
    """The days of a hand-over whose stocks differ from the baseline by more than the threshold."""
    return days.where(F.col("delta_pct") > threshold)


def shared_capacity(members: DataFrame, load: DataFrame, capacity: DataFrame, first: Column, last: Column) -> DataFrame:
    """(ghost_id, day, load, capacity, slack, overloaded, members) of all days: what the members load together, and which of them (item_id, load) do, by id.

    `members` has ghost_id and item_id, `load` item_id, day, qty, `capacity` ghost_id and per_day. A ghost without members has no rows; one without capacity has 0.
    """
    per = load.groupBy("item_id", "day").agg(F.sum("qty").alias("qty")).join(members.select("ghost_id", "item_id").distinct(), "item_id")
    found = per.groupBy("ghost_id", "day").agg(F.sum("qty").alias("load"), F.sort_array(F.collect_list(F.struct("item_id", F.col("qty").alias("load")))).alias("members"))  # of one day
    grid = members.select("ghost_id").distinct().join(capacity.select("ghost_id", "per_day"), "ghost_id", "left").withColumn("day", F.explode(F.sequence(first, last)))
    both = grid.join(found, ["ghost_id", "day"], "left").na.fill(0.0, ["load", "per_day"])
    slack = F.round(F.col("per_day") - F.col("load"), 4)
    none = F.array().cast(found.schema["members"].dataType)
    return both.select("ghost_id", "day", F.round("load", 4).alias("load"), F.col("per_day").alias("capacity"), slack.alias("slack"), (F.col("per_day") < F.col("load")).alias("overloaded"), F.coalesce("members", none).alias("members"))
