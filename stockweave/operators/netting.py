"""Forecast consumption, shortages of a plan, excess and obsolescence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consume(demand: DataFrame, fence: int = 0, strategy: str = "max_only") -> DataFrame:
    """Gross demand of each item and bucket from its orders and forecast.

    Inside the fence orders only; beyond it by strategy, the larger of both unless it
    is forecast_only or orders_only. Buckets without demand are left out.
    """
    beyond = {"forecast_only": F.col("forecast"), "orders_only": F.col("orders")}.get(strategy, F.greatest("orders", "forecast"))
    gross = F.when(F.col("bucket") < fence, F.col("orders")).otherwise(beyond)
    return demand.select("item_id", "bucket", gross.alias("gross")).where("gross <> 0")


def consume_weekly(demand: DataFrame, fence: int, strategy: str = "MAX") -> DataFrame:
    """The other model's weekly consumption: the larger of both inside the fence, the forecast beyond."""
    inside = F.col("bucket") < fence
    choice = {
        "FORECAST_ONLY": F.col("forecast"),
        "ORDERS_ONLY": F.when(inside, F.col("orders")).otherwise(0.0),
    }.get(strategy, F.when(inside, F.greatest("orders", "forecast")).otherwise(F.col("forecast")))
    return demand.select("item_id", "bucket", choice.alias("consumed"))


def offsets(window: int) -> list[int]:
    """0, then each distance back before ahead."""
    return [0, *(s * d for d in range(1, window + 1) for s in (-1, 1))]


def consume_windowed(demand: DataFrame, window: int, fence: int = 0) -> DataFrame:
    """Each order, in bucket order, eats forecast at the nearest buckets within the window; fenced buckets stay.

    Gross is the orders and what is left of the forecast. Sequential by item, so an item is
    one row with an entry for each of its buckets; many items are walked in one batch.
    """
    order = offsets(window)
    out = "item_id long, bucket int, gross double"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for items in batches:
            found = []
            for item, entries in zip(items["item_id"].tolist(), items["entries"], strict=True):
                orders, forecast = {}, {}
                for e in entries:
                    orders[e["bucket"]], forecast[e["bucket"]] = e["orders"], e["forecast"]
                for bucket, qty in orders.items():
                    for at in (bucket + step for step in order) if bucket >= fence else ():
                        if qty > 0 and at >= fence and forecast.get(at, 0) > 0:
                            eaten = min(qty, forecast[at])
                            forecast[at] -= eaten
                            qty -= eaten
                gross = ((b, q + (forecast[b] if b >= fence else 0.0)) for b, q in orders.items())
                found += [(item, b, q) for b, q in gross if q]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in out.split(", ")])

    # A bucket occurs once for each item, so an item has as many entries as the horizon has buckets.
    lists = demand.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "orders", "forecast"))).alias("entries"))
    return lists.mapInPandas(walk, out)


def excess(stock: DataFrame, gross: DataFrame, weeks: int, months: float = 6.0) -> DataFrame:
    """OBSOLETE without demand, EXCESS beyond the months of cover, with the surplus; items in balance are left out."""
    used = gross.where(F.col("bucket") < weeks).groupBy("item_id").agg(F.sum("gross").alias("demand"))
    both = stock.join(used, "item_id", "left").withColumn("annual", F.coalesce("demand", F.lit(0.0)) * 52 / weeks)
    limit = F.col("annual") * months / 12
    label = F.when(F.col("annual") == 0, "OBSOLETE").when(F.col("on_hand") > limit, "EXCESS")
    return both.where("on_hand > 0").select("item_id", "on_hand", F.round("annual", 4).alias("annual"), label.alias("class"), F.round(F.col("on_hand") - limit, 4).alias("surplus")).where("class is not null")


def eo_action(label: str):
    """STOP_BUY for what has no demand, REVIEW for excess."""
    return F.when(F.col(label) == "OBSOLETE", "STOP_BUY").when(F.col(label) == "EXCESS", "REVIEW").otherwise("HOLD")
