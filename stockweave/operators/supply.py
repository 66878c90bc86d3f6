"""Distribution and promising: lanes, fair shares, transfers, available-to-promise, capacity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def location_excess(stock: DataFrame, demand: DataFrame, safety: float) -> DataFrame:
    """On-hand beyond the horizon's demand and safety, where there is any."""
    used = demand.groupBy("item_id", "location_id").agg(F.sum("qty").alias("demand"))
    left = F.col("on_hand") - F.coalesce("demand", F.lit(0.0)) - safety
    return stock.join(used, ["item_id", "location_id"], "left").select("item_id", "location_id", left.alias("excess")).where("excess > 0")


def candidate_lanes(lanes: DataFrame, excess: DataFrame, deficits: DataFrame) -> DataFrame:
    """(item_id, source, dest, priority, lead, multiple, least, most) from where an item is in excess to where it is short.

    An item's own lanes replace the generic ones (null item_id) between the same places. What
    an item has and lacks names its places, so lanes are joined by places and never made for all items.
    """
    have = excess.select("item_id", F.col("location_id").alias("source"))
    lack = deficits.select("item_id", F.col("location_id").alias("dest"))
    terms = ["priority", "lead", "multiple", "least", "most"]
    ends = ["item_id", "source", "dest"]
    own = lanes.where("item_id is not null").join(have, ["item_id", "source"], "left_semi").join(lack, ["item_id", "dest"], "left_semi").select(*ends, *terms)
    generic = lanes.where("item_id is null").drop("item_id").join(have, "source").join(lack, ["item_id", "dest"], "left_semi").select(*ends, *terms)
    return own.unionByName(generic.join(own.select(*ends).distinct(), ends, "left_anti"))


def _whole(qty: float, multiple: float, least: float) -> float:
    """As much of a quantity as a lane ships: whole multiples, nothing below its least."""
    shipped = math.floor(qty / multiple) * multiple if multiple > 0 else qty
    return shipped if shipped > 0 and shipped >= least else 0.0


def fair_shares(excess: dict[int, float], deficits: dict[int, tuple[int, float]], lanes: list[tuple]) -> list[tuple]:
    """(source, dest, qty, ship_bucket, arrival_bucket) of one item; lanes are (priority, source, dest, lead, multiple, least, most).

    By priority, and then by source (those with the lowest priority of any of their lanes
    first): a source splits what it has among the destinations of that priority in proportion
    to what they lack; what rounding leaves goes to the neediest that can take a whole
    multiple, as long as there is one. A lane's most holds for both passes of its source and priority.
    """
    lack, have, found = {d: qty for d, (_, qty) in deficits.items()}, dict(excess), []
    first = {source: min(lane[0] for lane in lanes if lane[1] == source) for source in {lane[1] for lane in lanes}}
    for level in sorted({lane[0] for lane in lanes}):
        for source in sorted(first, key=lambda s: (first[s], s)):
            here = sorted((lane for lane in lanes if lane[:2] == (level, source)), key=lambda x: (x[2], x[6], x[5], x[4], x[3]))
            room = [lane[6] for lane in here]

            def ship(dest: int, part: float) -> float:
                sent = 0.0
                for k, (_, _, to, lead, multiple, least, _) in enumerate(here):
                    qty = _whole(min(part - sent, lack[dest], have[source], room[k]), multiple, least) if to == dest else 0.0
                    if qty > 0:
                        lack[dest] -= qty
                        have[source] -= qty
                        room[k] -= qty
                        sent += qty
                        leaves = max(0, deficits[dest][0] - lead)
                        found.append((source, dest, qty, leaves, leaves + lead))
                return sent

            short = sorted({lane[2] for lane in here if lack[lane[2]] > 0})
            total, start = sum(lack[d] for d in short), have[source]
            if start <= 0 or total <= 0:
                continue
            for dest, part in [(d, min(lack[d], start * lack[d] / total)) for d in short]:
                ship(dest, part)
            while short and have[source] > 0:
                dest = min(short, key=lambda d: (-lack[d], d))
                if lack[dest] <= 0 or not ship(dest, lack[dest]):
                    short.remove(dest)
    return found


def transfers(excess: DataFrame, deficits: DataFrame, lanes: DataFrame) -> DataFrame:
    """(item_id, source, dest, qty, ship_bucket, arrival_bucket) by fair_shares(), which an item's places and lanes alone decide."""
    out = "item_id long, source long, dest long, qty double, ship_bucket int, arrival_bucket int"
    paths = candidate_lanes(lanes, excess, deficits)
    grouped = paths.groupBy("item_id").agg(F.collect_list(F.struct("priority", "source", "dest", "lead", "multiple", "least", F.coalesce("most", F.lit(math.inf)).alias("most"))).alias("lanes"))
    have = excess.groupBy("item_id").agg(F.collect_list(F.struct("location_id", "excess")).alias("have"))
    lack = deficits.groupBy("item_id").agg(F.collect_list(F.struct("location_id", "bucket", "deficit")).alias("lack"))

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for item, ways, own, short in zip(rows["item_id"].tolist(), rows["lanes"], rows["have"], rows["lack"], strict=True):
                sent = fair_shares({e["location_id"]: e["excess"] for e in own}, {e["location_id"]: (e["bucket"], e["deficit"]) for e in short}, [tuple(w.values()) for w in ways])
                found += [(item, *s) for s in sent]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in out.split(", ")])

    return grouped.join(have, "item_id").join(lack, "item_id").mapInPandas(share, out).groupBy("item_id", "source", "dest", "ship_bucket", "arrival_bucket").agg(F.sum("qty").alias("qty"))


def split_shares(observed: DataFrame) -> DataFrame:
    """(item_id, location_id, pct): historical shares at 8 decimals; what rounding leaves goes to the largest, then the least location."""
    own = Window.partitionBy("item_id")
    total = F.sum("qty").over(own)
    pct = observed.where("qty > 0").withColumn("pct", F.bround(F.col("qty").cast("decimal(20,4)") / total.cast("decimal(20,4)"), 8).cast("decimal(12,8)"))
    first = F.row_number().over(own.orderBy(F.desc("pct"), "location_id")) == 1
    residual = F.lit(1).cast("decimal(12,8)") - F.sum("pct").over(own)
    return pct.withColumn("pct", F.when(first, F.col("pct") + residual).otherwise(F.col("pct"))).select("item_id", "location_id", F.col("pct").cast("double").alias("pct"))


def promise(buckets: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request's first day with enough from its day on, what is promised then, and the backorder."""
    keys = ["item_id", "location_id"]
    both = requests.join(buckets, keys).where("day >= request_day")
    enough = F.when(F.col("closing") >= F.col("qty"), F.col("day"))
    some = F.when(F.col("closing") > 0, F.struct("day", "closing"))
    out = both.groupBy(*keys, "request_id", "request_day", "qty").agg(F.min(enough).alias("full_day"), F.max(some).alias("last"))
    given = F.when(F.col("full_day").isNotNull(), F.col("qty")).otherwise(F.coalesce("last.closing", F.lit(0.0)))
    day = F.coalesce("full_day", "last.day")
    return out.select("request_id", *keys, day.alias("day"), given.alias("promised"), (F.col("qty") - given).alias("backorder"), (F.col("full_day") == F.col("request_day")).alias("on_time"))


def backward_load(orders: DataFrame, operations: DataFrame, capacity: float = 8.0) -> DataFrame:
    """(resource_id, day, hours): operations placed from the last back to the first, each spread evenly over whole days.

    Hours are summed as whole numbers of 1e-9, so that the sum doesn't depend on the order of its terms, and rounded once to 4 decimals.
    """
    whole = lambda c: F.round(c * 10000).cast("long")
    jobs = orders.join(operations, F.col("routing_id") == F.col("routing")).withColumn("h", whole(F.col("setup") + F.col("run") * F.col("qty")))
    jobs = jobs.withColumn("days", F.greatest(F.lit(1), F.ceil(F.col("h") / (capacity * 10000))).cast("int"))
    after = F.sum("days").over(Window.partitionBy("order_id").orderBy(F.desc("sequence")))  # operations of one sequence number take place together
    placed = jobs.withColumn("first", F.col("due_day") - after + 1)
    parts = placed.select("resource_id", F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("days") - 1).cast("int"))).alias("day"), F.expr("h * 100000 div days").alias("part"))
    return parts.where("day >= 0").groupBy("resource_id", "day").agg((F.expr("(sum(part) + 50000) div 100000") / 10000).alias("hours"))
