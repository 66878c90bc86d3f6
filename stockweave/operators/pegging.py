"""What a plan hangs together by: allocation that pegs demand to stock, walks over typed edges, causes of shortages, origins of dependent demand.

Edges have edge_type, from_id, to_id and priority; nodes node_id, node_type, quantity and due.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import counted, written
from .bom import united

#: Edges and reached nodes to a task of a walk's step.
STEP_ROWS = 50_000
SERIES = ["item_id", "location_id"]
STEP = "struct<step: int, node_id: string, node_type: string, edge_type: string, fact: string>"


@dataclass(frozen=True)
class Chains:
    """Series whose buckets lead to the next one each, and to nothing else; they are walked along within a series' row.

    `series` names them by item_id and location_id, once or more; `buckets` is an expression on those: an array of the buckets' node_id and start, in order. `feeds`
    (from_id, to_id, item_id, location_id) are edges from other nodes to a bucket, with its series. Series are dealt to `tasks` tasks.
    """

    series: DataFrame
    buckets: Column
    feeds: DataFrame
    tasks: int


def peg(demands: DataFrame, stock: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, bucket, priority, allocated): what each demand takes of the stock of its series' buckets.

    `demands` has node_id, rank (the smaller the earlier), due, qty and buckets, those that it consumes by edge
    priority; `stock` has bucket and closing. Demands are served by rank, due date and id; each takes what it needs
    of its buckets in turn, and reduces them. Demands of nothing, and buckets without stock, give no rows.

    A series' rows pass through one task in that order, and only what its buckets still hold is kept; so a series may have any
    number of demands.
    """
    held = stock.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("closing").cast("double")))).alias("held"))  # as many as the horizon has buckets
    return peg_held(demands, held, keys)


def peg_held(demands: DataFrame, closing: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """peg() with a row for each series: `held`, the closing stock by bucket. Series are dealt to `tasks` tasks, each of which sorts its own."""
    none = lambda kind: F.lit(None).cast(kind)
    first = closing.select(*keys, F.lit(0).alias("turn"), none("bigint").alias("rank"), none("date").alias("due"), none("string").alias("node_id"), none("double").alias("qty"), none("array<int>").alias("buckets"), "held")
    asked = demands.where("qty > 0").select(*keys, F.lit(1).alias("turn"), F.col("rank").cast("long").alias("rank"), "due", "node_id", F.col("qty").cast("double").alias("qty"), F.col("buckets").cast("array<int>").alias("buckets"), none("map<int,double>").alias("held"))
    rows = first.unionByName(asked)
    rows = (rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)).sortWithinPartitions(*keys, "turn", "rank", "due", "node_id")
    kinds = dict(demands.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", node_id string, bucket int, priority int, allocated double"

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for batch in batches:
            found = []
            for *series, turn, _, _, node, qty, buckets, stocks in batch.itertuples(index=False, name=None):
                if turn == 0:
                    now, held = series, dict(stocks)
                    continue
                if series != now:  # a series without stock
                    continue
                for priority, bucket in enumerate(buckets if buckets is not None else ()):
                    got = min(qty, held.get(bucket) or 0.0)
                    if got > 0:
                        held[bucket] -= got
                        qty -= got
                        found.append((*series, node, bucket, priority, got))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in out.split(", ")])

    return rows.mapInPandas(serve, out)


def walk(edges: DataFrame, roots: DataFrame, depth: int, tasks: int | None = None) -> DataFrame:
    """(root_id, node_id, depth, edge_type, path): all that is reached from each root (node_id) along edges, in `depth` steps at most.

    A node is reached once for each root, by the fewest steps; of ways of as many, by the one whose edge type and path come first. A root is its own
    first node, with edge type 'root'. Each step is a job that joins what the last one has reached, dealt to as many tasks as
    STEP_ROWS asks for, so that what one sorts doesn't grow with the tables. Edges are dealt to `tasks` tasks at first, which drop those that come twice.
    """
    edges = edges.select("edge_type", F.col("from_id").alias("node_id"), "to_id")
    edges, size = counted((edges.repartition(tasks, "node_id") if tasks else edges).distinct())
    front, n = counted(roots.select(F.col("node_id").alias("root_id"), "node_id", F.lit("root").alias("edge_type"), F.array("node_id").alias("path")).distinct())
    found = [front.withColumn("depth", F.lit(0))]
    seen = front.select("root_id", "node_id")
    for k in range(1, depth + 1):
        parts = 1 + (size["rows"] + n["rows"]) // STEP_ROWS
        ahead = front.drop("edge_type").repartition(parts, "node_id").join(edges.repartition(parts, "node_id"), "node_id").select("root_id", F.col("to_id").alias("node_id"), "edge_type", F.concat("path", F.array("to_id")).alias("path"))
        best = ahead.repartition(parts, "root_id", "node_id").groupBy("root_id", "node_id").agg(F.min(F.struct("edge_type", "path")).alias("b")).select("root_id", "node_id", "b.*")
        front, n = counted(best.join(seen, ["root_id", "node_id"], "left_anti"))
        if not n["rows"]:
            break
        found.append(front.withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front.select("root_id", "node_id"))
    return united(found).select("root_id", "node_id", "depth", "edge_type", "path")


def _units(qty: Column) -> Column:
    return F.coalesce(qty, F.lit(0)).cast("decimal(18,3)").cast("string")


def _said(node: Column, verb: str) -> Column:
    due = F.coalesce(F.concat(F.lit(" due "), node["due"].cast("string")), F.lit(""))
    return F.concat(node["node_type"], F.lit(" "), node["node_id"], F.lit(f" {verb} "), _units(node["quantity"]), F.lit(" units"), due)


def explain(short: DataFrame, edges: DataFrame, nodes: DataFrame, on_hand_type: str = "OnHandSupply") -> DataFrame:
    """Adds `causes`, three steps, `root_cause` (a node, if one is to blame) and `summary` to shortages (node_id, shortage_qty, bucket_end).

    First the demand that consumes the bucket, then the supply that replenishes it, each the first by edge priority and id; stock on hand is
    no supply here. Last why that isn't enough: it is due after the bucket's end (on it is in time), or it is
    smaller than the shortage, or all demand together is more; or there is no supply.
    """
    ends = edges.where(F.col("edge_type").isin("consumes", "replenishes")).join(nodes.select(F.col("node_id").alias("from_id"), "node_type", "quantity", "due"), "from_id", "left")
    node = F.struct(F.col("from_id").alias("node_id"), "node_type", "quantity", "due")
    first = lambda kind: F.min_by(F.when(kind, node), F.when(kind, F.struct("priority", "from_id")))
    supply = (F.col("edge_type") == "replenishes") & F.col("node_type").isNotNull() & (F.col("node_type") != on_hand_type)
    best = ends.groupBy(F.col("to_id").alias("node_id")).agg(first(F.col("edge_type") == "consumes").alias("demand"), first(supply).alias("supply"))
    both = short.join(best, "node_id", "left")
    d, s, qty = F.col("demand"), F.col("supply"), F.coalesce("shortage_qty", F.lit(0.0))
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    step = lambda n, who, edge, fact: F.struct(F.lit(n).alias("step"), who["node_id"].alias("node_id"), who["node_type"].alias("node_type"), F.lit(edge).alias("edge_type"), fact.alias("fact")).cast(STEP)
    nobody = lambda n, edge, fact: F.struct(F.lit(n), F.lit(None), F.lit(None), F.lit(edge), fact if isinstance(fact, Column) else F.lit(fact)).cast(STEP)
    name = text(s["node_type"], " ", s["node_id"])
    late, little = s["due"] > F.col("bucket_end"), F.coalesce(s["quantity"], F.lit(0.0)) < qty
    days = F.datediff(s["due"], F.col("bucket_end")).cast("string")
    one = F.when(d.isNull(), nobody(1, "consumes", "nothing demands of this bucket")).when(d["node_type"].isNull(), step(1, d, "consumes", F.lit("the demand is gone"))).otherwise(step(1, d, "consumes", _said(d, "requires")))
    two = F.when(s.isNull(), nobody(2, "replenishes", "nothing replenishes this bucket")).otherwise(step(2, s, "replenishes", _said(s, "provides")))
    three = (
        F.when(s.isNull(), nobody(3, "governed_by", text("no supply for a shortage of ", _units(qty), " units")))
        .when(late, step(3, s, "depends_on", text(name, " is ", days, " days late")))
        .when(little, step(3, s, "depends_on", text(name, " is ", _units(qty - F.coalesce(s["quantity"], F.lit(0.0))), " units short of it")))
        .otherwise(nobody(3, "governed_by", text("demand is more than all supply by ", _units(qty), " units")))
    )
    both = both.withColumn("causes", F.array(one, two, three))
    fact = lambda i: F.element_at("causes", i)["fact"]
    blamed = F.when(late | little, s["node_id"])
    return both.withColumns({"root_cause": blamed, "summary": F.concat(fact(1), F.lit(". "), fact(3), F.lit("."))}).drop("demand", "supply")


def origins(params: DataFrame, gross: DataFrame, firm: DataFrame, bom: DataFrame) -> DataFrame:
    """(item_id, origin, qty): the dependent demand of each item by the items whose own demand it comes from.

    Demand over the whole horizon is netted level by level: independent and dependent demand and safety less stock and firm supply (item_id, qty
    each). What a made item then lacks is its components' dependent demand, with scrap. It is owed to the origins of the
    item's demand, itself for the independent part, by their shares. `params` has item_id, llc, is_make, on_hand, safety.
    A level is one job, which writes what it passes on by the component's level.
    """
    total = lambda flows, name: flows.groupBy("item_id").agg(F.sum("qty").cast("double").alias(name))
    rows = params.select("item_id", "llc", "is_make", "on_hand", "safety").join(total(gross, "own"), "item_id", "left").join(total(firm, "firm"), "item_id", "left")
    lacking = F.col("safety") - F.col("on_hand") - F.col("firm")
    rows = rows.na.fill(0.0, ["own", "firm", "on_hand", "safety"]).select("item_id", "is_make", "own", lacking.alias("lacking"), F.col("llc").alias("level"))
    rows = written(rows, "level")
    below = params.select(F.col("item_id").alias("component"), F.col("llc").alias("below"))
    uses = bom.join(below, "component").join(rows.select(F.col("item_id").alias("parent"), "level"), "parent")
    uses = written(uses.select("parent", "component", (F.col("qty_per") * (1 + F.col("scrap"))).alias("per"), "below", "level"), "level")
    levels = sorted(r.level for r in rows.select("level").distinct().collect())
    tables: list[DataFrame] = []
    for level in levels:
        of = lambda t: t.where(F.col("level") == level).drop("level")  # noqa: B023, E731
        own = of(rows.where("own > 0")).select("item_id", F.col("item_id").alias("origin"), F.col("own").alias("qty"))
        asked = united([own, *(of(t) for t in tables)])
        net = asked.groupBy("item_id").agg(F.sum("qty").alias("all")).join(of(rows.where("is_make")), "item_id").withColumn("net", F.col("all") + F.col("lacking")).where("`all` > 0 and net > 0")
        mix = asked.groupBy("item_id", "origin").agg(F.sum("qty").alias("qty")).join(net.select("item_id", "net", "all"), "item_id")
        made = mix.withColumn("part", F.col("net") * F.col("qty") / F.col("all")).join(of(uses), F.col("item_id") == F.col("parent"))
        tables.append(written(made.select(F.col("component").alias("item_id"), "origin", (F.col("part") * F.col("per")).alias("qty"), F.col("below").alias("level")), "level"))
    if not tables:
        return rows.select("item_id", F.col("item_id").alias("origin"), F.col("own").alias("qty"))
    return united(tables).groupBy("item_id", "origin").agg(F.sum("qty").alias("qty"))


def top_origins(found: DataFrame, n: int) -> DataFrame:
    """(item_id, rank, origin, qty): the n largest origins of each item, ties by id."""
    order = Window.partitionBy("item_id").orderBy(F.desc("qty"), "origin")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("item_id", "rank", "origin", "qty")


def dirty(events: DataFrame, edges: DataFrame | None, nodes: DataFrame, ahead: int = 365, chains: Chains | None = None) -> DataFrame:
    """(event_id, node_id): all that a change (event_id, trigger_id, old_date, new_date) makes to be planned anew.

    From the trigger along edges, however far; of nodes (node_id, start, keys item_id and location_id), those whose start is outside the window stop the walk
    and aren't part of it, those without a start are always in. The window goes from the earlier date to `ahead` days after the later one; without
    dates it has no ends. With one, all buckets of the trigger's own series in the window are dirty too. Each
    step along `edges`, if there are any, is a job that joins what the last one has reached. Buckets in `chains` take no steps.
    """
    dated = F.coalesce("old_date", "new_date").isNotNull()
    opens, shuts = F.least("old_date", "new_date"), F.date_add(F.greatest("old_date", "new_date"), ahead)
    events = events.select("event_id", "trigger_id", opens.alias("opens"), shuts.alias("shuts"), dated.alias("dated"))
    placed = written(events.join(nodes.select(F.col("node_id").alias("trigger_id"), "start", *SERIES), "trigger_id"))
    front = placed.where(_inside(F.col)).select("event_id", F.col("trigger_id").alias("node_id"), "opens", "shuts", "dated")
    found = [front]
    if edges is not None:
        ends = written(edges.select(F.col("from_id").alias("node_id"), F.col("to_id")).distinct().join(nodes.select(F.col("node_id").alias("to_id"), "start"), "to_id"))
        while True:
            next_ = front.join(ends, "node_id").where(_inside(F.col)).select("event_id", F.col("to_id").alias("node_id"), "opens", "shuts", "dated").distinct()
            front, n = counted(next_.join(united(found), ["event_id", "node_id"], "left_anti"))
            if not n["rows"]:
                break
            found.append(front)
    series = nodes.where("start is not null").select(F.col("node_id").alias("bucket_id"), "start", *SERIES)
    changed = placed.where("dated").drop("start")
    own = changed.hint("shuffle_hash").join(series, SERIES).where(_inside(F.col))  # the events are hashed; buckets aren't sorted in the task that makes them
    pairs = united([*(f.select("event_id", "node_id") for f in found), own.select("event_id", F.col("bucket_id").alias("node_id"))]).distinct()
    return pairs if chains is None else pairs.unionByName(_along(united(found), changed, chains))


def _inside(of: Callable[[str], Column], start: Column | None = None) -> Column:
    """Whether a start is in the window (opens, shuts, dated)."""
    start = F.col("start") if start is None else start
    return start.isNull() | ~of("dated") | ((start >= of("opens")) & (start < of("shuts")))


def _along(reached: DataFrame, changed: DataFrame, chains: Chains) -> DataFrame:
    """(event_id, node_id): the buckets of chains from those that reached nodes lead to up to the window's end, and all in the window of the changed triggers' own series.

    A row for each event and series has all ways into it (without a bucket: the series as a whole), so that no bucket comes twice. Events are hashed and
    series stream past them.
    """
    way = lambda to: F.struct("opens", "shuts", "dated", to.cast("string").alias("to_id")).alias("way")
    led = reached.join(chains.feeds.where("to_id is not null").withColumnRenamed("from_id", "node_id"), "node_id").select("event_id", *SERIES, way(F.col("to_id")))
    ways = led.unionByName(changed.select("event_id", *SERIES, way(F.lit(None)))).repartition(chains.tasks, *SERIES).groupBy("event_id", *SERIES).agg(F.collect_set("way").alias("ways"))
    rows = ways.hint("shuffle_hash").join(chains.series.repartition(chains.tasks, *SERIES).distinct(), SERIES).select("event_id", "ways", chains.buckets.alias("buckets"))

    def taken(w: Column) -> Column:
        whole = w["to_id"].isNull()
        now = lambda a, b: (a["on"] | b["node_id"].eqNullSafe(w["to_id"])) & _inside(w.getField, b["start"])
        step = lambda a, b: F.struct((whole | now(a, b)).alias("on"), F.when(now(a, b), F.concat(a["ids"], F.array(b["node_id"]))).otherwise(a["ids"]).alias("ids"))
        return F.aggregate("buckets", F.struct(whole.alias("on"), F.array().cast("array<string>").alias("ids")), step, lambda a: a["ids"])

    return rows.select("event_id", F.explode(F.array_distinct(F.flatten(F.transform("ways", taken)))).alias("node_id"))
