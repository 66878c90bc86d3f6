"""Bills of material: levels, closure, explosion, cost roll-up.

Each walks level by level, once; a level is one job, which writes its rows and so cuts the lineage.
A walk that goes on past as many levels as there are parents is in a cycle; that raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import counted, written

#: Levels that are walked before parents are counted.
USUAL = 16


def fronts(first: DataFrame, step: Callable[[DataFrame], DataFrame], bom: DataFrame) -> Iterator[DataFrame]:
    """What each level's `step` makes of the one before, written, until one is empty. The step is the same plan each time, so its code is compiled once."""
    front, level, parents = first, 0, None
    while True:
        front, n = counted(step(front))
        if not n["rows"]:
            return
        level += 1
        yield front
        if level >= USUAL:
            parents = bom.select("parent").distinct().count() if parents is None else parents
            if level > parents:
                raise ValueError("the bill of materials has a cycle")


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for one in tables[1:]:
        out = out.unionByName(one)
    return out


def low_level_codes(items: DataFrame, bom: DataFrame) -> DataFrame:
    """item_id, llc: the longest path from a root; 0 for roots and standalone items.

    Level k has the items that some path of k edges leads to; the last such k is an item's code.
    """
    edges = written(bom.select("parent", F.col("component").alias("item_id")).distinct())
    below = lambda front: edges.join(front.select(F.col("item_id").alias("parent")), "parent", "left_semi").select("item_id").distinct()
    found = [edges.select("item_id").distinct(), *fronts(edges, below, edges)]
    found = united([items.select("item_id", F.lit(0).alias("llc")), *(f.withColumn("llc", F.lit(k)) for k, f in enumerate(found, 1))])
    return found.groupBy("item_id").agg(F.max("llc").alias("llc"))


def closure(bom: DataFrame) -> DataFrame:
    """ancestor, component, depth: every pair with the least number of levels between. A cycle raises."""
    edges = written(bom.select("parent", F.col("component").alias("below")).distinct())
    front = edges.select(F.col("parent").alias("ancestor"), F.col("below").alias("component"))
    step = lambda front: front.join(edges, F.col("component") == F.col("parent")).select("ancestor", F.col("below").alias("component")).distinct()
    pairs = united([f.withColumn("depth", F.lit(k)) for k, f in enumerate((front, *fronts(front, step, edges)), 1)])
    return pairs.groupBy("ancestor", "component").agg(F.min("depth").alias("depth"))


def explode(demand: DataFrame, bom: DataFrame) -> DataFrame:
    """item_id, gross: independent demand and what it needs of all components, with scrap. A cycle below it raises."""
    bom = written(bom)
    first = written(demand.groupBy("item_id").agg(F.sum("qty").alias("gross")))

    def step(front: DataFrame) -> DataFrame:
        need = F.sum(F.col("gross") * F.col("qty_per") * (1 + F.col("scrap")))
        return front.join(bom.hint("merge"), F.col("item_id") == F.col("parent")).groupBy(F.col("component").alias("item_id")).agg(need.alias("gross"))  # neither side passes through the driver, at any level

    return united([first, *fronts(first, step, bom)]).groupBy("item_id").agg(F.sum("gross").alias("gross"))


def explode_net(demand: DataFrame, bom: DataFrame, on_hand: DataFrame) -> DataFrame:
    """(root, item_id, level, path, gross, net): a line for every way from each demanded item (item_id, qty) to a component.

    A line is netted by itself against all that is on hand of its component, and passes what is lacking on, or the gross
    quantity where nothing is. Quantities are rounded to 6 decimals. A cycle below the demand raises.
    """
    uses = written(bom.join(on_hand.select(F.col("item_id").alias("component"), "on_hand"), "component", "left").na.fill(0.0, ["on_hand"]))
    first = written(demand.groupBy("item_id").agg(F.sum("qty").alias("passed")).select(F.col("item_id").alias("root"), "item_id", F.array("item_id").alias("path"), "passed"))

    def step(front: DataFrame) -> DataFrame:
        lines = front.select("root", "item_id", "path", "passed").join(uses, F.col("item_id") == F.col("parent"))
        lines = lines.withColumn("gross", F.round(F.col("passed") * F.col("qty_per") * (1 + F.col("scrap")), 6))
        lines = lines.withColumn("net", F.round(F.greatest(F.lit(0.0), F.col("gross") - F.col("on_hand")), 6))
        passed = F.when(F.col("net") > 0, F.col("net")).otherwise(F.col("gross"))
        return lines.select("root", F.col("component").alias("item_id"), F.concat("path", F.array("component")).alias("path"), "gross", "net", passed.alias("passed"))

    found = list(fronts(first, step, uses))
    if not found:
        return first.select("root", "item_id", F.lit(0).alias("level"), "path", F.col("passed").alias("gross"), F.col("passed").alias("net")).limit(0)
    return united([f.withColumn("level", F.lit(k)) for k, f in enumerate(found, 1)]).select("root", "item_id", "level", "path", "gross", "net")


def cost_rollup(items: DataFrame, bom: DataFrame, levels: DataFrame) -> DataFrame:
    """item_id, cost, currency: bought items at their standard cost, made ones at their components', deepest level first.

    An item that lacks the cost of a component has none. Its currency is its components', USD where they differ; no
    amounts are converted. `items` may do without a currency, which is USD then. What a level adds to its parents is written by
    their level, so that each cost is read once.
    """
    bom = bom.join(levels.select(F.col("item_id").alias("parent"), F.col("llc").alias("up")), "parent")
    lists = bom.groupBy(F.col("component").alias("item_id")).agg(F.collect_list(F.struct("parent", "up", (F.col("qty_per") * (1 + F.col("scrap"))).alias("per"))).alias("uses"))
    made = bom.groupBy(F.col("parent").alias("item_id")).agg(F.count("*").alias("parts"))
    items = items if "currency" in items.columns else items.withColumn("currency", F.lit("USD"))
    rows = items.select("item_id", F.col("standard_cost").alias("cost"), "currency").join(levels, "item_id").join(made, "item_id", "left").join(lists, "item_id", "left")
    rows = written(rows.withColumn("level", F.col("llc")), "level")
    deepest = rows.agg(F.max("llc")).first()[0]
    tables: list[DataFrame] = []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = rows.where(F.col("level") == level)
        cost, currency = F.col("cost"), F.col("currency")
        if tables:
            adds = united([t.where(F.col("level") == level) for t in tables]).groupBy("item_id")
            adds = adds.agg(F.sum("cost").alias("rolled"), F.count("cost").alias("known"), F.min("currency").alias("one"), F.max("currency").alias("other"))
            here = here.join(adds, "item_id", "left")
            cost = F.when(F.col("parts").isNull(), F.col("cost")).when(F.col("known") == F.col("parts"), F.col("rolled"))
            currency = F.when(F.col("parts").isNull(), F.col("currency")).when(F.col("one") == F.col("other"), F.col("one")).otherwise("USD")
        out = here.select("item_id", cost.alias("cost"), currency.alias("currency"), "uses")
        up = F.transform(F.coalesce("uses", F.array().cast("array<struct<parent: bigint, up: int, per: double>>")), lambda u: F.struct(u["parent"].alias("item_id"), (F.col("cost") * u["per"]).alias("cost"), F.col("currency").alias("currency"), u["up"].alias("level")))
        own = F.array(F.struct("item_id", "cost", "currency", F.lit(-1).alias("level")))
        tables.append(written(out.select(F.explode(F.concat(own, up)).alias("e")).select("e.*"), "level"))
    if not tables:
        return items.select("item_id", F.col("standard_cost").alias("cost"), "currency").limit(0)
    return united([t.where("level = -1") for t in tables]).select("item_id", "cost", "currency")
