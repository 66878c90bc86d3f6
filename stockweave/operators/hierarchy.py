"""Hierarchies of items: which leaves each node sums, middle-out reconciliation, and a bench of reconciliation methods.

A hierarchy has `levels` (root first), nodes (code, parent_code, level) and members (item_id, code): an item is
attached to one node. A block is a node of the block level with all that is below it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import counted, written


def default_hierarchy(registry: DataFrame, domain: str) -> str:
    """The one hierarchy of `registry` (hierarchy_id, domain, is_default) that is its domain's default; none or several raise."""
    found = [r.hierarchy_id for r in registry.where((F.col("domain") == domain) & F.col("is_default")).select("hierarchy_id").orderBy("hierarchy_id").limit(3).collect()]
    if len(found) != 1:
        raise ValueError(f"domain {domain!r} has {'no' if not found else 'several'} default hierarchies: {found}")
    return found[0]


def refuse(bad: DataFrame, what: str) -> None:
    """Raise with the first few rows of `bad`, if it has any."""
    rows = [", ".join(map(str, r)) for r in bad.limit(5).collect()]
    if rows:
        raise ValueError(f"{what}: {'; '.join(rows)}")


def summing(levels: Sequence[str], nodes: DataFrame, members: DataFrame, block_level: str | None = None) -> DataFrame:
    """(block, code, level, item_id): the leaves that each node of each block sums; a node without leaves has one row with a null item.

    These raise: no levels, a block level or a node's level that isn't declared, repeated codes, parents that
    aren't nodes, parents in a cycle (of any block), items attached twice or to what is no node. The walk goes from
    all nodes to their parents together, a level of the tree with each step.
    """
    block_level = block_level or next(iter(levels), None)
    if block_level not in levels:
        raise ValueError(f"{block_level!r} is not among the levels {list(levels)}")
    nodes = written(nodes.select("code", "parent_code", "level"))
    refuse(nodes.where(~F.col("level").isin(list(levels)) | F.col("level").isNull() | F.col("code").isNull()).select("code", "level"), "nodes of no declared level")
    refuse(nodes.groupBy("code").count().where("count > 1"), "repeated node codes")
    up = nodes.where("parent_code is not null").select(F.col("code").alias("below"), F.col("parent_code").alias("above"))
    known = nodes.select("code")
    refuse(up.join(known, F.col("above") == F.col("code"), "left_anti"), "unknown parents")
    refuse(members.join(known, "code", "left_anti").select("item_id", "code"), "items of unknown nodes")
    refuse(members.groupBy("item_id").count().where("count > 1"), "items attached twice")

    front = nodes.select("code", F.col("code").alias("ancestor"))
    pairs = front
    while True:
        above = front.join(up, F.col("ancestor") == F.col("below")).select("code", F.col("above").alias("ancestor"))
        front, n = counted(above, own=F.col("code") == F.col("ancestor"))
        if n["own"]:
            refuse(front.where("code = ancestor").select("code"), "parents in a cycle")
        if not n["rows"]:
            break
        pairs = pairs.unionByName(front)
    pairs = written(pairs)
    roots = nodes.where(F.col("level") == block_level).select("code")
    inside = pairs.join(roots, F.col("ancestor") == roots["code"], "left_semi").select(F.col("ancestor").alias("block"), "code")
    own = pairs.select(F.col("code").alias("held"), F.col("ancestor").alias("code")).join(members.select("item_id", F.col("code").alias("held")), "held").select("code", "item_id")
    return inside.join(nodes.select("code", "level"), "code").join(own, "code", "left").select("block", "code", "level", "item_id")


def node_totals(sums: DataFrame, values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(block, code, level, keys, qty): the values (item_id, keys, qty) of each node's leaves, added; 0 for nodes without any, where there are no keys."""
    each = values.groupBy("item_id", *keys).agg(F.sum("qty").alias("qty"))
    joined = sums.join(each, "item_id", "inner" if keys else "left")
    return joined.groupBy("block", "code", "level", *keys).agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("qty"))


def shares(leaves: DataFrame) -> DataFrame:
    """Adds `share` of its node and `cold` to each leaf (block, node, held, item_id, weight).

    `held` is the node that the item is attached to. A leaf without weight takes the mean of the positive ones of the same `held`; where
    there are none it has no share, unless others of its node have. A negative weight raises, once its row is read.
    """
    sane = F.when(F.col("weight") < 0, F.raise_error(F.concat(F.lit("negative history of item "), F.col("item_id").cast("string")))).otherwise(F.coalesce("weight", F.lit(0)))
    rows = leaves.withColumn("weight", sane)
    twins = rows.where("weight > 0").groupBy("block", "node", "held").agg(F.avg("weight").alias("twin"))
    rows = rows.join(twins, ["block", "node", "held"], "left")
    rows = rows.withColumn("cold", (F.col("weight") == 0) & F.col("twin").isNotNull()).withColumn("weight", F.when(F.col("cold"), F.col("twin")).otherwise(F.col("weight")).cast("double")).drop("twin")
    total = rows.groupBy("block", "node").agg(F.sum("weight").alias("total"))
    return rows.join(total, ["block", "node"]).withColumn("share", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0)).drop("total")


def split(curves: DataFrame, shared: DataFrame) -> DataFrame:
    """(block, node, item_id, curve): each node's curve (an array) by its leaves' shares. A curve that isn't zero, of a node whose leaves have no share, raises."""
    whole = F.aggregate("curve", F.lit(0.0), lambda s, x: s + F.abs(x))
    usable = curves.join(shared.groupBy("block", "node").agg(F.sum("share").alias("all")), ["block", "node"], "left")
    lost = (whole > 0) & (F.coalesce("all", F.lit(0.0)) == 0)
    usable = usable.withColumn("curve", F.when(lost, F.raise_error(F.concat(F.lit("no leaf to take the forecast of node "), F.col("node")))).otherwise(F.col("curve"))).drop("all")
    return shared.join(usable, ["block", "node"]).select("block", "node", "item_id", F.transform("curve", lambda x: x * F.col("share")).alias("curve"))


def periods(day: Column, cutoff: Column, grain: str) -> Column:
    """Which bucket of a grain (day, week, month) a day is in, counted from the bucket of the cutoff."""
    if grain == "month":
        return ((F.year(day) - F.year(cutoff)) * 12 + F.month(day) - F.month(cutoff)).cast("int")
    if grain == "week":
        return F.floor(F.datediff(day, F.date_trunc("week", cutoff)) / 7).cast("int")
    return F.datediff(day, cutoff)


def cutoff(today: Column, grain: str, holdout: int) -> Column:
    """The start of the bucket of `today` (which is not whole, so left out), `holdout` buckets back."""
    start = F.trunc(today, "month") if grain == "month" else F.date_trunc("week", today).cast("date") if grain == "week" else today
    return F.add_months(start, -holdout) if grain == "month" else F.date_sub(start, holdout * (7 if grain == "week" else 1))


def scores(curves: DataFrame) -> DataFrame:
    """(block, level, method, wape, mase, bias, n_series, n_obs) of (block, level, method, actual, forecast, past), arrays by series.

    WAPE and bias (mean of forecast less actual) are pooled over all series and periods. MASE is the mean over the
    series that have one: those whose past values differ from one to the next at all.
    """
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    steps = F.transform(F.sequence(F.lit(2), F.size("past")), lambda i: F.abs(F.element_at("past", i) - F.element_at("past", i - 1)))
    error = add(F.zip_with("actual", "forecast", lambda a, f: F.abs(a - f)))
    naive = F.when(F.size("past") > 1, F.nullif(add(steps), F.lit(0.0)) / (F.size("past") - 1))
    each = curves.select("block", "level", "method", error.alias("error"), add(F.col("forecast")).alias("made"), add(F.col("actual")).alias("booked"), F.size("actual").alias("n"), (error / F.size("actual") / naive).alias("mase"))
    r = lambda c: F.round(c, 6) + F.lit(0.0)
    return each.groupBy("block", "level", "method").agg(
        r(F.sum("error") / F.nullif(F.sum("booked"), F.lit(0.0))).alias("wape"),
        r(F.avg("mase")).alias("mase"),
        r((F.sum("made") - F.sum("booked")) / F.sum("n")).alias("bias"),
        F.count("*").alias("n_series"),
        F.sum("n").cast("long").alias("n_obs"),
    )


def bench(sums: DataFrame, members: DataFrame, history: DataFrame, recon_level: str, method: Callable[[Column], Column], horizon: int, lookback: int) -> DataFrame:
    """Scores of 'middleout' and of 'base' by block and level (leaf, `recon_level`, root), from (item_id, period, qty).

    Periods before 0, `lookback` of them, are learnt from; 0 to horizon - 1 are held out. A node of the reconciliation
    level is forecast by `method` from its periods with demand, in order, not below 0; without any, as zero.
    'middleout' splits that by the leaves' history, 'base' evenly. The root is scored
    where it isn't itself of that level. Items above the level raise; blocks without leaves or nodes of that level are left out.
    """
    leaf_of = sums.where("item_id is not null").groupBy("block", "item_id").agg(F.max(F.when(F.col("level") == recon_level, F.col("code"))).alias("node"), F.count_if(F.col("level") == recon_level).alias("n"), F.max(F.when(F.col("code") == F.col("block"), F.col("level"))).alias("top"))
    leaf_of = written(leaf_of.join(members.withColumnRenamed("code", "held"), "item_id"))
    levelled = leaf_of.groupBy("block").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    refuse(levelled.where("most > 0 and (most > 1 or least = 0)").select("block"), f"items that no single {recon_level} node holds, in blocks")
    leaf_of = leaf_of.where("n = 1")
    own = written(history.where(F.col("period").between(-lookback, horizon - 1)).groupBy("item_id", "period").agg(F.sum("qty").cast("double").alias("qty")))

    def series(keys: list[str], rows: DataFrame) -> DataFrame:
        """By keys: the past periods with demand, in order, and all periods held out."""
        past = F.transform(F.sort_array(F.collect_list(F.when(F.col("period") < 0, F.struct("period", "qty")))), lambda e: e["qty"])
        seen = F.map_from_entries(F.collect_list(F.when(F.col("period") >= 0, F.struct("period", "qty"))))
        found = rows.groupBy(*keys, "period").agg(F.sum("qty").alias("qty")).groupBy(*keys).agg(past.alias("past"), seen.alias("seen"))
        return found.select(*keys, "past", F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda t: F.coalesce(F.try_element_at("seen", t), F.lit(0.0))).alias("actual"))

    none, zero = F.array().cast("array<double>"), F.array_repeat(F.lit(0.0), horizon)
    filled = [F.coalesce("past", none).alias("past"), F.coalesce("actual", zero).alias("actual")]
    placed = leaf_of.join(own, "item_id")
    leaves = leaf_of.join(series(["item_id"], own), "item_id", "left").select("block", "node", "held", "item_id", *filled)
    nodes = leaf_of.select("block", "node").distinct().join(series(["block", "node"], placed), ["block", "node"], "left").select("block", "node", *filled)
    made = F.greatest(F.lit(0.0), F.coalesce(method(F.col("past")), F.lit(0.0)))
    nodes = written(nodes.withColumn("curve", F.when(F.size("past") > 0, F.array_repeat(made, horizon)).otherwise(zero)))
    leaves = written(leaves.withColumn("weight", F.aggregate("past", F.lit(0.0), lambda s, x: s + x)))

    curves = nodes.select("block", "node", "curve")
    each = split(curves, shares(leaves.drop("past", "actual"))).select("block", "item_id", F.lit("middleout").alias("method"), F.col("curve").alias("forecast"))
    sizes = leaves.groupBy("block", "node").agg(F.count("*").alias("n"))
    flat = leaves.select("block", "node", "item_id").join(sizes.join(curves, ["block", "node"]), ["block", "node"]).select("block", "item_id", F.lit("base").alias("method"), F.transform("curve", lambda x: x / F.col("n")).alias("forecast"))
    by_leaf = each.unionByName(flat).join(leaves.select("block", "item_id", "past", "actual"), ["block", "item_id"]).select("block", F.lit("leaf").alias("level"), "method", "past", "actual", "forecast")
    both = F.explode(F.array(F.lit("middleout"), F.lit("base"))).alias("method")
    by_node = nodes.select("block", F.lit(recon_level).alias("level"), both, "past", "actual", F.col("curve").alias("forecast"))
    parts = nodes.select("block", F.posexplode("curve").alias("at", "x")).groupBy("block", "at").agg(F.sum("x").alias("x")).groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("forecast"))
    roots = leaf_of.where(F.col("top") != recon_level).select("block").distinct()
    by_root = roots.join(series(["block"], placed), "block", "left").select("block", *filled).join(parts, "block").select("block", F.lit("root").alias("level"), both, "past", "actual", "forecast")
    return scores(by_leaf.unionByName(by_node).unionByName(by_root))


def verdicts(scored: DataFrame) -> DataFrame:
    """(block, method, wape): each block's method of the least leaf WAPE, ties by name; blocks without one are left out."""
    leaf = scored.where("level = 'leaf' and wape is not null")
    return leaf.groupBy("block").agg(F.min(F.struct("wape", "method")).alias("b")).select("block", "b.method", "b.wape")
