"""Links between similar sets, and the components that they form.

Sets meet in the lists of an inverted index. The set of a list that varies least from
the others is its head, and all others are compared with it. What the head's answers already connect
is not compared again; for the rest, lists are read only in the blocks of sizes that
an entry's position allows, and a pair is answered from the two sets' differences to
their common head.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .batches import dropped, saved

#: As many 64-bit ids at most are broadcast (some 16 bytes each); beyond, tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Blocks of sizes in the range of sizes that may match.
BLOCKS = 8


def restrict(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` is in `ids` (distinct and written, one column of that name)."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash"), column, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b); component: the least id reachable.

    Alternating large-star and small-star steps; each writes its edges to the shared
    folder, so lost executors cost one step.
    """

    def step(edges: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        written = saved(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")))
        return written, seen.get

    edges, now = step(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    while now != before and now.get("n"):
        both = edges.selectExpr("hi as u", "lo as v").unionByName(edges.selectExpr("lo as u", "hi as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before = now
        shorter, now = step(small.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct())
        dropped(edges)
        edges = shorter
    return edges.selectExpr("hi as id", "lo as component").unionByName(edges.selectExpr("lo as id", "lo as component").distinct())


def least_shared(n: Column, percent: int) -> Column:
    """How many items a set of n shares at least with any of `percent` per cent similarity."""
    return F.ceil(n * percent / 100)


def index_lists(items: DataFrame, percent: int) -> DataFrame:
    """The index (key, id, n, left, level) of sets (id, items): each under its rarest items.

    Items are ordered from rare to frequent, by the binary logarithm of their exact counts
    and then by value. A set stands in the lists of its first items, as many as any
    similar set must share one of; `left` of its items come after. Items that no other
    set has make no list. `level` is the mean of a set's logarithms: high for a text that
    many vary, as its variants have rare items of their own.
    """
    items = items.select("id", F.size("items").alias("n"), F.explode("items").alias("key"))
    counts = saved(items.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.floor(F.log2("m")).cast("int").alias("level")))
    placed = items.join(counts, "key").select("key", "id", "n", F.expr("row_number() over (partition by id order by level desc, key desc) - 1").alias("left"), F.expr("sum(level) over (partition by id) / n").alias("level"))
    return placed.where(F.col("left") + 1 >= least_shared(F.col("n"), percent))


def _most(n: Column, left: Column, percent: int) -> Column:
    """How large a set may be that shares at most left + 1 items with one of n and is similar to it."""
    return F.floor((left + 1) * (100 + percent) / percent) - n


def link_lists(lists: DataFrame, items: DataFrame, percent: int, groups: DataFrame | None = None) -> DataFrame:
    """Components (id, component) of sets whose Jaccard similarity is `percent` or more; sets without a link don't come back.

    `lists` (key, id, n, left, level) is the index: set `id` of n items stands in the list of
    `key` and shares at most left + 1 items with any set that it meets there. Each pair to
    be found shares a list. `items` (id, items array<long>) has the sets, each once. `groups`
    (the same columns) are further lists, in which sets are only compared with the head.

    Lists are divided by size, so that sets that meet have similar sizes. First every set is
    compared with the head of each of its lists: the one of the highest level, which the
    others differ from least. That takes as many comparisons as there are entries. Then, for what isn't connected with its list's head, pairs of
    the list across components are answered, if sizes and positions allow them, from the
    differences to the head: |a & b| = |h| - |h-a| - |h-b| + |(h-a) & (h-b)| + |(a-h) & (b-h)|.
    No link between components is lost, and no pairs are made within a component.
    """
    c = F.col
    block = F.floor(F.log(c("n").cast("double")) / -math.log(percent / 100)).cast("int")
    # A set stands in its block's list and as a guest in the next one: sets that match are in one block or in neighbours.
    lists = lists.withColumn("paired", F.lit(True))
    if groups is not None:
        lists = lists.unionByName(groups.withColumn("paired", F.lit(False)))
    placed = lists.select("key", "id", "n", "left", "level", "paired", F.explode(F.array(F.struct(block.alias("block"), F.lit(False).alias("guest")), F.struct((block + 1).alias("block"), F.lit(True).alias("guest")))).alias("at"))
    placed = saved(placed.select("key", "id", "n", "left", "level", "paired", "at.*"))
    heads = placed.groupBy("key", "block").agg(F.count("*").alias("m"), F.bool_and("guest").alias("guests"), F.max(F.struct("level", "n", "id")).alias("head"))
    heads = saved(heads.where("m > 1 and not guests").select("key", "block", c("head.id").alias("head")))
    entries = saved(placed.join(heads, ["key", "block"]).where("id <> head"))

    pairs = saved(entries.select("head", "id").distinct())
    named = items.select(c("id").alias("head"), c("items").alias("head_items"))
    compared = pairs.join(named, "head").join(items, "id").select("head", "id", F.size("head_items").alias("head_n"), F.array_except("head_items", "items").alias("removed"), F.array_except("items", "head_items").alias("extra"))
    same = c("head_n") - F.size("removed")
    compared = saved(compared.withColumn("linked", same * 100 >= (c("head_n") + F.size("extra")) * percent))
    found = saved(components(compared.where("linked").select(c("head").alias("a"), c("id").alias("b"))))

    of = entries.where("paired").join(found.select("id", c("component").alias("of")), "id", "left").join(found.select(c("id").alias("head"), c("component").alias("of_head")), "head", "left")
    of = of.select("key", "block", "head", "id", "n", "left", "guest", F.coalesce("of", "id").alias("of"), F.coalesce("of_head", "head").alias("of_head"))
    apart = of.where("of <> of_head")
    part = lambda n: F.floor(F.log(n.cast("double")) * BLOCKS / -math.log(percent / 100)).cast("int")
    least, most = least_shared(c("n"), percent), F.least(_most(c("n"), c("left"), percent), F.floor(c("n") * 100 / percent))
    probes = apart.where(most >= least).select("key", "block", *(c(x).alias(f"{x}2") for x in ("id", "n", "left", "guest", "of")), F.explode(F.sequence(part(least), part(most))).alias("part"))
    met = of.withColumn("part", part(c("n"))).join(probes, ["key", "block", "part"]).where((c("of") != c("of2")) & ~(c("guest") & c("guest2")) & (c("n2") <= _most(c("n"), c("left"), percent)) & (c("n") <= _most(c("n2"), c("left2"), percent)))
    met = saved(met.groupBy(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).agg(F.min("head").alias("head")))
    differs = compared.select("head", "id", "head_n", "removed", "extra")
    sides = [differs.select("head", c("id").alias(x), *([c("head_n")] if x == "a" else []), c("removed").alias(f"removed_{x}"), c("extra").alias(f"extra_{x}")) for x in ("a", "b")]
    both = reduce(lambda left, x: left.join(x[1], ["head", x[0]]), zip(("a", "b"), sides, strict=True), met)
    gone = F.size("removed_a") + F.size("removed_b") - F.size(F.array_intersect("removed_a", "removed_b"))
    same = c("head_n") - gone + F.size(F.array_intersect("extra_a", "extra_b"))
    sizes = 2 * c("head_n") - F.size("removed_a") - F.size("removed_b") + F.size("extra_a") + F.size("extra_b")
    more = saved(both.where(same * 100 >= (sizes - same) * percent).select("a", "b"))
    dropped(placed, heads, entries, pairs, compared, met)
    if more.isEmpty():
        return found
    return components(more.unionByName(found.select(c("id").alias("a"), c("component").alias("b"))))
