"""A Merkle manifest of a table: one root over all rows, and for each row the proof that leads from it to the root.

The rows of a tree (a source, say) are cut into blocks of FAN ** `levels` leaves, and each
block is reduced to one node by itself. This is repeated until few nodes are left; from
those the driver builds the upper tree, and broadcasts for each the path from it to the
root. Then each block finishes the proofs of its rows by itself.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .batches import saved

FAN = 16
PROOF = "array<struct<left: string, right: string>>"
Steps = list[tuple[str, str]]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """The SHA-256 of some fields: each `-` if null, else its length in bytes, `:` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, joined: level by level, from left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def height(n: int) -> int:
    """How many levels lead from n nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def climbed(nodes: list[str], steps: int) -> tuple[list[Steps], list[str]]:
    """The way of each node up some levels, as the siblings before and after it, and the nodes of the last level."""
    ways: list[Steps] = [[] for _ in nodes]
    level = nodes
    for up in range(steps):
        runs = ["".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        size = len(nodes[0])
        for i, way in enumerate(ways):
            at = i // FAN**up
            own = at % FAN * size
            way.append((runs[at // FAN][:own], runs[at // FAN][own + size :]))
        level = [digest(run) for run in runs]
    return ways, level


def ranked(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Adds `pos` (from 0, in order) and `n`, the number of rows, within each value of `tree`.

    Rows are sorted by ranges of (tree, order), so a tree of any size is dealt out; what
    one range holds of each tree is counted, and a row's place is its place there behind all
    ranges before. Equal rows are told apart by where they are stored.
    """
    keys = [F.col(tree), *order, F.col("_stored")]
    dealt = rows.withColumn("_stored", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = saved(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop("_stored"))
    held = dealt.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Written, so that Spark knows its size: a row for each range and each tree.
    places = saved(held.select("_tree", "_of", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n")))
    placed = dealt.join(places, dealt[tree].eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_range", "_at", "_tree", "_of", "_shift")


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, digest) of the nodes that blocks of FAN ** levels nodes are reduced to; a tree of one node stays as it is."""

    def reduce(key: tuple, block: pa.Table) -> pa.Table:
        n = block.column("n")[0].as_py()
        steps = min(levels, height(n))
        nodes = climbed(block.sort_by("pos").column("digest").to_pylist(), steps)[1]
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": [key[1].as_py()], "n": [-(-n // FAN**steps)], "digest": nodes})

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", block_of(levels)).applyInArrow(reduce, "tree string, pos long, n long, digest string")


def block_of(levels: int) -> Column:
    return F.floor(F.col("pos") / FAN**levels).alias("block")


def proven(nodes: DataFrame, levels: int, above: Broadcast | DataFrame) -> DataFrame:
    """Adds `proof` and `subroot`, the root of its own tree, to all nodes.

    `above` has the way from a block's top to the root: by (tree, block) if broadcast, else (tree, pos, proof).
    """
    names = nodes.columns
    schema = StructType([*nodes.schema.fields, *nodes.sparkSession.createDataFrame([], f"proof {PROOF}, subroot string").schema.fields])

    def finish(block: pa.Table, rest: Steps) -> pa.Table:
        block = block.sort_by("pos").select(names)
        digests, n = block.column("digest").to_pylist(), block.column("n")[0].as_py()
        ways, _ = climbed(digests, min(levels, height(n)))
        subroot = digests[0]
        for left, right in (ways[0] + rest)[: height(n)]:
            subroot = digest(left + subroot + right)
        each = len(ways[0]) + len(rest)
        left, right = (pa.array([s[side] for way in ways for s in (*way, *rest)], pa.string()) for side in (0, 1))
        steps = pa.StructArray.from_arrays([left, right], ["left", "right"])
        proofs = pa.ListArray.from_arrays(pa.array([i * each for i in range(len(ways) + 1)], pa.int32()), steps)
        return block.append_column("proof", proofs).append_column("subroot", pa.array([subroot] * len(ways), pa.string()))

    blocks = nodes.withColumn("block", block_of(levels)).groupBy("tree", "block")
    if isinstance(above, Broadcast):
        return blocks.applyInArrow(lambda key, block: finish(block, above.value[key[0].as_py(), key[1].as_py()]), schema)

    def beside(block: pa.Table, rest: pa.Table) -> pa.Table:
        return finish(block, [(s["left"], s["right"]) for s in rest.column("proof")[0].as_py()])

    return blocks.cogroup(above.select("tree", F.col("pos").alias("block"), "proof").groupBy("tree", "block")).applyInArrow(beside, schema)


def upper(rows: list[tuple[str | None, int, int, str]], over_trees: bool) -> tuple[dict[tuple[str | None, int], Steps], str | None]:
    """The way of each node (tree, pos, n, digest) to the root, and the root. `over_trees`: the trees' roots, in order, make a tree of their own."""
    found, roots = {}, []
    for tree, nodes in groupby(sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])), key=lambda r: r[0]):
        nodes = list(nodes)
        ways, top = climbed([d for *_, d in nodes], height(nodes[0][2]))
        found.update({(tree, pos): way for (_, pos, _, _), way in zip(nodes, ways, strict=True)})
        roots.append((tree, top[0]))
    if over_trees and roots:
        ways, top = climbed([d for _, d in roots], height(len(roots)))
        last = {tree: way for (tree, _), way in zip(roots, ways, strict=True)}
        return {key: way + last[key[0]] for key, way in found.items()}, top[0]
    return found, roots[0][1] if roots else None


def manifest(rows: DataFrame, *, tree: str, order: list[str], leaf: str, levels: int = 3, top_rows: int = 4096) -> DataFrame:
    """All rows with `proof`, `subroot` (the root of their tree) and `root`; columns of these names are replaced.

    `leaf` is a row's digest in hexadecimal. The leaves of one value of `tree` (cast to a string; nulls are a tree)
    ascend by `order`, nulls first, then by their digest; every FAN consecutive nodes, the last run fewer, become the
    digest of their joined digests, until one is left. The trees' roots, null first, then by their
    bytes, likewise lead to the root. `proof` is a list of steps: the siblings before and after the node, joined.

    The driver receives `top_rows` nodes at most, however many rows or trees there are:
    while more are left, blocks are reduced once more, and many trees' roots are ranked and reduced like leaves.
    Equal rows keep a leaf each; an empty table gives no rows.
    """
    spark = rows.sparkSession
    packed = rows.select(F.struct(*(c for c in rows.columns if c not in ("proof", "subroot", "root"))).alias("row"))
    packed = saved(packed.select("row", F.col(f"row.{tree}").cast("string").alias("tree"), F.col(f"row.{leaf}").alias("digest")))
    layers, over_trees = [saved(ranked(packed, "tree", [*(F.col(f"row.{c}") for c in order), F.col("digest")]))], True
    while len(layers) == 1 or layers[-1].count() > top_rows:
        if over_trees and len(layers) > 1 and layers[-1].where("n > 1").isEmpty():
            roots = layers[-1].select(F.col("tree").alias("name"), F.lit(None).cast("string").alias("tree"), "digest")
            layers.append(saved(ranked(roots, "tree", [F.col("name")])))
            over_trees = False
        layers.append(saved(tops(layers[-1], levels)))
    ways, root = upper([tuple(r) for r in layers[-1].select("tree", "pos", "n", "digest").collect()], over_trees)
    above: Broadcast | DataFrame = spark.sparkContext.broadcast(ways)
    for nodes in reversed(layers[:-1]):
        if not isinstance(above, Broadcast) and "name" in above.columns:  # from the roots in order to the trees that they are of
            above = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof")
            continue
        above = proven(nodes, levels, above)
    return above.select("row.*", "proof", "subroot", F.lit(root).alias("root"))
