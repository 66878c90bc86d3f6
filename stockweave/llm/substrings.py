"""Substring deduplication: repeated paragraphs, by MinHash bands and exact Jaccard, and repeated runs of words.

Paragraphs are a text's lines. Runs are found by windows that start at words chosen by
content, so that a passage is found wherever in a line it was placed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import dropped, saved, slices
from .setlinks import index_lists, link_lists, restrict
from .words import _STEP, Words, mixed

#: Minima in a band, and the share of pairs at the threshold that must collide in some band.
ROWS, RECALL = 2, 0.999


def bands_for(percent: int) -> int:
    """So many bands that paragraphs of `percent` per cent similarity collide with probability RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (percent / 100) ** ROWS))


class Passages:
    """Paragraphs and windows of `min_words` words of a column's texts: word ranges [lo, hi) and their texts.

    `line` and `window` name them by a hash of all their words; so equal ones have equal names.
    """

    def __init__(self, texts: pa.Array, k: int, min_words: int, every: int):
        w = self.words = Words(texts)
        n = len(w.hash)
        newline = np.concatenate([[0], np.cumsum(w.data == 10)])
        opens = np.zeros(n, bool)
        opens[1:] = newline[w.start[1:]] > newline[w.stop[:-1]]
        opens[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
        lo = np.flatnonzero(opens)
        hi = np.append(lo[1:], n)
        long = hi - lo >= min_words
        self.k, self.shingle = k, w.shingles(k)
        self.line_lo, self.line_hi = lo[long], hi[long]
        owner = np.searchsorted(w.first, lo, side="right") - 1
        number = np.arange(len(lo)) - np.searchsorted(owner, owner)
        self.line_owner, self.line_number = owner[long], number[long]
        rank = np.arange(n) - np.repeat(lo, hi - lo)
        placed = mixed(w.hash + rank.astype(np.uint64) * _STEP)
        self.line = self._over(np.bitwise_xor, placed, 0) ^ mixed((self.line_hi - self.line_lo).astype(np.uint64))
        self.window_lo, self.window_owner = self._windows(min_words, every)
        self.window = np.full(len(self.window_lo), min_words, np.uint64)
        for i in range(min_words):
            self.window = mixed(self.window * _STEP + w.hash[self.window_lo + i])

    def _over(self, f: np.ufunc, values: np.ndarray, less: int) -> np.ndarray:
        """f over each paragraph's values, but for its last `less` ones."""
        if not len(self.line_lo):
            return np.zeros(0, np.uint64)
        # reduceat over [lo, hi - less) pairs; the odd results are of what lies between
        return f.reduceat(np.append(values, np.uint64(0)), np.column_stack([self.line_lo, self.line_hi - less]).ravel())[::2]

    def bands(self, count: int) -> np.ndarray:
        """The band keys of each paragraph, from ROWS minima of its shingles each."""
        keys = np.zeros((len(self.line_lo), count), np.uint64)
        for band in range(count):
            key = np.full(len(self.line_lo), band + 1, np.uint64)
            for row in range(ROWS):
                seed = mixed(np.full(1, 1 + band * ROWS + row, np.uint64))
                key = mixed(key * _STEP + self._over(np.minimum, mixed(self.shingle ^ seed), self.k - 1))
            keys[:, band] = key
        return keys

    def _windows(self, size: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of `size` words, and their texts.

        A window starts at the least shingle (the last of equal ones) of each `every` in a row
        in a text. So a run of size + every - 1 words holds the same whole windows wherever it
        occurs: its first `every` shingles choose one that ends in it.
        """
        n = len(self.shingle)
        if n < every:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.uint64(0xFFFFFFFF)
        least = (self.shingle & ~low) | (low - np.arange(n, dtype=np.uint64))
        done = 1
        while done < every:
            step = min(done, every - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        at = np.arange(len(least))
        owner = np.searchsorted(self.words.first, at, side="right") - 1
        fits = at + every + self.k - 1 <= self.words.first[owner + 1]
        lo = np.unique((low - (least[fits] & low)).astype(np.int64))
        owner = np.searchsorted(self.words.first, lo, side="right") - 1
        fits = lo + size <= self.words.first[owner + 1]
        return lo[fits], owner[fits]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of the paragraphs, one after another, and where each one's begin (and the end)."""
        sizes = self.line_hi - self.k + 1 - self.line_lo
        owner = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        flat = self.shingle[np.arange(sizes.sum()) - np.repeat(starts - self.line_lo, sizes)]
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
        return flat[new], np.searchsorted(owner[new], np.arange(len(sizes) + 1))

    def places(self, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """First word and number of words in the text, and code points in it, stops exclusive."""
        points = np.concatenate([[0], np.cumsum((self.words.data & 0xC0) != 0x80)])
        base = points[self.words.offsets[owner]]
        return [lo - self.words.first[owner], hi - lo, points[self.words.start[lo]] - base, points[self.words.stop[hi - 1]] - base]


def repeated_paragraphs(docs: DataFrame, *, k: int = 5, percent: int = 80, min_words: int = 25, every: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that recur in another document: doc_id, paragraph, start, stop, n_words, keeper_doc_id, removed.

    A passage has `min_words` words or more. Paragraphs are a text's lines; `paragraph` is
    the line's number. Those that share a MinHash band are compared, and recur when their k-word
    shingles have a Jaccard similarity of `percent` per cent or more. The components of
    these links keep the paragraph of their least doc_id and remove those of all other
    documents; keepers are listed with removed = false. Starts and stops are code points.

    Windows of `min_words` words at places chosen by content recur when they are equal to
    one of another document; those that overlap or touch are joined to a run, whose `paragraph`
    is -1. Each run of min_words + every - 1 words that two documents share holds a whole window,
    wherever lines and sentences end. What may be left of a run are fewer than `every`
    words before its first window and after its last one.

    Repeats within one document are left. Rows with a null id or null text take no
    part; repeated rows count as one document; an empty table gives no rows; columns
    other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    bands = bands_for(percent)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = Passages(part.column(1), k, min_words, every)
            lines, windows = len(p.line), len(p.window)
            owner = np.concatenate([p.line_owner, p.window_owner])
            places = p.places(np.concatenate([p.line_lo, p.window_lo]), np.concatenate([p.line_hi, p.window_lo + min_words]), owner)
            number = np.concatenate([p.line_number, np.full(windows, -1)])
            names = np.concatenate([p.line, p.window]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(lines + windows + 1), lines) * bands, pa.int32()), pa.array(p.bands(bands).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[owner]), *(pa.array(x, pa.int32()) for x in (number, *places)), pa.array(names), keys], ["doc_id", "paragraph", "at", "n_words", "start", "stop", "id", "keys"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            p = Passages(part.column(1), k, min_words, every)
            flat, bounds = p.items()
            yield pa.RecordBatch.from_arrays([pa.array(p.line.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))], ["id", "items"])

    places = saved(rows.mapInArrow(find, "doc_id long, paragraph int, at int, n_words int, start int, stop int, id long, keys array<long>"))
    windows, lines = places.where("paragraph < 0"), places.where("paragraph >= 0")

    same = saved(windows.groupBy("id").agg(F.min("doc_id").alias("keeper_doc_id"), F.max("doc_id").alias("last")).where("keeper_doc_id < last").select("id", "keeper_doc_id"))
    before = Window.partitionBy("doc_id", "keeper_doc_id").orderBy("at")
    ended = F.max(F.col("at") + F.col("n_words")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs = windows.join(same, "id").withColumn("opens", F.coalesce(F.col("at") > ended, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "keeper_doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max(F.col("at") + F.col("n_words")) - F.min("at")).alias("n_words"))
    runs = saved(runs.select("doc_id", F.lit(-1).alias("paragraph"), "start", "stop", "n_words", "keeper_doc_id"))
    dropped(same)

    # Equal paragraphs collapse. Different ones that share a band key collide.
    classes = saved(lines.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_doc")))
    keys = lines.select("id", F.explode("keys").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key"))
    collided = saved(keys.join(shared, "key").select("key", "id").distinct())
    wanted = saved(collided.select("id").distinct())
    owners = saved(classes.join(wanted, "id").select("doc_id").distinct())
    # The shingles of one of each are read again.
    items = saved(restrict(restrict(rows, owners, "doc_id").mapInArrow(gather, "id long, items array<long>"), wanted, "id").dropDuplicates(["id"]))
    # What collides is compared with the first of its band key. What that leaves apart is compared in the lists of
    # its rarest shingles, of which any similar pair shares one, so that no band key makes all pairs of what has it.
    index = saved(index_lists(items, percent))
    able = index.groupBy("id").agg(F.first("n").alias("n"), F.max("left").alias("left"), F.first("level").alias("level"))
    groups = link_lists(index, items, percent, collided.join(able, "id").select("key", "id", "n", "left", "level"))

    placed = classes.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keepers = placed.groupBy("component").agg(F.min("doc_id").alias("keeper_doc_id"), F.max("last_doc").alias("last_doc")).where("keeper_doc_id < last_doc")
    named = saved(placed.select("id", "component").join(keepers.select("component", "keeper_doc_id"), "component").select("id", "keeper_doc_id"))
    dropped(classes, shared, collided, wanted, owners, items, index)
    found = lines.join(named, "id").select("doc_id", "paragraph", "start", "stop", "n_words", "keeper_doc_id").unionByName(runs)
    return found.withColumn("removed", F.col("doc_id") != F.col("keeper_doc_id")).distinct()


def without_repeats(docs: DataFrame, repeats: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with their removed passages cut out (the union of their ranges); all columns stay."""
    cuts = repeats.where("removed").groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_cuts"))
    text = F.col(text_col)
    walked = F.aggregate(
        "_cuts",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.struct(F.greatest(s["at"], c["stop"]).alias("at"), F.when(c["start"] > s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, c["start"] - s["at"]))).otherwise(s["out"]).alias("out")),
    )
    joined = docs.join(cuts, docs["doc_id"] == cuts["_doc"], "left")
    cut = F.concat(walked["out"], F.substring(text, walked["at"] + 1, F.length(text)))
    return joined.withColumn(text_col, F.when(F.col("_cuts").isNotNull(), cut).otherwise(text)).select(*docs.columns)
