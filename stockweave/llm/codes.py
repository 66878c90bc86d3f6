"""Product-quantised codes of vectors, by Lloyd's rounds that only look again at what may have changed its entry.

Vectors lie in chunks. For each part of the vectors and each entry of its codebook, a chunk keeps a heap of
the vectors assigned to it, by their slack: how much farther than this entry the next one is at
least. A round moves the entries, which uses up as much slack of all in a heap as its own entry and the farthest
moving other one have moved. These drifts are added up on the driver; a chunk pops what has none left
and finds its nearest entry exactly. A heap is held as its keys in ascending order, so
what is popped is a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import dropped, saved

CHUNK = "ids array<long>, labels array<string>, points binary, order binary, slack binary, first binary, sums binary"
MARGIN = 1e-3  # far above the rounding of a distance, so that ties are looked at again
LIMIT = 1 << 26  # whole numbers beyond this are clipped, so that no sum of squares passes 64 bits


def usable(vector: Column) -> Column:
    """Whether a vector is there, and holds nothing null or non-finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(vector) > 0)


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared, in whole numbers: a row for each point, a column for each entry."""
    out = np.empty((len(points), len(book)), np.int64)
    for j, entry in enumerate(book):
        gap = points - entry
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def rescan(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry, the first of equals, and its slack."""
    d = distances(points, book)
    nearest = d.argmin(axis=1)
    at = np.arange(len(points))
    own = np.sqrt(d[at, nearest])
    d[at, nearest] = np.iinfo(np.int64).max
    return nearest, np.sqrt(d.min(axis=1)) - own


class Heaps:
    """The heaps of one part in one chunk: `order` has the members entry by entry and by key, entry j's from first[j] to first[j + 1]."""

    def __init__(self, order: np.ndarray, slack: np.ndarray, first: np.ndarray):
        self.order, self.slack, self.first = order, slack, first

    @classmethod
    def of(cls, entry: np.ndarray, members: np.ndarray, slack: np.ndarray, entries: int) -> Heaps:
        by = np.lexsort((slack, entry))
        return cls(members[by].astype(np.int32), slack[by], np.searchsorted(entry[by], np.arange(entries + 1)).astype(np.int32))

    def entries(self) -> np.ndarray:
        """The entry of each place in `order`."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take out the members whose keys are within their entry's drift: they, and the entries they had."""
        entry = self.entries()
        out = np.zeros(len(self.order), bool)
        for j, d in enumerate(drift):
            a, b = self.first[j], self.first[j + 1]
            out[a : a + np.searchsorted(self.slack[a:b], d + MARGIN, side="right")] = True
        gone = self.order[out], entry[out]
        kept = entry[~out]
        self.order, self.slack = self.order[~out], self.slack[~out]
        self.first = np.searchsorted(kept, np.arange(len(self.first))).astype(np.int32)
        return gone

    def push(self, entry: np.ndarray, members: np.ndarray, slack: np.ndarray) -> Heaps:
        return Heaps.of(np.concatenate([self.entries(), entry]), np.concatenate([self.order, members]), np.concatenate([self.slack, slack]), len(self.first) - 1)


def totals(points: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Per entry the sum of its points, and their number last."""
    columns = [*points.T, np.ones(len(points))]  # a chunk's sums are exact in doubles
    return np.column_stack([np.bincount(entry, c, entries) for c in columns]).astype(np.int64)


def _arrays(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, list[Heaps], np.ndarray]]:
    """Row, points, heaps and sums of each chunk."""
    for row in range(batch.num_rows):
        cell = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)  # noqa: B023, E731
        n = len(batch.column("ids")[row])
        points = cell("points", np.int32).reshape(n, -1).astype(np.int64)
        order, slack, first = (cell(*c).reshape(parts, -1) for c in (("order", np.int32), ("slack", np.float64), ("first", np.int32)))
        heaps = [Heaps(*h) for h in zip(order, slack, first, strict=True)]
        yield row, points, heaps, cell("sums", np.int64).reshape(parts, first.shape[1] - 1, -1)


def _split(points: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(points, parts, axis=1)


def _stored(heaps: list[Heaps], sums: np.ndarray) -> list[bytes]:
    joined = (np.stack([getattr(h, name) for h in heaps]) for name in ("order", "slack", "first"))
    return [x.tobytes() for x in (*joined, sums)]


def begun(vectors: DataFrame, books: np.ndarray, width: int, scale: int, most: int = 2_000_000) -> DataFrame:
    """Chunks of (id, label, vector) rows with their first heaps, about `most` components in each."""
    parts, entries = books.shape[:2]
    rows_each = max(1, most // width)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows_each):
                batch = whole.slice(start, rows_each)
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                points = np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64).reshape(-1, width)
                heaps, sums = [], []
                for part, book in zip(_split(points, parts), books, strict=True):
                    entry, slack = rescan(part, book)
                    heaps.append(Heaps.of(entry, np.arange(len(part)), slack, entries))
                    sums.append(totals(part, entry, entries))
                cells = [batch.column("id").to_pylist(), batch.column("label").to_pylist(), points.astype(np.int32).tobytes(), *_stored(heaps, np.stack(sums))]
                yield pa.RecordBatch.from_pydict({f.split()[0]: [c] for f, c in zip(CHUNK.split(", "), cells, strict=True)}, schema=_SCHEMA)

    return vectors.mapInArrow(chunks, CHUNK)


_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *((n, pa.binary()) for n in ("points", "order", "slack", "first", "sums"))])


def advanced(chunks: DataFrame, books: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The chunks with all points at their nearest entries of moved books."""
    parts = len(books)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, points, heaps, sums in _arrays(batch, parts):
                sums = sums.copy()
                for k, part in enumerate(_split(points, parts)):
                    members, had = heaps[k].pop(drift[k])
                    entry, slack = rescan(part[members], books[k])
                    heaps[k] = heaps[k].push(entry, members, slack + drift[k][entry])
                    moved = entry != had
                    sums[k] += totals(part[members[moved]], entry[moved], len(books[k])) - totals(part[members[moved]], had[moved], len(books[k]))
                same = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(same.column(c) for c in ("ids", "labels", "points")), *(pa.array([c], pa.binary()) for c in _stored(heaps, sums))], schema=_SCHEMA)

    return chunks.mapInArrow(advance, CHUNK)


def summed(chunks: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all chunks: reads that column alone, and brings one number for each of the books' to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for cell in batch.column("sums"):
                total += np.frombuffer(cell.as_buffer(), np.int64).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    found = chunks.select("sums").mapInArrow(add, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    return np.array([r.total for r in found], np.int64).reshape(shape)


def coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, codes, error) of every vector: its entries, and its squared distance from them."""
    parts = len(books)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, points, heaps, _ in _arrays(batch, parts):
                codes, error = np.empty((len(points), parts), np.int32), np.zeros(len(points), np.int64)
                for k, part in enumerate(_split(points, parts)):
                    codes[heaps[k].order, k] = heaps[k].entries()
                    gap = part - books[k][codes[:, k]]
                    error += np.einsum("ij,ij->i", gap, gap)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
                cells = [batch.column("ids")[row].values, batch.column("labels")[row].values, lists, pa.array(error)]
                yield pa.RecordBatch.from_arrays(cells, ["id", "label", "codes", "error"])

    return chunks.mapInArrow(emit, "id long, label string, codes array<int>, error long")


def compress(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(id, label as a string, codes, error) of every vector, and the codebooks (part, entry, component).

    A component x counts as floor(scale * x); a vector is cut into `parts` equal consecutive parts. A part's
    book starts as that part of the `entries` smallest ids, ascending, and of repeated rows of an id the
    smallest vector. In each round every part goes to its nearest entry (squared distance in whole
    numbers, the first of equals), then entries with parts become the floor of their mean. Last, parts are assigned again.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of
    another length than the smallest id's, or all if `parts` doesn't divide that. With fewer ids the
    books have fewer entries; without any id no row comes back. Other rows without an id, and repeated rows, are coded each.

    A round reads and writes each chunk once, without a shuffle; the driver gets the sums of the books' entries only.
    """
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    lengths = kept.where("id is not null").orderBy("id", "vector").select(F.size("vector")).take(1)
    width = lengths[0][0] if lengths else 0
    if not width or width % parts:
        return rows.sparkSession.createDataFrame([], "id long, label string, codes array<int>, error long"), np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(F.size("vector") == width)
    first = [r.id for r in kept.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    seeds = kept.where(F.col("id").isin(first)).groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").collect()
    start = np.clip(np.floor(np.array([r.vector for r in seeds]) * scale), -LIMIT, LIMIT).astype(np.int64)
    books = np.stack(_split(start, parts))
    drift = np.zeros(books.shape[:2])
    chunks = saved(begun(kept, books, width, scale))
    for _ in range(rounds):
        sums = summed(chunks, (*books.shape[:2], books.shape[2] + 1))
        counts = sums[..., -1:]
        moved = np.where(counts > 0, sums[..., :-1] // np.maximum(counts, 1), books)  # // goes down
        step = np.sqrt(((moved - books).astype(float) ** 2).sum(axis=2))
        others = np.array([[max((s for i, s in enumerate(part) if i != j), default=0.0) for j in range(len(part))] for part in step])
        books, drift, last = moved, drift + step + others, chunks
        chunks = saved(advanced(chunks, books, drift))
        dropped(last)
    out = saved(coded(chunks, books))
    dropped(chunks)
    return out, books


def with_group_sums(rows: DataFrame, key: str, value: str, name: str, *, most: int = 100_000, salts: int = 64) -> DataFrame:
    """Adds the sum of `value` over all rows of the same key, nulls together.

    Sums are made before rows are shuffled. Up to `most` keys they are broadcast; beyond, a key's rows go to `salts` places each with a copy of its sum.
    """
    sums = saved(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name)))
    if sums.count() <= most:
        return rows.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    copies = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_of", (F.monotonically_increasing_id() % salts).cast("int"))
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_salt"))).drop("_key", "_of", "_salt")
