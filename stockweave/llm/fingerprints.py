"""Document fingerprints from prefix polynomial hashes.

The modular prefix array of a text gives the hash of any span in constant time,
so span equality is one comparison and a longest common extension a binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: Two primes below 2^31 with a base each: together the hash of a span has 62 bits.
PRIMES = (2147483647, 2147483629)
BASES = (1000003937, 1410065411)
SPAN = 24
BINS = 64


class _Powers:
    """Powers of a base, and of its inverse, modulo a prime, made longer when needed."""

    def __init__(self, prime: int, base: int):
        self.prime = np.uint64(prime)
        self.steps = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.by = [base % prime, pow(base, -1, prime)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.steps[0]) < n:
            m = len(self.steps[0])
            self.steps = [np.concatenate([s, s * np.uint64(pow(b, m, int(self.prime))) % self.prime]) for s, b in zip(self.steps, self.by, strict=True)]
        return self.steps[0][:n], self.steps[1][:n]


POWERS = tuple(_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class PrefixHash:
    """Prefix hashes of one text (code points)."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.prefix = []
        for powers in POWERS:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values * powers.upto(self.n)[0] % powers.prime, out=sums[1:])
            self.prefix.append(sums % powers.prime)

    def span(self, start, length, which: int = 0) -> np.ndarray:
        """Hash of span(s) of `length` at `start` (an int or an array) for one of the primes."""
        powers, sums = POWERS[which], self.prefix[which]
        start = np.asarray(start)
        back = powers.upto(self.n + 1)[1][start]
        return (sums[start + length] + powers.prime - sums[start]) % powers.prime * back % powers.prime

    def whole(self) -> tuple[int, int]:
        return int(self.prefix[0][-1]), int(self.prefix[1][-1])

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans at i here and at j there are equal (but for a collision of 62 bits)."""
        return all(int(self.span(i, length, w)) == int(other.span(j, length, w)) for w in range(len(POWERS)))

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """How far the texts agree from i here and j there on."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def sketch(self) -> np.ndarray:
        """For each bin, the least hash of the spans that fall in it (-1 if none): one-permutation MinHash."""
        k = min(SPAN, self.n)
        out = np.full(BINS, -1, np.int64)
        if not k:
            return out
        mixed = self.span(np.arange(self.n - k + 1), k) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        bins, values = (mixed >> np.uint64(58)).astype(np.int64), (mixed >> np.uint64(20) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if len(values) > 64 * BINS:  # the least of a bin is nearly always among the least of all
            few = values < (1 << 32) * 24 * BINS // len(values)
            if len(np.unique(bins[few])) == BINS:
                bins, values = bins[few], values[few]
        order = np.lexsort((values, bins))
        found, at = np.unique(bins[order], return_index=True)
        out[found] = values[order][at]
        return out


def fingerprint(h: PrefixHash, sketch: np.ndarray) -> str:
    """Length, hash of the whole text, then 16 bits of each bin (`----` for an empty one)."""
    a, b = h.whole()
    return f"{h.n:x}-{a:08x}{b:08x}-" + "".join("----" if v < 0 else f"{v & 0xFFFF:04x}" for v in sketch.tolist())


def likeness(one: str, two: str) -> float:
    """0 to 1: the share of equal bins among those filled in either; 1 for equal fingerprints."""
    if one == two:
        return 1.0
    a, b = one[-4 * BINS :], two[-4 * BINS :]
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, 4 * BINS, 4)]
    filled = [x == y for x, y in pairs if x != "----" or y != "----"]
    return sum(filled) / len(filled) if filled else 0.0


def _with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Documents dealt into ranges of ascending id, each range with a copy of the row that follows it.

    The ranges come from quantiles of the ids; the driver holds two numbers a range.
    """
    none = -(1 << 63)  # stands for a null id
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(none)))
    bounds = sorted(set(keyed.stat.approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    cuts = np.asarray(bounds, dtype=np.float64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy().astype(np.float64), side="right").astype(np.int32))

    firsts = {r.b: r.k for r in keyed.select(bucket("key").alias("b"), "key").groupBy("b").agg(F.min("key").alias("k")).collect()}
    filled = sorted(firsts)
    before = {firsts[b]: filled[i - 1] for i, b in enumerate(filled)}  # the first range follows the last one
    ids = np.asarray(sorted(before), dtype=np.int64)
    ranges = np.asarray([before[i] for i in ids.tolist()], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        own = np.searchsorted(cuts, values.astype(np.float64), side="right").astype(np.int32)
        at = np.minimum(np.searchsorted(ids, values), max(len(ids) - 1, 0))
        first = ids[at] == values if len(ids) else np.zeros(len(values), bool)
        return pd.Series([[o, r] if f else [o] for o, r, f in zip(own.tolist(), ranges[at].tolist() if len(ids) else own.tolist(), first.tolist(), strict=True)])

    return keyed.select("key", "doc_id", "text", F.posexplode(places("key")).alias("extra", "bucket")), len(filled)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text is the text with its last floor(n/2) code points replaced by
    the first as many of the next document's (ascending id, then text; nulls first;
    the last is followed by the first). `near_edited` and `near_next` compare
    fingerprints; `common_prefix` is the longest common extension of text and edited
    text at their starts. Null texts are empty: their sketch has no spans, and they
    are like nothing but other empty texts. Repeated rows follow each other; an empty
    table gives no rows; columns other than the two named are not read.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed, _ = _with_next(rows, 4 * parts)

    def describe(text: str) -> tuple:
        h = PrefixHash(code_points(text))
        return text, h, fingerprint(h, h.sketch())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, (text, hash, fingerprint)) of the row before
        for part in slices(batches, "text"):
            out = []
            for doc_id, text, extra, place in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "extra", "bucket")), strict=True):
                if extra and (last is None or last[0] != place):
                    continue  # a further row of the id that follows the range
                now = describe(text)
                if last is not None and last[0] == place:
                    _, own_id, (own, own_hash, own_print) = last
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    _, edited_hash, edited_print = describe(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_print, edited_print, likeness(own_print, edited_print), likeness(own_print, now[2]), own_hash.common_extension(0, edited_hash, 0)))
                last = None if extra else (place, doc_id, now)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()], strict=True)))
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "key", "text").select("doc_id", "text", "extra", "bucket").mapInArrow(run, SCHEMA)
