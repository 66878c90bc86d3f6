"""Language identification by prediction by partial matching: the language whose model codes a text's bytes shortest.

Each language has a tree of byte contexts up to `order` bytes, with the counts of what follows. A byte is coded in
the longest context that the language knows; where it has not followed there, an escape is coded and
the context shortened by a byte (the escape's share is that of the distinct bytes that follow, of both counts together).
The counts are frozen: scoring a text doesn't change them. Lengths are whole numbers of 1/65536 bit, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import saved, slices
from .words import mixed

BIT = 65536
PAD = 32  # what stands before a text's first byte
STEP = 1 << 20  # bytes that are scored at once


def padded(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after `order` pads, and where each text (with its pads) starts; the end of all last."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    starts = offsets + order * np.arange(len(offsets))
    out = np.full(starts[-1], PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(order * np.arange(1, len(offsets)), np.diff(offsets))] = data
    return out, starts


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """The k bytes that end at each place from k - 1 on, as numbers (k of 8 at most)."""
    out = np.zeros(max(len(data) - k + 1, 0), np.uint64)
    for i in range(k):
        out = out << np.uint64(8) | data[i : i + len(out)]
    return out


class Table:
    """Numbers by key, in a hash table with open addresses: a row for each language."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.full = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, bool)
        self.values = np.zeros((len(values), 1 << self.bits), np.int32)
        left, at = np.arange(len(keys)), self._places(keys)
        while len(left):
            free = ~self.full[at]
            slot, who = np.unique(at[free], return_index=True)  # the first of those that want a free place has it
            who = left[free][who]
            self.keys[slot], self.full[slot], self.values[:, slot] = keys[who], True, values[:, who]
            stay = ~np.isin(left, who)
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self._places(keys)
        out = np.where(self.full[at] & (self.keys[at] == keys), at, -1)
        left = np.flatnonzero((out < 0) & self.full[at])
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            here = at[left]
            same = self.full[here] & (self.keys[here] == keys[left])
            out[left[same]] = here[same]
            left = left[self.full[here] & ~same]
        return out


def _units(share: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(share) * BIT).astype(np.int64)


class Model:
    """The code lengths of all grams and escapes that the languages have seen, each language's complete: down to the order that it has them at."""

    def __init__(self, languages: list[str], order: int, counts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        """`counts`: (grams of k + 1 bytes ascending, how often each occurs) of each language and order k."""
        self.languages, self.order = languages, order
        self.grams: list[Table] = []
        self.contexts: list[Table] = []
        shorter_keys, shorter = np.arange(256, dtype=np.uint64), np.full((len(languages), 256), 8 * BIT, np.int64)
        for k in range(order + 1 if languages else 0):
            own = [counts.get((lang, k), (np.zeros(0, np.uint64), np.zeros(0, np.int64))) for lang in languages]
            keys = np.unique(np.concatenate([g for g, _ in own]))
            contexts = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(languages), len(contexts)), np.int64)
            below = keys & np.uint64((1 << 8 * max(k, 1)) - 1)  # without the context's first byte
            length = shorter[:, np.searchsorted(shorter_keys, below)]
            for row, (seen, n) in enumerate(own):
                at, first, distinct = np.unique(seen >> np.uint64(8), return_index=True, return_counts=True)
                total = np.add.reduceat(n, first) if len(n) else n
                escape[row, np.searchsorted(contexts, at)] = _units(distinct / (total + distinct))
                length[row] += escape[row, np.searchsorted(contexts, keys >> np.uint64(8))]
                length[row, np.searchsorted(keys, seen)] = _units(n / np.repeat(total + distinct, distinct))
            self.grams.append(Table(keys, length))
            self.contexts.append(Table(contexts, escape))
            shorter_keys, shorter = keys, length

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Per language the code length of each byte from `order` on, after those before it."""
        out = np.zeros((len(self.languages), len(data) - self.order), np.int64)
        left, keys = np.arange(out.shape[1]), grams(data, self.order + 1)
        for k in range(self.order, -1, -1):
            found = self.grams[k].find(keys)
            known = found >= 0
            for row, values in enumerate(self.grams[k].values):
                out[row, left[known]] += values[found[known]]
            left, keys = left[~known], keys[~known]
            if not len(left):
                return out
            context = self.contexts[k].find(keys >> np.uint64(8))
            known = context >= 0
            for row, values in enumerate(self.contexts[k].values):
                out[row, left[known]] += values[context[known]]
            keys = keys & np.uint64((1 << 8 * max(k, 1)) - 1)
        out[:, left] += 8 * BIT
        return out

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Per text and language the code length of the whole text."""
        data, starts = padded(texts, self.order)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        begins = starts[:-1] + self.order
        for a in range(self.order, len(data), STEP):
            b = min(a + STEP, len(data))
            lengths = self.lengths(data[a - self.order : b])
            first, last = np.searchsorted(starts[1:], a, side="right"), np.searchsorted(begins, b, side="left")
            edges = np.stack([np.clip(begins[first:last], a, b) - a, np.clip(starts[1 + first : 1 + last], a, b) - a], axis=1)
            sums = np.zeros((len(self.languages), lengths.shape[1] + 1), np.int64)
            np.cumsum(lengths, axis=1, out=sums[:, 1:])
            out[first:last] += (sums[:, edges[:, 1]] - sums[:, edges[:, 0]]).T
        return out


def fit(texts: DataFrame, *, order: int = 4, max_texts: int = 1_000) -> Model:
    """Learn from (lang, text) rows: all different texts of each language, or about `max_texts` of them chosen by a hash of the text.

    That bound is the model's: the driver gets the counts of the grams of `max_texts` texts a language, and broadcasts tables
    of them. Rows without a language, or with a text that is null or has no letter, take no part.
    """
    known = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text rlike '\\\\p{L}'")
    known = known.withColumn("at", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("at").alias("size"))
    chosen = known.join(F.broadcast(sizes), "lang").where(F.pmod("at", F.lit(1_000_003)) < F.lit(1_000_003) * max_texts / F.col("size"))
    sample = saved(chosen.groupBy("lang", "at").agg(F.first("text").alias("text")).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs = np.array(part.column(0).to_pylist())
            for lang in np.unique(langs):
                data, starts = padded(part.column(1).filter(pa.array(langs == lang)), order)
                begins = np.zeros(len(data), bool)
                begins[np.concatenate([np.arange(s, s + order) for s in starts[:-1].tolist()])] = True
                for k in range(order + 1):
                    keys, n = np.unique(grams(data, k + 1)[~begins[k:]], return_counts=True)
                    size = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([k] * size, pa.int32()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "k", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, ks, keys, n = (found.column(c).to_numpy() for c in ("lang", "k", "gram", "n"))
    counts = {}
    languages = sorted(set(langs.tolist()))
    for lang in languages:
        for k in range(order + 1):
            own = (langs == lang) & (ks == k)
            by = np.argsort(keys[own])
            counts[lang, k] = keys[own][by].view(np.uint64), n[own][by]
    return Model(languages, order, counts)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits) for every row: the language that codes its whole text shortest (the first by name of equals).

    `bits` has the code length of each of the model's languages, `score` the share that the best one has of all languages' probabilities of the text.
    A text that is null or has no letter is `und`, with score 0, as is any text for a model without languages. Repeated rows and
    rows with a null id are scored each; an empty table gives no rows. Texts of any length are scored about a million bytes at a time; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    if not model.languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, "text"):
            bits = known.totals(part.column(1)) / BIT
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            letters = part.column(2).to_numpy(zero_copy_only=False)
            names = [known.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), lists], ["doc_id", "lang_pred", "score", "bits"])

    return rows.mapInArrow(score, "doc_id long, lang_pred string, score double, bits array<double>")
