"""Exact N-gram Jaccard join: groups of documents with similar shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import dropped, saved, slices
from .setlinks import index_lists, link_lists, restrict
from .words import Words


def _first(n: int, percent: int) -> int:
    """In any order of all shingles, two similar sets share one of those that come first in each, if as many as this are taken."""
    return n - -(-percent * n // 100) + 1


def jaccard_groups(docs: DataFrame, *, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    A document's set: its distinct k-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z
    lower-cased); with fewer words the whole sequence as one; without words, or with a
    null text, empty and linked with nothing. Documents link when their sets' Jaccard
    similarity is `percent` per cent or more; component_id is the least doc_id reachable
    by links, the own one included. Sets hold 64-bit hashes of shingles, and equality is that of the hashes.

    Equal sets are collapsed first. Of its first shingles by hash value a set shares one
    with any similar set, and one more for each that both take beyond that; sets that share
    fewer with all others are done. The rest enter the index with their rarest shingles, counted exactly.

    Repeated rows come back each; rows with a null id have a null component unless a
    link leads to an id; an empty table gives no rows; columns other than the two named are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def name(s: np.ndarray) -> int:
        return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = Words(part.column(1)).sets(k)
            names = [name(s) if len(s) else None for s in sets]
            first = [s[: _first(len(s), percent) + max(1, len(s) // 20) - 1] for s in sets]
            need = [max(1, -(-percent * len(s) // 100) // 20) for s in sets]  # the least that the smallest similar set takes
            columns = [part.column(0), pa.array(names, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(need, pa.int32()), lists(first)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "n", "need", "first"])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s for s in Words(part.column(1)).sets(k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(name, sets), pa.int64()), lists(sets)], ["id", "items"])

    sets = saved(rows.mapInArrow(describe, "doc_id long, id long, n int, need int, first array<long>"))
    # Copies collapse to one set: its id is a 64-bit hash of its shingles.
    chosen = saved(sets.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.first("need").alias("need"), F.count("*").alias("copies")))
    keys = sets.select("id", F.explode("first").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key"))
    hits = keys.join(shared, "key").groupBy("id").agg(F.count("*").alias("hits"))
    wanted = saved(chosen.join(hits, "id").where("hits >= need * copies").select("id", "least"))
    # Sets of rows without an id are found by reading all those rows.
    texts = restrict(rows, saved(wanted.select(F.col("least").alias("doc_id")).where("doc_id is not null").distinct()), "doc_id").unionByName(rows.where("doc_id is null"))
    found = saved(restrict(texts.mapInArrow(items, "id long, items array<long>"), wanted.select("id"), "id").dropDuplicates(["id"]))
    groups = link_lists(saved(index_lists(found, percent)), found, percent)

    grouped = chosen.select("id", "least").join(groups, "id")
    heads = grouped.groupBy("component").agg(F.min("least").alias("of"))
    named = saved(chosen.select("id", "least").join(grouped.join(heads, "component").select("id", "of"), "id", "left").select("id", F.coalesce("of", "least").alias("component_id")))
    dropped(chosen, shared, wanted, found)
    return sets.select("doc_id", "id", "n").join(named, "id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
