"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are unit length, so the inner product is the cosine. Coarse lists hold
four-bit codes; a query's tables are scanned over the lists it probes. The angle between
a vector and what its code stands for bounds how near it can be to a query: what may be
among the best by that bound is reranked by its exact cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import saved

CODEWORDS = 16


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Quantiser:
    """Coarse centroids and four-bit codebooks of `parts` subspaces."""

    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # parts x 16 x width
    weight: float  # of the parallel error beside the whole

    @property
    def parts(self) -> int:
        return len(self.books)

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x parts x width, padded with zeros."""
        width = self.books.shape[2]
        out = np.zeros((len(x), self.parts * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), self.parts, width)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centroids have the largest inner products with each vector, best first."""
        scores = x @ self.centroids.T
        n = min(n, scores.shape[1])
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, axis=1), axis=1, kind="stable"), axis=1)

    def encode(self, x: np.ndarray, lists: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that make ||r||^2 + weight <r, x>^2 small for the error r, by coordinate descent."""
        target, direction = self.split(x - self.centroids[lists]), self.split(x)
        codes = np.stack([((target[:, m, None, :] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)], axis=1)
        along = sum(((target[:, m] - self.books[m][codes[:, m]]) * direction[:, m]).sum(1) for m in range(self.parts))
        for _ in range(sweeps):
            for m in range(self.parts):
                error = target[:, m, None, :] - self.books[m]
                part = (error * direction[:, m, None, :]).sum(2)
                own = np.take_along_axis(part, codes[:, m, None], axis=1)[:, 0]
                rest = along - own
                codes[:, m] = ((error**2).sum(2) + self.weight * (rest[:, None] + part) ** 2).argmin(1)
                along = rest + np.take_along_axis(part, codes[:, m, None], axis=1)[:, 0]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray, dim: int) -> np.ndarray:
        """What the codes stand for."""
        parts = self.books[np.arange(self.parts), codes]
        return self.centroids[lists] + parts.reshape(len(codes), -1)[:, :dim]

    def scan(self, queries: np.ndarray, codes: np.ndarray, at: int) -> np.ndarray:
        """Approximate inner products of queries with the coded vectors of one list: sums of table entries."""
        tables = np.einsum("qmw,mcw->qmc", self.split(queries), self.books).astype(np.float32)
        scores = np.repeat((queries @ self.centroids[at]).astype(np.float32)[:, None], len(codes), axis=1)
        for m in range(self.parts):
            scores += tables[:, m][:, codes[:, m]]
        return scores


def train(x: np.ndarray, lists: int, width: int = 2, threshold: float = 0.2, rounds: int = 6, seed: int = 7) -> Quantiser:
    """Fit on unit vectors. `threshold` is the inner product from which errors matter; it sets the parallel weight."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    lists = max(1, min(lists, n))
    centroids = x[rng.choice(n, lists, replace=False)].copy()
    for _ in range(12):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    own = (x @ centroids.T).argmax(1)
    centroids = np.stack([x[own == j].mean(0) if (own == j).any() else centroids[j] for j in range(lists)])
    parts = -(-dim // width)
    eta = (dim - 1) * threshold**2 / (1 - threshold**2)
    q = Quantiser(centroids, np.zeros((parts, CODEWORDS, width)), max(eta - 1, 0.0))
    target, direction = q.split(x - centroids[own]), q.split(x)
    for m in range(parts):
        q.books[m] = target[rng.choice(n, CODEWORDS, replace=n < CODEWORDS), m]
        for _ in range(8):
            code = ((target[:, m, None, :] - q.books[m]) ** 2).sum(2).argmin(1)
            for c in range(CODEWORDS):
                if (code == c).any():
                    q.books[m, c] = target[code == c, m].mean(0)
    for _ in range(rounds):
        codes = q.encode(x, own, 1)
        along = sum(((target[:, m] - q.books[m][codes[:, m]]) * direction[:, m]).sum(1) for m in range(parts))
        for m in range(parts):
            u, t = direction[:, m], target[:, m]
            rest = along - ((t - q.books[m][codes[:, m]]) * u).sum(1)
            for c in range(CODEWORDS):
                k = codes[:, m] == c
                if k.any():
                    outer = np.eye(width) * k.sum() + q.weight * u[k].T @ u[k]
                    right = t[k].sum(0) + q.weight * (u[k] * ((t[k] * u[k]).sum(1) + rest[k])[:, None]).sum(0)
                    q.books[m, c] = np.linalg.solve(outer, right)
            along = rest + ((t - q.books[m][codes[:, m]]) * u).sum(1)
    return q


def _pack(codes: np.ndarray) -> list[bytes]:
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    both = codes[:, ::2] | codes[:, 1::2] << 4
    return [r.tobytes() for r in both]


def _unpack(packed: list[bytes], parts: int) -> np.ndarray:
    both = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return np.stack([both & 15, both >> 4], axis=2).reshape(len(packed), -1)[:, :parts]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of rows in double precision; the same for a pair, whichever rows are beside it."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _may_reach(about: np.ndarray, length: np.ndarray, slack: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which vectors (columns) may have a cosine of `least` or more with each query (rows).

    `about` has a query's inner products with what the codes stand for, vectors of `length` at an angle of `slack` to
    the coded ones. The angle to a coded vector is at least that to its code less `slack`. The scan is in single precision, hence the margin.
    """
    angle = np.arccos(np.clip(least, -1.0, 1.0))[:, None] + 1e-7
    bound = np.cos(angle) * np.cos(slack) - np.sin(angle) * np.sin(slack)
    return (about + 1e-5 * (1 + length) >= length * bound) | (angle + slack >= np.pi)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1) if len(column) else np.zeros((0, 1), "<f4")


def nearest_neighbours(
    embeddings: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = 20_000, most_lists: int = 16, probe: float = 1.0, rerank: int = 96, chunk: int = 8192
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine, not counting itself; ties to the smaller id.

    `queries` is a table of ids of `embeddings`. Equal vectors are collapsed to one class
    that keeps its k + 1 least ids, so any number of copies costs one entry. The index is
    fitted on about `train_rows` classes, and every class is indexed; a query probes the
    share `probe` of the lists (8 at least; all, by default: vectors without clusters have
    their neighbours in any list). In each block its `rerank` best are scored exactly, and
    then all that may be as near as the (k + 1)-th of those, however many: among the probed lists
    nothing is missed, whatever the codes are worth on the rows.
    Lists are scanned in blocks of `chunk` vectors and eight times as many queries. Vectors that are null, zero,
    hold null or non-finite components, or have another length than most, take no part.
    Repeated ids are candidates each; an empty table gives no rows; columns other than the
    two named are not read.
    """
    spark = embeddings.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where("vec_id is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim = sizes["size"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = found.setdefault(np.asarray(v, "<f4").tobytes(), [])
                ids.append(i)
                if len(ids) > 64:
                    ids[:] = sorted(ids)[: k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array([sorted(x)[: k + 1] for x in found.values()], pa.list_(pa.int64()))], ["v", "ids"])

    least = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")
    valid = rows.where(F.size("v") == dim)
    # Copies meet in three steps, each of which keeps k + 1 ids: in a batch, in a share of the batches, in all.
    once = valid.mapInArrow(gather, "v binary, ids array<long>").groupBy("v", F.pmod(F.hash(F.get("ids", F.lit(0))), F.lit(64)).alias("share")).agg(least)
    classes = saved(once.groupBy("v").agg(least).select(F.get("ids", F.lit(0)).alias("cid"), "v", "ids"))
    count = classes.count()
    lists = max(1, min(most_lists, int(math.sqrt(count))))
    probes = min(lists, max(8, math.ceil(probe * lists)))
    picked = classes if count <= train_rows else classes.where(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < int(1_000_000 * train_rows / count))
    sample = np.stack([np.frombuffer(r.v, "<f4") for r in picked.orderBy("cid").select("v").collect()])
    q = train(_unit(sample), lists)

    sought = queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    asked = valid.join(sought, "vec_id", "left_semi").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, "<f4").tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["query_id", "v"]) for b in batches), "query_id long, v binary"
    )
    asked = saved(asked.join(classes.select("v", "cid"), "v").select("query_id", "cid"))
    wanted = classes.join(asked.select("cid").distinct(), "cid", "left_semi")

    code_chunks = max(1, math.ceil(count / lists / chunk))
    query_chunks = max(1, math.ceil(asked.count() * probes / lists / (8 * chunk)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_vectors(b.column("v")))
            own = q.nearest(x, 1)[:, 0]
            code = q.encode(x, own)
            stands = q.decode(code, own, dim)
            length = np.linalg.norm(stands, axis=1)
            slack = np.arccos(np.clip((x * stands).sum(1) / np.maximum(length, 1e-12), -1.0, 1.0)) + 1e-7
            columns = [pa.array(own, pa.int32()), b.column("cid"), pa.array(_pack(code), pa.binary()), pa.array(length), pa.array(np.where(length > 1e-6, slack, np.pi)), b.column("v")]
            yield pa.RecordBatch.from_arrays(columns, ["list", "cid", "code", "length", "slack", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = q.nearest(_unit(_vectors(b.column("v"))), probes)
            n = near.shape[1]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column("cid").take(at), b.column("v").take(at)], ["list", "qid", "v"])

    def scan(codes: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(asks):
            codes = codes.sort_values("cid")
            packed, cids, at = _unpack(codes["code"].tolist(), q.parts), codes["cid"].to_numpy(), int(codes["list"].iloc[0])
            length, slack = codes["length"].to_numpy(), codes["slack"].to_numpy()
            y = np.frombuffer(b"".join(codes["v"]), "<f4").reshape(len(codes), -1)
            x, qids = np.frombuffer(b"".join(asks["v"]), "<f4").reshape(len(asks), -1), asks["qid"].to_numpy()
            n, m = min(max(rerank, k + 1), len(y)), min(k + 1, len(y))
            for i in range(0, len(x), 256):
                xs = x[i : i + 256]
                about = q.scan(_unit(xs), packed, at)
                first = np.argpartition(-about, n - 1, axis=1)[:, :n]
                least = np.array([np.partition(_cosines(y[f], v[None]), n - m)[n - m] for f, v in zip(first, xs, strict=True)])
                for qid, v, may in zip(qids[i : i + 256], xs, _may_reach(about, length, slack, least), strict=True):
                    found = np.flatnonzero(may)
                    scores = _cosines(y[found], v[None])
                    top = np.lexsort((found, -scores))[:m]  # ties: the smaller id
                    out.append(pd.DataFrame({"qid": qid, "cid": cids[found[top]], "about": scores[top]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "cid": [], "about": []})

    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = classes.select("cid", "v").mapInArrow(encode, "list int, cid long, code binary, length double, slack double, v binary").withColumn("a", part("cid", code_chunks)).withColumn("b", every(query_chunks))
    asks = wanted.select("cid", "v").mapInArrow(route, "list int, qid long, v binary").withColumn("b", part("qid", query_chunks)).withColumn("a", every(code_chunks))
    about = codes.groupBy("list", "a", "b").cogroup(asks.groupBy("list", "a", "b")).applyInPandas(scan, "qid long, cid long, about double")
    best = about.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("about"), "cid"))).where(F.col("n") <= k + 1).select("qid", "cid")
    best = best.unionByName(wanted.select(F.col("cid").alias("qid"), "cid")).distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _cosines(_vectors(b.column("v")), _vectors(b.column("w"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("ids"), pa.array(scores)], ["qid", "ids", "score"])

    pairs = best.join(classes.select("cid", "v", "ids"), "cid").join(classes.select(F.col("cid").alias("qid"), F.col("v").alias("w")), "qid")
    scored = pairs.select("qid", "ids", "v", "w").mapInArrow(exact, "qid long, ids array<long>, score double")
    single = scored.select("qid", "score", F.explode("ids").alias("vec_id"))
    order = (F.desc("score"), "vec_id")
    top = single.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("n") <= k + 1)
    answers = top.groupBy("qid").agg(F.collect_list(F.struct("vec_id", "score")).alias("hits"))
    each = asked.join(answers, F.col("cid") == F.col("qid")).select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
