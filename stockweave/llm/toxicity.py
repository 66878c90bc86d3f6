"""Toxicity scores: a linear support vector machine over a gapped subsequence kernel.

Words are compared with landmark strings by the gap-weighted subsequence kernel, so
inserted characters and gaps only weaken a match. The Nyström map of the landmarks
turns the kernel into features; a text's are those of the sum kernel of its words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .batches import saved, slices

#: Texts scored as high as this are taken for toxic.
TOXIC = 0.3
#: Subsequences of this length count, each with DECAY to the power of the span it covers.
LENGTH, DECAY = 3, 0.6
#: Texts are sums over words of the normalised kernel to these powers (one the square of the other), which are kernels
#: too: weak matches, as many clean words have them, count little, but none is left out.
POWERS = (3, 6)
#: A text without words counts as clean, as often as this share of the clean rows, in fitting.
EMPTY = 0.02
#: Longer words and joined runs are compared in overlapping pieces of this length.
PIECE = 20
#: Single characters written apart: `a b c d`.
_APART = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")


def subsequence_kernel(s: str, t: str, length: int = LENGTH, decay: float = DECAY) -> float:
    """Sum over the common subsequences of `length` characters of decay^(span in s + span in t)."""
    n, m = len(s), len(t)
    if min(n, m) < length:
        return 0.0
    before = [[1.0] * (m + 1) for _ in range(n + 1)]
    for _ in range(length - 1):
        now = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(1, n + 1):
            run, above, row, old = 0.0, now[i - 1], now[i], before[i - 1]
            c = s[i - 1]
            for j in range(1, m + 1):
                run *= decay
                if t[j - 1] == c:
                    run += decay * decay * old[j - 1]
                row[j] = decay * above[j] + run
        before = now
    total = 0.0
    for i in range(1, n + 1):
        c, old = s[i - 1], before[i - 1]
        total += sum(old[j] for j in range(m) if t[j] == c)
    return total * decay * decay


def words_of(text: str) -> Counter:
    """How often each lower-case word occurs; marks inside words go, letters written apart are joined."""
    text = text.lower()
    found = Counter(text.split())
    for run in _APART.findall(text):
        found[run.replace(" ", "")] += 1
    return found


def gapped(text: str) -> str:
    """The text with a letter more inside each word of four letters or more, at a place and of a kind that the word's hash gives."""

    def one(found: re.Match) -> str:
        word = found[0]
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        at = 1 + h % (len(word) - 1)
        return word[:at] + chr(97 + h // 64 % 26) + word[at:]

    return re.sub(r"[^\W_]{4,}", one, text)


def _letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.int64)


@lru_cache(maxsize=None)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """All rising triples of places in a word of `size` letters, and DECAY to the power of each one's span."""
    at = np.array(list(combinations(range(size), LENGTH)), np.int64).reshape(-1, LENGTH)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


class Landmarks:
    """Landmark strings, and the kernel values of the words met so far with each of them; keeps the latest.

    The kernel is a product of two sparse vectors, of the weights of each word's
    subsequences. Those of the landmarks are a table, so a word costs its own subsequences only.
    """

    def __init__(self, strings: list[str], most: int = 120_000):
        self.strings, self.most = strings, most
        self.longest = max(map(len, strings), default=0)
        self.alphabet = np.unique(np.array([ord(c) for s in strings for c in s], np.int64))
        self.base = len(self.alphabet) + 1
        weights: dict[int, np.ndarray] = {}
        for j, s in enumerate(strings):
            at, span = _places(len(s))
            for code, w in zip(self._codes(_letters([s]), at)[0].tolist(), span.tolist(), strict=True):
                weights.setdefault(code, np.zeros(len(strings)))[j] += w
        dense = np.array([weights[c] for c in sorted(weights)]).reshape(len(weights), len(strings))
        self.norms = np.sqrt((dense**2).sum(axis=0))
        self.place = np.full(self.base**LENGTH, -1, np.int32)
        self.place[np.array(sorted(weights), np.int64)] = np.arange(len(weights))
        # The landmarks that have each subsequence, one after another, and its weight in them.
        row, self.column = np.nonzero(dense)
        self.weight = dense[row, self.column] / self.norms[self.column]
        self.first = np.searchsorted(row, np.arange(len(weights) + 1))
        gram = dense.T @ dense / np.outer(self.norms, self.norms)
        self.maps = []
        for power in POWERS:
            values, vectors = np.linalg.eigh((gram**power + gram.T**power) / 2)
            self.maps.append(vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T)  # gram^(-1/2)
        self.known: dict[str, int] = {}
        self.values = np.zeros((most, len(strings)), np.float32)  # of known words, to the first power

    def _codes(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A number for each word's subsequence at each row of `at`, by places in the landmarks' alphabet (the last: not in it)."""
        place = np.minimum(np.searchsorted(self.alphabet, letters), max(self.base - 2, 0))
        place = np.where(self.alphabet[place] == letters, place, self.base - 1)
        code = place[:, at[:, 0]]
        for i in range(1, LENGTH):
            code = code * self.base + place[:, at[:, i]]
        return code

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values of words of one length with all landmarks, a row each."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        size = len(words[0])
        if size < LENGTH or not self.strings:
            return out
        at, span = _places(size)
        step = max(1, 200_000 // len(at))
        for i in range(0, len(words), step):
            letters = _letters(words[i : i + step])
            place = self.place[self._codes(letters, at)]
            row, subsequence = np.nonzero(place >= 0)
            if not len(row):
                continue
            hit = place[row, subsequence]
            count = self.first[hit + 1] - self.first[hit]
            entry = np.arange(count.sum()) + np.repeat(self.first[hit] - np.cumsum(count) + count, count)
            cell = np.repeat(row * len(self.strings), count) + self.column[entry]
            found = np.bincount(cell, self.weight[entry] * np.repeat(span[subsequence], count), len(letters) * len(self.strings)).reshape(len(letters), -1)
            own = np.unique(row)
            out[i + own] = found[own] / self._own(letters[own], span)[:, None]
        return out

    @staticmethod
    def _own(letters: np.ndarray, span: np.ndarray) -> np.ndarray:
        """The words' own norms. A word without equal letters has each subsequence once; for others it is the kernel's recursion."""
        norms = np.full(len(letters), math.sqrt((span**2).sum()))
        ordered = np.sort(letters, axis=1)
        again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
        size = letters.shape[1]
        for i in range(0, len(again), 1024):
            some = np.ascontiguousarray(letters[again[i : i + 1024]].T)
            match = (some[:, None] == some[None, :]) * DECAY**2  # size x size x words
            now = match.copy()
            for _ in range(LENGTH - 1):
                for j in range(1, size):
                    now[:, j] += DECAY * now[:, j - 1]
                for j in range(1, size):
                    now[j] += DECAY * now[j - 1]
                sums = now[:-1, :-1]
                now = np.zeros_like(match)
                now[1:, 1:] = match[1:, 1:] * sums
            norms[again[i : i + 1024]] = np.sqrt(now.sum((0, 1)))
        return norms

    def _pieces(self, word: str) -> list[str]:
        """The word, or overlapping pieces of a long one: each run as long as the longest landmark lies whole in one."""
        size = max(PIECE, self.longest + 4)
        if len(word) <= size:
            return [word]
        step = size - self.longest
        return sorted({word[i : i + size] for i in range(0, len(word) - self.longest + 1, step)})

    def learn(self, words: set[str]) -> None:
        """Add the kernel values of the words that are new: of a long word the largest of its pieces."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:  # room for the words of these texts, or more if they have more
            self.known, new = {}, list(words)
        pieces: dict[int, list[tuple[int, str]]] = {}
        for n, word in enumerate(new):
            for piece in self._pieces(word if word.isalnum() else _MARKS.sub("", word)):
                pieces.setdefault(len(piece), []).append((n, piece))
        start, stop = len(self.known), len(self.known) + len(new)
        if stop > len(self.values):
            self.values = np.zeros((stop, len(self.strings)), np.float32)
        values = self.values[start:stop]
        values[:] = 0
        for some in pieces.values():
            of = np.array([n for n, _ in some])
            found = self.kernels([p for _, p in some]) ** POWERS[0]
            if len(np.unique(of)) == len(of):
                values[of] = np.maximum(values[of], found)
            else:
                np.maximum.at(values, of, found)
        self.known.update(zip(new, range(start, stop), strict=True))

    def features(self, texts: list[str]) -> np.ndarray:
        """Nyström features of each text, of the sum and of the mean of its words' kernels to each power, as signed logarithms."""
        counted = [words_of(t) for t in texts]
        self.learn(set().union(*counted))
        sums, means = np.zeros((2, len(POWERS), len(texts), len(self.strings)))
        for row, words in enumerate(counted):
            times = np.fromiter(words.values(), np.float32, len(words))
            values = self.values[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
            sums[:, row] = times @ values, times @ (values * values)
            means[:, row] = sums[:, row] * (100 / max(float(times.sum()), 1))
        mapped = np.concatenate([x[k] @ m for x in (sums, means) for k, m in enumerate(self.maps)], axis=1)
        return np.sign(mapped) * np.log1p(np.abs(mapped))


@dataclass(frozen=True)
class Model:
    """A fitted scorer."""

    strings: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities that the texts are toxic; an empty text's is that of one without any landmark."""
        margins = _landmarks(self.strings).features(texts) @ np.asarray(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])


@lru_cache(maxsize=1)
def _landmarks(strings: tuple[str, ...]) -> Landmarks:
    return Landmarks(list(strings))


def _choose(counts: pd.DataFrame, most: int) -> list[str]:
    """Landmarks among candidate strings: the most telling first, of equal ones the longest, none too like an earlier one."""
    toxic, clean = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    n_toxic, n_clean = counts.attrs["toxic"], counts.attrs["clean"]
    gain = (toxic / max(n_toxic, 1) - clean / max(n_clean, 1)) * np.log2((toxic + 0.5) / max(n_toxic, 1) / ((clean + 0.5) / max(n_clean, 1)))
    chosen: list[str] = []
    for i in sorted(range(len(counts)), key=lambda i: (-gain[i], -len(counts["word"].iloc[i]), counts["word"].iloc[i])):
        word = counts["word"].iloc[i]
        own = subsequence_kernel(word, word)
        if own and all(subsequence_kernel(word, c) < 0.8 * math.sqrt(own * subsequence_kernel(c, c)) for c in chosen):
            chosen.append(word)
            if len(chosen) == most:
                break
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, most: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge loss, classes weighted alike), by Newton steps until the rows inside the margin stay the same."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag(np.append(np.full(x.shape[1], penalty), 1e-6))
    w, before = np.zeros(z.shape[1]), None
    for _ in range(most):
        inside = sign * (z @ w) < 1
        if before is not None and (inside == before).all():
            break
        before, some = inside, z[inside]
        w = np.linalg.solve(ridge + some.T @ (some * share[inside][:, None]), some.T @ (share * sign)[inside])
    return w[:-1], float(w[-1])


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the margins (smoothed targets, Newton steps)."""
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, c = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, math.log((n1 + 1) / (n0 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        c = c - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return float(c[0]), float(c[1])


def fit(texts: DataFrame, *, max_rows: int = 10_000, landmarks: int = 64, candidates: int = 4_000) -> Model:
    """Fit on (doc_id, text, toxic) rows, or on about `max_rows` of them chosen by a hash of their ids.

    Toxic texts, and one clean text in four, are learnt from as they are and gapped(), so
    that inserted letters don't hide what is toxic. The bound holds what the driver receives: `candidates` strings, and
    one or two rows of 4 x `landmarks` features for each row of the sample. Landmarks are words, and starts of words, of 4 to PIECE letters. Rows with a null label take no
    part; without rows of both labels every score is the share of toxic rows.
    """
    labelled = texts.where("toxic is not null")
    count = labelled.count()
    if count > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    sample = saved(labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")))

    def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(found[0].keys() | found[1].keys())
            done = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[1][w] for w in names], pa.int64()), pa.array([found[0][w] for w in names], pa.int64())], ["word", "toxic", "clean"])
            for c in found:
                c.clear()
            return done

        for part in slices(batches, "text"):
            for text, toxic in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                plain = {_MARKS.sub("", w) for w in words_of(text or "")}
                found[toxic > 0].update({p for w in plain for p in (w, w[:4], w[:5], w[:6], w[:7], w[:8]) if LENGTH < len(p) <= PIECE})
            if len(found[0]) + len(found[1]) > 300_000:
                yield out()
        yield out()

    totals = {bool(r.toxic): r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(n_toxic + n_clean, 1)
        return Model((), (), 0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    counts = sample.mapInArrow(count_strings, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = F.col("toxic") / n_toxic - F.col("clean") / n_clean
    best = counts.where(F.col("toxic") >= min(5, max(1, n_toxic // 20))).orderBy(F.desc(lift * F.log2((F.col("toxic") + 0.5) / n_toxic / ((F.col("clean") + 0.5) / n_clean))), F.desc(F.length("word")), "word").limit(candidates).toPandas()
    best.attrs |= {"toxic": n_toxic, "clean": n_clean}
    strings = tuple(_choose(best, landmarks))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _landmarks(strings)
        for part in slices(batches, "text", 1_000_000):
            ids, texts, labels = (part.column(i).to_pylist() for i in range(3))
            # All that is toxic is learnt gapped too, and one clean text in four.
            twice = [i for i, t in enumerate(texts) if labels[i] > 0 or zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 4 == 0]
            texts = [t or "" for t in texts] + [gapped(texts[i] or "") for i in twice]
            rows = marks.features(texts).astype(np.float32)
            columns = [pa.array(x + [x[i] for i in twice], t) for x, t in ((ids, pa.int64()), (labels, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "toxic", "x"])

    rows = sample.mapInArrow(describe, "doc_id long, toxic int, x binary").toPandas().sort_values(["doc_id", "x"])
    x, y = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1).astype(float), rows["toxic"].to_numpy()
    scale = x.std(axis=0) + 1e-6
    empty = max(1, round(EMPTY * (y <= 0).sum()))
    w, b = _svm(np.concatenate([x / scale, np.zeros((empty, x.shape[1]))]), np.concatenate([y, np.zeros(empty, y.dtype)]))
    w = w / scale
    slope, shift = _platt(x @ w + b, y)
    return Model(strings, tuple(w.tolist()), float(b), slope, shift)


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score) for every document, or all its columns and `toxicity` (replacing one of that name) if `keep`.

    Null texts are empty and get the score of a text without any landmark; repeated rows
    come back each; an empty table gives no rows. Only the text enters the score. Texts
    are scored about a megabyte at a time, whatever the size of Arrow's batches.
    """
    if keep:
        rows = docs.drop("toxicity").withColumn(text_col, F.col(text_col).cast("string"))
        names, schema, column = rows.columns, StructType([*rows.schema.fields, StructField("toxicity", DoubleType())]), text_col
    else:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        names, schema, column = ["doc_id"], "doc_id long, score double", "text"
    at, text = [rows.columns.index(c) for c in names], rows.columns.index(column)
    name = "toxicity" if keep else "score"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, 1_000_000):
            scores = model.scores([t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in at), pa.array(scores, pa.float64())], [*names, name])

    return rows.mapInArrow(score, schema)
