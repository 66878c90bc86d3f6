"""BPE encoding and decoding with a word lexicon compiled into a minimal automaton.

The most frequent words of the corpus, with their ids, are compiled on the driver
into a shared-suffix acyclic automaton (bounded by `lexicon_words`), shipped as one
file and memory-mapped by every worker. Other words are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import published, saved, slices

#: White space of str.split() that the vocabulary's pattern takes for ordinary characters.
_ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Rules of a word-end BPE vocabulary file: normalising, cutting into words, merging."""

    def __init__(self, path: str):
        rules = json.loads(Path(path).read_text("utf-8"))
        model = rules["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(tuple(m) if isinstance(m, list) else tuple(m.split(" "))): i for i, m in enumerate(model["merges"])}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.word = regex.compile(rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.markers = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (a final sigma isn't special)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """White-space separated chunks of a normalised text; no word crosses them."""
        return regex.split(r"\s+", text) if _ODD.search(text) else text.split()

    def words(self, chunk: str) -> list[str]:
        """The chunk's words."""
        return self.word.findall(chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of a word by exact merging: always the pair of lowest rank, leftmost first."""
        parts = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        parts[-1] += self.end
        rank, none = self.ranks.get, len(self.ranks)
        if len(parts) > 64:
            parts = self._merge_long(parts)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
        return [self.ids[p] for p in parts if p in self.ids]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap and a linked list, for words of any length."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive: list[str | None] = list(parts)
        heap = [(self.ranks[pair], i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or alive[i] != left or alive[j] != right:
                continue
            alive[i], alive[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := (alive[a], alive[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], a, *pair))
        return [p for p in alive if p is not None]


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words' bytes, each word's number found on its path, then its ids.

    Each arc holds how many words come before those behind it, so that the sum
    along a word's path numbers the word; the number leads to its ids.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
    states: dict[tuple, int] = {}
    rows: list[tuple] = []  # (final, ((label, target), ...))
    counts: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in states:
            states[key] = len(rows)
            rows.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return states[key]

    path: list[list] = [[0, []]]  # open states along the last word: [final, arcs of settled targets]
    last = b""
    for word, _ in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        while len(path) - 1 > same:
            target = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        path += [[0, []] for _ in word[same:]]
        path[-1][0] = 1
        last = word
    while len(path) > 1:
        target = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], target))
    root = settle(path[0])
    first = np.cumsum([0, *(len(arcs) for _, arcs in rows)])
    arcs = []
    for final, out in rows:
        before = final
        for label, target in out:
            arcs.append((label, target, before))
            before += counts[target]
    offsets = np.cumsum([0, *(len(ids) for _, ids in words)])
    parts = [first, [f for f, _ in rows], [a[0] for a in arcs], [a[1] for a in arcs], [a[2] for a in arcs], offsets, [i for _, ids in words for i in ids]]
    arrays = [np.asarray(p, dtype="<i4") for p in parts]
    return np.asarray([root, *(len(a) for a in arrays)], dtype="<i4").tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype="<i4", mode="r")
        root, *sizes = data[:8].tolist()
        ends = np.cumsum([8, *sizes])
        self.root = root
        self.first, self.final, self.label, self.target, self.before, self.offsets, self.ids = (memoryview(data[a:b]) for a, b in zip(ends, ends[1:]))

    def find(self, word: str) -> list[int] | None:
        """The word's ids, or None if the lexicon hasn't the word."""
        state, number = self.root, 0
        first, label = self.first, self.label
        for byte in word.encode("utf-8", "surrogatepass"):
            end = first[state + 1]
            arc = bisect_left(label, byte, first[state], end)
            if arc == end or label[arc] != byte:
                return None
            number += self.before[arc]
            state = self.target[arc]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.final[state] else None


class _Chunks(dict):
    """Ids of chunks (as bytes): the latest `most`, and as many before them."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, most: int = 450_000):
        self.vocabulary, self.lexicon, self.most, self.older = vocabulary, lexicon, most, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older.get(chunk)
        if out is None:
            ids: list[int] = []
            for word in [chunk] if chunk.isalpha() else self.vocabulary.words(chunk):
                found = self.lexicon.find(word)
                ids += self.vocabulary.merge(word) if found is None else found
            out = array("i", ids).tobytes()
        self[chunk] = out
        return out


@lru_cache(maxsize=1)
def _worker_chunks(vocabulary_path: str, lexicon_name: str) -> _Chunks:
    """Kept by a worker process from task to task."""
    return _Chunks(Vocabulary(vocabulary_path), Lexicon(SparkFiles.get(lexicon_name)))


def frequent_words(docs: DataFrame, vocabulary_path: str, most: int, text_col: str = "text") -> list[str]:
    """The most frequent words over all documents, `most` at the most; counted before the shuffle.

    Words are taken by classes of frequency (eighths of a doubling), whole classes only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, chunks = Vocabulary(vocabulary_path), Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for word in vocabulary.words(chunk):
                    words[word] += n
            chunks.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        for part in slices(batches, "text"):
            for text in part.column(0).to_pylist():
                chunks.update(vocabulary.chunks(vocabulary.normal(text or "")))
            if len(chunks) >= 200_000:
                yield out()
        yield out()

    counts = docs.selectExpr(f"cast(`{text_col}` as string) as text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts.where("n > 1").withColumn("level", F.floor(F.log2("n") * 8)))
    least, total = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        if (total := total + r["count"]) > most:
            break
        least = r.level
    return [] if least is None else [r.word for r in counts.where(F.col("level") >= least).select("word").collect()]


def encode_documents(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 50_000) -> DataFrame:
    """Each document's ids and the text decoded from them: doc_id, ids array<int>, decoded string.

    Null texts are empty, empty texts give no ids and decode to the empty text,
    repeated rows come back each, an empty table gives none; columns other than
    the two named are not read. `lexicon_words` bounds the compiled lexicon (and
    what the driver receives); words beyond it are merged exactly.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    lexicon = compile_lexicon({w: vocabulary.merge(w) for w in frequent_words(docs, vocabulary_path, lexicon_words, text_col)})
    name = published(spark, lexicon, "lexicon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _worker_chunks(vocabulary_path, name)
        voc = chunks.vocabulary
        token = [voc.tokens.get(i, "") for i in range(max(voc.tokens) + 1)]

        def plain(text: str) -> bytes:
            return b"".join(map(chunks.__getitem__, voc.chunks(voc.normal(text))))

        for part in slices(batches, "text"):
            doc_ids, ids, sizes, decoded = part.column(0), [], [0], []
            for text in part.column(1).to_pylist():
                text = text or ""
                if voc.markers and "<|" in text and voc.markers.search(text):
                    got = b"".join(np.int32(voc.special[t]).tobytes() if t in voc.special else plain(t) for t in voc.markers.split(text))
                else:
                    got = plain(text)
                ids.append(got)
                sizes.append(len(got) // 4)
                decoded.append(" ".join(map(token.__getitem__, np.frombuffer(got, dtype="<i4").tolist())))
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
