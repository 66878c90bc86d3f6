"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Every partition tokenises its own documents and packs them in blocks of bounded
size, so nothing is shuffled and a lost task repeats only its own partition.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .batches import slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
)


class Encoder:
    """Byte-level BPE ids (little-endian uint32) of whole texts.

    Nothing is kept by word: where most words are new, to look them up costs more than to encode them with their text.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; markers of the vocabulary become their own id."""
        if any(s in text for s in self.special):
            return np.asarray(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        return self.bpe.encode_to_numpy(text, disallowed_special=()).tobytes() if text else b""


@dataclass(order=True)
class _Sequence:
    cost: float
    number: int
    room: int = field(compare=False)
    used: int = field(default=0, compare=False)


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (item, start, length, sequence, offset) of items shorter than `size`, and each sequence's cost.

    Items go in descending length to the sequence of least cost with room left;
    one that overruns its room is cut there and its rest goes on the same way.
    As many sequences as the tokens fill are opened; what is left over fills
    sequences of power-of-two lengths, so that no place is padded.
    """
    total = sum(lengths)
    heap = [_Sequence(0.0, k, size) for k in range(total // size)]
    rest = total % size
    small = [_Sequence(0.0, len(heap) + k, 1 << b) for k, b in enumerate(b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1)]
    costs = [0.0] * (len(heap) + len(small))
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[item]
        while left:
            target = heap[0] if heap else small[0]
            n = min(left, target.room)
            pieces.append((item, at, n, target.number, target.used))
            target.room, target.used, at, left = target.room - n, target.used + n, at + n, left - n
            target.cost += linear * n + quadratic * n * n
            costs[target.number] = target.cost
            if heap:
                heapq.heapreplace(heap, target) if target.room else heapq.heappop(heap)
            elif not target.room:
                small.pop(0)
    return pieces, costs


def _pack(docs: list[tuple[int | None, bytes]], size: int, linear: float, quadratic: float, first: int) -> tuple[pa.RecordBatch, int]:
    """Pieces of a block of documents, and the next free sequence number."""
    rows: list[tuple] = []
    number, rests = first, []
    full = linear * size + quadratic * size * size
    for doc_id, ids in docs:
        n = len(ids) // 4
        for start in range(0, n - n % size, size):
            rows.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], n, number, 0, full))
            number += 1
        if n % size:
            rests.append((doc_id, ids, n, n - n % size))
    pieces, costs = assign([n - start for _, _, n, start in rests], size, linear, quadratic)
    for item, at, length, sequence, offset in pieces:
        doc_id, ids, n, start = rests[item]
        at += start
        rows.append((doc_id, at, length, ids[4 * at : 4 * (at + length)], n, number + sequence, offset, costs[sequence]))
    columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], t.type) for t in _ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW), number + len(costs)


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    special: dict[str, int],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    size: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Pack every document, as ids and then `end_id`, into sequences of at most `size` tokens.

    Chunks of `size` fill sequences of their own; the rests are cost-balanced
    within blocks of about `block_tokens` tokens of one partition. Null texts are
    empty (one end id), a null id stays null, repeated rows are packed each, an
    empty table gives no rows; columns other than the two named are not read.
    The pieces' ids come back as little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern, special)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        block, tokens = [], 0
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                block.append((doc_id, encoder.encode(text or "") + end))
                tokens += len(block[-1][1]) // 4
                if tokens >= block_tokens:
                    out, number = _pack(block, size, linear, quadratic, number)
                    block, tokens = [], 0
                    yield from (out.slice(i, 2000) for i in range(0, out.num_rows, 2000))
        out, number = _pack(block, size, linear, quadratic, number)
        yield from (out.slice(i, 2000) for i in range(0, out.num_rows, 2000))

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, SCHEMA)
