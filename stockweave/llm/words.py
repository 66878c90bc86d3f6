"""Word and shingle hashes of whole Arrow text columns, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text of a column, A-Z lower-cased, as 64-bit hashes.

    `start` and `stop` are byte offsets in `data`; text i has words first[i] to first[i+1].
    Nulls and texts without words have none.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.data = data
        n = len(data)
        inside = np.ones(n + 1, bool)
        inside[:n] = (data != 32) & ((data < 9) | (data > 13))
        inside[n] = False
        begins = inside[:n].copy()
        begins[1:] &= ~inside[: n - 1]
        edges = self.offsets[:-1][self.offsets[:-1] < n]
        begins[edges] = inside[edges]
        ends = inside[:n] & ~inside[1:]
        last = self.offsets[1:][self.offsets[1:] > 0] - 1
        ends[last] = inside[last]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0)).astype(np.uint8)
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        power[1:] = _STEP
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        # h(word) = sum of (byte+1) STEP^(i-start): the prefix difference moved back to exponent 0
        back = np.empty(n + 1, np.uint64)
        back[0] = 1
        back[1:] = _BACK
        np.multiply.accumulate(back, out=back)
        self.hash = mixed((sums[self.stop] - sums[self.start]) * back[self.start] + (self.stop - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def shingles(self, k: int) -> np.ndarray:
        """A hash of the k words from each word on (rolling over text ends: use only positions that fit)."""
        out = np.full(max(len(self.hash) - k + 1, 0), k, np.uint64)
        for i in range(k):
            out = mixed(out * _STEP + self.hash[i : i + len(out)])
        return out

    def sets(self, k: int) -> list[np.ndarray]:
        """Each text's distinct shingles of k words, ascending; with fewer words the whole sequence as one; without words none."""
        all_k = self.shingles(k)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(all_k[a : b - k + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in self.hash[a:b]:
                    h = mixed(h * _STEP + w)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        return out
