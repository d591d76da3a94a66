"""Words of many texts at once: positions, hashes, and digests of runs of words.

Texts lie behind each other as the UTF-8 bytes of an Arrow array. Words are maximal
runs of bytes other than ASCII white space, compared with A-Z as a-z. All arrays have
one entry a word, so a slice of texts costs some hundred bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that are hashed along with all others; longer words go one by one.
LONG = 64
#: Odd multipliers: of the bytes of a word and of the words of a run, two of each.
BYTE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
RUN = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def parts(batch: pa.RecordBatch, column: str, rows: int = 1000, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most that many rows and, unless one row has more, bytes of the column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    while lo < batch.num_rows:
        hi = min(int(np.searchsorted(total, total[lo] + size, side="right")) - 1, lo + rows)
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one piece and the edges between them; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


class Words:
    """The words of texts: text (its row), start and stop (bytes), and 2 x 64 bits of hash."""

    def __init__(self, texts: pa.Array):
        self.data, self.edges = flat(texts)
        space = SPACE[self.data]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        inner = self.edges[1:-1]
        first, last = inner[inner < len(space)], inner[inner > 0] - 1
        begin[first], end[last] = ~space[first], ~space[last]  # a word ends with its text
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.text = np.searchsorted(self.edges, self.start, side="right") - 1
        self._hash()

    def __len__(self) -> int:
        return len(self.start)

    def _hash(self) -> None:
        lower, n = LOWER[self.data], self.stop - self.start
        order = np.argsort(np.minimum(n, LONG + 1), kind="stable")[::-1]
        start, size = self.start[order], n[order]
        rising = np.minimum(size, LONG + 1)[::-1]
        a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        for j in range(int(rising[-1]) if len(n) else 0):
            k = len(n) - int(np.searchsorted(rising, j, side="right"))  # words longer than j
            byte = lower[start[:k] + j].astype(np.uint64) + np.uint64(1)
            a[:k] = a[:k] * BYTE[0] + byte
            b[:k] = b[:k] * BYTE[1] + byte
        for i in range(int((size > LONG).sum())):
            whole = xxhash.xxh3_128_intdigest(lower[start[i] : start[i] + size[i]])
            a[i], b[i] = whole >> 64, whole & (2**64 - 1)
        self.hash = (np.empty_like(a), np.empty_like(b))
        for h, x in zip(self.hash, (a, b)):
            h[order] = mixed(x)

    def characters(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points between the start of a text and a byte position in it."""
        if not hasattr(self, "_inside"):
            self._inside = np.flatnonzero((self.data & 0xC0) == 0x80)
        lead = self.edges[text]
        return at - lead - (np.searchsorted(self._inside, at) - np.searchsorted(self._inside, lead))


class Runs:
    """Digests of runs of words, by sums that are made once for all words."""

    def __init__(self, words: Words):
        self.sums, self.back = [], []
        for h, base in zip(words.hash, RUN):
            up = np.full(len(h) + 1, base, np.uint64)
            down = np.full(len(h) + 1, pow(base, -1, 2**64), np.uint64)
            up[:1], down[:1] = 1, 1
            up, down = np.cumprod(up), np.cumprod(down)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1])]))
            self.back.append(down)

    def digest(self, lo: np.ndarray, hi: np.ndarray, salt: int, which: int = 0) -> np.ndarray:
        """64 bits of the words lo to hi (exclusive); digests of different salts do not meet."""
        run = (self.sums[which][hi] - self.sums[which][lo]) * self.back[which][lo]
        return mixed(run + mixed((hi - lo).astype(np.uint64) + np.uint64(salt << 40)))
