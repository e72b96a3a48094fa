"""Words of whole batches of texts, found and hashed in numpy.

Texts are read from the buffers of an Arrow array of bytes, folded by a table that makes every separator a space,
and cut to words together. What is needed beside the texts is about six bytes for each of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

#: Bytes that are hashed together; longer words are hashed one by one.
BLOCK = 1 << 20
LONG_WORD = 1 << 12
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + LONG_WORD + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words by position: a polynomial over the bytes, read from running sums."""

    _one: Hasher | None = None

    @classmethod
    def shared(cls) -> Hasher:
        """One for each worker."""
        cls._one = cls._one or cls()
        return cls._one

    def __init__(self):
        self.up, self.down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def words(self, folded: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of every word; none goes over a cut (the sorted ends of texts)."""
        raw = np.frombuffer(folded, dtype=np.uint8)
        inside = raw != 32
        edge = np.empty(len(raw) + 1, dtype=bool)
        edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
        edge[1:-1] = inside[1:] != inside[:-1]
        # A cut inside a run of letters ends one word and starts the next.
        at = cuts[(cuts > 0) & (cuts < len(raw))]
        at = np.unique(at[inside[at - 1] & inside[at]]) if len(at) else at
        marks = np.flatnonzero(edge)
        if len(at):
            marks = np.sort(np.concatenate([marks, at, at]))
        start, end = marks[::2], marks[1::2]
        h = np.empty(len(start), dtype=np.uint64)
        for k in np.flatnonzero(end - start > LONG_WORD):
            h[k] = xxh64_intdigest(folded[start[k] : end[k]])
        short = np.flatnonzero(end - start <= LONG_WORD)
        for part in np.split(short, np.flatnonzero(np.diff(start[short] // BLOCK)) + 1):
            if len(part):
                lo, hi = int(start[part[0]]), int(end[part[-1]])
                total = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * self.up[: hi - lo], out=total[1:])
                h[part] = (total[end[part] - lo] - total[start[part] - lo]) * self.down[start[part] - lo]
        return start, end, mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class TextBatch:
    """Start, end, hash and text number of the words of a batch of texts; n_words and first word of each text."""

    def __init__(self, hasher: Hasher, texts: pa.Array, fold: bytes):
        _, offsets, data = texts.buffers()
        cut = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.folded = (memoryview(data)[cut[0] : cut[-1]].tobytes() if data is not None else b"").translate(fold)
        ends = cut[1:] - cut[0]
        self.start, self.end, self.hash = hasher.words(self.folded, ends)
        self.of = np.searchsorted(ends, self.start, side="right")
        self.n_words = np.bincount(self.of, minlength=len(texts))
        self.first = np.r_[0, np.cumsum(self.n_words)]
