"""Words, shingles and lines of whole Arrow string columns as numpy arrays.

Hashes are 64 bits wide: a polynomial over the bytes of a word with a table of random byte codes,
finished by a mixing function. A-Z and a-z share their codes, so hashes ignore ASCII case only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20  # bytes of text that are handled at once, unless one text is longer
_R = U(0x9E3779B97F4A7C15)  # odd, so that powers can be inverted modulo 2**64
_CODES = np.frombuffer(hashlib.shake_256(b"byte codes").digest(2048), dtype=U).copy()
_CODES[65:91] = _CODES[97:123]
_MULT = np.frombuffer(hashlib.shake_256(b"word places").digest(64), dtype=U) | U(1)
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        inverse = U(pow(int(_R), -1, 1 << 64))
        for k, base in enumerate((_R, inverse)):
            p = np.full(size, base, dtype=U)
            p[0] = U(1)
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


class Chunk:
    """Some texts of a column: bytes and the offsets of the texts in them; rows first .. first + len - 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1
        self._sums: np.ndarray | None = None

    def spans(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes for which word[byte]; bounds[d] : bounds[d + 1] are text d's."""
        w = word[self.data]
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        before = np.empty_like(w)
        before[0], before[1:] = False, w[:-1]
        before[self.offsets[:-1][self.offsets[:-1] < len(w)]] = False
        after = np.empty_like(w)
        after[-1], after[:-1] = False, w[1:]
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each byte range, the same wherever the range lies."""
        p, inverse = powers(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=U)
            np.cumsum(_CODES[self.data] * p[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts] + (ends - starts).astype(U))

    def code_points(self) -> np.ndarray:
        """At i: how many characters start before byte i."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The texts of a column, null as empty, in pieces of about size bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, places, content = column.buffers()
    at = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Chunk(data[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text (or paragraph): its sorted distinct hashes of k consecutive words.

    A text of fewer words, but not none, has the whole sequence as one shingle; a text without words has none.
    """
    n = len(words)
    total = np.zeros(max(0, n - k + 1), dtype=U)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _MULT[j] if len(total) else total
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            whole = (words[a:b] * _MULT[: b - a]).sum(dtype=U, keepdims=True) + np.full(1, b - a, dtype=U) * _MULT[7]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


def digest(values: np.ndarray) -> str:
    """32 hex digits for a sorted set of hashes; empty sets have none."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest() if len(values) else ""
