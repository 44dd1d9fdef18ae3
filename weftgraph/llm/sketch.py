"""Fixed-size sketches of all 64-bit hashes of a corpus, built by tasks and merged segment by segment.

Two are offered. Twice: a pair of Bloom filters, of hashes seen once and of hashes seen again; a hash that two
documents hold is always in the second, one that a single document holds seldom is. Counts: how often the hashes
of each cell occur, on a logarithmic scale, as a rough document frequency.

A task sends each segment of its sketch compressed; the segments are dealt out by a shuffle, sorted, and merged as
a stream, so that no task holds more than one segment. Only the merged sketch, whose largest size is a parameter,
goes through the driver. It is broadcast as bytes that workers read where they lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow_text import U, mix

SEGMENTS = 64
MAX_BITS = 29  # 64 MB; see sift()
FLUSH = 1 << 20  # hashes that a task holds before it sends them on
_SCHEMA = "segment int, once binary, again binary"
_ARROW = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
_SEEDS = np.arange(1, 9, dtype=U) * U(0xD1342543DE82EF95)
_COUNTS = 7  # the probe of the counts

Hashes = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def mergers(spark: SparkSession) -> int:
    """Tasks that merge, each some segments: as many as a shuffle has, but no more than there are segments."""
    return min(SEGMENTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cells(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (mix(hashes + _SEEDS[probe]) >> U(64 - bits)).astype(np.int64)


def _pack(positions: np.ndarray) -> bytes:
    """Sorted positions as compressed differences, bytes of the same weight together."""
    apart = np.diff(positions, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return zlib.compress(apart.T.tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    apart = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(apart.T).view(np.uint32).ravel().astype(np.int64))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class TwiceFilter:
    """The filter of hashes seen again."""

    def __init__(self, spark: SparkSession, packed: np.ndarray, bits: int, probes: range):
        self.sent = spark.sparkContext.broadcast(packed.tobytes())
        self.bits, self.probes = bits, probes

    def test(self, hashes: np.ndarray) -> np.ndarray:
        packed = np.frombuffer(self.sent.value, dtype=np.uint8)
        found = np.ones(len(hashes), dtype=bool)
        for k in self.probes:
            at = cells(hashes, self.bits, k)
            found &= (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def forget(self) -> None:
        """For the end of a task: the worker, which waits for others, holds the filter no longer. The next task that
        needs it reads it again from the executor's disk."""
        vars(self.sent).pop("_value", None)

    def release(self) -> None:
        self.sent.destroy()


class Sifted:
    """Two filters, the second built from the hashes that passed the first, and about how often those hashes occur:
    a byte that grows with the logarithm of the count."""

    def __init__(self, spark: SparkSession, first: TwiceFilter, second: TwiceFilter, ranks: np.ndarray, rank_bits: int):
        self.first, self.second, self.rank_bits = first, second, rank_bits
        self.typical = int(2 ** (float(np.median(ranks)) / 8)) - 1  # the count of a cell in the middle
        self.sent = spark.sparkContext.broadcast(ranks.tobytes())

    def test(self, hashes: np.ndarray) -> np.ndarray:
        """Whether another document may hold the hash; true for each that one does."""
        found = self.first.test(hashes)
        at = np.flatnonzero(found)
        found[at] = self.second.test(hashes[at])
        return found

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.sent.value, dtype=np.uint8)[cells(hashes, self.rank_bits, _COUNTS)]

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """About how often each hash occurs; hashes of one cell are counted together."""
        return np.rint(2 ** (self.ranks(hashes) / 8)).astype(np.int64) - 1

    def forget(self) -> None:
        """As TwiceFilter.forget."""
        self.first.forget()
        self.second.forget()
        vars(self.sent).pop("_value", None)

    def release(self) -> None:
        """Frees the broadcasts, once no job needs them any more."""
        self.first.release()
        self.second.release()
        self.sent.destroy()


def _build(df: DataFrame, hashes_of: Hashes, bits: int, probes: range, rank_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The packed filter of hashes seen again, and ranks of all hashes if rank_bits."""
    span, cell_span = 1 << (bits - 6), 1 << max(0, rank_bits - 6)

    def flush(held: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        if rank_bits:
            counts += np.bincount(cells(every, rank_bits, _COUNTS), minlength=1 << rank_bits).astype(np.uint32)
        at = np.concatenate([cells(every, bits, k) for k in probes])
        at.sort()
        new = np.ones(len(at), dtype=bool)
        new[1:] = at[1:] != at[:-1]
        once, again = at[new], np.unique(at[~new])
        one, two = (np.searchsorted(x, np.arange(SEGMENTS + 1) * span) for x in (once, again))
        return _rows([(s, _pack(once[one[s] : one[s + 1]] - s * span), _pack(again[two[s] : two[s + 1]] - s * span)) for s in range(SEGMENTS) if one[s + 1] > one[s]])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        counts, n = np.zeros(1 << rank_bits if rank_bits else 0, dtype=np.uint32), 0
        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    n = 0
                    yield flush(held, counts)
        if n:
            yield flush(held, counts)
        if rank_bits and counts.any():
            yield _rows([(SEGMENTS + s, zlib.compress(counts[s * cell_span : (s + 1) * cell_span].tobytes(), 1), b"") for s in range(SEGMENTS)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, again = -1, np.zeros(0, bool), np.zeros(0, bool)

        def done() -> pa.RecordBatch:
            if now < SEGMENTS:
                return _rows([(now, b"", zlib.compress(np.packbits(again, bitorder="little").tobytes(), 1))])
            return _rows([(now, b"", zlib.compress(np.minimum(255, np.floor(8 * np.log2(once + 1))).astype(np.uint8).tobytes(), 1))])

        for batch in batches:
            for s, o, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now >= 0:
                        yield done()
                    now = s
                    once, again = (np.zeros(span, dtype=bool), np.zeros(span, dtype=bool)) if s < SEGMENTS else (np.zeros(cell_span, dtype=np.int64), np.zeros(0, bool))
                if s < SEGMENTS:
                    at = _unpack(o)
                    again[at[once[at]]] = True
                    once[at] = True
                    again[_unpack(a)] = True
                else:
                    once += np.frombuffer(zlib.decompress(o), dtype=np.uint32)
        if now >= 0:
            yield done()

    packed, ranks = np.zeros(1 << (bits - 3), dtype=np.uint8), np.zeros(1 << rank_bits, dtype=np.uint8)
    merged = df.mapInArrow(send, _SCHEMA).repartition(mergers(df.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(merge, _SCHEMA)
    for segment, _, raw in merged.collect():
        part = np.frombuffer(zlib.decompress(bytes(raw)), dtype=np.uint8)
        into, k = (packed, segment) if segment < SEGMENTS else (ranks, segment - SEGMENTS)
        into[k * len(part) : (k + 1) * len(part)] = part
    return packed, ranks


def _bits(expected: int, per_hash: int, max_bits: int) -> int:
    return min(max_bits, max(16, int(np.ceil(np.log2(max(expected, 1) * per_hash)))))


def twice_filter(df: DataFrame, hashes_of: Hashes, expected: int, max_bits: int = MAX_BITS) -> TwiceFilter:
    """The filter over the arrays that hashes_of yields, one array of distinct hashes for each document.

    expected: about how many hashes all arrays hold; there are eight bits for each, but 2**max_bits at most. Beyond
    that more hashes pass by chance, which callers settle by an exact count.
    """
    bits = _bits(expected, 8, max_bits)
    return TwiceFilter(df.sparkSession, _build(df, hashes_of, bits, range(2))[0], bits, range(2))


def sift(df: DataFrame, hashes_of: Hashes, expected: int, max_bits: int = MAX_BITS, per_cell: int | None = None) -> Sifted:
    """Two passes over the table: hashes that pass the filter of the first are sifted again, and counted, in the
    second, where far fewer are left. A hash that two documents hold passes both. There are at least four bits for
    each hash up to 2**max_bits / 4 hashes; with more of them more pass by chance. The second filter is as
    large as the first, or has per_cell bits for each cell that the first has seen again, if that is less: there two
    hashes lie as a rule."""
    spark = df.sparkSession
    bits = _bits(expected, 4, max_bits)
    packed, _ = _build(df, hashes_of, bits, range(1))
    first = TwiceFilter(spark, packed, bits, range(1))
    left_bits = _bits(int(np.bitwise_count(packed).sum(dtype=np.int64)), per_cell, bits) if per_cell else bits

    def left(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for h in hashes_of(batch):
            yield h[first.test(h)]

    rank_bits = min(22, bits)
    packed, ranks = _build(df, left, left_bits, range(1, 2), rank_bits)
    return Sifted(spark, first, TwiceFilter(spark, packed, left_bits, range(1, 2)), ranks, rank_bits)
