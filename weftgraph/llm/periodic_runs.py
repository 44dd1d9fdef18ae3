"""Periodic runs: stretches of words that repeat with a period, found by seeds on diagonals and their extension.

A run with smallest period q and at least max(least, 2q) words has max(least - q, q) or more consecutive places where
the word q further on is the same. So it holds a seed: a gram of SEED words that occurs again q words later. Grams of a
text are indexed, occurrence pairs of equal grams enumerated, and each is extended both ways along its diagonal (its
lag); a table of how far each lag is covered keeps other pairs of the same stretch from being extended again.

Not all pairs are needed: q places in a row hold a multiple of q - SEED + 1 from which a seed still fits, so that of a
lag only pairs that begin there count. Over all lags these are n log n pairs at most, however often a gram occurs. They
are taken from the index where its pairs are fewer, else from the lags; either way they are the same ones. Pairs whose
lag is a multiple of the period of a run that holds both lie on a diagonal that ends with that run, and are left out.
Of the lags that have one stretch the least is its period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import packed, unpacked
from .staging import small_batches

LEAST = 12  # words of a run
BLOCK = 256  # words that an extension compares first; each next step twice as many
_U = np.uint64
_FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def seed_words(least: int) -> int:
    """The least number of places in a row, over all periods, that agree with those a period on."""
    return (least + 1) // 2


def _ranks(words: list) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def seed_pairs(ranks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place), sorted, of the pairs of equal grams of size words that begin at a multiple of lag - size + 1."""
    none = np.zeros(0, dtype=np.int64)
    n = len(ranks) - size + 1
    if n < 2:
        return none, none
    gram = np.zeros(n, dtype=_U)
    for k in range(size):  # 64-bit hashes; a pair of different grams would be found out by its extension
        gram = (gram ^ (gram >> _U(29))) * _U(0xBF58476D1CE4E5B9) + ranks[k : k + n].astype(_U)
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(new, n))
    if len(new) == n:
        return none, none
    widest = len(ranks) // 2  # a run has two periods at least
    if int((count * (count - 1) // 2).sum()) <= n * max(1, n.bit_length()):
        lags, places = [], []
        # the other occurrence is 1, 2, .. further on in the index, as long as it is of the same gram
        group_end = np.repeat(np.append(new[1:], n), count)
        at = np.arange(n)
        for step in range(1, int(count.max())):
            at = at[at + step < group_end[at]]
            i = order[at]
            lag = order[at + step] - i
            some = (i % np.maximum(1, lag - size + 1) == 0) & (lag <= widest)
            lags.append(lag[some])
            places.append(i[some])
        lag, place = np.concatenate(lags), np.concatenate(places)
    else:
        lags, places = [], []
        for d in range(1, min(widest, n - 1) + 1):
            i = np.arange(0, n - d, max(1, d - size + 1))
            i = i[gram[i] == gram[i + d]]
            if len(i):
                lags.append(np.full(len(i), d, dtype=np.int64))
                places.append(i)
        lag, place = (np.concatenate(lags), np.concatenate(places)) if lags else (none, none)
    by = np.lexsort((place, lag))
    return lag[by], place[by]


def _extent(ranks: np.ndarray, i: int, lag: int) -> tuple[int, int]:
    """The longest stretch of places around i where the word lag further on is the same."""
    low, high, step = i, i, BLOCK
    while high < len(ranks) - lag:
        stop = min(high + step, len(ranks) - lag)
        same = ranks[high:stop] == ranks[high + lag : stop + lag]
        if not same.all():
            high += int(same.argmin())
            break
        high, step = stop, 2 * step
    step = BLOCK
    while low > 0:
        stop = max(0, low - step)
        same = ranks[stop:low] == ranks[stop + lag : low + lag]
        if not same.all():
            low -= int(same[::-1].argmin())
            break
        low, step = stop, 2 * step
    return low, high


def find_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, 2 * period) words, by start, then period."""
    if len(words) < least:
        return []
    ranks = _ranks(words)
    lags, places = seed_pairs(ranks, seed_words(least))
    if not len(lags):
        return []
    found: dict[tuple[int, int], int] = {}
    end_of, period_of = np.zeros(len(ranks), dtype=np.int64), np.ones(len(ranks), dtype=np.int64)  # of a run that holds a place, the one that ends last
    begins = np.flatnonzero(np.append(True, lags[1:] != lags[:-1]))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(lags)], strict=True):
        now = int(lags[a])
        at = places[a:b]
        at = at[~((end_of[at] > at + now) & (now % period_of[at] == 0))]
        k = 0
        while k < len(at):
            low, high = _extent(ranks, int(at[k]), now)  # the diagonal is covered up to high
            start, stop = low, high + now
            if stop - start >= max(least, 2 * now) and found.setdefault((start, stop), now) == now:
                part = end_of[start:stop]
                later = part < stop
                part[later] = stop
                period_of[start:stop][later] = now
            k += max(1, int(np.searchsorted(at[k:], high)))
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period do not."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """The columns keep (all by default) of each row, with n_words, runs (start in words, length, period; by start, then
    period) and collapsed: the words that stay, joined by single spaces.

    Words are runs without ASCII white space and are the same if their bytes are. A run is a stretch of at least
    max(least, 2 * period) words of whole text, that no neighbour extends; its period is the smallest. A null, empty or
    blank text has no words, no runs and an empty collapsed text. Repeated rows have equal results; an empty table gives
    an empty one. Columns named n_words, runs or collapsed are replaced.
    """
    small_batches(docs.sparkSession)
    new = StructType.fromDDL(_FIELDS)
    names = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    picked = docs.select(packed(names), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                runs = find_runs(words, least)
                if runs:
                    stay = kept_words(len(words), runs)
                    texts.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
                else:
                    texts.append(b" ".join(words))
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["__row", *new.names])

    return unpacked(picked.mapInArrow(run, StructType([picked.schema["__row"], *new.fields])), names, new.names)
