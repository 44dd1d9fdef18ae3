"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of ten consecutive benchmark words (or a whole item that is shorter). The search looks at
the block of two words that ends at a position. A shift table tells how far the next possible end of a pattern
is from there, so that most words are never looked at. Where the shift is none, the block's bucket holds the
patterns that end with it, by their first word, and the whole window is compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Shared, map_columns, packed, unpacked
from .staging import Staging

#: ASCII bytes outside words become spaces, A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
BLOCK_WORDS = 2_000_000  # benchmark words that one pass over the documents searches for


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Patterns:
    """Patterns of one length in words, with their shift table and suffix buckets."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.items: dict[tuple, set] = {}

    def build(self) -> Patterns:
        m, b = self.length, self.block
        self.most = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[bytes, list]] = {}
        for pattern, items in self.items.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                if m - end < self.shift.get(key, self.most):
                    self.shift[key] = m - end
            self.buckets.setdefault(pattern[-b:], {}).setdefault(pattern[0], []).append((list(pattern), tuple(items)))
        return self

    def search(self, words: list[bytes], hit: set[int], items: set) -> None:
        m, b, most, shift, buckets = self.length, self.block, self.most, self.shift.get, self.buckets
        at, n = m, len(words)  # a window ends before at
        while at <= n:
            key = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
            step = shift(key, most)
            if step:
                at += step
                continue
            for pattern, owners in buckets[key].get(words[at - m], ()):
                if words[at - m : at] == pattern:
                    hit.update(range(at - m, at))
                    items.update(owners)
            at += 1


def build(rows: list[tuple[int, str]], window: int = 10) -> list[Patterns]:
    """Tables for the items (id, text) of one block, one for each length of pattern. Null ids are left out."""
    by_length: dict[int, Patterns] = {}
    for item, text in rows:
        words = words_of(text)
        size = min(window, len(words))
        if not size or item is None:
            continue
        p = by_length.setdefault(size, Patterns(size))
        for i in range(len(words) - size + 1):
            p.items.setdefault(tuple(words[i : i + size]), set()).add(item)
    return [p.build() for p in by_length.values()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of a bounded number of words; one block is on the driver at a time."""
    block, n = [], 0
    for item, text in benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        size = len(words_of(text))
        if block and n + size > block_words:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += size
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns keep (all by default) of each row of docs, and n_words, hits (places of the words inside
    occurrences, sorted) and items (sorted ids of the items that occur, of any type that has an order; items with a null
    id are not searched for).

    The benchmark is searched for in blocks of block_words, one pass over the documents each, so that what is
    broadcast is bounded. Null texts have no words and no hits; repeated rows are searched each; an empty
    benchmark hits nothing. Columns named n_words, hits or items are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits", "items")]
    ids = f"array<{benchmark.schema[item_col].dataType.simpleString()}>"
    rows = docs.select(packed(keep), F.col(f"`{text_col}`").alias("__text"), F.array().cast("array<int>").alias("hits"), F.array().cast(ids).alias("items"))

    def scan(df: DataFrame, tables, keep: list[str]) -> DataFrame:
        def search(columns: list[pa.Array]) -> list[list]:
            out: list[list] = [[], [], []]
            for text, hits, items in zip(*(c.to_pylist() for c in columns), strict=True):
                words, hit, found = words_of(text), set(hits), set(items)
                for p in tables.value:
                    p.search(words, hit, found)
                for c, x in zip(out, (len(words), sorted(hit), sorted(found)), strict=True):
                    c.append(x)
            return out

        return map_columns(df, [F.col("__text"), F.col("hits"), F.col("items")], search, f"n_words long, hits array<int>, items {ids}", keep)

    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    block, staging, k = next(blocks), Staging(spark), 0
    for following in blocks:
        rows = staging.save(scan(rows, Shared(spark, build(block, window)), ["__row", "__text"]), f"block{k}")
        block, k = following, k + 1
    return unpacked(scan(rows, Shared(spark, build(block, window)), ["__row"]), keep, ["n_words", "hits", "items"])


def report(found: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
