"""Line dedup: lines that several documents hold stay in one of them only.

First a pair of Bloom filters is built from 64-bit hashes of line keys: one of keys seen once, one of keys seen
again in another document. Only keys that pass the second filter are shuffled, with their text, for an exact
count of documents and for the choice of the document that keeps the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SPACES, Chunk, chunks
from .columns import map_columns, packed
from .sketch import twice_filter
from .staging import Staging, small_batches

_BREAK = np.zeros(256, dtype=bool)
_BREAK[10] = True
_SPACE = "\t\n\x0b\x0c\r "
_LOWER = {c: c + 32 for c in range(65, 91)}
SALTS = 8  # parts that the documents with one line are dealt out in


def line_key(line: str) -> str:
    return line.strip(_SPACE).translate(_LOWER)


def _keys(c: Chunk, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends, hashes and texts (by number) of the keys with at least min_chars characters."""
    w_starts, w_ends, _ = c.spans(~SPACES)
    if not len(w_starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    breaks = np.flatnonzero(_BREAK[c.data])
    edges = np.unique(np.concatenate([c.offsets[:-1], breaks + 1, c.offsets[-1:]]))  # each line begins at one
    first, last = np.searchsorted(w_starts, edges[:-1]), np.searchsorted(w_starts, edges[1:])
    full = last > first
    starts, ends = w_starts[first[full]], w_ends[last[full] - 1]
    points = c.code_points()
    long = points[ends] - points[starts] >= min_chars
    starts, ends = starts[long], ends[long]
    return starts, ends, c.hashes(starts, ends), np.searchsorted(c.offsets, starts, "right") - 1


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the text's repeated lines taken out, and n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least min_chars
    characters that at least min_docs different doc_ids hold lose all their lines except in the largest doc_id.
    Rows of one doc_id count as one document and keep or lose a line together; null is a doc_id of its own and
    the smallest. A null text counts as one empty line and becomes an empty text. n_lines and n_dropped replace
    columns of these names. doc_ids may be of any type that has an order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    thin = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for c in chunks(batch.column(0)):
            _, _, h, text = _keys(c, min_chars)
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield h[new]

    size = thin.select(F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= min_chars))).alias("n")).first()[0] or 0
    again = twice_filter(thin.select("text"), hashes, size + 1)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                starts, ends, h, text = _keys(c, min_chars)
                at = np.flatnonzero(again.test(h))
                if not len(at):
                    continue
                seen = {(t, c.data[a:b].tobytes().lower()) for t, a, b in zip(text[at].tolist(), starts[at].tolist(), ends[at].tolist(), strict=True)}
                rows, keys = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r + c.first for r in rows])), pa.array([k.decode() for k in keys], pa.string())], names=["doc_id", "key"])
        again.forget()

    held = staging.save(thin.mapInArrow(suspects, f"doc_id {kind}, key string").distinct(), "held")
    again.release()
    repeated = held.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    repeated = repeated.select("key", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    drops = salted.join(repeated, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("__keys"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    whole = docs.select(packed(columns), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    joined = whole.join(drops, F.col("__id").eqNullSafe(F.col("__doc")), "left").drop("__doc", "__id")

    def without(columns: list[pa.Array]) -> list[list]:
        out: list[list] = [[], [], []]
        for text, keys in zip(*(c.to_pylist() for c in columns), strict=True):
            lines = (text or "").split("\n")
            gone = set(keys or ())
            kept = [x for x in lines if line_key(x) not in gone] if gone else lines
            for c, v in zip(out, ("\n".join(kept), len(lines), len(lines) - len(kept)), strict=True):
                c.append(v)
        return out

    out = map_columns(joined, [F.col("__text"), F.col("__keys")], without, "text string, n_lines long, n_dropped long", ["__row"])
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
