"""N-gram Jaccard join: documents that share most of their word shingles, by rare-first prefix filtering.

A pair of Bloom filters, built in two passes over the texts, tells which shingles another document may hold. Shingles
are ordered rare first: those that no other document holds, then the others by a sketch of their document frequency;
any order that all documents share is right, a rough one costs time only. Sets that link share a shingle of the
shorter one's index prefix and the longer one's probe prefix, so only shingles of prefixes are joined, and of these
only those that others may hold: documents with too many shingles of their own have none left. Candidates pass length
and positional filters in the join and a suffix filter (a lower bound of the number of hashes in which two sets
differ), and are counted once a pair. Equal sets are one class from the start, and their copies are never expanded
into pairs. Shingles are compared by 64-bit hashes, which are taken for the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SPACES, chunks, digest, shingles
from .set_links import odd_sketch, set_components
from .sketch import sift
from .staging import Staging, small_batches

SALTS = 8  # parts that the rows of one component are dealt out in
_PROFILE = "row long, n_shingles long, id binary, m int, toks array<struct<tok: bigint, pos: int>>, odd array<bigint>, hashes array<bigint>"
_TOKS = pa.list_(pa.struct([("tok", pa.int64()), ("pos", pa.int32())]))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for c in chunks(column):
        starts, ends, bounds = c.spans(~SPACES)
        yield from shingles(c.hashes(starts, ends), bounds, k)


def ngram_components(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for each row of docs. doc_id has the
    type of id_col, which may be any that has an order.

    Words are runs without white space, A-Z in lower case; a text of fewer than k words has one shingle, and one
    without words (null, empty) has none and links with nothing. Rows with equal texts are in one component,
    repeated rows of one doc_id too. A null doc_id stays null unless its row links with another; then it gets the
    component's smallest. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    staging = Staging(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    texts = docs.select("text")
    words = (texts.select(F.sum(F.length("text")).alias("n")).first()[0] or 0) // 6  # about how many
    known = sift(texts, lambda batch: shingle_sets(batch.column(0), k), words, per_cell=8)

    def profile(column: pa.Array) -> list[pa.Array]:
        n, ids, m, toks, odd, hashes = [], [], [], [], [], []
        for u in shingle_sets(column, k):
            others = u[known.test(u)]
            alone, prefix = len(u) - len(others), len(u) - -(-percent * len(u) // 100) + 1
            some = len(u) > 0 and alone < prefix
            if some:
                order = np.lexsort((others, known.ranks(others)))[: prefix - alone]
                toks.append([{"tok": t, "pos": p} for p, t in enumerate(others[order].view(np.int64).tolist(), alone)])
            else:
                toks.append(None)
            n.append(len(u))
            m.append(len(others))
            ids.append(bytes.fromhex(digest(u)) if some else None)
            odd.append(odd_sketch(u) if some else None)
            hashes.append(u.view(np.int64) if some else None)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(m, pa.int32()), pa.array(toks, _TOKS), pa.array(odd, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))]

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *profile(batch.column(1))], names=["doc_id", "n_shingles", "id", "m", "toks", "odd", "hashes"])
        known.forget()

    rows = staging.save(docs.mapInArrow(run, _PROFILE.replace("row long", f"doc_id {kind}")), "profile")
    known.release()
    some = rows.where("id IS NOT NULL")
    members = staging.save(some.select("id", F.col("n_shingles").cast("int").alias("n"), "m", "toks", "odd").dropDuplicates(["id"]), "members")
    comps = set_components(members, some.select("id", "hashes"), staging, percent)
    staging.drop(members)
    # the least doc_id of each set, of each component, and of each set again: copies are not gathered
    least = some.groupBy("id").agg(F.min("doc_id").alias("least")).join(comps, "id", "left").withColumn("c", F.coalesce("component", "id"))
    least = staging.save(least.select("id", "c", "least"), "least")
    parts = least.groupBy("c").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda name: F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")
    of_set = least.select("id", "c", salt("id").alias("salt")).join(parts, ["c", "salt"]).select("id", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = some.select("doc_id", "n_shingles", "id", salt("doc_id").alias("salt")).join(of_set, ["id", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
