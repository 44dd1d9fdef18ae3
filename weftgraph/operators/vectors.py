"""Exact search by cosine in an index of vectors on disk, for any number of queries at once.

Vectors are made unit vectors and dealt to cells by their nearest pivot; a cell's vectors lie in blocks by their distance
from the pivot. Of unit vectors the distance grows as the cosine falls, so that by the triangle inequality a query meets
only those cells, and in them blocks, whose distances from the pivot differ from its own by no more than its radius. For
the k nearest the radius follows from the counts and the reach of cells. Queries lie in blocks of the same kind; blocks of
both sides meet in an equi-join on the cell, and a pair of blocks is one matrix product. So the index is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import shared_dir

MOST_CELLS = 1024  # pivots are broadcast: so many vectors at most
BLOCK = 512  # vectors of a block
_DISTANCES = 1 << 19  # distances from pivots that a task holds at once
_SLACK = 1e-6  # of distances, for rounding


@dataclass
class VectorIndex:
    """blocks: (cell, low, high, ids, vs) on disk, partitioned by cell; low and high bound the distances from the cell's
    pivot, vs has the unit vectors one after the other. reach, depth and counts: of each cell the greatest and the least
    distance, and how many vectors it has."""

    blocks: DataFrame
    id_type: str
    pivots: np.ndarray
    depth: np.ndarray
    reach: np.ndarray
    counts: np.ndarray

    @property
    def width(self) -> int:
        return self.pivots.shape[1]


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with a vector that has a direction, and their unit vectors."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == width)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    with np.errstate(all="ignore"):
        most = np.abs(x).max(axis=1, initial=0)
        x = x / most[:, None]  # so that no square is too large or too small
        length = np.sqrt((x * x).sum(axis=1))
        some = np.isfinite(most) & (most > 0) & np.isfinite(length)
        return rows[some], x[some] / length[some, None]


def _rows(x: np.ndarray) -> pa.Array:
    """Vectors as a column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


def _blocks(rows: DataFrame, name: str, kind: str, extra: bool, size: int) -> DataFrame:
    """Rows (cell, d, name, v[, r]) sorted by cell and distance, as blocks of at most size rows."""
    fields = f"cell int, low double, high double, {name}s array<{kind}>, vs array<double>" + (", radius double, rs array<double>" if extra else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cells = t["cell"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            cut = [j for a, b in zip(cut[:-1], cut[1:], strict=True) for j in range(a, b, size)] + [len(cells)]
            lists = pa.array(cut, pa.int32())
            d, one = t["d"].to_numpy(), lambda c: pa.ListArray.from_arrays(lists, t[c].combine_chunks())
            flat = t["v"].combine_chunks()
            width = len(flat.flatten()) // max(1, len(flat))
            columns = {"cell": pa.array(cells[cut[:-1]], pa.int32()), "low": pa.array(np.minimum.reduceat(d, cut[:-1])), "high": pa.array(np.maximum.reduceat(d, cut[:-1])), f"{name}s": one(name), "vs": pa.ListArray.from_arrays(pa.array([c * width for c in cut], pa.int32()), flat.flatten())}
            if extra:
                columns |= {"radius": pa.array(np.maximum.reduceat(t["r"].to_numpy(), cut[:-1])), "rs": one("r")}
            return pa.RecordBatch.from_pydict(columns)

        n = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 8 * size:
                yield out()
                n = 0
        if held:
            yield out()

    return rows.sortWithinPartitions("cell", "d").mapInArrow(pack, fields)


def build_index(vectors: DataFrame, path: str | None = None, cells: int | None = None, block: int = BLOCK) -> VectorIndex | None:
    """An index of vectors (id, v) in a folder, by default one of the shared folder. Null vectors, those without a
    direction (zero, not finite) and those of another width than the first pivot's are left out. None if none is left."""
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n = rows.count()
    if not n:
        return None
    cells = min(MOST_CELLS, max(1, int(n**0.5) // 4)) if cells is None else cells
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("v"), "v").select("v").limit(cells).collect()]
    width = len(drawn[0])
    _, pivots = _unit(pa.array([v for v in drawn if len(v) == width], pa.list_(pa.float64())), width)
    sent = spark.sparkContext.broadcast(pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            at, x = _unit(batch.column(1), pivots.shape[1])
            step = max(1, _DISTANCES // len(pivots))
            for i in range(0, len(at), step):
                part = x[i : i + step]
                d = _apart(part, pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "d": pa.array(d[np.arange(len(part)), cell]), "id": batch.column(0).take(pa.array(at[i : i + step])), "v": _rows(part)})

    placed = rows.mapInArrow(assign, f"cell int, d double, id {kind}, v array<double>")
    path = path or f"{shared_dir(spark)}/weft-index-{uuid.uuid4().hex}"
    _blocks(placed.repartitionByRange("cell", "d"), "id", kind, False, block).write.partitionBy("cell").parquet(path)
    blocks = spark.read.schema(f"low double, high double, ids array<{kind}>, vs array<double>, cell int").parquet(path)
    depth, reach, counts = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), dtype=np.int64)
    for r in blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.size("ids")).alias("n")).collect():  # a row for each cell
        depth[r["cell"]], reach[r["cell"]], counts[r["cell"]] = r["low"], r["high"], r["n"]
    return VectorIndex(blocks, kind, pivots, depth, reach, counts)


def search(queries: DataFrame, index: VectorIndex | None, k: int | None = 1, theta: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(q, id, similarity): the k nearest vectors of the index by cosine, cut to 0 and 1, of each of queries (q, v), if at
    least theta; ties go to the smaller id. k of None takes all that reach theta. Exact. Null and zero vectors, and those
    of another width than the index, match nothing."""
    spark: SparkSession = queries.sparkSession
    kind = queries.schema["q"].dataType.simpleString()
    if index is None:
        return queries.select("q", F.col("q").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
    sent = spark.sparkContext.broadcast((index.pivots, index.depth, index.reach, index.counts))
    far = 2.0 if theta <= 0 else float(np.sqrt(max(0.0, 2 - 2 * theta)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, depth, reach, counts = sent.value
        for batch in batches:
            at, x = _unit(batch.column(1), pivots.shape[1])
            step = max(1, _DISTANCES // max(len(pivots), pivots.size // 16))  # a query's vector goes to each cell
            for i in range(0, len(at), step):
                part = x[i : i + step]
                d = _apart(part, pivots)
                r = np.full(len(part), far)
                if k is not None:  # so many vectors are no further away than this
                    most = np.where(counts > 0, d + reach, np.inf)
                    order = np.argsort(most, axis=1)
                    enough = np.cumsum(counts[order], axis=1) >= k
                    bound = np.take_along_axis(most, order, axis=1)[np.arange(len(part)), enough.argmax(axis=1)]
                    bound = np.where(enough.any(axis=1) & (bound + _SLACK < np.sqrt(2)), bound, 2.0)  # all negative cosines are 0
                    r = np.minimum(r, bound)
                r = r + _SLACK
                q, c = np.nonzero((counts > 0) & (d - reach <= r[:, None]) & (depth - d <= r[:, None]))
                yield pa.RecordBatch.from_pydict({"cell": pa.array(c, pa.int32()), "d": pa.array(d[q, c]), "q": batch.column(0).take(pa.array(at[i + q])), "v": _rows(part[q]), "r": pa.array(r[q])})

    asked = queries.select("q", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL").mapInArrow(spread, f"cell int, d double, q {kind}, v array<double>, r double")
    asked = _blocks(asked.repartitionByRange("cell", "d"), "q", kind, True, block).withColumnsRenamed({"low": "q_low", "high": "q_high", "vs": "q_vs"})
    near = (F.col("low") <= F.col("q_high") + F.col("radius")) & (F.col("high") >= F.col("q_low") - F.col("radius"))
    pairs = asked.join(index.blocks, "cell").where(near).select("qs", "q_vs", "rs", "ids", "vs")
    width = index.width

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                qs, q_vs, _, ids, vs = (batch.column(c)[j].values for c in range(5))
                score = np.clip(q_vs.to_numpy().reshape(-1, width) @ vs.to_numpy().reshape(-1, width).T, 0.0, 1.0)
                least = theta if k is None else np.maximum(theta, np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids)), None])
                q, i = np.nonzero(score >= least)
                if len(q):
                    yield pa.RecordBatch.from_pydict({"q": qs.take(pa.array(q)), "id": ids.take(pa.array(i)), "similarity": pa.array(score[q, i])})

    found = pairs.mapInArrow(products, f"q {kind}, id {index.id_type}, similarity double")
    if k is None:
        return found
    place = F.row_number().over(W.partitionBy("q").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")
