"""Vector code compression: product quantization of integer vectors, exact in all its arithmetic.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own, which starts as
parts of the first vectors and is moved by rounds of assignment and floor means. Nearest entries come from matrix
products: |x|^2 - 2 x.c + |c|^2, where the integers of x and c are broken into limbs so small that no float64 product
or sum of them leaves the exact range of 2^53; the products of limbs are recombined in int64, and the first of the
least distances wins. Tasks add up counts and sums of each entry's parts and send these alone; codebooks, a fixed
number of integers, are all that passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import packed, unpacked
from .staging import Staging

ENTRIES = 64
PARTS = 16
ROUNDS = 2
SCALE = 256
LARGEST = (1 << 27) - 1  # integers beyond are taken for this, so that distances of up to 64 components fit a long
FEW_LABELS = 100_000  # sums of so many labels are broadcast; those of more are joined by a shuffle
_SUMS = "part int, entry int, n bigint, sums array<bigint>"


def limb_bits(width: int) -> int:
    """Bits of a limb such that the sum of width products of two limbs is exact in float64."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs: x = limbs[0] + limbs[1] * 2**bits + ..; all but the last are not negative."""
    out, low = [], (1 << bits) - 1
    while x.size and (x.max() > low or x.min() < -low):
        out.append((x & low).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices, exactly, by float64 matrix products of their limbs."""
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    right = limbs(c, bits)
    for i, p in enumerate(limbs(x, bits)):
        for j, q in enumerate(right):
            out += (p @ q.T).astype(np.int64) << (bits * (i + j))
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of its nearest entry of book, the first of equally near ones, and the distance."""
    far = (book * book).sum(axis=1)[None, :] - 2 * exact_products(x, book)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best] + (x * x).sum(axis=1)


def integers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that can be coded (width components, all finite), and floor(scale * x) of them."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    flat = pc.list_flatten(vectors.take(pa.array(rows))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)  # null: nan
    whole = np.isfinite(flat).all(axis=1)
    return rows[whole], np.clip(np.floor(flat[whole] * scale), -LARGEST, LARGEST).astype(np.int64)


class Codebooks:
    """books[part] has a row of integers for each entry, the same number of entries for each part."""

    def __init__(self, books: np.ndarray, scale: int):
        self.books, self.scale = books, scale
        self.parts, self.entries, self.size = books.shape

    @property
    def width(self) -> int:
        return self.parts * self.size

    def digest(self) -> str:
        """sha256 of all integers, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of each part of each row, and distances."""
        parts = x.reshape(len(x), self.parts, self.size)
        both = [assign(np.ascontiguousarray(parts[:, p]), self.books[p]) for p in range(self.parts)]
        return np.stack([b[0] for b in both], axis=1), np.stack([b[1] for b in both], axis=1)


def first_codebooks(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks | None:
    """From the vectors with the smallest ids; rows of one id by their vectors. None if no vector can be coded."""
    whole = vectors.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0))
    first = whole.where("id IS NOT NULL").orderBy("id", "v").limit(entries).collect() or whole.orderBy("v").limit(1).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    _, x = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width, scale)
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, width // parts).transpose(1, 0, 2)), scale)


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floor mean of the parts that are nearest to it; an entry without parts stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((books.parts, books.entries), dtype=np.int64)
        total = np.zeros(books.books.shape, dtype=np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), books.width, books.scale)
            if not len(x):
                continue
            code, _ = books.codes(x)
            parts = x.reshape(len(x), books.parts, books.size)
            for p in range(books.parts):
                n[p] += np.bincount(code[:, p], minlength=books.entries)
                for k in range(books.size):  # a batch's sums are exact in float64
                    total[p, :, k] += np.bincount(code[:, p], weights=parts[:, p, k], minlength=books.entries).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e]), "sums": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    each = vectors.select("v").mapInArrow(sums, _SUMS)
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(books.size)))
    new = books.books.copy()
    for r in added.collect():  # parts * entries rows at most
        new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(books.size)]
    return Codebooks(new, books.scale)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, Codebooks | None]:
    """The columns keep (all but the vector by default) of each row that can be coded, with code (two hex digits for
    each part) and error (long, squared distances summed over parts), and the codebooks.

    Left out are rows whose vector is null, empty or has a null or non-finite component, or not as many components as
    that of the smallest id. Repeated ids count as often as they occur; a null id starts no codebook while there are
    others, but is coded. With fewer than entries vectors there are as many entries as vectors; an empty table gives an
    empty result and no codebooks. Components beyond LARGEST / scale are taken for that. Columns named code or error
    are replaced.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name up to 256 entries")
    names = [c for c in (vectors.columns if keep is None else keep) if c not in ("code", "error") and (keep is not None or c != vector_col)]
    rows = vectors.select(packed(names), F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    books = first_codebooks(rows.select("id", "v"), parts, entries, scale)
    if books is not None:
        for _ in range(rounds):
            books = moved(rows, books)
    picked = rows.select("__row", "v")
    schema = StructType([*picked.schema.fields[:1], *StructType.fromDDL("code string, error bigint").fields])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if books is None:
                continue
            at, x = integers(batch.column(1), books.width, books.scale)
            if len(at):
                entry, far = books.codes(x)
                flat = entry.astype(np.uint8).tobytes().hex()
                n = 2 * books.parts
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([flat[i : i + n] for i in range(0, len(flat), n)]), pa.array(far.sum(axis=1))], names=["__row", "code", "error"])

    coded = picked.mapInArrow(code, schema)
    return unpacked(coded, names, ["code", "error"]), books


def decode(code: str, books: Codebooks) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books.books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def with_label_error(coded: DataFrame, staging: Staging, label_col: str = "label") -> DataFrame:
    """coded with label_error: error summed over rows with an equal label, null ones together. A column of that name
    is replaced."""
    names = [c for c in coded.columns if c != "label_error"]
    rows = staging.save(coded.select(packed(names), F.col(f"`{label_col}`").alias("label"), "error"), "codes")
    sums = staging.save(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return unpacked(rows.join(sums, F.col("label").eqNullSafe(F.col("of"))), names, ["label_error"])
