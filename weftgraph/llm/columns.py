"""New columns computed from Arrow batches, beside the columns that a table has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .staging import small_batches


def map_columns(df: DataFrame, inputs: list[Column], make: Callable[[list[pa.Array]], list], fields: str, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default; those with a name in fields are replaced) and what make returns.

    make gets the input columns of a batch and returns a list of values or arrays for each of fields, one value
    a row. It may be run again for the same rows and must give the same values then.
    """
    small_batches(df.sparkSession)
    new = _parse_datatype_string(fields)
    assert isinstance(new, StructType)
    names = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    df, names, back = set_aside(df, names, lambda c: "." in c)
    prefix = "__in"
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    picked = df.select(*(F.col(f"`{c}`") for c in names), *(c.alias(f"{prefix}{k}") for k, c in enumerate(inputs)))
    n = len(names)
    schema = StructType([*picked.schema.fields[:n], *new.fields])
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(make(batch.columns[n:]), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *out], names=[*names, *arrow.names])

    return back(picked.mapInArrow(run, schema))


def packed(names: list[str]) -> Column:
    """The columns as one, __row, so that no name of theirs meets one of an operator's own."""
    return F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])).alias("__row")


def unpacked(df: DataFrame, names: list[str], new: list[str]) -> DataFrame:
    return df.select(*(F.col("__row")[c].alias(c) for c in names), *new)


def set_aside(df: DataFrame, keep: list[str], reserved: Callable[[str], bool] = lambda c: c.startswith("__") or "." in c) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with copies, under names that no operator uses, of the columns of keep whose names are reserved; the names to
    keep instead; and what gives a result their own names back. Nothing changes where no name is reserved."""
    aside = {c: f"kept column {k}" for k, c in enumerate(keep) if reserved(c)}
    if not aside:
        return df, keep, lambda out: out
    back = {v: c for c, v in aside.items()}
    return df.withColumns({v: F.col(f"`{c}`") for c, v in aside.items()}), [aside.get(c, c) for c in keep], lambda out: out.withColumnsRenamed(back)


class Shared:
    """A broadcast of any object, its class included: workers need no copy of this package. Loaded once a task."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.loaded = None

    def release(self) -> None:
        """Frees it on all machines, once no job needs it any more."""
        self.sent.destroy()

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "loaded": None}

    @property
    def value(self):
        if self.loaded is None:
            self.loaded = cloudpickle.loads(self.sent.value)
        return self.loaded
