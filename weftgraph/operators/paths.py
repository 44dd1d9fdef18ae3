"""Property paths as DataFrames of pairs (s, o)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import save
from ..sources.graph import Graph
from .patterns import Solutions, is_variable


def step(graph: Graph, predicate: str) -> DataFrame:
    found = graph.of(predicate)
    return (graph.triples([]) if found is None else found).select("s", "o")


def inverse(path: DataFrame) -> DataFrame:
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(*paths: DataFrame) -> DataFrame:
    """s/t: pairs that a middle node connects, as often as it does."""
    return reduce(lambda a, b: a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o"), paths)


def alternative(*paths: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, paths)


def negated(graph: Graph, forward: Sequence[str] = (), backward: Sequence[str] | None = None) -> DataFrame:
    """Pairs of any predicate but some; backward: of any inverse but some, None for no inverses at all."""
    parts = [graph.triples(without=forward).select("s", "o")] if forward or backward is None else []
    if backward is not None:
        parts.append(inverse(graph.triples(without=backward)))
    return alternative(*parts)


def nodes(graph: Graph) -> DataFrame:
    every = graph.triples()
    return every.select(F.col("s").alias("n")).unionByName(every.select(F.col("o").alias("n"))).distinct()


def zero_or_one(path: DataFrame, all_nodes: DataFrame) -> DataFrame:
    return all_nodes.select(F.col("n").alias("s"), F.col("n").alias("o")).unionByName(path).distinct()


def one_or_more(path: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Pairs that one or more steps connect, without repeats. starts: only from these nodes (s).

    Each round joins the newest pairs only, and written tables cut the lineage.
    """
    path = save(path.distinct(), "path")
    new = save(path if starts is None else path.join(starts.select("s").distinct(), "s", "left_semi"), "reach")
    parts = [new]
    while new.limit(1).count():
        known = reduce(DataFrame.unionByName, parts)
        new = save(sequence(new, path).distinct().join(known, ["s", "o"], "left_anti"), "reach")
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def zero_or_more(path: DataFrame, all_nodes: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    begin = all_nodes if starts is None else starts.select(F.col("s").alias("n")).distinct()
    return begin.select(F.col("n").alias("s"), F.col("n").alias("o")).unionByName(one_or_more(path, starts)).distinct()


def solutions(path: DataFrame, s, o) -> Solutions:
    """A path pattern's solutions; s and o are variables or Terms."""
    rows, names = path, {}
    for column, x in (("s", s), ("o", o)):
        if not is_variable(x):
            rows = rows.where(F.col(column) == x.column())
        elif x in names:
            rows = rows.where(F.col(names[x]) == F.col(column))
        else:
            names[x] = column
    return Solutions(rows.select(*(F.col(c).alias(v[1:]) for v, c in names.items())))
