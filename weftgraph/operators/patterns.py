"""Graph patterns over solutions: a DataFrame with a nullable TERM column for each variable.

A solution maps variables to terms and may leave some unbound. Two solutions are compatible if they agree on all
variables that both bind. Joins are equi-joins on variables that are bound for certain; a variable that may be
unbound splits the inputs into rows with and without it, so that no join needs an OR condition or a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import save
from ..sources.graph import Graph, not_null
from ..sources.terms import TERM, Term, iri

MOST_PRODUCT_ROWS = 100_000  # rows of the smaller side of a product at most
PRODUCT_ROWS = 4_000_000  # rows that a task of a product makes, about


@dataclass(frozen=True)
class Solutions:
    """df has a column for each variable; maybe: variables that some rows may leave unbound; generated: variables
    whose literals are a model's answers, to be compared by similarity."""

    df: DataFrame
    maybe: frozenset[str] = frozenset()
    generated: frozenset[str] = frozenset()
    thetas: dict[str, float] = field(default_factory=dict)

    @property
    def variables(self) -> list[str]:
        return self.df.columns

    def with_(self, df: DataFrame, maybe: Iterable[str] = ()) -> Solutions:
        left = {v for v in (*self.maybe, *maybe) if v in df.columns}
        return Solutions(df, frozenset(left), self.generated & set(df.columns), self.thetas)


def _both(a: Solutions, b: Solutions, df: DataFrame, maybe: Iterable[str]) -> Solutions:
    return Solutions(df, frozenset(v for v in maybe if v in df.columns), (a.generated | b.generated) & set(df.columns), {**b.thetas, **a.thetas})


def is_variable(x) -> bool:
    return isinstance(x, str) and x.startswith("?")


def match(graph: Graph, s, p, o, graph_name: str | None = None) -> Solutions:
    """A triple pattern. Variables are strings such as "?x", constants are Terms; p may be a string IRI.

    graph_name: an IRI reads that named graph (empty if there is none), a variable binds it to each in turn.
    """
    if graph_name is not None:
        if not is_variable(graph_name):
            if graph_name not in graph.named:
                return empty_like(match(graph, s, p, o))
            return match(graph.named[graph_name], s, p, o)
        each = []
        for name, g in graph.named.items():
            found = match(g, s, p, o)
            here = iri(F.lit(name))
            v = graph_name[1:]
            each.append(found.with_(found.df.where(F.col(v) == here) if v in found.df.columns else found.df.withColumn(v, here)))
        return reduce(union, each) if each else empty_like(match(graph, s, p, o))
    if not is_variable(p):
        name = p.lex if isinstance(p, Term) else p
        found = star(graph, (s, p, o))
        if found is not None:
            return found
        rows = graph.of(name)
        rows = graph.triples([]) if rows is None else rows
        places = [("s", s), ("o", o)]
    else:
        rows, places = graph.triples(), [("s", s), ("p", p), ("o", o)]
    seen: dict[str, str] = {}
    for column, x in places:
        if is_variable(x):
            if x in seen:
                rows = rows.where(F.col(seen[x]) == F.col(column))
            else:
                seen[x] = column
        else:
            # comparing the parts lets a filter reach the scan below a projection
            rows = rows.where((F.col(f"{column}.kind") == x.kind) & (F.col(f"{column}.lex") == x.lex) & (F.col(f"{column}.dt").eqNullSafe(F.lit(x.dt))) & (F.col(f"{column}.lang").eqNullSafe(F.lit(x.lang))))
    return Solutions(rows.select(*(F.col(c).alias(v[1:]) for v, c in seen.items())))


def star(graph: Graph, *patterns: Sequence) -> Solutions | None:
    """Patterns with one subject and constant predicates as one projection of the table that holds them all: each of
    its rows is a solution at most. None if no single table does."""
    subject = patterns[0][0]
    held = [graph.places.get(p.lex if isinstance(p, Term) else p, {}) for _, p, _ in patterns]
    tables = set.intersection(*map(set, held))
    if len(tables) != 1:
        return None
    places = [h[next(iter(tables))] for h in held]
    rows = not_null(places[0].rows, *places[0].subject.key, *(c for p in places for c in p.object.key))
    seen: dict[str, Column] = {}
    if is_variable(subject):
        seen[subject] = places[0].subject.column()
    else:
        rows = rows.where(places[0].subject.equals(subject, rows))
    for place, (_, _, o) in zip(places, patterns, strict=True):
        if not is_variable(o):
            rows = rows.where(place.object.equals(o, rows))
        elif o in seen:
            rows = rows.where(seen[o] == place.object_column())
        else:
            seen[o] = place.object_column()
    return Solutions(rows.select(*(c.alias(v[1:]) for v, c in seen.items())))


def bgp(graph: Graph, *patterns: Sequence, graph_name: str | None = None) -> Solutions:
    """A basic graph pattern: the join of its triple patterns; patterns that share no variable come last. Patterns
    of one subject that one table holds are not joined (see star)."""
    rest, todo = [], list(patterns)
    while todo:
        same = [x for x in todo if x[0] == todo[0][0] and not is_variable(x[1])] if graph_name is None and not is_variable(todo[0][1]) else []
        found = star(graph, *same) if len(same) > 1 else None
        rest.append(match(graph, *todo[0], graph_name=graph_name) if found is None else found)
        todo = todo[1:] if found is None else [x for x in todo if x not in same]
    out = rest.pop(0)
    while rest:
        k = next((k for k, m in enumerate(rest) if set(m.variables) & set(out.variables)), 0)
        out = join(out, rest.pop(k))
    return out


def empty_like(sol: Solutions) -> Solutions:
    return sol.with_(sol.df.limit(0))


def values(spark: SparkSession, variables: Sequence[str], rows: Sequence[Sequence[Term | None]]) -> Solutions:
    """Inline data; None is UNDEF."""
    names = [v.lstrip("?") for v in variables]
    if any(len(r) != len(names) for r in rows):
        raise ValueError("each row of VALUES needs a term for each variable")
    schema = T.StructType([T.StructField(n, TERM) for n in names])
    data = [tuple(None if t is None else (t.kind, t.lex, t.dt, t.lang) for t in r) for r in rows]
    maybe = {n for k, n in enumerate(names) if any(r[k] is None for r in rows)}
    return Solutions(spark.createDataFrame(data, schema), frozenset(maybe))


def shared(a: Solutions, b: Solutions) -> list[str]:
    return [v for v in a.variables if v in b.variables]


def _risky(a: Solutions, b: Solutions) -> str | None:
    return next((v for v in shared(a, b) if v in a.maybe or v in b.maybe), None)


def split_by(x: Solutions, v: str) -> tuple[Solutions, Solutions | None]:
    """Rows that bind v, and rows that do not, without the column; None if all rows bind it."""
    if v not in x.maybe:
        return x, None
    bound = Solutions(x.df.where(F.col(v).isNotNull()), x.maybe - {v}, x.generated, x.thetas)
    return bound, Solutions(x.df.where(F.col(v).isNull()).drop(v), x.maybe - {v}, x.generated - {v}, x.thetas)


def _named(x: Solutions, names: list[str]) -> Solutions:
    """x with all of names as columns, missing ones unbound."""
    missing = [n for n in names if n not in x.variables]
    return Solutions(x.df.select(*(F.col(n) if n in x.variables else F.lit(None).cast(TERM).alias(n) for n in names)), x.maybe | set(missing), x.generated, x.thetas)


def product(a: Solutions, b: Solutions, most: int = MOST_PRODUCT_ROWS) -> Solutions:
    """All pairs of rows; the smaller side is counted and must not exceed most rows. The other side is dealt out, so that
    no task makes more than PRODUCT_ROWS rows of many."""

    def dealt(rows: DataFrame, others: int) -> DataFrame:
        tasks = -(-rows.count() * others // PRODUCT_ROWS)
        return rows.repartition(tasks) if tasks > 1 else rows

    if (n := b.df.limit(most + 1).count()) <= most:
        df = dealt(a.df, n).crossJoin(F.broadcast(b.df))
    elif (n := a.df.limit(most + 1).count()) <= most:
        df = F.broadcast(a.df).crossJoin(dealt(b.df, n))
    else:
        raise ValueError(f"a product of two patterns with more than {most} rows each; join them by a variable")
    return _both(a, b, df, a.maybe | b.maybe)


def join(a: Solutions, b: Solutions) -> Solutions:
    """Compatible pairs, merged."""
    v = _risky(a, b)
    if v is None:
        on = shared(a, b)
        return _both(a, b, a.df.join(b.df, on), a.maybe | b.maybe) if on else product(a, b)
    names = a.variables + [n for n in b.variables if n not in a.variables]
    (a1, a0), (b1, b0) = split_by(a, v), split_by(b, v)
    parts = [join(a1, b1)]
    if a0:
        parts.append(join(a0, b1))
    if b0:
        parts.append(join(a1, b0))
    if a0 and b0:
        parts.append(_named(join(a0, b0), names))
    parts = [_named(p, names) for p in parts]
    return _both(a, b, reduce(DataFrame.unionByName, (p.df for p in parts)), frozenset().union(*(p.maybe for p in parts)))


def semi(a: Solutions, b: Solutions) -> Solutions:
    """Rows of a with a compatible row in b (EXISTS)."""
    v = _risky(a, b)
    if v is None:
        on = shared(a, b)
        return a.with_(a.df.join(b.df.select(*on), on, "left_semi") if on else a.df if b.df.limit(1).count() else a.df.limit(0))
    names = a.variables
    (a1, a0), (b1, b0) = split_by(a, v), split_by(b, v)
    parts = [semi(a1, b1)]
    if b0:
        parts.append(semi(anti(a1, b1), b0))
    if a0:
        parts.append(semi(a0, Solutions(b.df.drop(v), b.maybe - {v})))
    return a.with_(reduce(DataFrame.unionByName, (_named(p, names).df for p in parts)))


def anti(a: Solutions, b: Solutions) -> Solutions:
    """Rows of a without a compatible row in b (NOT EXISTS)."""
    v = _risky(a, b)
    if v is None:
        on = shared(a, b)
        return a.with_(a.df.join(b.df.select(*on), on, "left_anti") if on else a.df.limit(0) if b.df.limit(1).count() else a.df)
    names = a.variables
    (a1, a0), (b1, b0) = split_by(a, v), split_by(b, v)
    rest = anti(a1, b1)
    if b0:
        rest = anti(rest, b0)
    parts = [rest] + ([anti(a0, Solutions(b.df.drop(v), b.maybe - {v}))] if a0 else [])
    return a.with_(reduce(DataFrame.unionByName, (_named(p, names).df for p in parts)))


def minus(a: Solutions, b: Solutions) -> Solutions:
    """Rows of a without a compatible row in b that binds one of their variables (MINUS)."""
    on = shared(a, b)
    if not on:
        return a
    v = _risky(a, b)
    if v is None:
        return a.with_(a.df.join(b.df.select(*on), on, "left_anti"))
    names = a.variables
    (a1, a0), (b1, b0) = split_by(a, v), split_by(b, v)
    rest = anti(a1, b1)  # v is bound on both sides
    if b0:
        rest = minus(rest, b0)
    parts = [rest]
    if a0:
        parts.append(minus(a0, Solutions(b.df.drop(v), b.maybe - {v})))
    return a.with_(reduce(DataFrame.unionByName, (_named(p, names).df for p in parts)))


def optional(a: Solutions, b: Solutions, condition: Column | None = None) -> Solutions:
    """Left join (OPTIONAL); condition may use variables of both sides, and an error in it is no match."""
    new = [n for n in b.variables if n not in a.variables]
    if _risky(a, b) is None and shared(a, b) and condition is None:
        return _both(a, b, a.df.join(b.df, shared(a, b), "left"), a.maybe | b.maybe | set(new))
    tagged = a.with_(a.df.withColumn("__key", F.struct(*a.variables)))
    met = join(tagged, b)
    if condition is not None:
        met = met.with_(met.df.where(condition))
    # rows that are equal meet the same rows, so a row's terms stand for it
    key = met.df.select("__key").distinct()
    lone = tagged.df.join(key, tagged.df["__key"].eqNullSafe(key["__key"]), "left_anti").drop("__key")
    df = met.df.drop("__key").unionByName(lone, allowMissingColumns=True)
    return _both(a, b, df, met.maybe | a.maybe | set(new))


def union(a: Solutions, b: Solutions) -> Solutions:
    """All rows of both (UNION), as a bag."""
    names = a.variables + [n for n in b.variables if n not in a.variables]
    x, y = _named(a, names), _named(b, names)
    return _both(a, b, x.df.unionByName(y.df), x.maybe | y.maybe)


def where(a: Solutions, condition: Column) -> Solutions:
    """FILTER: an error counts as false."""
    return a.with_(a.df.where(condition))


def bind(a: Solutions, variable: str, value: Column) -> Solutions:
    """BIND: an error leaves the variable unbound."""
    v = variable.lstrip("?")
    if v in a.variables:
        raise ValueError(f"?{v} is bound already")
    return a.with_(a.df.withColumn(v, value), [v])


def project(a: Solutions, *variables: str) -> Solutions:
    return a.with_(a.df.select(*(v.lstrip("?") for v in variables)))


def distinct(a: Solutions) -> Solutions:
    return a.with_(a.df.distinct())


def reduced(a: Solutions) -> Solutions:
    """REDUCED permits the removal of repeats; none are removed."""
    return a


def sub_select(a: Solutions, *variables: str) -> Solutions:
    """A sub-query's result; its other variables are local, which the projection ensures."""
    return project(a, *variables)


def group(a: Solutions, by: Sequence[str], aggregates: dict[str, Column], having: Column | None = None) -> Solutions:
    """GROUP BY, aggregates and HAVING; without by all rows are one group, of no rows too."""
    names = [v.lstrip("?") for v in by]
    out = a.df.groupBy(*names).agg(*(c.alias(v.lstrip("?")) for v, c in aggregates.items()))
    return Solutions(out if having is None else out.where(having), frozenset({*aggregates} | (a.maybe & set(names))))


def order(a: Solutions, *keys: Column) -> Solutions:
    return a.with_(a.df.orderBy(*keys))


def cut(a: Solutions, limit: int | None = None, offset: int = 0) -> Solutions:
    """LIMIT and OFFSET."""
    df = a.df.offset(offset) if offset else a.df
    return a.with_(df if limit is None else df.limit(limit))


def ask(a: Solutions) -> DataFrame:
    """(result) of one row: whether there is a solution."""
    return a.df.limit(1).agg((F.count("*") > 0).alias("result"))


def _templated(a: Solutions, templates: Sequence[Sequence]) -> DataFrame:
    """A row of terms for each template and solution. A template's "_:name" is a new blank node for each different
    solution."""
    rows = a.df.withColumn("__row", F.sha2(F.to_json(F.struct(*a.variables)) if a.variables else F.lit(""), 256))

    def value(x) -> Column:
        if x is None:
            return F.lit(None).cast(TERM)
        if is_variable(x):
            return F.col(x[1:])
        if isinstance(x, Term):
            return x.column()
        return F.struct(F.lit(1).cast("tinyint").alias("kind"), F.concat(F.lit(x[2:] + "-"), "__row").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))

    return reduce(DataFrame.unionByName, (rows.select(*(value(x).alias(n) for n, x in zip("spog", t, strict=False))) for t in templates))


def construct(a: Solutions, *template: Sequence) -> DataFrame:
    """(s, p, o) of the template's triples for each solution, without repeats; triples with an unbound or an
    impossible term are left out. A template's "_:name" is a new blank node for each different solution."""
    return _templated(a, template).where("s.kind IN (0, 1) AND p.kind = 0 AND o IS NOT NULL").distinct()


def construct_quads(a: Solutions, *template: Sequence) -> DataFrame:
    """(g, s, p, o) of templates (s, p, o, graph) as of construct; graph is None for the default graph, whose g is null,
    and else an IRI or a variable. Quads whose graph is unbound or no IRI are left out."""
    named = [t for t in template if t[3] is not None]
    plain = [t for t in template if t[3] is None]
    found = [_templated(a, x).where("s.kind IN (0, 1) AND p.kind = 0 AND o IS NOT NULL" + (" AND g.kind = 0" if x is named else "")) for x in (named, plain) if x]
    return reduce(DataFrame.unionByName, (x.select(F.col("g.lex").alias("g"), "s", "p", "o") for x in found)).distinct()


def describe(graph: Graph, resources: DataFrame) -> DataFrame:
    """(s, p, o) of the resources (s) and of all blank nodes that their triples lead to, step by step; what a step
    finds is written, so that the next one starts from there."""
    every = graph.triples()
    here = every.join(resources.select("s").distinct(), "s", "left_semi")
    found = here = save(here, "described")
    while True:
        todo = here.where("o.kind = 1").select(F.col("o").alias("s")).distinct().join(found.select("s").distinct(), "s", "left_anti")
        here = save(every.join(todo, "s", "left_semi"), "described")
        if not here.limit(1).count():
            return found.select("s", "p", "o").distinct()
        found = found.unionByName(here)


def native(a: Solutions, /, **columns: Column) -> DataFrame:
    """Plain Spark columns of a result."""
    return a.df.select(*(c.alias(n) for n, c in columns.items()))


def each_group(parts: Iterable[Solutions], how: Callable = union) -> Solutions:
    return reduce(how, parts)
