"""Graphs as DataFrames: a DataFrame of subjects and objects for each predicate, tables seen as graphs, N-Triples.

A pattern with a constant predicate reads that predicate's DataFrame only. Over a table this is a projection of
two of its columns. Patterns with one subject that are read from one table are one projection of it, without a join,
and constants in them are compared with the table's own columns, so that they reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .terms import BNODE, IRI, LANG_STRING, LITERAL, RDF_TYPE, RDFS_LABEL, XSD, Term, iri, term, typed


@dataclass(frozen=True)
class Node:
    """The IRI of a row: a prefix and the key columns; null where one of them is null."""

    prefix: str
    key: tuple[str, ...]

    def column(self) -> Column:
        return iri(F.concat(F.lit(self.prefix), *(x for k, c in enumerate(self.key) for x in ([F.lit("-")] if k else []) + [F.col(f"`{c}`").cast("string")])))

    def equals(self, t: Term, rows: DataFrame) -> Column:
        rest = t.lex.removeprefix(self.prefix)
        if t.kind != IRI or not t.lex.startswith(self.prefix):
            return F.lit(False)
        kind = rows.schema[self.key[0]].dataType
        if len(self.key) == 1 and (isinstance(kind, StringType) or isinstance(kind, IntegralType) and _whole(rest)):
            return F.col(f"`{self.key[0]}`") == (rest if isinstance(kind, StringType) else int(rest))
        return self.column()["lex"] == t.lex


@dataclass(frozen=True)
class Value:
    """A column of a table as a literal, or a constant IRI."""

    name: str | None = None
    constant: str | None = None

    @property
    def key(self) -> tuple[str, ...]:
        return () if self.name is None else (self.name,)

    def column(self, rows: DataFrame) -> Column:
        return iri(F.lit(self.constant)) if self.name is None else typed(F.col(f"`{self.name}`"), rows.schema[self.name].dataType)

    def equals(self, t: Term, rows: DataFrame) -> Column:
        if self.name is None:
            return F.lit(t.kind == IRI and t.lex == self.constant)
        kind, value = rows.schema[self.name].dataType, self.column(rows)
        if isinstance(kind, StringType) and t.kind == LITERAL and t.dt == XSD + "string":
            return F.col(f"`{self.name}`") == t.lex
        if isinstance(kind, IntegralType) and t.kind == LITERAL and t.dt == XSD + "integer" and _whole(t.lex):
            return F.col(f"`{self.name}`") == int(t.lex)
        return (value["kind"] == t.kind) & (value["lex"] == t.lex) & value["dt"].eqNullSafe(F.lit(t.dt)) & value["lang"].eqNullSafe(F.lit(t.lang))


def _whole(text: str) -> bool:
    """Whether the text is how a long is written."""
    return re.fullmatch(r"0|-?[1-9]\d{0,17}", text) is not None


@dataclass(frozen=True)
class Place:
    """Where a table holds a predicate."""

    rows: DataFrame
    subject: Node
    object: Node | Value

    def object_column(self) -> Column:
        return self.object.column() if isinstance(self.object, Node) else self.object.column(self.rows)


@dataclass(frozen=True)
class Graph:
    """parts: for each predicate IRI a DataFrame (s, o). named: graphs by IRI; the default graph is the rest.
    places: for predicates of tables, by table, where it holds them. The nodes of two tables are never the same."""

    parts: Mapping[str, DataFrame]
    named: Mapping[str, Graph] = field(default_factory=dict)
    places: Mapping[str, Mapping[str, Place]] = field(default_factory=dict)

    def of(self, predicate: str) -> DataFrame | None:
        return self.parts.get(predicate)

    def triples(self, predicates: Iterable[str] | None = None, without: Iterable[str] = ()) -> DataFrame:
        """(s, p, o) of all predicates, of some, or of all but some; p is an IRI term."""
        names = [p for p in (self.parts if predicates is None else predicates) if p in self.parts and p not in set(without)]
        if not names:
            some = next(iter(self.parts.values()))
            return some.select("s", iri(F.lit("")).alias("p"), "o").limit(0)
        return reduce(DataFrame.unionByName, (self.parts[p].select("s", iri(F.lit(p)).alias("p"), "o") for p in names))

    def merge(self, other: Graph) -> Graph:
        """The union of the triples of two graphs."""
        both = dict(self.parts)
        for p, df in other.parts.items():
            both[p] = both[p].unionByName(df).distinct() if p in both else df
        alone = {**{p: x for p, x in self.places.items() if p not in other.parts}, **{p: x for p, x in other.places.items() if p not in self.parts}}
        return Graph(both, {**self.named, **other.named}, alone)

    def dataset(self, default: Iterable[str] = (), named: Iterable[str] = ()) -> Graph:
        """FROM and FROM NAMED: the default graph becomes the union of some named graphs, and some stay named."""
        base = reduce(Graph.merge, (Graph(self.named[g].parts, places=self.named[g].places) for g in default), Graph({}))
        return Graph(base.parts, {g: self.named[g] for g in named if g in self.named}, base.places)


@dataclass(frozen=True)
class TableMapping:
    """How a table is seen as a graph: a node for each row, a predicate for each column.

    key: columns of the node's IRI. links: predicates to the nodes of other tables, as column to (name, table).
    label: column of rdfs:label. Columns that are arrays, maps or structs are left out.
    """

    key: tuple[str, ...]
    links: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    label: str | None = None


def table_graph(tables: Mapping[str, DataFrame], mappings: Mapping[str, TableMapping], base: str = "http://t/") -> Graph:
    """The direct mapping of tables to a graph. Null values have no triple."""
    parts: dict[str, DataFrame] = {}
    places: dict[str, dict[str, Place]] = {}

    for name, m in mappings.items():
        df = tables[name]
        held = {RDF_TYPE: Value(constant=f"{base}class/{name}")}
        held |= {f"{base}{f.name}": Value(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")}
        held |= {f"{base}{link}": Node(f"{base}{target}/", (column,)) for column, (link, target) in m.links.items()}
        held |= {RDFS_LABEL: Value(m.label)} if m.label else {}
        for predicate, value in held.items():
            place = Place(df, Node(f"{base}{name}/", m.key), value)
            places.setdefault(predicate, {})[name] = place
            rows = not_null(df, *value.key, *m.key).select(place.subject.column().alias("s"), place.object_column().alias("o"))
            parts[predicate] = parts[predicate].unionByName(rows) if predicate in parts else rows
    return Graph(parts, places=places)


def not_null(rows: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda df, c: df.where(F.col(f"`{c}`").isNotNull()), dict.fromkeys(names), rows)


#: The star-schema and event tables as a graph.
STAR_SCHEMA = {
    "region": TableMapping(("r_regionkey",), label="r_name"),
    "nation": TableMapping(("n_nationkey",), {"n_regionkey": ("region", "region")}, "n_name"),
    "customer": TableMapping(("c_custkey",), {"c_nationkey": ("nation", "nation")}, "c_name"),
    "supplier": TableMapping(("s_suppkey",), {"s_nationkey": ("nation", "nation")}, "s_name"),
    "part": TableMapping(("p_partkey",), label="p_name"),
    "orders": TableMapping(("o_orderkey",), {"o_custkey": ("customer", "customer")}),
    "lineitem": TableMapping(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), {"l_orderkey": ("order", "orders"), "l_partkey": ("part", "part"), "l_suppkey": ("supplier", "supplier")}),
    "events": TableMapping(("event_id",), {"user_id": ("user", "customer")}),
}


def star_graph(spark: SparkSession, sf_dir: str, names: Iterable[str] = tuple(STAR_SCHEMA)) -> Graph:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return table_graph(tables, {n: STAR_SCHEMA[n] for n in tables})


_ESCAPES = (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'))
_NODE = r"(<[^>]*>|_:[^\s]+)"
_STATEMENT = rf'^\s*{_NODE}\s+<([^>]*)>\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9\-]+)?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$'


def _unescape(lex: Column) -> Column:
    out = F.replace(lex, F.lit("\\\\"), F.lit("\0"))
    for a, b in _ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(_code_points(out), F.lit("\0"), F.lit("\\"))


def _code_points(text: Column) -> Column:
    """The text with its \\uXXXX and \\UXXXXXXXX as the characters they stand for."""
    def one(x: Column) -> Column:
        n = F.when(x.startswith("\\U"), 8).otherwise(4)
        return F.concat(F.decode(F.unhex(F.lpad(F.substr(x, F.lit(3), n), 8, "0")), "UTF-32"), F.substr(x, n + 3))

    escape = r"\\(?:u[0-9A-Fa-f]{4}|U000[0-9A-Fa-f]{5}|U0010[0-9A-Fa-f]{4})"
    pieces = F.transform(F.split(text, f"(?={escape})"), lambda x: F.when(x.rlike(f"^{escape}"), one(x)).otherwise(x))
    return F.when(text.contains("\\u") | text.contains("\\U"), F.array_join(pieces, "")).otherwise(text)


def _parsed(text: Column) -> Column:
    """The term that a token of N-Triples stands for."""
    lex = _unescape(F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1))
    dt, lang = F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(text, r'"@([A-Za-z0-9\-]+)$', 1)
    kind = F.when(dt != "", dt).when(lang != "", LANG_STRING).otherwise(XSD + "string")
    return (
        F.when(text.startswith("<"), term(F.lit(IRI), _code_points(F.regexp_extract(text, "^<(.*)>$", 1))))
        .when(text.startswith("_:"), term(F.lit(BNODE), F.substring(text, 3, 1 << 20)))
        .otherwise(term(F.lit(LITERAL), lex, kind, F.when(lang != "", lang)))
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(g, s, p, o) of N-Triples or N-Quads files, without repeats; g is null in the default graph.

    Lines that are no statements (comments, blank lines, faulty ones) are left out; see read_ntriples_faults.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(_STATEMENT))
    part = lambda k: F.regexp_extract("value", _STATEMENT, k)
    return lines.select(F.when(part(4) != "", part(4)).alias("g"), _parsed(part(1)).alias("s"), part(2).alias("p"), _parsed(part(3)).alias("o")).distinct()


def read_ntriples_faults(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of N-Triples or N-Quads files that are neither statements nor comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(_STATEMENT) & ~F.col("value").rlike(r"^\s*(?:#.*)?$"))


def quads_graph(quads: DataFrame, predicates: Iterable[str], graphs: Iterable[str] = ()) -> Graph:
    """A graph over stored quads; predicates and named graphs are those a query names."""
    of = lambda rows: {p: rows.where(F.col("p") == p).select("s", "o") for p in predicates}
    return Graph(of(quads.where("g IS NULL")), {g: Graph(of(quads.where(F.col("g") == g))) for g in graphs})


def token(t: Column) -> Column:
    """A term as a token of N-Triples."""
    quoted = t["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    tail = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["dt"] == XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^<"), t["dt"], F.lit(">")))
    return F.when(t["kind"] == IRI, F.concat(F.lit("<"), t["lex"], F.lit(">"))).when(t["kind"] == BNODE, F.concat(F.lit("_:"), t["lex"])).otherwise(F.concat(F.lit('"'), quoted, F.lit('"'), tail))


def ntriples(triples: DataFrame) -> DataFrame:
    """(value) lines of N-Triples of (s, p, o), ready for write.text."""
    return triples.select(F.concat_ws(" ", token(F.col("s")), token(F.col("p")), token(F.col("o")), F.lit(".")).alias("value"))


def write_nquads(quads: DataFrame, path: str) -> None:
    """(g, s, p, o), p a term, as files of N-Quads: a folder for each graph, by its IRI, holds its quads only; those of the
    default graph lie in graph=default. A graph's quads are dealt to as many files as there are tasks."""
    graph = F.when(F.col("g").isNull(), F.lit("default")).otherwise(F.concat(F.lit("<"), "g", F.lit(">")))
    tail = F.when(F.col("g").isNull(), F.lit(".")).otherwise(F.concat(F.lit("<"), "g", F.lit("> .")))
    quads.select(F.concat_ws(" ", token(F.col("s")), token(F.col("p")), token(F.col("o")), tail).alias("value"), graph.alias("graph")).write.partitionBy("graph").text(path)
