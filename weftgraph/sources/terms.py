"""RDF terms as Spark structs: kind (0 IRI, 1 blank node, 2 literal), lex, dt, lang. A null struct is unbound."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
LABEL_PROPERTIES = (RDFS_LABEL, "http://www.w3.org/2004/02/skos/core#prefLabel", "http://schema.org/name", "https://schema.org/name", "http://xmlns.com/foaf/0.1/name")
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
INTEGERS = tuple(XSD + n for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger"))
NUMERICS = (*INTEGERS, XSD + "decimal", XSD + "double", XSD + "float")
IRI, BNODE, LITERAL = 0, 1, 2

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])


@dataclass(frozen=True)
class Term:
    """A constant term."""

    kind: int
    lex: str
    dt: str | None = None
    lang: str | None = None

    def column(self) -> Column:
        return term(F.lit(self.kind), F.lit(self.lex), F.lit(self.dt), F.lit(self.lang))


def Iri(lex: str) -> Term:  # noqa: N802
    return Term(IRI, lex)


def Lit(value, lang: str | None = None) -> Term:  # noqa: N802
    """A literal of a Python value: bool, int, float or str."""
    if isinstance(value, bool):
        return Term(LITERAL, str(value).lower(), XSD + "boolean")
    if isinstance(value, int):
        return Term(LITERAL, str(value), XSD + "integer")
    if isinstance(value, float):
        return Term(LITERAL, repr(value), XSD + "double")
    return Term(LITERAL, str(value), LANG_STRING if lang else XSD + "string", lang)


def term(kind: Column, lex: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(lex.isNotNull(), F.struct(kind.cast("tinyint").alias("kind"), lex.cast("string").alias("lex"), (none if dt is None else dt.cast("string")).alias("dt"), (none if lang is None else lang.cast("string")).alias("lang")))


def iri(lex: Column) -> Column:
    return term(F.lit(IRI), lex)


def bnode(lex: Column) -> Column:
    return term(F.lit(BNODE), lex)


def literal(value: Column, dt: str = XSD + "string", lang: Column | None = None) -> Column:
    return term(F.lit(LITERAL), value.cast("string"), F.lit(dt), lang)


def typed(value: Column, kind: T.DataType) -> Column:
    """A literal of a column of that Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return literal(value, XSD + "integer")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return literal(value, XSD + "double")
    if isinstance(kind, T.DecimalType):
        return literal(value, XSD + "decimal")
    if isinstance(kind, T.BooleanType):
        return literal(value, XSD + "boolean")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return literal(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    if isinstance(kind, T.DateType):
        return literal(value, XSD + "date")
    return literal(value)
