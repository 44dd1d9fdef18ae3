"""Results as files: JSON lines of bindings, and one JSON document for a small result."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.patterns import Solutions


def binding(t: Column) -> Column:
    """A term as the result formats write it; null if unbound."""
    kind = F.when(t["kind"] == 0, "uri").when(t["kind"] == 1, "bnode").otherwise("literal")
    plain = "http://www.w3.org/2001/XMLSchema#string"
    typed = F.when((t["kind"] == 2) & t["lang"].isNull() & (t["dt"] != plain), t["dt"])
    return F.when(t.isNotNull(), F.struct(kind.alias("type"), t["lex"].alias("value"), typed.alias("datatype"), t["lang"].alias("xml:lang")))


def json_lines(sol: Solutions) -> DataFrame:
    """(value): a JSON object of bindings for each solution, ready for write.text; unbound variables are absent."""
    return sol.df.select(F.to_json(F.struct(*(binding(F.col(v)).alias(v) for v in sol.variables))).alias("value"))


def json_document(sol: Solutions, most: int = 100_000) -> str:
    """The result as one document, for results of a bounded size; more rows are an error."""
    rows = [r[0] for r in json_lines(sol).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} solutions; write json_lines instead")
    return json.dumps({"head": {"vars": sol.variables}, "results": {"bindings": [json.loads(r) for r in rows]}}, ensure_ascii=False)
