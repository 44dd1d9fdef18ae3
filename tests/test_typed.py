"""Aggregates that keep types, and quads by graph."""

import os

from pyspark.sql.types import StructField, StructType

from weftgraph.functions import scalar as fn
from weftgraph.operators import patterns as P
from weftgraph.sources.graph import read_ntriples, write_nquads
from weftgraph.sources.terms import TERM, XSD, Iri, Lit


def test_sums_and_means_by_type(spark):
    number = lambda x, kind: (2, x, XSD + kind, None)
    groups = {
        "int": [number("9007199254740993", "integer"), number("9007199254740993", "long"), None],
        "dec": [number("1", "integer"), number("0.50", "decimal")], "dbl": [number("1", "integer"), number("0.5", "decimal"), number("1e0", "double")],
        "bad": [number("1", "integer"), number("x", "string")], "odd": [number("one", "integer")], "none": [None], "ten": [number("4", "integer"), number("6", "integer")],
    }
    rows = [((2, g, XSD + "string", None), x) for g, xs in groups.items() for x in xs]
    sol = P.Solutions(spark.createDataFrame(rows, StructType([StructField("g", TERM), StructField("x", TERM)])).repartition(3))
    out = {r["g"]["lex"]: (r["s"] and (r["s"]["lex"], r["s"]["dt"][len(XSD) :]), r["m"] and (r["m"]["lex"], r["m"]["dt"][len(XSD) :])) for r in P.group(sol, ["g"], {"s": fn.total("?x"), "m": fn.mean("?x")}).df.collect()}
    assert out["int"] == (("18014398509481986", "integer"), ("9007199254740993", "decimal"))
    assert out["dec"] == (("1.5", "decimal"), ("0.75", "decimal")) and out["dbl"][0] == ("2.5", "double") and out["dbl"][1][1] == "double"
    assert out["bad"] == out["odd"] == (None, None) and out["none"] == (("0", "integer"), ("0", "integer")) and out["ten"] == (("10", "integer"), ("5", "decimal"))


def test_quads_lie_in_their_graphs_folder(spark, tmp_path):
    sol = P.values(spark, ["?s", "?g", "?o"], [[Iri("http://s/1"), Iri("http://g/a b?"), Lit('x "y"\n')], [Iri("http://s/2"), Iri("http://g/b"), Lit(3)], [Iri("http://s/3"), Lit("no"), Lit(1)], [Iri("http://s/4"), None, Lit(1)]])
    quads = P.construct_quads(sol, ("?s", Iri("http://p"), "?o", "?g"), ("?s", Iri("http://q"), "_:b", Iri("http://g/b")), ("?s", Iri("http://r"), "?o", None))
    assert quads.count() == 2 + 4 + 4
    write_nquads(quads, str(tmp_path / "q"))
    back = read_ntriples(spark, str(tmp_path / "q"))
    key = lambda r: (r["g"], tuple(r["s"]), r["p"] if isinstance(r["p"], str) else r["p"]["lex"], tuple(r["o"]))
    assert sorted(map(repr, map(key, back.collect()))) == sorted(map(repr, map(key, quads.collect())))
    folders = [d for d in os.listdir(tmp_path / "q") if d.startswith("graph=")]
    assert len(folders) == 3
    for d in folders:
        assert len({r["g"] for r in read_ntriples(spark, str(tmp_path / "q" / d)).collect()}) == 1


def test_json_values_keep_their_types(spark):
    from weftgraph.functions.gen import parse_json_term

    raw = '{"a": {"b": [1, 2.5, true, "x y", null, {"c": [1]}, 12345678901234567890, 1e3]}}'
    want = [("1", "integer"), ("2.5", "double"), ("true", "boolean"), ("x y", "string"), ("", "string"), ('{"c":[1]}', "string"), ("12345678901234567890", "integer"), ("1000.0", "double")]
    df = spark.createDataFrame([(raw,), ("no json",), (None,)], "raw string")
    from pyspark.sql import functions as F

    for k, (lex, kind) in enumerate(want):
        rows = df.select(parse_json_term(F.col("raw"), f"a.b[{k}]").alias("t")).collect()
        assert [(r["t"]["lex"], r["t"]["dt"][len(XSD) :]) for r in rows] == [(lex, kind), ("", "string"), ("", "string")]
