"""Registered queries of the library itself, over the star-schema and event tables seen as a graph, each with SQL
that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gen
from ..functions import scalar as fn
from ..operators import paths
from ..operators import patterns as P
from ..operators import similarity as S
from ..operators.embed import LetterCounts, compared, embed_texts
from ..operators.generate import Echo, Mock, Options, candidate_labels, generate, ground
from ..sources.graph import Graph, ntriples, quads_graph, read_ntriples, star_graph, write_nquads
from ..sources.results import json_lines
from ..sources.terms import RDF_TYPE, RDFS_LABEL, XSD, Iri, Lit, iri, literal
from ..sources.turtle import read_turtle, turtle_text, write_turtle
from . import cost
from .staging import shared_dir

B = "http://t/"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    """Registers a function under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lexed(sol: P.Solutions, /, *variables: str, **numbers) -> DataFrame:
    """Variables as text, and more columns by expression."""
    return P.native(sol, **{v: F.col(f"{v}.lex") for v in variables}, **numbers)


def num(v: str):
    return F.col(f"{v}.lex").cast("double")


def long(v: str):
    return F.col(f"{v}.lex").cast("long")


# --- files -----------------------------------------------------------------------------------------------------


@query("SELECT 'http://t/customer/' || c_custkey AS c, c_name AS name, c_acctbal AS bal, c_nationkey AS home, upper(c_mktsegment) AS first, lower(c_mktsegment) AS second FROM customer")
def turtle_source(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as Turtle, with prefixes, blank nodes, lists and strings over lines, read back."""
    quoted = lambda c: F.concat(F.lit('"""'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"""'))
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    text = turtle_text(
        F.concat(F.lit("c:"), "c_custkey"), ("a", F.lit("t:Customer")), ("rdfs:label", quoted(F.col("c_name"))), ("t:about", F.concat(F.lit('"""one line .\n@prefix t: <http://other/> .\n'), "c_mktsegment", F.lit('"""@en'))),
        ("t:bal", F.format_string("%.2fE0", F.col("c_acctbal"))), ("t:home", F.concat(F.lit("[ t:nation "), "c_nationkey", F.lit(" ]"))), ("t:segments", F.concat(F.lit("( "), quoted(F.upper("c_mktsegment")), F.lit("\n "), quoted(F.lower("c_mktsegment")), F.lit(" )"))),
    )
    path = f"{shared_dir(spark)}/turtle-{uuid.uuid4().hex}"
    write_turtle(rows.select(text), path, {"c": B + "customer/", "t": B, "rdfs": RDFS_LABEL[: -len("label")]})
    rdf = RDF_TYPE[: -len("type")]
    g = quads_graph(read_turtle(spark, path).quads, [RDFS_LABEL, B + "bal", B + "home", B + "nation", B + "segments", rdf + "first", rdf + "rest"])
    s = P.bgp(g, ("?c", RDFS_LABEL, "?name"), ("?c", B + "bal", "?bal"), ("?c", B + "home", "?h"), ("?h", B + "nation", "?home"), ("?c", B + "segments", "?l"), ("?l", rdf + "first", "?first"), ("?l", rdf + "rest", "?m"), ("?m", rdf + "first", "?second"), ("?m", rdf + "rest", Iri(rdf + "nil")))
    return lexed(s, "c", "name", "first", "second", bal=num("bal"), home=F.col("home.lex").cast("int"))


@query("SELECT 'http://g/' || lower(c_mktsegment) AS g, 'http://t/customer/' || c_custkey AS s, c_name AS o FROM customer UNION ALL SELECT NULL, 'http://t/customer/' || c_custkey, 'http://t/nation/' || c_nationkey FROM customer")
def nquads_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Customers constructed into a graph for each segment, written by graph and read back."""
    g = star_graph(spark, sf, ["customer"])
    s = P.bgp(g, ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_mktsegment", "?m"), ("?c", B + "nation", "?n"))
    s = P.bind(s, "?g", iri(F.concat(F.lit("http://g/"), F.lower("m.lex"))))
    path = f"{shared_dir(spark)}/quads-{uuid.uuid4().hex}"
    write_nquads(P.construct_quads(s, ("?c", Iri(RDFS_LABEL), "?name", "?g"), ("?c", Iri(B + "nation"), "?n", None)), path)
    return read_ntriples(spark, path).select("g", F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


# --- scans and joins -------------------------------------------------------------------------------------------


@query("SELECT 'http://t/customer/' || c_custkey AS c, c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'")
def bgp_star(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer"])
    s = P.bgp(g, ("?c", B + "c_mktsegment", Lit("BUILDING")), ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_acctbal", "?b"))
    return lexed(s, "c", "name", bal=num("b"))


@query("SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def bgp_join_fk(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "nation"])
    s = P.group(P.bgp(g, ("?c", B + "nation", "?x"), ("?x", B + "n_name", "?n")), ["n"], {"k": F.count("*")})
    return P.native(s, n=F.col("n.lex"), k=F.col("k"))


@query("SELECT r_name AS r, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def bgp_chain_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["orders", "customer", "nation", "region"])
    s = P.bgp(g, ("?o", B + "o_totalprice", "?t"), ("?o", B + "customer", "?c"), ("?c", B + "nation", "?n"), ("?n", B + "region", "?x"), ("?x", B + "r_name", "?r"))
    s = P.group(s, ["r"], {"orders": F.count("*"), "total": F.sum(fn.number("?t"))})
    return P.native(s, r=F.col("r.lex"), orders=F.col("orders"), total=F.col("total"))


@query("SELECT 'http://t/n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT 'http://t/n_nationkey', count(*) FROM nation UNION ALL SELECT 'http://t/n_regionkey', count(*) FROM nation UNION ALL SELECT 'http://t/region', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#label', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM nation")
def bgp_var_predicate(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["nation"]), "?s", "?p", "?o")
    return P.native(P.group(s, ["p"], {"n": F.count("*")}), p=F.col("p.lex"), n=F.col("n"))


@query("SELECT 'http://t/part/' || p_partkey AS p FROM part WHERE p_partkey = p_size")
def repeated_var(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["part"])
    return lexed(P.bgp(g, ("?p", B + "p_partkey", "?k"), ("?p", B + "p_size", "?k")), "p")


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def values_join(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation", "region"])
    s = P.join(P.bgp(g, ("?x", B + "region", "?y"), ("?x", B + "n_name", "?n"), ("?y", B + "r_name", "?r")), P.values(spark, ["?r"], [[Lit("ASIA")], [Lit("EUROPE")]]))
    return lexed(s, "n", "r")


@query("SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (VALUES ('ASIA', NULL), (NULL, 'NATION_7'), ('AFRICA', 'NATION_10')) v(vr, vn) ON (vr IS NULL OR vr = r_name) AND (vn IS NULL OR vn = n_name)")
def values_undef(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation", "region"])
    s = P.bgp(g, ("?x", B + "region", "?y"), ("?x", B + "n_name", "?n"), ("?y", B + "r_name", "?r"))
    v = P.values(spark, ["?r", "?n"], [[Lit("ASIA"), None], [None, Lit("NATION_7")], [Lit("AFRICA"), Lit("NATION_10")]])
    return lexed(P.join(s, v), "n", "r")


def _two_graphs(spark: SparkSession, sf: str) -> Graph:
    customers, suppliers = star_graph(spark, sf, ["customer"]), star_graph(spark, sf, ["supplier"])
    return Graph(star_graph(spark, sf, ["nation"]).parts, {"http://g/c": customers, "http://g/s": suppliers})


@query("SELECT s_name AS name FROM supplier")
def named_graph_const(spark: SparkSession, sf: str) -> DataFrame:
    return lexed(P.match(_two_graphs(spark, sf), "?s", RDFS_LABEL, "?name", "http://g/s"), "name")


@query("SELECT 'http://g/c' AS g, n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 'http://g/s', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def named_graph_var(spark: SparkSession, sf: str) -> DataFrame:
    g = _two_graphs(spark, sf)
    s = P.join(P.match(g, "?s", B + "nation", "?x", "?g"), P.match(g, "?x", B + "n_name", "?n"))
    s = P.group(s, ["g", "n"], {"k": F.count("*")})
    return P.native(s, g=F.col("g.lex"), n=F.col("n.lex"), k=F.col("k"))


@query("SELECT count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier)")
def from_named_graphs(spark: SparkSession, sf: str) -> DataFrame:
    g = _two_graphs(spark, sf).dataset(["http://g/c", "http://g/s"])
    return P.native(P.group(P.match(g, "?s", RDFS_LABEL, "?n"), [], {"n": F.count("*")}), n=F.col("n"))


# --- filters ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS st, CAST(sum(CAST(o_custkey AS HUGEINT) * 100000000000000) AS VARCHAR) AS ints, round(avg(o_custkey), 6) AS mean, round(sum(o_totalprice), 2) AS dbl, CASE WHEN min(o_orderkey % 3) < 2 THEN 'decimal' ELSE 'integer' END AS kind, CAST(sum(CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_custkey AS DECIMAL(38,2)) + 0.25 ELSE o_custkey END) AS DOUBLE) AS mixed FROM orders GROUP BY o_orderstatus")
def group_sum_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of integers beyond 2^53, of doubles, and of integers among decimals keep their types."""
    g = star_graph(spark, sf, ["orders"])
    s = P.bgp(g, ("?o", B + "o_orderstatus", "?st"), ("?o", B + "o_custkey", "?k"), ("?o", B + "o_totalprice", "?t"), ("?o", B + "o_orderkey", "?n"))
    s = P.bind(s, "?big", literal(F.concat("k.lex", F.lit("00000000000000")), XSD + "integer"))
    s = P.bind(s, "?mix", F.when(long("n") % 3 < 2, literal(F.concat("k.lex", F.lit(".25")), XSD + "decimal")).otherwise(F.col("k")))
    s = P.group(s, ["st"], {"ints": fn.total("?big"), "mean": fn.mean("?k"), "dbl": fn.total("?t"), "mixed": fn.total("?mix")})
    exact = F.when(F.col("ints.dt") == XSD + "integer", F.col("ints.lex"))
    return P.native(s, st=F.col("st.lex"), ints=exact, mean=F.round(F.when(F.col("mean.dt") == XSD + "decimal", num("mean")), 6), dbl=F.round(F.when(F.col("dbl.dt") == XSD + "double", num("dbl")), 2), kind=F.substring_index("mixed.dt", "#", -1), mixed=num("mixed"))


@query("SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 7500")
def filter_numeric(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_acctbal", "?b"))
    s = P.where(s, (fn.number("?b") > 5000) & ~(fn.number("?b") > 7500))
    return lexed(s, "name", bal=num("b"))


@query("SELECT p_name AS name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*e')")
def filter_regex(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["part"]), "?p", RDFS_LABEL, "?name")
    return lexed(P.where(s, fn.regex(fn.lex("?name"), "^[a-m].*e", "i")), "name")


@query("SELECT n_name AS n FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["nation"]), ("?x", B + "n_name", "?n"), ("?x", B + "n_regionkey", "?k"))
    return lexed(P.where(s, fn.is_in("?k", Lit(1.0).column(), Lit(3).column())), "n")


@query("SELECT c_name AS name FROM customer WHERE c_acctbal < 0")
def filter_error_3vl(spark: SparkSession, sf: str) -> DataFrame:
    """An error or true is true, an error and true is an error: names are no numbers, so the first test is one."""
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_acctbal", "?b"))
    s = P.where(s, (fn.number("?name") > 0) | (fn.number("?b") < 0))
    return lexed(P.where(s, ~((fn.number("?name") > 0) & (fn.number("?b") > 0))), "name")


# --- optional, union, minus, exists, bind, sub-select ----------------------------------------------------------


@query("SELECT c_name AS name, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def optional_left(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "orders"])
    s = P.optional(P.match(g, "?c", RDFS_LABEL, "?name"), P.bgp(g, ("?x", B + "customer", "?c"), ("?x", B + "o_orderkey", "?o")))
    return lexed(s, "name", o=long("o"))


@query("SELECT c_name AS name, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20")
def optional_filter_inside(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "orders"])
    a = P.bgp(g, ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_acctbal", "?b"))
    b = P.bgp(g, ("?x", B + "customer", "?c"), ("?x", B + "o_orderkey", "?o"), ("?x", B + "o_totalprice", "?t"))
    return lexed(P.optional(a, b, fn.number("?t") > fn.number("?b") * 20), "name", o=long("o"))


@query("SELECT c.c_name AS name, s.s_name AS peer, n.n_name AS n FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1 LEFT JOIN supplier s ON (n.n_nationkey IS NULL OR n.n_nationkey = s.s_nationkey) AND s.s_acctbal > 9000 AND c.c_acctbal > 9500 WHERE c.c_acctbal > 9500 AND s.s_name IS NOT NULL")
def optional_unbound_join(spark: SparkSession, sf: str) -> DataFrame:
    """A variable that an OPTIONAL leaves unbound joins with anything."""
    g = star_graph(spark, sf, ["customer", "nation", "supplier"])
    a = P.where(P.bgp(g, ("?c", RDFS_LABEL, "?name"), ("?c", B + "c_acctbal", "?b")), fn.number("?b") > 9500)
    some = P.bgp(g, ("?c", B + "nation", "?x"), ("?x", B + "n_regionkey", Lit(1)))
    # ?n hangs on ?x, so that it is looked up before the join, which makes rows of each two where ?x is unbound
    left = P.optional(a, P.join(some, P.match(g, "?x", B + "n_name", "?n")))
    peers = P.where(P.bgp(g, ("?s", B + "nation", "?x"), ("?s", B + "s_name", "?peer"), ("?s", B + "s_acctbal", "?q")), fn.number("?q") > 9000)
    both = P.join(left, P.project(peers, "x", "peer"))
    return lexed(both, "name", "peer", "n")


@query("SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_name FROM supplier UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 0")
def union_bag(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "supplier"])
    a = P.where(P.bgp(g, ("?c", B + "c_name", "?name"), ("?c", B + "c_acctbal", "?b")), fn.number("?b") > 9000)
    b = P.match(g, "?s", B + "s_name", "?name")
    d = P.where(P.bgp(g, ("?s", B + "s_name", "?name"), ("?s", B + "s_acctbal", "?b")), fn.number("?b") > 0)
    return lexed(P.each_group([a, b, d]), "name")


@query("SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def minus_shared(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation", "supplier"])
    poor = P.where(P.bgp(g, ("?s", B + "nation", "?x"), ("?s", B + "s_acctbal", "?b")), fn.number("?b") < 0)
    return lexed(P.minus(P.match(g, "?x", B + "n_name", "?n"), poor), "n")


@query("SELECT n_name AS n FROM nation")
def minus_nothing_shared(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation", "region"])
    return lexed(P.minus(P.match(g, "?x", B + "n_name", "?n"), P.match(g, "?y", B + "r_name", "?r")), "n")


@query("SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "orders"])
    return lexed(P.semi(P.match(g, "?c", RDFS_LABEL, "?name"), P.bgp(g, ("?o", B + "customer", "?c"), ("?o", B + "o_orderstatus", Lit("P")))), "name")


@query("SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "orders"])
    return lexed(P.anti(P.match(g, "?c", RDFS_LABEL, "?name"), P.bgp(g, ("?o", B + "customer", "?c"), ("?o", B + "o_orderstatus", Lit("P")))), "name")


@query("SELECT 'http://t/lineitem/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS l, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def bind_expr(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["lineitem"]), ("?l", B + "l_extendedprice", "?e"), ("?l", B + "l_discount", "?d"))
    return lexed(s, "l", net=num("e") * (1 - num("d")))


@query("SELECT n_name AS n, k FROM nation JOIN (SELECT c_nationkey AS x, count(*) AS k FROM customer GROUP BY 1) ON x = n_nationkey WHERE k > 5")
def subselect_local(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "nation"])
    inner = P.group(P.match(g, "?s", B + "nation", "?x"), ["x"], {"k": F.count("*")}, F.col("k") > 5)
    s = P.join(P.match(g, "?x", B + "n_name", "?n"), P.sub_select(inner, "x", "k"))
    return P.native(s, n=F.col("n.lex"), k=F.col("k"))


@query("SELECT r_name AS r, s_name AS s FROM region CROSS JOIN supplier WHERE s_acctbal > 9000")
def product_bounded(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["region", "supplier"])
    s = P.where(P.bgp(g, ("?y", B + "s_acctbal", "?b"), ("?y", B + "s_name", "?s")), fn.number("?b") > 9000)
    return lexed(P.product(P.match(g, "?x", B + "r_name", "?r"), s), "r", "s")


# --- paths -----------------------------------------------------------------------------------------------------


def _hierarchy(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    g = star_graph(spark, sf, ["supplier", "nation", "region"])
    return g, paths.alternative(paths.step(g, B + "nation"), paths.step(g, B + "region"))


@query("SELECT 'http://t/supplier/' || s_suppkey AS s, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_seq(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["supplier", "nation", "region"])
    return lexed(paths.solutions(paths.sequence(*(paths.step(g, B + p) for p in ("nation", "region", "r_name"))), "?s", "?r"), "s", "r")


_UP = "SELECT 'http://t/supplier/' || s_suppkey AS s, 'http://t/nation/' || s_nationkey AS o FROM supplier UNION ALL SELECT 'http://t/nation/' || n_nationkey, 'http://t/region/' || n_regionkey FROM nation"


@query(_UP)
def path_alt(spark: SparkSession, sf: str) -> DataFrame:
    return lexed(paths.solutions(_hierarchy(spark, sf)[1], "?s", "?o"), "s", "o")


@query("SELECT 'http://t/region/' || n_regionkey AS s, 'http://t/nation/' || n_nationkey AS o FROM nation")
def path_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return lexed(paths.solutions(paths.inverse(paths.step(star_graph(spark, sf, ["nation"]), B + "region")), "?s", "?o"), "s", "o")


@query(f"WITH RECURSIVE e AS ({_UP}), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r")
def path_plus(spark: SparkSession, sf: str) -> DataFrame:
    return lexed(paths.solutions(paths.one_or_more(_hierarchy(spark, sf)[1]), "?s", "?o"), "s", "o")


@query(f"WITH RECURSIVE e AS ({_UP}), r AS (SELECT s, s AS o FROM e UNION SELECT o, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r")
def path_star(spark: SparkSession, sf: str) -> DataFrame:
    up = _hierarchy(spark, sf)[1]
    ends = up.select(F.col("s").alias("n")).unionByName(up.select(F.col("o").alias("n"))).distinct()
    return lexed(paths.solutions(paths.zero_or_more(up, ends), "?s", "?o"), "s", "o")


@query("WITH n AS (SELECT 'http://t/nation/' || n_nationkey AS x, 'http://t/region/' || n_regionkey AS y FROM nation) SELECT x AS s, x AS o FROM n UNION SELECT y, y FROM n UNION SELECT x, y FROM n")
def path_opt(spark: SparkSession, sf: str) -> DataFrame:
    up = paths.step(star_graph(spark, sf, ["nation"]), B + "region")
    ends = up.select(F.col("s").alias("n")).unionByName(up.select(F.col("o").alias("n"))).distinct()
    return lexed(paths.solutions(paths.zero_or_one(up, ends), "?s", "?o"), "s", "o")


@query("SELECT 'http://t/region/' || r_regionkey AS s, CAST(r_regionkey AS VARCHAR) AS o FROM region UNION ALL SELECT 'http://t/region/' || r_regionkey, 'http://t/class/region' FROM region UNION ALL SELECT r_name, 'http://t/region/' || r_regionkey FROM region")
def path_negset(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["region"])
    both = paths.negated(g, [B + "r_name", RDFS_LABEL], [B + "r_regionkey", RDF_TYPE, RDFS_LABEL])
    return lexed(paths.solutions(both, "?s", "?o"), "s", "o")


# --- aggregation and modifiers ---------------------------------------------------------------------------------


@query("SELECT l_returnflag AS f, l_linestatus AS st, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY ALL")
def group_sum_avg(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["lineitem"]), ("?l", B + "l_returnflag", "?f"), ("?l", B + "l_linestatus", "?st"), ("?l", B + "l_quantity", "?q"), ("?l", B + "l_discount", "?d"))
    s = P.group(s, ["f", "st"], {"sq": F.sum(fn.number("?q")), "ad": F.avg(fn.number("?d")), "n": F.count("*")})
    return P.native(s, f=F.col("f.lex"), st=F.col("st.lex"), q=F.col("sq"), d=F.col("ad"), n=F.col("n"))


@query("SELECT event_type AS t, count(*) AS n FROM events GROUP BY event_type")
def group_count(spark: SparkSession, sf: str) -> DataFrame:
    s = P.group(P.match(star_graph(spark, sf, ["events"]), "?e", B + "event_type", "?t"), ["t"], {"n": F.count("*")})
    return P.native(s, t=F.col("t.lex"), n=F.col("n"))


@query("SELECT event_type AS t, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    s = P.group(P.bgp(star_graph(spark, sf, ["events"]), ("?e", B + "event_type", "?t"), ("?e", B + "user_id", "?u")), ["t"], {"n": F.countDistinct("u")})
    return P.native(s, t=F.col("t.lex"), n=F.col("n"))


@query("SELECT r_name AS r, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def group_concat(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["nation", "region"]), ("?x", B + "region", "?y"), ("?x", B + "n_name", "?n"), ("?y", B + "r_name", "?r"))
    s = P.group(s, ["r"], {"names": fn.group_concat(F.col("n.lex"), ", ")})
    return P.native(s, r=F.col("r.lex"), names=F.col("names"))


@query("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND avg(o_totalprice) > 200000")
def having(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["orders"]), ("?o", B + "o_custkey", "?c"), ("?o", B + "o_totalprice", "?t"))
    s = P.group(s, ["c"], {"n": F.count("*"), "a": F.avg(fn.number("?t"))}, (F.col("n") > 15) & (F.col("a") > 200000))
    return P.native(s, c=long("c"), n=F.col("n"))


@query("SELECT p_brand AS b, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first FROM part GROUP BY p_brand")
def min_max(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["part"]), ("?p", B + "p_brand", "?b"), ("?p", B + "p_retailprice", "?r"), ("?p", B + "p_name", "?n"))
    s = P.group(s, ["b"], {"lo": fn.least_term("?r"), "hi": fn.greatest_term("?r"), "first": fn.sample("?n")})
    return P.native(s, b=F.col("b.lex"), lo=num("lo"), hi=num("hi"), first=F.col("first.lex"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0")
def implicit_group(spark: SparkSession, sf: str) -> DataFrame:
    s = P.where(P.match(star_graph(spark, sf, ["orders"]), "?o", B + "o_totalprice", "?t"), fn.number("?t") < 0)
    return P.native(P.group(s, [], {"n": F.count("*"), "total": F.sum(fn.number("?t"))}), n=F.col("n"), total=F.col("total"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
def group_by_expression(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bind(P.match(star_graph(spark, sf, ["orders"]), "?o", B + "o_orderdate", "?d"), "?y", F.year(fn.timestamp("?d")).cast("long"))
    s = P.group(s, ["y"], {"n": F.count("*")})
    return P.native(s, y=F.col("y"), n=F.col("n"))


@query("SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def order_limit_topk(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["orders"]), ("?x", B + "o_orderkey", "?o"), ("?x", B + "o_totalprice", "?t"))
    s = P.cut(P.order(s, fn.sort_key("?t").desc(), fn.sort_key("?o")), 25)
    return P.native(s, o=long("o"), t=num("t"))


@query("SELECT s_name AS s FROM supplier ORDER BY s_acctbal, s_name LIMIT 20 OFFSET 7")
def offset(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["supplier"]), ("?x", B + "s_name", "?s"), ("?x", B + "s_acctbal", "?b"))
    return lexed(P.cut(P.order(s, fn.sort_key("?b"), fn.sort_key("?s")), 20, 7), "s")


@query("SELECT DISTINCT p_brand AS b, p_type AS t FROM part")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["part"]), ("?p", B + "p_brand", "?b"), ("?p", B + "p_type", "?t"))
    return lexed(P.distinct(P.project(s, "b", "t")), "b", "t")


@query("SELECT DISTINCT o_orderpriority AS p FROM orders")
def reduced(spark: SparkSession, sf: str) -> DataFrame:
    s = P.reduced(P.project(P.match(star_graph(spark, sf, ["orders"]), "?o", B + "o_orderpriority", "?p"), "p"))
    return lexed(P.distinct(s), "p")


# --- query forms, sinks ----------------------------------------------------------------------------------------


@query("SELECT count(*) > 0 AS result FROM customer WHERE c_acctbal < -900")
def ask_true(spark: SparkSession, sf: str) -> DataFrame:
    return P.ask(P.where(P.match(star_graph(spark, sf, ["customer"]), "?c", B + "c_acctbal", "?b"), fn.number("?b") < -900))


@query("SELECT count(*) > 0 AS result FROM customer WHERE c_mktsegment = 'NONE'")
def ask_false(spark: SparkSession, sf: str) -> DataFrame:
    return P.ask(P.match(star_graph(spark, sf, ["customer"]), "?c", B + "c_mktsegment", Lit("NONE")))


@query("SELECT DISTINCT 'http://t/nation/' || c_nationkey AS s, 'http://x/segment' AS p, c_mktsegment AS o FROM customer")
def construct_triples(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", B + "nation", "?n"), ("?c", B + "c_mktsegment", "?m"))
    t = P.construct(s, ("?n", Iri("http://x/segment"), "?m"))
    return t.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@query("SELECT 'http://t/nation/' || n_nationkey AS s, 'http://t/' || p AS p, o FROM (SELECT n_nationkey, unnest(['n_name', 'n_nationkey', 'n_regionkey', 'region']) AS p, unnest([n_name, CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR), 'http://t/region/' || n_regionkey]) AS o FROM nation WHERE n_regionkey = 2)")
def describe_node(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation"])
    found = P.describe(g, P.match(g, "?s", B + "n_regionkey", Lit(2)).df)
    found = found.where(~F.col("p.lex").isin(RDF_TYPE, RDFS_LABEL))
    return found.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


@query("SELECT '<http://t/nation/' || n_nationkey || '> <http://t/n_name> \"' || n_name || '\" .' AS value FROM nation")
def ntriples_sink(spark: SparkSession, sf: str) -> DataFrame:
    return ntriples(star_graph(spark, sf, ["nation"]).triples([B + "n_name"]))


@query("""SELECT '{"r":{"type":"literal","value":"' || r_name || '"},"x":{"type":"uri","value":"http://t/region/' || r_regionkey || '"}}' AS value FROM region""")
def json_sink(spark: SparkSession, sf: str) -> DataFrame:
    return json_lines(P.project(P.match(star_graph(spark, sf, ["region"]), "?x", B + "r_name", "?r"), "r", "x"))


# --- scalar functions ------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS k, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS len, substr(c_name, 3, 5) AS sub, starts_with(c_name, 'Customer#0000000') AS starts, contains(c_name, '7') AS has, split_part(c_name, '#', 1) AS pre, split_part(c_name, '#', 2) AS post, regexp_replace(c_name, '0+', '-', 'g') AS rep FROM customer WHERE c_name LIKE '%#%'")
def fn_string(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", B + "c_custkey", "?k"), ("?c", B + "c_name", "?n"), ("?c", B + "c_mktsegment", "?m"))
    n = fn.string("?n")
    s = P.where(s, n.contains("#"))
    return P.native(s, k=long("k"), up=F.upper(fn.string("?m")), low=F.lower(n), len=F.length(n).cast("long"), sub=fn.substr(n, 3, 5), starts=n.startswith("Customer#0000000"), has=n.contains("7"), pre=fn.before(n, "#"), post=fn.after(n, "#"), rep=fn.replace(n, "0+", "-"))


@query("SELECT c_custkey AS k, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(floor(c_acctbal + 0.5) AS DOUBLE) AS r FROM customer")
def fn_numeric(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", B + "c_custkey", "?k"), ("?c", B + "c_acctbal", "?b"))
    b = fn.number("?b")
    return P.native(s, k=long("k"), a=F.abs(b), c=F.ceil(b).cast("double"), f=F.floor(b).cast("double"), r=fn.round_half_up(b))


@query("SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders")
def fn_datetime(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["orders"]), ("?x", B + "o_orderkey", "?o"), ("?x", B + "o_orderdate", "?d"))
    t = fn.timestamp("?d")
    return P.native(s, o=long("o"), y=F.year(t).cast("long"), m=F.month(t).cast("long"), d=F.dayofmonth(t).cast("long"), h=F.hour(t).cast("long"))


@query("SELECT n_name AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
def fn_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["nation"]), "?x", B + "n_name", "?n")
    return lexed(s, "n", m=fn.hash_of(fn.string("?n"), "md5"), s=fn.hash_of(fn.string("?n"), "sha256"))


@query("SELECT 'http://t/' || t AS p, count(*) FILTER (k = 'i') AS iris, count(*) FILTER (k = 'l') AS literals, count(*) FILTER (k = 'n') AS numbers FROM (SELECT 'region' AS t, 'i' AS k FROM nation UNION ALL SELECT 'n_name', 'l' FROM nation UNION ALL SELECT 'n_nationkey', unnest(['l', 'n']) FROM nation) GROUP BY t")
def fn_term_tests(spark: SparkSession, sf: str) -> DataFrame:
    s = P.where(P.match(star_graph(spark, sf, ["nation"]), "?s", "?p", "?o"), F.col("p.lex").isin(B + "region", B + "n_name", B + "n_nationkey"))
    count = lambda c: F.count(F.when(c, 1))
    s = P.group(s, ["p"], {"iris": count(fn.is_iri("?o")), "literals": count(fn.is_literal("?o")), "numbers": count(fn.is_numeric("?o"))})
    return P.native(s, p=F.col("p.lex"), iris=F.col("iris"), literals=F.col("literals"), numbers=F.col("numbers"))


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debt' END AS side, coalesce(NULL, c_name) AS n FROM customer")
def fn_conditional(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?c", B + "c_custkey", "?k"), ("?c", B + "c_acctbal", "?b"), ("?c", B + "c_name", "?n"))
    return P.native(s, k=long("k"), side=fn.if_(fn.number("?b") > 0, F.lit("credit"), F.lit("debt")), n=F.coalesce(fn.number("?n").cast("string"), fn.string("?n")))


# --- generation ------------------------------------------------------------------------------------------------


@query("SELECT c_name AS n, upper(n_name) AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey")
def genop_context(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer", "nation"])
    s = P.bgp(g, ("?x", B + "c_name", "?n"), ("?x", B + "nation", "?y"), ("?y", B + "n_name", "?r"))
    return lexed(generate(s, "Nation of {?n}: [{?r}]", ["answer"], Echo(how="upper")).solutions, "n", "answer")


@query("SELECT c_name AS n, a AS answer FROM customer CROSS JOIN (VALUES ('one'), ('two')) t(a)")
def genop_base(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    return lexed(generate(s, "Name two numbers", ["answer"], Mock(default='["one", "two", "one"]')).solutions, "n", "answer")


@query("SELECT c_name AS n, lower(c_name) AS a, lower(c_name) AS b FROM customer")
def genop_multi_output(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    return lexed(generate(s, "About [{?n}]", ["a", "b"], Echo(how="lower")).solutions, "n", "a", "b")


@query("SELECT c_name AS n FROM customer WHERE false")
def genop_empty(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    return lexed(generate(s, "About [{?n}]", ["a"], Echo(how="none")).solutions, "n")


@query("SELECT (SELECT count(*) FROM orders) AS n_solutions, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS n_calls, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS asked")
def genop_dedup_calls(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["orders"]), "?o", B + "o_orderpriority", "?p")
    prompt = "What does [{?p}] mean?"
    made = generate(s, prompt, ["a"], Echo())
    return cost.call_statistics(s, prompt).withColumn("asked", F.lit(made.calls()).cast("long"))


@query("SELECT c_name AS name, CASE WHEN c_acctbal > 9000 THEN upper(c_mktsegment) END AS a FROM customer")
def genop_optional(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["customer"])
    rich = P.where(P.bgp(g, ("?c", B + "c_mktsegment", "?m"), ("?c", B + "c_acctbal", "?b")), fn.number("?b") > 9000)
    made = generate(rich, "Segment [{?m}]", ["a"], Echo(how="upper")).solutions
    return lexed(P.optional(P.match(g, "?c", RDFS_LABEL, "?name"), P.project(made, "c", "a")), "name", "a")


@query("SELECT c_name AS n, reverse(upper(c_name)) AS b FROM customer")
def genop_chain(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    first = generate(s, "First [{?n}]", ["a"], Echo(how="upper")).solutions
    return lexed(generate(first, "Then [{?a}]", ["b"], Echo(how="reversed")).solutions, "n", "b")


@query("SELECT n_name AS n, upper(n_name) AS a FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name, lower(n_name) FROM nation WHERE n_regionkey = 1")
def genop_union(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation"])
    part = lambda k, how: generate(P.bgp(g, ("?x", B + "n_regionkey", Lit(k)), ("?x", B + "n_name", "?n")), "N [{?n}]", ["a"], Echo(how=how)).solutions
    return lexed(P.union(part(0, "upper"), part(1, "lower")), "n", "a")


@query("SELECT c_name AS n FROM customer WHERE lower(c_name) = 'customer#000000007'")
def genop_bound_output(spark: SparkSession, sf: str) -> DataFrame:
    """An output that is bound already keeps its term where the answer is similar."""
    g = star_graph(spark, sf, ["customer"])
    s = P.match(g, "?x", B + "c_name", "?n")
    return lexed(generate(s, "Which one?", ["n"], Mock(default='["customer#000000007"]'), graph=g).solutions, "n")


@query("SELECT c_name AS n, upper(c_name) AS a FROM customer")
def genop_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Answers come from records; a provider that would answer otherwise is not asked."""
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    first = generate(s, "N [{?n}]", ["a"], Echo(how="upper"))
    again = generate(s, "N [{?n}]", ["a"], Echo(how="none"), Options(records=first.records(), replay_only=True))
    return lexed(again.solutions, "n", "a")


@query("SELECT c_name AS n, upper(c_name) AS a, upper(c_name) AS b FROM customer")
def genop_together(spark: SparkSession, sf: str) -> DataFrame:
    """Five prompts share a request."""
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    return lexed(generate(s, "N [{?n}]", ["a", "b"], Echo(how="upper"), Options(together=5)).solutions, "n", "a", "b")


@query("SELECT CAST(k AS INTEGER) AS together, count(*) AS rows, CAST(sum(length(w)) AS BIGINT) AS chars FROM (SELECT unnest([1, 2, 5]) AS k), (SELECT DISTINCT p, w FROM (SELECT p_partkey AS p, unnest(string_split(p_name || ' ' || p_brand, ' ')) AS w FROM part) WHERE w <> '') GROUP BY k")
def genop_together_several(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with several answers and candidates give the same rows however many share a request."""
    g = star_graph(spark, sf, ["part"])
    s = P.bgp(g, ("?p", RDFS_LABEL, "?n"), ("?p", B + "p_brand", "?b"))
    each = []
    for k in (1, 2, 5):
        made = generate(s, "N [{?n} {?b}]", ["w"], Echo(several=" "), Options(together=k, candidates=["plain", "gold"]))
        each.append(made.solutions.df.agg(F.lit(k).alias("together"), F.count("*").alias("rows"), F.sum(F.length("w.lex")).alias("chars")))
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT count(*) AS n_prompts, CAST(0 AS BIGINT) AS n_failed, count(*) AS n_rows, CAST(sum(ceil((length(n) + 4) / 4)) AS BIGINT) AS tokens, CAST(sum(ceil((length(n) + 4) / 4)) AS BIGINT) AS tokens_out, CAST(5 * 3 + count(*) AS DOUBLE) / (3 + count(*)) AS fan_out FROM (SELECT DISTINCT c_name AS n FROM customer)")
def genop_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    prompt = "N [{?n}]"
    made = generate(s, prompt, ["a"], Echo())
    seen = cost.observed_fan_out(cost.fan_out(prompt), made.answers).first()[0]
    return made.metrics().drop("seconds").withColumn("fan_out", F.lit(seen))


@query("SELECT c_name AS n, c_mktsegment = 'BUILDING' AS low, false AS high FROM customer")
def genop_theta(spark: SparkSession, sf: str) -> DataFrame:
    """A filter compares a generated variable by the threshold of the generation that made it, whatever later ones say."""
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?x", B + "c_name", "?n"), ("?x", B + "c_mktsegment", "?m"))
    low = generate(s, "Segment of {?n}: [{?m} goods]", ["a"], Echo(how="lower"), Options(theta=0.5)).solutions
    both = generate(low, "Again, {?n}: [{?m} goods]", ["b"], Echo(how="lower"), Options(theta=0.9)).solutions
    building = Lit("building").column()
    return lexed(both, "n", low=S.similar(both, "?a", building), high=S.similar(both, "?b", building))


@query("SELECT c_name AS n, 'alpha' AS first FROM customer")
def genop_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates are part of the request, in order."""
    s = P.match(star_graph(spark, sf, ["customer"]), "?x", B + "c_name", "?n")
    made = generate(s, "Pick one for {?n}", ["first"], Echo(start="Choose from: ", end="; "), Options(candidates=["beta", "alpha", "gamma"])).solutions
    return lexed(made, "n", "first")


@query("SELECT c_name AS n, 'http://t/region/' || r_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ground_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Generated names of regions become the regions whose labels have the nearest vectors."""
    g = star_graph(spark, sf, ["customer", "nation", "region"])
    s = P.bgp(g, ("?c", B + "nation", "?y"), ("?c", B + "c_name", "?n"), ("?y", B + "region", "?z"), ("?z", B + "r_name", "?m"))
    made = generate(s, "Region of {?n}: [{?m}]", ["r"], Echo(how="lower")).solutions
    named = g.of(RDFS_LABEL).where("s.lex LIKE 'http://t/region/%'").select(F.col("s").alias("term"), F.lower("o.lex").alias("text"))
    values = made.df.select(F.col("r.lex").alias("text")).distinct()
    vectors = embed_texts(values.unionByName(named.select("text")), LetterCounts())
    entities = named.join(vectors, "text").select("term", F.col("term.lex").alias("id"), "v")
    return lexed(ground(made, "?r", vectors.select(F.col("text").alias("value"), F.col("text").alias("q"), "v"), entities, 0.99), "n", "r")


@query("SELECT r_name AS label FROM region")
def genop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    g = star_graph(spark, sf, ["nation", "region"])
    found = candidate_labels(g, B + "region")
    return star_graph(spark, sf, ["region"]).of(RDFS_LABEL).select(F.col("o.lex").alias("label")).where(F.col("label").isin(found))


# --- similarity ------------------------------------------------------------------------------------------------

_JACCARD = "CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_intersect(list_distinct(string_split_regex(lower(trim({a})), '\\s+')), list_distinct(string_split_regex(lower(trim({b})), '\\s+')))) / len(list_distinct(list_concat(string_split_regex(lower(trim({a})), '\\s+'), string_split_regex(lower(trim({b})), '\\s+')))) END"


_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length({x}) - length(replace({x}, c, '')) AS DOUBLE))"


def _part_pairs(theta: float, left: list[str], right: list[str]):
    """Texts made of columns of part and words; those of left and right may differ in their order."""
    of = lambda parts: " || ' ' || ".join(x if x.startswith("p_") else f"'{x}'" for x in parts)
    sql = f"WITH x AS (SELECT DISTINCT {of(left)} AS a FROM part), y AS (SELECT DISTINCT {of(right)} AS b FROM part), j AS (SELECT a, b, {_JACCARD.format(a='a', b='b')} AS similarity FROM x, y) SELECT a, b, CAST(similarity AS DOUBLE) AS similarity FROM j WHERE similarity >= {theta}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        g = star_graph(spark, sf, ["part"])
        s = P.bgp(g, *(("?p", B + c, f"?{c}") for c in sorted({*left, *right}) if c.startswith("p_"))).df
        text = lambda parts: F.concat_ws(" ", *(F.col(f"{x}.lex") if x.startswith("p_") else F.lit(x) for x in parts))
        return S.matching_texts(s.select(text(left).alias("a")), s.select(text(right).alias("b")), theta)

    return sql, run


_SHORT = ["p_name", "p_brand", "p_type"]
_LONG = ["p_name", "p_type", "of", "p_brand", "sold by the piece, at retail price, in size", "p_size"]
for _name, _theta, _left, _right in (("simjoin_jaccard_05", 0.5, _SHORT, _SHORT), ("simjoin_jaccard_085", 0.85, _LONG, _LONG), ("simjoin_jaccard_1", 1.0, _SHORT, _SHORT[::-1])):
    ORACLE_SQL[_name], QUERIES[_name] = _part_pairs(_theta, _left, _right)


@query("WITH x AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_brand AS a FROM part), y AS (SELECT DISTINCT substr(t, 1, p_size % 20) || 'x' || substr(t, p_size % 20 + 2) AS b FROM (SELECT p_type || ' ' || p_name || ' ' || p_brand AS t, p_size FROM part)), j AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN lower(trim(a)) = lower(trim(b)) THEN 0.98 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS similarity FROM x, y) SELECT a, b, CAST(similarity AS DOUBLE) AS similarity FROM j WHERE similarity >= 0.9")
def simjoin_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Names, and names with a typing error, by edit distance."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("a"), (F.col("p_size") % 20).alias("n"))
    typed = part.select(F.concat(F.expr("substr(a, 1, n)"), F.lit("x"), F.expr("substr(a, n + 2)")).alias("b"))
    return S.text_matches(part.select("a"), typed, 0.9, "edit").drop("reason")


@query(f"""WITH x AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS a FROM part), y AS (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS b FROM part),
p AS (SELECT a, {_LETTERS.format(x='a')} AS v, starts_with(a, 'b') AS none FROM x), q AS (SELECT b, {_LETTERS.format(x='b')} AS w FROM y),
j AS (SELECT a, b, CASE WHEN none THEN 'words' ELSE 'vectors' END AS reason, CASE WHEN none THEN {_JACCARD.format(a='a', b='b')} ELSE least(1.0, list_cosine_similarity(v, w)) END AS similarity FROM p, q)
SELECT a, reason, count(*) AS n, round(avg(similarity), 6) AS similarity FROM j WHERE similarity >= 0.913 GROUP BY a, reason""")
def simjoin_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by the cosine of their vectors, and by words where they have none."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    left, right = part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("a")), part.select(F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("b"))
    vectors = embed_texts(left.toDF("text").unionByName(right.toDF("text")), LetterCounts("b"))
    found = S.text_matches(left, right, 0.913, "vectors", vectors)
    return found.groupBy("a", "reason").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 6).alias("similarity"))


@query("SELECT s_name AS s, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = CASE WHEN s_acctbal > 4000 THEN 'BUILDING' ELSE 'MACHINERY' END GROUP BY s_name")
def simjoin_two_variables(spark: SparkSession, sf: str) -> DataFrame:
    """A generated nation and a generated segment must both agree with a customer's."""
    g = star_graph(spark, sf, ["supplier", "customer", "nation"])
    s = P.bgp(g, ("?y", RDFS_LABEL, "?s"), ("?y", B + "s_acctbal", "?b"), ("?y", B + "nation", "?z"), ("?z", B + "n_name", "?m"))
    made = generate(s, "Home of {?s}: [{?m}]", ["x"], Echo(how="lower")).solutions
    made = P.bind(made, "?w", literal(F.when(fn.number("?b") > 4000, "Building").otherwise(" machinery ")))
    made = P.project(generate(made, "Segment for {?s}: [{?w}]", ["seg"], Echo()).solutions, "s", "x", "seg")
    # customers of one nation and segment match alike: they are counted before the join
    alike = P.group(P.bgp(g, ("?c", B + "nation", "?x"), ("?c", B + "c_mktsegment", "?seg")), ["x", "seg"], {"k": F.count("*")})
    found = S.similarity_join(alike, made, g)
    return P.native(P.group(found, ["s"], {"n": F.sum("k")}), s=F.col("s.lex"), n=F.col("n"))


@query("SELECT c_name AS c, n_name AS n, 'http://t/nation/' || n_nationkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000")
def simjoin_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Generated names of nations are mapped to the nations by their labels."""
    g = star_graph(spark, sf, ["customer", "nation"])
    s = P.where(P.bgp(g, ("?y", RDFS_LABEL, "?c"), ("?y", B + "c_acctbal", "?b"), ("?y", B + "nation", "?z"), ("?z", B + "n_name", "?m")), fn.number("?b") > 8000)
    made = generate(s, "Where does {?c} live? [{?m}]", ["x"], Echo(how="lower")).solutions
    joined = S.similarity_join(P.match(g, "?x", B + "n_name", "?n"), made, g)
    return lexed(joined, "c", "n", "x")


@query("SELECT c_name AS n, c_mktsegment = 'BUILDING' AS same FROM customer")
def simfilter_eq_ne(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["customer"]), ("?x", B + "c_name", "?n"), ("?x", B + "c_mktsegment", "?m"))
    made = generate(s, "Segment of {?n}: [{?m}]", ["a"], Echo(how="lower")).solutions
    equal = S.similar(made, "?a", Lit("BUILDING ").column())
    yes, no = P.where(made, equal), P.where(made, ~equal)
    return lexed(yes, "n", same=F.lit(True)).unionByName(lexed(no, "n", same=F.lit(False)))


@query("SELECT a.p_name AS a, b.p_name AS b, CASE WHEN a.p_name = b.p_name THEN 1.0 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) END AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein_sim(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    other = part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b"))
    pairs = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(other, "k")
    return pairs.select("a", "b", S.levenshtein(F.col("a"), F.col("b")).alias("similarity"))


@query("WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q, vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) DESC, vec_id) AS k FROM q, embeddings) SELECT q, id, similarity FROM p WHERE k <= 5")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = S.nearest(index.where("id % 20 = 0").select(F.col("id").alias("q"), "v"), index, 5)
    return found.select("q", "id", F.round("similarity", 6).alias("similarity"))


@query("WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q, vec_id AS id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c FROM q, embeddings) SELECT q, id, round(least(1, c), 6) AS similarity FROM p WHERE c >= 0.2")
def cosine_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Each twentieth vector against all."""
    index = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = S.nearest(index.where("id % 20 = 0").select(F.col("id").alias("q"), "v"), index, None, 0.2)
    return found.select("q", "id", F.round("similarity", 6).alias("similarity"))


@query("WITH q AS (SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q, vec_id AS id, list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS c FROM q, embeddings) SELECT q, id, round(least(1, c), 6) AS similarity FROM p WHERE c >= 0.2")
def cosine_threshold_all(spark: SparkSession, sf: str) -> DataFrame:
    return cosine_threshold(spark, sf)


@query("SELECT 'http://t/region/' || r_regionkey AS term, r_name AS label FROM region UNION ALL SELECT 'http://t/class/region', 'region'")
def label_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of nodes, and the last part of an IRI where there is none."""
    g = star_graph(spark, sf, ["region"])
    terms = g.of(B + "r_name").select(F.col("s").alias("term")).unionByName(g.of(RDF_TYPE).select(F.col("o").alias("term"))).distinct()
    return S.texts_of(terms, S.labels(g)).select(F.col("term.lex").alias("term"), "label")




@query(f"""WITH t AS (SELECT a.p_partkey AS k, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), m AS (SELECT *, starts_with(a, 'b') OR starts_with(b, 'b') AS words FROM t)
SELECT k, CASE WHEN words THEN 'words' ELSE 'cosine' END AS measure, CASE WHEN words THEN round({_JACCARD.format(a='a', b='b')}, 6) ELSE round(list_cosine_similarity({_LETTERS.format(x='a')}, {_LETTERS.format(x='b')}), 6) END AS similarity FROM m""")
def sim_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of vectors that a provider gives, and words where it gives none."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    pairs = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("b")), "k")
    vectors = embed_texts(part.select(F.col("p_name").alias("text")), LetterCounts("b"))
    return compared(pairs, vectors).select("k", "measure", F.round("similarity", 6).alias("similarity"))


# --- functions for generated texts, statistics -----------------------------------------------------------------


@query("SELECT doc_id, CAST(floor((ceil(length(text) / 4) + ceil((CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(string_split_regex(trim(text, ' '), '\\s+')) END) * 1.3)) / 2) AS INTEGER) AS cost FROM documents")
def gen_token_cost(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", gen.token_cost(F.col("text")).alias("cost"))


@query("SELECT doc_id, CAST(floor((ceil(length(text) / 4) + ceil((CASE WHEN trim(text, ' ') = '' THEN 0 ELSE len(string_split_regex(trim(text, ' '), '\\s+')) END) * 1.3)) / 2) AS INTEGER) AS cost FROM documents")
def gen_token_cost_all(spark: SparkSession, sf: str) -> DataFrame:
    return gen_token_cost(spark, sf)


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def gen_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", gen.parse_json(F.col("props"), "k").alias("k"))


@query("SELECT event_id AS e, p AS path, CASE p WHEN 'k' THEN json_extract_string(props, '$.k') WHEN 'b' THEN CASE WHEN value > 100 THEN 'true' ELSE 'false' END WHEN 's' THEN event_type WHEN 'o' THEN props WHEN 'none' THEN '' END AS lex, CASE p WHEN 'k' THEN 'integer' WHEN 'd' THEN 'double' WHEN 'b' THEN 'boolean' ELSE 'string' END AS kind, CASE WHEN p = 'd' THEN value END AS number FROM (SELECT event_id, replace(props, ' ', '') AS props, value, event_type, unnest(['k', 'd', 'b', 's', 'o', 'none']) AS p FROM events)")
def gen_parse_json_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a JSON text keep their types."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.lit('{"in": [{"k": '), F.get_json_object("props", "$.k"), F.lit(', "d": '), F.format_string("%.2fe0", F.col("value")), F.lit(', "b": '), (F.col("value") > 100).cast("string"), F.lit(', "s": "'), F.col("event_type"), F.lit('", "o": '), F.col("props"), F.lit("}]}"))
    each = [e.select(F.col("event_id").alias("e"), F.lit(p).alias("path"), gen.parse_json_term(text, f"in[0].{p}").alias("t")) for p in ("k", "d", "b", "s", "o", "none")]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    kind = F.substring_index("t.dt", "#", -1)
    return rows.select("e", "path", F.when(kind != "double", F.col("t.lex")).alias("lex"), kind.alias("kind"), F.when(kind == "double", F.col("t.lex").cast("double")).alias("number"))


@query(f"SELECT a.p_partkey AS k, {_JACCARD.format(a='a.p_name', b='b.p_name')} >= 0.5 AS similar FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def gen_approx_eq(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    other = part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("other"))
    return part.withColumnRenamed("p_partkey", "k").join(other, "k").select("k", gen.approx_equal(F.col("p_name"), F.col("other"), 0.5).alias("similar"))


@query("SELECT o_orderkey AS o, lower(o_orderpriority) AS answer, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'urgent' WHEN contains(lower(o_orderpriority), 'high') THEN 'high' ELSE trim(lower(o_orderpriority), ' ') END AS label FROM orders")
def gen_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.lower("o_orderpriority").alias("answer"))
    return rows.withColumn("label", gen.pick_label(F.col("answer"), ["urgent", "high"]))


@query("SELECT o_orderkey AS o, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'urgent' WHEN contains(lower(o_orderpriority), 'high') THEN 'high' ELSE '[\"' || lower(o_orderpriority) || '\"]' END AS label FROM orders")
def gen_classify_asked(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("o"), "o_orderpriority")
    return gen.classify(rows, F.col("o_orderpriority"), ["urgent", "high"], Echo("Text: ", "\n")).select("o", "label")


@query("SELECT c_custkey AS k, '[\"' || c_name || '\"]' AS fields FROM customer")
def gen_extract(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_name")
    return gen.extract(rows, F.col("c_name"), ["name"], Echo(" from: ", "\n")).select("k", "fields")


@query("SELECT c_custkey AS k, c_acctbal > 0 AS valid, c_acctbal > 1000 AS entailed FROM customer WHERE c_acctbal IS NOT NULL")
def gen_validate_entail(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal IS NOT NULL")
    said = lambda least, yes, no: F.concat(F.when(F.col("c_acctbal") > least, yes).otherwise(no), F.lit(" "), F.col("c_name"))
    found = gen.validate(rows, said(0, "valid", "not valid"), "a name", Echo("Value: ", "\n"))
    found = gen.entail(found, F.col("c_name"), said(1000, "yes", "nothing"), Echo("Hypothesis: ", "\n"))
    return found.select(F.col("c_custkey").alias("k"), "valid", "entailed")


@query("SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') AS v FROM embeddings")
def gen_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), gen.embedding_text(F.col("embedding")).alias("v"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'http://www.wikidata.org/entity/Q' || p_partkey ELSE 'http://dbpedia.org/resource/' || replace(p_name, ' ', '_') END AS iri FROM part")
def gen_ground(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet")
    answer = F.when(F.col("p_partkey") % 5 == 0, "NONE").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q"), F.col("p_partkey"))).otherwise(F.col("p_name"))
    return rows.select(F.col("p_partkey").alias("k"), gen.grounded_iri(answer).alias("iri"))


@query("SELECT 'http://t/' || p AS p, n, n AS subjects, objects FROM (SELECT 'o_orderstatus' AS p, count(*) AS n, count(DISTINCT o_orderstatus) AS objects FROM orders UNION ALL SELECT 'customer', count(*), count(DISTINCT o_custkey) FROM orders)")
def kg_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cost.predicate_statistics(star_graph(spark, sf, ["orders"]).triples([B + "o_orderstatus", B + "customer"]))


@query("WITH p AS (SELECT DISTINCT 'Explain ' || o_orderpriority AS p FROM orders) SELECT count(*) AS n_calls, CAST(sum(ceil(length(p) / 4)) AS BIGINT) AS tokens FROM p")
def prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["orders"]), "?o", B + "o_orderpriority", "?p")
    return cost.prompt_tokens(s, "Explain {?p}")


@query("WITH p AS (SELECT DISTINCT 'Explain ' || c_mktsegment AS p FROM customer), t AS (SELECT count(*) AS n_calls, CAST(sum(ceil(length(p) / 4)) AS BIGINT) AS tokens FROM p) SELECT n_calls, tokens, n_calls * 100 AS tokens_out, (tokens * 0.5 + n_calls * 100 * 1.5) / 1e6 AS price, ceil(n_calls / 2) * 0.25 AS seconds FROM t")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    s = P.match(star_graph(spark, sf, ["customer"]), "?c", B + "c_mktsegment", "?m")
    return cost.estimate(cost.prompt_tokens(s, "Explain {?m}"), 100, 0.5, 1.5, 0.25, 2)


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'low' END AS band, length(c_name) > 3 AS valid FROM customer")
def fn_nested_optional(spark: SparkSession, sf: str) -> DataFrame:
    """Two BINDs by OPTIONAL parts; a customer in neither has none."""
    g = star_graph(spark, sf, ["customer"])
    every = P.bgp(g, ("?c", B + "c_custkey", "?k"), ("?c", B + "c_name", "?n"))
    balance = P.match(g, "?c", B + "c_acctbal", "?b")
    high = P.bind(P.where(balance, ~fn.less("?b", Lit(5000).column())), "?band", Lit("high").column())
    low = P.bind(P.where(balance, fn.less("?b", Lit(5000).column()) & ~fn.less("?b", Lit(0).column())), "?band", Lit("low").column())
    s = P.optional(every, P.project(P.union(high, low), "c", "band"))
    return P.native(s, k=long("k"), band=F.col("band.lex"), valid=F.length(fn.string("?n")) > 3)


@query("SELECT substr(o_orderpriority, 1, 1) AS p, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1")
def min_max_dates(spark: SparkSession, sf: str) -> DataFrame:
    s = P.bgp(star_graph(spark, sf, ["orders"]), ("?o", B + "o_orderpriority", "?p"), ("?o", B + "o_orderdate", "?d"))
    s = P.bind(s, "?k", fn.substr(fn.string("?p"), 1, 1))
    s = P.group(s, ["k"], {"first": F.min(fn.timestamp("?d")), "last": F.max(fn.timestamp("?d"))})
    return P.native(s, p=F.col("k"), first=F.col("first"), last=F.col("last"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return simjoin_terms(spark, sf)
