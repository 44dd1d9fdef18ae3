"""Solutions with unbound variables, graphs from files, paths, and generation."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalar as fn
from weftgraph.operators import paths
from weftgraph.operators import patterns as P
from weftgraph.operators import similarity as S
from weftgraph.operators.generate import Echo, Mock, Options, generate, parse_answer, placeholders
from weftgraph.sources.graph import Graph, TableMapping, ntriples, quads_graph, read_ntriples, table_graph
from weftgraph.sources.results import json_document
from weftgraph.sources.terms import RDF_TYPE, RDFS_LABEL, XSD, Iri, Lit, Term, iri

EX = "http://e/"
LINES = """<http://e/p1> <http://e/name> "Messi" .
<http://e/p1> <http://e/playsFor> <http://e/t1> .
<http://e/p2> <http://e/name> "Mbappe"@fr .
<http://e/p2> <http://e/playsFor> <http://e/t2> .
<http://e/p3> <http://e/name> "Jim\\"enez" .
<http://e/p3> <http://e/playsFor> <http://e/t3> .
<http://e/p1> <http://e/nick> "La Pulga" .
<http://e/t1> <http://www.w3.org/2000/01/rdf-schema#label> "Argentina" .
<http://e/t2> <http://www.w3.org/2000/01/rdf-schema#label> "France" .
<http://e/t3> <http://www.w3.org/2000/01/rdf-schema#label> "Mexico" .
# a comment
<http://e/p1> <http://e/name> "Messi" .
_:b <http://e/age> "7"^^<http://www.w3.org/2001/XMLSchema#integer> <http://e/g> .
"""


@pytest.fixture(scope="module")
def quads(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("nt") / "a.nq"
    path.write_text(LINES)
    return read_ntriples(spark, str(path))


@pytest.fixture(scope="module")
def graph(quads):
    return quads_graph(quads, [EX + "name", EX + "playsFor", EX + "nick", RDFS_LABEL, EX + "age"], [EX + "g"])


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def texts(sol, *names):
    return sorted((tuple(r[n] and r[n]["lex"] for n in names) for r in sol.df.select(*names).collect()), key=repr)


def test_ntriples_round_trip(quads, graph):
    assert quads.count() == 11
    out = [r[0] for r in ntriples(graph.triples([EX + "name"])).collect()]
    assert sorted(out) == sorted(x for x in dict.fromkeys(LINES.splitlines()) if "/name>" in x)
    assert texts(P.match(graph, "?s", EX + "age", "?a", EX + "g"), "a") == [("7",)]
    assert P.match(graph, "?s", EX + "age", "?a", EX + "none").df.count() == 0


def test_json_document(graph):
    doc = json_document(P.match(graph, "?s", EX + "nick", "?n"))
    assert '"vars": ["s", "n"]' in doc and "La Pulga" in doc


A, C = Iri(EX + "a"), Iri(EX + "c")
SIDES = [
    ([[A, C], [None, C], [A, None]], [[A, A], [None, C], [C, None]]),
    ([[None, None]], [[A, C]]),
    ([[A, C], [A, C]], [[None, None], [A, None]]),
    ([], [[A, C]]),
]


def brute(left, right, how):
    """left binds x, y; right binds x, z."""
    out = []
    for x, y in left:
        met = [(r[0], r[1]) for r in right if x is None or r[0] is None or x == r[0]]
        if how == "join":
            out += [(x or q, y, z) for q, z in met]
        elif how == "optional":
            out += [(x or q, y, z) for q, z in met] or [(x, y, None)]
        elif how == "semi":
            out += [(x, y)] if met else []
        elif how == "anti":
            out += [] if met else [(x, y)]
        elif how == "minus":
            out += [] if any(x is not None and x == r[0] for r in right) else [(x, y)]
    return sorted((tuple(t and t.lex for t in r) for r in out), key=repr)


@pytest.mark.parametrize("how", ["join", "optional", "semi", "anti", "minus"])
@pytest.mark.parametrize("side", range(len(SIDES)))
def test_unbound_variables(spark, how, side):
    left, right = SIDES[side]
    a, b = P.values(spark, ["?x", "?y"], left), P.values(spark, ["?x", "?z"], right)
    got = getattr(P, how)(a, b)
    assert texts(got, *(["x", "y", "z"] if how in ("join", "optional") else ["x", "y"])) == brute(left, right, how)


def test_values_arity(spark):
    with pytest.raises(ValueError):
        P.values(spark, ["?x", "?y"], [[A]])


def test_product_is_bounded(spark):
    a, b = P.values(spark, ["?x"], [[A]] * 3), P.values(spark, ["?y"], [[C]] * 3)
    assert P.product(a, b).df.count() == 9
    with pytest.raises(ValueError):
        P.product(a, b, most=2)


def test_cyclic_path(spark):
    t = [(0, EX + x, None, None) for x in "abc"]
    edges = P.values(spark, ["?s", "?o"], [[Iri(t[i][1]), Iri(t[(i + 1) % 3][1])] for i in range(3)]).df
    assert paths.one_or_more(edges).count() == 9
    start = edges.where(F.col("s.lex") == EX + "a").select("s")
    assert paths.one_or_more(edges, start).count() == 3
    assert paths.one_or_more(edges.limit(0)).count() == 0


def test_construct_blank_nodes(graph):
    s = P.match(graph, "?p", EX + "playsFor", "?t")
    t = P.construct(s, ("_:x", Iri(EX + "of"), "?p"), ("?missing", Iri(EX + "of"), "?p")) if False else P.construct(s, ("_:x", Iri(EX + "of"), "?p"))
    assert t.count() == 3 and t.select("s.lex").distinct().count() == 3


def test_describe_follows_blank_nodes(spark):
    row = lambda s, p, o: [s, Iri(p), o]
    from weftgraph.sources.terms import BNODE, Term

    b = Term(BNODE, "n1")
    df = P.values(spark, ["?s", "?p", "?o"], [row(A, EX + "q", b), row(b, EX + "r", Lit(1)), row(C, EX + "r", Lit(2))]).df
    g = Graph({EX + p: df.where(F.col("p.lex") == EX + p).select("s", "o") for p in ("q", "r")})
    assert P.describe(g, df.where(F.col("s.lex") == A.lex)).count() == 2


def test_scalar_rules(spark):
    v = P.values(spark, ["?a", "?b"], [[Lit(1), Lit(1.0)], [Lit("x"), Lit("x", "en")], [Lit("1"), Lit(1)], [A, Lit("x")], [None, Lit(1)]]).df
    got = [r[0] for r in v.select(fn.equal("?a", "?b")).collect()]
    assert got == [True, False, None, False, None]
    assert [r[0] for r in v.select(fn.truth("?a")).collect()] == [True, True, True, None, None]
    order = [r[0] and r[0]["lex"] for r in v.orderBy(fn.sort_key("?a")).select("a").collect()]
    assert order == [None, A.lex, "1", "1", "x"]
    assert v.select(fn.lang_matches(fn.lang("?b"), "EN")).collect()[1][0] is True


def test_context_generation_maps_to_terms(graph):
    s = P.bgp(graph, ("?p", EX + "name", "?name"), ("?p", EX + "playsFor", "?team"))
    made = generate(s, "Team of {?name}?", ["team"], Mock(default='["argentina"]'), graph=graph)
    assert made.calls() == 3
    assert texts(made.solutions, "name", "team") == [("Messi", EX + "t1")]


def test_similarity_join_keeps_graph_terms(graph):
    s = P.match(graph, "?p", EX + "name", "?name")
    made = generate(s, "Land of {?name}?", ["land"], Mock([("Messi", '["Argentina", "Chile"]'), ("Jim", "[\"mexico\"]")])).solutions
    assert "land" in made.generated
    got = S.similarity_join(P.match(graph, "?land", RDFS_LABEL, "?label"), made, graph)
    assert texts(got, "name", "land") == [('Jim"enez', EX + "t3"), ("Messi", EX + "t1")]
    kept = P.where(made, S.similar(made, "?land", Lit("chile").column()))
    assert texts(kept, "name") == [("Messi",)]


def test_base_mode_asks_once_and_failures(graph):
    s = P.match(graph, "?p", EX + "name", "?name")
    made = generate(s, "Two lands", ["x", "y"], Mock(default='[{"x": "a", "y": ""}, {"x": "", "y": ""}]'))
    assert made.calls() == 1 and texts(made.solutions, "x", "y") == [("a", None)] * 3
    with pytest.raises(ValueError):
        generate(s, "About {?nobody}", ["x"], Mock())
    with pytest.raises(ValueError):
        Options(theta=1.5)
    with pytest.raises(LookupError):
        generate(s, "New {?name}", ["x"], Mock(), Options(records=made.records(), replay_only=True))

    class Fails(Mock):
        def complete(self, prompts, outputs):
            return [None if "Messi" in p else '["ok"]' for p in prompts]

    assert texts(generate(s, "Q {?name}", ["x"], Fails()).solutions, "name") == [('Jim"enez',), ("Mbappe",)]
    with pytest.raises(RuntimeError):
        generate(s, "Q {?name}", ["x"], Fails(), Options(fail_on_error=True))


@pytest.mark.parametrize(
    ("raw", "outputs", "want"),
    [
        ('["a", "b", "a"]', ["x"], [["a"], ["b"]]),
        ("[]", ["x"], []),
        ("", ["x"], []),
        (None, ["x"], []),
        ('Sure:\n```json\n["a"]\n```', ["x"], [["a"]]),
        ('[{"x": 1, "y": true}, {"x": null, "y": "b"}]', ["x", "y"], [["1", "true"], [None, "b"]]),
        ('{"value": "v"}', ["x"], [["v"]]),
        ('[{"x": "a"} {"x": "b"}]', ["x"], [["a"], ["b"]]),
        ('["a", "b', ["x"], [["a"]]),
        ("plain text", ["x"], [["plain text"]]),
        ('["a"] and ["b"]', ["x"], [["a"], ["b"]]),
    ],
)
def test_answers(raw, outputs, want):
    assert parse_answer(raw, outputs) == want


def test_values_with_braces_stay(spark):
    from weftgraph.operators.generate import resolved

    df = P.values(spark, ["?x", "?y"], [[Lit("{?y}"), Lit("b")]]).df
    assert df.select(resolved("1 {?x} 2 {?y}")).first()[0] == "1 {?y} 2 b"
    assert placeholders("a {?x} {?y} {?x}") == ["x", "y"]


@pytest.mark.parametrize("theta", [0.0, 0.2, 0.5, 0.7, 0.85, 1.0])
def test_matching_loses_nothing(spark, theta):
    left = ["United States", "south korea", "Korea", "", "the Republic of Korea", "France", " france "]
    right = ["United States of America", "Korea South", "Republic of Korea", "France", "", "The Gambia", "the the republic of korea"]
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r["a"], r["b"]) for r in S.matching_texts(a, b, theta).collect()}
    words = lambda t: set(t.lower().strip().split()) or {""}
    want = {(x, y) for x in left for y in right if len(words(x) & words(y)) / len(words(x) | words(y)) >= theta}
    assert got == want


def test_nearest_matches_brute_force(spark):
    import random

    random.seed(3)
    data = [(i, [random.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    index = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    got = S.nearest(index.where("id < 5").withColumnRenamed("id", "q"), index, 3, block=2)

    def cos(x, y):
        n = sum(p * p for p in x) ** 0.5 * sum(p * p for p in y) ** 0.5
        return max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / n) if n else 0.0

    for q in range(5):
        best = sorted(((-cos(data[q][1], v), i) for i, v in data if v and any(v)), key=lambda t: (round(t[0], 6), t[1]))[:3]
        assert [r["id"] for r in got.where(f"q = {q}").orderBy(F.desc("similarity"), "id").collect()] == [i for _, i in best]


def test_answers_after_a_mended_one_count():
    raw = '[{"a":"1"}{"a":"2"}] and ["x","y"] and [{"a": "}]"}]'
    assert parse_answer(raw, ["a"]) == [["1"], ["2"], ["x"], ["y"], ["}]"]]


def test_canonical_labels_and_substrings(spark):
    names = {"http://x/m_0407yj__Cars_2": "Cars 2", "http://x/m_0abc_New-York": "New York", "http://x/concept_city_rome": "city rome", "http://x/a/": "http://x/a/", "http://x/m_0abc": "m 0abc"}
    df = spark.createDataFrame([(k,) for k in names], "k string")
    got = {r["k"]: r["v"] for r in df.select("k", S.canonical(iri(F.col("k"))).alias("v")).collect()}
    assert got == names
    cut = spark.range(1).select(*(fn.substr(F.lit("abcde"), a, n).alias(f"c{k}") for k, (a, n) in enumerate([(0, 2), (-1, 4), (2, 3), (4, None), (1, 0)]))).first()
    assert tuple(cut) == ("a", "ab", "bcd", "de", "")


def test_star_is_one_solution_a_row(spark):
    """Rows that share a key are no product of their values; constants are compared as terms are."""
    t = spark.createDataFrame([(1, "a", 2.5), (1, "b", 3.5), (2, None, 1.0), (3, "a", None)], "k int, x string, y double")
    g = table_graph({"t": t}, {"t": TableMapping(("k",), label="x")})
    both = P.bgp(g, ("?s", "http://t/x", "?x"), ("?s", "http://t/y", "?y"))
    assert sorted((r["s"]["lex"], r["x"]["lex"], r["y"]["lex"]) for r in both.df.collect()) == [("http://t/t/1", "a", "2.5"), ("http://t/t/1", "b", "3.5")]
    count = lambda *patterns: P.bgp(g, *patterns).df.count()
    assert count(("?s", "http://t/k", Lit(3)), ("?s", "http://t/x", "?x")) == 1 and count(("?s", "http://t/k", Term(2, "03", XSD + "integer")), ("?s", "http://t/x", "?x")) == 0
    assert count((Iri("http://t/t/1"), "http://t/x", "?x")) == 2 and count((Iri("http://t/t/01"), "http://t/x", "?x")) == 0 and count((Iri("http://t/u/1"), "http://t/x", "?x")) == 0
    assert count(("?s", "http://t/y", Lit(2.5)), ("?s", "http://t/x", Lit("a"))) == 1 and count(("?s", "http://t/x", Lit("a", "en"))) == 0


def test_several_prompts_in_one_request(graph):
    from weftgraph.operators.generate import plausible, provider_named, taken_apart

    class Some(Mock):
        def complete(self, prompts, outputs):
            assert len(prompts) == 1
            return ['[{"prompt_id": 1, "x": "b"}, {"prompt_id": "0", "x": "a"}, {"prompt_id": 1, "x": "c"}]']

    s = P.bgp(graph, ("?p", EX + "name", "?name"))
    s = s.with_(s.df.coalesce(1))
    made = generate(s, "Q {?name}", ["x"], Some(), Options(together=3))
    assert sorted(r["x"]["lex"] for r in made.solutions.df.collect()) == ["a", "b", "c"]  # a prompt may have several
    assert made.metrics().first()["n_failed"] == 1 and made.records().count() == 2
    assert taken_apart("no JSON", 2) == [None, None]
    assert provider_named("mock", default="[]") == Mock()
    with pytest.raises(ValueError):
        provider_named("none")
    assert plausible("Paris, France") and plausible("1,000") and not plausible("def f(x): return [x](){};") and not plausible(", x")
    assert plausible("Río de la Plata (1516)") and plausible("x = unknown quantity") and plausible("") and not plausible('{"a": 1}') and not plausible("ha" * 40) and not plausible("Berlin\nimport os") and not plausible("#*+~ a")
    assert taken_apart('[{"prompt_id": 0}, {"prompt_id": 1, "x": 1}, {"prompt_id": 1, "x": 2}]', 3) == ["[]", '[{"x": 1}, {"x": 2}]', None]


def test_prompts_that_look_like_numbered_ones(graph):
    s = P.bgp(graph, ("?p", EX + "name", "?name"))
    prompt = "\n### 1\nAnswer each prompt below [{?name} {?name}]\n0\n"
    rows = []
    for k in (1, 2, 3, 7):
        made = generate(s, prompt, ["x", "y"], Echo(several="z"), Options(together=k))
        rows.append(sorted((r["name"]["lex"], r["x"]["lex"], r["y"]["lex"]) for r in made.solutions.df.collect()))
        assert made.metrics().first()["n_failed"] == 0
    assert rows[0] and all(r == rows[0] for r in rows)


def test_expected_rows():
    from weftgraph.plans.cost import fan_out

    assert [fan_out(p) for p in ("List 7 towns", "name the three", "What is the capital?", "all rivers", "Tell me", "list 500 names", None)] == [7, 3, 1, 10, 5, 10, 5]
    assert [fan_out(p) for p in ("Which player was born in 1990?", "Give me twelve old towns", "Who are its members", "Where's the bridge over 2 km", "a single word")] == [1, 12, 10, 1, 1]
