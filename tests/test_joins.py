"""Vector index, edit distance join and joins on several generated variables against all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import edits
from weftgraph.operators import patterns as P
from weftgraph.operators import similarity as S
from weftgraph.operators.edits import edit_matches
from weftgraph.operators.vectors import build_index, search
from weftgraph.sources.graph import TableMapping, table_graph
from weftgraph.sources.terms import LITERAL, RDFS_LABEL, TERM


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_similarity(a, b):
    if a == b:
        return 1.0
    if a.strip().lower() == b.strip().lower():
        return 0.98
    return 1 - distance(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("theta", [0.3, 0.55, 0.75, 0.9, 1.0])
def test_edit_matches_equal_all_pairs(spark, theta):
    r = random.Random(int(100 * theta))
    words = ["".join(r.choice("abcé ") for _ in range(n)) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 12, 20) for _ in range(2)] + ["Messi", " messi ", "MESSI", "Lionel Messi", "Lionel  Mesi"]

    def typed(w):
        w = list(w)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(["", "x", "a", "ab"])
        return "".join(w)

    left, right = words, [typed(w) for w in words for _ in range(3)] + [None]
    got = edit_matches(spark.createDataFrame([(w,) for w in left] + [(None,)], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), theta).collect()
    want = {(a, b): edit_similarity(a, b) for a in left for b in right if b is not None and edit_similarity(a, b) >= theta - 1e-12}
    assert len(got) == len(want)
    assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in got} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("theta", [0.72, 0.85, 0.9, 0.97])
def test_edit_matches_of_texts_made_of_few_parts(spark, theta, monkeypatch):
    """Pairs at every length about the bounds for halves equal all pairs, and frequent grams make no pairs of their own."""
    r = random.Random(int(1000 * theta))
    made = lambda: " ".join([r.choice(["LARGE", "SMALL", "ÜBER"]), r.choice(["hot ring", "old bolt", "cold gear", "é"]), f"B#{r.randrange(1, 26)}"])[r.randrange(3) :] + "z" * r.choice([0, 0, 0, 9, 30])

    def typed(w):
        for _ in range(r.randrange(5)):
            at = r.choice([0, 1, len(w) // 2, len(w) // 2 + 1, len(w) - 1, len(w), r.randrange(len(w) + 1)])
            w = w[:at] + r.choice(["", "x", "q", "xy"]) + w[at + r.randrange(3) :]
        return w

    left = {made() for _ in range(110)}
    right = {typed(made()) for _ in range(140)} | {typed(w) for w in left}
    by_grams = []
    monkeypatch.setattr(edits, "_candidates", lambda a, b, *more, old=edits._candidates: by_grams.extend([*a.collect(), *b.collect()]) or old(a, b, *more))
    got = edit_matches(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), theta).collect()
    want = {(a, b): edit_similarity(a, b) for a in left for b in right if edit_similarity(a, b) >= theta - 1e-12}
    assert len(got) == len(want) and len(want) > 20
    assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in got} == {k: round(v, 9) for k, v in want.items()}
    assert all(len(t) < edits.LEAST or (1 - theta) * len(t) / theta + 1e-9 >= edits.MOST + 1 for (t,) in by_grams)


@pytest.mark.parametrize("cells", [1, 7, None])
def test_index_equals_all_pairs(spark, cells):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 5))
    x = centers[rng.integers(0, 6, 700)] + 0.1 * rng.normal(size=(700, 5))
    x[5], x[6], x[9] = x[7], 3 * x[7], -x[7]
    ids = [f"i{k:03d}" for k in range(700)]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [("z", [0.0] * 5), ("n", None), ("w", [1.0] * 4), ("inf", [float("inf")] * 5)]
    index = build_index(spark.createDataFrame(rows, "id string, v array<double>").repartition(3), cells=cells)
    q = np.concatenate([x[:40], rng.normal(size=(30, 5))])
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)] + [(1000, [0.0] * 5), (1001, None)], "q long, v array<double>").repartition(2)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.clip(unit(q) @ unit(x).T, 0, 1)
    for k, theta in ((1, 0.0), (5, 0.0), (3, 0.98), (None, 0.9), (900, 0.0)):
        got = {}
        for r in search(queries, index, k, theta).collect():
            got.setdefault(r["q"], []).append((r["similarity"], r["id"]))
        for i in range(len(q)):
            found = sorted(got.get(i, []), key=lambda s: (-s[0], s[1]))
            want = sorted(((cos[i, j], ids[j]) for j in range(700) if cos[i, j] >= theta), key=lambda s: (-round(s[0], 12), s[1]))[: k or 700]
            assert len(found) == len(want) and np.allclose([s for s, _ in found], [s for s, _ in want])
            if k is None:
                assert {j for _, j in found} == {j for _, j in want}
        assert not got.keys() & {1000, 1001}
    assert build_index(spark.createDataFrame([("z", [0.0])], "id string, v array<double>")) is None


def test_pruning_skips_blocks(spark):
    rng = np.random.default_rng(2)
    centers = np.eye(8)
    x = centers[np.arange(4000) % 8] + 0.01 * rng.normal(size=(4000, 8))
    index = build_index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), cells=16)
    asked = spark.createDataFrame([(0, x[0].tolist())], "q long, v array<double>")
    plan = search(asked, index, None, 0.999)
    assert plan.count() > 100
    cells = {r[0] for r in index.blocks.select("cell").distinct().collect()}
    assert len(cells) > 8


def test_vectors_with_words_for_the_rest(spark):
    texts = {"red car": [1.0, 0.0], "crimson auto": [0.99, 0.05], "blue boat": [0.0, 1.0], "old red car": None, "navy ship": [0.05, 0.99]}
    vectors = spark.createDataFrame(list(texts.items()), "text string, v array<double>")
    left, right = spark.createDataFrame([("red car",), ("old red car",), ("navy ship",)], "a string"), spark.createDataFrame([("crimson auto",), ("red car",), ("red car old",), ("blue boat",), ("old red car",)], "b string")
    got = {(r["a"], r["b"]): (round(r["similarity"], 3), r["reason"]) for r in S.text_matches(left, right, 0.6, "vectors", vectors).collect()}
    cos = lambda a, b: round(float(np.dot(texts[a], texts[b]) / np.linalg.norm(texts[a]) / np.linalg.norm(texts[b])), 3)
    assert got == {
        ("red car", "red car"): (1.0, "equal"), ("old red car", "old red car"): (1.0, "equal"), ("red car", "crimson auto"): (cos("red car", "crimson auto"), "vectors"), ("navy ship", "blue boat"): (cos("navy ship", "blue boat"), "vectors"),
        ("red car", "red car old"): (0.667, "words"), ("red car", "old red car"): (0.667, "words"), ("old red car", "red car"): (0.667, "words"), ("old red car", "red car old"): (1.0, "words"),
    }
    with pytest.raises(ValueError):
        S.text_matches(left, right, 0.5, "vectors")


def solutions(spark, rows, names, generated, maybe=()):
    term = lambda x: None if x is None else (0, x, None, None) if x.startswith("http") else (LITERAL, x, "http://www.w3.org/2001/XMLSchema#string", None)
    from pyspark.sql.types import StructField, StructType

    return P.Solutions(spark.createDataFrame([tuple(map(term, r)) for r in rows], StructType([StructField(n, TERM) for n in names])), frozenset(maybe), frozenset(generated))


def test_several_generated_variables_equal_all_pairs(spark):
    """Graph terms and generated texts on both sides, unbound ones too, against a comparison of all pairs of rows."""
    r = random.Random(6)
    names = {f"http://n/{k}": f"{a} {b}" for k, (a, b) in enumerate(itertools.product(["New", "Old", "Great"], ["York town", "Lake town", "Ford"]))}
    graph = table_graph({"n": spark.createDataFrame([(i.rpartition("/")[2], t) for i, t in names.items()], "k string, label string")}, {"n": TableMapping(("k",), label="label")}, base="http://")
    iris = [i for i in names]
    assert graph.of(RDFS_LABEL).select("s.lex").first()[0] in iris
    texts = [t.lower() for t in names.values()] + ["york new town", "ford", "great lake", "nowhere"]
    pick = lambda pool, n: [(r.choice(pool), r.choice(pool), r.choice(iris)) for _ in range(n)]
    cases = [
        (pick(iris, 25), pick(texts, 30), (), ("x", "y")),
        (pick(texts, 25), pick(texts, 30), ("x", "y"), ("x", "y")),
        (pick(iris, 20) + pick(texts, 10), pick(iris, 10) + pick(texts, 20), ("x",), ("x", "y")),
        ([(None if r.random() < 0.2 else a, b, c) for a, b, c in pick(iris, 25)], [(a, None if r.random() < 0.2 else b, c) for a, b, c in pick(texts, 25)], (), ("x", "y")),
    ]
    generated_text = lambda t, v, of: t is not None and v in of and not t.startswith("http")

    def jac(a, b):
        a, b = set(a.lower().split()), set(b.lower().split())
        return len(a & b) / len(a | b)

    def agree(p, m, v, pg, mg, theta):
        if p is None or m is None:
            return True
        g, h = generated_text(p, v, pg), generated_text(m, v, mg)
        if not g and not h:
            return p == m
        text = lambda t: names.get(t, t)
        return jac(text(p), text(m)) >= theta

    for left, right, pg, mg in cases:
        maybe = [{n for k, n in enumerate("xyz") if any(row[k] is None for row in rows)} for rows in (left, right)]
        a, b = solutions(spark, left, ["x", "y", "z"], pg, maybe[0]), solutions(spark, right, ["x", "y", "z"], mg, maybe[1])
        for theta in (0.6, 1.0):
            want = []
            for p in left:
                for m in right:
                    if p[2] == m[2] and all(agree(p[k], m[k], v, pg, mg, theta) for k, v in enumerate("xy")):
                        row = []
                        for k, v in enumerate("xy"):
                            x, y = p[k], m[k]
                            row.append(y if x is None else x if y is None or not generated_text(x, v, pg) or generated_text(y, v, mg) else y)
                        want.append((*row, p[2]))
            got = S.similarity_join(a, b, graph, theta).df.select("x.lex", "y.lex", "z.lex").collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), (theta, pg, mg)
    assert math.isclose(jac("a b", "b a"), 1)
    assert S.similarity_join(a.with_(a.df.limit(0)), b, graph).df.count() == 0 and F is not None


def test_texts_of_frequent_words_meet_seldom(spark):
    """Words that many texts hold, each in few of the same sets: the pairs that meet stay near the matching ones."""
    rng = random.Random(7)
    texts = {f"{rng.choice('abcdefgh')}1 {rng.choice('abcdefgh')}2 K{rng.randrange(6)} of Brand#{rng.randrange(25)} sold by the piece, at retail price, in size {rng.randrange(50)}" for _ in range(3000)}
    a, b = (spark.createDataFrame([(t,) for t in sorted(texts)], f"{c} string") for c in "ab")
    found = {(r["a"], r["b"]) for r in S.matching_texts(a, b, 0.85).collect()}
    words = {t: set(t.lower().split()) for t in texts}
    some = sorted(texts)[:40]
    assert {(x, y) for x in some for y in texts if len(words[x] & words[y]) >= 0.85 * len(words[x] | words[y])} == {p for p in found if p[0] in set(some)}
    assert S._meetings(a, b, 0.85).count() < 10 * len(found)


@pytest.mark.parametrize("theta", [0.3, 0.5, 0.85, 1.0])
def test_words_of_short_and_long_texts(spark, theta):
    rng = random.Random(5)
    words = [f"W{i}" for i in range(12)] + [f"v{i}" for i in range(30)]
    left = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 5, 8, 15, 20, 24, 25, 26, 30]))) for _ in range(60)]
    right = [" ".join([w for w in t.split(" ") if rng.random() < 0.95] + ["v3"] * rng.randrange(2)) for t in left for _ in range(2)]
    got = sorted((r["a"], r["b"]) for r in S.matching_texts(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), theta).collect())
    of = lambda t: set(t.lower().strip().split(" "))
    assert got == sorted((a, b) for a in set(left) for b in set(right) if a == b or len(of(a) & of(b)) / len(of(a) | of(b)) >= theta - 1e-12)


def test_rows_of_several_variables_meet_where_all_agree(spark, monkeypatch):
    """Rows of the same terms are matched once, whatever their number: only different combinations are written as such."""
    term = lambda c, kind=LITERAL: F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.col(c).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
    rows = spark.range(600).select(F.concat(F.lit("row "), "id").alias("r"), F.concat(F.lit("place "), F.col("id") % 2).alias("u"), F.concat(F.lit("kind "), F.col("id") % 3).alias("v")).withColumns({"up": F.upper("u"), "vp": F.upper("v")})
    pattern = P.Solutions(rows.select(term("r").alias("r"), term("u").alias("u"), term("v").alias("v")))
    made = P.Solutions(rows.select(term("r").alias("t"), term("up").alias("u"), term("vp").alias("v")), generated=frozenset({"u", "v"}))
    written = {}
    plain = S.save
    monkeypatch.setattr(S, "save", lambda df, name: written.setdefault(name, plain(df, name)) if name == "combos" else plain(df, name))
    g = table_graph({"n": spark.createDataFrame([("1", "one")], "k string, label string")}, {"n": TableMapping(("k",), label="label")})
    out = S.similarity_join(pattern, made, g, 0.85).df
    assert out.count() == 600 * 100
    assert written["combos"].count() == 6


def test_products_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(P, "PRODUCT_ROWS", 100)
    a, b = (P.Solutions(spark.range(n).coalesce(1).toDF(c)) for n, c in ((50, "x"), (40, "y")))
    for pairs in (P.product(a, b), P.product(b, a), P.product(a, b, 45)):
        rows = [r[0] for r in pairs.df.select(F.spark_partition_id()).collect()]
        assert len(rows) == 2000 and max(map(rows.count, set(rows))) <= 500


def test_search_by_few_distances_at_once(spark, monkeypatch):
    """Distances from pivots are held for few vectors at once, with the same results."""
    from weftgraph.operators import vectors

    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))]
    table = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    asked = table.where("id % 20 = 0").withColumnRenamed("id", "q")
    monkeypatch.setattr(vectors, "_DISTANCES", 16)
    got = sorted((r["q"], r["id"]) for r in search(asked, build_index(table, cells=5), 3).collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert got == sorted((q, int(i)) for q in range(0, 400, 20) for i in np.argsort(-(x @ x[q]), kind="stable")[:3])
