"""Vector codes against a plain version, and the edges of their input."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries, vector_codes
from weftgraph.llm.staging import Staging


def plain(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label). Python integers all the way."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)] if e in groups else c for e, c in enumerate(books[p])]
    out, by_label = {}, defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab)
        by_label[lab] += out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return {i: (code, err, by_label[lab], digest) for i, (code, err, lab) in out.items()}


def result(spark, df, **kw):
    coded, books = vector_codes.compress(df, keep=["vec_id", "label"], **kw)
    rows = vector_codes.with_label_error(coded, Staging(spark)).collect()
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], books.digest()) for r in rows}


def test_codes_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 2, 32).round(2)], int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(150)]
    rows += [(900, None, 1), (901, [1.0] * 31 + [float("nan")], 1), (902, [float("inf")] * 32, 0), (903, [None] + [0.5] * 31, 2)]
    rows += [(904, rows[0][1], 1), (905, [0.0] * 32, 1), (906, [2.0**18] * 32, None), (907, [-(2.0**18)] * 32, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    assert result(spark, df) == plain(rows)
    few = rows[:9]
    assert result(spark, spark.createDataFrame(few, df.schema)) == plain(few)


def test_products_are_exact_for_large_integers():
    rng = np.random.default_rng(5)
    for high in (200, 1 << 20, 1 << 27):
        x, c = rng.integers(-high, high, (40, 7)), rng.integers(-high, high, (9, 7))
        want = [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert vector_codes.exact_products(x, c).tolist() == want
    book = np.array([[3, 0], [1, 0], [1, 0], [-1, 0]])
    assert vector_codes.assign(np.array([[0, 0], [2, 0]]), book)[0].tolist() == [1, 0]  # the first of equally near ones


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, __row int, __label int, v string"
    empty, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert books is None and empty.count() == 0
    rows = [(1, [0.5] * 16, 1, "x", 7, 8, "y"), (1, [0.5] * 16, 1, "x", 7, 8, "y"), (None, [1.5] * 16, None, None, None, None, None), (2, [0.1] * 8, 1, "", 1, 1, ""), (3, [], 1, "", 1, 1, ""), (4, [1e30] * 16, 1, "", 1, 1, "")]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, schema), rounds=0)
    got = sorted((tuple(r) for r in vector_codes.with_label_error(coded, Staging(spark)).collect()), key=repr)
    assert books.entries == 3 and coded.columns == ["vec_id", "label", "__row", "__label", "v", "code", "error"]
    assert got[:2] == [(1, 1, 7, 8, "y", "00" * 16, 0, got[0][-1])] * 2
    assert [(r[0], r[5], r[6]) for r in got[2:]] == [(4, "02" * 16, 0), (None, "00" * 16, 16 * 256**2)] and got[3][-1] == 16 * 256**2
    assert got[0][-1] == 0  # label 1: its vectors are entries
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 5)], "vec_id long, embedding array<float>"))


def test_decoded_vectors_have_the_stated_error(spark, sf):
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"), keep=["vec_id", "embedding"])
    for r in coded.orderBy("vec_id").limit(50).collect():
        x = np.floor(256 * np.array(r["embedding"], dtype=np.float64)).astype(np.int64)
        assert int(((x - vector_codes.decode(r["code"], books)) ** 2).sum()) == r["error"]


def test_query_against_sql(spark, sf):
    got = queries.op13_vector_codes(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op13_vector_codes"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()} == plain(rows)
