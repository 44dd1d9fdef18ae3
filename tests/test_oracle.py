"""Each registered query of the library against its SQL."""

import math

import duckdb
import pytest

from weftgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.8g}")
    return x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = [tuple(map(plain, r)) for r in cursor.fetchall()]
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_token_cost_of_every_document(spark, sf, duck):
    assert catalogue.QUERIES["gen_token_cost_all"](spark, sf).count() == duck.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_threshold_asks_with_each_twentieth_vector(spark, sf):
    got = {r["q"] for r in catalogue.QUERIES["cosine_threshold_all"](spark, sf).collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}


def test_embedding_text_rounds_as_its_sql(spark, tmp_path, duck):
    """Exact ties of the sixth decimal, components that are null or not finite, and vectors without any."""
    rows = [(1, [0.0078125, 0.0234375, -0.0078125]), (2, [None, -0.0, float("nan"), float("inf"), 1e30]), (3, []), (4, [None]), (5, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["v"] for r in catalogue.QUERIES["gen_embedding_text"](spark, str(tmp_path)).collect()}
    sql = catalogue.ORACLE_SQL["gen_embedding_text"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(duck.execute(sql).fetchall())
    assert got[1] == "0.007812,0.023438,-0.007812"
