"""Every query with an oracle against DuckDB, and hand-computed values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from facetta.functions import vectors
from facetta.operators import retrieval as R
from facetta.plans import catalog
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, sf, con, name):
    assert compare(spark, con, sf, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_distances_by_hand(spark):
    row = spark.sql("select array(1, 2, 3) a, array(2, 2, 1) b")
    value = lambda c: row.select(c(F.col("a"), F.col("b")).alias("x")).first().x
    assert value(vectors.euclidean) == pytest.approx(2.236068, abs=1e-6)
    assert value(vectors.l1) == 3 and value(vectors.intersection) == 4
    assert value(vectors.chi2) == pytest.approx(4 / 3, abs=1e-6)
    assert value(vectors.hellinger) == pytest.approx(5.146264, abs=1e-6)
    assert value(vectors.cosine) == pytest.approx(0.198216, abs=1e-6)
    assert spark.sql("select array(5L, -1L) a, array(4L, 0L) b").select(vectors.hamming(F.col("a"), F.col("b")).alias("x")).first().x == 65


def test_ratio_by_hand(spark):
    q = spark.createDataFrame([(1, 7, [0.0, 0.0]), (2, 7, [10.0, 0.0])], "vec_id long, label int, embedding array<double>")
    g = spark.createDataFrame([(11, 1, [0.0, 1.0]), (12, 1, [0.0, 4.0]), (13, 1, [9.0, 0.0]), (14, 1, [14.0, 0.0]), (15, 2, [0.0, 0.0])], "vec_id long, label int, embedding array<double>")
    got = {(r.q_image, r.db_image): r.score for r in R.ratio_matches(q, g, "label", 0.5).collect()}
    assert got == {(7, 1): 1.0, (7, 2): 0.0}


def test_knn_against_columns(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = rows.where("vec_id % 100 = 0")
    got = {(r.query_id, r.rnk): r.db_id for r in R.knn(queries, rows.repartition(5), 3, "l1").collect()}
    data = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    for q in (r.vec_id for r in queries.collect()):
        near = sorted((round(float(np.abs(data[q] - v).sum()), 9), i) for i, v in data.items() if i != q)[:3]
        assert [got[(q, k)] for k in (1, 2, 3)] == [i for _, i in near]


def test_borda_and_rejection(spark):
    rank = lambda rows: spark.createDataFrame(rows, "query_id long, db_id long, rank int")
    one = rank([(1, 5, 0), (1, 6, 1), (1, 7, 2)])
    assert [r.db_id for r in R.borda([(one, 1.0)]).orderBy("rnk").collect()] == [5, 6, 7]
    two = rank([(1, 7, 0), (1, 6, 1), (1, 5, 2)])
    assert [r.db_id for r in R.borda([(one, 1.0), (two, 3.0)]).orderBy("rnk").collect()] == [7, 6, 5]
    near = spark.createDataFrame([(1, 0.2), (2, 0.9)], "query_id long, dist double")
    said = {r.query_id: (r.votes, r.accepted) for r in R.votes([(near, F.col("dist") < 0.5), (near, F.col("dist") < 0.1)]).collect()}
    assert said == {1: (1, True), 2: (0, False)}


def test_same_result_for_other_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    once = sorted(map(tuple, catalog.queries()["borda_fusion_top10"](spark, sf).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, catalog.queries()["borda_fusion_top10"](spark, sf).collect())) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
