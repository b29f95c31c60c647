"""Queries that SQL can't express: what must hold of their rows."""

import math

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, DIR).collect()


def test_sample(spark):
    got = [r["c_custkey"] for r in rows(spark, "sample_rows")]
    known = {r["c_custkey"] for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    assert len(got) == len(set(got)) == 50 and set(got) <= known and got == [r["c_custkey"] for r in rows(spark, "sample_rows")]


def test_clusters(spark):
    got = rows(spark, "embedding_clusters")
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    assert sorted(r["vec_id"] for r in got) == sorted(vectors) and len({r["cluster"] for r in got}) == 5
    by_cluster = {}
    for r in got:
        by_cluster.setdefault(r["cluster"], []).append(vectors[r["vec_id"]])
    mean = lambda v: [sum(x) / len(v) for x in zip(*v, strict=True)]
    spread = lambda v: sum(math.dist(x, mean(v)) ** 2 for x in v)
    assert sum(map(spread, by_cluster.values())) < spread(list(vectors.values()))


def test_approximations(spark):
    exact = {r["l_returnflag"]: r for r in spark.sql(f"SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, percentile(l_extendedprice, 0.5) AS median FROM parquet.`{DIR}/lineitem.parquet` GROUP BY 1").collect()}
    for r in rows(spark, "approximate_aggregates"):
        want = exact[r["l_returnflag"]]
        assert abs(r["parts"] / want["parts"] - 1) < 0.15 and abs(r["median"] / want["median"] - 1) < 0.05


def test_models_beat_chance(spark):
    for name in ("linear_model_metrics", "tree_model_metrics"):
        (r,) = rows(spark, name)
        assert r["rmse"] > 0 and math.isfinite(r["r2"]) and 0 <= r["sign_accuracy"] <= 1
