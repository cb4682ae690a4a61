"""Node tables and exact attributions against DuckDB and brute force over all subsets of features."""

import random
from itertools import combinations
from math import factorial

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from trackwork.operators import explain, trees

INPUTS = ["a", "b", "c_code", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a, b, c, d = rng.randrange(6), rng.random(), rng.choice("pqrst"), float(rng.randrange(3))
        rows.append((i, float(a), b, c, d, a * (c in "pr") + 3 * (b > 0.5) - d * (c == "s") + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "row_id int, a double, b double, c string, d double, y double")


@pytest.fixture(scope="module")
def fitted(data):
    codes = StringIndexer(inputCols=["c"], outputCols=["c_code"], handleInvalid="keep")
    boosted = GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, stepSize=0.5, seed=1)
    return Pipeline(stages=[codes, VectorAssembler(inputCols=INPUTS, outputCol="features"), boosted]).fit(data)


@pytest.fixture(scope="module")
def nodes(fitted):
    return trees.tree_nodes(fitted)


def test_scores_by_joins_equal_the_model(fitted, nodes, data):
    mine = trees.table_scores(nodes, trees.encoded(fitted, data, "row_id"), "row_id", trees.depth_of(fitted)).collect()
    own = {r.row_id: r.prediction for r in fitted.transform(data).collect()}
    assert len(mine) == 400 and all(r.prediction == pytest.approx(own[r.row_id], abs=1e-12) for r in mine)


def test_another_engine_scores_the_node_table(fitted, nodes, data):
    con = duckdb.connect()
    con.register("node", nodes.toPandas())
    con.register("given", trees.encoded(fitted, data, "row_id").toPandas())
    found = con.execute("""
        WITH RECURSIVE walk AS (
            SELECT row_id, x, tree, 0 AS at FROM given, (SELECT DISTINCT tree FROM node)
            UNION ALL
            SELECT row_id, x, w.tree,
                   CAST(CASE WHEN CASE WHEN categorical THEN list_contains(bounds, x[feature + 1]) ELSE x[feature + 1] <= bounds[1] END THEN yes ELSE no END AS INT)
            FROM walk w JOIN node n ON n.tree = w.tree AND n.node = w.at WHERE yes IS NOT NULL AND NOT isnan(yes)
        )
        SELECT row_id, sum(weight * value) FROM walk w JOIN node n ON n.tree = w.tree AND n.node = w.at
        WHERE yes IS NULL OR isnan(yes) GROUP BY row_id""").fetchall()
    own = {r.row_id: r.prediction for r in fitted.transform(data).collect()}
    assert len(found) == 400 and all(p == pytest.approx(own[i], abs=1e-9) for i, p in found)


def brute(fitted, x, background, spark):
    """Shapley values from the mean prediction for every subset of features kept."""
    width = len(INPUTS)
    subsets = [s for n in range(width + 1) for s in combinations(range(width), n)]
    mixed = [(i, [float(x[f] if f in s else z[f]) for f in range(width)]) for i, s in enumerate(subsets) for z in background]
    from pyspark.ml.functions import array_to_vector

    frame = spark.createDataFrame(mixed, "i int, v array<double>").withColumn("features", array_to_vector("v"))
    mean = {subsets[r.i]: r.m for r in fitted.stages[-1].transform(frame).groupBy("i").agg(F.avg("prediction").alias("m")).collect()}
    out = []
    for f in range(width):
        total = 0.0
        for s in subsets:
            if f not in s:
                weight = factorial(len(s)) * factorial(width - len(s) - 1) / factorial(width)
                total += weight * (mean[tuple(sorted((*s, f)))] - mean[s])
        out.append(total)
    return mean[()], out


def test_exact_attributions_equal_brute_force(fitted, data, spark):
    rows, background = data.where("row_id in (3, 77, 200)"), data.where("row_id % 19 = 5")
    found = trees.exact_attributions(fitted, rows, background).collect()
    arrays = {r.row_id: r.x for r in trees.encoded(fitted, data, "row_id").collect()}
    others = [arrays[r.row_id] for r in background.collect()]
    own = {r.row_id: r.prediction for r in fitted.transform(rows).collect()}
    assert len(found) == 3 * len(INPUTS)
    for i in (3, 77, 200):
        base, want = brute(fitted, arrays[i], others, spark)
        got = {r.feature: r for r in found if r.row_id == i}
        assert [got[name].contribution for name in INPUTS] == pytest.approx(want, abs=1e-9)
        assert got["a"].base_value == pytest.approx(base) and got["a"].prediction == pytest.approx(own[i])


def test_the_sampled_walk_comes_near(fitted, data):
    rows, background = data.where("row_id < 10"), data.where("row_id % 40 = 1")
    exact = {(r.row_id, r.feature): r.contribution for r in trees.exact_attributions(fitted, rows, background).collect()}
    walked = {(r.row_id, r.feature): r.contribution for r in explain.attribute(fitted, rows, background, permutations=12).collect()}
    assert exact.keys() == walked.keys()
    assert np.mean([abs(exact[k] - walked[k]) for k in exact]) < 0.05 * np.mean([abs(v) for v in exact.values()])


def test_stumps_and_empty_background(data):
    flat = data.withColumn("y", F.lit(2.0))
    codes = StringIndexer(inputCols=["c"], outputCols=["c_code"], handleInvalid="keep")
    model = Pipeline(stages=[codes, VectorAssembler(inputCols=INPUTS, outputCol="features"), GBTRegressor(labelCol="y", maxIter=2)]).fit(flat)
    found = trees.exact_attributions(model, data.where("row_id < 2"), data.where("row_id > 390")).collect()
    assert [(r.base_value, r.prediction, r.contribution) for r in found] == [(2.0, 2.0, 0.0)] * 8
    with pytest.raises(ValueError):
        trees.exact_attributions(model, data, data.where("false"))
