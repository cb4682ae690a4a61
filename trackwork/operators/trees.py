"""A fitted ensemble as tables: scoring by joins, and exact attributions from its leaf paths."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.session import scratch_path
from trackwork.sinks.tables import write_table


def tree_nodes(model: PipelineModel) -> DataFrame:
    """A row per node: tree, weight, node, value, feature, bounds, categorical, yes, no.

    An inner node sends a row to ``yes`` if its feature is at most ``bounds[0]`` or, where the feature is
    categorical, one of ``bounds``. A leaf has null children.
    """
    ensemble = model.stages[-1]
    spark = SparkSession.active()
    path = scratch_path(spark, "ensemble")
    ensemble.write().save(path)
    weights = F.array(*(F.lit(float(w)) for w in ensemble.treeWeights))
    node, split = F.col("nodeData"), F.col("nodeData.split")
    child = lambda c: F.when(node["leftChild"] >= 0, node[c])
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.get(weights, F.col("treeID")).alias("weight"), node["id"].alias("node"),
        node["prediction"].alias("value"), split["featureIndex"].alias("feature"),
        split["leftCategoriesOrThreshold"].alias("bounds"), (split["numCategories"] >= 0).alias("categorical"),
        child("leftChild").alias("yes"), child("rightChild").alias("no"),
    )
    return write_table(nodes.coalesce(1), scratch_path(spark, "tree-nodes"))


def depth_of(model: PipelineModel) -> int:
    return max(tree.depth for tree in model.stages[-1].trees)


def encoded(model: PipelineModel, rows: DataFrame, row_id: str) -> DataFrame:
    """(row_id, x): the model's inputs as an array."""
    return PipelineModel(model.stages[:-1]).transform(rows).select(row_id, vector_to_array("features").alias("x"))


def _goes_yes(x: Column, feature: Column, bounds: Column, categorical: Column) -> Column:
    value = F.get(x, feature)
    return F.when(categorical, F.array_contains(bounds, value)).otherwise(value <= F.get(bounds, F.lit(0)))


def table_scores(nodes: DataFrame, rows: DataFrame, row_id: str, depth: int) -> DataFrame:
    """(row_id, prediction) of ``rows`` (row_id, x), one level of all trees at a time.

    The node table is as large as the model, so each level is a join against a small side.
    """
    roots = nodes.where("node = 0").agg(F.collect_list("tree").alias("trees"))
    trees = F.lit(roots.first()["trees"])  # one number per tree
    at = rows.select(row_id, "x", F.explode(trees).alias("tree"), F.lit(0).alias("node"))
    for _ in range(depth):
        step = F.when(_goes_yes(F.col("x"), F.col("feature"), F.col("bounds"), F.col("categorical")), F.col("yes")).otherwise(F.col("no"))
        at = at.join(nodes, ["tree", "node"]).select(row_id, "x", "tree", F.when(F.col("yes").isNull(), F.col("node")).otherwise(step).alias("node"))
    return at.join(nodes, ["tree", "node"]).groupBy(row_id).agg(F.sum(F.col("weight") * F.col("value")).alias("prediction"))


def leaf_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """A row per leaf: leaf, value (weighted), conditions on the way to it, and the features they ask for."""
    condition = "array<struct<feature:int,bounds:array<double>,categorical:boolean,yes:boolean>>"
    open_ = nodes.where("node = 0").select("tree", "node", F.array().cast(condition).alias("conditions"))
    leaves = []
    for level in range(depth + 1):
        here = open_.join(nodes, ["tree", "node"])
        leaves.append(here.where("yes is null").select("tree", "node", (F.col("weight") * F.col("value")).alias("value"), "conditions"))
        if level == depth:
            break
        sides = F.explode(F.array(*(F.struct(F.col(c).alias("to"), F.lit(c == "yes").alias("yes")) for c in ("yes", "no"))))
        inner = here.where("yes is not null").withColumn("side", sides)
        more = F.struct("feature", "bounds", "categorical", F.col("side.yes").alias("yes"))
        open_ = inner.select("tree", F.col("side.to").alias("node"), F.concat("conditions", F.array(more)).alias("conditions"))
    paths = leaves[0]
    for other in leaves[1:]:
        paths = paths.unionByName(other)
    features = F.array_distinct(F.col("conditions.feature"))
    named = paths.select(F.xxhash64("tree", "node").alias("leaf"), "value", "conditions", features.alias("features"))
    return write_table(named.coalesce(1), scratch_path(nodes.sparkSession, "leaf-paths"))


def _met(x: Column) -> Column:
    """Bits of the path's features whose conditions the row meets."""
    holds = lambda c: _goes_yes(x, c["feature"], c["bounds"], c["categorical"]) == c["yes"]
    bit = lambda f, i: F.when(
        F.forall(F.filter("conditions", lambda c: c["feature"] == f), holds), F.call_function("shiftleft", F.lit(1), i)
    ).otherwise(F.lit(0))
    return F.aggregate(F.transform("features", bit), F.lit(0), lambda total, b: total + b)


def _masks(paths: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, leaf, met) for every row and leaf; all leaves of the model are in one array, which goes to every task."""
    leaf = F.struct("leaf", "conditions", "features")
    model = paths.agg(F.collect_list(leaf).alias("leaves")).withColumn("_whole", F.lit(True))  # one row, as large as the model
    spread = rows.withColumn("_whole", F.lit(True)).join(F.broadcast(model), "_whole").withColumn("l", F.explode("leaves"))
    return spread.select(*keys, "x", "l.*").select(*keys, "leaf", _met(F.col("x")).alias("met"))


def exact_attributions(model: PipelineModel, rows: DataFrame, background: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Exact Shapley values of every row's prediction, features absent taking the values of background rows.

    Columns as of the sampled ``attribute``: row_id, base_value, prediction, feature, contribution. Per leaf,
    a row and a background row matter only by which of the path's features let them pass; so background rows
    of any number are counted by that, and each of the few combinations is weighed once. Row ids are unique.
    """
    names = model.stages[-2].getInputCols()
    depth = depth_of(model)
    paths = leaf_paths(tree_nodes(model), depth)
    spark = rows.sparkSession
    seen = _masks(paths, encoded(model, background.withColumn("_same", F.lit(1)), "_same"))
    seen = write_table(seen.groupBy("leaf", F.col("met").alias("z")).agg(F.count(F.lit(1)).alias("n")), scratch_path(spark, "background-masks"))
    count = background.count()
    if not count:
        raise ValueError("background needs a row at least")
    own = write_table(_masks(paths, encoded(model, rows, row_id), row_id), scratch_path(spark, "row-masks"))

    every = F.call_function("shiftleft", F.lit(1), F.size("features")) - 1
    x, z = F.col("met"), F.col("z")
    only_x, only_z = x.bitwiseAND(F.bitwise_not(z)), z.bitwiseAND(F.bitwise_not(x))
    met = own.select("leaf", "met").distinct().join(paths.select("leaf", "value", "features"), "leaf").join(seen, "leaf")
    met = met.where(x.bitwiseOR(z) == every).withColumns({"a": F.bit_count(only_x), "b": F.bit_count(only_z)})
    met = met.select("leaf", "met", "value", "n", "a", "b", only_x.alias("only_x"), only_z.alias("only_z"), F.posexplode("features").alias("i", "feature"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    orders = F.factorial(F.col("a") + F.col("b"))
    last = F.factorial(F.col("a") - 1) * F.factorial("b") / orders
    first = F.factorial("a") * F.factorial(F.col("b") - 1) / orders
    part = F.when(F.col("only_x").bitwiseAND(bit) != 0, last).when(F.col("only_z").bitwiseAND(bit) != 0, -first)
    shares = met.where(part.isNotNull()).groupBy("leaf", "met", "feature").agg(F.sum(part * F.col("value") * F.col("n") / count).alias("part"))
    gained = own.join(shares, ["leaf", "met"]).groupBy(row_id, "feature").agg(F.sum("part").alias("contribution"))

    reached = F.col("met") == every
    predicted = own.join(paths.select("leaf", "value", "features"), "leaf").groupBy(row_id).agg(F.sum(F.when(reached, F.col("value")).otherwise(0.0)).alias("prediction"))
    base = seen.join(paths.select("leaf", "value", "features"), "leaf").where(z == every).agg((F.sum(F.col("value") * F.col("n")) / count).alias("base_value"))
    listed = predicted.withColumn("_whole", F.lit(True)).join(F.broadcast(base.withColumn("_whole", F.lit(True))), "_whole").select(row_id, "base_value", "prediction", F.posexplode(F.array(*map(F.lit, names))).alias("at", "feature"))
    gained = gained.withColumnRenamed("feature", "at")
    return listed.join(gained, [row_id, "at"], "left").select(row_id, "base_value", "prediction", "feature", F.coalesce("contribution", F.lit(0.0)).alias("contribution"))
