"""Shapley values by sampled feature orders, scored as ordinary rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwork.operators.skew import top_per_group

#: Background rows up to which a copy goes to every task; more are joined by number.
SENT_BACKGROUND = 200


def attribute(
    model: PipelineModel,
    rows: DataFrame,
    background: DataFrame,
    row_id: str = "row_id",
    permutations: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Contribution of every feature to every row's prediction, against the background mean.

    A row walks from each background row to itself, one feature at a time, in a hashed order
    and in its reverse; each step's change is credited to the feature that moved. The
    contributions of a row add up to its prediction less the base value.
    """
    encode = PipelineModel(model.stages[:-1])
    names = model.stages[-2].getInputCols()
    width = len(names)
    n_background = background.count()
    if not n_background:
        raise ValueError("background needs a row at least")

    base = encode.transform(background).select(vector_to_array("features").alias("_z"))
    base = base.withColumn("_b", F.row_number().over(Window.orderBy("_z")) - 1)
    walks = (
        encode.transform(rows)
        .select(row_id, vector_to_array("features").alias("_x"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_background - 1))))
        .withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .join(F.broadcast(base) if n_background <= SENT_BACKGROUND else base, "_b")
    )
    features = F.sequence(F.lit(0), F.lit(width - 1))
    keyed = F.transform(
        features, lambda i: F.struct(F.xxhash64(row_id, "_b", "_p", F.lit(seed), i).alias("h"), i.alias("i"))
    )
    order = F.array_sort(keyed)["i"]
    walks = walks.withColumn("_order", F.explode(F.array(order, F.reverse(order))))
    mixed = F.transform(
        F.sequence(F.lit(0), F.lit(width)),
        lambda s: F.struct(
            s.alias("step"),
            F.transform(
                "_x",
                lambda x, i: F.when(F.array_position("_order", i) <= s, x).otherwise(F.get("_z", i)),
            ).alias("v"),
        ),
    )
    steps = walks.select(row_id, "_order", F.explode(mixed).alias("_s")).select(
        row_id,
        F.col("_s.step").alias("_step"),
        F.get("_order", F.col("_s.step") - 1).alias("_gained"),
        F.get("_order", F.col("_s.step")).alias("_next"),
        array_to_vector("_s.v").alias("features"),
    )
    y = F.col("prediction")
    walked = 2 * permutations * n_background
    credit = [
        (
            (
                F.sum(F.when(F.col("_gained") == i, y).otherwise(0.0))
                - F.sum(F.when(F.col("_next") == i, y).otherwise(0.0))
            )
            / walked
        ).alias(name)
        for i, name in enumerate(names)
    ]
    wide = model.stages[-1].transform(steps).groupBy(row_id).agg(
        F.avg(F.when(F.col("_step") == 0, y)).alias("base_value"),
        F.avg(F.when(F.col("_step") == width, y)).alias("prediction"),
        *credit,
    )
    return wide.unpivot([row_id, "base_value", "prediction"], list(names), "feature", "contribution")


def importance(attributions: DataFrame) -> DataFrame:
    """Features by mean absolute contribution, rank 1 first."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    # One row per model feature, so a single ordered window is small.
    order = Window.orderBy(F.desc("importance"), "feature")
    return means.withColumn("rank", F.row_number().over(order))


def waterfall(attributions: DataFrame, row_id: str = "row_id", k: int = 12) -> DataFrame:
    """The k largest signed contributions per row."""
    order = [F.abs("contribution").desc(), F.col("feature")]
    return top_per_group(attributions, [row_id], order, k)
