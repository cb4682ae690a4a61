"""Boosted-tree delay model on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import existing
from trackwork.functions.factors import clip_delay
from trackwork.operators.features import fill_features, frequency_encode, model_features, with_split

LABEL = "arrival_delay_min"

# Boosting settings.
BOOSTING = {
    "maxIter": 500,
    "maxDepth": 6,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 20,
    "seed": 42,
}


def prepare(df: DataFrame, counts_from: DataFrame | dict[str, DataFrame] | None = None) -> DataFrame:
    """Labelled rows with frequency columns and no missing inputs."""
    labelled = df.where(F.col(LABEL).isNotNull())
    return fill_features(frequency_encode(labelled, counts_from=counts_from))


def feature_stages(df: DataFrame, use_categoricals: bool = True) -> list:
    """Category indexes and the feature vector; an unseen category gets its own code."""
    categories = existing(df, fv.CATEGORY_FEATURES) if use_categoricals else []
    stages = []
    if categories:
        codes = [f"{c}_code" for c in categories]
        stages.append(
            StringIndexer(
                inputCols=categories, outputCols=codes, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
    inputs = [*model_features(df), *(f"{c}_code" for c in categories)]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]


def train(
    df: DataFrame,
    params: dict | None = None,
    use_categoricals: bool = True,
    validation_pct: int = 10,
    key_cols=("train_no", "stop_seq"),
) -> PipelineModel:
    """Fit on prepared rows; a tenth of the keys only decides when to stop adding trees."""
    rows = with_split(df, key_cols, validation_pct, seed=7, name="_validation")
    boosted = GBTRegressor(
        featuresCol="features", labelCol=LABEL, validationIndicatorCol="_validation", **{**BOOSTING, **(params or {})}
    )
    return Pipeline(stages=[*feature_stages(df, use_categoricals), boosted]).fit(rows)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with ``predicted_delay_min``, evaluated in the JVM."""
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn("predicted_delay_min", clip_delay(F.col("prediction"))).drop(*added)


def predictions_daily(scored: DataFrame, run_date=None) -> DataFrame:
    """The prediction table; every run has a date."""
    day = F.lit(fv.RULE_RUN_DATE).cast("date") if run_date is None else run_date
    return scored.select(
        "train_no",
        "station_code",
        "scheduled_hour",
        F.col(LABEL).alias("actual_delay_min"),
        F.col("predicted_delay_min").cast("double").alias("predicted_delay_min"),
        day.alias("run_date"),
        *existing(scored, ("pm25", "zone")),
    )


def error_metrics(df: DataFrame, actual: str = "actual_delay_min", predicted: str = "predicted_delay_min") -> DataFrame:
    """MAE, RMSE and means over all rows, as one row."""
    miss = F.col(actual) - F.col(predicted)
    return df.agg(
        F.round(F.avg(F.abs(miss)), 2).alias("mae_all_rows"),
        F.round(F.sqrt(F.avg(miss * miss)), 2).alias("rmse_all_rows"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.round(F.avg(actual), 2).alias("avg_actual_delay"),
        F.round(F.avg(predicted), 2).alias("avg_predicted_delay"),
    )


def baseline_metrics(
    train_rows: DataFrame, test_rows: DataFrame, actual: str = "actual_delay_min", predicted: str = "predicted_delay_min"
) -> DataFrame:
    """Test error, R2, and the gain over always predicting the training mean."""
    mean = train_rows.agg(F.avg(actual)).scalar()
    miss = F.col(actual) - F.col(predicted)
    sums = test_rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg(miss * miss).alias("_res"),
        F.var_pop(actual).alias("_tot"),
        F.avg(F.abs(F.col(actual) - mean)).alias("baseline_mae"),
    )
    r2 = F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.nullif("_tot", F.lit(0.0))).otherwise(0.0)
    gain = F.try_divide(100 * (F.col("baseline_mae") - F.col("mae")), F.col("baseline_mae"))
    return sums.select("mae", "rmse", r2.alias("r2"), "baseline_mae", gain.alias("improvement_pct"))
