import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from trackwork.catalog import queries
from trackwork.operators import explain, features, model, skew
from trackwork.plans import views

PARAMS = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 1}


@pytest.fixture(scope="module")
def stops(spark):
    i = F.col("id")
    delay = 5 + 20 * (i % 3 == 0).cast("int") + (i % 7) * 2.0
    return spark.range(900).select(
        F.concat(F.lit("t"), i % 30).alias("train_no"), F.concat(F.lit("s"), i % 12).alias("station_code"),
        i.alias("stop_seq"), (i % 24).cast("int").alias("scheduled_hour"),
        F.when(i % 10 != 0, 50.0 + 40 * (i % 3 == 0).cast("int")).alias("pm25"), (i % 7).cast("int").alias("dwell_min"),
        F.when(i % 4 == 0, "Exp").when(i % 4 == 1, "Pass").alias("train_type"), F.lit("SR").alias("zone"),
        delay.alias("arrival_delay_min"),
    )


@pytest.fixture(scope="module")
def fitted(stops):
    train, test = features.hash_split(stops)
    ready = model.prepare(train)
    return model.train(ready, PARAMS), ready, model.prepare(test, counts_from=train)


def test_scores_beat_the_mean(fitted):
    trees, train, test = fitted
    scored = model.score(trees, test)
    assert set(scored.columns) == {*test.columns, "predicted_delay_min"}
    result = model.baseline_metrics(train, scored, model.LABEL, "predicted_delay_min").first()
    assert result.r2 > 0.8
    assert result.improvement_pct > 50
    assert "ArrowEvalPython" not in plan(scored) and "BatchEvalPython" not in plan(scored)


def test_unseen_category(fitted):
    trees, _, test = fitted
    assert model.score(trees, test.withColumn("zone", F.lit("XX"))).where("predicted_delay_min is null").count() == 0


def test_scoring_a_bare_request(fitted, stops, spark):
    trees, _, _ = fitted
    asked = spark.createDataFrame([("t1", "s1", 8), ("new", "new", 23)], "train_no string, station_code string, scheduled_hour int")
    ready = features.complete_features(features.request_features(asked, stops))
    assert model.score(trees, ready).where("predicted_delay_min between 0 and 360").count() == 2


def test_numeric_features_only(stops):
    ready = model.prepare(stops)
    trees = model.train(ready, {**PARAMS, "maxIter": 2}, use_categoricals=False)
    names = trees.stages[-2].getInputCols()
    assert "zone_code" not in names and names[-1] == "station_code_freq"


def test_predictions_table(fitted):
    trees, _, test = fitted
    daily = model.predictions_daily(model.score(trees, test))
    assert daily.columns == [
        "train_no", "station_code", "scheduled_hour", "actual_delay_min", "predicted_delay_min", "run_date", "pm25", "zone",
    ]
    assert views.monthly_delay(daily).first().m == 1


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 4.0)], "actual_delay_min double, predicted_delay_min double")
    assert tuple(model.error_metrics(df).first()) == (1.67, 2.38, 3, 4.0, 3.0)
    out = model.baseline_metrics(df, df).first()
    assert out.mae == pytest.approx(5 / 3)
    assert out.r2 == pytest.approx(1 - 17 / 26)
    assert out.baseline_mae == pytest.approx(8 / 3)
    assert out.improvement_pct == pytest.approx(37.5)
    flat = spark.createDataFrame([(2.0, 2.0)], "actual_delay_min double, predicted_delay_min double")
    assert tuple(model.baseline_metrics(flat, flat).first()) == (0.0, 0.0, 0.0, 0.0, None)


def test_attributions_add_up(fitted):
    trees, train, test = fitted
    sample = features.capped(test, 12, ("train_no", "stop_seq")).withColumn("row_id", F.col("stop_seq"))
    background = features.capped(train, 5, ("train_no", "stop_seq"))
    found = explain.attribute(trees, sample, background)
    sums = found.groupBy("row_id").agg(
        F.sum("contribution").alias("s"), F.first("base_value").alias("b"), F.first("prediction").alias("p"), F.count("*").alias("n")
    )
    width = len(trees.stages[-2].getInputCols())
    rows_found = sums.collect()
    assert len(rows_found) == 12
    for r in rows_found:
        assert r.n == width
        assert r.s == pytest.approx(r.p - r.b)
    mean = trees.transform(background).agg(F.avg("prediction")).first()[0]
    assert {round(r.b, 9) for r in rows_found} == {round(mean, 9)}
    raw = {r.row_id: r.prediction for r in trees.transform(sample).select("row_id", "prediction").collect()}
    assert all(r.p == pytest.approx(raw[r.row_id]) for r in rows_found)

    ranked = explain.importance(found)
    assert ranked.where("rank <= 3").where("feature in ('pm25', 'dwell_min')").count() == 2
    top = explain.waterfall(found, k=3)
    assert top.count() == 36
    assert rows(top.select("rank").distinct()) == [(1,), (2,), (3,)]
    unused = found.where("feature = 'zone_code'").agg(F.max(F.abs("contribution"))).first()[0]
    assert unused == pytest.approx(0, abs=1e-9)


def test_any_number_of_background_rows(fitted, monkeypatch):
    trees, train, test = fitted
    sample = features.capped(test, 3, ("train_no", "stop_seq")).withColumn("row_id", F.col("stop_seq"))
    background = features.capped(train, 8, ("train_no", "stop_seq"))
    sent = rows(explain.attribute(trees, sample, background))
    monkeypatch.setattr(explain, "SENT_BACKGROUND", 2)
    joined = rows(explain.attribute(trees, sample, background))
    assert [r[0] for r in sent] == [r[0] for r in joined]
    assert [r[-1] for r in sent] == pytest.approx([r[-1] for r in joined])
    with pytest.raises(ValueError):
        explain.attribute(trees, sample, background.limit(0))


def test_rule_views(spark):
    df = spark.createDataFrame(
        [("1", "A", "MAS", 160.0, 1), ("2", "A", "MAS", 20.0, 1), ("2", "B", "SBC", 20.0, 0)],
        "train_no string, station_name string, station_code string, pm25 double, is_peak_hour int",
    )
    city = views.with_city(df)
    assert rows(views.rule_predictions(df), "predicted_delay_min") == [(10,), (20,), (45,)]
    assert rows(views.polluted_routes(city)) == [("A", 90.0, 2), ("B", 20.0, 1)]
    assert rows(views.busiest_junction(df)) == [("MAS", 2)]
    assert rows(views.trains_through(city, "a")) == [(2,)]
    assert rows(views.total_trains(df)) == rows(views.total_trains(df, approx=True)) == [(2,)]
    assert rows(views.hazardous_cities(city, 50)) == [(1,)]


def test_forecasts_come_from_a_model_of_all_training_rows(spark, stops, monkeypatch):
    seen = []
    train = model.train
    monkeypatch.setattr(queries, "labelled", lambda spark, sf: stops)
    monkeypatch.setattr(queries.st, "requests", lambda spark, sf: stops.limit(9).withColumnRenamed("stop_seq", "request_id").drop("arrival_delay_min"))
    monkeypatch.setattr(features, "smallest_by_hash", lambda df, key, caps: skew.smallest_by_hash(df, key, [(c, 20) for c, _ in caps]))
    monkeypatch.setattr(model, "train", lambda df, params: seen.append(df.count()) or train(df, {**PARAMS, "maxIter": 2}))
    assert queries.QUERIES["request_forecast"](spark, "whole-forecast").count() == 9
    assert seen == [features.hash_split(stops)[0].count()]
