import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from trackwork.operators import features, skew
from trackwork.operators.labels import label_delays
from trackwork.plans import quality


def people(spark, n=4000):
    delay = F.when(F.col("id") % 5 == 0, 40.0).otherwise(3.0) + F.col("id") / 10000
    return spark.range(n).select(
        F.concat(F.lit("t"), F.col("id") % 50).alias("train_no"), F.col("id").alias("stop_seq"), delay.alias("arrival_delay_min")
    )


def test_split_is_stable_and_disjoint(spark):
    df = people(spark)
    train, test = features.hash_split(df)
    again, _ = features.hash_split(df.repartition(8))
    assert rows(train) == rows(again)
    assert sorted(rows(train) + rows(test)) == sorted(rows(df))
    assert 0.77 < train.count() / df.count() < 0.83


def test_date_split(spark):
    df = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-10')) AS d")
    train, test = features.date_split(df, "d", F.lit("2024-01-08").cast("date"))
    assert (train.count(), test.count()) == (7, 3)


def test_stratified_cap(spark):
    df = people(spark)
    sample = features.stratified_cap(df, cap=1000)
    assert sample.where("arrival_delay_min <= 30").count() == 800
    assert sample.where("arrival_delay_min > 30").count() == 200
    assert rows(sample) == rows(features.stratified_cap(df.repartition(6), cap=1000))
    whole = features.stratified_cap(df, cap=1_000_000)
    assert rows(whole) == rows(df)


def test_cap_with_copies(spark):
    df = spark.createDataFrame([("a", 1, 5.0)] * 700 + [(f"b{i}", i, 5.0) for i in range(300)], "train_no string, stop_seq int, d double")
    for n in (1, 10, 650, 999, 1000, 2000):
        assert features.capped(df, n, ("train_no", "stop_seq")).count() == min(n, 1000)


def test_hash_sample(spark):
    df = people(spark, 40_000)
    assert 120 < features.hash_sample(df).count() < 280
    assert features.hash_sample(df, fraction=0.5, cap=77).count() == 77


def test_frequency_encode(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "train_no string, station_code string")
    out = rows(features.frequency_encode(df), "train_no", "station_code", "train_no_freq", "station_code_freq")
    assert out == [("a", "x", 2.0, 3.0), ("a", "y", 2.0, 1.0), ("b", "x", 1.0, 3.0), (None, "x", 1.0, 3.0)]
    seen = features.frequency_encode(df, ("train_no",), counts_from=df.where("train_no = 'a'"))
    assert rows(seen, "train_no", "train_no_freq")[2] == ("b", 1.0)


def test_rows_are_not_dealt_by_a_column_of_few_values(spark):
    seen = spark.range(20_000).select(F.lit("t").alias("train_no"), (F.col("id") % 3).cast("string").alias("station_code"))
    df = spark.createDataFrame([("t", "1"), ("u", "9")], "train_no string, station_code string").repartition(2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = features.frequency_encode(df.crossJoin(spark.range(2_000)), counts_from=seen)
        assert plan(out).count("BroadcastHashJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = features.value_counts(seen)
    assert rows(features.frequency_encode(df, counts_from=counts)) == rows(features.frequency_encode(df, counts_from=seen))
    assert rows(features.frequency_encode(df, counts_from=counts), "train_no_freq", "station_code_freq") == [(1.0, 1.0), (20000.0, 6667.0)]


def test_index_categories(spark):
    df = spark.createDataFrame([("SR",), ("CR",), ("SR",), (None,)], "zone string")
    assert rows(features.index_categories(df)) == [("CR", 0), ("SR", 1), ("SR", 1), (None, -1)]


def test_request_features(spark):
    history = spark.createDataFrame([("1", "MAS"), ("1", "X")], "train_no string, station_code string")
    asked = spark.createDataFrame(
        [("1", "MAS", 8, 120.0), ("2", "PUNE", 21, None)], "train_no string, station_code string, scheduled_hour int, pm25 double"
    )
    out = features.request_features(asked, history)
    picked = rows(out, "train_no_freq", "station_code_freq", "pm25", "is_peak_hour", "is_junction", "total_stops", "zone")
    assert picked == [(100.0, 100.0, 80.0, 0, 0, 50, "SR"), (2.0, 1.0, 120.0, 1, 1, 50, "SR")]


@pytest.mark.parametrize("kind", ["spread", "copies", "edges", "single"])
def test_percentiles_match_numpy(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.lognormal(1.6, 0.9, 3001),
        "copies": np.concatenate([np.full(2000, 12.5), rng.uniform(0, 360, 999)]),
        "edges": np.concatenate([np.zeros(500), np.full(700, 360.0), [-3.0, 400.0, 5.0]]),
        "single": np.array([7.25]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "d double")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = skew.exact_percentiles(df, "d", wanted, 0.0, 360.0).first()
    assert [got[n] for n in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])


def test_distribution(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "arrival_delay_min double")
    assert tuple(quality.delay_distribution(df).first()) == (50.0, 90.0, 5.0, 69.3)
    assert tuple(quality.delay_distribution(df, approx=True).first())[2:] == (5.0, 69.3)


def test_labels(spark):
    df = spark.createDataFrame(
        [("1", i, 20, 160.0, "Exp", i % 2, 12) for i in range(20)],
        "train_no string, stop_seq int, total_stops int, pm25 double, train_type string, is_peak_hour int, dwell_min int",
    )
    out = label_delays(df)
    assert rows(out) == rows(label_delays(df.repartition(5)))
    assert rows(out) != rows(label_delays(df, seed=1))
    first = out.where("stop_seq = 0").first()
    assert (first.fog_factor, first.type_factor, first.stop_factor, first.peak_factor, first.dwell_factor) == (3.5, 0.8, 1.0, 1.0, 1.0)
    last = out.where("stop_seq = 19").first()
    assert (last.peak_factor, last.dwell_factor) == (1.3, 1.3)
    assert last.stop_factor == pytest.approx(1 + 1.5 * 19 / 20)
    assert out.where("arrival_delay_min < 0 or arrival_delay_min > 360").count() == 0
