import math

import pytest
from pyspark.sql import functions as F

from helpers import one, over, rows
from trackwork import fixed_values as fv
from trackwork.functions import cleaning, clock, factors, noise, vectors


def test_sentinels_and_casts(spark):
    assert over(spark, ["None", "x", None], lambda v: cleaning.null_if(v, "None")) == [None, "x", None]
    assert over(spark, ["1.5", "NA", "", None], lambda v: cleaning.number(v)) == [1.5, None, None, None]
    assert over(spark, ["\n a b\t", "x"], lambda v: cleaning.strip(v)) == ["a b", "x"]


def test_train_numbers(spark):
    texts = ["17316 E", "16609/11", "Chennai Express (06748)", "40702 / 40752", "6009", "Slip 12", None]
    assert over(spark, texts, lambda v: cleaning.train_number(v)) == ["17316", "16609", "06748", "40702", "6009", None, None]


def test_clean_names():
    assert cleaning.clean_name("S.No") == "sno"
    assert cleaning.clean_name(" Train\tName\n& Number ") == "train_name_number"
    assert cleaning.clean_name("Passengers in No's") == "passengers_in_nos"
    assert cleaning.clean_name("&") == cleaning.clean_name("") == cleaning.clean_name(None) == "unknown"


@pytest.mark.parametrize(
    "names, unique",
    [
        (["a", "b"], ["a", "b"]),
        (["a", "a", "a"], ["a", "a_1", "a_2"]),
        (["a", "a", "a_1"], ["a", "a_2", "a_1"]),
        (["unknown", "unknown"], ["unknown", "unknown_1"]),
    ],
)
def test_unique_names(names, unique):
    assert cleaning.unique_names(names) == unique


def test_frame_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Train No", "Train  No.", "x"])
    assert cleaning.sanitize_columns(df).columns == ["train_no", "train_no_1", "x"]
    twice = df.select("x", F.col("x"))
    assert cleaning.dedupe_columns(twice).columns == ["x", "x_1"]
    assert cleaning.rename_all(df, {"x": "y"}).columns[-1] == "y"
    assert cleaning.existing(df, ["x", "z"]) == ["x"]
    assert cleaning.zero_fill(df, ["x", "z"]).first()["z"] == 0.0


def test_fill_defaults(spark):
    df = spark.createDataFrame([(None, None, None)], "pm25 double, zone string, other string")
    filled = cleaning.fill_defaults(df, fv.NUMERIC_DEFAULTS, fv.CATEGORY_FEATURES)
    assert tuple(filled.first()) == (60.0, "UNKNOWN", None)


@pytest.mark.parametrize(
    "columns, role, expected",
    [
        (["sno", "train_no"], "train_no", "train_no"),
        (["train_name_number_passing_via_x"], "train_no", "train_name_number_passing_via_x"),
        (["rpm", "pm25_mean"], "pm25", "pm25_mean"),
        (["rpm"], "pm25", None),
        (["place_of_arrl", "arrl_to_karur"], "arrival", "arrl_to_karur"),
        (["place_of_dept", "dept_from_karur"], "departure", "dept_from_karur"),
        (["train_timings_arraival_to_t"], "arrival", "train_timings_arraival_to_t"),
        (["my_station_code"], "station_code", "my_station_code"),
        (["idx", "x"], "order", "idx"),
    ],
)
def test_roles(spark, columns, role, expected):
    df = spark.createDataFrame([tuple("x" for _ in columns)], columns)
    assert cleaning.resolve_role(df, role) == expected


def test_minutes(spark):
    texts = ["07:05", "23:59", "None", "02.:53", "7", "", None, "99999999999:1"]
    assert over(spark, texts, lambda v: clock.to_minutes(v)) == [425, 1439] + [None] * 6
    assert one(spark, clock.to_minutes(F.lit("01:00"), F.lit(None).cast("int"))) == 1500
    assert one(spark, clock.to_minutes(F.lit("01:00"), F.lit(3))) == 4380
    assert over(spark, ["09:10", "x", None], lambda v: clock.hour_of_day(v)) == [9, 12, 12]


def test_messy_clocks(spark):
    texts = ["7.00 AM", "12.40 AM", "12.10 PM", "2.45 PM", "21:43", "02.:53", "14.00", "22.1", "1.4", "6:5", "5", "0.01"]
    minutes = [420, 40, 730, 885, 1303, 173, 840, 1330, 100, 365, 300, 1]
    assert over(spark, texts, lambda v: clock.parse_clock(v)) == minutes
    assert over(spark, ["Start", "End", "NA", "25.00", "10.75", None, ""], lambda v: clock.parse_clock(v)) == [None] * 7


def test_peak_hours(spark):
    hours = [5, 6, 7, 10, 11, 16, 17, 20, 21, 22]
    assert over(spark, hours, lambda v: clock.is_peak(v, fv.PEAK_TIMETABLE), "int") == [0, 1, 1, 1, 0, 0, 1, 1, 1, 0]
    assert over(spark, hours, lambda v: clock.is_peak(v, fv.PEAK_TIMINGS), "int") == [0, 0, 1, 1, 0, 0, 1, 1, 0, 0]
    assert over(spark, hours, lambda v: clock.is_peak(v, fv.PEAK_REQUEST), "int") == [0, 1, 1, 1, 0, 0, 1, 1, 0, 0]


def test_ladders_at_their_bounds(spark):
    pm25 = [59.9, 60.0, 80.0, 100.0, 120.0, 150.0, 150.1, None]
    assert over(spark, pm25, lambda v: factors.fog_factor(v), "double") == [1.0, 1.2, 1.6, 2.2, 2.8, 3.5, 3.5, 1.0]
    assert over(spark, pm25, lambda v: factors.coarse_fog_factor(v), "double") == [1.0, 1.0, 1.0, 1.2, 1.2, 1.2, 1.5, 1.0]
    assert one(spark, factors.coarse_fog_factor(None)) == 1.0
    assert over(spark, pm25, lambda v: factors.rule_delay(v, F.lit(0)), "double") == [10, 10, 10, 10, 30, 30, 45, 10]
    assert one(spark, factors.rule_delay(F.lit(100.0), F.lit(1))) == 20
    assert over(spark, pm25, lambda v: factors.fog_label(v), "double") == ["Low"] * 4 + ["Moderate"] * 2 + ["High", "Low"]
    assert over(spark, [20.0, 20.1, 45.0, 45.1], lambda v: factors.risk_label(v), "double") == ["Low", "Medium", "Medium", "High"]
    assert over(spark, [30, 31, 100, 101], lambda v: factors.route_category(v), "int") == ["short", "medium", "medium", "long"]


def test_type_and_dwell(spark):
    kinds = ["Rajdhani", "VANDE BHARAT", "Duronto", "SF Exp", "Passenger", "PGR", "DEMU", "Raj Exp", "SF", None]
    expected = [0.45, 0.45, 0.8, 0.8, 1.4, 1.4, 1.05, 0.45, 1.0, 1.0]
    assert over(spark, kinds, lambda v: factors.type_factor(v)) == expected
    assert over(spark, [5, 6, 10, 11], lambda v: factors.dwell_factor(v, F.lit(3)), "int") == [1.0, 1.1, 1.1, 1.3]
    assert one(spark, factors.dwell_factor(F.lit(30), F.lit(0))) == 1.0


def test_delay_bounds_and_junctions(spark):
    assert over(spark, [-1.0, 12.0, 400.0], lambda v: factors.clip_delay(v), "double") == [0.0, 12.0, 360.0]
    assert over(spark, [-1.0, 12.36], lambda v: factors.floor_delay(v), "double") == [0.0, 12.4]
    assert over(spark, ["MAS", "PUNE", None], lambda v: factors.is_junction(v)) == [1, 0, 0]


def test_noise_depends_on_the_key_alone(spark):
    df = spark.range(20000).withColumn("z", noise.standard_normal(noise.row_key(["id"])))
    before = rows(df.repartition(1))
    assert rows(df.repartition(7)) == before
    values = [z for _, z in before]
    mean = sum(values) / len(values)
    assert abs(mean) < 0.03
    assert abs(math.sqrt(sum((z - mean) ** 2 for z in values) / len(values)) - 1) < 0.03


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.inner_product(a, a)) == 25.0
    assert one(spark, vectors.l2_normalize(a)) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_long_numbers_are_no_train(spark):
    labels = ["12345", "123456", "160000 E", "9876543210", "16609/11", "x(4411)y", "123", "00123456 / 20518"]
    assert over(spark, labels, cleaning.train_number) == ["12345", None, None, None, "16609", "4411", None, "20518"]


def test_means_do_not_depend_on_the_order_of_rows(spark):
    df = spark.range(20_000).selectExpr("id % 7 AS k", "(id * 37 % 1000) * 0.1 + id * 1e-4 AS v")
    means = [
        {r.k: r.m for r in df.repartition(n, "v").sortWithinPartitions("v" if n % 2 else "k").groupBy("k").agg(cleaning.exact_mean(F.col("v")).alias("m")).collect()}
        for n in (1, 4, 7)
    ]
    assert means[0] == means[1] == means[2]
