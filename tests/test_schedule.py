import random

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from trackwork.operators import schedule, skew

SCHEMA = (
    "train_number string, train_name string, station_code string, station_name string, "
    "day int, arrival string, departure string"
)


def timetable(spark, stops):
    data = [(t, f"Train {t}", s, f"Town {s}", d, a, dep) for t, s, d, a, dep in stops]
    return spark.createDataFrame(data, SCHEMA)


def by_station(df):
    return {(r.train_no, r.station_code): r for r in df.collect()}


def test_features(spark):
    stops = [
        ("1", "A", 1, "None", "08:00"),
        ("1", "B", 1, "09:00", "09:12"),
        ("1", "C", 2, "23:50", "00:10"),
        ("1", "D", 2, "06:00", "None"),
        ("1", "E", 1, "10:00", "02.:53"),
        ("2", "A", None, None, "17:30"),
        ("3", "A", 1, "10:00", "10:00"),
        ("3", "B", 1, "10:00", "10:00"),
    ]
    out = by_station(schedule.schedule_features(schedule.clean_schedules(timetable(spark, stops))))
    assert set(out) == {("1", "A"), ("1", "B"), ("1", "C"), ("2", "A"), ("3", "A"), ("3", "B")}
    a, b, c = (out["1", s] for s in "ABC")
    assert [r.stop_seq for r in (a, b, c)] == [0, 1, 2]
    assert {r.total_stops for r in (a, b, c)} == {3}
    assert [r.cumulative_travel_min for r in (a, b, c)] == [0, 72, 970]
    assert [r.dwell_min for r in (a, b, c)] == [0, 12, 0]
    assert [r.is_peak_hour for r in (a, b, c)] == [1, 1, 0]
    assert (a.arrival, out["2", "A"].journey_day, out["2", "A"].scheduled_hour) == (None, None, 17)
    assert (out["3", "A"].stop_seq, out["3", "B"].stop_seq) == (0, 1)
    assert a.route_length_cat == "short"


def test_overnight_dwell(spark):
    stops = [("1", "C", 2, "23:50", "00:10"), ("1", "D", 2, "05:00", "05:03")]
    out = by_station(schedule.schedule_features(timetable(spark, stops), overnight=True))
    assert [out["1", s].dwell_min for s in "CD"] == [20, 3]


@pytest.mark.parametrize("stops, category", [(30, "short"), (31, "medium"), (100, "medium"), (101, "long")])
def test_route_length(spark, stops, category):
    df = timetable(spark, [("1", f"S{i}", 1, None, f"{i // 60:02d}:{i % 60:02d}") for i in range(stops)])
    out = schedule.schedule_features(df)
    assert {r.route_length_cat for r in out.select("route_length_cat").collect()} == {category}


def busy_timetable(spark):
    rng = random.Random(3)
    stops = [("hot", f"S{rng.randrange(6)}", rng.randrange(1, 3), None, f"{rng.randrange(4):02d}:0{rng.randrange(3)}") for _ in range(300)]
    stops += [("hot", "S1", 1, None, "01:00")] * 200
    stops += [(None, f"S{i}", 1, None, "01:00") for i in range(90)]
    stops += [(str(i), f"S{j}", 1, None, f"0{j}:00") for i in range(20) for j in range(5)]
    return timetable(spark, stops).repartition(5)


@pytest.mark.parametrize("hot_rows", [1, 50, 400])
def test_hot_trains_number_their_stops_alike(spark, hot_rows):
    df = busy_timetable(spark)
    assert rows(schedule.schedule_features(df, hot_rows=hot_rows)) == rows(schedule.schedule_features(df))


def test_hot_train_is_not_sorted_in_one_group(spark):
    df = busy_timetable(spark)
    ordinary, hot = skew.split_hot(df, ["train_number"], 50)
    assert {r[0] for r in rows(hot.select("train_number").distinct())} == {"hot", None}
    assert ordinary.count() + hot.count() == df.count()


def test_expand_numbers_every_copy(spark):
    df = spark.createDataFrame([("a", 3), ("b", 150_000)], "k string, n long")
    out = skew.expand(df, "n", "i").groupBy("k").agg(F.countDistinct("i"), F.min("i"), F.max("i"))
    assert rows(out) == [("a", 3, 0, 2), ("b", 150_000, 0, 149_999)]


def test_one_shuffle_for_all_windows(spark):
    df = timetable(spark, [("1", "A", 1, None, "08:00"), ("1", "B", 1, None, "09:00")])
    out = schedule.schedule_features(df)
    out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1
    assert "Union" not in final


def test_sequence_by(spark):
    data = [("1", "10", "x"), ("1", "9", "y"), ("1", "oops", "z"), ("2", "1", "w")]
    df = spark.createDataFrame(data, "train_no string, sno string, v string")
    expected = [("1", "oops", 1), ("1", "9", 2), ("1", "10", 3), ("2", "1", 1)]
    for hot_rows in (1, 100):
        out = schedule.sequence_by(df, "train_no", "sno", hot_rows=hot_rows)
        assert rows(out, "train_no", "sno", "stop_seq") == sorted(expected, key=repr)


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_sequence_by_text(spark, hot_rows):
    clocks = ["10:30", "08:10", None, "09:20", "7"]
    df = spark.createDataFrame([(9 - i, "a", c) for i, c in enumerate(clocks)], "id int, key string, clock string")
    out = {r.clock: r.stop_seq for r in schedule.sequence_by(df, "key", "clock", hot_rows=hot_rows).collect()}
    assert out == {None: 1, "08:10": 2, "09:20": 3, "10:30": 4, "7": 5}
