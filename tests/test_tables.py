import glob

import pytest
from pyspark.sql import functions as F

from helpers import plan, rows
from trackwork.catalog import queries
from trackwork.operators import air, diff, enrich
from trackwork.session import scratch_path, shared_folder
from trackwork.sinks import tables

AIR = "city string, state string, last_update string, latitude double, longitude double, pollutant_id string, pollutant_avg string"


def readings(spark):
    day = "05-01-2024 10:00:00"
    data = [
        (" Delhi ", "Delhi", day, 1.0, 2.0, "PM2.5", "100"),
        ("delhi", "Delhi", day, 1.0, 2.0, " PM2.5 ", "200"),
        ("DELHI", "Delhi", day, 1.0, 2.0, "NO2", "NA"),
        ("DELHI", "Delhi", "06-01-2024 10:00:00", 1.0, 2.0, "PM2.5", "30"),
        ("DELHI", "Delhi", day, 1.0, 2.0, "RADON", "7"),
        ("Pune", "MAHARASHTRA", "garbled", 3.0, 4.0, "OZONE", "x"),
    ]
    return spark.createDataFrame(data, AIR)


def test_pivot(spark):
    out = {(r.city, str(r.obs_date)): r for r in air.pivot_air(readings(spark)).collect()}
    assert set(out) == {("DELHI", "2024-01-05"), ("DELHI", "2024-01-06"), ("PUNE", "None")}
    first = out["DELHI", "2024-01-05"]
    assert (first.pm25, first.no2, first.nh3) == (150.0, None, None)
    assert "RADON" not in air.pivot_air(readings(spark)).columns
    assert out["PUNE", "None"].ozone is None


def test_zone_air(spark):
    out = {r.zone: r.state_pm25 for r in air.zone_air(air.zone_state_map(spark), readings(spark)).collect()}
    assert len(out) == 17
    assert out["NR"] == 110.0
    assert out["SR"] is None


def dimensions(spark):
    features = spark.createDataFrame(
        [("1", "A", "Delhi"), ("1", "B", "Nowhere"), ("9", "Z", None)], "train_no string, station_code string, station_name string"
    )
    trains = spark.createDataFrame(
        [("1", "Exp", "CR", 500, 8, 1)],
        "train_no string, train_type string, zone string, total_distance_km int, duration_hours int, has_sleeper int",
    )
    stations = spark.createDataFrame(
        [("A", "ST", "NR", 1.0, 2.0), ("B", "ST", None, 3.0, 4.0)],
        "station_code string, state string, zone string, latitude double, longitude double",
    )
    return features, trains, stations


def test_enrich(spark):
    features, trains, stations = dimensions(spark)
    wide = air.pivot_air(readings(spark))
    out = enrich.enrich(features, trains, stations, wide)
    picked = rows(out, "train_no", "station_code", "zone", "train_zone", "pm25", "no2", "pm10")
    assert picked == [
        ("1", "A", "NR", "CR", 90.0, 30.0, 80.0),
        ("1", "B", "CR", "CR", 60.0, 30.0, 80.0),
        ("9", "Z", None, None, 60.0, 30.0, 80.0),
    ]
    fanned = enrich.enrich(features, trains, stations, wide, fanout=True)
    assert rows(fanned.where("station_code = 'A'"), "pm25") == [(150.0,), (30.0,)]


def test_enrich_timings(spark):
    _, trains, stations = dimensions(spark)
    sheet = spark.createDataFrame(
        [("1", "A", "08:10", "2"), ("1", "B", None, "1"), (None, None, None, None)],
        "train_number string, station_code string, departure_time string, s_no string",
    )
    wide = spark.createDataFrame([("ST", 170.0), ("ST", 170.0)], "state string, pm25 double")
    out = enrich.with_processed_ts(enrich.enrich_timings(sheet, trains, stations, wide))
    assert len(out.columns) == len(set(out.columns))
    assert {"zone", "zone_1"} < set(out.columns)
    picked = rows(out, "station_code", "stop_seq", "hour_of_day", "is_peak_hour", "fog_factor")
    assert picked == [("A", 2, 8, 1, 1.5), ("B", 1, 12, 0, 1.5)]
    without = enrich.enrich_timings(sheet.drop("station_code"), trains, stations, wide)
    assert {r.fog_factor for r in without.collect()} == {1.0}
    with pytest.raises(ValueError):
        enrich.enrich_timings(sheet.drop("train_number"), trains, stations, wide)


def test_snapshot_diff(spark):
    schema = "id int, a string, b int"
    old = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3), (4, None, 4)], schema)
    new = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (4, None, 4), (5, "n", None)], schema)
    assert rows(diff.snapshot_diff(old, new, ["id"])) == [
        (2, "y", 2, "update"),
        (3, "z", 3, "delete"),
        (5, "n", None, "insert"),
    ]


def test_partitioned_write_replaces_schema(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "n int, zone string")
    tables.write_table(df.withColumn("extra", F.lit(1)), scratch + "/t")
    back = tables.write_table(df, scratch + "/t", ("zone",))
    assert rows(back, "n", "zone") == [(1, "a"), (2, "b"), (3, "b")]
    assert glob.glob(scratch + "/t/zone=b/*.parquet")
    spread = tables.write_table(df, scratch + "/r", (), (3, "zone"))
    assert rows(spread, "n") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_clustered_write(spark, scratch, hot_rows):
    df = spark.range(1000).select((F.col("id") % 40).alias("k"), "id").union(
        spark.range(500).select(F.lit(7).cast("long"), F.col("id") + 5000)
    )
    back = tables.cluster_write(df, scratch + "/c", ["k"], 4, hot_rows)
    assert rows(back) == rows(df)


def test_smoke_counts_and_views(spark, scratch):
    out = tables.smoke(spark, scratch)
    assert rows(out) == [("bronze", 1, "bronze ok"), ("gold", 1, "gold ok"), ("silver", 1, "silver ok")]
    assert rows(tables.row_counts(a=out, b=out.limit(1))) == [("a", 3), ("b", 1)]
    tables.register_views({"smoke_rows": out})
    assert spark.sql("SELECT count(*) n FROM smoke_rows").first().n == 3


def test_scratch_paths_are_new_and_shared(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(folder)


def test_snapshots_with_null_keys_and_other_columns(spark):
    old = spark.createDataFrame([(None, 1, "x"), (1, 2, "y"), (2, 3, "z")], "k int, v int, gone string")
    new = spark.createDataFrame([(None, 1), (1, 5), (3, None)], "k int, v int")
    kinds = {r.k: r._change_type for r in diff.snapshot_diff(old.drop("gone"), new, ["k"]).collect()}
    assert kinds == {1: "update", 2: "delete", 3: "insert"}
    out = diff.snapshot_diff(old, new, ["k"])
    assert out.columns == ["k", "v", "gone", "_change_type"]
    assert {r.k: (r.gone, r._change_type) for r in out.collect()} == {None: (None, "update"), 1: (None, "update"), 2: ("z", "delete"), 3: (None, "insert")}


def test_z_order_prunes_by_either_key(spark, scratch):
    """Both keys' lookups skip files, and rows, nulls and hot keys included, come back as they were."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.xxhash64("id") % 500))
    df = spark.range(6000).select("id", key.alias("a"), F.when(i % 50 != 7, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(400))).alias("b"))
    back = tables.zorder_write(df, f"{scratch}/z", ["a", "b"], 16)
    assert back.exceptAll(df).count() == 0 and back.count() == 6000
    shares = {r.key: (r["values"], r.files, r.share) for r in tables.files_to_read(back, ["a", "b"]).collect()}
    assert shares["a"][1] == shares["b"][1] >= 12
    assert shares["a"][2] < 0.5 and shares["b"][2] < 0.6
    sorted_by_one = tables.cluster_write(df, f"{scratch}/c", ["a", "b"], 16)
    assert {r.key: r.share for r in tables.files_to_read(sorted_by_one, ["b"]).collect()}["b"] > shares["b"][2]


def test_z_value_interleaves_ranks(spark):
    df = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    placed = df.withColumn("z", tables.z_value(df, ["a", "b"], bits=2)).collect()
    want = {(a, b): ((a >> 1) << 3) | ((b >> 1) << 2) | ((a & 1) << 1) | (b & 1) for a in range(4) for b in range(4)}
    assert {(r.a, r.b): r.z for r in placed} == want
    empty = df.where("false")
    assert empty.withColumn("z", tables.z_value(empty, ["a", "b"])).count() == 0


def test_few_stations_are_sent_to_the_stops(spark, monkeypatch):
    """Whatever Spark estimates of them: the stops are not dealt by station."""
    features, trains, stations = dimensions(spark)
    wide = air.pivot_air(readings(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = plan(enrich.enrich(features, trains, stations, wide))
        monkeypatch.setattr(enrich, "SENT_STATIONS", 1)
        joined = plan(enrich.enrich(features, trains, stations, wide))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sent.count("BroadcastHashJoin") == 1 and joined.count("BroadcastHashJoin") == 0


def test_stops_are_not_dealt_by_city(spark):
    """However many readings there are of few cities."""
    features, trains, stations = dimensions(spark)
    many = readings(spark).crossJoin(spark.range(2_000)).drop("id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        out = enrich.enrich(features.crossJoin(spark.range(9_000)).drop("id"), trains, stations, air.pivot_air(many))
        assert "SortMergeJoin [_city" not in plan(out) and "hashpartitioning(_city" not in plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_deal_the_stops_once(spark, monkeypatch):
    """The window's exchange by train serves the join with trains too."""
    _, trains, stations = dimensions(spark)
    kinds = "train_number string, train_name string, station_code string, station_name string, day int, arrival string, departure string, run_date date"
    stops = spark.createDataFrame([("1", "One", "A", "Delhi", 1, "None", "10:00", None), ("1", "One", "B", "Pune", 1, "11:00", "11:05", None)], kinds)
    for name, df in {"schedules": stops, "trains": trains, "stations": stations, "air_long": readings(spark)}.items():
        monkeypatch.setattr(queries.st, name, lambda spark, sf, df=df: df)
    staged = {}
    monkeypatch.setattr(queries, "_WRITTEN", {})
    monkeypatch.setattr(queries, "stage", lambda df, name: staged.setdefault(name, df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(queries.labelled(spark, "own rows"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert list(staged) == ["labels"] and "Window" in joined
    assert joined.count("Exchange hashpartitioning(train_no") == 2  # stops and trains
    assert rows(staged["labels"], "stop_seq", "total_stops", "train_type") == [(0, 2, "Exp"), (1, 2, "Exp")]
