"""Every registered query: (spark, folder of test tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.catalog import standins as st
from trackwork.functions import cleaning, clock, factors, noise, vectors
from trackwork.operators import (
    air,
    cascade,
    chunks,
    diff,
    enrich,
    explain,
    features,
    labels,
    lsh,
    model,
    retrieval,
    schedule,
    sparse,
    trees,
)
from trackwork.plans import forecast, quality, sketches, views
from trackwork.session import scratch_path
from trackwork.sinks import tables
from trackwork.sources import layouts, readers

QUERIES = {}
#: Cosine of hashed words from which a chunk is about a question.
NEAR_CHUNK = 0.55
#: Boosting of the registered queries: the documented depth, fewer and larger steps than the 500 of the default.
QUERY_TREES = {"maxIter": 20, "maxDepth": 6, "stepSize": 0.15}


def query(function):
    QUERIES[function.__name__] = function
    return function


# Shared steps


_WRITTEN: dict = {}


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table that many queries read, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = stage(build(), name)
    return _WRITTEN[key]


def timetable(spark: SparkSession, sf: str) -> DataFrame:
    return schedule.schedule_features(schedule.clean_schedules(st.schedules(spark, sf)), keep=("run_date",))


def stops(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "timetable", lambda: timetable(spark, sf))


def enriched(spark: SparkSession, sf: str, fanout: bool = False, of: DataFrame | None = None) -> DataFrame:
    return enrich.enrich(
        stops(spark, sf) if of is None else of,
        st.trains(spark, sf),
        st.stations(spark, sf),
        air.pivot_air(st.air_long(spark, sf)),
        fanout,
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Not from the written timetable: rows that the window has dealt by train meet the trains where they are."""
    return once(spark, sf, "labels", lambda: labels.label_delays(enriched(spark, sf, of=timetable(spark, sf))))


def in_cities(spark: SparkSession, sf: str) -> DataFrame:
    return views.with_city(enriched(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    ruled = views.rule_predictions(labelled(spark, sf), F.col("run_date"))
    return model.predictions_daily(ruled, F.col("run_date"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """A table several later steps read, written once to the shared folder."""
    return tables.write_table(df, scratch_path(df.sparkSession, name))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "station-train-graph", lambda: cascade.station_train_edges(stops(spark, sf)))


def spread(spark: SparkSession, sf: str, **options) -> DataFrame:
    """The delays of every badly delayed stop, passed on."""
    return cascade.cascade(edges(spark, sf), delayed_sources(spark, sf), **options)


def delayed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every stop with a major delay."""
    late = labelled(spark, sf).where(F.col("arrival_delay_min") > fv.MAJOR_DELAY_MIN)
    return late.select(
        F.col("train_no").alias("source_train"),
        F.col("station_code").alias("source_station"),
        F.col("arrival_delay_min").alias("delay_min"),
    )


def rule_chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.chunk_pages(st.pages(spark, sf))


def shown(df: DataFrame, **digits) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Timetable features


@query
def schedule_features(spark, sf):
    out = stops(spark, sf)
    return out.withColumns(
        {
            "journey_day": F.coalesce("journey_day", F.lit(-1)),
            "arrival": F.coalesce("arrival", F.lit("")),
            "run_date": F.col("run_date").cast("string"),
        }
    )


@query
def schedule_overnight(spark, sf):
    cleaned = schedule.clean_schedules(st.schedules(spark, sf))
    out = schedule.schedule_features(cleaned, overnight=True)
    return out.groupBy("station_code").agg(
        F.sum("dwell_min").alias("dwell_min"), F.count_if(F.col("dwell_min") > 10).alias("long_stops")
    )


@query
def route_category(spark, sf):
    return stops(spark, sf).groupBy("route_length_cat", "total_stops").agg(
        F.count(F.lit(1)).alias("stops"), F.countDistinct("train_no").alias("trains")
    )


@query
def enriched_stops(spark, sf):
    kept = enriched(spark, sf).select(
        "train_no", "stop_seq", "train_type", "train_zone", "total_distance_km", "duration_hours",
        "has_sleeper", "state", "zone", "latitude", "longitude", "pm25", "no2", "pm10",
    )
    filled = kept.fillna("", ["train_type", "train_zone", "state", "zone"]).fillna(
        -1, ["total_distance_km", "duration_hours", "has_sleeper", "latitude", "longitude"]
    )
    return shown(filled, pm25=4, no2=4, pm10=4)


@query
def air_fanout(spark, sf):
    """Literal join on city: one row per stop and dated reading, counted per station."""
    fanned = enriched(spark, sf, fanout=True)
    return fanned.groupBy("station_code").agg(
        F.count(F.lit(1)).alias("joined_rows"), F.round(F.avg("pm25"), 3).alias("avg_pm25")
    )


@query
def silver_timings(spark, sf):
    """Second silver table from timing sheets with their own column names."""
    sheet = st.schedules(spark, sf).select(
        F.col("train_number"), "station_code", F.col("departure").alias("departure_time"),
        F.date_diff("run_date", F.lit("1990-01-01").cast("date")).cast("string").alias("s_no"),
    )
    city_air = air.city_air(air.pivot_air(st.air_long(spark, sf)))
    by_state = city_air.select(F.col("city").alias("state"), "pm25")
    out = enrich.enrich_timings(sheet, st.trains(spark, sf), st.stations(spark, sf), by_state)
    out = enrich.with_processed_ts(out).where(F.col("_processed_ts").isNotNull())
    picked = out.select(
        "train_no", "stop_seq", F.col("s_no").cast("int").alias("s_no"), "hour_of_day", "is_peak_hour",
        F.coalesce("zone", F.lit("")).alias("train_zone"),
        F.coalesce("zone_1", F.lit("")).alias("station_zone"),
        F.coalesce("state", F.lit("")).alias("state"), "fog_factor",
    )
    return picked.groupBy("stop_seq", "hour_of_day", "is_peak_hour", "station_zone", "fog_factor").agg(
        F.count(F.lit(1)).alias("stops"),
        F.sum("s_no").alias("s_no_sum"),
        F.countDistinct("train_zone").alias("train_zones"),
        F.min("state").alias("first_state"),
    )


@query
def feature_ranges(spark, sf):
    return views.feature_ranges(enriched(spark, sf))


@query
def zone_pm25(spark, sf):
    return views.zone_pm25(enriched(spark, sf))


# Air quality


@query
def aq_pivot(spark, sf):
    wide = air.pivot_air(st.air_long(spark, sf))
    wide = wide.withColumn("obs_date", F.col("obs_date").cast("string"))
    return shown(wide.fillna(-1.0), **{c: 4 for c in fv.POLLUTANTS.values()})


@query
def top_polluted_cities(spark, sf):
    return views.polluted_cities(air.pivot_air(st.air_long(spark, sf)))


@query
def zone_state_pm25(spark, sf):
    out = air.zone_air(air.zone_state_map(spark), st.air_long(spark, sf))
    return shown(out, state_pm25=4)


# Labels


@query
def delay_labels(spark, sf):
    out = labelled(spark, sf).select(
        "train_no", "stop_seq", "fog_factor", "type_factor", "stop_factor", "peak_factor",
        "dwell_factor", "arrival_delay_min",
    )
    return shown(out, stop_factor=6, arrival_delay_min=5)


@query
def delay_by_zone(spark, sf):
    return views.delay_by_zone(labelled(spark, sf))


@query
def delay_distribution(spark, sf):
    return quality.delay_distribution(labelled(spark, sf))


# Reporting views


@query
def trains_by_city(spark, sf):
    return views.trains_by_city(in_cities(spark, sf))


@query
def hourly_schedule(spark, sf):
    return views.hourly_schedule(stops(spark, sf))


@query
def delay_sketches(spark, sf):
    """Percentiles and trains per zone from summaries of each day and zone; whether they keep their error bounds."""
    rows = labelled(spark, sf)
    daily = once(spark, sf, "delay-summaries", lambda: sketches.summarise(rows, ["run_date", "zone"]))
    told = sketches.report(sketches.merged(daily, ["zone"]), ["zone"], quality.PERCENTILES)
    checked = sketches.within_bounds(rows, told, "zone", quality.PERCENTILES)
    return checked.withColumn("zone", F.coalesce("zone", F.lit("")))


@query
def polluted_routes(spark, sf):
    return views.polluted_routes(in_cities(spark, sf))


@query
def top_polluted_routes(spark, sf):
    return views.top_polluted_routes(in_cities(spark, sf), 5)


@query
def hazardous_cities(spark, sf):
    return views.hazardous_cities(in_cities(spark, sf))


@query
def total_trains(spark, sf):
    return views.total_trains(stops(spark, sf))


@query
def rule_prediction(spark, sf):
    ruled = views.rule_predictions(enriched(spark, sf).drop("run_date"))
    return ruled.groupBy("predicted_delay_min", F.col("run_date").cast("string").alias("run_date")).agg(
        F.count(F.lit(1)).alias("stops")
    )


@query
def avg_predicted_delay(spark, sf):
    return views.avg_predicted_delay(predictions(spark, sf))


@query
def monthly_delay(spark, sf):
    return views.monthly_delay(predictions(spark, sf))


@query
def delayed_pairs(spark, sf):
    return views.delayed_pairs(predictions(spark, sf))


@query
def scatter_points(spark, sf):
    points = stage(predictions(spark, sf), "predictions").withColumn("day", F.col("run_date").cast("string"))
    out = views.scatter(points, ("train_no", "station_code", "day"))
    return shown(out, pm25=4)


@query
def highest_prediction(spark, sf):
    late = predictions(spark, sf).select(
        "train_no", "station_code", F.col("actual_delay_min").alias("predicted_delay_min")
    )
    return shown(views.highest_prediction(late), predicted_delay_min=5)


@query
def error_metrics(spark, sf):
    return model.error_metrics(predictions(spark, sf))


@query
def baseline_metrics(spark, sf):
    """Rule-based prediction against the training mean, on hash-split rows."""
    ruled = views.rule_predictions(labelled(spark, sf)).withColumnRenamed(
        "arrival_delay_min", "actual_delay_min"
    )
    train, test = features.hash_split(stage(ruled, "ruled"))
    out = model.baseline_metrics(train, test)
    return shown(out, **{c: 4 for c in out.columns})


@query
def risk_levels(spark, sf):
    return forecast.passenger_forecast(predictions(spark, sf)).groupBy("risk", "fog").agg(
        F.count(F.lit(1)).alias("stops"), F.max("delay_shown").alias("longest")
    )


@query
def passenger_forecast(spark, sf):
    """Labels on the observed delays, which cover the whole range."""
    seen = labelled(spark, sf).withColumn("predicted_delay_min", F.col("arrival_delay_min"))
    return forecast.passenger_forecast(seen).select(
        "train_no", "stop_seq", "delay_shown", "risk", "fog", "rights_question"
    )


@query
def rights_queries(spark, sf):
    seen = labelled(spark, sf).withColumn("predicted_delay_min", F.col("arrival_delay_min"))
    return forecast.rights_queries(seen)


@query
def junction_trains(spark, sf):
    return views.busiest_junction(stops(spark, sf))


@query
def trains_through_city(spark, sf):
    return views.trains_through(in_cities(spark, sf), "nation_7")


@query
def polluted_trains(spark, sf):
    return views.polluted_trains(enriched(spark, sf))


@query
def first_stops(spark, sf):
    return views.preview(edges(spark, sf), 10, ["train_no", "station_code", "scheduled_hour"])


@query
def table_counts(spark, sf):
    return tables.row_counts(
        schedules=st.schedules(spark, sf),
        trains=st.trains(spark, sf),
        stations=st.stations(spark, sf),
        air_quality=air.pivot_air(st.air_long(spark, sf)),
        schedule_features=stops(spark, sf),
        trains_by_city=views.trains_by_city(in_cities(spark, sf)),
        rules_chunks=rule_chunks_of(spark, sf),
    )


# Encoding, splitting, sampling


@query
def freq_encode(spark, sf):
    return features.frequency_encode(stops(spark, sf)).select(
        "train_no", "stop_seq", "station_code", "train_no_freq", "station_code_freq"
    )


@query
def label_encode(spark, sf):
    coded = features.index_categories(enriched(spark, sf))
    return coded.groupBy("train_type_code", "zone_code").agg(
        F.count(F.lit(1)).alias("stops"),
        F.coalesce(F.min("train_type"), F.lit("")).alias("train_type"),
        F.coalesce(F.min("zone"), F.lit("")).alias("zone"),
    )


@query
def filled_features(spark, sf):
    """Model inputs after encoding and default filling, summed per zone."""
    ready = model.prepare(labelled(spark, sf))
    ready = cleaning.zero_fill(ready, ["platform_count"])
    inputs = [*features.model_features(ready), "platform_count"]
    return ready.groupBy("zone").agg(*(F.round(F.avg(c), 4).alias(c) for c in inputs))


@query
def hash_split(spark, sf):
    flagged = features.with_split(stops(spark, sf))
    return flagged.select("train_no", "stop_seq", F.col("is_train").cast("int").alias("is_train"))


@query
def date_split(spark, sf):
    """Every fourth stop of a train has no date here."""
    dated = stops(spark, sf).withColumn("run_date", F.when(F.col("stop_seq") != 3, F.col("run_date")))
    train, test = features.date_split(dated, "run_date", F.lit("1998-01-01").cast("date"))
    counted = tables.row_counts(train=train, test=test)
    return counted


@query
def stratified_sample(spark, sf):
    rows = labelled(spark, sf).select("train_no", "stop_seq", "arrival_delay_min")
    return shown(features.stratified_cap(rows, cap=5000), arrival_delay_min=5)


@query
def explain_sample(spark, sf):
    return features.hash_sample(stops(spark, sf)).select("train_no", "stop_seq", "station_code")


@query
def request_features(spark, sf):
    return features.request_features(st.requests(spark, sf), stops(spark, sf)).select(
        "request_id", "train_no", "station_code", "scheduled_hour", "train_no_freq", "station_code_freq",
        "stop_seq", "total_stops", "dwell_min", "pm25", "no2", "train_type", "zone", "is_peak_hour",
        "is_junction",
    )


# Delay propagation


@query
def station_edges(spark, sf):
    return edges(spark, sf)


@query
def edge_frequency(spark, sf):
    return cascade.edge_frequency(edges(spark, sf))


@query
def cascade_hop1(spark, sf):
    return spread(spark, sf, hops=1)


@query
def cascade_hop2(spark, sf):
    out = spread(spark, sf, hops=2)
    return out.where(F.col("hop") == 2)


@query
def cascade_summary(spark, sf):
    return cascade.cascade_summary(edges(spark, sf), delayed_sources(spark, sf))


@query
def cascade_wrapped(spark, sf):
    out = spread(spark, sf, hops=1, wrap=True)
    return out.groupBy("scheduled_hour").agg(
        F.count(F.lit(1)).alias("stops"), F.round(F.sum("propagated_delay"), 1).alias("delay")
    )


@query
def cascade_four_hops(spark, sf):
    out = spread(spark, sf, hops=4)
    return out.groupBy("hop").agg(
        F.count(F.lit(1)).alias("stops"),
        F.countDistinct("source_train", "source_station").alias("sources"),
        F.max("propagated_delay").alias("longest"),
        F.sum(F.col("scheduled_hour") * F.col("rank")).alias("hour_sum"),
        F.countDistinct("train_no").alias("trains"),
    )


@query
def network_spread(spark, sf):
    """The longest delay that reaches each train and station within four hops, of all major delays together."""
    out = cascade.network_spread(edges(spark, sf), delayed_sources(spark, sf), hops=4)
    return out.select("train_no", "station_code", "hop", "propagated_delay")


@query
def cascade_json(spark, sf):
    """Affected stops per source as JSON, read back and counted."""
    packed = cascade.cascade_json(spread(spark, sf))
    record = "array<struct<hop: int, rank: int, train_no: string, station: string, propagated_delay: double>>"
    back = packed.select("source_train", "source_station", F.from_json("cascade", record).alias("c"))
    return back.select(
        "source_train",
        "source_station",
        F.size("c").alias("n"),
        F.get("c", F.lit(0))["train_no"].alias("first_train"),
        F.get("c", F.lit(0))["propagated_delay"].alias("first_delay"),
    )


# Rulebook text and retrieval


@query
def rule_chunks(spark, sf):
    out = rule_chunks_of(spark, sf)
    return out.withColumn("section", F.coalesce("section", F.lit("")))


@query
def chunk_row_ids(spark, sf):
    numbered = chunks.with_row_id(rule_chunks_of(spark, sf))
    return numbered.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("id").alias("ids"))


@query
def rules_by_source(spark, sf):
    return views.rules_by_source(rule_chunks_of(spark, sf))


@query
def chunks_by_source(spark, sf):
    return views.chunks_by_source(rule_chunks_of(spark, sf))


@query
def section_preview(spark, sf):
    return chunks.section_preview(rule_chunks_of(spark, sf))


@query
def section_preview_source(spark, sf):
    """The same within one rulebook."""
    return chunks.section_preview(rule_chunks_of(spark, sf), sources=["src19"])


@query
def keyword_chunks(spark, sf):
    return chunks.search_chunks(rule_chunks_of(spark, sf), pattern=fv.RIGHTS_WORDS).select(
        "chunk_id", "text"
    )


@query
def keyword_preview(spark, sf):
    out = chunks.keyword_preview(rule_chunks_of(spark, sf))
    return out.withColumn("section", F.coalesce("section", F.lit("")))


@query
def vector_norms(spark, sf):
    unit = vectors.l2_normalize(F.col("vector"))
    length = vectors.inner_product(unit, unit)
    first = F.round(F.get(unit, F.lit(0)), 6)
    return st.chunk_vectors(spark, sf).select("chunk_id", F.round(length, 6).alias("length"), first.alias("first"))


def centroid_hits(spark, sf, k=4):
    return retrieval.top_k_similar(st.label_centroids(spark, sf), st.chunk_vectors(spark, sf), k)


def cited_hits(spark, sf):
    """Hits with the page they come from; a vector's page is the document of the same number."""
    source = st.pages(spark, sf).withColumn("section", F.nullif(F.col("page") % 7, F.lit(0)).cast("string"))
    return centroid_hits(spark, sf).join(source, F.col("chunk_id") == F.col("page"))


@query
def vector_topk(spark, sf):
    return shown(centroid_hits(spark, sf), score=4)


def near_vectors(spark, sf):
    """Every twentieth vector as a query against all."""
    corpus = st.chunk_vectors(spark, sf)
    return corpus.where(F.col("chunk_id") % 20 == 0).withColumnRenamed("chunk_id", "query_id"), corpus


@query
def approximate_topk(spark, sf):
    return lsh.approximate_top_k(*near_vectors(spark, sf), k=4)


@query
def approximate_recall(spark, sf):
    """How many of the exact results the approximate search has to find, and whether it finds nine tenths."""
    asked, corpus = near_vectors(spark, sf)
    found = lsh.recall(retrieval.top_k_similar(asked, corpus, 4), lsh.approximate_top_k(asked, corpus, 4))
    return found.select("wanted", (F.col("recall") >= 0.9).cast("int").alias("enough"))


@query
def rag_context(spark, sf):
    return retrieval.rag_context(cited_hits(spark, sf))


@query
def citations(spark, sf):
    cited = retrieval.citations(cited_hits(spark, sf))
    line = F.transform(
        "citations",
        lambda c: F.concat_ws(", ", c["source"], c["section"], c["page"]),
    )
    return cited.select("query_id", F.array_join(line, "; ").alias("citations"))


@query
def rag_fallback(spark, sf):
    """Every question id from conversations; only label numbers find context."""
    asked = st.table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    answered = retrieval.with_fallback(asked, retrieval.rag_context(cited_hits(spark, sf)))
    return answered.select("query_id", F.col("matched").cast("int").alias("matched"), "context")


def best_chunks(spark, sf, asked, k):
    """The chunks nearest to each question (query_id, query_text), with their texts."""
    found = once(spark, sf, "chunks", lambda: rule_chunks_of(spark, sf))
    corpus = retrieval.embed(found).select("chunk_id", "vector")
    hits = retrieval.top_k_similar(retrieval.embed(asked, "query_text", prefix="query: "), corpus, k)
    return hits.join(found, "chunk_id")


def question_hits(spark, sf):
    """The four chunks nearest to each question by words weighted by rarity."""

    def build():
        index = sparse.build_index(once(spark, sf, "chunks", lambda: rule_chunks_of(spark, sf)))
        return sparse.search(st.questions(spark, sf), index, 4)

    return once(spark, sf, "question-hits", build)


@query
def question_topk(spark, sf):
    """Text retrieval end to end: chunks indexed by their words, then the four best for each question."""
    index = sparse.build_index(once(spark, sf, "chunks", lambda: rule_chunks_of(spark, sf)))
    return sparse.search(st.questions(spark, sf), index, 4)


@query
def hashed_question_topk(spark, sf):
    """The same with dense vectors of hashed words, all alike."""
    return best_chunks(spark, sf, st.questions(spark, sf), 4).select("query_id", "chunk_id", "score", "rank")


@query
def question_context(spark, sf):
    """Contexts and citations of the questions, from the chunks found."""
    found = once(spark, sf, "chunks", lambda: rule_chunks_of(spark, sf))
    hits = question_hits(spark, sf).join(found, "chunk_id")
    line = F.transform("citations", lambda c: F.concat_ws(", ", c["source"], c["section"], c["page"]))
    cited = retrieval.citations(hits).select("query_id", F.array_join(line, "; ").alias("citations"))
    return retrieval.rag_context(hits).join(cited, "query_id")


@query
def chat_fallback(spark, sf):
    """The first user message of every conversation, with near chunks as context or the no-match answer."""
    said = st.table(spark, sf, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id"))
    asked = said.agg(F.min_by("text", "turn").alias("query_text"))
    near = best_chunks(spark, sf, asked, 2).where(F.col("score") >= NEAR_CHUNK)
    answered = retrieval.with_fallback(asked, retrieval.rag_context(near))
    return answered.select("query_id", F.col("matched").cast("int").alias("matched"), "context")


# Model


_FITTED: dict = {}


def fitted(spark, sf):
    """A model, the rows it has not seen, and the rows it was fitted on; fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = _fit(spark, sf)
    return _FITTED[key]


def _fit(spark, sf):
    train, test = features.hash_split(labelled(spark, sf))
    counts = features.value_counts(train)
    ready = stage(model.prepare(features.stratified_cap(train), counts_from=counts), "train-rows")
    return model.train(ready, QUERY_TREES), stage(model.prepare(test, counts_from=counts), "test-rows"), ready


_FORECASTERS: dict = {}


def forecaster(spark, sf):
    """A model fitted on every training row, however many; fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FORECASTERS:
        train, _ = features.hash_split(labelled(spark, sf))
        ready = stage(model.prepare(train, counts_from=features.value_counts(train)), "forecast-rows")
        _FORECASTERS[key] = model.train(ready, QUERY_TREES)
    return _FORECASTERS[key]


@query
def model_scores(spark, sf):
    trees, test, _ = fitted(spark, sf)
    return model.predictions_daily(model.score(trees, test), F.col("run_date"))


@query
def model_metrics(spark, sf):
    trees, test, train = fitted(spark, sf)
    scored = model.score(trees, test)
    return model.baseline_metrics(train, scored, model.LABEL, "predicted_delay_min")


@query
def request_forecast(spark, sf):
    """Requests with little more than a train, a station and an hour, scored and labelled."""
    history = labelled(spark, sf)
    ensemble = forecaster(spark, sf)
    asked = features.request_features(st.requests(spark, sf), history)
    scored = model.score(ensemble, features.complete_features(asked))
    return forecast.passenger_forecast(scored).select(
        "request_id", "train_no", "station_code", "delay_shown", "risk", "fog", "rights_question"
    )


def attributions(spark, sf):
    """Of as many rows against as large a background as the library's defaults say."""

    def build() -> DataFrame:
        trees, test, train = fitted(spark, sf)
        rows = features.hash_sample(test.withColumn("row_id", F.concat_ws("|", "train_no", "stop_seq")))
        return explain.attribute(trees, rows, features.capped(train, fv.BACKGROUND_ROWS, ("train_no", "stop_seq")))

    return once(spark, sf, "attributions", build)


@query
def model_attributions(spark, sf):
    return attributions(spark, sf)


@query
def model_score_checks(spark, sf):
    """What SQL can tell of the scored rows: which they are, their actual delays, and the range of predictions."""
    trees, test, _ = fitted(spark, sf)
    scored = model.score(trees, test)
    inside = F.col("predicted_delay_min").between(0, fv.MAX_DELAY_MIN)
    return scored.select(
        "train_no", "stop_seq", F.round("arrival_delay_min", 5).alias("actual"), F.coalesce(inside.cast("int"), F.lit(0)).alias("in_range")
    )


@query
def model_attribution_checks(spark, sf):
    """Explained rows, and whether the contributions of each add up to its prediction less the base."""
    sums = attributions(spark, sf).groupBy("row_id").agg(
        F.sum("contribution").alias("s"), F.first("prediction").alias("p"), F.first("base_value").alias("b")
    )
    off = F.abs(F.col("s") - F.col("p") + F.col("b")) > 1e-6
    return sums.agg(F.count(F.lit(1)).alias("rows_explained"), F.count_if(off).alias("rows_off"))


def exact(spark, sf):
    """Exact attributions of the explained rows, against all rows the model was fitted on."""

    def build() -> DataFrame:
        ensemble, test, train = fitted(spark, sf)
        rows = features.hash_sample(test.withColumn("row_id", F.concat_ws("|", "train_no", "stop_seq")))
        return trees.exact_attributions(ensemble, rows, train)

    return once(spark, sf, "exact-attributions", build)


@query
def exact_attributions(spark, sf):
    return exact(spark, sf)


@query
def exact_attribution_checks(spark, sf):
    """Explained rows, and whether their exact contributions add up to MLlib's own prediction less the base."""
    ensemble, test, _ = fitted(spark, sf)
    sums = exact(spark, sf).groupBy("row_id").agg(F.sum("contribution").alias("s"), F.first("base_value").alias("b"))
    scored = ensemble.transform(test.withColumn("row_id", F.concat_ws("|", "train_no", "stop_seq"))).select("row_id", "prediction")
    off = F.abs(F.col("s") - F.col("prediction") + F.col("b")) > 1e-6
    return sums.join(scored, "row_id").agg(F.count(F.lit(1)).alias("rows_explained"), F.count_if(off).alias("rows_off"))


@query
def exact_importance(spark, sf):
    return explain.importance(exact(spark, sf))


@query
def table_score_checks(spark, sf):
    """Rows scored by joins with the node table, and how many of them MLlib scores otherwise."""
    ensemble, test, _ = fitted(spark, sf)
    keyed = test.withColumn("row_id", F.struct("train_no", "stop_seq"))
    by_table = trees.table_scores(trees.tree_nodes(ensemble), trees.encoded(ensemble, keyed, "row_id"), "row_id", trees.depth_of(ensemble))
    both = by_table.join(ensemble.transform(keyed).select("row_id", F.col("prediction").alias("own")), "row_id")
    return both.agg(F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.abs(F.col("prediction") - F.col("own")) > 1e-9).alias("rows_off"))


@query
def model_importance(spark, sf):
    return explain.importance(attributions(spark, sf))


@query
def model_waterfall(spark, sf):
    return explain.waterfall(attributions(spark, sf))


# Ingest and layout


@query
def messy_clocks(spark, sf):
    """Clock texts in the styles found on timing sheets, one per event."""
    n = F.col("event_id")
    hour, minute = n % 24, F.floor(n / 24) % 60
    styles = [
        F.concat(st.text(hour), F.lit("."), st.two_digits(minute)),
        F.concat(st.two_digits(hour), F.lit(":"), st.two_digits(minute)),
        F.concat(st.text(hour % 12 + 1), F.lit("."), st.two_digits(minute), F.lit(" PM")),
        F.concat(st.text(hour % 12 + 1), F.lit(":"), st.two_digits(minute), F.lit(" am")),
        F.concat(st.two_digits(hour), F.lit(".:"), st.two_digits(minute)),
        F.concat(st.text(hour), F.lit("."), st.text(minute % 10)),
        F.lit("Start"),
        F.lit("NA"),
    ]
    raw = F.get(F.array(*styles), (n % 8).cast("int"))
    texts = st.table(spark, sf, "events").select(n, raw.alias("clock"))
    minutes = clock.parse_clock(cleaning.null_if(F.col("clock"), "NA"))
    return texts.select("event_id", "clock", F.coalesce(minutes, F.lit(-1)).alias("minutes"))


@query
def train_numbers(spark, sf):
    key = F.col("o_orderkey") + 10000
    key = F.when(F.col("o_orderkey") % 3 == 0, key * 10).otherwise(key)  # too long for a train
    styles = [
        F.concat(st.text(key), F.lit(" E")),
        F.concat(st.text(key), F.lit("/11")),
        F.concat(F.lit("Chennai Express ("), st.text(key), F.lit(")")),
        F.concat(st.text(key), F.lit(" / "), st.text(key + 1)),
        F.lit("Special 12"),
    ]
    raw = F.get(F.array(*styles), (F.col("o_orderkey") % 5).cast("int"))
    number = F.coalesce(cleaning.train_number(raw), F.lit(""))
    return st.table(spark, sf, "orders").select("o_orderkey", number.alias("train_no"))


@query
def csv_air_ingest(spark, sf):
    """Readings written as CSV, read back under the declared schema and pivoted."""
    path = scratch_path(spark, "air-csv")
    st.air_long(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    wide = air.pivot_air(readers.read_aq(spark, path))
    return wide.groupBy("city").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.avg("pm25"), 4).alias("pm25"), F.round(F.avg("no2"), 4).alias("no2")
    )


@query
def json_schedule_ingest(spark, sf):
    path = scratch_path(spark, "schedules-json")
    st.schedules(spark, sf).drop("run_date").write.json(path)
    read = schedule.clean_schedules(readers.read_schedules(spark, path))
    return read.groupBy("station_code").agg(
        F.count(F.lit(1)).alias("stops"),
        F.count("arrival").alias("arrivals"),
        F.count("day").alias("days"),
        F.countDistinct("departure").alias("departures"),
    )


def as_feature_collections(df: DataFrame, feature, group) -> DataFrame:
    """GeoJSON text with at most a few hundred features per line."""
    return df.groupBy(group.alias("_g")).agg(
        F.to_json(
            F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
        ).alias("value")
    ).select("value")


@query
def geojson_trains(spark, sf):
    path = scratch_path(spark, "trains-geojson")
    properties = F.struct(
        F.col("train_no").alias("number"), F.col("train_name").alias("name"), F.col("train_type").alias("type"),
        "zone", F.col("total_distance_km").alias("distance"), F.col("duration_hours").alias("duration_h"),
        F.col("has_sleeper").alias("sleeper"),
    )
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"))
    group = F.floor(F.col("train_no").cast("long") / 500)
    as_feature_collections(st.trains(spark, sf), feature, group).write.text(path)
    return readers.read_trains(spark, path, lines=True).select(
        "train_no", "train_name", "train_type", "zone", "total_distance_km", "duration_hours", "has_sleeper"
    )


@query
def geojson_stations(spark, sf):
    path = scratch_path(spark, "stations-geojson")
    properties = F.struct(
        F.col("station_code").alias("code"), F.col("station_name").alias("name"), "state", "zone", "address"
    )
    place = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(properties.alias("properties"), place.alias("geometry"))
    found = st.stations(spark, sf)
    groups = max(1, found.count() // 200)
    keyed = found.withColumn("_h", F.pmod(F.xxhash64("station_code"), F.lit(groups)))
    as_feature_collections(keyed, feature, F.col("_h")).write.text(path)
    out = readers.read_stations(spark, path, lines=True)
    return out.fillna("", ["zone"])


@query
def csv_layouts(spark, sf):
    """Three sheets with their own headers, read as one table in common columns."""
    root = scratch_path(spark, "sheets")
    base = st.schedules(spark, sf)
    dotted = F.regexp_replace("departure", ":", ".")
    sheets = [
        base.where("coalesce(day, 0) % 3 = 0").select(
            F.col("station_code").alias("S.No"), F.col("train_number").alias("Train No"),
            F.col("train_name").alias("Name of the Train"), F.col("departure").alias("Time(Departure)"),
        ),
        base.where("coalesce(day, 0) % 3 = 1").select(
            F.concat("train_number", F.lit(" E")).alias("Train Number"),
            F.col("train_name").alias("Train Name "), F.col("station_name").alias("Place - From"),
            F.col("arrival").alias("Arrival"), dotted.alias("Departure from Karur"),
            F.lit("Daily, all").alias("Day of Service"),
        ),
        base.where("coalesce(day, 0) % 3 = 2").select(
            F.concat(F.lit("Express ("), "train_number", F.lit(")")).alias("Train Name & Number passing via X Junction"),
            F.col("arrival").alias("Train Arrival Timings"),
            F.lit("Yes").alias("Monday"), F.lit("No").alias("Tuesday"), F.lit("Yes").alias("Sunday"),
        ),
    ]
    for i, sheet in enumerate(sheets):
        sheet.write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/sheet={i}")
    out = layouts.read_canonical_timings(spark, f"{root}/*/*.csv")
    return out.groupBy(F.coalesce("days", F.lit("")).alias("days")).agg(
        F.count(F.lit(1)).alias("stops"),
        F.count("train_no").alias("numbers"),
        F.count("train_name").alias("names"),
        F.count("origin").alias("origins"),
        F.sum("arrival_min").alias("arrivals"),
        F.sum("departure_min").alias("departures"),
        F.count("_source_file").alias("lineage"),
    ).fillna(-1)


@query
def running_history(spark, sf):
    """A dated history written by year and month, then read back for a few partitions."""
    source = st.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("train_no"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Schedule_Date"),
    )
    history = readers.load_history(source)
    back = tables.write_table(
        history, scratch_path(spark, "history"), ("year", "month"), repartition=(None, "train_no")
    )
    return back.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("runs"), F.min("run_date").cast("string").alias("first_run")
    )


@query
def partitioned_by_zone(spark, sf):
    back = tables.write_table(labelled(spark, sf), scratch_path(spark, "features"), ("zone",))
    return back.groupBy(F.coalesce("zone", F.lit("")).alias("zone")).agg(
        F.count(F.lit(1)).alias("stops"), F.round(F.avg("arrival_delay_min"), 3).alias("avg_delay")
    )


@query
def layer_counts(spark, sf):
    """One table per layer written, read back and counted."""
    layers = {"bronze": st.schedules(spark, sf), "silver": stops(spark, sf), "gold": labelled(spark, sf)}
    back = {name: tables.write_table(df, scratch_path(spark, name)) for name, df in layers.items()}
    return tables.row_counts(**back)


@query
def sql_views(spark, sf):
    """Two views registered for SQL and joined by name."""
    tables.register_views({"timetable_stops": stops(spark, sf), "train_zones": st.trains(spark, sf)})
    return spark.sql(
        "SELECT zone, count(*) AS stops, count(DISTINCT s.train_no) AS trains, max(s.total_stops) AS longest "
        "FROM timetable_stops s JOIN train_zones t ON s.train_no = t.train_no GROUP BY zone"
    )


@query
def zordered_files(spark, sf):
    """Stops along the Z-curve of train and station: a lookup by either key reads less than half of 64 files."""
    back = tables.zorder_write(stops(spark, sf), scratch_path(spark, "z-ordered"), ["train_no", "station_code"], 64)
    read = tables.files_to_read(back, ["train_no", "station_code"])
    return read.select("key", "values", (F.col("share") < 0.5).cast("int").alias("skips"))


@query
def zordered_lookup(spark, sf):
    """The same table summed per station after read-back."""
    back = tables.zorder_write(stops(spark, sf), scratch_path(spark, "z-ordered"), ["train_no", "station_code"], 16)
    return back.groupBy("station_code").agg(
        F.count(F.lit(1)).alias("stops"), F.sum("cumulative_travel_min").alias("travel_min")
    )


@query
def clustered_lookup(spark, sf):
    """Stops sorted over the files by train and station, summed per station after read-back."""
    path = scratch_path(spark, "clustered")
    back = tables.cluster_write(stops(spark, sf), path, ["train_no", "station_code"])
    return back.groupBy("station_code").agg(
        F.count(F.lit(1)).alias("stops"), F.sum("cumulative_travel_min").alias("travel_min")
    )


@query
def snapshot_diff(spark, sf):
    """Orders against a later version with rows removed, added and changed; one has no key in either."""
    old = st.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = old.withColumn("o_orderkey", F.nullif("o_orderkey", F.lit(1)))
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, F.lit("X")).when(key % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    kept = old.where(F.coalesce(key % 11 != 0, F.lit(True))).withColumn("o_orderstatus", status)
    added = old.where(key % 13 == 0).withColumn("o_orderkey", -key - 1)
    out = diff.snapshot_diff(old, kept.unionByName(added), ["o_orderkey"])
    return out.fillna("", ["o_orderstatus"])


@query
def text_sequence(spark, sf):
    """Stops of each train numbered by their departure text, unread and missing ones included."""
    rows = st.schedules(spark, sf).select("train_number", F.nullif("departure", F.lit("--:--")).alias("departure"))
    numbered = schedule.sequence_by(rows.where("train_number is not null"), "train_number", "departure")
    return numbered.select("train_number", F.coalesce("departure", F.lit("")).alias("departure"), "stop_seq")
