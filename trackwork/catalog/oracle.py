"""The registered queries in SQL for an independent engine, over the same test tables."""

from __future__ import annotations

import re

from trackwork import fixed_values as fv
from trackwork.catalog.standins import EVENT_POLLUTANTS, STATES, TRAIN_TYPES, ZONES


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_case(pairs: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


JUNCTIONS = sql_list(fv.JUNCTIONS)
STATION_CODE = "CASE WHEN {k} < 8 THEN " + JUNCTIONS + "[{k}::INT + 1] ELSE {k}::VARCHAR END"


def station_code(key: str) -> str:
    return STATION_CODE.replace("{k}", key)


def md5_int(key: str, part: int = 0) -> str:
    return f"('0x' || substr(md5({key}), {8 * part + 1}, 8))::BIGINT"


def ladder(pairs, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def gap_filled(columns: dict[str, float]) -> str:
    return ", ".join(f"coalesce({c}, {v}::DOUBLE) AS {c}" for c, v in columns.items())


FOG = ladder([(f"pm25 >= {n}", f"{f}::DOUBLE") for n, f in fv.FOG_LADDER], "1.0::DOUBLE")
TYPE = ladder(
    [(f"regexp_matches(train_type, '{p}')", f"{f}::DOUBLE") for p, f in fv.TRAIN_TYPE_LADDER],
    "1.0::DOUBLE",
)
DWELL = ladder(
    [(f"dwell_min > {n} AND stop_seq > 0", f"{f}::DOUBLE") for n, f in fv.DWELL_LADDER], "1.0::DOUBLE"
)
RULE = ladder(
    [*((f"pm25 > {n}", m) for n, m in fv.RULE_PM25), ("is_peak_hour = 1", fv.RULE_PEAK)], fv.RULE_OTHER
)
RISK = ladder([(f"delay_shown > {n}", f"'{v}'") for n, v in fv.RISK_LADDER], "'Low'")
FOG_LABEL = ladder([(f"pm25 > {n}", f"'{v}'") for n, v in fv.FOG_LABEL_LADDER], "'Low'")
ROUTE = "CASE WHEN total_stops > 100 THEN 'long' WHEN total_stops > 30 THEN 'medium' ELSE 'short' END"
HOUR = "try_cast(split_part({c}, ':', 1) AS INT)"


def minutes(clock: str, day: str) -> str:
    return (
        f"coalesce({day}, 1) * 1440 + try_cast(split_part({clock}, ':', 1) AS BIGINT) * 60 "
        f"+ try_cast(split_part({clock}, ':', 2) AS BIGINT)"
    )


def mean(column: str) -> str:
    """A mean that does not depend on the order of rows."""
    return f"sum(({column})::DECIMAL(28,8))::DOUBLE / count({column})"


def peak(hour: str, spans) -> str:
    hits = " OR ".join(f"{hour} BETWEEN {a} AND {b}" for a, b in spans)
    return f"CASE WHEN {hits} THEN 1 ELSE 0 END"


def word_counts(key: str, text: str, table: str) -> str:
    """Words per hashed bucket of every text."""
    return rf"""
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
        FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+')) AS w FROM {table})
        WHERE w <> '' GROUP BY ALL"""


def terms_of(key: str, table: str) -> str:
    """Words of every text with their counts."""
    return rf"""
        SELECT {key}, term, count(*) AS n
        FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM {table})
        WHERE term <> '' GROUP BY ALL"""


def best_chunks(words: str, k: int) -> str:
    """The k chunks of the highest cosine of word counts."""
    return f"""
        SELECT * FROM (
            SELECT item_id AS query_id, chunk_id, round(score, 6) AS score,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank
            FROM (SELECT item_id, chunk_id, round(dot / (q.norm * c.norm), 12) AS score
                  FROM (SELECT q.item_id, c.chunk_id, sum(q.n * c.n)::DOUBLE AS dot
                        FROM {words} q JOIN chunk_words c USING (bucket) GROUP BY ALL)
                  JOIN (SELECT item_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM {words} GROUP BY item_id) q USING (item_id)
                  JOIN chunk_norms c USING (chunk_id)))
        WHERE rank <= {k}"""


def spread_hop(n: int) -> str:
    """Every stop reached from the stops of the hop before, each pair of them met."""
    if n % 2:
        meets = "e.station_code = f.station_code AND e.train_no <> f.train_no AND abs(e.scheduled_hour - f.scheduled_hour) <= 2"
    else:
        meets = "e.train_no = f.train_no AND e.station_code <> f.station_code"
    return f"""
        SELECT e.train_no, e.station_code, e.scheduled_hour, max(f.delay) AS delay
        FROM spread{n - 1} f JOIN edges e ON {meets} GROUP BY ALL"""


EXCERPT = (
    "'[Excerpt ' || rank || '] Source: ' || source_title || ', Section ' || coalesce(section, 'N/A') "
    "|| ', Page ' || page || chr(10) || text || chr(10)"
)

# Common table expressions, in order of dependence.
CTES = {
    "schedules": f"""
        SELECT l_orderkey::VARCHAR AS train_number, 'Train ' || l_orderkey AS train_name,
               {station_code("l_suppkey")} AS station_code, 'Nation_' || (l_suppkey % 25) AS station_name,
               nullif(l_linenumber, 7) AS day,
               CASE WHEN l_linenumber = 1 THEN 'None'
                    ELSE lpad(((l_partkey % 24 * 60 + l_suppkey % 60 - l_partkey % 13 + 1440) % 1440 // 60)::VARCHAR, 2, '0')
                         || ':' || lpad(((l_partkey % 24 * 60 + l_suppkey % 60 - l_partkey % 13 + 1440) % 1440 % 60)::VARCHAR, 2, '0')
               END AS arrival,
               CASE WHEN l_linenumber = 6 AND l_partkey % 2 = 0 THEN 'None'
                    WHEN l_partkey % 97 = 0 THEN '--:--'
                    ELSE lpad((l_partkey % 24)::VARCHAR, 2, '0') || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0')
               END AS departure,
               l_shipdate::DATE AS run_date
        FROM lineitem""",
    "parsed": f"""
        SELECT train_number AS train_no, train_name, station_code, station_name, day AS journey_day,
               nullif(arrival, 'None') AS arrival, departure, run_date,
               {minutes("departure", "day")} AS dep_abs_min, {minutes("arrival", "day")} AS arr_abs_min,
               {HOUR.format(c="departure")} AS scheduled_hour
        FROM schedules""",
    "placed": """
        SELECT *,
               row_number() OVER (PARTITION BY train_no ORDER BY dep_abs_min, station_code NULLS FIRST,
                   journey_day NULLS FIRST, arrival NULLS FIRST, departure NULLS FIRST,
                   train_name NULLS FIRST, station_name NULLS FIRST, run_date NULLS FIRST) - 1 AS stop_seq,
               count(*) OVER (PARTITION BY train_no) AS total_stops,
               min(dep_abs_min) OVER (PARTITION BY train_no) AS origin_dep_min
        FROM parsed WHERE dep_abs_min IS NOT NULL""",
    "stops": f"""
        SELECT train_no, train_name, station_code, station_name, journey_day, arrival, departure,
               scheduled_hour, stop_seq, total_stops, dep_abs_min - origin_dep_min AS cumulative_travel_min,
               CASE WHEN dep_abs_min > arr_abs_min THEN dep_abs_min - arr_abs_min ELSE 0 END AS dwell_min,
               {peak("scheduled_hour", fv.PEAK_TIMETABLE)} AS is_peak_hour, {ROUTE} AS route_length_cat, run_date,
               dep_abs_min, arr_abs_min
        FROM placed""",
    "trains": f"""
        SELECT o_orderkey::VARCHAR AS train_no, 'Train ' || o_orderkey AS train_name,
               {sql_case(TRAIN_TYPES, "o_orderpriority")} AS train_type,
               {sql_list(ZONES)}[(o_custkey % 17)::INT + 1] AS zone,
               floor(o_totalprice / 200)::INT AS total_distance_km,
               floor(o_totalprice / 20000)::INT AS duration_hours, (o_orderkey % 2)::INT AS has_sleeper
        FROM orders""",
    "stations": f"""
        SELECT {station_code("s_suppkey")} AS station_code, 'Nation_' || (s_suppkey % 25) AS station_name,
               n_name AS state,
               CASE WHEN s_suppkey % 10 <> 0 THEN {sql_list(ZONES)}[(s_suppkey % 17)::INT + 1] END AS zone,
               r_name AS address, (s_suppkey % 29 + 68)::DOUBLE AS longitude, (s_suppkey % 28 + 8)::DOUBLE AS latitude
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "air_long": f"""
        SELECT {sql_list(STATES)}[(user_id % 17)::INT + 1] AS state, 'NATION_' || (user_id % 25) AS city,
               ts::DATE AS obs_date, (user_id % 25 + 8)::DOUBLE AS latitude, (user_id % 25 + 68)::DOUBLE AS longitude,
               {sql_case(EVENT_POLLUTANTS, "event_type")} AS pollutant_id,
               CASE WHEN event_id % 10 <> 0 THEN value * (user_id % 25 + 1) END AS reading
        FROM events""",
    "air_wide": "SELECT city, obs_date, latitude, longitude, "
    + ", ".join(
        f"{mean(f"CASE WHEN pollutant_id = '{p}' THEN reading END")} AS {c}" for p, c in fv.POLLUTANTS.items()
    )
    + " FROM air_long GROUP BY ALL",
    "city_air": f"""
        SELECT city, {mean("pm25")} AS pm25, {mean("no2")} AS no2, {mean("pm10")} AS pm10 FROM air_wide GROUP BY city""",
    "enriched": f"""
        SELECT s.*, t.train_type, t.zone AS train_zone, t.total_distance_km, t.duration_hours, t.has_sleeper,
               st.state, coalesce(st.zone, t.zone) AS zone, st.latitude, st.longitude, upper(s.station_name) AS city,
               coalesce(a.pm25, {fv.AIR_DEFAULTS["pm25"]}::DOUBLE) AS pm25,
               coalesce(a.no2, {fv.AIR_DEFAULTS["no2"]}::DOUBLE) AS no2,
               coalesce(a.pm10, {fv.AIR_DEFAULTS["pm10"]}::DOUBLE) AS pm10
        FROM stops s LEFT JOIN trains t ON t.train_no = s.train_no
        LEFT JOIN stations st ON st.station_code = s.station_code
        LEFT JOIN city_air a ON upper(s.station_name) = a.city""",
    "factored": f"""
        SELECT *, {FOG} AS fog_factor, {TYPE} AS type_factor,
               1.0::DOUBLE + stop_seq::DOUBLE / total_stops * {fv.STOP_SLOPE}::DOUBLE AS stop_factor,
               CASE WHEN is_peak_hour = 1 THEN {fv.PEAK_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END AS peak_factor,
               {DWELL} AS dwell_factor, train_no || '|' || stop_seq || '|42' AS row_key
        FROM enriched""",
    "labelled": f"""
        SELECT *, least(greatest(
                   exp(sqrt(-2.0::DOUBLE * ln(({md5_int("row_key", 0)} + 1) / 4294967297::DOUBLE))
                       * cos(2 * pi() * ({md5_int("row_key", 1)} / 4294967296::DOUBLE))
                       * {fv.NOISE_SIGMA}::DOUBLE + {fv.NOISE_MU}::DOUBLE)
                   * fog_factor * type_factor * stop_factor * peak_factor * dwell_factor, 0::DOUBLE),
               {fv.MAX_DELAY_MIN}::DOUBLE) AS arrival_delay_min
        FROM factored""",
    "predictions": f"""
        SELECT train_no, station_code, scheduled_hour, arrival_delay_min AS actual_delay_min,
               ({RULE})::DOUBLE AS predicted_delay_min, run_date, pm25, zone
        FROM labelled""",
    "edges": """
        SELECT DISTINCT train_no, station_code, scheduled_hour FROM stops
        WHERE train_no IS NOT NULL AND station_code IS NOT NULL""",
    "located": f"""
        SELECT d.source_train, d.source_station, d.delay_min, h.hour
        FROM (SELECT train_no AS source_train, station_code AS source_station,
                     max(arrival_delay_min) AS delay_min
              FROM labelled WHERE arrival_delay_min > {fv.MAJOR_DELAY_MIN} GROUP BY ALL) d
        JOIN (SELECT train_no, station_code, min(scheduled_hour) AS hour FROM edges GROUP BY ALL) h
          ON h.train_no = d.source_train AND h.station_code = d.source_station""",
    "hop1": """
        SELECT * FROM (
            SELECT source_train, source_station, e.train_no, e.station_code, e.scheduled_hour, 1 AS hop,
                   delay_min, round(delay_min * 0.6::DOUBLE, 1) AS propagated_delay,
                   row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY abs(e.scheduled_hour - hour), e.train_no, e.scheduled_hour) AS rank
            FROM located JOIN edges e ON e.station_code = source_station AND e.train_no <> source_train
                 AND abs(e.scheduled_hour - hour) <= 2)
        WHERE rank <= 10""",
    "hop2": """
        SELECT * FROM (
            SELECT source_train, source_station, e.train_no, e.station_code, e.scheduled_hour, 2 AS hop,
                   round(delay_min * 0.36::DOUBLE, 1) AS propagated_delay,
                   row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY first_rank, e.station_code, e.scheduled_hour, e.train_no) AS rank
            FROM (SELECT source_train, source_station, train_no, min(rank) AS first_rank, max(delay_min) AS delay_min
                  FROM hop1 GROUP BY ALL) h
            JOIN edges e ON e.train_no = h.train_no AND e.station_code <> source_station)
        WHERE rank <= 15""",
    "affected": """
        SELECT * EXCLUDE (delay_min) FROM hop1 UNION ALL BY NAME SELECT * FROM hop2""",
    "near_calls": """
        SELECT source_train, source_station, e.train_no FROM located
        JOIN edges e ON e.station_code = source_station AND e.train_no <> source_train
            AND abs(e.scheduled_hour - hour) <= 2""",
    "both_hops": """
        SELECT source_train, source_station, 1 AS hop, count(*) AS n FROM near_calls GROUP BY ALL
        UNION ALL
        SELECT source_train, source_station, 2, count(*)
        FROM (SELECT DISTINCT * FROM near_calls) t
        JOIN edges e ON e.train_no = t.train_no AND e.station_code <> source_station
        GROUP BY ALL""",
    "short1": """
        SELECT * FROM (
            SELECT source_train, source_station, e.train_no, e.station_code, e.scheduled_hour, delay_min, hour AS source_hour,
                   row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY abs(e.scheduled_hour - hour), e.train_no, e.scheduled_hour) AS rank
            FROM located JOIN edges e ON e.station_code = source_station AND e.train_no <> source_train
                 AND abs(e.scheduled_hour - hour) <= 2)
        WHERE rank <= 10""",
    "short2": """
        SELECT * FROM (
            SELECT source_train, source_station, e.train_no, e.station_code, e.scheduled_hour, delay_min,
                   row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY first_rank, e.station_code, e.scheduled_hour, e.train_no) AS rank
            FROM (SELECT source_train, source_station, train_no, min(rank) AS first_rank, max(delay_min) AS delay_min
                  FROM short1 GROUP BY ALL) h
            JOIN edges e ON e.train_no = h.train_no AND e.station_code <> source_station)
        WHERE rank <= 15""",
    "seen2": """
        SELECT source_train, source_station, train_no, station_code FROM short1
        UNION SELECT source_train, source_station, train_no, station_code FROM short2""",
    "short3": """
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY best, train_no, station_code, scheduled_hour) AS rank
            FROM (SELECT f.source_train, f.source_station, e.train_no, e.station_code, e.scheduled_hour,
                         max(f.delay_min) AS delay_min,
                         min(ROW(f.rank, abs(e.scheduled_hour - f.scheduled_hour), e.train_no, e.scheduled_hour)) AS best
                  FROM short2 f JOIN edges e ON e.station_code = f.station_code AND e.train_no <> f.source_train
                       AND abs(e.scheduled_hour - f.scheduled_hour) <= 2
                  WHERE NOT EXISTS (SELECT 1 FROM seen2 s WHERE s.source_train = f.source_train
                        AND s.source_station = f.source_station AND s.train_no = e.train_no
                        AND s.station_code = e.station_code)
                  GROUP BY ALL))
        WHERE rank <= 10""",
    "seen3": """
        SELECT * FROM seen2 UNION SELECT source_train, source_station, train_no, station_code FROM short3""",
    "short4": """
        SELECT * FROM (
            SELECT source_train, source_station, e.train_no, e.station_code, e.scheduled_hour, delay_min,
                   row_number() OVER (PARTITION BY source_train, source_station
                       ORDER BY first_rank, e.station_code, e.scheduled_hour, e.train_no) AS rank
            FROM (SELECT source_train, source_station, train_no, min(rank) AS first_rank, max(delay_min) AS delay_min
                  FROM short3 GROUP BY ALL) h
            JOIN edges e ON e.train_no = h.train_no AND e.station_code <> source_station
            WHERE NOT EXISTS (SELECT 1 FROM seen3 s WHERE s.source_train = h.source_train
                  AND s.source_station = h.source_station AND s.train_no = e.train_no
                  AND s.station_code = e.station_code))
        WHERE rank <= 15""",
    "spread0": "SELECT source_train AS train_no, source_station AS station_code, hour AS scheduled_hour, delay_min AS delay FROM located",
    **{f"spread{n}": spread_hop(n) for n in (1, 2, 3, 4)},
    "pages_of": r"""
        SELECT source, 'Rulebook ' || source AS source_title, doc_id AS page,
               CASE WHEN doc_id % 3 = 0 THEN (doc_id % 90 + 54) || CASE WHEN doc_id % 2 = 0 THEN 'A. ' ELSE '. ' END ELSE '' END
               || CASE WHEN doc_id % 5 = 0 THEN 'Ticket refund. ' ELSE '' END || text AS raw
        FROM documents""",
    "pages_read": r"""
        SELECT source, source_title, page, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body FROM pages_of""",
    "cut": r"""
        SELECT source, source_title, page,
               CASE WHEN len(regexp_extract_all(body, '(?m)^\s*(\d{1,4}[A-Z]?)[\.\s]', 1)) > 0
                    THEN regexp_extract_all(body, '(?m)^\s*(\d{1,4}[A-Z]?)[\.\s]', 1)[1] END AS section,
               body, unnest(range(0, length(body), 450)) AS pos
        FROM pages_read WHERE length(body) >= 30""",
    "chunked": """
        SELECT source, source_title, page, section, source || '_p' || page || '_o' || pos AS chunk_id,
               substr(body, pos + 1, 500) AS text
        FROM cut WHERE length(substr(body, pos + 1, 500)) >= 80""",
    "centroids": """
        SELECT label AS query_id, list(mean ORDER BY i) AS vector
        FROM (SELECT label, i, avg(x::DOUBLE) AS mean
              FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY ALL)
        GROUP BY label""",
    "hits": """
        SELECT * FROM (
            SELECT query_id, chunk_id, round(score, 6) AS score,
                   row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
            FROM (SELECT query_id, vec_id AS chunk_id,
                         round(list_cosine_similarity(vector, list_transform(embedding, lambda x: x::DOUBLE)), 12) AS score
                  FROM centroids CROSS JOIN embeddings))
        WHERE rank <= 4""",
    "cited": """
        SELECT query_id, rank, source_title, coalesce(nullif(page % 7, 0)::VARCHAR, 'N/A') AS section, page,
               body AS text
        FROM hits JOIN (SELECT *, raw AS body FROM pages_of) ON chunk_id = page""",
    "chunk_words": word_counts("chunk_id", "'passage: ' || text", "chunked"),
    "chunk_norms": "SELECT chunk_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM chunk_words GROUP BY chunk_id",
    "hashed_question_words": word_counts("item_id", "'query: ' || text", "benchmark"),
    "hashed_question_hits": best_chunks("hashed_question_words", 4),
    "chunk_terms": terms_of("chunk_id", "chunked"),
    "rarities": """
        SELECT term, ln((SELECT count(*) + 1 FROM chunked)::DOUBLE / (count(*) + 1)) AS idf FROM chunk_terms GROUP BY term""",
    "chunk_weights": """
        SELECT chunk_id, term, n * idf AS w, sqrt(sum(n * idf * n * idf) OVER (PARTITION BY chunk_id)) AS length
        FROM chunk_terms JOIN rarities USING (term)""",
    "question_terms": terms_of("item_id", "benchmark"),
    "question_weights": """
        SELECT item_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS length
        FROM (SELECT item_id, term, n * coalesce(idf, ln((SELECT count(*) + 1 FROM chunked)::DOUBLE)) AS w
              FROM question_terms LEFT JOIN rarities USING (term))""",
    "question_hits": """
        SELECT item_id AS query_id, chunk_id, round(score, 6) AS score,
               row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id)::INT AS rank
        FROM (SELECT item_id, chunk_id, round(sum(q.w / q.length * (c.w / c.length)), 12) AS score
              FROM question_weights q JOIN chunk_weights c USING (term) WHERE q.w > 0 AND c.w > 0 GROUP BY ALL)
        QUALIFY rank <= 4""",
    "first_said": "SELECT conv_id AS item_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "said_words": word_counts("item_id", "'query: ' || text", "first_said"),
    "said_hits": best_chunks("said_words", 2),
    "contexts": """
        SELECT query_id, string_agg('[Excerpt ' || rank || '] Source: ' || source_title || ', Section ' || section
                   || ', Page ' || page || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context
        FROM cited GROUP BY query_id""",
}

def needed(sql: str) -> list[str]:
    """Names of the table expressions a statement uses, directly or not."""

    def direct(text: str) -> set[str]:
        return set(re.findall(r"\w+", text)) & set(CTES)

    found: set[str] = set()
    waiting = direct(sql)
    while waiting:
        name = waiting.pop()
        found.add(name)
        waiting |= direct(CTES[name]) - found - {name}
    return [name for name in CTES if name in found]


def with_tables(sql: str) -> str:
    names = needed(sql)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql


MESSY_CLOCK = r"""
WITH texts AS (
    SELECT event_id, CASE event_id % 8
        WHEN 0 THEN (event_id % 24) || '.' || lpad((event_id // 24 % 60)::VARCHAR, 2, '0')
        WHEN 1 THEN lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id // 24 % 60)::VARCHAR, 2, '0')
        WHEN 2 THEN (event_id % 24 % 12 + 1) || '.' || lpad((event_id // 24 % 60)::VARCHAR, 2, '0') || ' PM'
        WHEN 3 THEN (event_id % 24 % 12 + 1) || ':' || lpad((event_id // 24 % 60)::VARCHAR, 2, '0') || ' am'
        WHEN 4 THEN lpad((event_id % 24)::VARCHAR, 2, '0') || '.:' || lpad((event_id // 24 % 60)::VARCHAR, 2, '0')
        WHEN 5 THEN (event_id % 24) || '.' || (event_id // 24 % 60 % 10)
        WHEN 6 THEN 'Start' ELSE 'NA' END AS clock
    FROM events),
parts AS (
    SELECT *, try_cast(regexp_extract(clock, '^(\d{1,2})', 1) AS INT) AS h,
           regexp_extract(clock, '^\d{1,2}[.:]+(\d{1,2})', 1) AS m,
           regexp_extract(clock, '^\d{1,2}([.:]+)', 1) AS sep,
           lower(regexp_extract(clock, '([AaPp])[Mm]$', 1)) AS half
    FROM texts),
read AS (
    SELECT event_id, clock,
           CASE WHEN half = 'a' AND h = 12 THEN 0 WHEN half = 'p' AND h < 12 THEN h + 12 ELSE h END AS hour,
           CASE WHEN sep = '.' AND length(m) = 1 THEN try_cast(m AS INT) * 10 ELSE try_cast(m AS INT) END AS minute
    FROM parts)
SELECT event_id, clock, coalesce(CASE WHEN hour < 24 AND minute < 60 THEN hour * 60 + minute END, -1) AS minutes
FROM read"""

AIR_COLUMNS = list(fv.POLLUTANTS.values())
RATIO = "100.0::DOUBLE * count(*) FILTER ({}) / count(*)"
SHOWN = "SELECT *, round(greatest(arrival_delay_min, 0::DOUBLE), 1) AS delay_shown FROM labelled"
QUESTION = "'" + fv.RIGHTS_QUESTION.replace("%d", "' || floor(delay_shown)::BIGINT || '") + "'"
KEYED_42 = "train_no || '|' || stop_seq || '|42'"
INPUTS = [*fv.NUMERIC_FEATURES, "train_no_freq", "station_code_freq"]

STATEMENTS = {
    "schedule_features": """
        SELECT train_no, train_name, station_code, station_name, coalesce(journey_day, -1) AS journey_day,
               coalesce(arrival, '') AS arrival, departure, scheduled_hour, stop_seq, total_stops,
               cumulative_travel_min, dwell_min, is_peak_hour, route_length_cat, run_date::VARCHAR AS run_date
        FROM stops""",
    "schedule_overnight": """
        SELECT station_code, sum(d)::BIGINT AS dwell_min, count(*) FILTER (d > 10) AS long_stops
        FROM (SELECT station_code, coalesce(CASE WHEN arr_abs_min > dep_abs_min THEN dep_abs_min - arr_abs_min + 1440
                     ELSE dep_abs_min - arr_abs_min END, 0) AS d FROM stops)
        GROUP BY station_code""",
    "route_category": """
        SELECT route_length_cat, total_stops, count(*) AS stops, count(DISTINCT train_no) AS trains
        FROM stops GROUP BY ALL""",
    "enriched_stops": """
        SELECT train_no, stop_seq, coalesce(train_type, '') AS train_type, coalesce(train_zone, '') AS train_zone,
               coalesce(total_distance_km, -1) AS total_distance_km, coalesce(duration_hours, -1) AS duration_hours,
               coalesce(has_sleeper, -1) AS has_sleeper, coalesce(state, '') AS state, coalesce(zone, '') AS zone,
               coalesce(latitude, -1::DOUBLE) AS latitude, coalesce(longitude, -1::DOUBLE) AS longitude,
               round(pm25, 4) AS pm25, round(no2, 4) AS no2, round(pm10, 4) AS pm10
        FROM enriched""",
    "air_fanout": """
        SELECT station_code, count(*) AS joined_rows, round(avg(coalesce(w.pm25, 60.0::DOUBLE)), 3) AS avg_pm25
        FROM stops s LEFT JOIN air_wide w ON upper(s.station_name) = w.city GROUP BY station_code""",
    "silver_timings": f"""
        SELECT stop_seq, hour_of_day, is_peak_hour, station_zone, fog_factor, count(*) AS stops,
               sum(s_no)::BIGINT AS s_no_sum, count(DISTINCT train_zone) AS train_zones, min(state) AS first_state
        FROM (
            SELECT row_number() OVER (PARTITION BY train_number ORDER BY s_no, s.station_code, departure)
                       AS stop_seq,
                   coalesce({HOUR.format(c="departure")}, 12) AS hour_of_day,
                   {peak("coalesce(" + HOUR.format(c="departure") + ", 12)", fv.PEAK_TIMINGS)} AS is_peak_hour,
                   coalesce(t.zone, '') AS train_zone, coalesce(st.zone, '') AS station_zone,
                   coalesce(st.state, '') AS state,
                   CASE WHEN a.pm25 > 150 THEN 1.5::DOUBLE WHEN a.pm25 > 80 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS fog_factor,
                   s_no
            FROM (SELECT *, run_date - DATE '1990-01-01' AS s_no FROM schedules) s
            LEFT JOIN trains t ON t.train_no = s.train_number
            LEFT JOIN stations st ON st.station_code = s.station_code
            LEFT JOIN city_air a ON a.city = st.state)
        GROUP BY ALL""",
    "feature_ranges": """
        SELECT count(*) AS total_records, count(DISTINCT train_no) AS unique_trains,
               count(DISTINCT station_code) AS unique_stations, round(avg(stop_seq), 1) AS avg_stop_seq,
               max(total_stops) AS max_stops, round(avg(cumulative_travel_min), 1) AS avg_cumulative_min,
               round(avg(dwell_min), 2) AS avg_dwell_min, round(avg(pm25), 1) AS avg_pm25
        FROM enriched""",
    "zone_pm25": """
        SELECT zone, round(avg(pm25), 1) AS avg_pm25, count(DISTINCT train_no) AS trains, count(*) AS stop_records
        FROM enriched WHERE zone IS NOT NULL GROUP BY zone ORDER BY avg_pm25 DESC, zone""",
    "aq_pivot": "SELECT city, obs_date::VARCHAR AS obs_date, latitude, longitude, "
    + ", ".join(f"round(coalesce({c}, -1::DOUBLE), 4) AS {c}" for c in AIR_COLUMNS)
    + " FROM air_wide",
    "top_polluted_cities": """
        SELECT city, round(avg(pm25), 1) AS avg_pm25, round(avg(no2), 1) AS avg_no2, count(*) AS observation_days
        FROM air_wide WHERE pm25 IS NOT NULL GROUP BY city ORDER BY avg_pm25 DESC, city LIMIT 15""",
    "zone_state_pm25": "SELECT z AS zone, s AS state_for_aq, round(state_pm25, 4) AS state_pm25 FROM (VALUES "
    + ", ".join(f"('{z}', '{s}')" for z, s in fv.ZONE_STATES)
    + f""") m(z, s) LEFT JOIN (SELECT state, {mean("reading")} AS state_pm25 FROM air_long
           WHERE pollutant_id = 'PM2.5' GROUP BY state) ON state = s""",
    "delay_labels": """
        SELECT train_no, stop_seq, fog_factor, type_factor, round(stop_factor, 6) AS stop_factor, peak_factor,
               dwell_factor, round(arrival_delay_min, 5) AS arrival_delay_min
        FROM labelled""",
    "delay_by_zone": """
        SELECT zone, round(avg(pm25), 1) AS avg_pm25, round(avg(arrival_delay_min), 1) AS avg_delay,
               count(DISTINCT train_no) AS trains
        FROM labelled WHERE zone IS NOT NULL GROUP BY zone ORDER BY avg_delay DESC, zone""",
    "delay_sketches": """
        SELECT coalesce(zone, '') AS zone, count(arrival_delay_min) AS n, 1 AS p50, 1 AS p90, 1 AS n_trains FROM labelled GROUP BY ALL""",
    "delay_distribution": f"""
        SELECT round(quantile_cont(arrival_delay_min, 0.5), 1) AS p50,
               round(quantile_cont(arrival_delay_min, 0.9), 1) AS p90,
               round({RATIO.format("arrival_delay_min < 5")}, 1) AS pct_on_time,
               round({RATIO.format("arrival_delay_min > 30")}, 1) AS pct_major_delay
        FROM labelled""",
    "trains_by_city": """
        SELECT city, count(*) AS scheduled_trains, round(avg(pm25), 1) AS avg_pm25, round(avg(no2), 1) AS avg_no2
        FROM enriched WHERE city IS NOT NULL GROUP BY city""",
    "hourly_schedule": """
        SELECT scheduled_hour, count(*) AS num_trains FROM stops WHERE scheduled_hour IS NOT NULL
        GROUP BY scheduled_hour ORDER BY scheduled_hour""",
    "polluted_routes": """
        SELECT city, round(avg(pm25), 1) AS avg_pm25, count(DISTINCT train_no) AS trains_affected
        FROM enriched WHERE pm25 IS NOT NULL AND city IS NOT NULL GROUP BY city ORDER BY avg_pm25 DESC, city""",
    "top_polluted_routes": """
        SELECT city, round(avg(pm25), 1) AS avg_pm25, count(DISTINCT train_no) AS trains_affected
        FROM enriched GROUP BY city ORDER BY avg_pm25 DESC, city LIMIT 5""",
    "hazardous_cities": """
        SELECT count(*) AS hazardous_cities
        FROM (SELECT city FROM enriched GROUP BY city HAVING round(avg(pm25), 1) > 100)""",
    "total_trains": "SELECT count(DISTINCT train_no) AS total_trains FROM stops",
    "rule_prediction": f"""
        SELECT {RULE} AS predicted_delay_min, '{fv.RULE_RUN_DATE}' AS run_date, count(*) AS stops
        FROM enriched GROUP BY ALL""",
    "avg_predicted_delay": "SELECT round(avg(predicted_delay_min), 1) AS avg_predicted_delay FROM predictions",
    "monthly_delay": """
        SELECT month(run_date)::INT AS m, round(avg(predicted_delay_min), 1) AS avg_delay
        FROM predictions GROUP BY ALL ORDER BY m""",
    "delayed_pairs": """
        SELECT train_no, station_code, round(avg(predicted_delay_min), 1) AS avg_delay
        FROM predictions GROUP BY ALL ORDER BY avg_delay DESC, train_no, station_code LIMIT 10""",
    "scatter_points": f"""
        SELECT train_no, station_code, day, round(pm25, 4) AS pm25, predicted_delay_min
        FROM (SELECT *, run_date::VARCHAR AS day FROM predictions WHERE pm25 IS NOT NULL)
        ORDER BY {md5_int("train_no || '|' || station_code || '|' || day || '|42'")},
                 train_no, station_code, day, pm25, predicted_delay_min LIMIT 2000""",
    "highest_prediction": """
        SELECT train_no, station_code, round(arrival_delay_min, 5) AS predicted_delay_min
        FROM labelled ORDER BY labelled.arrival_delay_min DESC, train_no, station_code LIMIT 1""",
    "error_metrics": """
        SELECT round(avg(abs(actual_delay_min - predicted_delay_min)), 2) AS mae_all_rows,
               round(sqrt(avg((actual_delay_min - predicted_delay_min) ** 2)), 2) AS rmse_all_rows,
               count(*) AS total_predictions, round(avg(actual_delay_min), 2) AS avg_actual_delay,
               round(avg(predicted_delay_min), 2) AS avg_predicted_delay
        FROM predictions""",
    "baseline_metrics": f"""
        SELECT round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(1 - res / tot, 4) AS r2,
               round(baseline_mae, 4) AS baseline_mae,
               round(100 * (baseline_mae - mae) / baseline_mae, 4) AS improvement_pct
        FROM (SELECT avg(abs(a - p)) AS mae, sqrt(avg((a - p) ** 2)) AS rmse, sum((a - p) ** 2) AS res,
                     sum((a - test_mean) ** 2) AS tot, avg(abs(a - train_mean)) AS baseline_mae
              FROM (SELECT arrival_delay_min AS a, {RULE} AS p, {md5_int(KEYED_42, 2)} % 100 < 80 AS is_train,
                           avg(arrival_delay_min) FILTER ({md5_int(KEYED_42, 2)} % 100 < 80) OVER () AS train_mean,
                           avg(arrival_delay_min) FILTER ({md5_int(KEYED_42, 2)} % 100 >= 80) OVER () AS test_mean
                    FROM labelled)
              WHERE NOT is_train)""",
    "risk_levels": f"""
        SELECT {RISK} AS risk, {FOG_LABEL} AS fog, count(*) AS stops, max(delay_shown) AS longest
        FROM (SELECT *, round(greatest(predicted_delay_min, 0::DOUBLE), 1) AS delay_shown FROM predictions)
        GROUP BY ALL""",
    "passenger_forecast": f"""
        SELECT train_no, stop_seq, delay_shown, {RISK} AS risk, {FOG_LABEL} AS fog, {QUESTION} AS rights_question
        FROM ({SHOWN})""",
    "rights_queries": f"""
        SELECT {QUESTION} AS query_text, count(*) AS stops FROM ({SHOWN}) GROUP BY ALL""",
    "junction_trains": f"""
        SELECT station_code, count(DISTINCT train_no) AS trains FROM stops
        WHERE list_contains({JUNCTIONS}, station_code) GROUP BY station_code
        ORDER BY trains DESC, station_code LIMIT 1""",
    "trains_through_city": "SELECT count(DISTINCT train_no) AS trains FROM enriched WHERE city = 'NATION_7'",
    "polluted_trains": "SELECT DISTINCT train_no, train_name FROM enriched WHERE pm25 > 100",
    "first_stops": "SELECT * FROM edges ORDER BY train_no, station_code, scheduled_hour LIMIT 10",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS n FROM {source}"
        for name, source in {
            "schedules": "schedules",
            "trains": "trains",
            "stations": "stations",
            "air_quality": "air_wide",
            "schedule_features": "stops",
            "trains_by_city": "(SELECT DISTINCT city FROM enriched WHERE city IS NOT NULL)",
            "rules_chunks": "chunked",
        }.items()
    ),
    "freq_encode": """
        SELECT train_no, stop_seq, station_code, (count(*) OVER (PARTITION BY train_no))::DOUBLE AS train_no_freq,
               (count(*) OVER (PARTITION BY station_code))::DOUBLE AS station_code_freq
        FROM stops""",
    "label_encode": """
        SELECT coalesce(tc, -1)::INT AS train_type_code, coalesce(zc, -1)::INT AS zone_code, count(*) AS stops,
               coalesce(min(e.train_type), '') AS train_type, coalesce(min(e.zone), '') AS zone
        FROM enriched e
        LEFT JOIN (SELECT train_type, row_number() OVER (ORDER BY train_type) - 1 AS tc
                   FROM (SELECT DISTINCT train_type FROM enriched WHERE train_type IS NOT NULL)) t USING (train_type)
        LEFT JOIN (SELECT zone, row_number() OVER (ORDER BY zone) - 1 AS zc
                   FROM (SELECT DISTINCT zone FROM enriched WHERE zone IS NOT NULL)) z ON z.zone = e.zone
        GROUP BY ALL""",
    "filled_features": "SELECT coalesce(zone, 'UNKNOWN') AS zone, "
    + ", ".join(f"round(avg(coalesce({c}, {fv.NUMERIC_DEFAULTS[c]})), 4) AS {c}" for c in INPUTS)
    + """, 0::DOUBLE AS platform_count
        FROM (SELECT *, (count(*) OVER (PARTITION BY train_no))::DOUBLE AS train_no_freq,
                     (count(*) OVER (PARTITION BY station_code))::DOUBLE AS station_code_freq FROM labelled)
        GROUP BY ALL""",
    "hash_split": f"""
        SELECT train_no, stop_seq, ({md5_int(KEYED_42, 2)} % 100 < 80)::INT AS is_train FROM stops""",
    "date_split": """
        SELECT 'train' AS name, count(*) AS n FROM stops WHERE run_date < DATE '1998-01-01' OR stop_seq = 3
        UNION ALL SELECT 'test', count(*) FROM stops WHERE run_date >= DATE '1998-01-01' AND stop_seq <> 3""",
    "stratified_sample": f"""
        SELECT train_no, stop_seq, round(arrival_delay_min, 5) AS arrival_delay_min
        FROM (SELECT *, row_number() OVER (PARTITION BY arrival_delay_min > 30
                  ORDER BY {md5_int(KEYED_42)}, train_no, stop_seq) AS n FROM labelled)
        WHERE n <= CASE WHEN arrival_delay_min > 30 THEN 1000 ELSE 4000 END""",
    "explain_sample": f"""
        SELECT train_no, stop_seq, station_code FROM stops
        WHERE {md5_int(KEYED_42, 3)} < {int(fv.EXPLAIN_FRACTION * 2**32)}
        ORDER BY {md5_int(KEYED_42)}, train_no, stop_seq LIMIT {fv.EXPLAIN_ROWS}""",
    "request_features": f"""
        SELECT r.c_custkey AS request_id, r.train_no, r.station_code, r.scheduled_hour,
               coalesce(t.n, 100)::DOUBLE AS train_no_freq, coalesce(s.n, 100)::DOUBLE AS station_code_freq,
               0 AS stop_seq, 50 AS total_stops, 5 AS dwell_min, coalesce(r.pm25, 80.0::DOUBLE) AS pm25,
               30.0::DOUBLE AS no2, 'EXP' AS train_type, 'SR' AS zone,
               {peak("r.scheduled_hour", fv.PEAK_REQUEST)} AS is_peak_hour,
               list_contains({JUNCTIONS}, r.station_code)::INT AS is_junction
        FROM (SELECT c_custkey, (c_custkey * 3)::VARCHAR AS train_no, {station_code("(c_custkey % 997)")} AS station_code,
                     (c_custkey % 24)::INT AS scheduled_hour,
                     CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey * 8.0::DOUBLE END AS pm25 FROM customer) r
        LEFT JOIN (SELECT train_no, count(*) AS n FROM stops GROUP BY ALL) t ON t.train_no = r.train_no
        LEFT JOIN (SELECT station_code, count(*) AS n FROM stops GROUP BY ALL) s ON s.station_code = r.station_code""",
    "station_edges": "SELECT * FROM edges",
    "edge_frequency": """
        SELECT train_no, station_code, count(*) AS frequency FROM edges GROUP BY ALL
        ORDER BY frequency DESC, train_no, station_code LIMIT 10""",
    "cascade_hop1": "SELECT * EXCLUDE (delay_min) REPLACE (rank::INT AS rank) FROM hop1",
    "cascade_hop2": "SELECT * REPLACE (rank::INT AS rank) FROM hop2",
    "cascade_summary": """
        SELECT source_train, source_station, sum(n)::BIGINT AS total_affected,
               coalesce(sum(n) FILTER (hop = 1), 0)::BIGINT AS hop1_count, coalesce(sum(n) FILTER (hop = 2), 0)::BIGINT AS hop2_count
        FROM both_hops GROUP BY ALL""",
    "cascade_wrapped": """
        SELECT scheduled_hour, count(*) AS stops, round(sum(d), 1) AS delay
        FROM (SELECT e.scheduled_hour, round(delay_min * 0.6::DOUBLE, 1) AS d,
                     row_number() OVER (PARTITION BY source_train, source_station
                         ORDER BY least(abs(e.scheduled_hour - hour), 24 - abs(e.scheduled_hour - hour)),
                                  e.train_no, e.scheduled_hour) AS rank
              FROM located JOIN edges e ON e.station_code = source_station AND e.train_no <> source_train
                   AND least(abs(e.scheduled_hour - hour), 24 - abs(e.scheduled_hour - hour)) <= 2)
        WHERE rank <= 10 GROUP BY scheduled_hour""",
    "cascade_four_hops": " UNION ALL ".join(
        f"SELECT {hop} AS hop, count(*) AS stops, count(DISTINCT source_train || ',' || source_station) AS sources, "
        f"round(max(delay_min) * {fv.CASCADE_DECAY**hop!r}::DOUBLE, 1) AS longest, "
        f"sum(scheduled_hour * rank)::BIGINT AS hour_sum, count(DISTINCT train_no) AS trains FROM short{hop}"
        for hop in (1, 2, 3, 4)
    ),
    "network_spread": f"""
        SELECT train_no, station_code, (min(hop) FILTER (here = most))::INT AS hop, round(max(most), 1) AS propagated_delay
        FROM (SELECT *, max(here) OVER (PARTITION BY train_no, station_code) AS most
              FROM ({" UNION ALL ".join(
                  f"SELECT train_no, station_code, {n} AS hop, max(delay) * {fv.CASCADE_DECAY**n!r}::DOUBLE AS here FROM spread{n} GROUP BY ALL"
                  for n in (1, 2, 3, 4))}))
        GROUP BY ALL""",
    "cascade_json": """
        SELECT source_train, source_station, count(*)::INT AS n, arg_min(train_no, hop * 100 + rank) AS first_train,
               arg_min(propagated_delay, hop * 100 + rank) AS first_delay
        FROM affected GROUP BY ALL""",
    "rule_chunks": "SELECT * REPLACE (coalesce(section, '') AS section) FROM chunked",
    "chunk_row_ids": "SELECT count(*) AS chunks, count(DISTINCT chunk_id) AS ids FROM chunked",
    "rules_by_source": """
        SELECT source, source_title, count(*) AS chunk_count, min(page) AS first_page, max(page) AS last_page
        FROM chunked GROUP BY ALL""",
    "chunks_by_source": "SELECT source, count(*) AS chunk_count FROM chunked GROUP BY source",
    "section_preview": f"""
        SELECT page, section, substr(text, 1, 200) AS preview, chunk_id FROM chunked
        WHERE list_contains({sql_list(fv.RIGHTS_SECTIONS)}, section) ORDER BY page, chunk_id LIMIT 10""",
    "section_preview_source": f"""
        SELECT page, section, substr(text, 1, 200) AS preview, chunk_id FROM chunked
        WHERE list_contains({sql_list(fv.RIGHTS_SECTIONS)}, section) AND source = 'src19' ORDER BY page, chunk_id LIMIT 10""",
    "keyword_chunks": f"""
        SELECT chunk_id, text FROM chunked
        WHERE regexp_matches(text, '{fv.RIGHTS_WORDS}')""",
    "keyword_preview": f"""
        SELECT source, page, coalesce(section, '') AS section, substr(text, 1, 180) AS preview, chunk_id FROM chunked
        WHERE regexp_matches(text, '{fv.RIGHTS_WORDS}') ORDER BY page, chunk_id LIMIT 10""",
    "vector_norms": """
        SELECT vec_id AS chunk_id, 1.0::DOUBLE AS length,
               round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)
                   AS first
        FROM embeddings""",
    "vector_topk": "SELECT query_id, chunk_id, round(score, 4) AS score, rank::INT AS rank FROM hits",
    "rag_context": "SELECT * FROM contexts",
    "citations": """
        SELECT query_id, string_agg(source_title || ', ' || section || ', ' || page, '; ' ORDER BY rank) AS citations
        FROM cited GROUP BY query_id""",
    "approximate_recall": """
        SELECT count(*) * least(4, (SELECT count(*) FROM embeddings)) AS wanted, 1 AS enough FROM embeddings WHERE vec_id % 20 = 0""",
    "rag_fallback": f"""
        SELECT q.query_id, (context IS NOT NULL)::INT AS matched,
               coalesce(context, '{fv.NO_MATCH_ANSWER.replace("'", "''")}') AS context
        FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) q
        LEFT JOIN contexts c ON c.query_id = q.query_id""",
    "question_topk": "SELECT * FROM question_hits",
    "hashed_question_topk": "SELECT * FROM hashed_question_hits",
    "question_context": f"""
        SELECT query_id, string_agg({EXCERPT}, chr(10) ORDER BY rank) AS context,
               string_agg(source_title || ', ' || coalesce(section, 'N/A') || ', ' || page, '; ' ORDER BY rank) AS citations
        FROM question_hits JOIN chunked USING (chunk_id) GROUP BY query_id""",
    "chat_fallback": f"""
        SELECT item_id AS query_id, (context IS NOT NULL)::INT AS matched,
               coalesce(context, '{fv.NO_MATCH_ANSWER.replace("'", "''")}') AS context
        FROM first_said LEFT JOIN (
            SELECT query_id, string_agg({EXCERPT}, chr(10) ORDER BY rank) AS context
            FROM said_hits JOIN chunked USING (chunk_id) WHERE score >= 0.55 GROUP BY query_id)
            ON query_id = item_id""",
    "messy_clocks": MESSY_CLOCK,
    "train_numbers": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 OR key > 99999 THEN '' ELSE key::VARCHAR END AS train_no
        FROM (SELECT o_orderkey, (o_orderkey + 10000) * CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 1 END AS key FROM orders)""",
    "csv_air_ingest": """
        SELECT city, count(*) AS days, round(avg(pm25), 4) AS pm25, round(avg(no2), 4) AS no2
        FROM air_wide GROUP BY city""",
    "json_schedule_ingest": """
        SELECT station_code, count(*) AS stops, count(nullif(arrival, 'None')) AS arrivals, count(day) AS days,
               count(DISTINCT departure) AS departures
        FROM schedules GROUP BY station_code""",
    "geojson_trains": "SELECT * FROM trains",
    "geojson_stations": "SELECT * REPLACE (coalesce(zone, '') AS zone) FROM stations",
    "csv_layouts": """
        SELECT days, count(*) AS stops, count(train_no) AS numbers, count(train_name) AS names,
               count(origin) AS origins, coalesce(sum(a)::BIGINT, -1) AS arrivals,
               coalesce(sum(d)::BIGINT, -1) AS departures, count(*) AS lineage
        FROM (
            SELECT CASE sheet WHEN 0 THEN '' WHEN 1 THEN 'Daily, all' ELSE 'Monday, Sunday' END AS days,
                   CASE WHEN length(train_number) BETWEEN 4 AND 5 THEN train_number END AS train_no,
                   train_name, CASE WHEN sheet = 1 THEN station_name END AS origin,
                   CASE WHEN sheet <> 0 THEN try_cast(split_part(arrival, ':', 1) AS INT) * 60
                        + try_cast(split_part(arrival, ':', 2) AS INT) END AS a,
                   CASE WHEN sheet <> 2 THEN try_cast(split_part(departure, ':', 1) AS INT) * 60
                        + try_cast(split_part(departure, ':', 2) AS INT) END AS d
            FROM (SELECT *, coalesce(day, 0) % 3 AS sheet FROM schedules))
        GROUP BY days""",
    "running_history": """
        SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS runs,
               min(o_orderdate::DATE)::VARCHAR AS first_run
        FROM orders GROUP BY ALL""",
    "layer_counts": """
        SELECT 'bronze' AS name, count(*) AS n FROM schedules UNION ALL SELECT 'silver', count(*) FROM stops
        UNION ALL SELECT 'gold', count(*) FROM labelled""",
    "sql_views": """
        SELECT t.zone, count(*) AS stops, count(DISTINCT s.train_no) AS trains, max(s.total_stops) AS longest
        FROM stops s JOIN trains t ON s.train_no = t.train_no GROUP BY t.zone""",
    "model_score_checks": f"""
        SELECT train_no, stop_seq, round(arrival_delay_min, 5) AS actual, 1 AS in_range
        FROM labelled WHERE {md5_int(KEYED_42, 2)} % 100 >= 80""",
    "model_attribution_checks": f"""
        SELECT least(count(*), {fv.EXPLAIN_ROWS}) AS rows_explained, 0 AS rows_off FROM labelled
        WHERE {md5_int(KEYED_42, 2)} % 100 >= 80 AND {md5_int(KEYED_42, 3)} < {int(fv.EXPLAIN_FRACTION * 2**32)}""",
    "exact_attribution_checks": f"""
        SELECT least(count(*), {fv.EXPLAIN_ROWS}) AS rows_explained, 0 AS rows_off FROM labelled
        WHERE {md5_int(KEYED_42, 2)} % 100 >= 80 AND {md5_int(KEYED_42, 3)} < {int(fv.EXPLAIN_FRACTION * 2**32)}""",
    "table_score_checks": f"""
        SELECT count(*) AS rows_scored, 0 AS rows_off FROM labelled WHERE {md5_int(KEYED_42, 2)} % 100 >= 80""",
    "partitioned_by_zone": """
        SELECT coalesce(zone, '') AS zone, count(*) AS stops, round(avg(arrival_delay_min), 3) AS avg_delay
        FROM labelled GROUP BY ALL""",
    "zordered_files": """
        SELECT 'train_no' AS key, count(DISTINCT train_no) AS values, 1 AS skips FROM stops
        UNION ALL SELECT 'station_code', count(DISTINCT station_code), 1 FROM stops""",
    "zordered_lookup": """
        SELECT station_code, count(*) AS stops, sum(cumulative_travel_min)::BIGINT AS travel_min
        FROM stops GROUP BY station_code""",
    "clustered_lookup": """
        SELECT station_code, count(*) AS stops, sum(cumulative_travel_min)::BIGINT AS travel_min
        FROM stops GROUP BY station_code""",
    "snapshot_diff": """
        WITH before AS (SELECT nullif(o_orderkey, 1) AS o_orderkey, o_orderstatus, o_totalprice FROM orders),
        after AS (
            SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' WHEN o_orderkey % 7 = 0 THEN NULL
                                    ELSE o_orderstatus END AS o_orderstatus, o_totalprice
            FROM before WHERE o_orderkey IS NULL OR o_orderkey % 11 <> 0
            UNION ALL SELECT -o_orderkey - 1, o_orderstatus, o_totalprice FROM before WHERE o_orderkey % 13 = 0)
        SELECT a.o_orderkey, coalesce(a.o_orderstatus, '') AS o_orderstatus, a.o_totalprice,
               CASE WHEN b.known IS NULL THEN 'insert' ELSE 'update' END AS _change_type
        FROM after a LEFT JOIN (SELECT *, 1 AS known FROM before) b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey
        WHERE b.known IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
              OR a.o_totalprice IS DISTINCT FROM b.o_totalprice
        UNION ALL
        SELECT o_orderkey, o_orderstatus, o_totalprice, 'delete' FROM before b
        WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey)""",
    "text_sequence": """
        SELECT train_number, coalesce(departure, '') AS departure,
               row_number() OVER (PARTITION BY train_number ORDER BY departure NULLS FIRST) AS stop_seq
        FROM (SELECT train_number, nullif(departure, '--:--') AS departure FROM schedules)""",
}

ORACLE = {
    name: sql.strip() if sql.strip().startswith("WITH") else with_tables(sql.strip())
    for name, sql in STATEMENTS.items()
}
