"""Names, thresholds, defaults and patterns the results depend on."""

# Which state's air stands for each railway zone.
ZONE_STATES = (
    ("NR", "DELHI"),
    ("NCR", "UTTAR PRADESH"),
    ("NWR", "RAJASTHAN"),
    ("NER", "UTTAR PRADESH"),
    ("NFR", "ASSAM"),
    ("ECR", "BIHAR"),
    ("ER", "WEST BENGAL"),
    ("SER", "JHARKHAND"),
    ("ECoR", "ODISHA"),
    ("SCR", "TELANGANA"),
    ("SECR", "CHHATTISGARH"),
    ("CR", "MAHARASHTRA"),
    ("WR", "GUJARAT"),
    ("WCR", "MADHYA PRADESH"),
    ("SR", "TAMIL NADU"),
    ("SWR", "KARNATAKA"),
    ("KR", "KERALA"),
)

# Pollutant codes and the columns they become.
POLLUTANTS = {
    "PM2.5": "pm25",
    "PM10": "pm10",
    "NO2": "no2",
    "SO2": "so2",
    "CO": "co",
    "OZONE": "ozone",
    "NH3": "nh3",
}

# Readings assumed where a city has none.
AIR_DEFAULTS = {"pm25": 60.0, "no2": 30.0, "pm10": 80.0}

# Delay multipliers. Each ladder is read top down, first match wins.
FOG_LADDER = ((150, 3.5), (120, 2.8), (100, 2.2), (80, 1.6), (60, 1.2))
COARSE_FOG_LADDER = ((150, 1.5), (80, 1.2))
TRAIN_TYPE_LADDER = (
    ("(?i)raj|shatabdi|vande", 0.45),
    ("(?i)dur|exp", 0.80),
    ("(?i)pass|pgr", 1.40),
    ("(?i)memu|demu|mmts", 1.05),
)
DWELL_LADDER = ((10, 1.3), (5, 1.1))
PEAK_FACTOR = 1.30
STOP_SLOPE = 1.5
NOISE_SIGMA = 0.7
NOISE_MU = 1.6
MAX_DELAY_MIN = 360.0

# Clock hours counted as peak (inclusive), in three uses.
PEAK_TIMETABLE = ((6, 10), (17, 21))
PEAK_TIMINGS = ((7, 10), (17, 20))
PEAK_REQUEST = ((6, 10), (17, 20))

# Rule-based delay in minutes.
RULE_PM25 = ((150, 45), (100, 30))
RULE_PEAK = 20
RULE_OTHER = 10
RULE_RUN_DATE = "2024-01-15"

# Labels shown to passengers.
RISK_LADDER = ((45, "High"), (20, "Medium"))
FOG_LABEL_LADDER = ((150, "High"), (100, "Moderate"))
HEAVY_PM25 = 100
RIGHTS_QUESTION = (
    "My train is delayed by %d minutes. "
    "What are my refund and compensation rights under the Railways Act 1989?"
)

# Major interchange stations.
JUNCTIONS = ("MAS", "SBC", "NDLS", "HWH", "CSMT", "SC", "HYB", "BCT")

# Model inputs and what replaces a missing one.
NUMERIC_FEATURES = (
    "stop_seq",
    "total_stops",
    "cumulative_travel_min",
    "dwell_min",
    "scheduled_hour",
    "is_peak_hour",
    "pm25",
    "no2",
    "journey_day",
    "total_distance_km",
    "duration_hours",
    "latitude",
    "longitude",
)
FREQUENCY_FEATURES = ("train_no", "station_code")
CATEGORY_FEATURES = ("train_type", "zone")
NUMERIC_DEFAULTS = {
    "stop_seq": 0,
    "total_stops": 50,
    "cumulative_travel_min": 0,
    "dwell_min": 5,
    "scheduled_hour": 12,
    "is_peak_hour": 0,
    "pm25": 60.0,
    "no2": 25.0,
    "journey_day": 1,
    "total_distance_km": 500,
    "duration_hours": 8,
    "latitude": 20.0,
    "longitude": 77.0,
    "train_no_freq": 1.0,
    "station_code_freq": 1.0,
}
UNKNOWN = "UNKNOWN"
REQUEST_DEFAULTS = {
    "stop_seq": 0,
    "total_stops": 50,
    "cumulative_travel_min": 0,
    "dwell_min": 5,
    "journey_day": 1,
    "pm25": 80.0,
    "no2": 30.0,
    "train_type": "EXP",
    "zone": "SR",
}
REQUEST_FREQUENCY = 100

# Sampling and boosting sizes.
TRAIN_ROWS = 150_000
MAJOR_DELAY_MIN = 30
SCATTER_ROWS = 2000
EXPLAIN_FRACTION = 0.005
EXPLAIN_ROWS = 1000
BACKGROUND_ROWS = 50

# Rulebook chunking and search.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MIN_PAGE_CHARS = 30
MIN_CHUNK_CHARS = 80
SECTION_PATTERN = r"(?m)^\s*(\d{1,4}[A-Z]?)[\.\s]"
RIGHTS_SECTIONS = ("54", "55", "123", "124", "124A", "138")
RIGHTS_WORDS = "(?i)refund|compensation|untoward|accident|passenger|ticket|delay"
NO_MATCH_ANSWER = (
    "I don't have relevant rulebook content for that question. "
    "Please contact a railway officer."
)

# Delay passed on along the network.
CASCADE_DECAY = 0.6
CASCADE_WINDOW_H = 2
CASCADE_CAPS = (10, 15)

# Candidate names of the run-date column, in order of preference.
DATE_COLUMNS = ("date", "run_date", "schedule_date", "actual_date")
