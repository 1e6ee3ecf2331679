"""Fixed values of the domain: vocabularies, thresholds and lookup tables.

Everything in this file must equal the published behaviour for results to match, so it is written
out plainly and in one place.
"""

from __future__ import annotations

# --- hazards -----------------------------------------------------------------------------------
HAZARDS = (
    "pm25", "ozone", "no2", "pollen_tree", "pollen_grass", "pollen_weed", "traffic_prox",
    "construction", "industrial_prox", "grade", "heat", "cold_air", "humidity", "crowd_density",
    "shade_deficit",
)
POLLEN_HAZARDS = ("pollen_tree", "pollen_grass", "pollen_weed")
RASTER_HAZARDS = ("pm25", "ozone", "no2")

# --- study area --------------------------------------------------------------------------------
CITY_BBOX = (-74.25909, 40.477399, -73.700272, 40.917577)  # west, south, east, north
LOCAL_ZONE = "America/New_York"

# --- street network ----------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8
MAX_SEGMENT_LENGTH_M = 99.0
EXCLUDED_HIGHWAYS = ("abandoned", "bus_guideway", "construction", "motorway", "motorway_link",
                     "planned", "platform", "proposed", "raceway", "razed")
BIKE_EXCLUDED_HIGHWAYS = ("corridor", "elevator", "escalator", "steps")
DENIED_ACCESS = ("no", "private")
ALLOWED_ACCESS = ("designated", "destination", "permissive", "yes")
SIDEWALK_KEYS = ("sidewalk", "sidewalk:both", "sidewalk:left", "sidewalk:right")
SIDEWALK_PRESENT = ("both", "left", "right", "separate", "yes")
TRAFFIC_CLASS_WEIGHTS = {"motorway": 5.0, "trunk": 4.0, "primary": 3.0, "secondary": 2.0}

# --- proximity kernels -------------------------------------------------------------------------
KERNEL_RADIUS_M = 1_000.0
KERNEL_DECAY_M = 300.0
FACILITY_MERGE_M = 25.0
INDUSTRIAL_NEAR_M = 200.0
TREE_RADIUS_M = 15.0
CONSTRUCTION_RADIUS_M = 40.0
IMAGE_SNAP_M = 25.0

# genus, group, rating, first and last pollen month
ALLERGENIC_GENERA = (
    ("Platanus", "London plane", 3.0, 3, 5),
    ("Quercus", "oak", 3.0, 3, 6),
    ("Betula", "birch", 3.0, 3, 5),
    ("Morus", "mulberry", 3.0, 3, 6),
    ("Fraxinus", "ash", 2.0, 2, 5),
    ("Acer", "maple", 2.0, 2, 5),
    ("Ulmus", "elm", 2.0, 2, 4),
)

# --- facility feeds ----------------------------------------------------------------------------
FACILITY_STATE = "NY"
FACILITY_PADDING_DEG = 0.02
PROGRAM_COLUMNS = {"airids": "CAA", "npdesids": "CWA", "rcraids": "RCRA", "rmpids": "RMP",
                   "triids": "TRI", "eisids": "EIS"}
INDUSTRIAL_PROGRAMS = ("CAA", "CWA", "RMP", "TRI", "EIS")

# --- permits -----------------------------------------------------------------------------------
PERMIT_MAJOR_WORK = ("earth work", "foundation", "general construction", "structural",
                     "support of excavation")
PERMIT_STREET_WORK = ("construction fence", "sidewalk shed")

# --- elevation and pollution grids ---------------------------------------------------------------
MAX_GRADE_PCT = 20.0
LONG_SEGMENT_M = 75.0
LONG_SEGMENT_FRACTIONS = (0.25, 0.5, 0.75)
GRID_NAME_PATTERNS = {
    "pm25": r"(?i)(?:^|/)aa(\d+)_pm300m(?:/hdr\.adf)?$",
    "no2": r"(?i)(?:^|/)aa(\d+)_no2300m(?:/hdr\.adf)?$",
    "ozone": r"(?i)(?:^|/)s(\d+)_o3300m(?:/hdr\.adf)?$",
}

# --- live layer --------------------------------------------------------------------------------
READING_LOOKBACK_HOURS = 24
FIELD_LOOKBACK_HOURS = 2
MAX_HAZARD_FIELDS = 20
SCALAR_RANGE = (0.1, 10.0)
SEVERITY_NAMES = ("low", "moderate", "high", "severe")
SENSOR_PARAMETERS = {"pm25": "pm25", "pm2.5": "pm25", "no2": "no2", "o3": "ozone"}
AQI_PARAMETERS = {"pm2.5": "pm25", "ozone": "ozone", "no2": "no2"}
POLLEN_CODES = {"TREE": "pollen_tree", "GRASS": "pollen_grass", "WEED": "pollen_weed"}
WIND_BEARINGS = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5, "E": 90.0, "ESE": 112.5, "SE": 135.0,
    "SSE": 157.5, "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5, "W": 270.0, "WNW": 292.5,
    "NW": 315.0, "NNW": 337.5,
}
AQI_CATEGORIES = ((50, "Good"), (100, "Moderate"), (150, "Unhealthy for sensitive groups"),
                  (200, "Unhealthy"), (300, "Very unhealthy"), (None, "Hazardous"))
POLLEN_CATEGORIES = ("None", "Very low", "Low", "Moderate", "High", "Very high")
SHADE_HEAT_C = 27.0
POLLEN_ACTIVE_UPI = 2.0
TREE_POLLEN_MONTHS = (2, 6)

# --- street imagery ----------------------------------------------------------------------------
MODEL_VERSION = "segformer-b0-cityscapes-1024-v1"
VEHICLE_CLASSES = ("car", "truck", "bus", "motorcycle")
PERSON_CLASSES = ("person", "rider")
EGO_BAND_FRACTION = 0.2
EGO_BACKFILL_CAR_FRACTION = 0.10
MAX_EGO_FRACTION = 0.5
MIN_INSTANCE_FRACTION = 0.0005
MIN_INSTANCE_PIXELS = 16
DAYLIGHT_HOURS = (8, 17)
SECONDS_PER_YEAR = 365.25 * 24 * 60 * 60
TAU_YEARS_SKY = 5.0
TAU_YEARS_CROWD = 0.5
SAMPLE_INTERVAL_M = 50.0
SAMPLE_RADIUS_M = 30.0
BEARING_TOLERANCE_DEG = 45.0
BEARING_SPAN_M = 10.0

# --- way scores (packing order) ------------------------------------------------------------------
WAY_SCORES = ("pm25", "no2", "ozone", "traffic", "industrial", "shade", "pollen", "grade",
              "industrial_within_200m", "svf", "crowd")
OPTIONAL_WAY_SCORES = ("svf", "crowd")
NO_DATA = 127
BITS_PER_SCORE = 7
SCORES_PER_PACK = 4
TILE_COLUMNS = {"pm25": "pm25_prior", "no2": "no2_prior", "ozone": "ozone_prior",
                "traffic": "traffic_prox", "industrial": "industrial_prox",
                "shade": "shade_benefit", "pollen": "pollen_source"}

# --- profiles ----------------------------------------------------------------------------------
# preset -> (weights, hard avoids, maximum grade)
PRESETS = {
    "asthma": ({"pm25": 3.0, "ozone": 3.0, "traffic_prox": 2.0, "construction": 2.0,
                "cold_air": 1.5}, (), 20.0),
    "allergies": ({"pollen_tree": 3.0, "pollen_grass": 3.0, "pollen_weed": 3.0,
                   "humidity": 1.5}, (), 20.0),
    "copd": ({"pm25": 3.0, "ozone": 3.0, "grade": 3.0, "traffic_prox": 2.0, "heat": 1.5,
              "cold_air": 1.5}, ("grade_above_6_pct",), 6.0),
    "chemical_sensitivity": ({"industrial_prox": 3.0, "construction": 3.0, "traffic_prox": 1.5,
                              "no2": 1.5},
                             ("active_construction_frontage", "industrial_within_200m"), 20.0),
    "cardiac": ({"pm25": 3.0, "heat": 3.0, "grade": 3.0, "ozone": 1.5},
                ("grade_above_5_pct",), 5.0),
    "none": ({}, (), 20.0),
}
HARD_AVOIDS = ("active_construction_frontage", "industrial_within_200m", "grade_above_5_pct",
               "grade_above_6_pct")
DEFAULT_DETOUR_TOLERANCE = 0.25
DEFAULT_CONSERVATISM = 1.0
# exposure above -> share of the sensitivity
EXPOSURE_BANDS = ((75, 1.0), (50, 0.67), (25, 0.33))
# profile hazard -> way score it acts on
DIRECT_SCORES = {"pm25": "pm25", "no2": "no2", "ozone": "ozone", "traffic_prox": "traffic",
                 "industrial_prox": "industrial", "grade": "grade", "crowd_density": "crowd",
                 "pollen_tree": "pollen"}
INVERSE_SCORES = {"shade_deficit": "shade"}
CANYON_SENSITIVITY = 0.5
PRIORITY_FLOOR = 0.1
LIVE_SEVERITY_STEP = 0.1875
MAX_WEIGHT = 3.0
MODE_ALIASES = {"foot": "foot", "walk": "foot", "walking": "foot", "bike": "bike",
                "bicycle": "bike", "cycling": "bike"}
VARIANT_ALIASES = {"fastest": "fastest", "shortest": "fastest", "cleanest": "cleanest",
                   "lower_pm25": "cleanest", "low_pm25": "cleanest"}
# route exposure key -> way score; shade is reported as a deficit
ROUTE_EXPOSURES = {"pm25": "pm25", "no2": "no2", "ozone": "ozone", "traffic_prox": "traffic",
                   "industrial_prox": "industrial", "shade_deficit": "shade",
                   "pollen_tree": "pollen", "grade": "grade"}
# variant -> (starting weight scale, multiple of the detour tolerance)
VARIANT_PLAN = {"balanced": (1.0, 1.0), "cleanest": (2.0, 2.0)}
MAX_VARIANT_ATTEMPTS = 3

# --- announcements -----------------------------------------------------------------------------
MENTION_THRESHOLD = 60.0
MAX_MENTIONS = 3
OPENING_ELEVATED = "Starting your route. This is the cleaner of the options for the conditions you chose."
OPENING_CALM = "Starting your route. Conditions along this route look unremarkable today."
CLOSING_LINE = "You have arrived."
HAZARD_LINES = {
    "pm25": "This stretch carries more particulate pollution than the rest of your route.",
    "no2": "Traffic exhaust is heavier along here.",
    "ozone": "Ozone tends to run higher on open stretches like this one in the afternoon.",
    "pollen_tree": "Tree pollen is elevated here. You may want to cover your face.",
    "pollen_grass": "Grass pollen is elevated along this section.",
    "pollen_weed": "Weed pollen is elevated along this section.",
    "traffic_prox": "You are close to a busy road for the next few minutes.",
    "construction": "There is active construction nearby.",
    "industrial_prox": "This passes near industrial sites.",
    "grade": "The next part climbs a little more steeply.",
    "heat": "This section has little shade in the heat.",
    "cold_air": "This stretch is exposed to cold air.",
    "humidity": "The air is heavier and more humid along here.",
    "crowd_density": "This stretch is usually busy with people and traffic.",
    "shade_deficit": "There is little tree cover along this part.",
}

# --- request limits: name -> (calls, seconds) ------------------------------------------------------
RATE_LIMITS = {"routing": (30, 60), "analysis": (6, 60), "registration": (5, 3600)}

# --- tables left out of the serving copy -------------------------------------------------------------
STAGING_TABLES = ("street_tree", "segment_nyccas_sample", "segment_tree_sample",
                  "segment_traffic_sample", "segment_industrial_sample", "traffic_road")
