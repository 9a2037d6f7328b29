"""Lookup tables, word lists, thresholds and limits.

Everything here is data that must hold exactly these values for results to be
right.  Logic lives elsewhere; other deployments pass their own rows to the
operators instead.
"""

# --- Fixed values: subjects, in matching order -------------------------------
# code, name, callsign, capital, capital lon, capital lat,
# west, south, east, north, adversary, query, accent
SUBJECTS = (
    ("IR", "Iran", "PERSIA", "Tehran", 51.389, 35.6892,
     44.0, 25.0, 63.3, 39.8, "IL", "Iran", "warning"),
    ("IL", "Israel", "SHIELD", "Jerusalem", 35.2137, 31.7683,
     34.2, 29.4, 35.9, 33.4, "IR", "Israel", "primary"),
    ("UA", "Ukraine", "TRIDENT", "Kyiv", 30.5234, 50.4501,
     22.1, 44.3, 40.2, 52.4, "RU", "Ukraine", "primary"),
    ("RU", "Russia", "BEAR", "Moscow", 37.6173, 55.7558,
     27.0, 41.2, 69.0, 70.0, "UA", "Russia", "danger"),
)

# --- Fixed values: theaters --------------------------------------------------
# id, name, label, member codes, west, south, east, north, query words
THEATERS = (
    ("middle-east", "Middle East", "MIDDLE EAST // IRAN — ISRAEL",
     ("IR", "IL"), 33.0, 24.0, 64.0, 40.5, ("Iran", "Israel")),
    ("eastern-europe", "Eastern Europe", "EASTERN EUROPE // RUSSIA — UKRAINE",
     ("UA", "RU"), 21.0, 43.0, 70.0, 70.5, ("Ukraine", "Russia")),
    ("global", "Global", "GLOBAL THEATER // ALL FRONTS",
     ("IR", "IL", "UA", "RU"), 21.0, 24.0, 70.0, 70.5,
     ("Iran", "Israel", "Ukraine", "Russia")),
)
DEFAULT_THEATER = "middle-east"

# --- Fixed values: keyword lists, in matching order --------------------------
KEYWORDS = (
    ("IR", ("iran", "iranian", "tehran", "persia", "irgc")),
    ("IL", ("israel", "israeli", "jerusalem", "tel aviv", "idf", "gaza")),
    ("UA", ("ukraine", "ukrainian", "kyiv", "kiev", "kharkiv", "odesa")),
    ("RU", ("russia", "russian", "moscow", "kremlin", "putin")),
)

# --- Fixed values: reference hotspots (name, lat, lon, weight) ---------------
SEEDS = (
    ("Tehran, Iran", 35.6892, 51.389, 0.9),
    ("Isfahan, Iran", 32.6539, 51.666, 0.7),
    ("Natanz, Iran", 33.7248, 51.726, 0.85),
    ("Bandar Abbas, Iran", 27.1865, 56.2808, 0.6),
    ("Jerusalem, Israel", 31.7683, 35.2137, 0.85),
    ("Tel Aviv, Israel", 32.0853, 34.7818, 0.8),
    ("Haifa, Israel", 32.7940, 34.9896, 0.55),
    ("Gaza", 31.5017, 34.4668, 0.95),
    ("Beirut, Lebanon", 33.8938, 35.5018, 0.7),
    ("Damascus, Syria", 33.5138, 36.2765, 0.65),
    ("Strait of Hormuz", 26.5667, 56.25, 0.75),
    ("Kyiv, Ukraine", 50.4501, 30.5234, 0.85),
    ("Kharkiv, Ukraine", 49.9935, 36.2304, 0.8),
    ("Bakhmut, Ukraine", 48.5957, 38.0, 0.9),
    ("Avdiivka, Ukraine", 48.1392, 37.7428, 0.88),
    ("Zaporizhzhia, Ukraine", 47.8388, 35.1396, 0.82),
    ("Kherson, Ukraine", 46.6354, 32.6169, 0.78),
    ("Odesa, Ukraine", 46.4825, 30.7233, 0.6),
    ("Sevastopol, Crimea", 44.6166, 33.5254, 0.7),
    ("Belgorod, Russia", 50.5957, 36.5873, 0.65),
    ("Moscow, Russia", 55.7558, 37.6173, 0.7),
    ("Rostov-on-Don, Russia", 47.2357, 39.7015, 0.6),
)

# --- Fixed values: threat bands (closed below) -------------------------------
THREAT_BANDS = (
    (0.92, "critical"),
    (0.75, "severe"),
    (0.55, "high"),
    (0.38, "elevated"),
    (0.2, "guarded"),
)
THREAT_FLOOR = "low"

# --- Fixed values: scoring weights -------------------------------------------
VOLUME_WEIGHT = 0.55
INTENSITY_WEIGHT = 0.45
FATALITY_BASE = 0.45
FATALITY_DIVISOR = 2
QUIET_ARC_INTENSITY = 0.4

# --- Fixed values: tone gauge ------------------------------------------------
TONE_LIMIT = 10.0
TONE_BANDS = ((-3.0, "danger"), (1.0, "warning"))
TONE_CALM = "success"

# --- Fixed values: caps and look-backs ---------------------------------------
SIGNAL_CAP = 250
ARTICLE_CAP = 60
CONFLICT_CAP = 400
REPORT_CAP_PER_SUBJECT = 12
REPORT_CAP = 24
TICKER_CAP = 24
TITLE_WIDTH = 90
EVENT_LOOKBACK_DAYS = 1
ARTICLE_LOOKBACK_DAYS = 2
PULSE_LOOKBACK_DAYS = 14
CONFLICT_LOOKBACK_DAYS = 14
RAIL_POINTS = 64
ARC_POINTS = 48
GRATICULE_STEP = 5

# --- Fixed values: seconds an answer stays fresh -----------------------------
TTL_SECONDS = {"events": 60, "feed": 45, "pulse": 120, "situation": 300}

# --- Fixed values: source names and defaults for absent fields ---------------
SOURCE_GEO = "gdelt"
SOURCE_CONFLICT = "acled"
SOURCE_SEED = "seed"
UNKNOWN_PLACE = "Unknown"
UNKNOWN_EVENT = "Event"
UNKNOWN_COUNTRY = "—"
DEFAULT_REPORT_DOMAIN = "ReliefWeb"

# --- Fixed values: notes and status words ------------------------------------
NOTE_EVENTS = "Live uplink unavailable — showing reference hotspots."
NOTE_FEED = "No live articles — uplink degraded."
NOTE_PULSE = "No timeline data — uplink degraded."
NOTE_SITUATION = "No situation reports available."

# --- Fixed values: boundary feature ids --------------------------------------
BOUNDARY_IDS = (("364", "IR"), ("376", "IL"), ("804", "UA"), ("643", "RU"))

# --- Fixed values: keyed profile rows ----------------------------------------
ROLES = ("viewer", "analyst", "admin")
DEFAULT_ROLE = "viewer"
