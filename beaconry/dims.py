"""Synthetic dimension tables and parameters. Real vocabularies, fences and lists come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# Relevance vocabulary: (kind, code, ord, term); a trailing * is a prefix entry.
VOCABULARY = [
    ("region", "north", 0, "ention"),
    ("region", "north", 0, "thtion*"),
    ("region", "south", 1, "estion"),
    ("region", "south", 1, "the nd"),
    ("region", "west", 2, "mente"),
    ("region", "west", 2, "einver*"),
    ("region", "east", 3, "cionas"),
    ("region", "east", 3, "oument"),
    ("topic", "drill", 0, "ingor"),
    ("topic", "drill", 0, "ouaux*"),
    ("topic", "closure", 1, "onbleea"),
    ("topic", "closure", 1, "enlich*"),
    ("topic", "release", 2, "erung"),
    ("topic", "release", 2, "cionue"),
]
EXCLUDE = ["of the nd", "to the nd"]
WEIGHTS = {"region": 0.5, "topic": 0.5, "title": 1.0, "text": 0.4, "feed_region": 0.5, "threshold": 0.5, "margin": 0.1}
WEIGHTS_B = {**WEIGHTS, "text": 0.6, "threshold": 0.6, "margin": 0.05}

# Feeds: (feed, enabled, queue, grade, region); a feed has a region when it covers exactly one.
GRADES = ["A", "B", "C", "D", "E", "F", None]
REGIONS = ["north", "south", "west", "east"]


def feed_rows():
    for i in range(20):
        yield (
            f"src{i}",
            i % 4 != 3,
            i % 3 != 2,
            GRADES[i % len(GRADES)],
            REGIONS[i % 5] if i % 5 < 4 else None,
            15 * (1 + i % 4),
        )


FEEDS = list(feed_rows())
FEED_SCHEMA = "feed string, enabled boolean, queue boolean, grade string, region string, cadence_minutes int"
GRADE_FLOOR = "D"

# Protected wording: single words keep both boundaries, phrases match as prefixes.
PROTECTED_TERMS = ["ingha", "queque", "on the th", "de la men"]
POSITION_STEMS = ["tionan", "geund"]

# Warnings.
STATIONS = [("D", "Dune Point"), ("F", "Fern Head"), ("P", "Pine Rock"), ("T", "Teal Bay")]
SUBJECTS = [("A", "navigational warning"), ("B", "meteorological warning"), ("D", "search and rescue")]
SEAS = ["NORTH REACH", "AMBER GULF", "OPEN OCEAN", "FAR BASIN", "OUTER SHELF", "COLD DRIFT", "LOW STRAIT"]
OWN_SEAS = ["NORTH REACH", "AMBER GULF"]
OWN_BOX = (19.0, 30.0, 30.0, 40.0)
AUTHORITIES = ["AMBER RADIO", "HALCYON COORDINATION", "LIME OFFICE.", "NORDWIND NAVY", "PORT HALCYON", None, "OSTRIA SERVICE", "OSTRIA NAVY", "QUARTZ MET"]
EXCLUDED_ISSUER = r"\bNORDWIND\b|OSTRIA NAVY"
EXCLUDED_SUBJECT = r"\bNORDWIND (?:RANGE|NAVY)\b"
ACTIVITIES = [
    (0, "shooting", "TARGET PRACTICE"),
    (1, "drill", "DRILL"),
    (2, "mapping", "SOUNDING"),
    (2, "mapping", "MAPPING"),
    (3, "salvage", "SALVAGE"),
    (4, "drift", "DRIFTING"),
]
GROUPS = {"shooting": "military", "drill": "military", "mapping": "survey"}
CELL_DEG = 0.25
MAX_SPAN_DEG2 = 9.0
DENSITY_YEARS = (2015, 2021)
BREAK_YEAR = 2022
SERIES_FROM = 2013
BOXES = [
    ("north", 19.0, 36.0, 28.0, 44.0),
    ("south", 19.0, 30.0, 30.0, 37.0),
    ("east", 30.0, 30.0, 42.0, 47.0),
    ("strait", 28.5, 38.0, 30.5, 40.0),
    ("empty", -10.0, 0.0, -5.0, 5.0),
]
BOX_SCHEMA = "box string, west double, south double, east double, north double"

# Position safety rules: protected address blocks and allocation codes.
PROTECTED_BLOCKS = [(0x4A0000, 0x4A0FFF), (0x4A8000, 0x4A8100)]
PROTECTED_CODES = [399, 512]
KINDS_WITH_POSITION = ["adsb", "ais"]
FENCE_BUFFER_NM = 12.0
FENCE_MARGINS_KM = 1.0

# Trade.
PIVOT_PERIOD = "199901"
WINDOW_MONTHS = 12
MODES = [("2100", "sea"), ("3200", "road")]
HEADING_CHAPTERS = ["10", "25", "72", "73"]
CONTROL_PARTNER = 3
LABELS = [(f"{i:02d}", f"{i:02d} - Chapter {i}", f"Fasil {i}" if i % 3 else None) for i in range(0, 97, 2)]

# Records and facets.
STATUSES = ["verified", "unverified", "disputed", "retracted"]
REGION_COUNTRIES = [("north", [1, 2, 3, 4]), ("south", [5, 6, 7]), ("west", [8, 9]), ("east", [10, 11, 12, 13, 14])]
DOMAIN_VOCAB = ["click", "error", "purchase", "launch"]
TIERS = [(n, "core" if n < 5 else "near") for n in range(12)]
FORCED_NAMES = ["small ring", "red widget"]
CHANNEL_LIMITS = (4, 30)
CADENCE = [("click", 1, 2), ("view", 7, 4), ("error", 1, 1), ("export", 31, 7)]
