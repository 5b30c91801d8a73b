"""Disaster taxonomy: canonical type and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical types and their synonyms.
DISASTER_SYNONYMS = {
    "Earthquake": ["Earthquake", "Seismic Event", "Tremor"],
    "Tsunami": ["Tsunami", "Tidal Wave"],
    "Volcanic Eruption": ["Volcanic Eruption", "Volcanic Explosion"],
    "Landslide": [
        "Landslide", "Rockslide", "Mudslide", "Avalanche", "Snow Avalanche", "Sinkhole", "Ground Collapse",
    ],
    "Hurricane": ["Hurricane", "Cyclone", "Typhoon", "Superstorm", "Tornado", "Twister"],
    "Flood": [
        "Flood", "Severe Flooding", "Flash Flood", "Sudden Flood", "Storm Surge", "Coastal Flooding",
        "Seiche", "Lake Surge",
    ],
    "Heatwave": ["Heatwave", "Extreme Heatwave"],
    "Wildfire": ["Wildfire", "Forest Fire", "Brush Fire", "Firestorm"],
    "Cold Snap": ["Cold Snap", "Extreme Cold", "Polar Vortex"],
    "Pandemic": ["Pandemic", "Global Pandemic", "Epidemic", "Disease Outbreak"],
    "Solar Flare": ["Solar Flare", "Geomagnetic Storm", "Gamma-Ray Burst"],
    "Transportation Accident": ["Transportation Accident", "Major Crash"],
}


def read_taxonomy(spark: SparkSession, path: str, root: str = "disasters") -> DataFrame:
    """One JSON object of canonical type to synonym list, as ``(canonical, synonym)`` rows."""
    raw = spark.read.schema(f"{root} map<string,array<string>>").json(path, multiLine=True)
    return explode_taxonomy(raw, root)


def explode_taxonomy(df: DataFrame, column: str = "disasters") -> DataFrame:
    return df.select(F.explode(column).alias("canonical", "synonyms")).select(
        "canonical", F.explode("synonyms").alias("synonym")
    )
