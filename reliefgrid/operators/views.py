"""Data behind the views: map, chart, key figures, post list, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.scalars import (
    POLARITY_SCALE, cell_list, coerce_count, coerce_number, degree_distance, polarity_units,
)
from reliefgrid.functions.text import title_case
from reliefgrid.operators.counts import sample_deviation

# Coordinates are averaged as whole millionths of a degree.
DEGREE_SCALE = 1_000_000
# Marker sizes of the map.
DISTANCE_FACTOR = 50
MIN_MARKER = 1.0
STATE_MARKER = 5.0
STATE_LABEL = "State-level data"
BINS = 20


def coerce_counts(counts: DataFrame) -> DataFrame:
    """Numeric columns of a counts table read as text; unreadable values take their defaults."""
    return counts.withColumns(
        {
            "count": coerce_count("count"),
            "avg_sentiment": coerce_number("avg_sentiment", 0),
            "severity": coerce_number("severity", 0),
        }
    )


def place_key(col: str) -> Column:
    return F.lower(F.trim(col))


def city_coordinates(posts: DataFrame, order: list[str]) -> DataFrame:
    """Coordinates of the first post per normalised city and state."""
    first = F.min_by(F.struct("latitude", "longitude"), F.struct(*order))
    return (
        posts.where((F.col("city") != "") & (F.col("state") != ""))
        .groupBy(place_key("city").alias("city_key"), place_key("state").alias("state_key"))
        .agg(first.alias("at"))
        .select("city_key", "state_key", "at.latitude", "at.longitude")
    )


def map_markers(counts: DataFrame, coordinates: DataFrame, states: DataFrame) -> DataFrame:
    """One marker per counts row: centre of its known cities, else of its state, else none."""
    keys = ["country", "state", "disasters"]
    named = counts.join(
        states.select(F.col("code").alias("state"), F.col("name").alias("_name")), "state", "left"
    ).withColumn("full_state", F.coalesce("_name", "state")).drop("_name")
    cities = named.select(*keys, F.explode("cities").alias("city")).select(
        *keys, place_key("city").alias("city_key"), place_key("state").alias("state_key")
    )
    found = cities.join(coordinates, ["city_key", "state_key"]).where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )

    def mean(name: str) -> Column:
        units = F.sum(F.round(F.col(name) * DEGREE_SCALE).cast("long"))
        return units / (F.count(name) * F.lit(DEGREE_SCALE))

    centres = found.groupBy(*keys).agg(
        mean("latitude").alias("c_lat"),
        mean("longitude").alias("c_lon"),
        F.collect_list(F.struct("latitude", "longitude")).alias("points"),
    )
    reach = F.array_max(
        F.transform(
            "points",
            lambda p: degree_distance(p["latitude"], p["longitude"], F.col("c_lat"), F.col("c_lon")),
        )
    )
    centre = states.select(F.col("name").alias("full_state"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    has_city = F.col("c_lat").isNotNull()
    return (
        named.join(centres, keys, "left")
        .join(centre, "full_state", "left")
        .select(
            "state",
            "full_state",
            F.coalesce("c_lat", "s_lat").alias("lat"),
            F.coalesce("c_lon", "s_lon").alias("lon"),
            F.when(has_city, F.greatest(reach * DISTANCE_FACTOR, F.lit(MIN_MARKER)))
            .otherwise(F.lit(STATE_MARKER))
            .alias("size"),
            "count",
            F.col("disasters").alias("disaster"),
            F.when(has_city, F.array_join("cities", ", ")).otherwise(F.lit(STATE_LABEL)).alias("city"),
            "severity",
            F.col("avg_sentiment").alias("sentiment"),
        )
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def state_chart(counts: DataFrame) -> DataFrame:
    return counts.groupBy("state", "disasters").agg(F.sum("count").alias("count"))


def kpi_stats(counts: DataFrame) -> DataFrame:
    """Reports, distinct disasters, states and cities, and the mean of the group means."""

    def distinct(name: str) -> Column:
        missing = F.coalesce(F.max(F.when(F.col(name).isNull(), 1)), F.lit(0))
        return F.count_distinct(name) + missing

    cents = F.rint(F.col("avg_sentiment") * 100).cast("long")
    cities = counts.select(F.explode("cities").alias("c")).agg(F.count_distinct("c")).scalar()
    return counts.agg(
        F.sum("count").alias("total_reports"),
        distinct("disasters").alias("total_disasters"),
        distinct("state").alias("total_states"),
        (F.rint(F.sum(cents) / F.count(cents)) / 100).alias("avg_sentiment"),
    ).withColumn("total_cities", cities)


def state_list(counts: DataFrame) -> DataFrame:
    return counts.select("state").where(F.col("state") != "").distinct()


def posts_by_state(posts: DataFrame, state: str) -> DataFrame:
    return posts.where(F.col("state") == state)


def posts_table(posts: DataFrame, state: str) -> DataFrame:
    """Display rows of one state."""
    return posts_by_state(posts, state).select(
        title_case("text").alias("text"),
        cell_list("disasters").alias("disasters"),
        title_case("city").alias("city"),
        title_case("state").alias("state"),
        title_case("sentiment").alias("sentiment"),
        F.col("polarity").cast("string").alias("polarity"),
    )


def sentiment_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("sentiment").agg(F.count("*").alias("count"))


def polarity_stats(posts: DataFrame) -> DataFrame:
    """Mean and sample deviation of polarity from exact sums."""
    u = polarity_units("polarity").cast("decimal(19,0)")
    sums = posts.agg(
        F.count("polarity").cast("decimal(38,0)").alias("n"),
        F.sum(u).cast("decimal(38,0)").alias("s"),
        F.sum(u * u).cast("decimal(38,0)").alias("q"),
    )
    mean = F.col("s").cast("double") / F.col("n").cast("double") / POLARITY_SCALE
    return sums.select(
        F.col("n").cast("long").alias("n"),
        F.when(F.col("n") > 0, mean).alias("mean"),
        (sample_deviation("n", "s", "q") / POLARITY_SCALE).alias("std"),
    )


def polarity_histogram(posts: DataFrame) -> DataFrame:
    """Density over equal bins of [-1, 1]; the last bin is closed, values outside are ignored."""
    units = polarity_units("polarity")
    width = 2 * POLARITY_SCALE // BINS
    bins = (
        posts.select(units.alias("u"))
        .where(F.col("u").between(-POLARITY_SCALE, POLARITY_SCALE))
        .groupBy(F.least(F.floor((F.col("u") + POLARITY_SCALE) / width), F.lit(BINS - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = posts.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(bins, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # A window over the few bins, so the posts are read once.
    total = F.sum("n").over(Window.partitionBy())
    return filled.select(
        "bin",
        ((F.col("bin") * 2 - BINS) / BINS).alias("left_edge"),
        F.col("n").alias("count"),
        (F.col("n") * BINS / (total * 2)).alias("density"),
    )


