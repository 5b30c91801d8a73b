"""Crisis counts, running merges, severity and the offline counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.scalars import POLARITY_SCALE, polarity_units, round2
from reliefgrid.session import cut

KEYS = ["country", "state", "disasters"]
COUNT_COLUMNS = ["country", "state", "disasters", "count", "avg_sentiment", "cities"]

# Averages of two decimals are folded as whole cents between these ends.
CENTS = 100
# Batches folded per step of the running mean.
FOLD_BATCHES = 1024


def first_disaster(disasters: Column | str = "disasters") -> Column:
    """First element of the list; ``Unknown`` for an empty or missing one."""
    d = F.col(disasters) if isinstance(disasters, str) else disasters
    return F.coalesce(F.get(d, F.lit(0)), F.lit("Unknown"))


def single_disaster(posts: DataFrame, explode_all: bool = False) -> DataFrame:
    """One disaster text per row: the first of the list, or one row per element."""
    if explode_all:
        return posts.withColumn("disasters", F.explode_outer("disasters"))
    return posts.withColumn("disasters", first_disaster())


def mean_polarity(units: str, n: str) -> Column:
    return round2(F.col(units) / (F.col(n) * F.lit(POLARITY_SCALE)))


def count_partials(posts: DataFrame) -> DataFrame:
    """Additive form of the counts: rows, polarity units and distinct cities per group.

    The first aggregate also groups by city, which spreads a hot group over many tasks and
    leaves a city list that is already distinct for the second one.
    """
    by_city = (
        posts.where(F.col("country").isNotNull() & F.col("state").isNotNull() & F.col("disasters").isNotNull())
        .groupBy(*KEYS, "city")
        .agg(F.count("*").alias("n"), F.sum(polarity_units("polarity")).alias("u"))
    )
    return by_city.groupBy(*KEYS).agg(
        F.sum("n").alias("count"),
        F.sum("u").alias("polarity_units"),
        F.sort_array(F.collect_list("city")).alias("cities"),
    )


def finish_counts(partials: DataFrame) -> DataFrame:
    return partials.select(
        *KEYS, "count", mean_polarity("polarity_units", "count").alias("avg_sentiment"), "cities"
    )


def crisis_counts(posts: DataFrame) -> DataFrame:
    """Rows per ``(country, state, disaster)``, mean polarity and distinct cities.

    Rows with a missing key are not counted.
    """
    return finish_counts(count_partials(posts))


def merged_cities(rows: DataFrame) -> DataFrame:
    """Union of the city lists per group without blanks."""
    return (
        rows.select(*KEYS, F.explode("cities").alias("city"))
        .where(F.col("city") != "")
        .distinct()
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_list("city")).alias("cities"))
    )


def _with_cities(totals: DataFrame, rows: DataFrame) -> DataFrame:
    joined = totals.join(merged_cities(rows), KEYS, "left")
    return joined.withColumn("cities", F.coalesce("cities", F.array().cast("array<string>")))


def merge_partials(*partials: DataFrame) -> DataFrame:
    """Add up additive states; the order and the grouping of the parts do not matter.

    The parts hold one row per group; they are written out, as totals and cities read them.
    """
    rows = partials[0]
    for other in partials[1:]:
        rows = rows.unionByName(other)
    rows = cut(rows)
    totals = rows.groupBy(*KEYS).agg(
        F.sum("count").alias("count"), F.sum("polarity_units").alias("polarity_units")
    )
    return _with_cities(totals, rows)


def merge_counts(previous: DataFrame | None, new: DataFrame) -> DataFrame:
    """Merge finished counts with the running ones: counts add, averages are averaged again.

    Without a previous state the new counts stand; without new rows the previous state stays.
    """
    if previous is None:
        return new.select(COUNT_COLUMNS)
    # Both sides are worked out once; emptiness, totals and cities are read from what is written.
    old = previous.select(COUNT_COLUMNS).withColumn("_side", F.lit(0))
    rows = cut(old.unionByName(new.select(COUNT_COLUMNS).withColumn("_side", F.lit(1))))
    sides = {r[0] for r in rows.select("_side").distinct().collect()}
    if len(sides) < 2:
        return rows.select(COUNT_COLUMNS)
    # Averages carry two decimals, so whole cents add exactly.
    cents = F.rint(F.col("avg_sentiment") * CENTS).cast("long")
    totals = rows.groupBy(*KEYS).agg(
        F.sum("count").alias("count"),
        (F.rint(F.sum(cents) / F.count(cents)) / CENTS).alias("avg_sentiment"),
    )
    return _with_cities(totals, rows).select(COUNT_COLUMNS)


def sample_deviation(n: str, s: str, q: str) -> Column:
    """Sample deviation from exact count, sum and sum of squares (decimals without scale)."""
    spread = (F.col(n) * F.col(q) - F.col(s) * F.col(s)).cast("double")
    pairs = (F.col(n) * (F.col(n) - 1)).cast("double")
    return F.when(F.col(n) > 1, F.sqrt(spread / pairs))


def severity(counts: DataFrame, zero_guard: bool = True) -> DataFrame:
    """Add the z-score of ``count`` over all rows, with the sample deviation.

    A deviation of zero divides by one (``zero_guard``); a single row has no severity. Sums
    are exact, so the score does not depend on row order. The counts (one row per group) are
    written out first: the totals and the rows then read one small table instead of running
    the scan below twice.
    """
    counts = cut(counts)
    wide = F.col("count").cast("decimal(19,0)")
    stats = counts.agg(
        F.count("count").cast("decimal(38,0)").alias("n"),
        F.sum(wide).cast("decimal(38,0)").alias("s"),
        F.sum(wide * wide).cast("decimal(38,0)").alias("q"),
    )
    mean_sd = stats.select(
        F.struct(
            (F.col("s").cast("double") / F.col("n").cast("double")).alias("mean"),
            sample_deviation("n", "s", "q").alias("sd"),
        ).alias("m")
    ).scalar()
    sd = mean_sd["sd"]
    divisor = F.when(sd == 0, F.lit(1.0) if zero_guard else F.lit(None).cast("double")).otherwise(sd)
    return counts.withColumn("severity", (F.col("count") - mean_sd["mean"]) / divisor)


def sort_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("count").desc(), *[c for c in KEYS if c in counts.columns])


def running_mean(batches: DataFrame, keys: list[str], fold: int = FOLD_BATCHES) -> DataFrame:
    """Average kept by ``(old + new) / 2`` rounded to cents at each batch, in batch order.

    ``batches`` holds the keys, ``batch`` (whole number, one row per key) and
    ``avg_sentiment`` of two decimals in [-1, 1]. The running value has only 201 levels, so
    a run of batches is a table from the level before to the level after. Runs of ``fold``
    batches become tables in parallel, which are then chained: no task ever holds the whole
    history of a key.
    """
    levels = F.concat(
        F.array(F.lit(None).cast("int")), F.sequence(F.lit(-CENTS), F.lit(CENTS))
    )

    def step(acc: Column, row: Column) -> Column:
        return F.coalesce(F.rint((acc + row["c"]) / 2).cast("int"), row["c"])

    cents = F.rint(F.col("avg_sentiment") * CENTS).cast("int").alias("c")
    runs = (
        batches.withColumn("run", F.floor(F.col("batch") / fold))
        .groupBy(*keys, "run")
        .agg(F.sort_array(F.collect_list(F.struct("batch", cents))).alias("rows"))
        .select(
            *keys,
            "run",
            F.transform(levels, lambda level: F.aggregate("rows", level, step)).alias("table"),
        )
    )
    chained = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", "table"))).alias("tables"))
    last = F.aggregate(
        "tables",
        F.lit(None).cast("int"),
        lambda acc, t: F.get(t["table"], F.coalesce(acc + CENTS + 1, F.lit(0))),
    )
    return chained.select(*keys, (last / CENTS).alias("avg_sentiment"))


def explode_entities(posts: DataFrame) -> DataFrame:
    """One row per disaster and place; empty lists give one row with null."""
    return posts.withColumn("disasters", F.explode_outer("disasters")).withColumn(
        "locations", F.explode_outer("locations")
    )


def offline_counts(posts: DataFrame) -> DataFrame:
    """Counts per ``(disaster, place)`` of posts with an opinion; rows with any null are dropped."""
    rows = explode_entities(posts.where(F.col("sentiment") != "Neutral")).na.drop("any")
    totals = rows.groupBy("disasters", "locations").agg(
        F.count("*").alias("count"), F.sum(polarity_units("polarity")).alias("_u")
    )
    return totals.select(
        "disasters", "locations", "count", mean_polarity("_u", "count").alias("avg_sentiment")
    )


def offline_state_counts(posts: DataFrame) -> DataFrame:
    """Counts per state over all disasters of a post, not only the first."""
    return crisis_counts(single_disaster(posts, explode_all=True))
