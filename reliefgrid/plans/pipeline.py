"""The live and the offline pipeline, as chains of operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.columns import bind
from reliefgrid.functions.scalars import sentiment_class
from reliefgrid.functions.text import clean_text
from reliefgrid.operators import counts, posts as post_ops
from reliefgrid.operators.places import RESOLVED_FIELDS, collect_places, resolve_all
from reliefgrid.operators.tagging import (
    add_scores, choose_places, disaster_names, known_names, likely_places, place_names, tag_disasters,
)
from reliefgrid.session import cut


@dataclass
class Dictionaries:
    """Static tables of the pipeline."""

    phrases: Mapping[str, str]
    gazetteer: DataFrame
    states: DataFrame
    lexicon: DataFrame
    mode: str = "cascade"
    max_words: int = 3

    @property
    def names(self) -> DataFrame:
        return place_names(self.gazetteer)


def extract_entities(posts: DataFrame, dicts: Dictionaries, key: str = "post_id") -> DataFrame:
    """``(key, disasters, locations, sentiment, polarity)`` for every post."""
    cleaned = posts.select(key, clean_text("text").alias("cleaned"))
    # Disasters, scores and likely places are found in the row, so a text is cleaned once; only
    # place hits are grouped and joined back. What was found is written out without the texts.
    known = known_names(dicts.names, dicts.max_words)
    tagged = add_scores(tag_disasters(cleaned, dicts.phrases), dicts.lexicon)
    tagged = cut(tagged.select(key, "disasters", "polarity", likely_places(known, dicts.max_words).alias("_runs")))
    runs = tagged.select(key, F.explode("_runs").alias("r")).select(key, "r.*")
    places = choose_places(runs, known, key)
    none = F.array().cast("array<string>")
    return (
        tagged.select(key, "disasters", "polarity")
        .join(places, key, "left")
        .select(
            key,
            "disasters",
            F.coalesce("locations", none).alias("locations"),
            sentiment_class("polarity").alias("sentiment"),
            "polarity",
        )
    )


def filter_crisis(posts: DataFrame) -> DataFrame:
    """Posts with a disaster and a place."""
    return posts.where((F.size("disasters") > 0) & (F.size("locations") > 0))


def naming_disaster(posts: DataFrame, phrases: Mapping[str, str]) -> DataFrame:
    """Posts that name a disaster, with ``cleaned`` and ``disasters``.

    Both are made in one generated value that is missing for other posts; a plain filter
    would make Spark clean and tag each text once more below it.
    """
    made = bind(
        clean_text("text"),
        lambda c: F.struct(c.alias("cleaned"), disaster_names(c, phrases).alias("disasters")),
    )
    hit = bind(made, lambda m: F.when(F.size(m["disasters"]) > 0, F.array(m)))
    return posts.select("*", F.explode_outer(hit).alias("_hit")).where(F.col("_hit").isNotNull()).select(
        *posts.columns, "_hit.*"
    )


def crisis_posts(
    posts: DataFrame, dicts: Dictionaries, key: str = "post_id", order: list[str] | None = None
) -> DataFrame:
    """One row per crisis post, with its resolved places in ``all_locations``; null if none has a state.

    Empty texts go, then copies, of which only those shuffle that occur more than once; a tag
    depends on the text alone, so copies share it and each text is cleaned and tagged once. The
    posts that name a disaster are written out with their likely places, without the cleaned
    text, which no later step reads. Texts meet the places of their post in one join.
    """
    unique = post_ops.dedup_text(post_ops.filter_nonempty(posts), order or [key])
    known = known_names(dicts.names, dicts.max_words)
    scored = add_scores(naming_disaster(unique, dicts.phrases), dicts.lexicon)
    named = cut(scored.select(
        *_post_columns(key), "disasters", sentiment_class("polarity").alias("sentiment"), "polarity",
        likely_places(known, dicts.max_words).alias("_runs")))

    runs = named.select(key, F.explode("_runs").alias("r")).select(key, "r.*")
    places = cut(choose_places(runs, known, key))
    located = resolve_all(places, dicts.gazetteer, dicts.states, key, dicts.mode)
    grouped = collect_places(located.where(F.col("resolved.state") != ""), key)
    # Written out, as whoever stores the posts counts their places too.
    found = cut(places.select(key).join(grouped, key, "left"))
    return named.drop("_runs").join(found, key)


def _post_columns(key: str) -> list[str]:
    return list(dict.fromkeys(["author", "created_at", key, "text", "uri"]))


def filtered_posts(
    posts: DataFrame, dicts: Dictionaries, key: str = "post_id", order: list[str] | None = None
) -> DataFrame:
    """One row per crisis post and resolved place."""
    return fan_out(crisis_posts(posts, dicts, key, order), key)


def fan_out(crisis: DataFrame, key: str = "post_id", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per place of ``all_locations``; a post without any keeps one row of nulls.

    The first row names its city as location, the others the text of the mention. ``also`` names
    further columns to keep.
    """
    rows = crisis.select("*", F.posexplode_outer("all_locations").alias("place_no", "place"))
    location = F.when(F.coalesce("place_no", F.lit(0)) == 0, F.col("place.city")).otherwise(F.col("place.location"))
    return rows.select(
        *_post_columns(key),
        "disasters",
        "sentiment",
        "polarity",
        *[F.col(f"place.{c}").alias(c) for c in RESOLVED_FIELDS],
        location.alias("location"),
        *also,
    )


def crisis_summary(
    filtered: DataFrame, previous: DataFrame | None = None, explode_all: bool = False
) -> DataFrame:
    """Counts of the filtered posts, merged with the running ones, with severity."""
    single = counts.single_disaster(filtered, explode_all)
    new = counts.crisis_counts(single)
    merged = new if previous is None else counts.merge_counts(previous, new)
    return counts.sort_counts(counts.severity(merged))
