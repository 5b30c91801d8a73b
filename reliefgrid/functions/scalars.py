"""Scalar rules: sentiment classes, rounding, coercion, list text, links, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.columns import as_col
from reliefgrid.functions.text import title_case

# Polarity is summed as whole millionths, so that sums do not depend on row order.
POLARITY_SCALE = 1_000_000

# Class thresholds and names.
POSITIVE_FROM = 0.1
NEGATIVE_BELOW = 0.0


def sentiment_class(polarity: Column | str) -> Column:
    p = as_col(polarity)
    return F.when(p >= POSITIVE_FROM, "Positive").when(p < NEGATIVE_BELOW, "Negative").otherwise("Neutral")


def polarity_units(polarity: Column | str) -> Column:
    return F.round(as_col(polarity) * POLARITY_SCALE).cast("long")


def round2(value: Column | str) -> Column:
    """Two decimals, ties to even on the scaled value."""
    return F.rint(as_col(value) * 100) / 100


def coerce_number(value: Column | str, default: float) -> Column:
    """Numeric text to double; unreadable, missing or not-a-number text takes the default."""
    number = as_col(value).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(float(default)))


def coerce_count(value: Column | str) -> Column:
    return coerce_number(value, 1).cast("long")


def parse_list_literal(text: Column | str, keep_apostrophes: bool = False) -> Column:
    """List text such as ``['a', 'b']`` to an array; text that does not parse gives an empty one.

    ``keep_apostrophes`` also reads elements holding an apostrophe between double quotes.
    """
    raw = as_col(text)
    source = raw if keep_apostrophes else F.translate(raw, "'", '"')
    shaped = F.when(F.trim(raw).startswith("[") & F.trim(raw).endswith("]"), source)
    return F.coalesce(F.from_json(shaped, "array<string>"), F.array().cast("array<string>"))


def list_literal(items: Column | str) -> Column:
    """Array of strings to list text; quotes as the parser above expects them."""
    quoted = F.transform(
        as_col(items),
        lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), x, F.lit("'"))
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def normalise_list(items: Column | str) -> Column:
    """Trimmed lower-case elements without blanks; a missing list is an empty one."""
    given = F.coalesce(as_col(items), F.array().cast("array<string>"))
    return F.transform(F.filter(given, lambda x: x != ""), lambda x: F.lower(F.trim(x)))


def split_alternates(names: Column | str) -> Column:
    return F.split(F.coalesce(as_col(names), F.lit("")), ",")


def last_segment(path: Column | str) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def post_uri(repo: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("at://"), as_col(repo), F.lit("/"), as_col(path))


def post_url(author: Column | str, uri: Column | str) -> Column:
    # Fixed value: link format.
    return F.concat(F.lit("https://bsky.app/profile/"), as_col(author), F.lit("/post/"), last_segment(uri))


def one_line(text: Column | str) -> Column:
    return F.replace(as_col(text), F.lit("\n"), F.lit(" "))


def parse_created_at(text: Column | str) -> Column:
    """ISO time text with ``Z`` or an offset to a timestamp; anything else to null."""
    return F.try_to_timestamp(as_col(text))


def iso_utc(moment: Column | str) -> Column:
    return F.date_format(F.to_utc_timestamp(as_col(moment), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2))


def cell_text(value: Column | str) -> Column:
    """Display form of a text cell; list text is joined by commas, all of it title-cased."""
    raw = as_col(value)
    items = F.from_json(F.when(raw.startswith("[") & raw.endswith("]"), raw), "array<string>")
    return F.coalesce(cell_list(items), title_case(raw))


def cell_list(items: Column | str) -> Column:
    return F.array_join(F.transform(as_col(items), title_case), ", ")
