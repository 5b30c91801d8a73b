"""Declared schemas of the tables the package reads and writes."""

from __future__ import annotations

POST = "text string, created_at string, author string, uri string"

COMMIT = (
    "repo string, "
    "ops array<struct<action:string,path:string>>, "
    "records array<struct<type:string,text:string,createdAt:string,"
    "embed:struct<type:string,thumb:string>,reply:struct<parent:struct<uri:string>>>>"
)

# The nineteen columns of the place file, in file order.
GAZETTEER_FILE = (
    "geonameid long, name string, asciiname string, alternatenames string, latitude double, "
    "longitude double, featureClass string, featureCode string, countryCode string, cc2 string, "
    "stateCode string, admin2Code string, admin3Code string, admin4Code string, population long, "
    "elevation double, dem long, timezone string, modificationDate string"
)

# Expected columns of the two state tables and the default of a missing column.
FILTERED_POST_DEFAULTS = {
    "author": ("string", ""),
    "created_at": ("string", ""),
    "post_id": ("string", ""),
    "text": ("string", ""),
    "uri": ("string", ""),
    "preprocessed_text": ("string", ""),
    "disasters": ("array<string>", []),
    "locations": ("array<string>", []),
    "sentiment": ("string", "Neutral"),
    "polarity": ("double", 0.0),
    "city": ("string", ""),
    "state": ("string", ""),
    "region": ("string", ""),
    "country": ("string", ""),
    # Blank in the text files, hence null once typed.
    "latitude": ("double", None),
    "longitude": ("double", None),
    "location": ("string", ""),
}
CRISIS_COUNT_DEFAULTS = {
    "country": ("string", ""),
    "state": ("string", ""),
    "disasters": ("string", ""),
    "count": ("long", 0),
    "avg_sentiment": ("double", 0.0),
    "cities": ("array<string>", []),
    "severity": ("double", 0.0),
}

CRISIS_COUNT_FILE = (
    "country string, state string, disasters string, count string, avg_sentiment string, "
    "cities string, severity string"
)
