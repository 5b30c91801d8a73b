"""Text cleaning, case and token functions, all JVM-side expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.columns import as_col, bind

# Letters, digits and underscore over all scripts; combining marks are left out on purpose.
WORD = r"\p{L}\p{N}_"


def clean_text(text: Column | str) -> Column:
    """Hashtags become split words plus a comma; mentions, URLs and other signs become spaces."""
    given = as_col(text)
    tags, signs = "(#[A-Za-z0-9_]+)|@[A-Za-z0-9_]+", rf"[^A-Za-z0-9,\s{WORD}]"
    links = rf"(?:(?<![{WORD}])|\G)[{WORD}]++://\S+"
    # Only texts with a link pay for looking at whole words.
    marked = F.when(F.contains(given, F.lit("://")), F.regexp_replace(given, f"(?U){tags}|{links}|{signs}", "$1 ")).otherwise(
        F.regexp_replace(given, f"(?U){tags}|{signs}", "$1 "))

    def open_tag(part: Column) -> Column:
        return bind(
            F.regexp_extract(part, "^[A-Za-z0-9_]+", 0),
            lambda tag: F.concat(split_camel(tag), F.lit(","), F.substring(part, F.length(tag) + 2, F.length(part))),
        )

    def open_tags(body: Column) -> Column:
        # From here on every hash sign starts a hashtag, and a space ends it.
        opened = bind(
            F.split(body, "#"),
            lambda parts: F.concat(
                F.get(parts, F.lit(0)),
                F.array_join(F.transform(F.filter(parts, lambda p, i: i > 0), open_tag), ""),
            ),
        )
        return F.when(F.contains(body, F.lit("#")), opened).otherwise(body)

    # A single space is no match, as it would be replaced by itself.
    return F.trim(F.regexp_replace(bind(marked, open_tags), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def split_camel(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"(?<=[a-z])(?=[A-Z])", " ")


def title_case(text: Column | str) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    pieces = F.split(F.lower(as_col(text)), r"(?<=[^\p{IsLowercase}\p{IsUppercase}\p{Lt}])")

    def lift(piece: Column) -> Column:
        first = F.upper(F.substring(piece, 1, 1))
        # Upper-casing may give two letters, of which only the first stays large.
        head = F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 3)))
        return F.concat(head, F.substring(piece, F.lit(2), F.length(piece)))

    return F.array_join(F.transform(pieces, lift), "")


def strip_possessive(mention: Column | str) -> Column:
    return F.regexp_replace(F.btrim(as_col(mention), F.lit("# ")), "['’]s$", "")


def tokens(cleaned: Column | str) -> Column:
    """Words of a cleaned text in order, each comma a token of its own."""
    spaced = F.trim(F.replace(as_col(cleaned), F.lit(","), F.lit(" , ")))
    return F.filter(F.split(spaced, " +"), lambda t: t != "")


def topic_words(text: Column | str, stop_words: Iterable[str]) -> Column:
    """Lower-case words without links, hashtag signs, mentions, punctuation and stop words."""
    bare = as_col(text)
    for pattern in (r"(?U)http\S+", "#", rf"@[{WORD}]+", rf"(?U)[^{WORD}\s]"):
        bare = F.regexp_replace(bare, pattern, "")
    words = F.split(F.lower(bare), r"(?U)\s+")
    stop = list(stop_words)
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop) if stop else w != "")
