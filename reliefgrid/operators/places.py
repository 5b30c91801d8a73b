"""Place resolution: name lookups, the cascades, classification and per-post results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.text import title_case
from reliefgrid.operators.joins import large_join, lookup_join
from reliefgrid.session import cut
from reliefgrid.sources.states import known_states, state_keys, state_names

PLACE_FIELDS = [
    "geonameid", "name", "featureCode", "stateCode", "countryCode", "latitude", "longitude", "population",
]
RESOLVED_FIELDS = ["city", "state", "region", "country", "latitude", "longitude"]

GRAM = 3
# Sizes of the grams that needles are looked up by: each by the largest that fits, so that long needles meet few texts.
GRAM_SIZES = (GRAM, 4, 6, 8, 12, 16, 24, 32)
# Postings, or needles, of a gram that meet in one task, about.
BLOCK_ROWS = 100_000


def place_struct() -> Column:
    return F.struct(*PLACE_FIELDS).alias("place")


def place_rank(place: Column) -> Column:
    """Largest population first, missing last, then the smallest id."""
    return F.struct((-F.coalesce(place["population"], F.lit(-1))).alias("p"), place["geonameid"].alias("g"))


def best_place(candidates: DataFrame, *keys: str) -> DataFrame:
    """The best candidate per key, combined map-side before the shuffle."""
    return candidates.groupBy(*keys).agg(F.min_by("place", place_rank(F.col("place"))).alias("place"))


def is_kind(*prefixes: str) -> Column:
    code = F.upper(F.coalesce(F.col("featureCode"), F.lit("")))
    out = code.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        out = out | code.startswith(prefix)
    return out


def lower_alternates() -> Column:
    return F.filter(F.transform("alternate_list", lambda a: F.lower(F.trim(a))), lambda a: a != "")


def name_index(gazetteer: DataFrame) -> DataFrame:
    """One row per normalised primary or alternate name with its best place."""
    keys = F.array_distinct(F.concat(F.array(F.lower("name")), F.coalesce(lower_alternates(), F.array())))
    rows = gazetteer.select(F.explode(F.array_compact(keys)).alias("key"), place_struct())
    return best_place(rows.where(F.col("key") != ""), "key")


def lookup_exact(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(mention, place)`` for distinct mentions by primary or alternate name; misses have null."""
    keyed = mentions.withColumn("key", F.lower(F.trim("mention")))
    return keyed.join(name_index(gazetteer), "key", "left").drop("key")


def mark_states(mentions: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``is_state``: whether the mention is the code or name of a state."""
    keys = state_keys(states).select(F.col("key").alias("_key"), F.lit(True).alias("_hit"))
    marked = mentions.join(keys, F.lower(F.trim("mention")) == F.col("_key"), "left")
    return marked.select(*mentions.columns, F.col("_hit").isNotNull().alias("is_state"))


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one length."""
    return F.array_distinct(_substrings(text, size))


def _substrings(text: Column, size: Column | int) -> Column:
    """All substrings of one length, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.coalesce(F.transform(places, lambda i: F.substring(text, i, size)), F.array().cast("array<string>"))


def _placed_grams(text: Column, sizes: list[Column | int]) -> Column:
    """``at, gram`` of all substrings of some lengths, from one; a gram is the hash of its text."""
    every = [F.transform(_substrings(text, n), lambda g, i: F.struct((i + 1).cast("int").alias("at"), F.xxhash64(g).alias("gram"))) for n in sizes]
    return F.concat(*every) if every else F.array().cast("array<struct<at:int,gram:bigint>>")


def _pieces(n: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(0)) / BLOCK_ROWS)).cast("int")


def contains_lookup(mentions: DataFrame, texts: DataFrame, shortest: int = 1) -> DataFrame:
    """Best place whose ``hay`` holds the mention (and whose ``also``, if given), by a positional gram index.

    ``mentions``: distinct ``(mention, needle)``, the needle in lower case. ``texts``:
    ``(hay, also, place)``. A posting is a gram, a text's number and the gram's place in it.
    A needle is looked up by grams of the largest of ``GRAM_SIZES`` that fits; it meets the
    postings of its rarest one, and the text must then hold the needle at that very place.
    Postings and needles of a gram that has many are dealt over a grid of pieces, so that no task
    gets all of either. Needles shorter than a gram are grams themselves and meet the best place
    per gram; ``shortest`` tells that there are none.
    """
    # Written out, so that the numbers stay the same whoever reads them.
    numbered = cut(best_place(texts, "hay", "also").withColumn("text", F.monotonically_increasing_id()))
    fitting = F.array_max(F.filter(F.array(*[F.lit(n) for n in GRAM_SIZES]), lambda n: n <= F.length("needle")))
    long_ones = cut(mentions.where(F.length("needle") >= GRAM).select("mention", "needle", fitting.alias("size")))
    # At most as many numbers as there are sizes.
    used = sorted(r[0] for r in long_ones.select("size").distinct().collect())
    postings = numbered.select("text", F.explode(_placed_grams(F.col("hay"), used)).alias("g")).select("text", "g.at", "g.gram")
    sizes = cut(postings.groupBy("gram").agg(F.count("*").alias("n")))

    asked = long_ones.select("mention", "needle", F.explode(_placed_grams(F.col("needle"), [F.col("size")])).alias("g")).select("mention", "needle", "g.at", "g.gram")
    ranked = (
        large_join(asked, sizes, "gram", "left").groupBy("mention", "needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("r"))
    )
    # A needle with a gram that no text holds is found nowhere.
    probes = cut(ranked.where(F.col("r.n") > 0).select("mention", "needle", "r.n", "r.gram", F.col("r.at").alias("offset")))
    # Only grams with many postings or needles; those that no needle asks for are left out.
    grid = F.broadcast(cut(
        large_join(sizes, probes.groupBy("gram").agg(F.count("*").alias("asked")), "gram", "left")
        .where((F.col("n") > BLOCK_ROWS) | (F.col("asked") > BLOCK_ROWS))
        .select("gram", _pieces("n").alias("rows"), _pieces("asked").alias("columns"), F.col("asked").isNull().alias("idle"))))

    def dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        of = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
        every = F.explode(F.sequence(F.lit(0), of[other] - 1)).alias(f"_{other}")
        return df.join(grid, "gram", "left").where(~F.coalesce("idle", F.lit(False))).select(
            *df.columns, F.pmod(F.xxhash64(key), of[own]).cast("int").alias(f"_{own}"), every)

    met = large_join(dealt(probes.drop("n"), "columns", "rows", "needle"), dealt(postings, "rows", "columns", "text"), ["gram", "_rows", "_columns"])
    likely = met.select("mention", "needle", "text", (F.col("at") - F.col("offset")).alias("before")).where("before >= 0")
    verified = large_join(likely, numbered, "text").where(
        (F.substring("hay", F.col("before") + 1, F.length("needle")) == F.col("needle"))
        & (F.col("also").isNull() | F.contains("also", "needle"))
    )
    found = best_place(verified.select("mention", "place"), "mention")
    if shortest >= GRAM:
        return found

    short_ones = mentions.where((F.length("needle") < GRAM) & (F.length("needle") > 0))
    short_grams = F.filter(
        F.concat(*[_grams(F.col("hay"), n) for n in range(1, GRAM)]),
        lambda g: F.col("also").isNull() | F.contains(F.col("also"), g),
    )
    per_gram = best_place(numbered.select(F.explode(short_grams).alias("needle"), "place"), "needle")
    return found.unionByName(large_join(short_ones, per_gram, "needle").select("mention", "place"))


def alternate_texts(gazetteer: DataFrame, with_name: bool = False) -> DataFrame:
    also = F.lower("name") if with_name else F.lit(None).cast("string")
    return gazetteer.where(is_kind("PPL")).select(
        F.lower(F.array_join("alternate_list", ",")).alias("hay"), also.alias("also"), place_struct()
    )


def lookup_fuzzy(mentions: DataFrame, gazetteer: DataFrame, longer_than: int = 3) -> DataFrame:
    """Best populated place with the mention anywhere in its alternates; misses are absent."""
    needles = mentions.select("mention", F.lower(F.trim("mention")).alias("needle"))
    wanted = needles.where(F.length("needle") > longer_than)
    return contains_lookup(wanted, alternate_texts(gazetteer), shortest=longer_than + 1)


def cascade_keys(gazetteer: DataFrame) -> DataFrame:
    """Best place per key of the three equality stages, as ``(stage, key, place)``."""
    state_keys = F.array(
        F.struct(F.lit(1).alias("stage"), F.lower("stateCode").alias("key")),
        F.struct(F.lit(1).alias("stage"), F.lower("name").alias("key")),
    )
    town_keys = F.concat(
        F.array(F.struct(F.lit(2).alias("stage"), F.col("name").alias("key"))),
        F.transform(
            F.coalesce(F.array_distinct(lower_alternates()), F.array().cast("array<string>")),
            lambda a: F.struct(F.lit(3).alias("stage"), a.alias("key")),
        ),
    )
    keys = F.when(F.upper("featureCode") == "ADM1", state_keys).when(is_kind("PPL"), town_keys)
    rows = gazetteer.select(F.explode(keys).alias("k"), place_struct()).select("k.*", "place")
    return best_place(rows.where(F.col("key").isNotNull()), "stage", "key")


def cascade_equal_stages(mentions: DataFrame, gazetteer: DataFrame, states: DataFrame) -> DataFrame:
    """``(mention, is_state, stage, place)``: the first equality stage with a hit, in one join.

    A state code or name looks at state records only; other mentions look for a town of the
    title-cased name, then for an alternate name. Without a hit stage and place are null.
    """
    norm = F.trim("mention")
    stages = F.when(
        F.col("is_state"),
        F.array(F.struct(F.lit(1).alias("stage"), F.lower(norm).alias("key"))),
    ).otherwise(
        F.array_compact(
            F.array(
                F.struct(F.lit(2).alias("stage"), title_case(norm).alias("key")),
                F.when(
                    F.length(norm) > 2, F.struct(F.lit(3).alias("stage"), F.lower(norm).alias("key"))
                ),
            )
        )
    )
    marked = mark_states(mentions.select("mention"), states)
    probes = marked.select("mention", "is_state", F.explode(stages).alias("k")).select("mention", "is_state", "k.*")
    hits = probes.join(cascade_keys(gazetteer), ["stage", "key"], "left")
    first = F.min_by(F.struct("stage", "place"), F.when(F.col("place").isNotNull(), F.col("stage")))
    return (
        hits.groupBy("mention", "is_state")
        .agg(first.alias("f"))
        .select("mention", "is_state", F.col("f.stage").alias("stage"), F.col("f.place").alias("place"))
    )


def unresolved(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    return mentions.join(resolved.where(F.col("place").isNotNull()), "mention", "left_anti")


def lookup_cascade(mentions: DataFrame, gazetteer: DataFrame, states: DataFrame) -> DataFrame:
    """``(mention, stage, place)`` for distinct mentions over all four stages; misses have null."""
    equal = cut(cascade_equal_stages(mentions, gazetteer, states))
    open_ones = equal.where(F.col("place").isNull() & ~F.col("is_state")).select("mention")
    fuzzy = lookup_fuzzy(open_ones, gazetteer).select("mention", F.col("place").alias("fuzzy"))
    return equal.join(fuzzy, "mention", "left").select(
        "mention",
        F.when(F.col("place").isNotNull(), F.col("stage"))
        .when(F.col("fuzzy").isNotNull(), F.lit(4))
        .alias("stage"),
        F.coalesce("place", "fuzzy").alias("place"),
    )


def lookup_two_stage(mentions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(mention, stage, place)``: exact name of a town or area, else a town with the mention
    in both alternates and name."""
    exact = best_place(
        gazetteer.where(is_kind("PPL", "ADM")).select(F.col("name").alias("mention"), place_struct()), "mention"
    )
    first = cut(mentions.select("mention").join(exact, "mention", "left"))
    open_ones = first.where(F.col("place").isNull()).select("mention", F.lower("mention").alias("needle"))
    second = contains_lookup(open_ones, alternate_texts(gazetteer, with_name=True))
    return first.join(second.withColumnRenamed("place", "fuzzy"), "mention", "left").select(
        "mention",
        F.when(F.col("place").isNotNull(), F.lit(1)).when(F.col("fuzzy").isNotNull(), F.lit(2)).alias("stage"),
        F.coalesce("place", "fuzzy").alias("place"),
    )


def region_states(regions: DataFrame, states: DataFrame, longest_match: bool = False) -> DataFrame:
    """``(region, hit)`` of distinct regions that hold a state's name: the first state in dimension order.

    ``longest_match`` takes the longest such name instead. Each name is kept under its rarest
    gram, so a region meets only names that share one with it; the match is then verified.
    """
    listed = known_states(states)
    names = cut(listed.select(F.lower("name").alias("low"), F.struct("ord", "code", "name", "lat", "lon").alias("hit")))

    def keys(text: Column) -> Column:
        return F.when(F.length(text) < GRAM, F.array(text)).otherwise(_grams(text, GRAM))

    grams = names.select("low", F.explode(keys(F.col("low"))).alias("gram")).distinct()
    sizes = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(sizes, "gram").groupBy("low").agg(F.min(F.struct("n", "gram")).alias("r")).select("low", "r.gram")
    kept = names.join(rarest, "low")
    low = F.lower("region")
    probes = regions.where(F.col("region").isNotNull()).select("region", F.explode(F.concat(*[_grams(low, n) for n in range(1, GRAM + 1)])).alias("gram"))
    hits = probes.join(kept, "gram").where(F.contains(F.lower("region"), "low"))
    rank = F.struct((-F.length("hit.name")).alias("r"), "hit.ord") if longest_match else F.struct("hit.ord", "hit.code", "hit.name")
    return hits.groupBy("region").agg(F.min_by("hit", rank).alias("hit"))


def classify_places(found: DataFrame, states: DataFrame, keep_misses: bool = True, longest_match: bool = False) -> DataFrame:
    """Add ``resolved``, a struct of city, state, region, country and coordinates, to rows of ``mention, place``.

    ``keep_misses=False`` gives nulls for a mention without a record instead of trying its
    text as a region. The state dimension may have any size.
    """
    columns = [c for c in found.columns if c != "is_state"]
    marked = mark_states(found.select(columns), states)
    names = state_names(states).select(F.col("code").alias("_code"), F.col("name").alias("_decoded"))
    place = F.col("place")
    feature = F.upper(F.coalesce(place["featureCode"], F.lit("")))
    is_area = feature.startswith("PPL") | feature.startswith("ADM")
    state = F.when(feature == "ADM1", F.coalesce("_decoded", place["stateCode"])).when(is_area, F.col("_decoded"))
    decoded = marked.join(names, place["stateCode"] == F.col("_code"), "left")
    # An empty state counts as none.
    owned = decoded.withColumn("_own", F.when(state != "", state))
    cleared = cut(owned.withColumn(
        "_region", F.when(F.col("_own").isNull() & ~F.col("is_state"), title_case(F.trim("mention")))).select(*columns, "_own", "_region"))
    hits = region_states(cleared.select(F.col("_region").alias("region")).distinct(), states, longest_match).select(
        F.col("region").alias("_named"), "hit")
    joined = cleared.join(hits, F.col("_region") == F.col("_named"), "left")
    built = F.struct(
        F.when(F.col("_own").isNotNull() & (feature != "ADM1"), place["name"]).alias("city"),
        F.coalesce("hit.name", "_own").alias("state"),
        F.col("_region").alias("region"),
        place["countryCode"].alias("country"),
        F.coalesce("hit.lat", place["latitude"]).alias("latitude"),
        F.coalesce("hit.lon", place["longitude"]).alias("longitude"),
    )
    return joined.select(*columns, (built if keep_misses else F.when(place.isNotNull(), built)).alias("resolved"))


def resolve_mentions(
    mentions: DataFrame, gazetteer: DataFrame, states: DataFrame, mode: str = "cascade"
) -> DataFrame:
    """``(mention, resolved)`` for distinct mentions; ``mode`` is exact, cascade or two_stage."""
    found = lookup_places(mentions, gazetteer, states, mode)
    return classify_places(found.select("mention", "place"), states, keep_misses=mode != "exact").select("mention", "resolved")


def lookup_places(mentions: DataFrame, gazetteer: DataFrame, states: DataFrame, mode: str = "cascade") -> DataFrame:
    """Distinct mentions with ``place``, by one of the three lookups."""
    if mode == "exact":
        return lookup_exact(mentions, gazetteer)
    if mode == "two_stage":
        return lookup_two_stage(mentions, gazetteer)
    return lookup_cascade(mentions, gazetteer, states)


def lookup_in_state(pairs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(mention, hint, stage, place)``: the best town of a mention within the state of a code; misses are absent.

    A town of the title-cased name comes first, then one with the mention among its alternates.
    """
    norm = F.trim("mention")
    town = F.array_compact(F.array(
        F.struct(F.lit(2).alias("stage"), title_case(norm).alias("key")),
        F.when(F.length(norm) > 2, F.struct(F.lit(3).alias("stage"), F.lower(norm).alias("key")))))
    probes = pairs.select("mention", "hint", F.explode(town).alias("k")).select("mention", "hint", "k.*")
    names = F.array(F.struct(F.lit(2).alias("stage"), F.col("name").alias("key")))
    others = F.transform(
        F.coalesce(F.array_distinct(lower_alternates()), F.array().cast("array<string>")),
        lambda a: F.struct(F.lit(3).alias("stage"), a.alias("key")))
    towns = gazetteer.where(is_kind("PPL")).select(F.col("stateCode").alias("hint"), F.explode(F.concat(names, others)).alias("k"), place_struct())
    best = best_place(towns.select("hint", "k.*", "place").where(F.col("key").isNotNull() & F.col("hint").isNotNull()), "hint", "stage", "key")
    hits = probes.join(best, ["hint", "stage", "key"])
    first = hits.groupBy("mention", "hint").agg(F.min_by(F.struct("stage", "place"), "stage").alias("f"))
    return first.select("mention", "hint", "f.stage", "f.place")


def next_state(posts: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """``(key, pos, mention, hint)``: every mention, with the state's code where the next mention of the post names one."""
    rows = posts.select(key, "locations", F.posexplode("locations").alias("pos", "mention"))
    after = rows.select(key, "pos", "mention", F.lower(F.trim(F.get("locations", F.col("pos") + 1))).alias("_next"))
    keys = state_keys(states).select(F.col("key").alias("_next"), F.col("code").alias("hint"))
    return lookup_join(after, keys, "_next").drop("_next")


def resolve_all(
    posts: DataFrame, gazetteer: DataFrame, states: DataFrame, key: str, mode: str = "exact", context: bool = False
) -> DataFrame:
    """``(key, pos, mention, resolved)``: every mention of every post; misses have nulls.

    Each distinct mention is looked up once; the result meets the posts again through the
    lookup join, so a mention that fills a third of the posts is neither looked up twice
    nor shuffled to one task. With ``context``, a mention that the next one follows up with a
    state ("Springfield, Illinois") is looked up among that state's towns first.
    """
    if not context:
        rows = posts.select(key, F.posexplode("locations").alias("pos", "mention"))
    else:
        rows = cut(next_state(posts, states, key))
    distinct = rows.where(F.col("mention") != "").select("mention").distinct()
    resolved = cut(resolve_mentions(distinct, gazetteer, states, mode))
    plain = lookup_join(rows, resolved, "mention")
    if not context:
        return plain
    pairs = rows.where(F.col("hint").isNotNull() & (F.col("mention") != "")).select("mention", "hint").distinct()
    inside = classify_places(lookup_in_state(pairs, gazetteer), states).select(
        F.col("mention").alias("_mention"), F.col("hint").alias("_hint"), F.col("resolved").alias("_inside"))
    joined = plain.join(inside, (F.col("mention") == F.col("_mention")) & (F.col("hint") == F.col("_hint")), "left")
    return joined.select(key, "pos", "mention", F.coalesce("_inside", "resolved").alias("resolved"))


def collect_places(rows: DataFrame, key: str) -> DataFrame:
    """Back to one row per post: ``all_locations`` in mention order, misses included."""
    item = F.struct(
        "pos", F.col("mention").alias("location"), *[F.col(f"resolved.{c}").alias(c) for c in RESOLVED_FIELDS]
    )
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    fields = ["location", *RESOLVED_FIELDS]
    bare = F.transform("_items", lambda s: F.struct(*[s[c].alias(c) for c in fields]))
    return packed.select(key, bare.alias("all_locations"))


def standardize_places(
    posts: DataFrame, gazetteer: DataFrame, states: DataFrame, key: str, mode: str = "cascade", context: bool = False
) -> DataFrame:
    """Per post: the first place with a state at the top, further ones in ``all_locations``.

    Posts without such a place have nulls at the top and an empty list.
    """
    rows = resolve_all(posts, gazetteer, states, key, mode, context).where(F.col("resolved.state") != "")
    places = collect_places(rows, key)
    top = F.get("all_locations", F.lit(0))
    rest = F.filter("all_locations", lambda p, i: i > 0)
    return (
        posts.select(key)
        .join(places, key, "left")
        .select(
            key,
            *[top[c].alias(c) for c in RESOLVED_FIELDS],
            F.when(F.size("all_locations") > 1, rest).alias("all_locations"),
        )
    )


def enrich_first_place(
    posts: DataFrame, gazetteer: DataFrame, states: DataFrame, mode: str = "exact"
) -> DataFrame:
    """Resolve the first mention only and add its columns."""
    firsts = posts.withColumn("mention", F.get("locations", F.lit(0)))
    distinct = firsts.where(F.col("mention") != "").select("mention").distinct()
    resolved = cut(resolve_mentions(distinct, gazetteer, states, mode))
    joined = lookup_join(firsts, resolved, "mention")
    return joined.select(*posts.columns, *[F.col(f"resolved.{c}").alias(c) for c in RESOLVED_FIELDS])


def decode_state(df: DataFrame, states: DataFrame, code: str, name: str, keep_unknown: bool) -> DataFrame:
    """State name for a code column; unknown codes stay or become null."""
    dim = states.select(F.col("code").alias(code), F.col("name").alias("_name"))
    joined = df.join(dim, code, "left")
    value = F.coalesce("_name", code) if keep_unknown else F.col("_name")
    return joined.withColumn(name, value).drop("_name")


def state_centroid(df: DataFrame, states: DataFrame, name: str = "state") -> DataFrame:
    dim = states.select(F.col("name").alias(name), F.col("lat").alias("state_lat"), F.col("lon").alias("state_lon"))
    return df.join(dim, name, "left")


def places_named(gazetteer: DataFrame, name: str, n: int = 5) -> DataFrame:
    """The ``n`` most populous places of a name, in any case."""
    return (
        gazetteer.where(F.lower("name") == name.lower())
        .orderBy(F.col("population").desc_nulls_last(), "geonameid")
        .limit(n)
    )
