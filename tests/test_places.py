import random

import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import places
from reliefgrid.operators.joins import lookup_join
from reliefgrid.sources.states import STATE_SCHEMA, us_states

GAZ = "geonameid long, name string, alternate_list array<string>, countryCode string, stateCode string, " \
      "latitude double, longitude double, featureCode string, population long"
ROWS = [
    (1, "Buffalo", ["buf", "buffalo city"], "US", "NY", 42.9, -78.9, "PPLA2", 270000),
    (2, "Buffalo", [], "US", "WY", 44.3, -106.7, "PPL", 4600),
    (3, "Los Angeles", ["L.A.", "la", "city of angels"], "US", "CA", 34.05, -118.24, "PPLA2", 3900000),
    (4, "California", ["Golden State"], "US", "CA", 37.25, -119.75, "ADM1", 39000000),
    (5, "District of Columbia", ["Washington DC"], "US", "DC", 38.9, -77.0, "ADM1", 600000),
    (6, "Erie County", [""], "US", "NY", 42.7, -78.7, "ADM2", 900000),
    (7, "San Juan", ["San Juan Bautista"], "PR", "ZZ", 18.4, -66.1, "PPLC", 400000),
    (8, "Lake Erie", ["erie"], "US", "NY", 42.2, -81.2, "LK", 0),
    (9, "Springfield", ["springtown"], "US", "IL", 39.8, -89.6, "PPLA", None),
    (10, "Houston", ["h-town", "space city"], "US", "TX", 29.8, -95.4, "PPL", 2300000),
]


@pytest.fixture(scope="module")
def gaz(spark):
    return spark.createDataFrame(ROWS, GAZ).cache()


def resolve(spark, gaz, texts, mode="cascade"):
    mentions = spark.createDataFrame([(t,) for t in texts], "mention string")
    rows = places.resolve_mentions(mentions, gaz, us_states(spark), mode).select("mention", "resolved.*").collect()
    return {r["mention"]: (r["city"], r["state"], r["region"]) for r in rows}


def test_cascade_rules(spark, gaz):
    got = resolve(
        spark, gaz,
        ["Buffalo", "Canada", "CA", "california", " la", "space c", "District of Columbia", "Northern California",
         "West Virginia Panhandle", "Arkansas River", "Washington Dc", "San Juan", "TX", "ny", "Lake Erie"],
    )
    assert got["Buffalo"] == ("Buffalo", "New York", None)
    assert got["Canada"] == (None, None, "Canada")
    assert got["CA"] == got["california"] == (None, "California", None)
    assert got[" la"] == (None, None, None)
    assert got["space c"] == ("Houston", "Texas", None)
    assert got["District of Columbia"] == (None, "District of Columbia", None)
    assert got["Northern California"] == (None, "California", "Northern California")
    assert got["West Virginia Panhandle"] == (None, "Virginia", "West Virginia Panhandle")
    assert got["Arkansas River"] == (None, "Arkansas", "Arkansas River")
    assert got["Washington Dc"] == (None, "Washington", "Washington Dc")
    assert got["San Juan"] == (None, None, "San Juan")
    # A state text without a state record stays open, and gets no region.
    assert got["TX"] == got["ny"] == (None, None, None)
    assert got["Lake Erie"] == (None, None, "Lake Erie")


def test_longest_region(spark):
    regions = spark.createDataFrame([("West Virginia Panhandle",), ("Nowhere",), (None,)], "region string")
    first, longest = (places.region_states(regions, us_states(spark), x).collect() for x in (False, True))
    assert [(r.region, r.hit.name) for r in first] == [("West Virginia Panhandle", "Virginia")]
    assert [(r.region, r.hit.name) for r in longest] == [("West Virginia Panhandle", "West Virginia")]


def test_fifty_thousand_states(spark, gaz):
    """Any number of states, some without code or name, against plain containment."""
    rng = random.Random(8)
    rows = [(i, f"S{i}", f"{rng.choice('abcdefgh')}{i:05d}{rng.choice('xyz')}", float(i), -float(i)) for i in range(50_000)]
    rows += [(50_000, None, "nocode", 0.0, 0.0), (50_001, "NN", None, 0.0, 0.0), (50_002, "ab", "Ab", 1.0, 1.0), (50_003, "e", "", 1.0, 1.0)]
    states = spark.createDataFrame(rows, STATE_SCHEMA)
    texts = [f"the {rows[i][2].upper()} and {rows[i // 2][2]} side" for i in range(0, 50_000, 997)] + ["nocode", "crab nebula", "zzz", ""]
    regions = spark.createDataFrame([(t,) for t in texts], "region string")
    names = [(o, n) for o, c, n, _, _ in rows if c and n]
    for longest in (False, True):
        want = {}
        for t in texts:
            fits = [(o, n) for o, n in names if n.lower() in t.lower()]
            if fits:
                want[t] = min(fits, key=(lambda x: (-len(x[1]), x[0])) if longest else (lambda x: x[0]))[1]
        assert {r.region: r.hit.name for r in places.region_states(regions, states, longest).collect()} == want
    mentions = spark.createDataFrame([("s7",), (" S49999 ",), ("nn",), (rows[3][2].upper(),)], "mention string")
    assert {r.mention: r.is_state for r in places.mark_states(mentions, states).collect()} == {
        "s7": True, " S49999 ": True, "nn": False, rows[3][2].upper(): True}


def test_next_mention_narrows_to_its_state(spark):
    towns = [
        (1, "Springfield", ["springtown"], "US", "IL", 39.8, -89.6, "PPLA", 100),
        (2, "Springfield", ["springtown"], "US", "OR", 44.0, -123.0, "PPL", 50),
        (3, "Springfield", [], "US", "MO", 37.2, -93.3, "PPL", 900),
        (4, "Springfield", [], "US", "OR", 44.0, -123.0, "LK", 5000),
    ]
    gaz = spark.createDataFrame(towns, GAZ)
    posts = spark.createDataFrame([
        (1, ["Springfield", "Illinois"]), (2, ["Springfield", "oregon"]), (3, ["Springfield", "Houston"]), (4, ["Springfield", "TX"]),
        (5, ["springtown", "OR", "Springfield"]), (6, []), (7, None), (8, ["Oregon", "Illinois"])], "post_id int, locations array<string>")
    rows = places.resolve_all(posts, gaz, us_states(spark), "post_id", "cascade", context=True).collect()
    got = {(r.post_id, r.pos): (r.resolved.city, r.resolved.state) for r in rows}
    assert got[1, 0] == ("Springfield", "Illinois") and got[2, 0] == ("Springfield", "Oregon")
    # Without a state behind it, or without a town there, population decides.
    assert got[3, 0] == got[4, 0] == got[5, 2] == ("Springfield", "Missouri")
    assert got[5, 0] == ("Springfield", "Oregon")
    plain = places.resolve_all(posts, gaz, us_states(spark), "post_id", "cascade").collect()
    assert {(r.post_id, r.pos) for r in plain} == set(got)
    assert {r.resolved.state for r in plain if r.mention == "Springfield"} == {"Missouri"}


def test_exact_and_two_stage(spark, gaz):
    got = resolve(spark, gaz, ["LA", "erie", "Nowhere", "erie county"], "exact")
    assert got["LA"] == ("Los Angeles", "California", None)
    assert got["erie"] == (None, None, "Erie")
    assert got["Nowhere"] == (None, None, None)
    assert got["erie county"] == ("Erie County", "New York", None)
    got = resolve(spark, gaz, ["Buffalo", "buffalo", "uf", "Erie County", "county"], "two_stage")
    assert got["Buffalo"][0] == got["buffalo"][0] == got["uf"][0] == "Buffalo"
    assert got["Erie County"] == ("Erie County", "New York", None)
    assert got["county"] == (None, None, "County")


def test_contains_lookup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(places, "BLOCK_ROWS", 7)
    rng = random.Random(11)
    words = ["ville", "town", "spring", "san", "port", "lake", "über", "a%b", "_x"]
    rows = []
    for i in range(300):
        alts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.choice(words), alts, "US", "NY", 0.0, 0.0, "PPL", rng.choice([None, 1, 5, 5, 9])))
    gaz = spark.createDataFrame(rows, GAZ)
    needles = sorted({w[: rng.randint(1, 9)] for w in (a for r in rows for a in r[2])} | {"ll", "v", "%b", "zz", "n,s", "t,"})
    for with_name in (False, True):
        mentions = spark.createDataFrame([(n, n) for n in needles], "mention string, needle string")
        found = places.contains_lookup(mentions, places.alternate_texts(gaz, with_name)).collect()
        got = {r["mention"]: r["place"]["geonameid"] for r in found}
        want = {}
        for n in needles:
            fits = [r for r in rows if n in ",".join(r[2]) and (not with_name or n in r[1])]
            if fits:
                want[n] = min(fits, key=lambda r: (-(r[8] if r[8] is not None else -1), r[0]))[0]
        assert got == want


def test_lookup_join_with_hot_and_missing_keys(spark, no_broadcast):
    keys = ["hot"] * 500 + [None] * 300 + [f"k{i}" for i in range(200)] + ["gone"] * 100
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 3), ("k7", 7), ("extra", 9)], "k string, v int")
    got = {r["i"]: r["v"] for r in lookup_join(left, right, "k", "left").collect()}
    want = {i: {"hot": 1, "k3": 3, "k7": 7}.get(k) for i, k in enumerate(keys)}
    assert got == want
    kept = lookup_join(left, right, "k", "inner").collect()
    assert sorted(r["i"] for r in kept) == [i for i, v in want.items() if v is not None]


def test_standardize_keeps_only_places_with_state(spark, gaz, no_broadcast):
    posts = spark.createDataFrame(
        [(1, ["Canada", "Buffalo", "Houston", "Buffalo"]), (2, ["Canada"]), (3, [])], "post_id int, locations array<string>"
    )
    rows = {r["post_id"]: r for r in places.standardize_places(posts, gaz, us_states(spark), "post_id").collect()}
    assert rows[1]["city"] == "Buffalo"
    assert [p["location"] for p in rows[1]["all_locations"]] == ["Houston", "Buffalo"]
    assert rows[2]["state"] is None and rows[2]["all_locations"] is None
    assert rows[3]["state"] is None


def test_decode_and_topk(spark, gaz):
    done = places.decode_state(gaz.select("geonameid", "stateCode"), us_states(spark), "stateCode", "state", True)
    got = {r["geonameid"]: r["state"] for r in done.collect()}
    assert got[1] == "New York" and got[7] == "ZZ"
    assert [r["geonameid"] for r in places.places_named(gaz, "buffalo").collect()] == [1, 2]


def test_large_tables_of_the_lookup_are_not_broadcast(spark, gaz):
    """Exploded grams look small to Spark; only the grid of hot grams may go through the driver."""
    mentions = spark.createDataFrame([("space city",), ("h-town",)], "mention string")
    for found in (places.lookup_fuzzy(mentions, gaz), places.lookup_two_stage(mentions, gaz)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
        assert joins and all("[gram#" in x and "LeftOuter" in x for x in joins if "mention#" not in x), joins


def test_needles_of_all_gram_sizes(spark, monkeypatch):
    monkeypatch.setattr(places, "BLOCK_ROWS", 5)
    text = "abcabcabdé0123456789abcabcabcabcabcabcxyz, the end of a long text"
    rows = [(i, text[i:] + text[:i]) for i in range(12)]
    gaz = spark.createDataFrame([(i, "x", [t], "US", "NY", 0.0, 0.0, "PPL", i) for i, t in rows], GAZ)
    needles = {text[i:i + n] for i in (0, 5, 17, 22) for n in range(1, 42)} | {"abcabcabcabd", "q" * 40}
    mentions = spark.createDataFrame([(n, n) for n in needles], "mention string, needle string")
    found = {r["mention"]: r["place"]["geonameid"] for r in places.contains_lookup(mentions, places.alternate_texts(gaz)).collect()}
    assert found == {n: max(own) for n in needles if (own := [i for i, t in rows if n in t])}
