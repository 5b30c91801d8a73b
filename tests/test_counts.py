import random

import pytest
from pyspark.sql import functions as F

import models
from reliefgrid.operators import counts, evaluate, repair, views
from reliefgrid.sources import schemas
from reliefgrid.sources.states import us_states

POST = "disasters array<string>, polarity double, city string, state string, country string"
# Known posts and their counts.
POSTS = [
    ("Earthquake", 0.0, "Universal City", "California"),
    ("Earthquake", 0.15, "Los Angeles County", "California"),
    ("Hurricane", -0.05, None, "Texas"),
    ("Hurricane", 0.12, "Houston", "Texas"),
    ("Flood", -0.1, "Miami", "Florida"),
    ("Flood", 0.0, "Key West", "Florida"),
    ("Wildfire", -0.08, "Boulder", "Colorado"),
    ("Wildfire", 0.0, "Denver", "Colorado"),
    ("Pandemic", 0.05, "New York", "New York"),
    ("Pandemic", -0.04, "Buffalo", "New York"),
    ("Wildfire", 0.11125, "Los Angeles", "Texas"),
    ("Wildfire", 0.11125, None, "California"),
    ("Cold Snap", 0.026515, None, "Florida"),
    ("Earthquake", 0.0, "Christchurch", "Virginia"),
    ("Flood", -0.1875, "Little Rock", "Alabama"),
    ("Flood", 0.733333, "Kansas City", "Kansas"),
    ("Flood", 0.733333, "Pleasant Hill", "Mississippi"),
]
EXPECTED = {
    ("Colorado", "Wildfire"): (2, -0.04, ["Boulder", "Denver"]),
    ("California", "Earthquake"): (2, 0.08, ["Los Angeles County", "Universal City"]),
    ("New York", "Pandemic"): (2, 0.0, ["Buffalo", "New York"]),
    ("Florida", "Flood"): (2, -0.05, ["Key West", "Miami"]),
    # An exact tie (0.035): to even here, while sums of binary fractions would fall to 0.03.
    ("Texas", "Hurricane"): (2, 0.04, ["Houston"]),
    ("California", "Wildfire"): (1, 0.11, []),
    ("Alabama", "Flood"): (1, -0.19, ["Little Rock"]),
    ("Florida", "Cold Snap"): (1, 0.03, []),
    ("Mississippi", "Flood"): (1, 0.73, ["Pleasant Hill"]),
    ("Kansas", "Flood"): (1, 0.73, ["Kansas City"]),
    ("Texas", "Wildfire"): (1, 0.11, ["Los Angeles"]),
    ("Virginia", "Earthquake"): (1, 0.0, ["Christchurch"]),
}


def frame(spark, rows):
    made = [([r[0]], *r[1:], "US") for r in rows]
    return counts.single_disaster(spark.createDataFrame(made, POST))


def test_known_counts(spark):
    rows = counts.severity(counts.crisis_counts(frame(spark, POSTS))).collect()
    got = {(r["state"], r["disasters"]): (r["count"], r["avg_sentiment"], r["cities"]) for r in rows}
    assert got == EXPECTED
    for r in rows:
        want = 1.1328430311977618 if r["count"] == 2 else -0.8091735937126872
        assert r["severity"] == pytest.approx(want, abs=1e-12)


def test_second_known_severity(spark):
    sizes = [5, 4, 4, 3, 3, 2, 2, 2, 2] + [1] * 9
    rows = counts.severity(spark.createDataFrame([(s,) for s in sizes], "count long")).collect()
    by = {r["count"]: r["severity"] for r in rows}
    assert by[5] == pytest.approx(2.337581167421939, abs=1e-12) and by[2] == 0.0


def test_severity_of_one_row_and_of_equal_rows(spark):
    one = counts.severity(spark.createDataFrame([(3,)], "count long")).first()
    assert one["severity"] is None
    same = spark.createDataFrame([(3,), (3,)], "count long")
    assert [r["severity"] for r in counts.severity(same).collect()] == [0.0, 0.0]
    assert [r["severity"] for r in counts.severity(same, zero_guard=False).collect()] == [None, None]


def test_missing_keys_are_not_counted(spark):
    rows = [(["Flood"], 0.1, "A", None, "US"), (["Flood"], 0.1, "A", "Ohio", None), ([], 0.1, "A", "Ohio", "US")]
    got = counts.crisis_counts(counts.single_disaster(spark.createDataFrame(rows, POST))).collect()
    assert [(r["state"], r["disasters"], r["count"]) for r in got] == [("Ohio", "Unknown", 1)]


def test_merge_forms(spark):
    a, b = frame(spark, POSTS[:9]), frame(spark, POSTS[9:])
    merged = counts.merge_counts(counts.crisis_counts(a), counts.crisis_counts(b)).collect()
    got = {(r["state"], r["disasters"]): (r["count"], r["avg_sentiment"], r["cities"]) for r in merged}
    assert got[("New York", "Pandemic")] == (2, 0.0, ["Buffalo", "New York"])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in EXPECTED.items()}
    exact = counts.finish_counts(counts.merge_partials(counts.count_partials(a), counts.count_partials(b)))
    again = {(r["state"], r["disasters"]): (r["count"], r["avg_sentiment"], r["cities"]) for r in exact.collect()}
    assert again == EXPECTED
    assert counts.merge_counts(None, counts.crisis_counts(a)).count() == 5
    none = counts.crisis_counts(a.where("false"))
    assert counts.merge_counts(counts.crisis_counts(a), none).count() == 5


@pytest.mark.parametrize("fold", [1, 3, 1000])
def test_running_mean_against_model(spark, fold):
    rng = random.Random(2)
    history = {k: [(b, rng.randint(-100, 100)) for b in sorted(rng.sample(range(60), rng.randint(1, 40)))] for k in "abcdef"}
    history["golden"] = [(1, 10), (2, 30), (3, -20)]
    rows = [(k, b, c / 100) for k, items in history.items() for b, c in items]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, batch int, avg_sentiment double")
    got = {r["k"]: r["avg_sentiment"] for r in counts.running_mean(df, ["k"], fold).collect()}
    assert got["golden"] == 0.0
    assert got == {k: models.fold([c for _, c in items]) / 100 for k, items in history.items()}


def test_offline_counts(spark):
    rows = [(["Flood", "Fire"], ["X", "Y"], "Positive", 0.5), (["Flood"], [], "Negative", -0.5),
            (["Flood"], ["X"], "Neutral", 0.0), (["Flood"], ["X"], "Negative", -0.25)]
    df = spark.createDataFrame(rows, "disasters array<string>, locations array<string>, sentiment string, polarity double")
    got = {(r["disasters"], r["locations"]): (r["count"], r["avg_sentiment"]) for r in counts.offline_counts(df).collect()}
    assert got == {("Flood", "X"): (2, 0.12), ("Flood", "Y"): (1, 0.5), ("Fire", "X"): (1, 0.5), ("Fire", "Y"): (1, 0.5)}


def test_views(spark):
    schema = "country string, state string, disasters string, count long, avg_sentiment double, cities array<string>, severity double"
    rows = [("US", "Ohio", "Flood", 3, 0.1, ["A", "B"], 1.0), ("US", None, "Fire", 1, 0.02, ["A"], 0.0),
            ("US", "Utah", None, 2, 0.3, [], 0.0), ("US", "Nowhere", "Fire", 2, 0.3, ["Z"], 0.0)]
    table = spark.createDataFrame(rows, schema)
    k = views.kpi_stats(table).first()
    assert (k["total_reports"], k["total_disasters"], k["total_states"], k["total_cities"], k["avg_sentiment"]) == (8, 3, 4, 3, 0.18)
    posts = spark.createDataFrame(
        [(1, " a", "OHIO ", 10.0, 20.0), (2, "A", "Ohio", 99.0, 99.0), (3, "b", "ohio", 10.0, 22.0)],
        "i int, city string, state string, latitude double, longitude double",
    )
    marks = {r["state"]: r for r in views.map_markers(table, views.city_coordinates(posts, ["i"]), us_states(spark)).collect()}
    assert set(marks) == {"Ohio", "Utah"}
    assert (marks["Ohio"]["lat"], marks["Ohio"]["lon"], marks["Ohio"]["size"], marks["Ohio"]["city"]) == (10.0, 21.0, 50.0, "A, B")
    assert (marks["Utah"]["lat"], marks["Utah"]["size"], marks["Utah"]["city"]) == (39.3055, 5.0, "State-level data")
    edges = spark.createDataFrame([(-1.0,), (1.0,), (0.0,), (1.5,), (0.1,)], "polarity double")
    bins = {r["bin"]: (r["count"], r["density"]) for r in views.polarity_histogram(edges).collect()}
    assert len(bins) == 20 and {b: v[0] for b, v in bins.items() if v[0]} == {0: 1, 10: 1, 11: 1, 19: 1}
    assert bins[0][1] == pytest.approx(2.5)


def test_repair_and_gate(spark):
    old = spark.createDataFrame([("a", "t")], "author string, text string")
    fixed = repair.repair_schema(old, schemas.FILTERED_POST_DEFAULTS).first()
    assert fixed["disasters"] == [] and fixed["polarity"] == 0.0 and fixed["sentiment"] == "Neutral" and fixed["city"] == ""
    both = repair.union_aligned(old, old.withColumn("latitude", F.lit(1.0)), schemas.FILTERED_POST_DEFAULTS)
    assert sorted(str(r["latitude"]) for r in both.collect()) == ["1.0", "None"]
    empty = repair.quality_gate(old.where("false"), schemas.FILTERED_POST_DEFAULTS).first()
    assert empty["start_over"] and "city" in empty["missing_columns"]


def test_gold_lists_and_scores(spark):
    rows = [("1", 1, "first", " A "), ("1", 2, "second", "B"), ("1", 3, "third", "A"), ("2", 4, "x", None), (None, 5, "y", "Q")]
    gold = evaluate.gold_lists(spark.createDataFrame(rows, "id string, ord int, text string, toponym string"))
    got = {r["id"]: (r["text"], r["locations"]) for r in gold.collect()}
    assert got == {"1": ("first", ["A", "B"]), "2": ("x", [])}
    pred = spark.createDataFrame([("1", "p", ["a town", "c"]), ("3", "only", ["d"])], "id string, text string, locations array<string>")
    results = evaluate.compare_lists(gold, pred)
    s = evaluate.extraction_scores(results).first()
    assert (s["tp"], s["fp"], s["fn"]) == (1, 2, 1)
    assert s["precision"] == pytest.approx(1 / 3, abs=1e-6) and s["recall"] == pytest.approx(0.5, abs=1e-6)
    assert [r["id"] for r in evaluate.error_samples(results, n=1).collect()] == ["1"]
