import pytest

from reliefgrid.operators import posts as post_ops
from reliefgrid.operators import tagging
from reliefgrid.plans import pipeline
from reliefgrid.functions.text import clean_text
from reliefgrid.sources.states import us_states
from reliefgrid.sources.taxonomy import DISASTER_SYNONYMS
from test_places import GAZ

# Ten posts, one per disaster family, with the types the taxonomy gives.
SMOKE = [
    ("A huge Earthquake shook our street in Los Angeles, CA and woke the whole block.", ["Earthquake"]),
    ("A Wildfire burns and a Seismic Event rattles windows across Northern California.", ["Wildfire", "Earthquake"]),
    ("Crews fight a Wildfire in California while gusts make things worse uphill.", ["Wildfire"]),
    ("The Flood gauge in Houston, Texas passed its mark after two days of rain.", ["Flood"]),
    ("Forecasters track a Cyclone turning north towards Galveston, TX tonight.", ["Hurricane"]),
    ("Shutters are up before the Hurricane reaches Miami—buses leave at noon.", ["Hurricane"]),
    ("Sirens announce a Tsunami off Sendai in Japan following a quake.", ["Tsunami"]),
    ("An odd Tidal Wave rumour reached Mexico City this morning.", ["Tsunami"]),
    ("Two cars were lost when a Flash Flood crossed the road in Phoenix, AZ.", ["Flood"]),
    ("Ash from the Volcanic Eruption drifts over Hawaii’s Big Island at dawn.", ["Volcanic Eruption"]),
]
PLACES = [
    (1, "Los Angeles", ["la"], "US", "CA", 34.05, -118.24, "PPLA2", 3900000),
    (2, "California", [], "US", "CA", 37.2, -119.7, "ADM1", 39000000),
    (3, "Houston", [], "US", "TX", 29.76, -95.37, "PPL", 2300000),
    (4, "Texas", [], "US", "TX", 31.2, -99.2, "ADM1", 29000000),
    (5, "Mexico City", [], "MX", "09", 19.4, -99.1, "PPLC", 9000000),
    (6, "Phoenix", [], "US", "AZ", 33.4, -112.0, "PPLA", 1600000),
]


def test_smoke_disasters(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SMOKE)], "post_id int, text string")
    tagged = tagging.tag_disasters(
        rows.withColumn("cleaned", clean_text("text")), tagging.phrase_table(DISASTER_SYNONYMS)
    )
    got = {r["post_id"]: r["disasters"] for r in tagged.collect()}
    assert [got[i] for i in range(10)] == [want for _, want in SMOKE]


def test_phrase_rules(spark):
    phrases = tagging.phrase_table(DISASTER_SYNONYMS)
    assert len(set(phrases.values())) == 12
    texts = {
        "gamma-ray bursts": ["Solar Flare"],
        "FLOODS and earthquakes": ["Flood", "Earthquake"],
        "flooding": [],
        "Forest, Fire": [],
        "snow avalanche": ["Landslide"],
        "#ForestFire": ["Wildfire"],
        "": [],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("cleaned", clean_text("text"))
    got = {r["text"]: r["disasters"] for r in tagging.tag_disasters(rows, phrases).collect()}
    assert got == texts


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_joined_tags_of_a_large_taxonomy(spark, broadcast):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    names = [(f"N{i % 9}", f"word{i} rising") for i in range(20_000)]
    names += [("B", "shared"), ("A", "shared"), ("Long", long), ("Short", "two"), ("Gas", "gas"), ("Wide", "storm-surge")]
    names += [(f"C{i:05d}", "common") for i in range(6_000)]
    texts = {
        "word17 rising and words17 risings": ["N8"],
        "Word18 risings": ["N0"],
        "shared shareds common": ["A", "C00000"],
        long: ["Long"],
        long.replace("five", "fives"): ["Long"],
        "one two": ["Short"],
        "ga": [],
        "gass gas": ["Gas"],
        "storms surge": ["Wide"],
        "storm, surge": [],
        "": [],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("cleaned", clean_text("text"))
    taxonomy = spark.createDataFrame(names, "canonical string, synonym string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r["text"]: r["disasters"] for r in tagging.tag_disasters_joined(rows, taxonomy, "id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == texts


def test_joined_tags_agree_with_inline_ones(spark):
    taxonomy = spark.createDataFrame([(n, w) for n, ws in DISASTER_SYNONYMS.items() for w in ws], "canonical string, synonym string")
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SMOKE)], "id int, text string").withColumn("cleaned", clean_text("text"))
    inline = tagging.tag_disasters(rows, tagging.phrase_table(DISASTER_SYNONYMS)).collect()
    assert sorted(inline) == sorted(tagging.tag_disasters_joined(rows, taxonomy, "id").select(rows.columns + ["disasters"]).collect())


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_filtered_posts(spark, broadcast):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, broadcast)
    try:
        base = [(i, "me", "2025", t, f"at://x/{i}") for i, (t, _) in enumerate(SMOKE)]
        base += [(50, "copy", "2025", SMOKE[3][0], "at://x/50"), (51, "e", "2025", "", "at://x/51"),
                 (52, "n", "2025", "Nice day in Houston", "at://x/52")]
        posts = spark.createDataFrame(base, "post_id int, author string, created_at string, text string, uri string")
        dicts = pipeline.Dictionaries(
            phrases=tagging.phrase_table(DISASTER_SYNONYMS),
            gazetteer=spark.createDataFrame(PLACES, GAZ),
            states=us_states(spark),
            lexicon=spark.createDataFrame([("huge", 0.4, 0.9), ("worse", -0.4, 0.6)], "word string, polarity double, subjectivity double"),
        )
        filtered = pipeline.filtered_posts(posts, dicts)
        rows = filtered.orderBy("post_id", "location").collect()
        got = [(r["post_id"], r["disasters"][0], r["city"], r["state"], r["location"], r["sentiment"]) for r in rows]
        assert sorted(map(str, got)) == sorted(map(str, [
            (0, "Earthquake", "Los Angeles", "California", "Los Angeles", "Positive"),
            (1, "Wildfire", None, "California", None, "Neutral"),
            (2, "Wildfire", None, "California", None, "Negative"),
            (3, "Flood", "Houston", "Texas", "Houston", "Neutral"),
            (3, "Flood", None, "Texas", "Texas", "Neutral"),
            (7, "Tsunami", None, None, None, "Neutral"),
            (8, "Flood", "Phoenix", "Arizona", "Phoenix", "Neutral"),
        ]))
        summary = pipeline.crisis_summary(filtered).collect()
        assert [(r["state"], r["disasters"], r["count"]) for r in summary][0] == ("California", "Wildfire", 2)
        again = pipeline.crisis_summary(filtered, pipeline.crisis_summary(filtered)).collect()
        assert sum(r["count"] for r in again) == 2 * sum(r["count"] for r in summary)
    finally:
        spark.conf.set(key, before)


def test_two_letter_codes_need_capitals(spark):
    names = spark.createDataFrame([("or", 1), ("me", 1), ("reno", 1)], "gram string, words int")
    posts = spark.createDataFrame([(1, "me or you in Reno OR"), (2, "none")], "id int, cleaned string")
    got = tagging.tag_places(posts, names, "id").collect()
    assert [(r["id"], r["locations"]) for r in got] == [(1, ["Reno", "OR"])]


def test_model_hook(spark):
    def load():
        return lambda texts: [{"disasters": ["Flood"] if "Flood" in t else [], "locations": ["A", "A"], "polarity": 0.5} for t in texts]

    posts = spark.createDataFrame([(1, "#FloodNow here"), (2, "calm")], "post_id int, text string")
    got = {r["post_id"]: r for r in tagging.extract_with_model(posts, load).collect()}
    assert got[1]["disasters"] == ["Flood"] and got[2]["disasters"] == [] and got[2]["locations"] == ["A"]


def test_commit_rules(spark):
    schema = (
        "repo string, ops array<struct<action:string,path:string>>, records array<struct<type:string,text:string,"
        "createdAt:string,embed:struct<type:string,thumb:string>,reply:struct<parent:struct<uri:string>>>>"
    )
    post = "app.bsky.feed.post"
    rows = [("did:1", [("create", f"{post}/a"), ("create", f"{post}/b"), ("delete", f"{post}/c"), ("create", "x/d")],
             [(post, "hi", None, ("app.bsky.embed.external", None), None), ("like", "no", None, None, None),
              (post, None, "t", ("app.bsky.embed.images", None), (("at://p",),))])]
    commits = spark.createDataFrame(rows, schema)
    flat = post_ops.flatten_post(post_ops.create_records(commits)).orderBy("uri", "text").collect()
    assert [(r["uri"][-1], r["text"], r["has_images"], r["reply_to"]) for r in flat] == [
        ("a", "", True, "at://p"), ("a", "hi", False, None), ("b", "", True, "at://p"), ("b", "hi", False, None)]
    assert post_ops.create_records(commits, first_only=True).count() == 2


def test_numbering_is_consecutive(spark):
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "k")
    free = post_ops.number_rows(df, "n").collect()
    assert sorted(r["n"] for r in free) == list(range(1, 1001))
    ordered = post_ops.number_rows(df, "n", ["k"]).collect()
    assert all(r["n"] == r["k"] + 1 for r in ordered)
    one = df.where("k < 0")
    assert post_ops.number_rows(one, "n").count() == 0


def test_lemmas_and_lexicon(spark):
    posts = spark.createDataFrame([(1, "The Geese are the best geese"), (2, "")], "id int, text string")
    lemmas = spark.createDataFrame([("geese", "goose")], "word string, lemma string")
    got = {r["id"]: r["preprocessed_text"] for r in tagging.preprocess_topics(posts, ["the", "are"], "id", lemmas).collect()}
    assert got == {1: "goose best goose", 2: ""}
    lexicon = spark.createDataFrame([("best", 1.0, 0.3), ("geese", 0.5, 0.1)], "word string, polarity double, subjectivity double")
    scored = tagging.lexicon_scores(posts.withColumn("cleaned", clean_text("text")), lexicon, "id")
    rows = {r["id"]: r["polarity"] for r in scored.collect()}
    assert rows[1] == pytest.approx(2 / 3, abs=1e-6) and rows[2] == 0.0


def test_texts_are_cleaned_once(spark):
    """What a text holds is written out; nothing behind that cleans the texts again."""
    from reliefgrid.plans import bindings, catalogue, pipeline

    done = pipeline.extract_entities(bindings.posts(spark, "/root/testdata/sf0.001"), catalogue.doc_dicts(spark, "/root/testdata/sf0.001"))
    assert "://" not in done._jdf.queryExecution().optimizedPlan().toString()
