import random

import pytest
from pyspark.sql import functions as F

import models
from reliefgrid.functions import matching, scalars, text


def column(spark, values, kind, *exprs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in rows.select("i", *exprs).orderBy("i").collect()]


CLEAN = {
    "RT @newsdesk: Smoke drifts over Fresno! Keep indoors!": "RT Smoke drifts over Fresno Keep indoors",
    "Floods #RockIsland #AustinTexas #SanMateo": "Floods Rock Island, Austin Texas, San Mateo,",
    "#Rock's x #Rocké #aB#cD @http://x.y/#Foo http://x/#FooBar é’s ünï #http://Q a_b ## #":
        "Rock, s x Rock,é a B,c D, x y Foo, é s ünï http, Q a_b",
    "📢 quake‑test #flood,now (#sismo)": "quake test flood,,now sismo,",
    "#iPhoneXS café": "i Phone XS, café",
}


def test_clean_text_examples(spark):
    got = column(spark, list(CLEAN), "string", text.clean_text("v"))
    assert [g[0] for g in got] == list(CLEAN.values())


def test_clean_text_against_model(spark):
    given = models.texts(7, 400)
    got = column(spark, given, "string", text.clean_text("v"))
    assert [g[0] for g in got] == [models.clean(t) for t in given]


def test_title_case_against_python(spark):
    given = ["o'fallon", "winston-salem", "mexico's city", "a1b x", "ßa äB", "", "UPPER lower"] + models.texts(3, 150)
    got = column(spark, given, "string", text.title_case("v"))
    assert [g[0] for g in got] == [t.title() for t in given]


def test_small_text_rules(spark):
    got = column(spark, ["# Buffalo's #", "Reno’s", "Its", "s"], "string", text.strip_possessive("v"))
    assert [g[0] for g in got] == ["Buffalo", "Reno", "Its", "s"]
    stop = ["i", "the", "its", "again", "it"]
    given = ["I like the river today! #calm", "I don't think it's snowing again! #snow", "@a http://x.y z"]
    got = column(spark, given, "string", text.topic_words("v", stop))
    assert [g[0] for g in got] == [
        ["like", "river", "today", "calm"], ["dont", "think", "snowing", "snow"], ["z"],
    ]
    assert column(spark, ["RockIsland"], "string", text.split_camel("v")) == [("Rock Island",)]


def test_sentiment_and_rounding(spark):
    got = column(spark, [0.1, 0.0999, 0.0, -0.0001, -1.0], "double", scalars.sentiment_class("v"))
    assert [g[0] for g in got] == ["Positive", "Neutral", "Neutral", "Negative", "Negative"]
    got = column(spark, [0.035, 0.005, -0.075, 0.125], "double", scalars.round2("v"))
    assert [g[0] for g in got] == [0.04, 0.0, -0.08, 0.12]


def test_coercion_and_lists(spark):
    given = ["5", "2.9", "x", None, "nan", ""]
    got = column(spark, given, "string", scalars.coerce_count("v"), scalars.coerce_number("v", 0))
    assert [g[0] for g in got] == [5, 2, 1, 1, 1, 1]
    assert [g[1] for g in got] == [5.0, 2.9, 0.0, 0.0, 0.0, 0.0]
    given = ["['Denver', 'Boulder']", "[]", "[\"Coeur d'Alene\"]", "oops", None]
    got = column(
        spark, given, "string", scalars.parse_list_literal("v"), scalars.parse_list_literal("v", True)
    )
    assert [g[0] for g in got] == [["Denver", "Boulder"], [], [], [], []]
    assert [g[1] for g in got] == [["Denver", "Boulder"], [], ["Coeur d'Alene"], [], []]
    got = column(spark, ["['flood', 'cold snap']", "new york"], "string", scalars.cell_text("v"))
    assert [g[0] for g in got] == ["Flood, Cold Snap", "New York"]


def test_created_at_forms(spark):
    given = [
        "2025-04-22T00:00:18Z", "2025-04-21T23:18:30.741680Z", "2025-04-22T00:04:42+00:00",
        "2025-04-22T00:22:17.324472+00:00", "yesterday",
    ]
    got = column(spark, given, "string", scalars.iso_utc(scalars.parse_created_at("v")))
    assert [g[0] for g in got] == [
        "2025-04-22T00:00:18Z", "2025-04-21T23:18:30Z", "2025-04-22T00:04:42Z", "2025-04-22T00:22:17Z", None,
    ]


def test_partial_match_example_and_model(spark):
    rng = random.Random(5)
    stock = ["york", "new york", "la", "los angeles", "ca", "x", "san", "san jose", "jose"]
    cases = [(["los angeles", "ca", "new york"], ["york", "los angeles", "la", "x"]), ([], []), (["a"], []), ([], ["a"])]
    cases += [
        (rng.sample(stock, rng.randint(0, 6)), [rng.choice(stock) for _ in range(rng.randint(0, 7))]) for _ in range(120)
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, g array<string>, p array<string>")
    got = rows.select("i", matching.match_partial("g", "p").alias("m")).select("i", "m.*").orderBy("i").collect()
    for row, case in zip(got, cases):
        pairs, false, missed = models.partial(*case)
        assert [tuple(x) for x in row["tp"]] == pairs
        assert (row["fp"], row["fn"]) == (false, missed)


def test_exact_match(spark):
    rows = spark.createDataFrame([(["a", "b", "b"], ["b", "c", "c"])], "g array<string>, p array<string>")
    row = rows.select(matching.match_exact("g", "p").alias("m")).select("m.*").first()
    assert (row["tp"], row["fp"], row["fn"]) == (["b"], ["c"], ["a"])


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_span_choice_against_model(spark, longest):
    rng = random.Random(longest)
    cases = []
    for _ in range(80):
        every = {(rng.randint(1, 14), rng.randint(1, longest)) for _ in range(rng.randint(0, 16))}
        cases.append(sorted(every))
    rows = spark.createDataFrame(
        [(i, [list(s) for s in c]) for i, c in enumerate(cases)], "i int, s array<struct<start:int,len:int>>"
    )
    got = rows.select("i", matching.choose_spans("s").alias("k")).orderBy("i").collect()
    assert [[tuple(s) for s in r["k"]] for r in got] == [models.spans(c) for c in cases]


def test_normalise_list(spark):
    got = column(spark, [[" A ", "", "b"], None], "array<string>", scalars.normalise_list(F.col("v")))
    assert [g[0] for g in got] == [["a", "b"], []]


def test_clean_text_with_and_without_links(spark):
    """Signs, runs of white space of every kind, and links next to texts that have none."""
    from pyspark.sql import functions as F

    from reliefgrid.functions.text import WORD, clean_text

    texts = ["a\t\tb", " a  b ", "a  b c", "x y", "a.b, c!d", "é://u v", "see http://x.y/z,now", "@me hi_there", "a\n b\r\nc", "...", "", " ", "(a) [b]  {c}\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    marked = F.regexp_replace("text", rf"(?U)(#[A-Za-z0-9_]+)|@[A-Za-z0-9_]+|(?:(?<![{WORD}])|\G)[{WORD}]++://\S+|[^{WORD}\s,]", "$1 ")
    plain = F.trim(F.regexp_replace(marked, r"(?U)\s+", " "))
    for row in rows.select("text", clean_text("text").alias("got"), plain.alias("wanted")).collect():
        assert row["got"] == row["wanted"], row
