"""Lookups inside the row: filters, dictionaries, long phrases, span choice and counted hashes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reliefgrid.functions import matching, packed
from reliefgrid.operators import bitfilter, posts, tagging

import models


def test_filter_misses_nothing(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    for most in (packed.MOST_BITS, 64):
        made = packed.make_filter(keys, F.xxhash64("k"), most)
        probes = spark.range(6000).select("id", made.holds(F.xxhash64(F.concat(F.lit("k"), "id"))).alias("hit"))
        hits = {r.id for r in probes.where("hit").collect()}
        assert set(range(3000)) <= hits
        if most > 64:
            assert len(hits) < 3600
    empty = packed.make_filter(keys.limit(0), F.xxhash64("k"))
    assert spark.range(50).where(empty.holds(F.xxhash64("id"))).count() == 0


@pytest.mark.parametrize("part", [1 << 14, 37])
def test_dictionary_in_parts(spark, part):
    rows = [(f"w{i}", i, None if i % 5 == 0 else f"v{i}") for i in range(200)] + [(None, 1, "x"), ("quo\"te\\ é\n", 7, "ü")]
    table = packed.make_dictionary(spark.createDataFrame(rows, "word string, n long, v string"), "word", ["n", "v"], part)
    assert len(table.parts) == max(1, -(-201 // part))
    asked = spark.createDataFrame([(r[0],) for r in rows] + [("none",), ("",)], "q string")
    got = {r.q: (None if r.e is None else (r.e.n, r.e.v)) for r in asked.select("q", table.find(F.col("q")).alias("e")).collect()}
    assert got == {**{r[0]: r[1:] for r in rows if r[0]}, None: None, "none": None, "": None}
    nothing = packed.make_dictionary(spark.createDataFrame([], "word string, n long"), "word", ["n"], part)
    assert asked.where(nothing.find(F.col("q")).isNotNull()).count() == 0


def test_counted_hashes_let_single_rows_pass(spark):
    rows = [(i, f"t{i % 700}") for i in range(1000)] + [(5000, None), (4000, None), (1, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r.id, r.text or "~") for r in posts.keep_first(df, ["text"], ["id"]).collect())
    want = {}
    for i, t in rows:
        want[t] = min(i, want.get(t, i))
    assert got == sorted((i, t or "~") for t, i in want.items())
    marked = bitfilter.marked(df, F.xxhash64("text"), bitfilter.bit_filter(df.limit(0).select(F.xxhash64("text").alias("h")), "h"), "m")
    assert marked.where("m").count() == 0 and marked.count() == len(rows)
    plan = posts.keep_first(df, ["text"], ["id"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def _plain_tags(words, taxonomy):
    spans = {}
    for name, synonym in taxonomy:
        phrase = synonym.lower().split()
        for i in range(len(words) - len(phrase) + 1):
            if phrase and words[i] in (phrase[0], phrase[0] + "s") and all(t in (w, w + "s") for t, w in zip(words[i:i + len(phrase)], phrase)):
                key = (i + 1, len(phrase))
                spans[key] = min(name, spans.get(key, name))
    return list(dict.fromkeys(spans[s] for s in models.spans(list(spans))))


def test_long_phrases_and_a_large_taxonomy(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choice(vocabulary) for _ in range(3000))
    middle = " ".join(long.split()[:20])
    taxonomy = [("Long", long), ("Middle", middle), ("Short", "w1 w2"), ("Short", ""), ("Alpha", "w1 w2"), ("One", "w3")]
    taxonomy += [(f"N{i}", f"w{i % 40} x{i}") for i in range(600)]
    texts = [" ".join(rng.choice(vocabulary + [f"x{rng.randint(0, 600)}", "w1 w2s", "w3s"]) for _ in range(30)) for _ in range(60)]
    texts += [long, "a " + long + " w3", middle + " w9", " ".join(long.split()[:2999]), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, cleaned string")
    table = spark.createDataFrame(taxonomy, "canonical string, synonym string")
    got = {r.id: r.disasters for r in tagging.tag_disasters_joined(rows, table, "id").collect()}
    assert got == {i: _plain_tags((t or "").split(), taxonomy) for i, t in enumerate(texts)}
    none = tagging.tag_disasters_joined(rows, table.limit(0), "id").collect()
    assert all(r.disasters == [] for r in none)


def test_span_choice_takes_time_in_proportion(spark):
    def seconds(n):
        # Chains of overlapping spans of three lengths: each sweep takes every other start.
        spans = [(i, size) for i in range(1, n // 3 + 1) for size in (1, 2, 3)]
        rows = spark.createDataFrame([(spans,)], "s array<struct<start:int,len:int>>").cache()
        rows.count()
        begun = time.perf_counter()
        kept = rows.select(matching.choose_spans("s").alias("k")).first().k
        assert [k.start for k in kept[:3]] == [1, 4, 7] and all(k.len == 3 for k in kept[:-1])
        return time.perf_counter() - begun

    seconds(300)
    small, large = min(seconds(10_000) for _ in range(2)), min(seconds(20_000) for _ in range(2))
    assert large < 3.5 * small + 0.3


def test_state_files_told_apart(spark, tmp_path):
    from reliefgrid.sources.probe import load_states, probe_files

    expected = {"state": ("string", ""), "count": ("long", 0), "city": ("string", "none")}
    root = tmp_path / "states"
    root.mkdir()
    (root / "good.csv").write_text('state,count,extra\n"Ohio, East",3,x\nTexas,,y\n\n')
    (root / "blank.csv").write_text("state,count\nTexas,NaN\nOhio,\n")
    (root / "bom.csv").write_text("﻿state,count,city\nOhio,1,Lima\n")
    (root / "only_head.csv").write_text("state,count,city\n")
    (root / "headless.csv").write_text("Ohio,3,Lima\nTexas,4,Waco\n")
    (root / "tabs.csv").write_text("state\tcount\tcity\nOhio\t3\tLima\n")
    (root / "pipes.csv").write_text("state|count\nOhio|3\n")
    (root / "zero.csv").write_bytes(b"")
    (root / "white.csv").write_text("\n  \n")
    (root / "binary.csv").write_bytes(bytes(range(256)) * 4)
    (root / "latin.csv").write_bytes("state,count\nKöln,3\n".encode("latin-1"))
    (root / "other.csv").write_text("state,count\nnot asked for,1\n")
    names = ["good.csv", "blank.csv", "bom.csv", "only_head.csv", "headless.csv", "tabs.csv", "pipes.csv", "zero.csv", "white.csv", "binary.csv", "latin.csv", "gone.csv"]
    found = {r["name"]: r for r in probe_files(spark, str(root), names, expected).collect()}
    assert {n: r.status for n, r in found.items()} == {
        "good.csv": "good", "blank.csv": "good", "bom.csv": "good", "only_head.csv": "good", "headless.csv": "headerless", "tabs.csv": "wrong_delimiter",
        "pipes.csv": "wrong_delimiter", "zero.csv": "empty", "white.csv": "empty", "binary.csv": "binary", "latin.csv": "binary", "gone.csv": "missing"}
    assert (found["good.csv"].row_count, found["good.csv"].missing_columns, found["good.csv"].empty_columns, found["good.csv"].start_over) == (2, ["city"], [], False)
    assert (found["blank.csv"].empty_columns, found["blank.csv"].missing_columns) == (["count"], ["city"])
    assert found["bom.csv"].missing_columns == [] and found["only_head.csv"].start_over and found["headless.csv"].start_over
    rows, report = load_states(spark, str(root), names, expected)
    got = sorted((r.state_file, r.state, r["count"], r.city) for r in rows.collect() if r.state_file == "good.csv")
    assert got == [("good.csv", "Ohio, East", "3", "none"), ("good.csv", "Texas", None, "none")]
    assert report.where("start_over").count() == 9
