import pytest

from reliefgrid.operators import counts
from reliefgrid.sources import readers, snapshots, taxonomy
from reliefgrid.sources.taxonomy import DISASTER_SYNONYMS
from reliefgrid.streaming import crisis

SCHEMA = "country string, state string, disasters string, city string, polarity double"


def rows(seed):
    return [("US", f"S{(i * seed) % 5}", f"D{i % 3}", f"C{(i * 7) % 4}" if i % 5 else None, ((i * 37 * seed) % 2001 - 1000) / 1000) for i in range(80)]


def shown(df):
    return sorted(tuple(map(str, r)) for r in df.select("country", "state", "disasters", "count", "avg_sentiment", "cities").collect())


def test_stream_equals_batch_and_survives_repeats(spark, tmp_path):
    feed, root, check = (str(tmp_path / n) for n in ("feed", "root", "check"))
    everything = []
    for seed in (1, 2, 3, 4):
        everything += rows(seed)
        spark.createDataFrame(rows(seed), SCHEMA).coalesce(1).write.mode("append").json(feed)
        stream = crisis.read_feed(spark, feed, SCHEMA, files_per_batch=1)
        crisis.run_available(stream, crisis.partials_sink(root), check)
    want = shown(counts.crisis_counts(spark.createDataFrame(everything, SCHEMA)))
    assert snapshots.versions(spark, root, "batch") == [0, 1, 2, 3]
    assert shown(crisis.running_counts(spark, root)) == want

    # The same batch number again replaces its rows.
    crisis.partials_sink(root)(spark.createDataFrame(rows(4), SCHEMA), 3)
    assert shown(crisis.running_counts(spark, root)) == want

    assert crisis.compact(spark, root) == 3
    assert shown(crisis.running_counts(spark, root)) == want
    crisis.partials_sink(root)(spark.createDataFrame(rows(5), SCHEMA), 4)
    want = shown(counts.crisis_counts(spark.createDataFrame(everything + rows(5), SCHEMA)))
    assert shown(crisis.running_counts(spark, root)) == want
    crisis.compact(spark, root)
    assert shown(crisis.running_counts(spark, root)) == want


def test_halving_average(spark, tmp_path):
    root = str(tmp_path / "root")
    sink = crisis.partials_sink(root)
    for number, value in enumerate((0.1, 0.3, -0.2)):
        sink(spark.createDataFrame([("US", "S", "D", "C", value)], SCHEMA), number)
    halved = crisis.running_counts_halving(spark, root).first()
    exact = crisis.running_counts(spark, root).first()
    assert (halved["count"], halved["avg_sentiment"]) == (3, 0.0)
    assert exact["avg_sentiment"] == 0.07


def test_dedup_in_batches_and_across(spark, tmp_path):
    feed, out, check = (str(tmp_path / n) for n in ("feed", "out", "check"))
    schema = "text string, created_at string"
    for part in ([("a", "2024-01-01T00:00:00"), ("a", "2024-01-01T00:00:01")], [("a", "2024-01-01T00:00:02"), ("b", "2024-01-01T00:00:03")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(feed)
    stream = crisis.read_feed(spark, feed, schema, files_per_batch=1)
    crisis.run_available(stream, crisis.dedup_batches(["created_at"], crisis.rows_sink(out)), check)
    assert sorted(r["text"] for r in crisis.read_rows(spark, out).collect()) == ["a", "a", "b"]
    seen = []
    unique = crisis.dedup_stream(crisis.read_feed(spark, feed, schema, 1), "created_at", "1 hour")
    crisis.run_available(unique, crisis.for_each_batch(lambda df: seen.extend(r["text"] for r in df.collect())), check + "2")
    assert sorted(seen) == ["a", "b"]


def test_live_loop_equals_one_batch(spark, tmp_path):
    from reliefgrid.operators import tagging
    from reliefgrid.plans import pipeline
    from reliefgrid.sources.states import us_states
    from test_pipeline import PLACES, SMOKE
    from test_places import GAZ

    feed, posts_root, counts_root = (str(tmp_path / n) for n in ("feed", "posts", "counts"))
    schema = "post_id int, author string, created_at string, text string, uri string"
    posts = [(i, "me", "2025", t, f"at://x/{i}") for i, (t, _) in enumerate(SMOKE)]
    dicts = pipeline.Dictionaries(
        phrases=tagging.phrase_table(DISASTER_SYNONYMS),
        gazetteer=spark.createDataFrame(PLACES, GAZ),
        states=us_states(spark),
        lexicon=spark.createDataFrame([("huge", 0.4, 0.9)], "word string, polarity double, subjectivity double"),
    )
    for part in (posts[:4], posts[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(feed)
    crisis.run_available(
        crisis.read_feed(spark, feed, schema, 1), crisis.live_sink(dicts, posts_root, counts_root), str(tmp_path / "check")
    )
    whole = pipeline.filtered_posts(spark.createDataFrame(posts, schema), dicts)
    key = ["post_id", "city", "state", "location", "polarity"]
    stored = crisis.read_rows(spark, posts_root).select(key).collect()
    assert sorted(map(str, stored)) == sorted(map(str, whole.select(key).collect()))
    assert shown(crisis.running_counts(spark, counts_root)) == shown(pipeline.crisis_summary(whole))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.read_snapshot(spark, root) is None
    assert snapshots.write_snapshot(spark.range(2).where("id > 5"), root) is None
    assert snapshots.write_snapshot(spark.range(2), root) == 1
    bigger = snapshots.read_snapshot(spark, root).union(spark.range(3))
    assert snapshots.write_snapshot(bigger, root) == 2
    assert snapshots.read_snapshot(spark, root).count() == 5


def test_taxonomy_file(spark, tmp_path):
    import json

    path = tmp_path / "types.json"
    path.write_text(json.dumps({"disasters": DISASTER_SYNONYMS}, indent=2))
    got = taxonomy.read_taxonomy(spark, str(path)).collect()
    assert len(got) == 46 and len({r["canonical"] for r in got}) == 12
    assert sum(r["canonical"] == "Flood" for r in got) == 8


def test_readers(spark, tmp_path):
    line = ["1", "Xville", "Xville", "x,  y", "1.5", "-2.5", "P", "PPL", "NA", "", "OH", "", "", "", "10", "", "7", "UTC", "2025-01-01"]
    (tmp_path / "g.txt").write_text("\t".join(line) + "\n" + "\t".join(["2", "None"] + [""] * 17) + "\n")
    got = readers.read_gazetteer(spark, str(tmp_path / "g.txt")).orderBy("geonameid").collect()
    assert got[0]["alternate_list"] == ["x", "  y"] and got[0]["countryCode"] is None and got[0]["population"] == 10
    assert got[1]["name"] is None and got[1]["alternate_list"] == [""]

    (tmp_path / "d.csv").write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    schema = "a string, b string, c string"
    kept = readers.read_complete_rows(spark, str(tmp_path / "d.csv"), schema).collect()
    assert sorted(map(tuple, kept)) == [("1", "2", "3"), ("6", "7", "8")]
    padded = readers.read_padded_rows(spark, str(tmp_path / "d.csv"), schema).collect()
    assert sorted(map(tuple, padded)) == [("1", "2", "3"), ("4", "5", ""), ("6", "7", "8")]

    (tmp_path / "q.csv").write_text('a,b\n"line one\nsays ""hi""",2\n')
    assert [tuple(r) for r in readers.read_quoted_csv(spark, str(tmp_path / "q.csv"), "a string, b int").collect()] == [('line one\nsays "hi"', 2)]

    (tmp_path / "l.tsv").write_bytes(b"id\ttext\n1\tcaf\xff\n")
    assert readers.read_labels(spark, str(tmp_path / "l.tsv"), "id string, text string").first()["text"] == "caf\ufffd"

    for name, body in (("one", '[{"tweet_id": 1, "tweet_text": "a"}]'), ("two", '[{"tweet_id": 2, "extra": 5}]')):
        (tmp_path / f"{name}.json").write_text(body)
    union = readers.read_json_archives(spark, str(tmp_path / "*.json"))
    assert union.count() == 2 and set(union.columns) == {"tweet_id", "tweet_text", "extra"}


@pytest.mark.parametrize("name", ["first", "second"])
def test_shared_dir_is_stable(spark, name):
    from reliefgrid.session import scratch_path, shared_dir

    assert scratch_path(spark, name).startswith(shared_dir(spark))


def test_running_counts_before_the_first_batch(spark, tmp_path):
    assert crisis.running_counts(spark, str(tmp_path / "nothing")).collect() == []


def test_lenient_rows_keep_a_long_row_with_an_empty_last_field(spark, tmp_path):
    from reliefgrid.sources.readers import read_complete_rows

    (tmp_path / "x.csv").write_text('1,2,3\n4,5\n6,7,8,9\n6,7,,9\n1,2,\n"a,b",c\n"a,b",c,,d\n')
    rows = read_complete_rows(spark, str(tmp_path / "x.csv"), "a string, b string, c string", header=False).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("6", "7", "8"), ("6", "7", None), ("1", "2", None), ("a,b", "c", None)]


def test_windows_drop_state_and_late_rows(spark, tmp_path):
    from reliefgrid.streaming import windows

    feed, out, check = (str(tmp_path / n) for n in ("feed", "out", "check"))
    schema = "ts timestamp, kind string, value double"

    def deliver(*rows):
        from datetime import datetime

        data = [(datetime.fromisoformat(t) if t else None, k, v) for t, k, v in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = crisis.read_table_feed(spark, feed, schema, "*.parquet")
        return windows.append_windows(windows.window_counts(stream, "ts", "1 hour", "2 hours", ["kind"], "value"), out, check)

    deliver(("2024-01-01 00:10:00", "a", 0.25), ("2024-01-01 00:50:00", "a", 0.5), ("2024-01-01 05:00:00", "b", None), (None, "a", 1.0))
    # The first window has ended and its state is gone; the next row of it is late. Half past three is not.
    reports = deliver(("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 03:30:00", "a", 1.0), ("2024-01-01 09:00:00", "b", 1.0))
    dropped = sum(op["numRowsDroppedByWatermark"] for p in reports for op in p["stateOperators"])
    assert dropped == 1
    assert reports[-1]["stateOperators"][0]["numRowsTotal"] == 1
    got = sorted((r.window_start.hour, r.kind, r["count"], r.units) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", 2, 750000), (3, "a", 1, 1000000), (5, "b", 1, None)]
    # Started again without new input, nothing is emitted twice.
    deliver()
    assert spark.read.parquet(out).count() == 3


def test_windows_of_a_table(spark):
    from reliefgrid.streaming import windows

    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:10:00', 1), (TIMESTAMP'2024-01-01 00:50:00', 1), (TIMESTAMP'2024-01-01 03:00:00', 1) AS t(ts, k)")
    sliding = windows.window_counts(rows, "ts", "2 hours", "1 hour", slide="1 hour")
    assert sorted((r.window_start.hour, r["count"]) for r in sliding.collect()) == [(0, 2), (2, 1), (3, 1), (23, 2)]
    sessions = windows.session_counts(rows, "ts", "1 hour", "1 hour", ["k"])
    assert sorted((r.window_start.hour, r.window_end.minute, r["count"]) for r in sessions.collect()) == [(0, 50, 2), (3, 0, 1)]


def test_store_shows_all_tables_of_a_batch_or_none(spark, tmp_path):
    from reliefgrid.streaming.store import Store

    tables = {"left": "x int", "right": "y string"}
    store = Store(spark, str(tmp_path / "store"), tables)
    assert store.read("left").collect() == [] and store.fold("left", lambda df: df) is None
    one, two = spark.range(3).selectExpr("int(id) as x", "'s' as more"), spark.sql("SELECT 'a' AS y")

    class Broken(Store):
        def _append(self, name, rows, number, attempt):
            if name == "right":
                raise RuntimeError("lost")
            super()._append(name, rows, number, attempt)

    with pytest.raises(RuntimeError):
        Broken(spark, str(tmp_path / "store"), tables).commit(0, {"left": one, "right": two})
    assert store.read("left").count() == 0 and not store.holds(0)
    assert store.commit(0, {"left": one, "right": two})
    assert not store.commit(0, {"left": one, "right": two})
    again = Store(spark, str(tmp_path / "store"), tables)
    assert (again.read("left").count(), again.read("right").count()) == (3, 1)
    total = lambda df: df.groupBy().agg({"x": "sum"}).selectExpr("int(`sum(x)`) as x")
    assert again.fold("left", total) == 0
    assert [r.x for r in again.read("left").collect()] == [3]
    again.commit(1, {"left": one})
    assert sorted(r.x for r in again.read("left").collect()) == [0, 1, 2, 3]
    assert again.fold("left", total) == 1 and [r.x for r in again.read("left").collect()] == [6]


def test_live_loop_knows_posts_by_their_links(spark, tmp_path):
    from reliefgrid.operators import tagging
    from reliefgrid.plans import pipeline
    from reliefgrid.sources.states import us_states
    from test_pipeline import PLACES, SMOKE
    from test_places import GAZ

    feed, check = str(tmp_path / "feed"), str(tmp_path / "check")
    schema = "author string, created_at string, text string, uri string"
    posts = [("me", "2025", t, f"at://x/{i}") for i, (t, _) in enumerate(SMOKE)]
    dicts = pipeline.Dictionaries(
        phrases=tagging.phrase_table(DISASTER_SYNONYMS), gazetteer=spark.createDataFrame(PLACES, GAZ), states=us_states(spark),
        lexicon=spark.createDataFrame([("huge", 0.4, 0.9)], "word string, polarity double, subjectivity double"))
    store = crisis.live_store(spark, str(tmp_path / "live"))
    assert crisis.live_counts(store).collect() == []
    handle = crisis.live_batch(dicts, store)
    for part in (posts[:4], posts[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(feed)
        crisis.run_available(crisis.read_feed(spark, feed, schema, 1), handle, check)
    # A batch that comes again changes nothing.
    handle(spark.createDataFrame(posts[4:], schema), 1)
    whole = pipeline.filtered_posts(spark.createDataFrame(posts, schema), dicts, "uri")
    key = ["uri", "city", "state", "location", "polarity"]
    assert sorted(map(str, store.read("posts").select(key).collect())) == sorted(map(str, whole.select(key).collect()))
    assert shown(crisis.live_counts(store)) == shown(pipeline.crisis_summary(whole))
    crisis.fold_counts(store)
    assert shown(crisis.live_counts(store)) == shown(pipeline.crisis_summary(whole))


def test_live_store_holds_a_text_once_and_drops_scratch(spark, tmp_path):
    from pathlib import Path

    from reliefgrid.operators import tagging
    from reliefgrid.plans import pipeline
    from reliefgrid.session import shared_dir
    from reliefgrid.sources.states import us_states
    from reliefgrid.streaming.store import Store
    from test_places import GAZ
    from test_pipeline import PLACES

    texts = ["Flood in Houston, Texas, then Phoenix and Los Angeles.", "A huge Flood in Mexico City.", "Flood nowhere", "Nice day in Houston"]
    posts = spark.createDataFrame([("me", "2025", t, f"at://x/{i}") for i, t in enumerate(texts)], "author string, created_at string, text string, uri string")
    dicts = pipeline.Dictionaries(
        phrases=tagging.phrase_table(DISASTER_SYNONYMS), gazetteer=spark.createDataFrame(PLACES, GAZ), states=us_states(spark),
        lexicon=spark.createDataFrame([("huge", 0.4, 0.9)], "word string, polarity double, subjectivity double"))
    whole = sorted(map(str, pipeline.filtered_posts(posts, dicts, "uri").collect()))
    root = str(tmp_path / "live")
    store = crisis.live_store(spark, root)
    scratch_tables = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("table-*"))
    before = scratch_tables()
    crisis.live_batch(dicts, store)(posts, 0)
    assert scratch_tables() == before
    # A post of several places is one stored row, and as many rows for a reader.
    stored = spark.read.parquet(f"{root}/posts")
    assert sorted(r.uri for r in stored.collect()) == ["at://x/0", "at://x/1"]
    assert sorted(map(str, store.read("posts").drop("_batch").collect())) == whole and len(whole) > 2
    assert {r._batch for r in store.read("posts").collect()} == {0}
    # Rows of another layout are refused, not read as nulls.
    with pytest.raises(ValueError, match="other columns"):
        Store(spark, root, {"posts": "uri string, city string"})


def test_keyed_state_over_a_restart_and_its_expiry(spark, tmp_path):
    from datetime import datetime

    from reliefgrid.streaming import keyed
    from reliefgrid.streaming.store import Store

    schema = SCHEMA + ", ts timestamp"
    feed = str(tmp_path / "feed")
    exact = Store(spark, str(tmp_path / "exact"), {"totals": keyed.TOTALS})
    halving = Store(spark, str(tmp_path / "halving"), {"levels": keyed.LEVELS})
    fading = Store(spark, str(tmp_path / "fading"), {"levels": keyed.LEVELS})
    days = {0: "2024-01-01", 1: "2024-01-02", 2: "2024-03-01", 3: "2024-03-02"}
    for number, value in enumerate((0.1, 0.3, -0.2, None)):
        place = "S" if number < 2 else "T"
        moment = datetime.fromisoformat(days[number])
        rows_here = [("US", place, "D", c, value, moment) for c in ("C", "E", "", None)] + [("US", None, "D", "C", 1.0, moment)]
        spark.createDataFrame(rows_here, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = crisis.read_table_feed(spark, feed, schema, "*.parquet")
        keyed.run_keyed(keyed.keyed_totals(stream), exact, "totals", str(tmp_path / "c1"))
        keyed.run_keyed(keyed.keyed_levels(stream), halving, "levels", str(tmp_path / "c2"))
        keyed.run_keyed(keyed.keyed_levels(stream, "ts", "1 day", "10 days"), fading, "levels", str(tmp_path / "c3"))
    found = {r.state: (r["count"], r.avg_sentiment, r.cities) for r in keyed.keyed_counts(exact).collect()}
    assert found == {"S": (8, 0.2, ["C", "E"]), "T": (8, -0.1, ["C", "E"])} or found == {"S": (8, 0.2, ["C", "E"]), "T": (8, -0.2, ["C", "E"])}
    levels = {r.state: (r["count"], r.avg_sentiment) for r in keyed.latest_levels(halving.read("levels")).collect()}
    assert levels == {"S": (8, 0.2), "T": (8, -0.2)}
    # Without rows for ten days behind the watermark, a group is gone.
    assert [r.state for r in keyed.latest_levels(fading.read("levels")).collect()] == ["T"]


def test_rows_before_the_first_batch(spark, tmp_path):
    assert crisis.read_rows(spark, str(tmp_path / "none")).collect() == []
    assert crisis.running_counts_halving(spark, str(tmp_path / "none")).collect() == []
