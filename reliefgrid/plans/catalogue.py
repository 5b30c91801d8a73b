"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions import scalars, text
from reliefgrid.functions.matching import match_exact, match_partial
from reliefgrid.operators import counts, evaluate, places, repair, tagging, views
from reliefgrid.operators import posts as post_ops
from reliefgrid.plans import bindings as b
from reliefgrid.plans import pipeline
from reliefgrid.session import cut, scratch_path
from reliefgrid.sources import probe, readers, schemas, snapshots, taxonomy
from reliefgrid.streaming import crisis, keyed
from reliefgrid.streaming import windows as windowing
from reliefgrid.streaming.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(items: Column | str) -> Column:
    return F.array_join(items, "|")


def resolved_columns(struct: str = "resolved") -> list[Column]:
    return [F.col(f"{struct}.{c}").alias(c) for c in places.RESOLVED_FIELDS]


def doc_dicts(spark: SparkSession, sf: str) -> pipeline.Dictionaries:
    return pipeline.Dictionaries(
        phrases=tagging.phrase_table(b.DOC_TAXONOMY),
        gazetteer=b.doc_gazetteer(spark, sf),
        states=b.states(spark, sf),
        lexicon=b.lexicon(spark),
        max_words=2,
    )


def cleaned_posts(spark: SparkSession, sf: str) -> DataFrame:
    return b.posts(spark, sf).select("post_id", text.clean_text("text").alias("cleaned"))


def show_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("cities", joined("cities"))


# --- sources and sinks -------------------------------------------------------------------


@query
def stream_posts(spark, sf):
    """Commits as a JSON feed, read as a stream, flattened and written batch by batch."""
    feed, out = scratch_path(spark, "feed"), scratch_path(spark, "posts")
    b.commits(spark, sf).write.json(feed)
    stream = crisis.read_feed(spark, feed, schemas.COMMIT, files_per_batch=4)
    flat = post_ops.flatten_post(post_ops.create_records(stream))
    crisis.run_available(flat, crisis.rows_sink(out), scratch_path(spark, "check"))
    return crisis.read_rows(spark, out).drop("batch")


@query
def bounded_batch(spark, sf):
    return post_ops.bounded_batch(b.posts(spark, sf).select("post_id", "author", "uri"), 50, ["post_id"])


@query
def scan_json_union(spark, sf):
    docs = b.table(spark, sf, "documents")
    base = scratch_path(spark, "archive")
    docs.where(F.col("lang") == "en").select("doc_id", "text", "source").write.json(f"{base}/a")
    docs.where(F.col("lang") != "en").select("doc_id", "text", "lang").write.json(f"{base}/b")
    schema = "doc_id long, text string, lang string, source string"
    return readers.read_json_archives(spark, f"{base}/*", schema, lines=True)


def _code() -> Column:
    return F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))


@query
def scan_gazetteer(spark, sf):
    c = b.table(spark, sf, "customer")
    path = scratch_path(spark, "places")
    blank = F.lit("")
    c.select(
        "c_custkey", "c_name", "c_name",
        F.concat_ws(",", F.lower("c_mktsegment"), F.upper("c_name")),
        F.col("c_custkey") / 8, F.col("c_custkey") / 4, F.lit("P"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise("PPL"),
        F.lit("US"), blank, _code(), blank, blank, blank,
        F.floor("c_acctbal").cast("long"), blank, F.lit(7), F.lit("UTC"), F.lit("2025-01-01"),
    ).toDF(*[f"c{i}" for i in range(19)]).write.csv(path, sep="\t", header=False)
    return readers.read_gazetteer(spark, path).withColumn("alternate_list", joined("alternate_list"))


@query
def scan_tsv_labels(spark, sf):
    path = scratch_path(spark, "labels")
    b.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "US").otherwise("NA").alias("country_code"), "toxic"
    ).write.csv(path, sep="\t", header=True)
    return readers.read_labels(spark, path, "doc_id long, country_code string, toxic int")


@query
def scan_csv_quoted(spark, sf):
    path = scratch_path(spark, "quoted")
    b.posts(spark, sf).select("post_id", "text", "author").write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, lineSep="\n"
    )
    return readers.read_quoted_csv(spark, path, "post_id long, text string, author string")


def _damaged_lines(spark: SparkSession, sf: str) -> str:
    """Rows of three fields, with one short and one long kind of row."""
    path = scratch_path(spark, "damaged")
    key, kind = F.col("p_partkey").cast("string"), F.col("p_type")
    b.table(spark, sf, "part").select(
        F.when(kind == "SMALL", F.concat_ws(",", key, "p_brand"))
        .when(kind == "LARGE", F.concat_ws(",", key, "p_brand", "p_type", "p_name"))
        .otherwise(F.concat_ws(",", key, "p_brand", "p_type"))
        .alias("value")
    ).write.text(path)
    return path


@query
def scan_csv_lenient(spark, sf):
    path = _damaged_lines(spark, sf)
    schema = "part string, brand string, kind string"
    complete = readers.read_complete_rows(spark, path, schema, header=False)
    padded = readers.read_padded_rows(spark, path, schema, header=False)
    return complete.withColumn("reader", F.lit("complete")).unionByName(padded.withColumn("reader", F.lit("padded")))


@query
def explode_taxonomy(spark, sf):
    path = scratch_path(spark, "taxonomy")
    # Many small maps of a type rather than one that holds all its names.
    few = F.pmod(F.xxhash64("p_name"), F.lit(1024))
    b.table(spark, sf, "part").groupBy("p_type", few).agg(F.collect_set("p_name").alias("names")).select(
        F.create_map("p_type", "names").alias("disasters")
    ).write.json(path)
    raw = spark.read.schema("disasters map<string,array<string>>").json(path)
    return taxonomy.explode_taxonomy(raw)


@query
def append_posts(spark, sf):
    """A store without coordinates takes a batch that has them; both sides are widened."""
    root = scratch_path(spark, "store")
    rows = b.report_posts(spark, sf).drop("batch").withColumn("post_id", F.col("post_id").cast("string"))
    old = rows.where(F.col("created_at") < "1998-01-01").drop("latitude", "longitude", "polarity")
    new = rows.where(F.col("created_at") >= "1998-01-01")
    for part in (old, new):
        snapshots.append_posts(repair.repair_schema(part, schemas.FILTERED_POST_DEFAULTS), root)
    return spark.read.parquet(root).select(
        "post_id", "author", "created_at", joined("disasters").alias("disasters"), "sentiment", "polarity",
        "city", "state", "country", "latitude", "longitude", "uri",
    )


@query
def write_counts_snapshot(spark, sf):
    root = scratch_path(spark, "counts")
    rows = b.single_reports(spark, sf)
    snapshots.write_snapshot(counts.crisis_counts(rows.where(F.col("created_at") < "1998-01-01")), root)
    previous = snapshots.read_snapshot(spark, root)
    merged = counts.merge_counts(previous, counts.crisis_counts(rows.where(F.col("created_at") >= "1998-01-01")))
    snapshots.write_snapshot(merged, root)
    return show_counts(snapshots.read_snapshot(spark, root))


@query
def post_export(spark, sf):
    posts = b.posts(spark, sf).withColumns(
        {
            "has_images": F.contains("text", F.lit("http")),
            "reply_to": F.when(F.col("created_at") == "de", F.lit("")).when(F.col("created_at") == "fr", F.col("uri")),
        }
    )
    return post_ops.export_posts(posts, ["post_id"])


@query
def state_quality_gate(spark, sf):
    rows = b.report_posts(spark, sf).drop("batch", "latitude", "longitude")
    rows = rows.withColumn("region", F.lit(None).cast("string"))
    gate = repair.quality_gate(rows, schemas.FILTERED_POST_DEFAULTS)
    return gate.withColumns(
        {"missing_columns": joined("missing_columns"), "empty_columns": joined("empty_columns")}
    )


@query
def state_file_gate(spark, sf):
    """Counts written as state files in good and bad ways; two of them are no such files at all."""
    root = scratch_path(spark, "states")
    rows = counts.crisis_counts(b.single_reports(spark, sf)).withColumn("cities", joined("cities"))
    rows = cut(rows.withColumn("region", F.lit(None).cast("string")))
    rows.write.csv(f"{root}/good", header=True)
    rows.drop("cities", "count").withColumn("avg_sentiment", F.lit(None).cast("double")).write.csv(f"{root}/thin", header=True)
    rows.write.csv(f"{root}/headerless", header=False)
    rows.write.csv(f"{root}/semicolon", header=True, sep=";")
    rows.write.parquet(f"{root}/binary")
    spark.range(1).select(F.lit(" ")).write.text(f"{root}/empty")
    names = ["good", "thin", "headerless", "semicolon", "binary", "empty", "missing"]
    found = probe.probe_files(spark, root, names, schemas.CRISIS_COUNT_DEFAULTS)
    return found.withColumns({c: joined(c) for c in ("missing_columns", "empty_columns")})


# --- projections and filters -------------------------------------------------------------


@query
def project_columns(spark, sf):
    return b.posts(spark, sf).select("post_id", "author", "text")


@query
def flatten_post(spark, sf):
    return post_ops.flatten_post(post_ops.create_records(b.commits(spark, sf)))


@query
def has_images(spark, sf):
    return flatten_post(spark, sf).select("uri", "text", "has_images")


@query
def reply_to(spark, sf):
    return flatten_post(spark, sf).select("uri", "text", "reply_to")


@query
def filter_creates(spark, sf):
    rows = post_ops.create_records(b.commits(spark, sf))
    first = post_ops.create_records(b.commits(spark, sf), first_only=True)

    def flat(df: DataFrame, form: str) -> DataFrame:
        return df.select("repo", F.col("op.path").alias("path"), "record.text", F.lit(form).alias("form"))

    return flat(rows, "all").unionByName(flat(first, "first"))


@query
def filter_keyword(spark, sf):
    return post_ops.filter_keyword(b.posts(spark, sf), "THAT THE").select("post_id", "text")


@query
def filter_nonempty(spark, sf):
    return post_ops.filter_nonempty(flatten_post(spark, sf)).select("uri", "text")


@query
def filter_crisis(spark, sf):
    lists = b.posts(spark, sf).select(
        "post_id",
        F.filter(F.split("text", " "), lambda w: w == "that").alias("disasters"),
        F.filter(F.split("text", " "), lambda w: w == "with").alias("locations"),
    )
    return pipeline.filter_crisis(lists).select(
        "post_id", F.size("disasters").alias("n_disasters"), F.size("locations").alias("n_locations")
    )


@query
def drop_null_state(spark, sf):
    return repair.drop_null_state(b.reports(spark, sf)).select("post_id", "state")


@query
def filter_polar(spark, sf):
    rows = b.reports(spark, sf).withColumn("sentiment", scalars.sentiment_class("polarity"))
    return rows.where(F.col("sentiment") != "Neutral").select("post_id", "sentiment", "polarity")


@query
def posts_by_state(spark, sf):
    return views.posts_by_state(b.reports(spark, sf), "NATION_7").select("post_id", "state", "city")


@query
def places_named_topk(spark, sf):
    towns = b.gazetteer(spark, sf).withColumn("name", F.get(F.split(F.get("alternate_list", F.lit(0)), " "), F.lit(0)))
    return places.places_named(towns, "Household").select(
        "name", "countryCode", "stateCode", "featureCode", "population", "geonameid"
    )


@query
def repair_schema(spark, sf):
    rows = b.report_posts(spark, sf).select("post_id", "author", "state", "disasters")
    fixed = repair.repair_schema(rows, schemas.FILTERED_POST_DEFAULTS)
    return fixed.withColumns({"disasters": joined("disasters"), "locations": joined("locations")})


@query
def coerce_numeric(spark, sf):
    """Numbers as text, some unreadable."""
    part = F.col("p_size").cast("string")
    kind = F.col("p_type")
    rows = b.table(spark, sf, "part").select(
        "p_partkey",
        F.when(kind == "SMALL", F.lit("n/a")).when(kind == "LARGE", F.concat(part, F.lit(".75"))).otherwise(part)
        .alias("count"),
        F.when(kind == "PROMO", F.lit(None).cast("string")).otherwise(F.concat(F.lit("-0."), part)).alias("avg_sentiment"),
        F.when(kind == "MEDIUM", F.col("p_name")).otherwise(F.concat(part, F.lit("e-1"))).alias("severity"),
    )
    return views.coerce_counts(rows)


@query
def default_entities(spark, sf):
    """Labels stand in for extraction results; documents without one take the defaults."""
    found = b.table(spark, sf, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, F.array(F.lit("Flood"))).alias("disasters"),
        F.when(F.col("quality") == 1, F.array(F.lit("Buffalo"), F.lit("Reno"))).alias("locations"),
        F.when(F.col("quality") == 1, F.lit("Positive")).alias("sentiment"),
        (F.col("quality") / 2).alias("polarity"),
    )
    rows = b.table(spark, sf, "documents").select("doc_id").join(found, "doc_id", "left")
    full = repair.fill_defaults(rows, repair.entity_defaults())
    return full.withColumns({"disasters": joined("disasters"), "locations": joined("locations")})


@query
def reject_rows(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "value")
    checks = {
        "k below ten": F.col("k").try_cast("int") >= 10,
        "value over two hundred": F.col("value") <= 200,
    }
    good, bad = repair.split_rejects(rows, checks)
    return good.withColumn("reason", F.lit("kept")).unionByName(bad).select("event_id", "reason")


# --- places ------------------------------------------------------------------------------


def _place_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "mention",
        F.col("place.geonameid").alias("geonameid"),
        F.col("place.name").alias("name"),
        F.col("place.featureCode").alias("feature"),
        *[F.col(c) for c in ("stage",) if c in df.columns],
    )


@query
def place_lookup_exact(spark, sf):
    return _place_columns(places.lookup_exact(b.mentions(spark, sf), b.gazetteer(spark, sf)))


@query
def place_lookup_cascade(spark, sf):
    return _place_columns(places.lookup_cascade(b.mentions(spark, sf), b.gazetteer(spark, sf), b.states(spark, sf)))


@query
def place_lookup_two_stage(spark, sf):
    # Names that repeat their alternates give the second stage something to find.
    gaz = b.gazetteer(spark, sf).withColumn(
        "alternate_list", F.concat("alternate_list", F.array(F.lower("name")))
    )
    wanted = b.mention_rows(spark, sf).select(
        F.when(F.contains("mention", F.lit("#")), F.expr("substring(mention, 4)")).otherwise(F.col("mention")).alias("mention")
    )
    return _place_columns(places.lookup_two_stage(wanted.distinct(), gaz))


@query
def place_lookup_fuzzy(spark, sf):
    return _place_columns(places.lookup_fuzzy(b.mentions(spark, sf), b.gazetteer(spark, sf)))


@query
def region_to_state(spark, sf):
    states = b.states(spark, sf)
    regions = b.mentions(spark, sf).select(text.title_case(F.trim("mention")).alias("region")).distinct()
    first = places.region_states(regions, states).select("region", F.col("hit.name").alias("state"))
    longest = places.region_states(regions, states, longest_match=True).select("region", F.col("hit.name").alias("longest"))
    return regions.join(first, "region", "left").join(longest, "region", "left")


@query
def decode_state(spark, sf):
    rows = b.gazetteer(spark, sf).select("geonameid", "stateCode")
    dim = b.states(spark, sf)
    kept = places.decode_state(rows, dim, "stateCode", "state_or_code", keep_unknown=True)
    return places.decode_state(kept, dim, "stateCode", "state", keep_unknown=False)


@query
def state_centroid(spark, sf):
    rows = b.reports(spark, sf).select("post_id", F.initcap("state").alias("state"))
    return places.state_centroid(rows, b.states(spark, sf))


@query
def city_coordinates(spark, sf):
    return views.city_coordinates(b.reports(spark, sf), ["created_at", "post_id"])


@query
def resolve_author(spark, sf):
    posts = flatten_post(spark, sf).select("author", "uri", "text")
    return post_ops.resolve_author(posts, b.handles(spark, sf))


@query
def place_in_context(spark, sf):
    """Alternates that customers of several nations share, each followed by the customer's own state."""
    cust, key = F.col("c_custkey"), F.col("c_nationkey")
    named = F.concat(F.lower("c_mktsegment"), F.lit(" "), (cust % 1000 % 40).cast("string"))
    gaz = b.gazetteer(spark, sf).withColumn(
        "alternate_list", F.transform("alternate_list", lambda a: F.concat(F.split(a, " ")[0], F.lit(" "), (F.col("geonameid") % 1000 % 40).cast("string"))))
    posts = b.table(spark, sf, "customer").select(
        cust.alias("post_id"), F.array(named, F.when(key % 3 == 0, F.concat(F.lit("nation_"), key.cast("string"))).otherwise(F.concat(F.lit("N"), key.cast("string"))), named).alias("locations"))
    done = places.resolve_all(posts, gaz, b.states(spark, sf), "post_id", "cascade", context=True)
    return done.select("post_id", "pos", "mention", *resolved_columns())


@query
def unresolved_mentions(spark, sf):
    found = b.mentions(spark, sf)
    return places.unresolved(found, places.lookup_exact(found, b.gazetteer(spark, sf))).select("mention")


@query
def best_match(spark, sf):
    rows = b.gazetteer(spark, sf).select("stateCode", places.place_struct())
    best = places.best_place(rows, "stateCode")
    return best.select("stateCode", "place.geonameid", "place.name", "place.population")


@query
def classify_place(spark, sf):
    """Every gazetteer record classified under its own name and under an unknown region."""
    rows = b.gazetteer(spark, sf).select(
        F.explode(F.array("name", F.concat(F.lit("upper "), F.lower("name")))).alias("mention"), places.place_struct()
    )
    done = places.classify_places(rows, b.states(spark, sf))
    return done.select(F.col("place.geonameid").alias("geonameid"), "mention", *resolved_columns())


@query
def enrich_first_place(spark, sf):
    rows = b.located_posts(spark, sf)
    done = places.enrich_first_place(rows, b.gazetteer(spark, sf), b.states(spark, sf))
    return done.withColumn("locations", joined("locations"))


@query
def resolve_all_places(spark, sf):
    done = places.resolve_all(b.located_posts(spark, sf), b.gazetteer(spark, sf), b.states(spark, sf), "post_id")
    listed = places.collect_places(done, "post_id")
    shown = F.transform(
        "all_locations",
        lambda p: F.concat_ws(
            "/", p["location"], F.coalesce(p["city"], F.lit("-")), F.coalesce(p["state"], F.lit("-")),
            F.coalesce(p["region"], F.lit("-")), F.coalesce(p["country"], F.lit("-")),
        ),
    )
    return listed.select("post_id", F.size("all_locations").alias("n"), joined(shown).alias("all_locations"))


@query
def standardize_places(spark, sf):
    done = places.standardize_places(b.located_posts(spark, sf), b.gazetteer(spark, sf), b.states(spark, sf), "post_id")
    rest = F.transform(F.coalesce("all_locations", F.array()), lambda p: F.concat_ws("/", p["location"], p["state"]))
    return done.withColumn("all_locations", joined(rest))


# --- tagging -----------------------------------------------------------------------------


@query
def tag_disasters(spark, sf):
    tagged = tagging.tag_disasters(cleaned_posts(spark, sf), tagging.phrase_table(b.DOC_TAXONOMY))
    return tagged.select("post_id", joined("disasters").alias("disasters"))


@query
def tag_disasters_joined(spark, sf):
    rows = [(name, phrase) for name, phrases in b.DOC_TAXONOMY.items() for phrase in phrases]
    taxonomy = spark.createDataFrame(rows, "canonical string, synonym string")
    tagged = tagging.tag_disasters_joined(cleaned_posts(spark, sf), taxonomy, "post_id")
    return tagged.select("post_id", joined("disasters").alias("disasters"))


@query
def tag_from_table(spark, sf):
    """Tags from a taxonomy that grows with the tables: long words of the passages, and pairs of words."""
    tagged = tagging.tag_disasters_joined(cleaned_posts(spark, sf), b.word_taxonomy(spark, sf), "post_id")
    return tagged.select("post_id", joined("disasters").alias("disasters"))


@query
def tag_places(spark, sf):
    names = tagging.place_names(b.doc_gazetteer(spark, sf))
    tagged = tagging.tag_places(cleaned_posts(spark, sf), names, "post_id", max_words=2)
    return tagged.select("post_id", joined("locations").alias("locations"))


@query
def pred_lists(spark, sf):
    labels = b.posts(spark, sf).select(F.col("post_id").alias("id"), F.col("post_id").alias("ord"), "text")
    names = tagging.place_names(b.doc_gazetteer(spark, sf))
    pred = evaluate.pred_lists(labels, names, max_words=2)
    return pred.select("id", "text", F.size("locations").alias("n"), joined("locations").alias("locations"))


@query
def lexicon_polarity(spark, sf):
    return tagging.lexicon_scores(cleaned_posts(spark, sf), b.lexicon(spark), "post_id")


@query
def extract_entities(spark, sf):
    done = pipeline.extract_entities(b.posts(spark, sf), doc_dicts(spark, sf))
    return done.withColumns({"disasters": joined("disasters"), "locations": joined("locations")})


@query
def filtered_posts(spark, sf):
    done = pipeline.filtered_posts(b.posts(spark, sf), doc_dicts(spark, sf))
    return done.withColumn("disasters", joined("disasters"))


@query
def distinct_mentions(spark, sf):
    words = F.split(text.clean_text("text"), " ")
    return b.posts(spark, sf).select("post_id", joined(F.array_distinct(words)).alias("mentions"))


# --- counts ------------------------------------------------------------------------------


@query
def crisis_counts(spark, sf):
    return show_counts(counts.severity(counts.crisis_counts(b.single_reports(spark, sf))))


@query
def first_disaster(spark, sf):
    rows = b.report_posts(spark, sf)
    rows = rows.withColumn("disasters", F.when(F.col("city").isNotNull(), F.col("disasters")))
    return counts.single_disaster(rows).select("post_id", "disasters")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = b.single_reports(spark, sf)
    return rows.where(F.col("created_at") < "1998-01-01"), rows.where(F.col("created_at") >= "1998-01-01")


@query
def merge_counts(spark, sf):
    old, new = _halves(spark, sf)
    merged = counts.merge_counts(counts.crisis_counts(old), counts.crisis_counts(new))
    return show_counts(counts.severity(merged))


@query
def merge_counts_exact(spark, sf):
    old, new = _halves(spark, sf)
    merged = counts.merge_partials(counts.count_partials(old), counts.count_partials(new))
    return show_counts(counts.finish_counts(merged))


@query
def running_mean_fold(spark, sf):
    rows = b.single_reports(spark, sf)
    parts = (
        rows.where(F.col("country").isNotNull() & F.col("state").isNotNull())
        .groupBy("country", "state", "disasters", "batch")
        .agg(F.count("*").alias("n"), F.sum(scalars.polarity_units("polarity")).alias("u"))
        .select(*counts.KEYS, "batch", counts.mean_polarity("u", "n").alias("avg_sentiment"))
    )
    return counts.running_mean(parts, counts.KEYS, fold=16)


@query
def severity(spark, sf):
    rows = b.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("count"))
    return counts.severity(rows)


@query
def counts_sorted(spark, sf):
    return show_counts(counts.sort_counts(counts.crisis_counts(b.single_reports(spark, sf))))


def _opinions(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.reports(spark, sf).select(
        "post_id",
        "country",
        "state",
        "city",
        "polarity",
        F.when(F.col("city") == "BUILDING", F.array("disaster", F.lit("Other")))
        .when(F.col("city").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("disaster"))
        .alias("disasters"),
        F.array_compact(F.array("state", "city")).alias("locations"),
    )
    return rows.withColumn("sentiment", scalars.sentiment_class("polarity"))


@query
def offline_counts(spark, sf):
    rows = _opinions(spark, sf).select("disasters", "locations", "sentiment", "polarity")
    return counts.severity(counts.offline_counts(rows), zero_guard=False)


@query
def offline_state_counts(spark, sf):
    return show_counts(counts.offline_state_counts(_opinions(spark, sf)))


@query
def explode_entities(spark, sf):
    rows = _opinions(spark, sf).select("post_id", "disasters", "locations")
    return counts.explode_entities(rows)


# --- views -------------------------------------------------------------------------------


def _snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return counts.severity(counts.crisis_counts(b.single_reports(spark, sf)))


@query
def state_chart(spark, sf):
    return views.state_chart(_snapshot(spark, sf))


@query
def kpi_stats(spark, sf):
    return views.kpi_stats(_snapshot(spark, sf))


@query
def map_markers(spark, sf):
    """Cities seen only in some states have coordinates; other rows fall back to the state."""
    rows = b.single_reports(spark, sf)
    known = rows.where((F.col("city") != "BUILDING") & (F.col("longitude") > 0) & (F.col("country") != "ASIA"))
    coords = views.city_coordinates(known, ["created_at", "post_id"])
    dim = b.states(spark, sf).withColumn("code", F.upper("name")).where(F.col("ord") != 8)
    return views.map_markers(_snapshot(spark, sf), coords, dim)


@query
def state_list(spark, sf):
    return views.state_list(_snapshot(spark, sf))


@query
def sentiment_counts(spark, sf):
    return views.sentiment_counts(_opinions(spark, sf))


@query
def polarity_stats(spark, sf):
    return views.polarity_stats(b.reports(spark, sf))


@query
def polarity_histogram(spark, sf):
    return views.polarity_histogram(b.reports(spark, sf))


@query
def posts_table(spark, sf):
    rows = b.report_posts(spark, sf).withColumns(
        {"text": F.concat_ws(" ", "author", "created_at"), "sentiment": scalars.sentiment_class("polarity")}
    )
    return views.posts_table(rows, "NATION_3")


# --- evaluation --------------------------------------------------------------------------


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gold_lists(b.turn_labels(spark, sf, "user"))


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gold_lists(b.turn_labels(spark, sf, "assistant"))


@query
def gold_lists(spark, sf):
    return _gold(spark, sf).select("id", "text", joined("locations").alias("locations"))


@query
def gold_pred_outer(spark, sf):
    done = evaluate.compare_lists(_gold(spark, sf), _pred(spark, sf), partial=False)
    return done.select("id", "text", joined("gold").alias("gold"), joined("pred").alias("pred"))


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    done = evaluate.compare_lists(_gold(spark, sf), _pred(spark, sf), partial=False)
    return done.select("id", "gold", "pred")


@query
def match_exact_lists(spark, sf):
    return _lists(spark, sf).select("id", match_exact("gold", "pred").alias("m")).select(
        "id", *[joined(f"m.{c}").alias(c) for c in ("tp", "fp", "fn")]
    )


@query
def match_partial_lists(spark, sf):
    rows = _lists(spark, sf).select("id", match_partial("gold", "pred").alias("m"))
    pairs = F.transform("m.tp", lambda p: F.concat_ws("~", p["gold"], p["pred"]))
    return rows.select("id", joined(pairs).alias("tp"), joined("m.fp").alias("fp"), joined("m.fn").alias("fn"))


@query
def extraction_scores(spark, sf):
    return evaluate.extraction_scores(evaluate.compare_lists(_gold(spark, sf), _pred(spark, sf)))


@query
def error_samples(spark, sf):
    done = evaluate.compare_lists(_gold(spark, sf), _pred(spark, sf), partial=False)
    return evaluate.error_samples(done, n=20).select("id", joined("fp").alias("fp"), joined("fn").alias("fn"))


@query
def normalise_lists(spark, sf):
    raw = F.filter(F.split("text", r"\n"), lambda x: F.length(x) > 0)
    lines = F.when(F.col("role") != "system", F.concat(raw, F.array(F.lit(""), F.lit(" Ab "))))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", joined(scalars.normalise_list(lines)).alias("items")
    )


# --- dedup and set operations ------------------------------------------------------------


@query
def dedup_first(spark, sf):
    return post_ops.dedup_text(b.posts(spark, sf), ["post_id"])


@query
def dedup_id(spark, sf):
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return post_ops.keep_first(rows, ["conv_id"], ["turn"])


@query
def union_posts(spark, sf):
    docs = b.posts(spark, sf).select("post_id", "text", "author")
    turns = b.table(spark, sf, "conversations").select(F.col("conv_id").alias("post_id"), "text", "role")
    return repair.union_posts(docs, turns)


@query
def union_aligned(spark, sf):
    rows = b.report_posts(spark, sf).withColumn("post_id", F.col("post_id").cast("string"))
    old = rows.select("post_id", "author", "disasters", "state")
    new = rows.select("post_id", "author", "city", "polarity", "latitude")
    both = repair.union_aligned(old, new, schemas.FILTERED_POST_DEFAULTS)
    return both.withColumns({"disasters": joined("disasters"), "locations": joined("locations")})


# --- scalar functions --------------------------------------------------------------------


@query
def clean_text(spark, sf):
    return cleaned_posts(spark, sf)


@query
def split_camel(spark, sf):
    return b.table(spark, sf, "part").select(
        "p_partkey",
        text.split_camel(F.replace(F.initcap(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), F.lit(""))).alias("words"),
    )


@query
def preprocess_text(spark, sf):
    return tagging.preprocess_topics(b.posts(spark, sf), b.STOP_WORDS, "post_id", b.lemmas(spark))


@query
def sentiment_class(spark, sf):
    return b.reports(spark, sf).select("post_id", scalars.sentiment_class("polarity").alias("sentiment"))


@query
def strip_possessive(spark, sf):
    raw = F.concat(F.lit("# "), "c_name", F.when(F.col("c_acctbal") > 5000, F.lit("'s")).otherwise(F.lit("’s")), F.lit(" #"))
    return b.table(spark, sf, "customer").select("c_custkey", text.strip_possessive(raw).alias("mention"))


@query
def title_case(spark, sf):
    return b.posts(spark, sf).select("post_id", text.title_case("text").alias("title"))


@query
def post_url(spark, sf):
    return b.posts(spark, sf).select("post_id", "uri", scalars.post_url("author", "uri").alias("url"))


@query
def split_alternates(spark, sf):
    names = F.when(F.col("c_acctbal") > 0, F.concat_ws(",", "c_name", "c_mktsegment"))
    parts = scalars.split_alternates(names)
    return b.table(spark, sf, "customer").select("c_custkey", F.size(parts).alias("n"), joined(parts).alias("names"))


@query
def parse_list_literal(spark, sf):
    name = F.when(F.col("p_type") == "SMALL", F.lit("Coeur d'Alene")).otherwise(F.col("p_name"))
    items = F.when(F.col("p_type") != "LARGE", F.array(name, "p_brand"))
    literal = F.when(F.col("p_type") == "PROMO", F.lit("broken [")).otherwise(scalars.list_literal(items))
    rows = b.table(spark, sf, "part").select("p_partkey", literal.alias("t"))
    return rows.select(
        "p_partkey",
        joined(scalars.parse_list_literal("t")).alias("items"),
        joined(scalars.parse_list_literal("t", keep_apostrophes=True)).alias("all_items"),
    )


@query
def degree_distance(spark, sf):
    rows = b.reports(spark, sf)
    return rows.select(
        "post_id",
        scalars.degree_distance(F.col("latitude"), F.col("longitude"), F.lit(10.5), F.lit(-20.25)).alias("degrees"),
    )


@query
def entities_json(spark, sf):
    rows = b.report_posts(spark, sf)
    made = F.to_json(F.struct("post_id", "disasters", "city", "state"))
    back = F.from_json(made, "post_id long, disasters array<string>, city string, state string")
    return rows.select("post_id", made.alias("json"), back["state"].alias("state"))


@query
def parse_created_at(spark, sf):
    """The four time forms of the feed, and text that is none."""
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    form = (
        F.when(F.col("event_type") == "view", F.concat(base, F.lit("Z")))
        .when(F.col("event_type") == "click", F.concat(micro, F.lit("Z")))
        .when(F.col("event_type") == "purchase", F.concat(base, F.lit("+00:00")))
        .when(F.col("event_type") == "signup", F.concat(micro, F.lit("+02:00")))
        .otherwise(F.concat(F.lit("x"), base))
    )
    return b.table(spark, sf, "events").select(
        "event_id", scalars.iso_utc(scalars.parse_created_at(form)).alias("created_at")
    )


# --- streams -----------------------------------------------------------------------------

def _order_reports(batch: DataFrame) -> DataFrame:
    """Order rows of a micro-batch as reports, without a join."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return batch.select(
        F.when(F.col("o_orderstatus") != "P", F.lit("US")).alias("country"),
        F.concat(F.lit("State "), F.month("o_orderdate").cast("string")).alias("state"),
        F.col("o_orderpriority").alias("disasters"),
        F.concat(F.lit("City "), (F.col("o_custkey") % 20).cast("string")).alias("city"),
        (((cents % 2001) - 1000) / 1000).alias("polarity"),
    )


def _order_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as Parquet files, read two at a time."""
    path = scratch_path(spark, "orders")
    orders = b.table(spark, sf, "orders")
    orders.repartition(8).write.parquet(path)
    return crisis.read_table_feed(spark, path, b.TABLES["orders"], "*.parquet", files_per_batch=2)


@query
def stream_crisis_counts(spark, sf):
    root = scratch_path(spark, "state")
    handle = crisis.partials_sink(root, _order_reports)
    crisis.run_available(_order_feed(spark, sf), handle, scratch_path(spark, "check"))
    return show_counts(crisis.running_counts(spark, root))


@query
def stream_merge(spark, sf):
    """Two runs over one feed with a compaction between; the second resumes the first."""
    root, check = scratch_path(spark, "state"), scratch_path(spark, "check")
    path = scratch_path(spark, "orders")
    orders = b.table(spark, sf, "orders")
    handle = crisis.partials_sink(root, _order_reports)
    for part in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"):
        orders.where(part).write.mode("append").parquet(path)
        feed = crisis.read_table_feed(spark, path, b.TABLES["orders"], "*.parquet", files_per_batch=1)
        crisis.run_available(feed, handle, check)
        crisis.compact(spark, root)
    return show_counts(crisis.running_counts(spark, root))


@query
def stream_dedup(spark, sf):
    """Copies of a document go inside the batch; the feed comes as one batch."""
    out = scratch_path(spark, "unique")
    feed = crisis.read_table_feed(spark, sf, b.TABLES["documents"], "documents.parquet")
    handle = crisis.dedup_batches(["doc_id"], crisis.rows_sink(out))
    crisis.run_available(feed, handle, scratch_path(spark, "check"))
    return crisis.read_rows(spark, out).drop("batch")


def _window_query(spark: SparkSession, sf: str, windows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events delivered part by part, some of them late; every part is a run that resumes the one before."""
    feed, out, check = (scratch_path(spark, n) for n in ("feed", "windows", "check"))
    events = b.table(spark, sf, "events")
    day = F.unix_date(F.col("ts").cast("date"))
    first, last = events.agg(F.min(day), F.max(day)).head()
    if first is None:
        first = last = 0
    age = day - F.lit(first)
    late = (F.col("event_id") % 10 == 0) & (age < 5)
    final = max(2, (last - first) // 10)
    part = F.when(late, F.lit(final)).otherwise(F.floor(age / 10))
    for number in range(final + 1):
        events.where(part == number).write.mode("append").parquet(feed)
        stream = crisis.read_table_feed(spark, feed, b.TABLES["events"], "*.parquet")
        windowing.append_windows(windows(stream), out, check)
    return spark.read.parquet(out)


@query
def windowed_counts(spark, sf):
    """Six-hour windows by kind of event."""
    return _window_query(spark, sf, lambda s: windowing.window_counts(s, "ts", "6 hours", "2 days", ["event_type"], "value"))


@query
def sliding_counts(spark, sf):
    """Windows of a day that begin every twelve hours."""
    return _window_query(spark, sf, lambda s: windowing.window_counts(s, "ts", "24 hours", "2 days", value="value", slide="12 hours"))


@query
def session_counts(spark, sf):
    """Sessions of a user, apart by two hours without any event."""
    return _window_query(spark, sf, lambda s: windowing.session_counts(s, "ts", "2 hours", "2 days", ["user_id"], "value"))


@query
def live_loop(spark, sf):
    """Posts of the feed, which have links and no other id, through tagging, place lookup, store and counts.

    Two runs, the second one resuming the first after the counts were folded. Each group of the
    running counts comes with the number of its stored posts.
    """
    feed, check = scratch_path(spark, "feed"), scratch_path(spark, "check")
    store = crisis.live_store(spark, scratch_path(spark, "live"))
    posts = b.posts(spark, sf).drop("post_id")
    dicts = doc_dicts(spark, sf)
    schema = "author string, created_at string, text string, uri string"
    # Copies of a text have one length and meet in one run.
    for part in (0, 1):
        posts.where(F.length("text") % 2 == part).write.mode("append").parquet(feed)
        stream = crisis.read_table_feed(spark, feed, schema, "*.parquet")
        crisis.run_available(stream, crisis.live_batch(dicts, store), check)
        crisis.fold_counts(store)
    stored = counts.single_disaster(store.read("posts")).groupBy(*counts.KEYS).agg(F.count("*").alias("stored"))
    return show_counts(crisis.live_counts(store).join(stored, counts.KEYS, "left"))


@query
def stream_dedup_across(spark, sf):
    """Copies of a text in either of two deliveries go, as the watermark is not past them."""
    feed, check, out = (scratch_path(spark, n) for n in ("feed", "check", "unique"))
    docs = b.table(spark, sf, "documents")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(feed)
        stream = crisis.read_table_feed(spark, feed, b.TABLES["documents"], "*.parquet")
        timed = stream.select("text", F.timestamp_seconds("doc_id").alias("moment"))
        crisis.run_available(crisis.dedup_stream(timed, "moment", "10000 days"), crisis.rows_sink(out), check)
    return crisis.read_rows(spark, out).select("text")


@query
def batch_callback(spark, sf):
    """A user's own function sees every batch of posts; here it stores links of one line each."""
    path, out = scratch_path(spark, "commits"), scratch_path(spark, "seen")
    b.commits(spark, sf).write.json(path)
    stream = crisis.read_feed(spark, path, schemas.COMMIT)

    def callback(batch: DataFrame) -> None:
        rows = post_ops.flatten_post(post_ops.create_records(batch))
        rows.select("uri", scalars.one_line("text").alias("line")).write.mode("append").parquet(out)

    crisis.run_available(stream, crisis.for_each_batch(callback), scratch_path(spark, "check"))
    return spark.read.parquet(out)


@query
def merge_fresh_start(spark, sf):
    """Running counts without a previous state, with an empty one, and with an empty batch."""
    rows = cut(counts.crisis_counts(b.single_reports(spark, sf)))
    none = rows.where("false")
    made = {
        "absent": counts.merge_counts(snapshots.read_snapshot(spark, scratch_path(spark, "none")), rows),
        "empty": counts.merge_counts(none, rows),
        "no_batch": counts.merge_counts(rows, none),
        "nothing": counts.merge_counts(none, none),
    }
    parts = [df.withColumn("start", F.lit(name)) for name, df in made.items()]
    return show_counts(repair.union_posts(*parts))


def _two_runs(spark: SparkSession, sf: str, handle: Callable[[DataFrame], None]) -> None:
    """Orders in two deliveries; ``handle`` works off what is there after each."""
    path = scratch_path(spark, "orders")
    orders = b.table(spark, sf, "orders")
    for part in (F.col("o_orderstatus") == "F", F.col("o_orderstatus") != "F"):
        orders.where(part).write.mode("append").parquet(path)
        handle(crisis.read_table_feed(spark, path, b.TABLES["orders"], "*.parquet"))


@query
def stream_keyed_counts(spark, sf):
    """Exact running counts from the stream's own state, over a restart."""
    store, check = Store(spark, scratch_path(spark, "keyed"), {"totals": keyed.TOTALS}), scratch_path(spark, "check")
    _two_runs(spark, sf, lambda feed: keyed.run_keyed(keyed.keyed_totals(_order_reports(feed)), store, "totals", check))
    return show_counts(keyed.keyed_counts(store))


@query
def stream_keyed_means(spark, sf):
    """The halving average from the stream's own state, over a restart."""
    store, check = Store(spark, scratch_path(spark, "keyed"), {"levels": keyed.LEVELS}), scratch_path(spark, "check")
    _two_runs(spark, sf, lambda feed: keyed.run_keyed(keyed.keyed_levels(_order_reports(feed)), store, "levels", check))
    return keyed.latest_levels(store.read("levels"))


QUERIES["match_exact"] = QUERIES.pop("match_exact_lists")
QUERIES["match_partial"] = QUERIES.pop("match_partial_lists")
