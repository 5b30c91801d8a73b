"""From decoded commits to posts, and the filters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reliefgrid.functions.scalars import one_line, post_uri, post_url
from reliefgrid.operators.bitfilter import bit_filter, marked
from reliefgrid.operators.joins import lookup_join
from reliefgrid.session import cut

# Record and embed type names of the feed.
POST_TYPE = "app.bsky.feed.post"
IMAGE_EMBED = "app.bsky.embed.images"
LINK_EMBED = "app.bsky.embed.external"


def has_images(record: Column) -> Column:
    kind = record["embed"]["type"]
    shown = (kind == IMAGE_EMBED) | ((kind == LINK_EMBED) & record["embed"]["thumb"].isNotNull())
    return F.coalesce(shown, F.lit(False))


def reply_to(record: Column) -> Column:
    return record["reply"]["parent"]["uri"]


def create_records(commits: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per created post: every post record for every matching operation of a commit.

    ``first_only`` keeps the first post record per operation, as the live feed does.
    """
    ops = commits.select("repo", F.explode("ops").alias("op"), "records").where(
        (F.col("op.action") == "create") & F.col("op.path").startswith(POST_TYPE + "/")
    )
    wanted = F.filter("records", lambda r: r["type"] == POST_TYPE)
    if first_only:
        wanted = F.slice(wanted, 1, 1)
    return ops.select("repo", "op", F.explode(wanted).alias("record"))


def flatten_post(records: DataFrame) -> DataFrame:
    record = F.col("record")
    return records.select(
        F.coalesce(record["text"], F.lit("")).alias("text"),
        F.coalesce(record["createdAt"], F.lit("")).alias("created_at"),
        F.col("repo").alias("author"),
        post_uri("repo", "op.path").alias("uri"),
        has_images(record).alias("has_images"),
        reply_to(record).alias("reply_to"),
    )


def resolve_author(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """Replace the author id by its first known handle; unknown ids stay.

    ``handles`` holds ``did`` and ``also_known_as``, one row per id.
    """
    named = handles.select(
        F.col("did").alias("author"),
        F.substring_index(F.get("also_known_as", F.lit(0)), "at://", -1).alias("handle"),
    )
    joined = lookup_join(posts, named, "author")
    return joined.withColumn("author", F.coalesce("handle", "author")).drop("handle")


def filter_keyword(posts: DataFrame, keyword: str | None, column: str = "text") -> DataFrame:
    """Case-insensitive substring filter; no keyword keeps all."""
    if not keyword:
        return posts
    return posts.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(keyword))))


def filter_nonempty(posts: DataFrame, column: str = "text") -> DataFrame:
    return posts.where(F.length(column) > 0)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``.

    Hashes are counted first, and a filter of bounded size marks the rows whose hash occurs more
    than once. All others stand alone and pass without a shuffle. The marked ones are grouped by
    the whole key, with map-side combine, so copies of a popular text collapse before the shuffle;
    equal hashes of different keys only cost a few rows more.
    """
    hashed = F.xxhash64(*keys)
    counted = df.select(hashed.alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = marked(df, hashed, bit_filter(counted, "h"), "_again")
    alone = rows.where(~F.col("_again")).select(df.columns)
    return alone.union(_first_of_group(rows.where("_again").select(df.columns), keys, order))


def _first_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    grouped = df.groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(first.alias("_first"))
    return grouped.select(*keys, "_first.*").select(df.columns)


def dedup_text(posts: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(posts, ["text"], order)


def number_rows(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from one, over all rows, without a window over the whole table.

    The partition number and the place inside the partition are fixed by writing them out;
    the offsets come from one count per partition. ``order`` sorts first (end it with a
    unique column, so that no partition holds more than its share).
    """
    base = df.orderBy(*order) if order else df
    placed = cut(
        base.withColumn("_part", F.spark_partition_id()).withColumn(
            "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One small row per partition, so neither this window nor the broadcast grows with the rows.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_at") + 1)
        .select(name, *df.columns)
    )


def export_posts(posts: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows of the per-post CSV: number, link, one-line text and a text for missing replies."""
    numbered = number_rows(posts, "_id", order)
    # Header names.
    return numbered.select(
        F.col("_id").alias("Post ID"),
        F.col("author").alias("Author"),
        one_line("text").alias("Text"),
        F.col("created_at").alias("Created At"),
        F.col("uri").alias("URI"),
        post_url("author", "uri").alias("URL"),
        F.col("has_images").alias("Has Images"),
        F.coalesce(F.nullif("reply_to", F.lit("")), F.lit("N/A")).alias("Reply To"),
    )


def write_posts_csv(posts: DataFrame, path: str, order: list[str] | None = None) -> None:
    export_posts(posts, order).write.csv(path, header=True, quote='"', escape='"')


def bounded_batch(posts: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """At most ``limit`` posts of a pull, the earliest first."""
    return posts.orderBy(*order).limit(limit)
