"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger keeps which
blob was scanned under which version of which rule, and what was found. A run scans only the
pairs that the ledger lacks, the texts of one id for each blob however many paths hold it, and
findings are joined back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.session import cut

# The patterns of the three kinds and the least lengths of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that must have ``least`` characters, and texts one of which any match needs."""

    kind: str
    version: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


# Under version 1 ledgers may hold wrong places of texts in repeated rows, so those are scanned again.
RULES = (
    Rule("assign", "1.1", ASSIGN, 2, 6, (":", "=")),
    Rule("access", "1.1", ACCESS, 0, 20, ("AKIA",)),
    Rule("hex", "1.1", HEX, 0, 24),
)
_SCANS = "blob binary, kind string, version string, run string"
_FOUND = "blob binary, kind string, version string, run string, begin long, end long"


def _ledger(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A part of the ledger; empty before the first run."""
    frame = spark.createDataFrame([], schema)
    frame.write.mode("append").parquet(f"{path}/{part}")
    return spark.read.schema(schema).parquet(f"{path}/{part}")


def _needed(rule: Rule) -> Column:
    cond = F.array_contains("kinds", rule.kind)
    if rule.needs:
        some = F.lit(False)
        for text in rule.needs:
            some = some | F.contains("text", F.lit(text))
        cond = cond & some
    return cond


def _matches(todo: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, kind, begin, end`` of all matches; offsets are code points, the end exclusive.

    A text splits at its matches, so the lengths of pieces and matches, summed in order, give
    every place.
    """
    empty = F.array().cast("array<string>")
    raw = todo.select("blob", "text", *[
        F.when(_needed(r), F.expr(f"regexp_extract_all(text, {_quoted(r.pattern)}, 0)")).otherwise(empty).alias(r.kind) for r in rules
    ])
    some = F.lit(False)
    for r in rules:
        some = some | (F.size(r.kind) > 0)
    raw = raw.where(some)
    each = F.filter(F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.col(r.kind).alias("found"),
                 F.when(F.size(r.kind) > 0, F.split("text", r.pattern)).otherwise(empty).alias("pieces")) for r in rules
    ]), lambda x: F.size(x["found"]) > 0)
    kinds = raw.select("blob", F.explode(each).alias("k")).select(
        "blob", "k.kind", F.posexplode(F.arrays_zip("k.found", "k.pieces")).alias("i", "m"))
    # Repeated rows of a blob give the same matches; each counts once, so that the sum below adds no peers.
    kinds = kinds.where(F.col("m.found").isNotNull()).select(
        "blob", "kind", "i", F.col("m.found").alias("found"), F.length("m.pieces").cast("long").alias("gap"), F.length("m.found").cast("long").alias("size")).distinct()
    before = Window.partitionBy("blob", "kind").orderBy("i")
    placed = kinds.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("begin", F.col("end") - F.col("size"))
    fine = F.lit(False)
    for r in rules:
        fine = fine | ((F.col("kind") == r.kind) & (F.length(F.regexp_extract("found", r.pattern, r.group)) >= r.least))
    return placed.where(fine).select("blob", "kind", "begin", "end")


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Brings the ledger up to date and returns ``blob, kind, begin, end`` of the current rules.

    Nulls count as empty texts. Findings are written before the scans that vouch for them, so a
    run that is broken off is repeated as a whole and leaves nothing that is read.
    """
    spark = docs.sparkSession
    texts = _addressed(docs, id_col, text_col)
    scans = _ledger(spark, ledger, "scans", _SCANS)
    _ledger(spark, ledger, "found", _FOUND)
    blobs = texts.groupBy("blob").agg(F.min("key").alias("key"))
    pairs = blobs.select("blob", "key", F.explode(F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("r")).select("blob", "key", "r.*")
    unseen = cut(pairs.join(scans, ["blob", "kind", "version"], "left_anti").groupBy("blob", "key").agg(F.sort_array(F.collect_set("kind")).alias("kinds")))
    todo = texts.join(unseen, ["blob", "key"]).select("blob", "text", "kinds")
    run = uuid.uuid4().hex
    versions = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    new = _matches(todo, rules)
    new.select("blob", "kind", versions[F.col("kind")].alias("version"), F.lit(run).alias("run"), "begin", "end").write.mode("append").parquet(f"{ledger}/found")
    unseen.select("blob", F.explode("kinds").alias("kind")).select(
        "blob", "kind", versions[F.col("kind")].alias("version"), F.lit(run).alias("run")).write.mode("append").parquet(f"{ledger}/scans")

    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    scans = spark.read.schema(_SCANS).parquet(f"{ledger}/scans").where(current)
    found = spark.read.schema(_FOUND).parquet(f"{ledger}/found").where(current)
    return found.join(scans, ["blob", "kind", "version", "run"], "left_semi").select("blob", "kind", "begin", "end")


def _addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-1).cast("long"))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


def secrets(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``spans``: ``begin, kind number, kind, end`` of its secrets, in order.

    A null text is empty and has none. Rows without id and repeated rows are returned each;
    further columns are ignored.
    """
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    found = scan(docs, ledger, rules, id_col, text_col)
    by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        "begin", number[F.col("kind")].alias("number"), "kind", "end"))).alias("spans")).withColumnRenamed("blob", "_blob")
    paths = _addressed(docs, id_col, text_col).select("id", "blob")
    none = F.array().cast("array<struct<begin:bigint,number:int,kind:string,end:bigint>>")
    return paths.join(by_blob, F.col("blob") == F.col("_blob"), "left").select(
        F.col("id").alias(id_col), F.hex("blob").alias("blob"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in angle brackets; other texts stay as they are."""
    found = scan(docs, ledger, rules, id_col, text_col)
    by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "kind"))).alias("_spans")).withColumnRenamed("blob", "_blob")
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(by_blob, F.unhex(F.sha2(text, 256)) == F.col("_blob"), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        # A span inside what is already gone adds no second mark.
        gap = F.substring(F.col(text_col), (state["at"] + 1).cast("int"), F.greatest(s["begin"] - state["at"], F.lit(0)).cast("int"))
        mark = F.concat(F.lit("<"), s["kind"], F.lit(">"))
        new = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(gap, mark)).alias("parts"))
        return F.when(s["end"] <= state["at"], state).otherwise(new)

    def finish(state: Column) -> Column:
        rest = F.substring(F.col(text_col), (state["at"] + 1).cast("int"), F.length(text_col))
        return F.concat(F.array_join(state["parts"], ""), rest)

    clean = F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", start, step, finish)).otherwise(F.col(text_col))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
