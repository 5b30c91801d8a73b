"""Dictionary tagging of disasters and places, lexicon sentiment, and the model hook."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.functions.columns import bind
from reliefgrid.functions.matching import choose_spans
from reliefgrid.functions.packed import make_dictionary, make_filter
from reliefgrid.functions.scalars import POLARITY_SCALE, polarity_units
from reliefgrid.functions.text import WORD, clean_text, strip_possessive, tokens, topic_words
from reliefgrid.operators.joins import lookup_join
from reliefgrid.session import cut

# Phrase lists up to this size travel inside the expression; larger ones are joined.
MAX_INLINE_PHRASES = 5_000


def phrase_table(synonyms: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Normalised phrase to canonical name; every word may carry a plural ``s``.

    Words are lower-cased and freed from signs as the text is, so that a hyphenated
    synonym meets its cleaned form. The first canonical name wins for a shared phrase.
    """
    table: dict[str, str] = {}
    for canonical, phrases in synonyms.items():
        for phrase in phrases:
            words = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in phrase).lower().split()
            for ends in itertools.product(("", "s"), repeat=len(words)):
                table.setdefault(" ".join(w + e for w, e in zip(words, ends)), canonical)
    if len(table) > MAX_INLINE_PHRASES:
        raise ValueError("phrase list too large to inline; use tag_disasters_joined")
    return table


def disaster_names(cleaned: Column | str, phrases: Mapping[str, str]) -> Column:
    """Canonical names of the phrases in a cleaned text, in text order, each once.

    One expression inside the row, without any shuffle. Only positions whose word starts
    some phrase are looked at further; intermediate lists are bound once.
    """
    by_len: dict[int, list[str]] = {}
    for phrase in phrases:
        by_len.setdefault(phrase.count(" ") + 1, []).append(phrase)
    first_words = sorted({p.split(" ")[0] for p in phrases})
    canonical = F.from_json(F.lit(json.dumps(dict(phrases))), "map<string,string>")

    def gram(words: Column, start: Column, n: Column | int) -> Column:
        return F.get(words, start - 1) if isinstance(n, int) and n == 1 else F.array_join(F.slice(words, start, n), " ")

    def starts(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(first_words), (i + 1).cast("int")))
        return F.array_compact(marked)

    def spans(words: Column, at: Column) -> Column:
        def of_length(n: int) -> Column:
            fits = F.filter(at, lambda i: (i + n - 1 <= F.size(words)) & gram(words, i, n).isin(by_len[n]))
            return F.transform(fits, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len")))

        return F.concat(*[of_length(n) for n in sorted(by_len)])

    def names(words: Column) -> Column:
        kept = bind(starts(words), lambda at: choose_spans(spans(words, at)))
        return F.transform(kept, lambda s: F.element_at(canonical, gram(words, s["start"], s["len"])))

    return F.array_distinct(bind(F.transform(tokens(cleaned), F.lower), names))


def tag_disasters(posts: DataFrame, phrases: Mapping[str, str], cleaned: str = "cleaned") -> DataFrame:
    """Add ``disasters`` to posts with a cleaned text."""
    return posts.withColumn("disasters", disaster_names(cleaned, phrases))


def taxonomy_phrases(taxonomy: DataFrame) -> DataFrame:
    """``(canonical, stem, phrase)``, one row per phrase, with its first name, of ``(canonical, synonym)`` rows.

    ``phrase`` holds the words as ``phrase_table`` cuts them; ``stem`` joins them without any
    final ``s``, so that a phrase and its plurals meet under one key.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace("synonym", rf"[^{WORD}]", " ")), " +"), lambda w: w != "")
    rows = taxonomy.select("canonical", words.alias("phrase")).where(F.size("phrase") > 0)
    return rows.groupBy(_stem(F.col("phrase")).alias("stem"), "phrase").agg(F.min("canonical").alias("canonical"))


def _stem(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.rtrim(w, F.lit("s"))), " ")


# Words of a phrase that are looked for in every text; the rest of longer ones is checked where those stand.
LEAD_WORDS = 16


def tag_disasters_joined(posts: DataFrame, taxonomy: DataFrame, key: str, cleaned: str = "cleaned") -> DataFrame:
    """Add ``disasters`` from ``(canonical, synonym)`` rows of any number and length; ``key`` names each post.

    Two filters of bounded size go through the texts inside the row: one of the words that open a
    phrase, one of the phrases' leading words. Only runs that pass both become rows; they meet
    the phrases by stem, then each word must be that of the phrase or its plural. A phrase of more
    than ``LEAD_WORDS`` words looks at the rest of a text only where its leading words stand. Of
    names that share a phrase the first in order counts. The tags are those that
    ``tag_disasters`` gives for a small taxonomy.
    """
    lead = F.slice("phrase", F.lit(1), F.lit(LEAD_WORDS))
    phrases = cut(taxonomy_phrases(taxonomy).withColumn("lead", _stem(lead)).withColumn("lead_len", F.size(lead)))
    heads = make_filter(phrases, F.xxhash64(F.rtrim(F.get("phrase", F.lit(0)), F.lit("s"))))
    leads = make_filter(phrases, F.xxhash64("lead"))
    # At most LEAD_WORDS numbers.
    sizes = sorted(r[0] for r in phrases.select("lead_len").distinct().collect())

    def runs(words: Column) -> Column:
        opening = F.array_compact(F.transform(words, lambda w, i: F.when(heads.holds(F.xxhash64(F.rtrim(w, F.lit("s")))), i + 1)))

        def of_size(at: Column, n: int) -> Column:
            def stem(i: Column) -> Column:
                return F.rtrim(F.get(words, i - 1), F.lit("s")) if n == 1 else _stem(F.slice(words, i, n))

            fits = F.filter(at, lambda i: (i + n - 1 <= F.size(words)) & leads.holds(F.xxhash64(stem(i))))
            return F.transform(fits, lambda i: F.struct(i.cast("int").alias("start"), F.slice(words, i, n).alias("run")))

        return bind(opening, lambda at: F.concat(*[of_size(at, n) for n in sizes]))

    lowered = F.transform(tokens(cleaned), F.lower)
    if not sizes:
        return posts.withColumn("disasters", F.when(F.lit(True), F.array().cast("array<string>")))
    hits = posts.select(key, F.explode(bind(lowered, runs)).alias("r")).select(key, "r.start", "r.run", _stem(F.col("r.run")).alias("lead"))

    def alike(words: Column, phrase: Column) -> Column:
        return F.forall(F.zip_with(words, phrase, lambda t, w: F.coalesce((t == w) | (t == F.concat(w, F.lit("s"))), F.lit(False))), lambda x: x)

    named = lookup_join(hits, phrases, "lead", "inner").where(
        (F.size("run") == F.col("lead_len")) & alike(F.col("run"), F.slice("phrase", F.lit(1), F.lit(LEAD_WORDS))))
    short = named.where(F.size("phrase") <= LEAD_WORDS)
    open_ones = named.where(F.size("phrase") > LEAD_WORDS).select(key, "start", "phrase", "canonical")
    words = posts.select(key, lowered.alias("_words"))
    rest = F.slice("_words", F.col("start"), F.size("phrase"))
    long = open_ones.join(words, key).where((F.size(rest) == F.size("phrase")) & alike(rest, F.col("phrase")))
    every = short.select(key, "start", F.size("phrase").alias("len"), "canonical").union(long.select(key, "start", F.size("phrase"), "canonical"))
    spans = every.groupBy(key, "start", "len").agg(F.min("canonical").alias("name")).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "len", "name"))).alias("_spans"))
    kept = F.transform(choose_spans("_spans"), lambda s: s["name"])
    tagged = spans.select(key, F.array_distinct(kept).alias("disasters"))
    none = F.array().cast("array<string>")
    return posts.join(tagged, key, "left").withColumn("disasters", F.coalesce("disasters", none))


def place_names(gazetteer: DataFrame) -> DataFrame:
    """Distinct normalised names and alternates with their length in words."""
    every = F.concat(
        F.array(F.lower(F.trim("name"))), F.transform("alternate_list", lambda a: F.lower(F.trim(a)))
    )
    names = gazetteer.select(F.explode(F.filter(every, lambda x: x != "")).alias("gram"))
    spaced = F.regexp_replace("gram", r"\s+", " ")
    return (
        names.select(spaced.alias("gram"))
        .distinct()
        .select("gram", (F.size(F.split("gram", " "))).alias("words"))
    )


def place_runs(words: Column, names: DataFrame, max_words: int, capitalised: bool) -> Column:
    """``start, len, mention`` of the runs of a text's words that are likely names, inside the row.

    A filter of the names' first words tells where runs are tried at all, a filter of the names
    which of them stay; both are of bounded size.
    """
    heads = make_filter(names, F.xxhash64(F.substring_index("gram", " ", 1)))
    grams = make_filter(names, F.xxhash64("gram"))

    def runs(given: Column) -> Column:
        def of_size(at: Column, n: int) -> Column:
            def text(i: Column) -> Column:
                return F.get(given, i - 1) if n == 1 else F.array_join(F.slice(given, i, n), " ")

            fits = F.filter(at, lambda i: (i + n - 1 <= F.size(given)) & grams.holds(F.xxhash64(F.lower(text(i)))))
            return F.transform(fits, lambda i: F.struct(i.cast("int").alias("start"), F.lit(n).alias("len"), text(i).alias("mention")))

        def is_open(w: Column) -> Column:
            likely = heads.holds(F.xxhash64(F.lower(w)))
            return likely & F.rlike(w, F.lit(r"^\p{Lu}")) if capitalised else likely

        opening = F.array_compact(F.transform(given, lambda w, i: F.when(is_open(w), i + 1)))
        return bind(opening, lambda at: F.concat(*[of_size(at, n) for n in range(1, max_words + 1)]))

    return bind(words, runs)


def tag_places(
    posts: DataFrame,
    names: DataFrame,
    key: str,
    max_words: int = 3,
    cleaned: str = "cleaned",
    capitalised: bool = False,
    distinct: bool = True,
) -> DataFrame:
    """``(key, locations)`` for posts with at least one place mention, in text order.

    Texts are read once, whatever the size of the name table: only runs that are likely names
    leave the row, and an equality join with the names keeps the true ones.
    ``distinct=False`` keeps repeated mentions.
    """
    known = known_names(names, max_words)
    rows = posts.select(key, F.explode(likely_places(known, max_words, cleaned, capitalised)).alias("r")).select(key, "r.*")
    return choose_places(rows, known, key, distinct)


def known_names(names: DataFrame, max_words: int) -> DataFrame:
    """The names of at most so many words, written out."""
    return cut(names.where(F.col("words") <= max_words).select("gram").distinct())


def likely_places(known: DataFrame, max_words: int, cleaned: str = "cleaned", capitalised: bool = False) -> Column:
    """``start, len, mention`` of the runs of a cleaned text that are likely among the known names."""
    return place_runs(tokens(cleaned), known, max_words, capitalised)


def choose_places(rows: DataFrame, known: DataFrame, key: str, distinct: bool = True) -> DataFrame:
    """``(key, locations)`` of posts with a known name among their runs, ``(key, start, len, mention)``, in text order."""
    # Two-letter codes count as places only in capitals.
    upper_code = (F.length("mention") != 2) | (F.upper("mention") == F.col("mention"))
    likely = rows.where(upper_code & ~F.contains("mention", F.lit(","))).withColumn("gram", F.lower("mention"))
    spans = lookup_join(likely, known, "gram", "inner").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("start", "len", "mention"))).alias("_spans")
    )
    kept = spans.withColumn("_kept", choose_spans("_spans"))
    mentions = F.transform("_kept", lambda s: strip_possessive(s["mention"]))
    return kept.select(key, (F.array_distinct(mentions) if distinct else mentions).alias("locations"))


def polarity_columns(words: Column, lexicon: DataFrame) -> list[Column]:
    """``polarity`` and ``subjectivity`` of an array of lower-case words, inside the row."""
    units = lexicon.select("word", polarity_units("polarity").alias("p"), polarity_units("subjectivity").alias("s"))
    weights = make_dictionary(units, "word", ["p", "s"])
    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(x) for x in ("p", "pn", "s", "sn")])

    def add(acc: Column, row: Column) -> Column:
        return F.struct(*[x for name in ("p", "s") for x in (
            (acc[name] + F.coalesce(row[name], zero)).alias(name), (acc[f"{name}n"] + row[name].isNotNull().cast("long")).alias(f"{name}n"))])

    def mean(total: Column, name: str) -> Column:
        return F.when(total[f"{name}n"] > 0, total[name] / (total[f"{name}n"] * F.lit(POLARITY_SCALE))).otherwise(F.lit(0.0))

    means = bind(
        F.coalesce(weights.sums(words, start, add), start),
        lambda t: F.struct(mean(t, "p").alias("polarity"), mean(t, "s").alias("subjectivity")))
    return [means.alias("_means")]


def add_scores(posts: DataFrame, lexicon: DataFrame, cleaned: str = "cleaned") -> DataFrame:
    """``posts`` with ``polarity, subjectivity``: mean word weight per post, zero without a hit.

    ``lexicon`` holds ``word, polarity, subjectivity``, one row per word. Its weights are summed as
    whole units, so the mean does not depend on row order. Words never leave their row.
    """
    scored = posts.select("*", *polarity_columns(F.transform(tokens(cleaned), F.lower), lexicon))
    return scored.select(*posts.columns, "_means.polarity", "_means.subjectivity")


def lexicon_scores(posts: DataFrame, lexicon: DataFrame, key: str, cleaned: str = "cleaned") -> DataFrame:
    """``(key, polarity, subjectivity)`` of each post."""
    return add_scores(posts.select(key, cleaned), lexicon, cleaned).select(key, "polarity", "subjectivity")


def preprocess_topics(
    posts: DataFrame, stop_words: Iterable[str], key: str, lemmas: DataFrame | None = None
) -> DataFrame:
    """``(key, preprocessed_text)``; ``lemmas`` holds ``word, lemma``, one row per word.

    Lemmas are looked up inside the row, so words never leave it.
    """
    words = topic_words("text", stop_words)
    if lemmas is not None:
        table = make_dictionary(lemmas, "word", ["lemma"])
        words = F.transform(words, lambda w: F.coalesce(table.find(w)["lemma"], w))
    return posts.select(key, F.coalesce(F.array_join(words, " "), F.lit("")).alias("preprocessed_text"))


def extract_with_model(
    posts: DataFrame,
    load: Callable[[], Callable[[list[str]], list[dict]]],
    key: str = "post_id",
) -> DataFrame:
    """Entities from a user model, by Arrow batches; ``load`` runs once per task.

    The model takes cleaned texts and gives dictionaries with ``disasters``, ``locations``
    and ``polarity``.
    """
    kind = dict(posts.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        model = load()
        for batch in batches:
            found = model(batch["cleaned"].tolist())
            yield pd.DataFrame(
                {
                    key: batch[key].to_numpy(),
                    "disasters": [list(dict.fromkeys(f.get("disasters", []))) for f in found],
                    "locations": [list(dict.fromkeys(f.get("locations", []))) for f in found],
                    "polarity": [float(f.get("polarity", 0.0)) for f in found],
                }
            )

    out = f"`{key}` {kind}, disasters array<string>, locations array<string>, polarity double"
    return posts.select(key, clean_text("text").alias("cleaned")).mapInPandas(run, out)
