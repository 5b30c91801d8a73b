"""List comparison and span choice inside one row, by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.columns import as_col, bind

PAIRS = "array<struct<gold:string,pred:string>>"


def match_exact(gold: Column | str, pred: Column | str) -> Column:
    g, p = as_col(gold), as_col(pred)
    return F.struct(
        F.sort_array(F.array_intersect(g, p)).alias("tp"),
        F.sort_array(F.array_except(p, g)).alias("fp"),
        F.sort_array(F.array_except(g, p)).alias("fn"),
    )


def match_partial(gold: Column | str, pred: Column | str) -> Column:
    """Each prediction in order takes the first free gold item where one contains the other."""
    g, p = as_col(gold), as_col(pred)
    start = F.struct(
        F.array_repeat(F.lit(False), F.size(g)).alias("used"),
        F.array().cast(PAIRS).alias("tp"),
        F.array().cast("array<string>").alias("fp"),
    )

    def take(acc: Column, item: Column) -> Column:
        # The inner index is one-based; zero means that no gold item is free.
        fits = F.transform(
            g, lambda x, i: ~F.get(acc["used"], i) & (F.contains(x, item) | F.contains(item, x))
        )
        return bind(
            F.array_position(fits, True).cast("int"),
            lambda at: F.when(
                at > 0,
                F.struct(
                    F.transform(acc["used"], lambda u, i: u | (i == at - 1)).alias("used"),
                    F.concat(
                        acc["tp"],
                        F.array(F.struct(F.get(g, at - 1).alias("gold"), item.alias("pred"))),
                    ).cast(PAIRS).alias("tp"),
                    acc["fp"].alias("fp"),
                ),
            ).otherwise(
                F.struct(
                    acc["used"].alias("used"),
                    acc["tp"].alias("tp"),
                    F.concat(acc["fp"], F.array(item)).alias("fp"),
                )
            ),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            acc["tp"].alias("tp"),
            acc["fp"].alias("fp"),
            F.filter(g, lambda x, i: ~F.get(acc["used"], i)).alias("fn"),
        )

    return F.aggregate(p, start, take, finish)


# Items of a list's inner pieces: adding one copies no more than a piece.
PIECE = 128


def choose_spans(spans: Column | str) -> Column:
    """Longest spans first, then earliest, without overlaps; result in text order.

    ``spans`` holds structs whose first fields are ``start`` and ``len``, each pair once. Lengths
    are handled from long to short. Starts that a longer span covers go by set difference; one
    sweep over the rest takes each span that begins behind the last one taken. A sweep is linear in
    the spans, and there is one for each length that occurs.
    """

    def choose(given: Column) -> Column:
        none = F.filter(given, lambda s: F.lit(False))
        pieces = F.filter(F.array(given), lambda x: F.lit(False))

        def add_length(kept: Column, n: Column) -> Column:
            covered = F.flatten(
                F.transform(kept, lambda s: F.sequence(s["start"] - n + 1, s["start"] + s["len"] - 1))
            )

            def sweep(own: Column) -> Column:
                free = F.array_except(F.transform(own, lambda s: s["start"]), covered)

                def walk(open_starts: Column) -> Column:
                    begin = F.struct(
                        F.lit(0).alias("at"), F.lit(-1).alias("end"), pieces.alias("done"), none.alias("last"))

                    def step(acc: Column, s: Column) -> Column:
                        is_free = F.coalesce(F.get(open_starts, acc["at"]) == s["start"], F.lit(False))
                        taken = is_free & (s["start"] > acc["end"])
                        full = F.size(acc["last"]) >= PIECE
                        done = F.when(taken & full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
                        last = F.when(taken & full, F.array(s)).when(taken, F.concat(acc["last"], F.array(s))).otherwise(acc["last"])
                        return F.struct(
                            (acc["at"] + is_free.cast("int")).alias("at"),
                            F.when(taken, s["start"] + n - 1).otherwise(acc["end"]).alias("end"),
                            done.alias("done"), last.alias("last"))

                    return F.aggregate(own, begin, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))

                return bind(free, walk)

            return F.concat(kept, bind(F.filter(given, lambda s: s["len"] == n), sweep))

        lengths = F.reverse(F.array_sort(F.array_distinct(F.transform(given, lambda s: s["len"]))))
        chosen = F.aggregate(lengths, none, add_length)
        return F.when(F.size(given) <= 1, given).otherwise(F.sort_array(chosen))

    return bind(F.sort_array(as_col(spans)), choose)
