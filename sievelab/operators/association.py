"""Rank correlation of features with the response and with each other, and the suggestion table.

Ranks are computed once per feature. The response is ranked on the packed rows first, so that its rank travels with
the row when features are ranked; no join on the row key is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.functions.columns import blend_scores, correlation
from sievelab.operators.joins import attach_small
from sievelab.operators.moments import cross_moments
from sievelab.operators.ordering import average_rank, slot_rows
from sievelab.operators.ranking import above_median, argmax
from sievelab.sources.scratch import save_table


def name_table(df: DataFrame, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(names)), "pos int, variable string")


def rank_target(packed: DataFrame, rows: int, width: int, **options) -> DataFrame:
    """Adds ``y_rank``; the features move along with their row, once, as the rows are written for the passes over the features."""
    options = {"rows_per_slot": slot_rows(rows, width), **options}
    return save_table(average_rank(packed, "y", alias="y_rank", sizes=(rows, 1), **options), "ranked-response")


def spearman_target(packed: DataFrame, names: list[str], rows: int | None = None, **options) -> DataFrame:
    """(variable, n, rho): Spearman correlation of every feature with the response; null if either is constant."""
    rows = packed.count() if rows is None else rows
    ranked_y = rank_target(packed.select("y", "x"), rows, len(names), **options)
    cells = ranked_y.select("y_rank", F.posexplode("x").alias("pos", "value"))
    ranked = average_rank(cells, "value", ["pos"], alias="x_rank", sizes=(rows, len(names)), **options)
    rho = ranked.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("x_rank"), F.col("y_rank")).alias("rho")
    )
    return rho.join(F.broadcast(name_table(packed, names)), "pos").select("variable", "n", "rho")


def rank_rows(packed: DataFrame, width: int, rows: int | None = None, **options) -> DataFrame:
    """(row, y, x): response and features of each row replaced by their ranks, centred at zero.

    Rows are put together again by a number of their own, so the caller's key may repeat or be absent.
    """
    rows = packed.count() if rows is None else rows
    centre = (rows + 1) / 2.0
    numbered = packed.select(F.monotonically_increasing_id().alias("row"), "y", "x")
    ranked_y = rank_target(numbered, rows, width, **options)
    cells = ranked_y.select("row", "y_rank", F.posexplode("x").alias("pos", "value"))
    ranked = average_rank(cells, "value", ["pos"], alias="x_rank", sizes=(rows, width), **options)
    return ranked.groupBy("row").agg(  # exactly ``width`` cells per row
        (F.first("y_rank") - centre).alias("y"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "x_rank"))), lambda cell: cell["x_rank"] - centre
        ).alias("x"),
    )


def feature_pairs(suggestions: DataFrame, finals: list[str]) -> DataFrame:
    """Every (final, suggestion), self pairs included; ``finals`` is the short list the model kept."""
    return suggestions.select(
        F.explode(F.array(*[F.lit(f) for f in finals])).alias("final"), F.col("variable").alias("suggestion")
    )


def spearman_pairs(
    packed: DataFrame, names: list[str], finals: list[str], rows: int | None = None, **options
) -> DataFrame:
    """(final, suggestion, abs_spearman_fs, abs_spearman_ts, n) of every final with every feature in ``names``.

    Ranks are centred, so a correlation is the sum of products over the root of both sums of squares. Only the finals'
    rows of the product matrix are summed. A feature without spread has null correlations.
    """
    rows = packed.count() if rows is None else rows
    at = {name: i for i, name in enumerate(names)}
    left = list(dict.fromkeys(finals))
    ranked = rank_rows(packed, len(names), rows, **options)
    cells = save_table(cross_moments(ranked, [at[f] for f in left], len(names)), "cross-moments")
    squares = cells.where("i = 0").select("j", F.col("value").alias("square"))
    sides = [(1, 0, None), *((k, at[f] + 1, f) for k, f in enumerate(left, 2))]  # row, its own column, its name
    side = packed.sparkSession.createDataFrame(sides, "i int, own int, final string")
    own = side.join(F.broadcast(squares.withColumnsRenamed({"j": "own", "square": "own_square"})), "own")
    spread = F.sqrt(F.greatest(F.col("square"), F.lit(0.0)) * F.greatest(F.col("own_square"), F.lit(0.0)))
    ratio = F.abs(F.try_divide(F.col("value"), spread))
    rho = F.when(ratio > 1, 1.0).otherwise(ratio)
    label = name_table(packed, names).select((F.col("pos") + 1).alias("j"), F.col("variable").alias("suggestion"))
    # all of these hold one row per feature, or per final and feature
    found = cells.where("i > 0 AND j > 0").join(F.broadcast(own), "i").join(F.broadcast(squares), "j")
    found = found.join(F.broadcast(label), "j").select("final", "suggestion", rho.alias("rho"))
    target = found.where("final IS NULL").select("suggestion", F.col("rho").alias("abs_spearman_ts"))
    pairs = found.where("final IS NOT NULL").join(F.broadcast(target), "suggestion")
    return pairs.select(
        "final", "suggestion", F.col("rho").alias("abs_spearman_fs"), "abs_spearman_ts", F.lit(rows).cast("long").alias("n")
    )


def mic_lookup(pairs: DataFrame, mic: DataFrame) -> DataFrame:
    """Adds the MIC of the suggestion: (variable, mic) looked up by name."""
    return attach_small(pairs, mic.select(F.col("variable").alias("suggestion"), "mic"), ["suggestion"])


def pair_table(pairs: DataFrame, mic: DataFrame) -> DataFrame:
    """Pairs whose target correlation is above the median of all pairs, with MIC and blended scores."""
    return blend_scores(mic_lookup(above_median(pairs, "abs_spearman_ts"), mic))


def suggestions(scored: DataFrame) -> DataFrame:
    """Best final per suggestion, best score first."""
    best = argmax(scored, "mean_of_corr_mic", ["final"], ["suggestion"])
    return best.orderBy(F.desc("mean_of_corr_mic"), "suggestion")
