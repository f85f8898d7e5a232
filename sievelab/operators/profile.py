"""Distribution summaries per variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelab.operators.joins import fix_small
from sievelab.operators.ordering import quantiles

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def describe_features(long: DataFrame, approximate: bool = False, **options) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation) and max of the present values per variable.

    Quartiles are exact at any group size; ``approximate`` replaces them by a sketch in the same single pass.
    """
    present = long.where(F.col("value").isNotNull())
    aggregates = [
        F.count(F.lit(1)).alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if approximate:
        sketch = F.percentile_approx("value", list(QUARTILES.values()), 10_000)
        rows = present.groupBy("variable").agg(*aggregates, sketch.alias("q"))
        return rows.select(
            "variable", "count", "mean", "std", "min",
            *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(QUARTILES)],
            "max",
        )
    moments, variables = fix_small(present.groupBy("variable").agg(*aggregates))
    if variables is not None and "sizes" not in options:
        options["sizes"] = (moments.agg(F.max("count")).first()[0] or 0, variables)
    cuts = quantiles(present, "value", QUARTILES, ["variable"], **options)
    return moments.join(cuts, "variable").select("variable", "count", "mean", "std", "min", *QUARTILES, "max")
