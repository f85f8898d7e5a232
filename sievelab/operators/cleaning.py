"""Guards, cleaning and scaling of a job's table.

A job arrives wide, one column per parameter. Row sets used for modelling are either *long*
(row_id, variable, value), where the dotted names are values, or *packed* (row_id, y, x ARRAY<DOUBLE>). Both come
from the wide table without a shuffle. Statistics are one aggregate with map-side combine and a result of one row
per feature, which is broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelab.operators.joins import attach_small
from sievelab.sources.files import column

# Column names that describe the wafer or the step and are never features.
METADATA_COLUMNS = frozenset(
    {
        "END_TIME",
        "END_TM",
        "FAB",
        "LOT_CD",
        "ALIAS_LOT_ID",
        "LOT_ID",
        "WF_ID",
        "group_key",
        "module",
        "recipe_id",
        "oper",
        "FAB(FDC)",
        "LOT_CD(FDC)",
    }
)

# Result codes.
OK = "0"
NO_COEFFICIENT = "1"
NO_PAIR = "2"
EMPTY = "-1"
CONSTANT_RESPONSE = "-2"
NO_FEATURE = "-3"
TOO_FEW_ROWS = "-4"
MIN_ROWS = 10


def guard_expression(n: Column, response_std: Column, usable_features: Column | None = None) -> Column:
    """First failing input check, else null: empty, too few rows, constant response, no usable feature.

    A response with one value has no sample deviation and passes the constancy check.
    """
    code = F.when(n == 0, EMPTY).when(n < MIN_ROWS, TOO_FEW_ROWS).when(response_std == 0, CONSTANT_RESPONSE)
    if usable_features is not None:
        code = code.when(usable_features == 0, NO_FEATURE)
    return code


def guard_code(df: DataFrame, y: str, by: list[str] | None = None) -> DataFrame:
    """Row count, raw sample deviation of the response and guard code, per job if ``by`` is given."""
    profile = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(number(column(y))).alias("y_std")
    )
    return profile.withColumn("code", guard_expression(F.col("n"), F.col("y_std")))


def drop_null_target(df: DataFrame, y: str) -> DataFrame:
    """Rows with a response; the null test is a filter that scans can apply."""
    return df.where(column(y).isNotNull() & ~F.isnan(column(y).cast("double")))


def feature_columns(
    columns: list[str],
    y: str,
    exclude: frozenset[str] | set[str] = METADATA_COLUMNS,
    legacy_name_match: bool = False,
) -> list[str]:
    """Columns that are features, in table order.

    ``legacy_name_match`` also drops columns whose name is contained in the response's name.
    """
    kept = []
    for name in columns:
        is_response = name in y if legacy_name_match else name == y
        if not is_response and name not in exclude and name != "END_TIME":
            kept.append(name)
    return kept


def require_numeric(df: DataFrame, features: list[str]) -> None:
    wrong = [f for f in features if not isinstance(df.schema[f].dataType, (T.NumericType, T.BooleanType))]
    if wrong:
        raise ValueError(f"features that are not numeric: {', '.join(wrong)}")


def number(value: Column) -> Column:
    """Double with NaN read as missing."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def to_long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row per row and feature; map-only."""
    cells = [F.struct(F.lit(f).alias("variable"), number(column(f)).alias("value")) for f in features]
    return df.select(*[column(k) for k in keep], F.explode(F.array(*cells)).alias("cell")).select(
        *[F.col(f"`{k}`") for k in keep], "cell.variable", "cell.value"
    )


def feature_profile(long: DataFrame) -> DataFrame:
    """One row per variable: rows, present values, moments. Missing values count as the mean in ``*_filled``."""
    present = F.count("value")
    rows = F.count(F.lit(1))
    pop = F.stddev_pop("value")
    return long.groupBy("variable").agg(
        rows.alias("n"),
        present.alias("n_present"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        (pop * F.sqrt(present / rows)).alias("std_pop_filled"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
    )


def mean_impute(long: DataFrame, n_features: int | None = None) -> DataFrame:
    """Missing values replaced by the variable's mean; an all-missing variable stays missing."""
    means = long.groupBy("variable").agg(F.avg("value").alias("__mean"))
    joined = attach_small(long, means, ["variable"], known_rows=n_features)
    return _like(long, joined, F.coalesce("value", "__mean"))


def drop_constant(long: DataFrame, n_features: int | None = None) -> DataFrame:
    """Variables with a positive sample deviation."""
    varying = (
        long.groupBy("variable").agg(F.stddev_samp("value").alias("std")).where("std > 0").select("variable")
    )
    return attach_small(long, varying, ["variable"], how="left_semi", known_rows=n_features)


def drop_null_features(long: DataFrame, n_features: int | None = None) -> DataFrame:
    """Variables without any missing value."""
    full = (
        long.groupBy("variable")
        .agg((F.count("value") == F.count(F.lit(1))).alias("full"))
        .where("full")
        .select("variable")
    )
    return attach_small(long, full, ["variable"], how="left_semi", known_rows=n_features)


def standardize(long: DataFrame, n_features: int | None = None) -> DataFrame:
    """(value - mean) / population deviation by variable; a constant variable keeps divisor 1."""
    stats = long.groupBy("variable").agg(
        F.avg("value").alias("__mean"), F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("__std")
    )
    joined = attach_small(long, stats, ["variable"], known_rows=n_features)
    return _like(long, joined, (F.col("value") - F.col("__mean")) / F.col("__std"))


def l2_normalize(long: DataFrame, n_features: int | None = None) -> DataFrame:
    """Each varying variable divided by its Euclidean norm over all rows; constant variables are dropped."""
    stats = (
        long.groupBy("variable")
        .agg(
            F.stddev_samp("value").alias("__std"),
            F.coalesce(F.nullif(F.sqrt(F.sum(F.col("value") * F.col("value"))), F.lit(0.0)), F.lit(1.0)).alias("__norm"),
        )
        .where("__std > 0")
    )
    joined = attach_small(long, stats, ["variable"], known_rows=n_features)
    return _like(long, joined, F.col("value") / F.col("__norm"))


def long_with_target(df: DataFrame, features: list[str], y: str, time: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, y, end_micros, variable, value): the response and time stay with their row, so nothing is joined; map-only."""
    timed = df.select(
        column(row_id).alias(row_id),
        number(column(y)).alias("y"),
        F.unix_micros(column(time)).alias("end_micros"),
        *[column(f) for f in features if f not in (row_id, "y", "end_micros")],
    )
    return to_long(timed, features, [row_id, "y", "end_micros"])


def attach_target(long: DataFrame, target: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds the response and time of each row from a table of its own, matched on the row key."""
    return long.join(target, row_id)


def select_features(long: DataFrame, selected: DataFrame, n_features: int | None = None) -> DataFrame:
    """Rows of the named variables."""
    return attach_small(long, selected.select("variable"), ["variable"], how="left_semi", known_rows=n_features)


def pack(df: DataFrame, features: list[str], keep: list[Column]) -> DataFrame:
    """Kept columns plus ``x``, the features as one array in the given order; map-only."""
    return df.select(*keep, F.array(*[number(column(f)) for f in features]).alias("x"))


def job_profile(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """One pass over the source: per position (0 = response, then the features) counts, mean and deviations.

    The response's ``n`` counts all rows, a feature's only the rows with a response. ``std_pop_filled`` is the
    population deviation once missing values are replaced by the mean.
    """
    values = F.array(*[number(column(c)) for c in [y, *features]])
    cells = df.select(number(column(y)).isNotNull().alias("known"), F.posexplode(values).alias("pos", "value"))
    present, rows = F.count("value"), F.count(F.lit(1))
    return cells.where("known OR pos = 0").groupBy("pos").agg(
        rows.alias("n"),
        present.alias("n_present"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.stddev_pop("value").alias("std_pop"),
        (F.stddev_pop("value") * F.sqrt(present / rows)).alias("std_pop_filled"),
    )


def _like(long: DataFrame, joined: DataFrame, value: Column) -> DataFrame:
    return joined.select(*[value.alias("value") if c == "value" else F.col(f"`{c}`") for c in long.columns])
