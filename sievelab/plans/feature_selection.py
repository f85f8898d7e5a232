"""The whole job: guards, forest, lasso, forward selection, suggestions, result rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.functions.special import spearman_pvalue
from sievelab.operators import association, cleaning, forest, lasso, results, sampling, status, stepwise
from sievelab.operators.joins import fix_small
from sievelab.operators.mic import mic
from sievelab.operators.moments import Moments, collect_moments, moment_cells, total
from sievelab.operators.ranking import above_median, argmax, top_n, top_n_abs
from sievelab.sources.files import column
from sievelab.sources.scratch import save_table


@dataclass(frozen=True)
class Settings:
    """Sizes and seeds of the job's stages."""

    forest: forest.ForestSpec = field(default_factory=forest.ForestSpec)
    forest_top: int | None = None  # keep so many features after the forest or the lasso; none are dropped by default
    lasso_top: int | None = None
    test_share: float = 0.3
    split_seed: int = 42
    alphas: tuple[float, float, int] = (-10.0, -3.0, 100)
    tolerance: float = lasso.TOLERANCE
    folds: int = 5
    gain: float = 0.0
    patience: int = stepwise.PATIENCE
    penalty: str = "single"
    mic_method: str = "optimized"
    mic_cells: int | None = None
    mic_max_b: int | None = None
    legacy_name_match: bool = False
    failed_event: bool = False


@dataclass
class JobResult:
    """Outcome of one job: result code, the three result tables, and the tables they come from."""

    code: str
    importance: DataFrame
    coefficients: DataFrame
    result: DataFrame
    status: DataFrame
    details: dict[str, DataFrame] = field(default_factory=dict)
    dropped: dict[str, int] = field(default_factory=dict)  # features that a top-N setting left out


CELLS_PER_PART = 2_000_000
MODEL_SCHEMA = "variable string, score double, abs_score double"
PAIR_SCHEMA = (
    "final string, suggestion string, abs_spearman_fs double, abs_spearman_ts double, n long, mic double, "
    "mean_of_corr double, mean_of_corr_mic double"
)


def feature_selection(
    df: DataFrame,
    y: str,
    row_id: str | None = None,
    job_id: str = "job",
    area: str = "local",
    as_of: dt.datetime | None = None,
    exclude: frozenset[str] | set[str] = cleaning.METADATA_COLUMNS,
    settings: Settings = Settings(),
    clock: Callable[[], dt.datetime] = dt.datetime.now,
    on_stage: Callable[[DataFrame], None] | None = None,
) -> JobResult:
    """Explain column ``y`` of the wide table ``df`` by its other numeric columns.

    ``row_id`` names an integer column that gives the row order, without nulls; without it rows are numbered as read.
    The cleaned, scaled matrix is written once to the shared scratch folder, dealt by a hash of the key whatever the
    input's files, and every stage reads that table. Only names, importances and moment matrices, whose sizes depend on
    the number of features, reach the driver. ``on_stage`` gets the status event of each stage when it is reached.
    """
    spark = df.sparkSession
    as_of = as_of or clock()
    stages: list[tuple[str, dt.datetime]] = []

    def reached(stage: str) -> None:
        stages.append((stage, clock()))
        if on_stage is not None:
            events = status.stage_events(spark, job_id, area, stages)
            on_stage(events.where(F.col("event_id") == len(stages) - 1))

    reached("STARTED")
    features = cleaning.feature_columns(df.columns, y, set(exclude) | {row_id or ""}, settings.legacy_name_match)
    cleaning.require_numeric(df, features)

    def stop(code: str) -> JobResult:
        if settings.failed_event:
            reached("FAILED")
        return JobResult(
            code,
            results.error_row(spark, code, job_id, as_of),
            results.coeff_rows(spark.createDataFrame([], MODEL_SCHEMA), code, job_id, as_of),
            results.result_rows(spark.createDataFrame([], PAIR_SCHEMA), job_id, as_of),
            status.stage_events(spark, job_id, area, stages),
        )

    profile = {r["pos"]: r for r in cleaning.job_profile(df, y, features).collect()}  # one row per column
    response = profile.pop(0, None)
    usable = [
        (features[pos - 1], _steady(r["mean"]), _steady(r["std_pop_filled"]))
        for pos, r in sorted(profile.items())
        if (r["std"] or 0) > 0
    ]
    code = _guard(response["n"] if response else 0, response["std"] if response else None, len(usable))
    if code is not None:
        return stop(code)

    names = [name for name, _, _ in usable]
    rows = response["n_present"]
    scaled_rows = _scaled_matrix(df, y, row_id, usable, _steady(response["mean"]), _steady(response["std_pop"] or 1.0))
    matrix = save_table(_dealt(scaled_rows, rows * len(names)), "matrix")
    if not matrix.where("row_id IS NULL").isEmpty():
        raise ValueError(f"null keys in {row_id}")

    importances = forest.rf_bootstrap(matrix, names, settings.forest, rows=rows)
    per_replicate = (len(names), settings.forest.replicates)
    stats, _ = fix_small(forest.importance_stats(importances, sizes=(settings.forest.replicates, len(names))))
    positive = forest.positive_importance(stats)
    # By name, as the descent's early stop depends on the order it visits the features in.
    n_positive = positive.count()
    best = positive if settings.forest_top is None else top_n(positive, "mean", settings.forest_top)
    chosen = sorted(r["variable"] for r in best.collect())
    dropped = {"forest": n_positive - len(chosen)}
    reached("RF_COMPLETED")
    details = {"importances": forest.rank_importance(importances, per_replicate), "importance_stats": stats}

    at = {name: i for i, name in enumerate(names)}
    screened = matrix.select("row_id", "y", _take([at[c] for c in chosen]).alias("x"))
    if chosen:
        cells, moments = _grouped_moments(screened, rows, len(chosen), settings)
        norms = total(moments.values()).norms
        scaled = {grp: m.rescaled(norms) for grp, m in moments.items()}
        path, alpha = _best_alpha(spark, scaled, settings)
        selected = lasso.lasso_select(spark, total(scaled.values()), chosen, alpha, settings.tolerance)
        n_selected = selected.count()
        selected = top_n_abs(selected, "score", settings.lasso_top or max(n_selected, 1))
        kept = [r["variable"] for r in selected.collect()]
        dropped["lasso"] = n_selected - len(kept)
        details |= {"alphas": path, "lasso": selected}
        everything = total(scaled.values())
    else:
        kept = []
    reached("LASSO_COMPLETED")
    if not kept:
        return JobResult(
            cleaning.NO_COEFFICIENT,
            results.importance_rows(stats, cleaning.NO_COEFFICIENT, job_id, as_of),
            results.coeff_rows(spark.createDataFrame([], MODEL_SCHEMA), cleaning.NO_COEFFICIENT, job_id, as_of),
            results.result_rows(spark.createDataFrame([], PAIR_SCHEMA), job_id, as_of),
            status.stage_events(spark, job_id, area, stages),
            details,
            dropped,
        )

    fold_cells = _restrict(cells, len(chosen), [chosen.index(k) for k in kept], settings.folds)
    trace = save_table(
        stepwise.step_forward(
            fold_cells, kept, tol=settings.gain, patience=settings.patience, penalty=settings.penalty
        ),
        "trace",
    )
    model = stepwise.best_model(trace)
    terms = model.collect()  # one row per feature
    finals = [r["variable"] for r in terms]
    details["quality"] = _quality(
        spark, everything, chosen, {"lasso": selected.collect(), "step_forward": terms}
    )
    reached("STEP_FORWARD_COMPLETED")

    pairs = association.spearman_pairs(screened, chosen, finals, rows)
    above = above_median(pairs, "abs_spearman_ts")
    wanted = [r["suggestion"] for r in above.select("suggestion").distinct().orderBy("suggestion").collect()]
    mics = _mic_of(screened, chosen, wanted, rows, settings)
    scored = association.pair_table(pairs, mics)
    best = association.suggestions(scored)
    reached("MIC_COMPLETED")

    code = cleaning.OK if wanted else cleaning.NO_PAIR
    return JobResult(
        code,
        results.importance_rows(stats, code, job_id, as_of),
        results.coeff_rows(model, code, job_id, as_of),
        results.result_rows(best, job_id, as_of),
        status.stage_events(spark, job_id, area, stages),
        details
        | {"trace": trace, "model": model, "pairs": _with_tails(pairs), "mic": mics, "scored": _with_tails(scored)},
        dropped,
    )


def write_job(
    job: JobResult,
    root: str,
    format: str = "parquet",
    on_stage: Callable[[DataFrame], None] | None = None,
    clock: Callable[[], dt.datetime] = dt.datetime.now,
) -> DataFrame:
    """Append the three result tables below ``root``, partitioned by day; returns the status with what followed.

    A job that ran through is COMPLETED once its rows are written; a guarded one keeps the status it ended with.
    """
    results.append_table(job.importance, f"{root}/importance", format)
    results.append_table(job.coefficients, f"{root}/coefficients", format)
    results.append_table(job.result, f"{root}/result", format)
    if job.code not in (cleaning.OK, cleaning.NO_PAIR):
        return job.status
    last = job.status.orderBy(F.desc("event_id")).first()
    done = [("", clock())] * (last["event_id"] + 1) + [("COMPLETED", clock())]
    events = status.stage_events(job.status.sparkSession, last["jobid"], last["area"], done)
    event = events.where(F.col("event_id") == last["event_id"] + 1)
    if on_stage is not None:
        on_stage(event)
    return job.status.unionByName(event)


def _quality(spark: SparkSession, m: Moments, names: list[str], models: dict[str, list]) -> DataFrame:
    """(model, r2, adj_r2) of the job's own models on all rows."""
    rows = []
    for model, terms in models.items():
        weights = {t["variable"]: t["score"] for t in terms}
        rows.append((model, *stepwise.model_quality(m, np.array([weights.get(n, 0.0) for n in names]))))
    return spark.createDataFrame(rows, "model string, r2 double, adj_r2 double")


def _with_tails(pairs: DataFrame) -> DataFrame:
    """Adds the p-values of both correlations of each pair."""
    tails = {f"p_{k}": spearman_pvalue(F.col(f"abs_spearman_{k}"), F.col("n")) for k in ("fs", "ts")}
    return pairs.withColumns(tails)


def _guard(n: int, std: float | None, usable: int) -> str | None:
    if n == 0:
        return cleaning.EMPTY
    if n < cleaning.MIN_ROWS:
        return cleaning.TOO_FEW_ROWS
    if std == 0:
        return cleaning.CONSTANT_RESPONSE
    return cleaning.NO_FEATURE if usable == 0 else None


def _scaled_matrix(
    df: DataFrame, y: str, row_id: str | None, usable: list[tuple[str, float, float]], mean: float, std: float
) -> DataFrame:
    """(row_id, y, x): rows with a response, missing values imputed, everything standardised. Map-only."""
    rows = cleaning.drop_null_target(df, y)
    cells = [
        (F.coalesce(cleaning.number(column(name)), F.lit(m)) - F.lit(m)) / F.lit(s) for name, m, s in usable
    ]
    key = column(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    return rows.select(
        key.alias("row_id"),
        ((cleaning.number(column(y)) - F.lit(mean)) / F.lit(std)).alias("y"),
        F.array(*cells).alias("x"),
    )


def _dealt(matrix: DataFrame, cells: int) -> DataFrame:
    """The rows by a hash of their key, in parts of about CELLS_PER_PART numbers, each sorted.

    Bagging draws by partition, so the same rows must lie in the same partitions however the source was cut.
    """
    parts = max(1, -(-cells // CELLS_PER_PART))
    return matrix.repartition(parts, F.xxhash64("row_id")).sortWithinPartitions("row_id", "y", "x")


def _steady(value: float) -> float:
    """The number without its last digits, which depend on the order of a sum."""
    return float(f"{value:.11g}")


def _take(positions: list[int]):
    return F.array(*[F.get("x", F.lit(p)) for p in positions])


def _grouped_moments(packed: DataFrame, rows: int, width: int, settings: Settings) -> tuple[DataFrame, dict[int, Moments]]:
    """Moments per (test split, fold): group code is split x folds + fold."""
    ids = packed.select("row_id")
    cut = sampling.exact_cuts(ids, settings.test_share, settings.split_seed, rows=rows)[0]
    ends = sampling.fold_ends(ids, settings.folds, rows=rows)
    group = cut.contains().cast("int") * settings.folds + sampling.fold_of(ends)
    cells = save_table(moment_cells(packed, group, width=width), "moments")
    return cells, collect_moments(cells)


def _best_alpha(spark: SparkSession, moments: dict[int, Moments], settings: Settings) -> tuple[DataFrame, float]:
    train = total(m for grp, m in moments.items() if grp < settings.folds)
    test = total(m for grp, m in moments.items() if grp >= settings.folds)
    path = lasso.lasso_path(spark, train, test, sampling.alpha_values(*settings.alphas), settings.tolerance)
    fixed = spark.createDataFrame(path.collect(), path.schema)  # one row per penalty
    return fixed, argmax(fixed, "test_score", ["alpha"]).first()["alpha"]


def _restrict(cells: DataFrame, width: int, positions: list[int], folds: int) -> DataFrame:
    """Fold moments of the named features only, renumbered."""
    old_row, old_col = np.triu_indices(width + 2)
    old = {(i, j): p for p, (i, j) in enumerate(zip(old_row.tolist(), old_col.tolist()))}
    kept = [0, 1, *[p + 2 for p in positions]]
    new_row, new_col = np.triu_indices(len(kept))
    moves = []
    for p, (i, j) in enumerate(zip(new_row.tolist(), new_col.tolist())):
        a, b = sorted((kept[i], kept[j]))
        moves.append((old[(a, b)], p))
    mapping = cells.sparkSession.createDataFrame(moves, "pos int, new_pos int")
    moved = cells.join(F.broadcast(mapping), "pos")  # one row per matrix cell
    return moved.groupBy((F.col("grp") % folds).alias("grp"), F.col("new_pos").alias("pos")).agg(
        F.sum("value").alias("value")
    )


def _mic_of(packed: DataFrame, names: list[str], wanted: list[str], rows: int, settings: Settings) -> DataFrame:
    if not wanted:
        return packed.sparkSession.createDataFrame([], "variable string, mic double, b int")
    narrowed = packed.select("y", _take([names.index(w) for w in wanted]).alias("x"))
    scored = mic(
        narrowed, wanted, rows, cells=settings.mic_cells, max_b=settings.mic_max_b, method=settings.mic_method
    )
    return packed.sparkSession.createDataFrame(scored.collect(), scored.schema)  # one row per feature
