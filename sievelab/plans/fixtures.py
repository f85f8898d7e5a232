"""Job tables derived from the shared test tables, at whatever scale they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelab.operators.cleaning import mean_impute, to_long
from sievelab.sources.files import column

ORDER_FEATURES = [
    "line.cnt",
    "line.qty",
    "line.price",
    "line.disc",
    "line.tax",
    "cust.acctbal",
    "cust.nation",
    "const.one",
    "null.all",
]
EMBEDDING_WIDTH = 64
EMBEDDING_FEATURES = [f"emb.{i:02d}" for i in range(EMBEDDING_WIDTH)]
PLANTED = {"emb.08": 3.0, "emb.35": -2.0, "emb.46": 1.0}
MARK_FEATURES = ["line.number", "line.discount", "line.tax"]
LINE_FEATURES = ["line.quantity", "line.discount", "line.price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: price as response, line and customer figures as features, and metadata columns.

    Has missing values, a constant and an empty column. Averages are rounded so that ties are ties everywhere.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("line.cnt"),
        F.round(F.sum("l_quantity"), 2).alias("line.qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("line.price"),
        F.round(F.avg("l_discount"), 6).alias("line.disc"),
        F.round(F.avg("l_tax"), 6).alias("line.tax"),
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("cust.acctbal"), F.col("c_nationkey").cast("double").alias("cust.nation")
    )
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("y"),
        F.col("o_orderdate").cast("timestamp").alias("END_TIME"),
        F.col("o_orderpriority").alias("LOT_ID"),
        *[F.col(f"`{c}`") for c in ORDER_FEATURES[:7]],
        F.lit(1.0).alias("const.one"),
        F.lit(None).cast("double").alias("null.all"),
    )


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(orders_wide(spark, sf_dir), ORDER_FEATURES, ["row_id"])


def orders_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the seven varying features, missing values imputed."""
    features = ORDER_FEATURES[:7]
    return mean_impute(to_long(orders_wide(spark, sf_dir), features, ["row_id"]), len(features))


def embeddings_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, x) with 64 features and a response planted on three of them plus label noise."""
    x = F.col("embedding").cast("array<double>")
    signal = F.lit(0.05) * F.col("label")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", x.alias("x"))
    for name, weight in PLANTED.items():
        signal = signal + F.lit(weight) * F.col("x")[EMBEDDING_FEATURES.index(name)]
    return rows.select("row_id", signal.alias("y"), "x")


def embeddings_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = embeddings_packed(spark, sf_dir)
    return packed.select("row_id", "y", *[F.col("x")[i].alias(n) for i, n in enumerate(EMBEDDING_FEATURES)])


def embeddings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, variable, value)."""
    names = F.array(*[F.lit(n) for n in EMBEDDING_FEATURES])
    cells = embeddings_packed(spark, sf_dir).select("row_id", "y", F.posexplode("x").alias("pos", "value"))
    return cells.select("row_id", "y", F.get(names, F.col("pos")).alias("variable"), "value")


def lineitem_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x): line price against quantity, discount and itself."""
    lines = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    return lines.select(price.alias("y"), F.array("l_quantity", "l_discount", price).alias("x"))


def lineitem_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x) of few distinct values: tax against line number, discount and itself."""
    lines = table(spark, sf_dir, "lineitem")
    x = F.array(F.col("l_linenumber").cast("double"), "l_discount", "l_tax")
    return lines.select(F.col("l_tax").alias("y"), x.alias("x"))


def orders_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, y, x) of the seven varying order features, missing values imputed in one aggregate."""
    wide = orders_wide(spark, sf_dir)
    features = ORDER_FEATURES[:7]
    means = wide.agg(F.array(*[F.avg(column(f)) for f in features]).alias("means")).scalar()
    filled = [F.coalesce(column(f), F.get(means, F.lit(i))) for i, f in enumerate(features)]
    return wide.select("row_id", "y", F.array(*filled).alias("x"))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as status events: a user is a job, an event type a status."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("jobid"),
        F.col("event_type").alias("area"),
        F.col("event_type").alias("status"),
        (F.col("event_id") % 101).cast("int").alias("progress"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
