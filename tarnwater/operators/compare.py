"""A water series against climate indices and other series: joins on the month, lagged correlations, composites by phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import f_p
from .series import indexed


def paired(series: DataFrame, index: DataFrame, x: str, y: str, key: str = "month_key") -> DataFrame:
    """(key, x, y): months that both have."""
    return series.select(key, F.col(x).alias("x")).join(index.select(key, F.col(y).alias("y")), key)


def cross_correlation(pairs: DataFrame, max_lag: int = 12, key: str = "month_key") -> DataFrame:
    """(lag, n, r): x at row i against y at row i - lag, rows by order; no rows unless there are twice max_lag months."""
    rows = indexed(pairs, key)
    enough = pairs.agg((F.count("*") >= 2 * max_lag).alias("_ok"))
    left = rows.select("i", "x").crossJoin(F.broadcast(enough)).where("_ok").select("i", "x", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    right = rows.select(F.col("i").alias("_j"), "y")
    return left.join(right, F.col("_j") == F.col("i") - F.col("lag")).groupBy("lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def best_lag(lags: DataFrame) -> DataFrame:
    """The lag of the largest absolute correlation, the first on ties, and what it means."""
    best = lags.agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("b"))).alias("s")).select("s.*")
    return best.withColumn("meaning", F.when(F.col("lag") < 0, "water leads index").when(F.col("lag") > 0, "index leads water").otherwise("in phase"))


def significance(pairs: DataFrame, fixed_n: int | None = 100) -> DataFrame:
    """Half-width of the 95 % band of no correlation: for a fixed n as drawn in the original figures, or for the pairs' own."""
    n = F.lit(fixed_n) if fixed_n else F.count("*")
    return pairs.agg((1.96 / F.sqrt(n.cast("double"))).alias("band"))


def phases(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`phase` of each month: its index in deviations from the mean above, below or within the threshold."""
    every = W.partitionBy()
    z = (F.col("y") - F.avg("y").over(every)) / F.stddev_samp("y").over(every)
    return pairs.withColumn("index_std", z).withColumn("phase", F.when(F.col("index_std") > threshold, "positive").when(F.col("index_std") < -threshold, "negative").when(F.col("index_std").isNotNull(), "neutral"))


def phase_means(phased: DataFrame) -> DataFrame:
    return phased.where("phase is not null").groupBy("phase").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x"))


def phase_months(phased: DataFrame, key: str = "month_key") -> DataFrame:
    """Mean of the metric by phase and month of the year."""
    return phased.where("phase is not null").groupBy("phase", (F.col(key) % 100).cast("int").alias("month_i")).agg(F.avg("x").alias("mean_x"))


def anova(phased: DataFrame, p_value: bool = True) -> DataFrame:
    """One-way analysis of variance of x by phase: F, degrees of freedom, p."""
    groups = phased.where("phase is not null and x is not null").groupBy("phase").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    sums = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"), F.sum(F.col("n") * F.col("v")).alias("within"), grand.alias("_g"))
    out = sums.select((F.col("k") - 1).cast("double").alias("df_between"), (F.col("n") - F.col("k")).cast("double").alias("df_within"), (F.col("_q") - F.col("n") * F.col("_g") * F.col("_g")).alias("between"), "within")
    out = out.select("df_between", "df_within", F.try_divide(F.try_divide("between", "df_between"), F.try_divide("within", "df_within")).alias("f_stat"))
    return out.withColumn("p_value", f_p("f_stat", "df_between", "df_within")) if p_value else out
