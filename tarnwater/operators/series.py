"""Statistics of monthly series. A series has a row per month: thousands of rows, so windows over all of it are in order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stl as stl_
from ..functions.distributions import normal_p, t_p


def indexed(series: DataFrame, order: str = "month_key", by: Sequence[str] = ()) -> DataFrame:
    """`i`: the row's place in order, from 0."""
    return series.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1)


def climatology(series: DataFrame, metrics: Sequence[str], month: str = "month_i") -> DataFrame:
    """Mean and sample deviation of each metric by month of the year."""
    return series.groupBy(month).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def anomalies(series: DataFrame, metric: str, month: str = "month_i", key: str = "month_key", baseline: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Difference from the month's mean over the baseline, and that in deviations; months the baseline lacks have mean 0 and deviation 1."""
    start, end = baseline
    if start is None and end is None:
        by = W.partitionBy(month)
        x = series.withColumns({"_m": F.avg(metric).over(by), "_s": F.stddev_samp(metric).over(by)})
    else:
        base = series
        if start is not None:
            base = base.where(F.col(key) >= start)
        if end is not None:
            base = base.where(F.col(key) <= end)
        means = base.groupBy(month).agg(F.avg(metric).alias("_m"), F.stddev_samp(metric).alias("_s"), F.lit(True).alias("_known"))
        x = series.join(F.broadcast(means), month, "left").withColumns({"_m": F.coalesce("_m", F.lit(0.0)), "_s": F.when(F.col("_known"), F.col("_s")).otherwise(1.0)}).drop("_known")
    return x.withColumns({f"{metric}_anomaly": F.col(metric) - F.col("_m"), f"{metric}_anomaly_std": (F.col(metric) - F.col("_m")) / (F.col("_s") + 1e-10)}).drop("_m", "_s")


def summary(series: DataFrame, metrics: Sequence[str], key: str = "month_key", year: str = "year_i") -> DataFrame:
    """One row: span, months, years, and mean, deviation, least, most and median of each metric."""
    each = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max"), (F.median, "median"))]
    return series.agg(F.min(key).alias("start_month"), F.max(key).alias("end_month"), F.count("*").alias("n_months"), F.count_distinct(year).alias("n_years"), *each)


def summary_json(series: DataFrame, metrics: Sequence[str], **names: str) -> DataFrame:
    row = summary(series, metrics, **names)
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def correlations(series: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, in long form (x, y, r): one aggregate, one row per pair."""
    pairs = [(a, b) for a in metrics for b in metrics]
    wide = series.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("s")).select("s.*")


def rank_correlation(series: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman: correlation of average ranks."""
    out = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        out = out.withColumn(f"_{c}", F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0)
    return out.agg(F.corr(f"_{x}", f"_{y}").alias("rho"))


def histogram(series: DataFrame, metric: str, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the greatest value, the last bin closed."""
    ends = series.agg(F.min(metric).cast("double").alias("_lo"), F.max(metric).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col(metric) - F.col("_lo"), width)), F.lit(0)))
    return series.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(series: DataFrame, metric: str, by: str = "year_i") -> DataFrame:
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return series.groupBy(by).agg(F.min(metric).alias("low"), q.alias("_q"), F.max(metric).alias("high")).select(by, "low", *(F.col("_q")[k].alias(f"q{k + 1}") for k in range(3)), "high")


def linear_trend(series: DataFrame, metric: str, order: str = "month_key", p_value: bool = True) -> DataFrame:
    """Slope per row, intercept, r squared, standard error, and the p of the slope."""
    rows = indexed(series, order).where(F.col(metric).isNotNull())
    n, r2 = F.col("n"), F.col("r_squared")
    fit = rows.agg(F.count("*").alias("n"), F.regr_slope(metric, "i").alias("slope"), F.regr_intercept(metric, "i").alias("intercept"), F.regr_r2(metric, "i").alias("r_squared"), F.regr_syy(metric, "i").alias("_yy"), F.regr_sxx(metric, "i").alias("_xx"))
    fit = fit.withColumn("stderr", F.sqrt(F.try_divide((1 - r2) * F.try_divide("_yy", "_xx"), F.when(n > 2, (n - 2).cast("double"))))).drop("_xx", "_yy")
    return fit.withColumn("p_value", t_p(F.try_divide("slope", "stderr"), (n - 2).cast("double"))) if p_value else fit


def _pairs(series: DataFrame, metric: str, order: str) -> DataFrame:
    rows = indexed(series, order).select("i", F.col(metric).alias("v"))
    a, b = rows.withColumnsRenamed({"i": "ia", "v": "va"}), rows.withColumnsRenamed({"i": "ib", "v": "vb"})
    return a.join(F.broadcast(b), F.col("ib") > F.col("ia"))


def mann_kendall(series: DataFrame, metric: str, order: str = "month_key", p_value: bool = True, tie_correction: bool = False) -> DataFrame:
    """S, its variance, Z with continuity correction; with p_value, the p and the trend's name at 0.05."""
    s = _pairs(series, metric, order).agg(F.coalesce(F.sum(F.signum(F.col("vb") - F.col("va"))), F.lit(0.0)).alias("s"))
    n = series.agg(F.count("*").alias("n"))
    x = s.crossJoin(F.broadcast(n)).withColumn("var_s", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18)
    if tie_correction:
        ties = series.groupBy(metric).count().agg(F.sum(F.col("count") * (F.col("count") - 1) * (2 * F.col("count") + 5) / 18).alias("_ties"))
        x = x.crossJoin(F.broadcast(ties)).withColumn("var_s", F.col("var_s") - F.col("_ties")).drop("_ties")
    x = x.withColumn("z", F.coalesce(F.try_divide(F.col("s") - F.signum("s"), F.sqrt("var_s")), F.lit(0.0)))
    if not p_value:
        return x
    x = x.withColumn("p_value", normal_p("z"))
    return x.withColumn("trend", F.when((F.col("p_value") < 0.05) & (F.col("z") > 0), "increasing").when(F.col("p_value") < 0.05, "decreasing").otherwise("no significant trend"))


def sens_slope(series: DataFrame, metric: str, order: str = "month_key") -> DataFrame:
    """Median slope of all pairs, 0 if there are none."""
    slope = (F.col("vb") - F.col("va")) / (F.col("ib") - F.col("ia"))
    return _pairs(series, metric, order).agg(F.coalesce(F.median(slope), F.lit(0.0)).alias("slope"))


def decompose(series: DataFrame, metric: str, order: str = "month_key", period: int = 12, seasonal: int = 13, by: str | None = None) -> DataFrame:
    """`metric`_trend, _seasonal and _residual by STL; null for series shorter than two periods. Each series of `by` fits one task."""
    kind = series.schema[order].dataType.simpleString()
    schema = f"_by string, {order} {kind}, {metric} double, {metric}_trend double, {metric}_seasonal double, {metric}_residual double"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        y = frame[metric].to_numpy(float)
        parts = stl_.stl(y, period, seasonal) if len(y) >= 2 * period and not pd.isna(y).any() else (None, None, None)
        return frame.assign(**{f"{metric}_{n}": p for n, p in zip(("trend", "seasonal", "residual"), parts)})

    rows = series.select((F.col(by).cast("string") if by else F.lit("")).alias("_by"), order, F.col(metric).cast("double").alias(metric))
    out = rows.groupBy("_by").applyInPandas(fit, schema)
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")
