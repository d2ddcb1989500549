"""Registered queries of the operators, each with its SQL where SQL can express it. They run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, names
from .model import DSWX, INTR, MonthlyParams
from .operators import altimetry, catalog, clean, compare, derivatives, elevation, merge, metrics, monthly, resample, series, spatial, statistics
from .sources.fixtures import view, with_views
from .storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ("cell_id",)


def query(sql: str | None = None, **more: str):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql in SQL.values() else with_views(sql)
        return f

    return add


def _obs(s, d):
    """Daily observations (the v_obs of the SQL), as the library merges them."""
    return merge.priority_pick(view(s, d, "v_scene"), ["cell_id", "row_i", "col_i", "obs_date", "month_key"], INTR, ["cls", "inwam"])


def _dswx(s, d):
    return merge.priority_merge(view(s, d, "v_scene_dswx"), ["cell_id", "row_i", "col_i", "obs_date"], DSWX)


def _stats(s, d):
    return statistics.water_statistics(_obs(s, d), keys=["cell_id", "row_i", "col_i"])


STATS = """stats AS (
  SELECT cell_id, row_i, col_i, water_count, valid_count, cloud_count, CASE WHEN valid_count = 0 THEN 0.0E0 ELSE CAST(water_count AS DOUBLE) / valid_count END AS water_prob,
    CASE WHEN valid_count = 0 THEN 0.0E0 ELSE CAST(cloud_count AS DOUBLE) / valid_count END AS cloud_frac
  FROM (SELECT cell_id, row_i, col_i, count(*) FILTER (WHERE cls <> 255) AS valid_count, count(*) FILTER (WHERE cls IN (1, 2, 3, 4)) AS water_count,
      count(*) FILTER (WHERE cls = 4) AS cloud_count FROM v_obs GROUP BY cell_id, row_i, col_i) c
), modes AS (
  SELECT cell_id, cls AS mode_class FROM (SELECT cell_id, cls, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, cls) AS rn
    FROM v_obs WHERE cls <> 255 GROUP BY cell_id, cls) m WHERE rn = 1
), wstats AS (
  SELECT s.*, coalesce(m.mode_class, 255) AS mode_class, water_prob >= 0.81 AS persistent, water_prob <= 0.4 AS stable_land,
    water_prob >= 0.1 AND water_prob < 0.81 AS ephemeral FROM stats s LEFT JOIN modes m ON s.cell_id = m.cell_id
)"""


# --- composites


@query("""
SELECT cell_id, obs_date, CAST(coalesce(max(cls) FILTER (WHERE rn = 1 AND cls <> 255), 255) AS INT) AS cls FROM (
  SELECT cell_id, obs_date, cls, row_number() OVER (PARTITION BY cell_id, obs_date ORDER BY
    CASE cls WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 0 THEN 4 WHEN 9 THEN 5 WHEN 255 THEN 2000 ELSE 1000 END, file_pos) AS rn
  FROM v_scene) t GROUP BY cell_id, obs_date""")
def daily_priority_mosaic(s, d):
    return merge.priority_merge(view(s, d, "v_scene"), ["cell_id", "obs_date"], INTR)


@query("SELECT cell_id, obs_date, cls FROM v_dswx")
def opera_priority_mosaic(s, d):
    return merge.priority_merge(view(s, d, "v_scene_dswx"), ["cell_id", "obs_date"], DSWX)


@query("SELECT cell_id, obs_date, CAST(coalesce(min(cls) FILTER (WHERE cls <> 255), 255) AS INT) AS cls FROM v_scene_dswx GROUP BY cell_id, obs_date")
def min_mosaic(s, d):
    return merge.min_merge(view(s, d, "v_scene_dswx"), ["cell_id", "obs_date"])


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY cell_id, obs_date ORDER BY file_pos) AS k FROM v_scene_dswx),
g AS (SELECT cell_id, obs_date, max(cls) FILTER (WHERE k = 1) AS v1 FROM f GROUP BY cell_id, obs_date),
r AS (SELECT f.cell_id, f.obs_date, f.cls, f.acq_min, row_number() OVER (PARTITION BY f.cell_id, f.obs_date ORDER BY CASE WHEN g.v1 = 0 THEN f.k END, f.cls, f.file_pos) AS rn
  FROM f JOIN g ON f.cell_id = g.cell_id AND f.obs_date = g.obs_date WHERE f.k = 1 OR (f.cls > 0 AND g.v1 <> 0))
SELECT cell_id, obs_date, cls, acq_min FROM r WHERE rn = 1""")
def min_positive_with_time(s, d):
    return merge.min_positive_merge(view(s, d, "v_scene_dswx"), ["cell_id", "obs_date"])


@query("""
SELECT cell_id, month_key, CAST(coalesce(max(cls) FILTER (WHERE rn = 1 AND cls <> 255), 255) AS INT) AS cls FROM (
  SELECT cell_id, month_key, cls, row_number() OVER (PARTITION BY cell_id, month_key ORDER BY
    CASE cls WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 0 THEN 4 WHEN 9 THEN 5 WHEN 255 THEN 2000 ELSE 1000 END, obs_date) AS rn
  FROM v_obs) t GROUP BY cell_id, month_key""")
def plain_monthly_merge(s, d):
    return monthly.monthly_merge(_obs(s, d), INTR, KEYS)


@query("""
SELECT file_id, min(x_m) AS xmin, min(y_m) AS ymin, max(x_m + 100) AS xmax, max(y_m + 100) AS ymax, min(10.0E0 + lake_id % 3) AS res FROM v_lake GROUP BY file_id""")
def extent_union(s, d):
    lakes = view(s, d, "v_lake").select("file_id", F.col("x_m").alias("xmin"), F.col("y_m").alias("ymin"), (F.col("x_m") + 100).alias("xmax"), (F.col("y_m") + 100).alias("ymax"), (10.0 + F.col("lake_id") % 3).alias("res"))
    return merge.extent_union(lakes, ["file_id"])


@query("""
WITH a AS (SELECT cell_id, obs_date, cls FROM v_dswx) SELECT x.cell_id, x.obs_date, x.cls - y.cls AS change
FROM a x JOIN a y ON x.cell_id = y.cell_id AND y.obs_date = x.obs_date - INTERVAL 1 DAY WHERE x.cls <> 255 AND y.cls <> 255""")
def difference_image(s, d):
    one = _dswx(s, d).select("cell_id", "obs_date", "cls")
    return merge.difference(one, one.withColumn("obs_date", F.date_add("obs_date", 1)), ["cell_id", "obs_date"])


# --- statistics


@query(f"WITH {STATS} SELECT cell_id, row_i, col_i, valid_count, water_count, cloud_count, CAST(mode_class AS INT) AS mode_class, water_prob, cloud_frac, persistent, stable_land, ephemeral FROM wstats JOIN (SELECT count(*) AS n FROM v_obs) z ON true".replace("JOIN (SELECT count(*) AS n FROM v_obs) z ON true", ""))
def water_statistics(s, d):
    return _stats(s, d)


@query("""
SELECT cell_id, count(*) FILTER (WHERE cls <> 255) AS valid_count, count(*) FILTER (WHERE cls IN (1, 2, 3, 4)) AS water_count, count(*) FILTER (WHERE cls = 9) AS cloud_count
FROM v_obs GROUP BY cell_id""")
def pixel_counts_cloud9(s, d):
    from .model import StatisticsParams

    return statistics.pixel_counts(_obs(s, d), StatisticsParams(cloud=9), KEYS)


@query("""
SELECT cell_id, sum(CASE WHEN cls <> 255 THEN w ELSE 0.0E0 END) AS valid_weight, sum(CASE WHEN cls IN (1, 2, 3, 4) THEN w ELSE 0.0E0 END) AS water_weight,
  sum(CASE WHEN cls = 4 THEN w ELSE 0.0E0 END) AS cloud_weight
FROM (SELECT cell_id, cls, CASE WHEN inwam IS NULL OR inwam = 255 THEN 0.0E0 ELSE inwam / 4.0E0 END AS w FROM v_obs) t GROUP BY cell_id""")
def weighted_counts(s, d):
    return statistics.weighted_counts(_obs(s, d), keys=KEYS)


@query("""
WITH c AS (SELECT DISTINCT cell_id FROM v_obs), m AS (SELECT cell_id, cls, row_number() OVER (PARTITION BY cell_id ORDER BY count(*) DESC, cls) AS rn FROM v_obs WHERE cls <> 255 GROUP BY cell_id, cls)
SELECT c.cell_id, CAST(coalesce(m.cls, 255) AS INT) AS mode_class FROM c LEFT JOIN m ON c.cell_id = m.cell_id AND m.rn = 1""")
def mode_class(s, d):
    return statistics.mode_class(_obs(s, d), keys=KEYS)


@query("SELECT cls, count(*) AS n, 100.0E0 * count(*) / sum(count(*)) OVER () AS pct FROM v_obs GROUP BY cls")
def class_histogram(s, d):
    return statistics.class_histogram(_obs(s, d))


@query(f"""WITH {STATS}, coast AS (SELECT row_i, col_i FROM v_dem WHERE col_i >= 8)
SELECT w.row_i, w.col_i, w.col_i >= 8 AND w.water_prob >= 0.6 AS ocean, EXISTS (SELECT 1 FROM coast c WHERE (c.row_i - w.row_i) * (c.row_i - w.row_i) + (c.col_i - w.col_i) * (c.col_i - w.col_i) <= 9) AS shore_buffer
FROM wstats w, (SELECT max(cell_id) AS m FROM v_obs) z WHERE z.m >= 0""")
def ocean_masks(s, d):
    coast = view(s, d, "v_dem").where("col_i >= 8")
    return statistics.ocean_masks(_stats(s, d), coast, 3).select("row_i", "col_i", "ocean", "shore_buffer")


@query("""
SELECT width, height, obs_date FROM (SELECT file_id, CAST(10 + file_id % 3 AS INT) AS width, CAST(10 + file_id % 5 AS INT) AS height, min(lake_id) AS obs_date FROM v_lake GROUP BY file_id) t
ORDER BY width * height, obs_date LIMIT 1""")
def reference_grid(s, d):
    grids = view(s, d, "v_lake").groupBy("file_id").agg(F.min("lake_id").alias("obs_date")).select((10 + F.col("file_id") % 3).cast("int").alias("width"), (10 + F.col("file_id") % 5).cast("int").alias("height"), "obs_date")
    return statistics.reference_grid(grids)


@query("SELECT CAST(10 + file_id % 3 AS INT) AS width, CAST(10 + file_id % 5 AS INT) AS height, count(*) AS n FROM v_lake GROUP BY file_id % 3, file_id % 5")
def grid_sizes(s, d):
    return statistics.grid_sizes(view(s, d, "v_lake").select((10 + F.col("file_id") % 3).cast("int").alias("width"), (10 + F.col("file_id") % 5).cast("int").alias("height")))


# --- monthly

QUALITY = """quality AS (
  SELECT obs_date, CAST(cloud AS DOUBLE) / total AS cloud_frac, CAST(valid AS DOUBLE) / total AS valid_frac, CAST(water AS DOUBLE) / total AS water_frac,
    CASE WHEN valid = 0 THEN 1.0E0 ELSE CAST(odd AS DOUBLE) / valid END AS mismatch
  FROM (SELECT o.obs_date, count(*) AS total, count(*) FILTER (WHERE cls = 9) AS cloud, count(*) FILTER (WHERE cls NOT IN (9, 255)) AS valid, count(*) FILTER (WHERE cls IN (1, 2, 3, 4)) AS water,
      count(*) FILTER (WHERE cls NOT IN (9, 255) AND (cls IN (1, 2, 3, 4)) <> (coalesce(w.water_prob, 0) >= 0.55)) AS odd
    FROM v_obs o LEFT JOIN wstats w ON o.cell_id = w.cell_id GROUP BY o.obs_date) t
), passing AS (SELECT o.* FROM v_obs o JOIN quality q ON o.obs_date = q.obs_date WHERE q.cloud_frac <= 0.6 AND q.valid_frac >= 0.2 AND q.mismatch <= 0.3)"""

VOTE = """weighed AS (
  SELECT *, CASE WHEN cls IN (1, 2, 3, 4) THEN CASE WHEN inwam = 1 THEN 4.0E0 WHEN inwam = 2 THEN 3.0E0 WHEN inwam = 3 THEN 2.0E0 WHEN inwam = 4 THEN 1.0E0
      WHEN cls = 1 THEN 3.5E0 WHEN cls = 2 THEN 3.0E0 WHEN cls = 3 THEN 2.0E0 ELSE 1.0E0 END WHEN cls = 0 THEN 3.0E0 ELSE 0.0E0 END AS w FROM passing
), votes AS (
  SELECT month_key, cell_id, count(*) AS n, count(*) FILTER (WHERE cls NOT IN (9, 255)) AS valid, count(*) FILTER (WHERE cls = 255) AS missing,
    count(*) FILTER (WHERE cls IN (1, 2)) AS wet, count(*) FILTER (WHERE cls = 3) AS part, count(*) FILTER (WHERE cls = 0) AS dry,
    count(*) FILTER (WHERE cls IN (1, 2, 3, 4) AND w >= 3) AS high, count(*) FILTER (WHERE cls IN (1, 2, 3, 4) AND w >= 2) AS moderate,
    sum(CASE WHEN cls IN (1, 2, 3, 4) THEN w ELSE 0.0E0 END) AS ww, sum(CASE WHEN cls = 0 THEN w ELSE 0.0E0 END) AS lw,
    coalesce(max(w) FILTER (WHERE cls IN (1, 2, 3, 4)), 0) AS maxw, sum(CASE WHEN cls = 1 THEN w ELSE 0.0E0 END) AS s1, sum(CASE WHEN cls = 2 THEN w ELSE 0.0E0 END) AS s2,
    sum(CASE WHEN cls = 3 THEN w ELSE 0.0E0 END) AS s3, sum(CASE WHEN cls = 4 THEN w ELSE 0.0E0 END) AS s4
  FROM weighed GROUP BY month_key, cell_id
), f AS (
  SELECT v.*, w.persistent, w.stable_land, w.water_prob, CAST(wet AS DOUBLE) / nullif(valid, 0) AS wf, CAST(part AS DOUBLE) / nullif(valid, 0) AS pf, CAST(high AS DOUBLE) / nullif(valid, 0) AS hf,
    CAST(moderate AS DOUBLE) / nullif(valid, 0) AS mf, greatest(s1, s2, s3, s4) AS top FROM votes v JOIN wstats w ON v.cell_id = w.cell_id
), m1 AS (
  SELECT *, CASE WHEN ((high >= 2 AND coalesce(hf, 0) >= 0.5) OR (moderate >= 3 AND coalesce(mf, 0) >= 0.6 AND ww >= lw + 2) OR (high >= 1 AND ww >= lw + 2 AND maxw >= 3)) AND valid >= 3 AND top > 0 AND maxw >= 2
      THEN CASE WHEN part > 0 AND valid > 0 THEN 3 WHEN s1 = top THEN 1 WHEN s2 = top THEN 2 WHEN s3 = top THEN 3 ELSE 4 END
      WHEN missing = n THEN 255 WHEN valid = 0 THEN 9 ELSE 0 END AS m FROM f
), m2 AS (SELECT * REPLACE (CASE WHEN persistent THEN 1 WHEN stable_land THEN 0 WHEN valid < 5 AND m IN (1, 2) AND part >= 1 THEN 3 ELSE m END AS m), NOT (persistent OR stable_land) AS free FROM m1
), m3 AS (SELECT * REPLACE (CASE WHEN free AND coalesce(wf, 0) >= 0.6 AND coalesce(pf, 0) >= 0.3 THEN CASE WHEN wf >= pf THEN 1 ELSE 3 END WHEN free AND coalesce(wf, 0) >= 0.6 THEN 1
      WHEN free AND coalesce(pf, 0) >= 0.3 THEN 3 ELSE m END AS m) FROM m2
), m4 AS (SELECT * REPLACE (CASE WHEN free AND m = 0 AND (wet > 0 OR part > 0) THEN 3 ELSE m END AS m) FROM m3
), monthly AS (
  SELECT month_key, cell_id, CAST(CASE WHEN m IN (1, 2) AND wet + part > 0 AND CAST(part AS DOUBLE) / (wet + part) >= 0.5 AND dry > 0 THEN 3
      WHEN m = 0 AND part > 0 AND part > wet THEN 3 WHEN m = 0 AND wet > 1 AND NOT part > wet THEN 1 ELSE m END AS INT) AS cls FROM m4
)"""


@query(f"WITH {STATS}, {QUALITY} SELECT *, cloud_frac <= 0.6 AND valid_frac >= 0.2 AND mismatch <= 0.3 AS passes FROM quality WHERE (SELECT count(*) FROM v_obs) >= 0")
def daily_qc(s, d):
    obs = stored(_obs(s, d), "observations")
    return monthly.daily_quality(obs, statistics.water_statistics(obs, keys=KEYS), keys=KEYS)


@query(f"""WITH {STATS}, {QUALITY.replace('SELECT o.obs_date, count(*) AS total', 'SELECT o.obs_date, 100 AS total')}
SELECT *, cloud_frac <= 0.6 AND valid_frac >= 0.2 AND mismatch <= 0.3 AS passes FROM quality WHERE (SELECT count(*) FROM v_obs) >= 0""")
def daily_qc_of_grid(s, d):
    """Shares of the grid's 100 cells, of which many have no observation on a date."""
    obs = stored(_obs(s, d), "observations")
    return monthly.daily_quality(obs, statistics.water_statistics(obs, keys=KEYS), keys=KEYS, cells=100)


def _both(s, d):
    """The month's composite by cell, and the statistics; daily observations are merged and written once."""
    obs = stored(_obs(s, d), "observations")
    stats = stored(statistics.water_statistics(obs, keys=["cell_id", "row_i", "col_i"]), "statistics")
    passed = monthly.passing(obs, monthly.daily_quality(obs, stats, keys=KEYS))
    return monthly.monthly_vote(passed, stats, keys=("cell_id", "row_i", "col_i")), stats


def _monthly(s, d):
    return _both(s, d)[0]


@query(f"WITH {STATS}, {QUALITY}, {VOTE} SELECT month_key, cell_id, cls FROM monthly WHERE (SELECT count(*) FROM v_obs) >= 0")
def monthly_vote(s, d):
    return _monthly(s, d).select("month_key", "cell_id", "cls")


@query(f"WITH {STATS}, {QUALITY.replace('<= 0.3)', '<= 0.3 AND q.water_frac >= 0.1)')}, {VOTE} SELECT month_key, cell_id, cls FROM monthly WHERE (SELECT count(*) FROM v_obs) >= 0")
def monthly_vote_min_water(s, d):
    obs = stored(_obs(s, d), "observations")
    stats = stored(statistics.water_statistics(obs, keys=["cell_id", "row_i", "col_i"]), "statistics")
    passed = monthly.passing(obs, monthly.daily_quality(obs, stats, MonthlyParams(min_daily_water=0.1), KEYS))
    return monthly.monthly_vote(passed, stats, keys=("cell_id",))


# --- cleaning

DENSE = """dense AS (
  SELECT m.month_key, c.cell_id, CAST(coalesce(o.cls, 255) AS INT) AS cls FROM (SELECT DISTINCT month_key FROM monthly) m CROSS JOIN (SELECT DISTINCT cell_id FROM monthly) c
    LEFT JOIN monthly o ON o.month_key = m.month_key AND o.cell_id = c.cell_id
), masked AS (
  SELECT d.*, w.mode_class, CASE WHEN w.persistent THEN 1 WHEN w.stable_land AND d.cls IN (1, 2) THEN 0 ELSE d.cls END AS cleaned,
    CASE WHEN w.persistent AND d.cls NOT IN (1, 2, 3, 4) THEN 2 WHEN NOT w.persistent AND w.stable_land AND d.cls IN (1, 2) THEN 3 ELSE 0 END AS confidence
  FROM dense d JOIN wstats w ON d.cell_id = w.cell_id
)"""

FILLED = """tried AS (
  SELECT *, coalesce(lag(u, 1) OVER o, lead(u, 1) OVER o, lag(u, 2) OVER o, lead(u, 2) OVER o, lag(u, 3) OVER o, lead(u, 3) OVER o) AS near
  FROM (SELECT *, CASE WHEN {ok} THEN cls END AS u FROM masked) x WINDOW o AS (PARTITION BY cell_id ORDER BY month_key)
), filled AS (
  SELECT month_key, cell_id, CAST(CASE WHEN cleaned IN (9, 255) THEN coalesce(near, mode_class, 255) ELSE cleaned END AS INT) AS cls,
    CAST(CASE WHEN cleaned IN (9, 255) THEN greatest(confidence, CASE WHEN near IS NOT NULL THEN 4 ELSE 5 END) ELSE confidence END AS INT) AS confidence FROM tried
)"""


def _fill(with_inwam: bool):
    def run(s, d):
        m, stats = _both(s, d)
        masked = clean.apply_masks(clean.densify(m.select("month_key", "cell_id", "cls"), KEYS), stats, KEYS)
        return clean.temporal_fill(masked, with_inwam=with_inwam, keys=KEYS).select("month_key", "cell_id", F.col("cleaned").cast("int").alias("cls"), "confidence")

    return run


@query(f"WITH {STATS}, {QUALITY}, {VOTE}, {DENSE} SELECT month_key, cell_id, cls, CAST(cleaned AS INT) AS cleaned, CAST(confidence AS INT) AS confidence FROM masked WHERE (SELECT count(*) FROM v_obs) >= 0")
def mask_chain(s, d):
    m, stats = _both(s, d)
    return clean.apply_masks(clean.densify(m.select("month_key", "cell_id", "cls"), KEYS), stats, KEYS).select("month_key", "cell_id", "cls", "cleaned", "confidence")


@query(f"WITH {STATS}, {QUALITY}, {VOTE}, {DENSE}, {FILLED.format(ok='cls IN (1, 2)')} SELECT * FROM filled WHERE (SELECT count(*) FROM v_obs) >= 0")
def temporal_fill(s, d):
    return _fill(True)(s, d)


@query(f"WITH {STATS}, {QUALITY}, {VOTE}, {DENSE}, {FILLED.format(ok='cls NOT IN (9, 255)')} SELECT * FROM filled WHERE (SELECT count(*) FROM v_obs) >= 0")
def temporal_fill_without_inwam(s, d):
    return _fill(False)(s, d)


#: Labels of water bodies by recursion; {{near}} says which cells are neighbours.
BODIES = """wet AS (SELECT month_key, cell_id, cell_id // 10 AS r, cell_id % 10 AS c FROM {of} WHERE cls IN (1, 2, 3, 4)
), reach AS (
  SELECT month_key, cell_id, r, c, cell_id AS root FROM wet
  UNION SELECT w.month_key, w.cell_id, w.r, w.c, x.root FROM reach x JOIN wet w ON w.month_key = x.month_key AND {near}
), labels AS (SELECT month_key, cell_id, min(r) AS r, min(c) AS c, min(root) AS component FROM reach GROUP BY month_key, cell_id)"""
EIGHT = "abs(w.r - x.r) <= 1 AND abs(w.c - x.c) <= 1"
FOUR = "abs(w.r - x.r) + abs(w.c - x.c) <= 1"


@query(f"""WITH RECURSIVE {STATS}, {QUALITY}, {VOTE}, {DENSE}, {FILLED.format(ok='cls IN (1, 2)')}, {BODIES.format(of='filled', near=EIGHT)},
small AS (SELECT month_key, component FROM labels GROUP BY month_key, component HAVING count(*) < 9)
SELECT f.month_key, f.cell_id, CAST(CASE WHEN s.component IS NOT NULL THEN 0 ELSE f.cls END AS INT) AS cls, f.confidence
FROM filled f LEFT JOIN labels l ON f.month_key = l.month_key AND f.cell_id = l.cell_id LEFT JOIN small s ON l.month_key = s.month_key AND l.component = s.component WHERE (SELECT count(*) FROM v_obs) >= 0""")
def despeckle(s, d):
    m, stats = _both(s, d)
    return clean.clean_monthly(m.select("month_key", "row_i", "col_i", "cls"), stats).select("month_key", (F.col("row_i") * 10 + F.col("col_i")).alias("cell_id"), "cls", "confidence")


# --- metrics


@query(f"""WITH {STATS}, {QUALITY}, {VOTE}
SELECT m.month_key, count(*) FILTER (WHERE cls IN (1, 2, 3, 4)) * 0.0009E0 AS total_area_km2, count(*) FILTER (WHERE cls IN (1, 2, 3, 4) AND water_prob >= 0.8) * 0.0009E0 AS permanent_area_km2,
  count(*) FILTER (WHERE cls IN (1, 2, 3, 4) AND water_prob >= 0.15 AND water_prob < 0.8) * 0.0009E0 AS seasonal_area_km2, count(*) FILTER (WHERE cls IN (1, 2, 3, 4) AND water_prob > 0 AND water_prob < 0.15) * 0.0009E0 AS ephemeral_area_km2,
  count(*) FILTER (WHERE cls IN (1, 2)) * 0.0009E0 AS high_conf_area_km2, count(*) FILTER (WHERE cls = 3) * 0.0009E0 AS partial_area_km2, count(*) FILTER (WHERE cls <> 255) AS valid_pixels,
  CAST(count(*) FILTER (WHERE cls = 9) AS DOUBLE) / count(*) AS cloud_fraction
FROM monthly m JOIN wstats w ON m.cell_id = w.cell_id WHERE (SELECT count(*) FROM v_obs) >= 0 GROUP BY m.month_key""")
def month_area_metrics(s, d):
    m, stats = _both(s, d)
    return metrics.month_areas(m, stats, 0.0009, keys=KEYS)


#: Weights of border cells by the code of their neighbourhood, as in the operator.
PERIMETER = """border AS (
  SELECT l.* FROM labels l WHERE (SELECT count(*) FROM labels x WHERE x.month_key = l.month_key AND x.component = l.component AND abs(x.r - l.r) + abs(x.c - l.c) = 1) < 4
), codes AS (
  SELECT a.month_key, a.component, a.cell_id, sum(CASE WHEN a.cell_id = b.cell_id THEN 1 WHEN abs(a.r - b.r) + abs(a.c - b.c) = 1 THEN 2 ELSE 10 END) AS v
  FROM border a JOIN border b ON a.month_key = b.month_key AND a.component = b.component AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.month_key, a.component, a.cell_id
), lengths AS (
  SELECT month_key, component, sum(CASE WHEN v IN (5, 7, 15, 17, 25, 27) THEN 1.0E0 WHEN v IN (21, 33) THEN sqrt(2.0E0) WHEN v IN (13, 23) THEN (1 + sqrt(2.0E0)) / 2 ELSE 0.0E0 END) AS perimeter FROM codes GROUP BY month_key, component
)"""


@query(f"""WITH RECURSIVE {STATS}, {QUALITY}, {VOTE}, {BODIES.format(of='monthly', near=FOUR)}, {PERIMETER},
sizes AS (SELECT month_key, component, count(*) AS n FROM labels GROUP BY month_key, component HAVING count(*) >= 10),
bodies AS (SELECT s.month_key, count(*) AS k, avg(s.n * 0.0009E0) AS mean_km2, max(s.n * 0.0009E0) AS max_km2, sum(p.perimeter) AS p FROM sizes s LEFT JOIN lengths p ON s.month_key = p.month_key AND s.component = p.component GROUP BY s.month_key),
whole AS (SELECT month_key, count(*) AS n, avg(r) AS r, avg(c) AS c FROM wet GROUP BY month_key)
SELECT m.month_key, coalesce(b.k, 0) AS num_water_bodies, round(coalesce(b.mean_km2, 0), 9) AS mean_body_size_km2, round(coalesce(b.max_km2, 0), 9) AS max_body_size_km2, round(coalesce(b.p / (w.n + 1e-10), 0), 6) AS fragmentation_index,
  round(CASE WHEN b.k IS NULL THEN 0.0E0 ELSE 30.0E0 * w.c + 1000 END, 6) AS centroid_x, round(CASE WHEN b.k IS NULL THEN 0.0E0 ELSE -30.0E0 * w.r + 5000 END, 6) AS centroid_y
FROM (SELECT DISTINCT month_key FROM monthly) m LEFT JOIN bodies b ON m.month_key = b.month_key LEFT JOIN whole w ON m.month_key = w.month_key WHERE (SELECT count(*) FROM v_obs) >= 0""")
def body_metrics(s, d):
    grid = {"a": 30.0, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -30.0, "f": 5000.0}
    x = metrics.body_metrics(_monthly(s, d).select("month_key", "row_i", "col_i", "cls"), 0.0009, grid)
    return x.select("month_key", F.col("num_water_bodies").cast("long").alias("num_water_bodies"), *(F.round(c, 9 if "size" in c else 6).alias(c) for c in ("mean_body_size_km2", "max_body_size_km2", "fragmentation_index", "centroid_x", "centroid_y")))


@query(f"WITH {STATS} SELECT cell_id, water_prob >= 0.8 AS permanent, water_prob >= 0.15 AND water_prob < 0.8 AS seasonal, water_prob > 0 AND water_prob < 0.15 AS ephemeral, water_prob > 0 AS any_water FROM wstats WHERE (SELECT count(*) FROM v_obs) >= 0")
def water_kinds(s, d):
    return _stats(s, d).select("cell_id", *(c.alias(k) for k, c in metrics.water_kinds(F.col("water_prob")).items()))


@query("""
WITH raw AS (SELECT DISTINCT month_key, 0 AS cleaned FROM v_obs), done AS (SELECT DISTINCT month_key, 1 AS cleaned FROM v_obs WHERE month_key % 2 = 0)
SELECT * FROM done UNION ALL SELECT * FROM raw WHERE month_key NOT IN (SELECT month_key FROM done)""")
def one_per_month(s, d):
    raw = _obs(s, d).select("month_key").distinct()
    return metrics.one_per_month(raw.where("month_key % 2 = 0").withColumn("cleaned", F.lit(1)), raw.withColumn("cleaned", F.lit(0)))


# --- series


@query("""SELECT month_i, round(avg(area_km2), 6) AS area_km2_mean, round(stddev_samp(area_km2), 6) AS area_km2_std, round(avg(bodies), 6) AS bodies_mean, round(stddev_samp(bodies), 6) AS bodies_std
FROM v_series GROUP BY month_i""")
def climatology(s, d):
    x = series.climatology(view(s, d, "v_series"), ["area_km2", "bodies"])
    return x.select("month_i", *(F.round(c, 6).alias(c) for c in x.columns[1:]))


@query("""WITH m AS (SELECT *, avg(area_km2) OVER w AS mu, stddev_samp(area_km2) OVER w AS sd FROM v_series WINDOW w AS (PARTITION BY month_i))
SELECT month_key, round(area_km2 - mu, 6) AS anomaly, round((area_km2 - mu) / (sd + 1e-10), 5) AS anomaly_std FROM m""")
def anomaly(s, d):
    x = series.anomalies(view(s, d, "v_series"), "area_km2")
    return x.select("month_key", F.round("area_km2_anomaly", 6).alias("anomaly"), F.round("area_km2_anomaly_std", 5).alias("anomaly_std"))


@query("""WITH b AS (SELECT month_i, avg(area_km2) AS mu, stddev_samp(area_km2) AS sd FROM v_series WHERE month_key >= 199305 AND month_key <= 199602 GROUP BY month_i)
SELECT v.month_key, round(area_km2 - coalesce(mu, 0), 6) AS anomaly, round((area_km2 - coalesce(mu, 0)) / (CASE WHEN b.month_i IS NULL THEN 1 ELSE sd END + 1e-10), 5) AS anomaly_std FROM v_series v LEFT JOIN b ON v.month_i = b.month_i""")
def anomaly_baseline(s, d):
    x = series.anomalies(view(s, d, "v_series"), "area_km2", baseline=(199305, 199602))
    return x.select("month_key", F.round("area_km2_anomaly", 6).alias("anomaly"), F.round("area_km2_anomaly_std", 5).alias("anomaly_std"))


@query("""SELECT min(month_key) AS start_month, max(month_key) AS end_month, count(*) AS n_months, count(DISTINCT year_i) AS n_years, round(avg(area_km2), 5) AS area_km2_mean, round(stddev_samp(area_km2), 5) AS area_km2_std,
  round(min(area_km2), 5) AS area_km2_min, round(max(area_km2), 5) AS area_km2_max, round(median(area_km2), 5) AS area_km2_median FROM v_series""")
def summary_stats(s, d):
    x = series.summary(view(s, d, "v_series"), ["area_km2"])
    return x.select("start_month", "end_month", "n_months", "n_years", *(F.round(c, 5).alias(c) for c in x.columns[4:]))


@query("""WITH t AS (SELECT v.area_km2, CAST(v.bodies AS DOUBLE) AS bodies, i.index_value FROM v_series v JOIN v_index i ON v.month_key = i.month_key),
c AS (SELECT corr(area_km2, bodies) AS ab, corr(area_km2, index_value) AS ai, corr(bodies, index_value) AS bi FROM t)
SELECT x, y, round(r, 6) AS r FROM (SELECT 'area_km2' AS x, 'area_km2' AS y, 1.0E0 AS r FROM c UNION ALL SELECT 'area_km2', 'bodies', ab FROM c UNION ALL SELECT 'area_km2', 'index_value', ai FROM c
  UNION ALL SELECT 'bodies', 'area_km2', ab FROM c UNION ALL SELECT 'bodies', 'bodies', 1.0E0 FROM c UNION ALL SELECT 'bodies', 'index_value', bi FROM c
  UNION ALL SELECT 'index_value', 'area_km2', ai FROM c UNION ALL SELECT 'index_value', 'bodies', bi FROM c UNION ALL SELECT 'index_value', 'index_value', 1.0E0 FROM c) u""")
def corr_matrix(s, d):
    both = view(s, d, "v_series").join(view(s, d, "v_index"), "month_key").select("area_km2", F.col("bodies").cast("double").alias("bodies"), "index_value")
    return series.correlations(both, ["area_km2", "bodies", "index_value"]).withColumn("r", F.round("r", 6))


@query("""WITH t AS (SELECT v.area_km2 AS x, i.index_value AS y FROM v_series v JOIN v_index i ON v.month_key = i.month_key),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0E0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0E0 AS b FROM t) SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman(s, d):
    pairs = compare.paired(view(s, d, "v_series"), view(s, d, "v_index"), "area_km2", "index_value")
    return series.rank_correlation(pairs, "x", "y").select(F.round("rho", 6).alias("rho"))


@query("""WITH e AS (SELECT min(area_km2) AS lo, max(area_km2) AS hi FROM v_series)
SELECT CAST(least(29, floor((area_km2 - lo) / ((hi - lo) / 30))) AS INT) AS bin, count(*) AS n FROM v_series, e GROUP BY 1""")
def histogram(s, d):
    return series.histogram(view(s, d, "v_series"), "area_km2", 30)


@query("""SELECT year_i, round(min(area_km2), 6) AS low, round(quantile_cont(area_km2, 0.25), 6) AS q1, round(quantile_cont(area_km2, 0.5), 6) AS q2, round(quantile_cont(area_km2, 0.75), 6) AS q3, round(max(area_km2), 6) AS high FROM v_series GROUP BY year_i""")
def yearly_quartiles(s, d):
    x = series.quartiles(view(s, d, "v_series"), "area_km2")
    return x.select("year_i", *(F.round(c, 6).alias(c) for c in x.columns[1:]))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY month_key) - 1 AS i, area_km2 FROM v_series)
SELECT count(*) AS n, round(regr_slope(area_km2, i), 8) AS slope, round(regr_intercept(area_km2, i), 6) AS intercept, round(regr_r2(area_km2, i), 8) AS r_squared,
  round(sqrt((1 - regr_r2(area_km2, i)) * regr_syy(area_km2, i) / regr_sxx(area_km2, i) / (count(*) - 2)), 8) AS stderr FROM t""")
def linear_trend(s, d):
    x = series.linear_trend(view(s, d, "v_series"), "area_km2", p_value=False)
    return x.select("n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r_squared", 8).alias("r_squared"), F.round("stderr", 8).alias("stderr"))


@query("""WITH t AS (SELECT row_number() OVER (ORDER BY month_key) - 1 AS i, area_km2 AS v FROM v_series), s AS (SELECT sum(sign(b.v - a.v)) AS s FROM t a JOIN t b ON b.i > a.i), c AS (SELECT count(*) AS n FROM t)
SELECT CAST(s AS DOUBLE) AS s, n, round(n * (n - 1) * (2 * n + 5) / 18.0E0, 6) AS var_s, round((s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0E0), 6) AS z FROM s, c""")
def mann_kendall_s(s, d):
    x = series.mann_kendall(view(s, d, "v_series"), "area_km2", p_value=False)
    return x.select("s", "n", F.round("var_s", 6).alias("var_s"), F.round("z", 6).alias("z"))


@query("WITH t AS (SELECT row_number() OVER (ORDER BY month_key) - 1 AS i, area_km2 AS v FROM v_series) SELECT round(median((b.v - a.v) / (b.i - a.i)), 8) AS slope FROM t a JOIN t b ON b.i > a.i")
def sens_slope(s, d):
    return series.sens_slope(view(s, d, "v_series"), "area_km2").select(F.round("slope", 8).alias("slope"))


@query()
def trend_p_values(s, d):
    v = view(s, d, "v_series")
    a = series.linear_trend(v, "area_km2").select(F.lit("linear").alias("method"), "slope", "p_value")
    b = series.mann_kendall(v, "area_km2").select(F.lit("mann-kendall").alias("method"), F.col("z").alias("slope"), "p_value")
    return a.unionByName(b)


@query()
def stl(s, d):
    return series.decompose(view(s, d, "v_series"), "area_km2")


# --- comparison

PAIRS = "t AS (SELECT v.month_key, v.area_km2 AS x, i.index_value AS y FROM v_series v JOIN v_index i ON v.month_key = i.month_key)"
PHASES = f"{PAIRS}, p AS (SELECT *, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS z FROM t), q AS (SELECT *, CASE WHEN z > 0.5 THEN 'positive' WHEN z < -0.5 THEN 'negative' ELSE 'neutral' END AS phase FROM p)"


def _pairs(s, d):
    return compare.paired(view(s, d, "v_series"), view(s, d, "v_index"), "area_km2", "index_value")


@query(f"WITH {PAIRS} SELECT * FROM t WHERE (SELECT count(*) FROM v_index) >= 0 AND (SELECT count(*) FROM v_series) >= 0")
def paired_series(s, d):
    return _pairs(s, d)


LAGS = f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (ORDER BY month_key) - 1 AS i FROM t), g AS (SELECT CAST(unnest(generate_series(-12, 12)) AS INT) AS lag),
l AS (SELECT g.lag, count(*) AS n, corr(a.x, b.y) AS r FROM g JOIN n a ON true JOIN n b ON b.i = a.i - g.lag WHERE (SELECT count(*) FROM t) >= 24 GROUP BY g.lag)"""
USED = "(SELECT count(*) FROM v_index) >= 0 AND (SELECT count(*) FROM v_series) >= 0"


@query(f"{LAGS} SELECT lag, n, round(r, 6) AS r FROM l WHERE {USED}")
def cross_corr(s, d):
    return compare.cross_correlation(_pairs(s, d)).withColumn("r", F.round("r", 6))


@query(f"{LAGS} SELECT lag, round(r, 6) AS r, CASE WHEN lag < 0 THEN 'water leads index' WHEN lag > 0 THEN 'index leads water' ELSE 'in phase' END AS meaning FROM l WHERE {USED} ORDER BY abs(r) DESC, lag LIMIT 1")
def best_lag(s, d):
    return compare.best_lag(compare.cross_correlation(_pairs(s, d))).withColumn("r", F.round("r", 6))


@query(f"WITH {PHASES} SELECT phase, count(*) AS n, round(avg(x), 6) AS mean_x FROM q WHERE {USED} GROUP BY phase")
def composite_phase(s, d):
    return compare.phase_means(compare.phases(_pairs(s, d))).withColumn("mean_x", F.round("mean_x", 6))


@query(f"WITH {PHASES} SELECT phase, CAST(month_key % 100 AS INT) AS month_i, round(avg(x), 6) AS mean_x FROM q WHERE {USED} GROUP BY 1, 2")
def phase_months(s, d):
    return compare.phase_months(compare.phases(_pairs(s, d))).withColumn("mean_x", F.round("mean_x", 6))


@query(f"""WITH {PHASES}, g AS (SELECT phase, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM q GROUP BY phase), a AS (SELECT avg(x) AS m FROM q), k AS (SELECT count(*) AS k, sum(n) AS n FROM g)
SELECT CAST(max(k.k) - 1 AS DOUBLE) AS df_between, CAST(max(k.n) - max(k.k) AS DOUBLE) AS df_within, round((sum(g.n * (g.m - a.m) * (g.m - a.m)) / (max(k.k) - 1)) / (sum(g.n * g.v) / (max(k.n) - max(k.k))), 6) AS f_stat FROM g, a, k WHERE {USED}""")
def anova_f(s, d):
    return compare.anova(compare.phases(_pairs(s, d)), p_value=False).withColumn("f_stat", F.round("f_stat", 6))


@query()
def anova_p(s, d):
    return compare.anova(compare.phases(_pairs(s, d)))


@query(f"WITH {PAIRS} SELECT round(1.96 / sqrt(100.0E0), 9) AS band FROM (SELECT count(*) AS n FROM t) x WHERE {USED}")
def significance_band(s, d):
    return compare.significance(_pairs(s, d)).select(F.round("band", 9).alias("band"))


# --- derivatives

FREQ = "f AS (SELECT cell_id, 100.0E0 * CASE WHEN v = 0 THEN 0.0E0 ELSE CAST(w AS DOUBLE) / v END AS water_pct FROM (SELECT cell_id, count(*) FILTER (WHERE cls < 250) AS v, count(*) FILTER (WHERE cls IN (1, 2)) AS w FROM v_dswx GROUP BY cell_id) c)"
#: Each observation with the rank of its date among all dates of the stack, from the first on and from the last on.
RANKED = """days AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS a, row_number() OVER (ORDER BY obs_date DESC) AS z FROM (SELECT DISTINCT obs_date FROM v_dswx) q),
k AS (SELECT v.*, d.a, d.z FROM v_dswx v JOIN days d ON v.obs_date = d.obs_date)"""
ENDS = f"""{RANKED}, e AS (SELECT cell_id, arg_min(cls, a) FILTER (WHERE a <= 3 AND cls <= 250) AS initial, arg_min(cls, z) FILTER (WHERE z <= 3 AND cls <= 250) AS final FROM k GROUP BY cell_id)"""


@query(f"WITH {FREQ} SELECT cell_id, water_pct FROM f WHERE (SELECT count(*) FROM v_dswx) >= 0")
def water_frequency(s, d):
    return derivatives.water_frequency(_dswx(s, d), KEYS)


@query(f"WITH {FREQ} SELECT cell_id, water_pct, CASE WHEN water_pct >= 95 THEN 2 WHEN water_pct > 0 THEN 1 ELSE 0 END AS persistence, CASE WHEN water_pct = 100 THEN 2 WHEN water_pct > 0 THEN 1 ELSE 0 END AS season_type FROM f WHERE (SELECT count(*) FROM v_dswx) >= 0")
def persistence(s, d):
    return derivatives.season_type(derivatives.persistence(derivatives.water_frequency(_dswx(s, d), KEYS)))


@query(f"""WITH {RANKED} SELECT cell_id, (count(*) FILTER (WHERE z <= 3 AND cls IN (1, 2)) - count(*) FILTER (WHERE a <= 3 AND cls IN (1, 2))) / 3.0E0 AS change
FROM k WHERE (SELECT count(*) FROM v_dswx) >= 0 GROUP BY cell_id""")
def water_change(s, d):
    return derivatives.water_change(_dswx(s, d), keys=KEYS)


@query(f"WITH {ENDS} SELECT cell_id, initial, final FROM e WHERE (SELECT count(*) FROM v_dswx) >= 0")
def first_valid_composite(s, d):
    return derivatives.first_and_last(stored(_dswx(s, d), "stack"), KEYS)


@query(f"""WITH {ENDS} SELECT cell_id, CASE WHEN initial = 1 AND final = 1 THEN 0 WHEN initial = 0 AND final = 1 THEN 1 WHEN initial = 1 AND final = 0 THEN 2 WHEN initial = 2 AND final = 2 THEN 3 WHEN initial = 0 AND final = 2 THEN 4
  WHEN initial = 2 AND final = 0 THEN 5 WHEN initial = 1 AND final = 2 THEN 6 WHEN initial = 2 AND final = 1 THEN 7 END AS transition FROM e WHERE (SELECT count(*) FROM v_dswx) >= 0""")
def transitions(s, d):
    ends = derivatives.first_and_last(stored(_dswx(s, d), "stack"), KEYS)
    return ends.select("cell_id", derivatives.transitions(F.col("initial"), F.col("final")).alias("transition"))


@query(f"WITH {ENDS}, {FREQ} SELECT e.cell_id, CASE WHEN NOT ((initial = 0 AND final = 0) OR water_pct >= 95) THEN final - initial END AS change FROM e JOIN f ON e.cell_id = f.cell_id WHERE (SELECT count(*) FROM v_dswx) >= 0")
def change_map(s, d):
    stack = stored(_dswx(s, d), "stack")
    return derivatives.change_map(derivatives.first_and_last(stack, KEYS), derivatives.water_frequency(stack, KEYS), keys=KEYS)


@query("SELECT obs_date, CASE WHEN cls <= 200 THEN cls END AS cls FROM v_dswx WHERE cell_id = 42")
def pixel_series(s, d):
    return derivatives.pixel_series(_dswx(s, d), {"cell_id": 42})


# --- elevation


@query("SELECT elev AS level FROM v_dem WHERE elev >= 0 GROUP BY elev ORDER BY count(*) DESC, elev LIMIT 1")
def dem_mode(s, d):
    return elevation.dem_mode(view(s, d, "v_dem"))


#: Shores of the month's composite on the 10 x 10 grid, where the size limits fall below one cell. Cloud grows by one step.
EDGES = """grid AS (SELECT month_key, cell_id, cell_id // 10 AS r, cell_id % 10 AS c, CASE WHEN cls IN (1, 2) THEN 1 WHEN cls IN (0, 3) THEN 0 ELSE 5 END AS state FROM monthly),
edge AS (SELECT g.month_key, g.cell_id FROM grid g WHERE g.state = 0
  AND EXISTS (SELECT 1 FROM grid x WHERE x.month_key = g.month_key AND x.state = 1 AND abs(x.r - g.r) + abs(x.c - g.c) <= 1)
  AND NOT EXISTS (SELECT 1 FROM grid x WHERE x.month_key = g.month_key AND x.state = 5 AND abs(x.r - g.r) + abs(x.c - g.c) <= 1))"""


def _edges(s, d):
    m = _monthly(s, d).select("month_key", "row_i", "col_i", "cls")
    return elevation.water_edges(m, ["month_key"], 100, cloud_steps=1)


@query(f"WITH {STATS}, {QUALITY}, {VOTE}, {EDGES} SELECT month_key, cell_id FROM edge WHERE (SELECT count(*) FROM v_obs) >= 0")
def water_edge(s, d):
    return _edges(s, d).select("month_key", (F.col("row_i") * 10 + F.col("col_i")).alias("cell_id"))


@query(f"""WITH {STATS}, {QUALITY}, {VOTE}, {EDGES}, level AS (SELECT elev AS level FROM v_dem WHERE elev >= 0 GROUP BY elev ORDER BY count(*) DESC, elev LIMIT 1),
x AS (SELECT e.month_key, v.elev, l.level, round_even(v.elev, 0) AS re FROM edge e JOIN v_dem v ON e.cell_id = v.cell_id, level l),
modes AS (SELECT month_key, arg_max(re, n * 1000000 - re) AS mode_elev, count(*) AS k FROM (SELECT month_key, re, count(*) AS n FROM x WHERE re <> round_even(level, 0) GROUP BY month_key, re) c GROUP BY month_key),
st AS (SELECT month_key, median(elev) FILTER (WHERE elev <> level) AS median_elev, stddev_pop(elev) FILTER (WHERE elev <> level) AS std_elev, count(*) AS n FROM x GROUP BY month_key)
SELECT s.month_key, round(CASE WHEN m.k > 1 THEN median_elev END, 6) AS median_elev, round(CASE WHEN m.k > 1 THEN mode_elev END, 6) AS mode_elev, round(CASE WHEN m.k > 1 THEN std_elev END, 6) AS std_elev, CASE WHEN m.k > 1 THEN s.n END AS n
FROM st s LEFT JOIN modes m ON s.month_key = m.month_key WHERE (SELECT count(*) FROM v_obs) >= 0""".replace("modes AS (SELECT month_key", "emodes AS (SELECT month_key").replace("JOIN modes m ON s.month_key", "JOIN emodes m ON s.month_key"))
def edge_elevation(s, d):
    dem = view(s, d, "v_dem")
    x = elevation.edge_elevation(_edges(s, d), dem, elevation.dem_mode(dem), ["month_key"])
    return x.select("month_key", *(F.round(c, 6).alias(c) for c in ("median_elev", "mode_elev", "std_elev")), "n")


# --- altimetry


@query("""SELECT file_id, lake_id, lake_name, wse, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY dist, lake_id) AS rn
  FROM (SELECT *, sqrt((x_m - 5000) * (x_m - 5000) + (y_m - 4800) * (y_m - 4800)) AS dist FROM v_lake) a WHERE dist <= 5000) b WHERE rn = 1""")
def nearest_lake(s, d):
    x = altimetry.nearest_feature(view(s, d, "v_lake"), 5000.0, 4800.0)
    return x.select("file_id", "lake_id", "lake_name", "wse", F.round("distance", 6).alias("distance"))


@query("""SELECT file_id, lake_id, lake_name FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN lower(lake_name) = 'lake 1' THEN 0 WHEN contains(lower(lake_name), 'lake 1') THEN 1 ELSE 2 END, dist, lake_id) AS rn
  FROM (SELECT *, sqrt((x_m - 5000) * (x_m - 5000) + (y_m - 4800) * (y_m - 4800)) AS dist FROM v_lake) a WHERE dist <= 5000) b WHERE rn = 1""")
def name_tier(s, d):
    return altimetry.nearest_feature(view(s, d, "v_lake"), 5000.0, 4800.0, preferred="Lake 1").select("file_id", "lake_id", "lake_name")


@query("SELECT file_id, lake_id, lake_name, wse FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY lake_id) AS rn FROM v_lake WHERE contains(lower(lake_name), 'lake 2')) t WHERE rn = 1")
def first_match(s, d):
    return altimetry.first_match(view(s, d, "v_lake"), "LAKE 2").select("file_id", "lake_id", "lake_name", "wse")


@query("SELECT lake_name, file_id, lake_id FROM (SELECT *, row_number() OVER (PARTITION BY lake_name ORDER BY file_id, lake_id) AS rn FROM v_lake) t WHERE rn = 1")
def unique_lakes(s, d):
    return altimetry.unique_lakes(view(s, d, "v_lake")).select("lake_name", "file_id", "lake_id")


@query("SELECT lake_name FROM v_lake GROUP BY lake_name ORDER BY count(*) DESC, lake_name LIMIT 1")
def common_name(s, d):
    return altimetry.common_name(view(s, d, "v_lake"))


@query("""SELECT file_id, y, x, wse FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY abs(lat - 34.55) + abs(lon + 119.31), y, x) AS rn, min(lat) OVER f AS s0, max(lat) OVER f AS s1, min(lon) OVER f AS w0, max(lon) OVER f AS w1
  FROM v_swath WINDOW f AS (PARTITION BY file_id)) t WHERE rn = 1 AND 34.55 BETWEEN s0 AND s1 AND -119.31 BETWEEN w0 AND w1""")
def nearest_cell(s, d):
    return altimetry.nearest_cell(view(s, d, "v_swath"), 34.55, -119.31)


@query("SELECT obs_date, path, tier FROM (SELECT *, min(tier) OVER (PARTITION BY obs_date) AS best FROM (SELECT granule AS obs_date, path, CASE WHEN contains(path, '_WTR.') THEN 0 WHEN contains(path, '_WTR-2.') THEN 1 ELSE 2 END AS tier FROM v_file) a) b WHERE tier = best")
def source_tier(s, d):
    files = view(s, d, "v_file").select(F.col("granule").alias("obs_date"), "path")
    return altimetry.best_tier(files, ["_WTR.", "_WTR-2.", "_CONF."])


@query("""SELECT lake_id, CAST(floor((lon + 180) / 6) + 1 AS INT) || substr('CDEFGHJKLMNPQRSTUVWX', CAST(greatest(1, least(20, floor((lat + 80) / 8) + 1)) AS INT), 1) AS zone
FROM (SELECT lake_id, x_m / 60.0E0 - 80 AS lat, y_m / 30.0E0 - 160 AS lon FROM v_lake) t""")
def utm_zone(s, d):
    return view(s, d, "v_lake").select("lake_id", geo.utm_zone(F.col("x_m") / 60.0 - 80, F.col("y_m") / 30.0 - 160).alias("zone"))


@query("SELECT lake_id, round(6378137.0E0 * radians(lon), 3) AS x, round(6378137.0E0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM (SELECT lake_id, x_m / 100.0E0 - 50 AS lat, y_m / 50.0E0 - 100 AS lon FROM v_lake) t")
def mercator(s, d):
    x = view(s, d, "v_lake").select("lake_id", geo.mercator(F.col("y_m") / 50.0 - 100, F.col("x_m") / 100.0 - 50).alias("p"))
    return x.select("lake_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("SELECT lake_id, x_m >= 2000 AND x_m < 7000 AND y_m >= 1000 AND y_m < 8000 AND NOT (x_m >= 4000 AND y_m >= 5000) AS inside FROM v_lake")
def point_in_polygon(s, d):
    ring = F.array(*(F.struct(F.lit(x - 1.0).alias("x"), F.lit(y - 1.0).alias("y")) for x, y in ((2000, 1000), (7000, 1000), (7000, 5000), (4000, 5000), (4000, 8000), (2000, 8000))))
    return view(s, d, "v_lake").select("lake_id", spatial.inside(F.col("x_m"), F.col("y_m"), ring).alias("inside"))


# --- resampling, gauges


@query("SELECT CAST(ts AS DATE) AS day, cell_id, round(avg(tp), 6) AS tp FROM v_hourly GROUP BY 1, 2")
def daily_mean(s, d):
    return resample.daily_mean(view(s, d, "v_hourly"), ["tp"], ["cell_id"]).withColumn("tp", F.round("tp", 6))


@query("SELECT CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week, cell_id, round(sum(tp), 4) AS tp FROM v_hourly GROUP BY 1, 2")
def weekly_sum(s, d):
    return resample.weekly(view(s, d, "v_hourly"), sums=["tp"], keys=["cell_id"]).withColumn("tp", F.round("tp", 4))


@query("SELECT week, cell_id, CASE WHEN tp > 50 THEN round(tp, 6) END AS tp FROM (SELECT CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS DATE) AS week, cell_id, avg(tp) AS tp FROM v_hourly GROUP BY 1, 2) t")
def masked_weekly(s, d):
    return resample.above(resample.weekly(view(s, d, "v_hourly"), means=["tp"], keys=["cell_id"]), "tp", 50).withColumn("tp", F.round("tp", 6))


@query("SELECT cell_id, round(avg(tp), 6) AS tp FROM v_hourly GROUP BY cell_id")
def time_mean(s, d):
    return resample.time_mean(view(s, d, "v_hourly"), ["tp"], ["cell_id"]).withColumn("tp", F.round("tp", 6))


GAUGE = "g AS (SELECT event_id, d, nullif(TRY_CAST(feet AS DOUBLE), 0) * 0.3048 - 1 AS level FROM v_gauge)"


def _gauge(s, d):
    return view(s, d, "v_gauge").select("event_id", "d", names.gauge_metres(F.col("feet"), -1.0).alias("level"))


@query(f"WITH {GAUGE}, l AS (SELECT avg(level) AS m, stddev_pop(level) AS s FROM g) SELECT event_id, d, round(level, 6) AS level FROM g, l WHERE level > m - 3 * s AND level < m + 3 * s AND (SELECT count(*) FROM v_gauge) >= 0")
def gauge_outliers(s, d):
    return resample.without_outliers(_gauge(s, d), "level").withColumn("level", F.round("level", 6))


@query(f"WITH {GAUGE} SELECT round(1.96 * stddev_pop(level) / sqrt(count(level)), 6) AS error FROM g WHERE (SELECT count(*) FROM v_gauge) >= 0")
def standard_error(s, d):
    return resample.standard_error(_gauge(s, d), "level").select(F.round("error", 6).alias("error"))


# --- catalogues


@query("""SELECT o_orderkey, scene_id FROM (SELECT *, TRY_CAST(regexp_replace(split_part(scene_id, '_', 1), '\\D', '', 'g') AS INT) AS sat, regexp_extract(scene_id, '(\\d{8})', 1) AS dd FROM v_scene_name) t
WHERE NOT (sat = 7 AND dd >= '20030531')""")
def scene_filter(s, d):
    return catalog.split_slc_off(view(s, d, "v_scene_name"))[0].select("o_orderkey", "scene_id")


@query("SELECT o_orderkey, TRY_CAST(regexp_replace(split_part(scene_id, '_', 1), '\\D', '', 'g') AS INT) AS sat, CAST(strptime(regexp_extract(scene_id, '(\\d{8})', 1), '%Y%m%d') AS DATE) AS acquired FROM v_scene_name")
def scene_parts(s, d):
    return view(s, d, "v_scene_name").select("o_orderkey", names.satellite(F.col("scene_id")).alias("sat"), names.acquisition(F.col("scene_id")).alias("acquired"))


@query("""SELECT granule, count(DISTINCT CASE WHEN contains(path, '_WTR-2.') THEN 'WTR-2' WHEN contains(path, '_WTR.') THEN 'WTR' ELSE 'CONF' END) AS n_assets FROM v_file GROUP BY granule
HAVING count(DISTINCT CASE WHEN contains(path, '_WTR-2.') THEN 'WTR-2' WHEN contains(path, '_WTR.') THEN 'WTR' ELSE 'CONF' END) = 3""")
def asset_having(s, d):
    return catalog.complete_groups(catalog.layers(view(s, d, "v_file")))


@query("SELECT granule_id, path FROM v_file WHERE granule IN (SELECT granule FROM v_file WHERE contains(path, '_WTR.'))")
def dependent_layers(s, d):
    return catalog.dependent_layers(catalog.layers(view(s, d, "v_file"))).select("granule_id", "path")


@query("""SELECT l_orderkey, url FROM (SELECT l_orderkey, url, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, url) AS k FROM (SELECT l_orderkey, l_linenumber, CONCAT('/SWOT_', CASE WHEN l_suppkey % 2 = 0 THEN '100m_' ELSE '250m_' END,
  CAST(l_partkey AS VARCHAR), CASE l_partkey % 3 WHEN 0 THEN '.nc' WHEN 1 THEN '.NC' ELSE '.md5' END) AS url FROM lineitem) t
WHERE contains(url, '100m') AND lower(url) LIKE '%.nc') u WHERE k = 1""")
def raster_links(s, d):
    size = F.when(F.col("l_suppkey") % 2 == 0, "100m_").otherwise("250m_")
    kind = F.when(F.col("l_partkey") % 3 == 0, ".nc").when(F.col("l_partkey") % 3 == 1, ".NC").otherwise(".md5")
    url = F.concat(F.lit("/SWOT_"), size, F.col("l_partkey").cast("string"), kind).alias("url")
    links = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", url)
    return catalog.raster_links(links, "l_orderkey", pos="l_linenumber")


@query("SELECT CAST(o_orderdate AS DATE) AS obs_date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events")
def all_dates(s, d):
    named = (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
    return catalog.all_dates(*(s.read.parquet(f"{d}/{t}.parquet").select(F.col(c).cast("date").alias("obs_date")) for t, c in named))


@query("""SELECT o.row_i - 4 AS row_i, o.col_i - 3 AS col_i, n.elev - o.elev AS change FROM v_dem o
JOIN v_dem n ON n.row_i = CAST(floor((o.row_i - 4 + 0.5) / 2.5) AS INT) AND n.col_i = CAST(floor((o.col_i - 3 + 0.5) / 2.5) AS INT)
WHERE o.row_i >= 4 AND o.col_i >= 3""")
def aligned_difference(s, d):
    """A raster against one of coarser cells that begins three cells to the right and four below."""
    dem = view(s, d, "v_dem")
    height = dem.agg(F.max("row_i")).first()[0] + 1
    fine = {"width": 10, "height": height, "a": 1.0, "c": 0.0, "e": -1.0, "f": 0.0}
    coarse = fine | {"a": 2.5, "c": 3.0, "e": -2.5, "f": -4.0}
    return merge.aligned_difference(dem, dem, coarse, fine, "elev")


@query("SELECT granule_id, path FROM v_file WHERE granule_id NOT IN (SELECT granule_id FROM v_file WHERE length % 3 = 0)")
def skip_existing(s, d):
    files = view(s, d, "v_file")
    return catalog.missing(files, files.where("length % 3 = 0"), ["granule_id"]).select("granule_id", "path")


@query("SELECT granule_id, length FROM v_file WHERE length < 1024")
def small_files(s, d):
    return catalog.too_small(view(s, d, "v_file")).select("granule_id", "length")


@query("""SELECT granule, path FROM (SELECT granule, path, row_number() OVER (PARTITION BY granule ORDER BY CASE WHEN contains(lower(path), 'level-3') OR contains(lower(path), 'dswe') THEN 0 ELSE 1 END, granule_id) AS k FROM v_file WHERE length % 2 = 0) t WHERE k = 1""")
def best_option(s, d):
    options = view(s, d, "v_file").withColumn("available", F.col("length") % 2 == 0)
    return catalog.best_option(options, "granule", "path", "granule_id").select("granule", "path")


@query("SELECT file_id, CONCAT('https://tiles.example.org/', CAST(file_id AS VARCHAR(10)), '/lake_', CAST(lake_id AS VARCHAR(10)), '.tif') AS url FROM v_lake")
def addresses(s, d):
    return catalog.addresses(view(s, d, "v_lake"), "https://tiles.example.org/%s/lake_%s.tif", a="file_id", b="lake_id").select("file_id", "url")


@query("SELECT CAST(date '2023-04-01' + CAST(k * 9 AS INT) AS DATE) AS \"start\", CAST(least(date '2023-04-01' + CAST(k * 9 + 8 AS INT), date '2023-07-01') AS DATE) AS stop FROM (SELECT unnest(generate_series(0, 10)) AS k) t WHERE date '2023-04-01' + CAST(k * 9 AS INT) <= date '2023-07-01'")
def date_chunks(s, d):
    return catalog.date_chunks("2023-04-01", "2023-07-01", s)


@query("SELECT obs_date, count(*) AS n FROM v_obs WHERE obs_date BETWEEN date '1994-03-01' AND date '1995-02-28' GROUP BY obs_date")
def date_filter(s, d):
    return catalog.between_dates(_obs(s, d), "1994-03-01", "1995-02-28").groupBy("obs_date").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN length < 1024 THEN 'broken' WHEN length % 2 = 0 THEN 'created' ELSE 'skipped' END AS status, count(*) AS n FROM v_file GROUP BY 1")
def status_counts(s, d):
    return catalog.status_counts(view(s, d, "v_file").withColumn("status", F.expr("case when length < 1024 then 'broken' when length % 2 = 0 then 'created' else 'skipped' end")))


@query("SELECT lake_id, trim(split_part(split_part(lake_name, ';', 1), ',', 1)) AS lake FROM v_lake")
def lake_names(s, d):
    return view(s, d, "v_lake").select("lake_id", names.simple_lake(F.col("lake_name")).alias("lake"))


# --- grids


@query("""SELECT t.row_i, t.col_i, v.elev FROM v_dem t LEFT JOIN v_dem v ON v.row_i = floor((t.row_i + 0.5) * 40 / 30.0E0) AND v.col_i = floor((t.col_i + 0.5) * 40 / 30.0E0)""")
def resample_nearest(s, d):
    grid = lambda size: {"a": size, "c": 1000.0, "e": -size, "f": 9000.0}
    dem = view(s, d, "v_dem").select("row_i", "col_i", "elev")
    return spatial.resample_nearest(dem, dem.select("row_i", "col_i"), grid(40.0), grid(30.0))


@query("SELECT row_i, col_i, elev FROM v_dem WHERE col_i * 0.5E0 + 10 BETWEEN 11 AND 13 AND 50 - row_i * 0.5E0 BETWEEN 46 AND 48")
def crop_window(s, d):
    return spatial.crop(view(s, d, "v_dem"), F.col("col_i") * 0.5 + 10, 50 - F.col("row_i") * 0.5, (11, 46, 13, 48)).select("row_i", "col_i", "elev")


@query("""WITH o AS (SELECT r.i, c.j FROM (SELECT unnest(generate_series(-7, 7)) AS i) r CROSS JOIN (SELECT unnest(generate_series(-7, 7)) AS j) c WHERE abs(r.i) + abs(c.j) <= 7)
SELECT DISTINCT CAST(a.row_i + o.i AS INT) AS row_i, CAST(a.col_i + o.j AS INT) AS col_i FROM v_dem a, o WHERE a.elev = 905""")
def dilate_lake(s, d):
    return spatial.dilate(view(s, d, "v_dem").where("elev = 905").select("row_i", "col_i"), [], steps=7)


# --- names, places and further lookups


@query("SELECT ts, CAST(datediff('minute', TIMESTAMP '2023-01-01 00:00:00', date_trunc('minute', ts)) AS INT) AS minutes, round(year(ts) + (dayofyear(ts) - 1) / CAST(date_diff('day', make_date(year(ts), 1, 1), make_date(year(ts) + 1, 1, 1)) AS DOUBLE), 9) AS decimal_year FROM v_hourly")
def acquisition_times(s, d):
    ts = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return view(s, d, "v_hourly").select("ts", names.epoch_minutes(ts).alias("minutes"), F.round(names.decimal_year(F.to_date("ts")), 9).alias("decimal_year"))


ORBIT = "CONCAT('SWOT_L2_HR_LakeSP_Obs_', lpad(CAST(lake_id % 30 AS VARCHAR(5)), 3, '0'), '_', lpad(CAST(lake_id AS VARCHAR(5)), 3, '0'), '_NA_2023', lpad(CAST(1 + lake_id % 12 AS VARCHAR(5)), 2, '0'), '01T010203_PIC0.zip')"


@query(f"SELECT lake_id, split_part(f, '_', 6) AS cycle, split_part(f, '_', 7) AS pass, split_part(f, '_', 9) AS stamp FROM (SELECT lake_id, {ORBIT} AS f FROM v_lake) t")
def orbit_names(s, d):
    return view(s, d, "v_lake").select("lake_id", names.orbit(F.expr(ORBIT)).alias("o")).select("lake_id", "o.*")


@query("SELECT event_id, TRY_CAST(replace(CASE WHEN event_id % 3 = 0 THEN CONCAT('1,', feet) ELSE feet END, ',', '') AS FLOAT) AS v FROM v_gauge")
def clean_numbers(s, d):
    return view(s, d, "v_gauge").select("event_id", names.clean_number(F.expr("case when event_id % 3 = 0 then concat('1,', feet) else feet end")).alias("v"))


@query("SELECT lake_id, CASE WHEN lake_id % 4 = 0 THEN 0.5E0 ELSE CAST(lake_id % 7 AS DOUBLE) / 8 END AS fraction FROM v_lake")
def fractions(s, d):
    text = F.expr("case when lake_id % 4 = 0 then '0.5' else concat(lake_id % 7, '/8') end")
    return view(s, d, "v_lake").select("lake_id", names.fraction(text).alias("fraction"))


@query("SELECT lake_id, round(30 / (111320.0E0 * cos(radians(x_m / 200 - 25))), 12) AS lon, round(30 / 111320.0E0, 12) AS lat FROM v_lake")
def degrees_per_pixel(s, d):
    x = view(s, d, "v_lake").select("lake_id", geo.degrees_per_pixel(F.lit(30.0), F.col("x_m") / 200 - 25).alias("p"))
    return x.select("lake_id", F.round("p.lon", 12).alias("lon"), F.round("p.lat", 12).alias("lat"))


@query("""SELECT lake_id, floor((x_m / 128 - 30) * 10) / 10 AS west, floor((y_m / 128) * 10) / 10 AS south, ceil((x_m / 128 - 28) * 10) / 10 AS east, ceil((y_m / 128 + 3) * 10) / 10 AS north FROM v_lake""")
def polygon_bounds(s, d):
    x, y = F.col("x_m") / 128 - 30, F.col("y_m") / 128
    corner = lambda a, b: F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x, y), corner(x + 2, y), corner(x + 2, y + 3), corner(x, y + 3), corner(x, y)), F.lit("))"))
    return view(s, d, "v_lake").select("lake_id", geo.ring_bounds(geo.wkt_ring(wkt), 1).alias("b")).select("lake_id", "b.*")


@query("SELECT cell_id, 30.0E0 * col_i + 1000 AS x, 5000 - 30.0E0 * row_i AS y, CAST(floor((4990 - 12.5E0 * row_i - 5000) / -30) AS INT) AS \"row\", CAST(floor((12.5E0 * col_i) / 30) AS INT) AS col FROM v_dem")
def affine(s, d):
    g = {"a": 30.0, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -30.0, "f": 5000.0}
    at = geo.geo_to_pixel(1000 + 12.5 * F.col("col_i"), 4990 - 12.5 * F.col("row_i"), g)
    return view(s, d, "v_dem").select("cell_id", geo.pixel_to_geo(F.col("row_i"), F.col("col_i"), g).alias("p"), at.alias("q")).select("cell_id", "p.*", "q.*")


@query("""WITH p AS (SELECT lake_id, x_m / 1300 AS x, y_m / 130 AS y FROM v_lake),
c AS (SELECT p.*, (1 - abs(p.x - v.col_i)) * (1 - abs(p.y - v.row_i)) AS w, v.elev FROM p JOIN v_dem v ON v.col_i IN (floor(p.x), floor(p.x) + 1) AND v.row_i IN (floor(p.y), floor(p.y) + 1))
SELECT lake_id, x, y, round(sum(w * elev) / sum(w), 6) AS elev FROM c GROUP BY lake_id, x, y""")
def bilinear_elevation(s, d):
    points = view(s, d, "v_lake").select("lake_id", (F.col("x_m") / 1300).alias("x"), (F.col("y_m") / 130).alias("y"))
    return spatial.bilinear(view(s, d, "v_dem"), points, "elev").withColumn("elev", F.round("elev", 6))


RECTANGLE = ((1.3, 2.2), (6.7, 2.2), (6.7, 5.9), (1.3, 5.9))


def _ring(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


@query("SELECT row_i, col_i FROM v_dem WHERE col_i + 1 >= 1.3 AND col_i <= 6.7 AND row_i + 1 >= 2.2 AND row_i <= 5.9")
def rasterize(s, d):
    return spatial.rasterize(view(s, d, "v_dem"), s.range(1).select(_ring(RECTANGLE).alias("ring")))


@query("""SELECT lake_id, round(sqrt(power(greatest(2000.0E0 - x_m, 0, x_m - 6000), 2) + power(greatest(1500.0E0 - y_m, 0, y_m - 4500), 2)), 6) AS distance FROM v_lake""")
def polygon_distance(s, d):
    ring = _ring(((2000, 1500), (6000, 1500), (6000, 4500), (2000, 4500)))
    return view(s, d, "v_lake").select("lake_id", F.round(spatial.polygon_distance(F.col("x_m"), F.col("y_m"), ring), 6).alias("distance"))


@query("SELECT lake_id FROM v_lake WHERE 5050 BETWEEN x_m AND x_m + 3000 AND 4050 BETWEEN y_m AND y_m + 3000 ORDER BY lake_id LIMIT 1")
def containing_lake(s, d):
    corner = lambda i, j: F.struct((F.col("x_m") + i).alias("x"), (F.col("y_m") + j).alias("y"))
    lakes = view(s, d, "v_lake").withColumn("ring", F.array(corner(0.0, 0.0), corner(3000.0, 0.0), corner(3000.0, 3000.0), corner(0.0, 3000.0)))
    return altimetry.containing_feature(lakes, 5050.0, 4050.0).select("lake_id")


@query("SELECT lake_id FROM v_lake WHERE x_m <= 6000 AND x_m + 500 >= 3000 AND y_m <= 7000 AND y_m + 500 >= 2000")
def box_filter(s, d):
    return view(s, d, "v_lake").where(spatial.boxes_meet(F.col("x_m"), F.col("y_m"), F.col("x_m") + 500, F.col("y_m") + 500, (3000, 2000, 6000, 7000))).select("lake_id")


@query("SELECT cell_id, CAST(round_even(row_i * 4 / 9.0E0, 0) AS INT) AS r, CAST(round_even(col_i * 24 / 9.0E0, 0) AS INT) AS c FROM v_dem")
def zoom_indices(s, d):
    return view(s, d, "v_dem").select("cell_id", spatial.zoom_index(F.col("row_i"), 10, 5).alias("r"), spatial.zoom_index(F.col("col_i"), 10, 25).alias("c"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN substr(scene_id, 1, 4) END AS sensor FROM v_scene_name")
def metadata_field(s, d):
    fields = F.expr("array(named_struct('fieldName', if(o_orderkey % 2 = 0, 'Sensor', 'Other'), 'value', substr(scene_id, 1, 4)), named_struct('fieldName', 'Id', 'value', scene_id))")
    return view(s, d, "v_scene_name").select("o_orderkey", names.field_value(fields, "Sensor").alias("sensor"))


@query("SELECT lake_id FROM v_lake WHERE lake_id % 3 = 1")
def of_zone(s, d):
    files = view(s, d, "v_lake").withColumn("path", F.expr("concat('SWOT_L2_HR_Raster_100m_UTM', 10 + lake_id % 3, 'S_N_x.nc')"))
    return altimetry.of_zone(files, "11S").select("lake_id")


@query("SELECT granule_id FROM v_file WHERE length % 100 <= 40")
def clear_enough(s, d):
    items = view(s, d, "v_file").withColumn("eo:cloud_cover", F.col("length") % 100)
    return catalog.clear_enough(items, 40).select("granule_id")


@query("SELECT granule_id FROM v_file WHERE contains(lower(path), 'conf') OR contains(lower(path), 'wtr-2')")
def known_datasets(s, d):
    return catalog.known_datasets(view(s, d, "v_file").withColumn("dataset", F.col("path")), ["CONF", "wtr-2"]).select("granule_id")


@query("SELECT * FROM (SELECT \"start\", stop, CAST(date_diff('day', lag(stop) OVER (ORDER BY \"start\"), \"start\") - 1 AS INT) AS gap_days FROM (SELECT DISTINCT obs_date AS \"start\", obs_date AS stop FROM v_obs WHERE day(obs_date) % 4 <> 0) t) u WHERE gap_days <> 0")
def date_gaps(s, d):
    days = _obs(s, d).where("day(obs_date) % 4 <> 0").select(F.col("obs_date").alias("start")).distinct()
    return catalog.gaps(days.withColumn("stop", F.col("start")))


@query("SELECT ts, cell_id, tp FROM v_hourly WHERE cell_id % 2 = 0")
def final_version(s, d):
    return resample.of_version(view(s, d, "v_hourly").withColumn("expver", F.when(F.col("cell_id") % 2 == 0, 1).otherwise(5)))


@query("SELECT month_key, area_km2 AS value, 'water' AS source FROM v_series UNION ALL SELECT month_key, index_value, 'index' FROM v_index")
def together(s, d):
    return resample.together(water=view(s, d, "v_series").select("month_key", F.col("area_km2").alias("value")), index=view(s, d, "v_index").select("month_key", F.col("index_value").alias("value")))


@query(f"WITH {FREQ} SELECT cell_id, CASE WHEN water_pct >= 5 THEN water_pct END AS shown FROM f WHERE (SELECT count(*) FROM v_dswx) >= 0")
def shown_frequency(s, d):
    return derivatives.water_frequency(_dswx(s, d), KEYS).select("cell_id", derivatives.shown_frequency(F.col("water_pct")).alias("shown"))


@query("""WITH t AS (SELECT l_suppkey % 20 AS k, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), m AS (SELECT k, median(v) AS median_elev, max(v) AS mode_elev FROM t GROUP BY k)
SELECT round(avg(median_elev), 6) AS median_elev_mean, min(median_elev) AS median_elev_min, max(median_elev) AS median_elev_max, round(avg(mode_elev), 6) AS mode_elev_mean, min(mode_elev) AS mode_elev_min, max(mode_elev) AS mode_elev_max FROM m""")
def elevation_summary(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_suppkey") % 20).alias("k")).agg(F.median("l_quantity").alias("median_elev"), F.max("l_quantity").alias("mode_elev"))
    x = elevation.elevation_summary(rows)
    return x.select(*(F.round(c, 6).alias(c) if c.endswith("mean") else c for c in x.columns))


@query(f"""WITH {STATS}, {QUALITY}, {VOTE} SELECT CAST(month_key AS INT) AS month_key, CAST(floor(month_key / 100) AS INT) AS year_i, CAST(month_key % 100 AS INT) AS month_i, round(count(*) FILTER (WHERE cls IN (1, 2, 3, 4)) * 0.0009E0, 9) AS total_area_km2,
  count(*) FILTER (WHERE cls <> 255) AS valid_pixels FROM monthly WHERE (SELECT count(*) FROM v_obs) >= 0 GROUP BY month_key""")
def monthly_metrics(s, d):
    m, stats = _both(s, d)
    rows = metrics.monthly_metrics(m.select("month_key", "row_i", "col_i", "cls"), stats, 0.0009)
    return rows.select("month_key", "year_i", "month_i", F.round("total_area_km2", 9).alias("total_area_km2"), "valid_pixels")


@query(SQL["water_statistics"])
def streamed_statistics(s, d):
    """The statistics of a stream of observations, as the counters keep them."""
    from .streaming import counters

    keys = ["cell_id", "row_i", "col_i"]
    obs = stored(_obs(s, d), "arriving")
    place = obs.inputFiles()[0].rsplit("/", 1)[0]
    stream = s.readStream.schema(obs.schema).parquet(place)
    counters.follow(stream, f"{place}-counts", f"{place}-progress", keys).awaitTermination()
    return counters.statistics(s, f"{place}-counts", keys=keys).select(*_stats(s, d).columns)
