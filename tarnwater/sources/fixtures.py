"""Views that reshape the test tables into the model's shape. The same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "orders", "part", "supplier", "nation", "events")

VIEWS: dict[str, str] = {
    "v_scene": """
SELECT CAST(l_partkey % 100 AS INT) AS cell_id, CAST(floor((l_partkey % 100) / 10.0) AS INT) AS row_i, CAST(l_partkey % 10 AS INT) AS col_i,
  CAST(l_shipdate AS DATE) AS obs_date, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS month_key, l_orderkey * 10 + l_linenumber AS file_pos,
  CAST(CASE WHEN l_quantity >= 49 THEN 255 WHEN l_quantity >= 45 THEN 9
    WHEN l_partkey % 5 = 0 THEN CASE WHEN l_quantity <= 40 THEN 1 ELSE 0 END
    WHEN l_partkey % 5 = 1 THEN CASE WHEN l_quantity <= 5 THEN 2 ELSE 0 END
    WHEN l_partkey % 5 = 2 THEN CASE WHEN month(l_shipdate) BETWEEN 4 AND 9 THEN 1 ELSE 0 END
    WHEN l_partkey % 5 = 3 THEN CASE WHEN l_quantity <= 15 THEN 3 WHEN l_quantity <= 25 THEN 1 ELSE 0 END
    ELSE CAST(l_quantity AS INT) % 5 END AS INT) AS cls,
  CAST(l_suppkey % 6 - 1 AS INT) AS inwam
FROM lineitem""",
    "v_scene_dswx": """
SELECT CAST(l_partkey % 100 AS INT) AS cell_id, CAST(floor((l_partkey % 100) / 10.0) AS INT) AS row_i, CAST(l_partkey % 10 AS INT) AS col_i,
  CAST(l_shipdate AS DATE) AS obs_date, l_orderkey * 10 + l_linenumber AS file_pos, CAST(l_suppkey * 7 % 1440 AS INT) AS acq_min,
  CAST(CASE WHEN l_quantity >= 48 THEN 255 WHEN l_quantity >= 46 THEN 253 WHEN l_quantity >= 44 THEN 252 WHEN l_quantity >= 43 THEN 254
    ELSE (l_partkey + CAST(l_quantity AS INT)) % 3 END AS INT) AS cls
FROM lineitem""",
    "v_obs": """
SELECT cell_id, row_i, col_i, obs_date, month_key, cls, inwam FROM (
  SELECT s.*, row_number() OVER (PARTITION BY cell_id, obs_date ORDER BY
    CASE cls WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 0 THEN 4 WHEN 9 THEN 5 ELSE 1000 END, file_pos) AS rn
  FROM v_scene s) t
WHERE rn = 1""",
    "v_dswx": """
SELECT cell_id, row_i, col_i, obs_date, cls FROM (
  SELECT s.*, row_number() OVER (PARTITION BY cell_id, obs_date ORDER BY
    CASE WHEN cls = 1 THEN 0 WHEN cls = 0 THEN 1 WHEN cls = 2 THEN 2 WHEN cls = 255 THEN 2000 ELSE 1000 END, file_pos) AS rn
  FROM v_scene_dswx s) t
WHERE rn = 1""",
    "v_series": """
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS month_key, CAST(year(o_orderdate) AS INT) AS year_i,
  CAST(month(o_orderdate) AS INT) AS month_i, round(sum(o_totalprice) / 1.0E6, 3) AS area_km2, count(*) AS bodies
FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""",
    "v_index": """
SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS month_key, round(avg(l_discount * 100.0E0), 4) AS index_value
FROM lineitem GROUP BY year(l_shipdate), month(l_shipdate)""",
    "v_dem": """
SELECT CAST(p_partkey AS INT) AS cell_id, CAST(floor(p_partkey / 10.0) AS INT) AS row_i, CAST(p_partkey % 10 AS INT) AS col_i,
  CASE WHEN p_partkey % 5 = 0 THEN 905.0E0 ELSE 900.0E0 + (p_partkey % 23) * 0.5E0 END AS elev
FROM part""",
    "v_lake": """
SELECT s_suppkey AS lake_id, CONCAT('LAKE ', CAST(s_nationkey AS VARCHAR(10)), ';ALIAS') AS lake_name,
  (s_suppkey * 37 % 101) * 100.0E0 AS x_m, (s_suppkey * 53 % 97) * 100.0E0 AS y_m, s_acctbal AS wse, CAST(s_suppkey % 8 AS INT) AS file_id
FROM supplier""",
    "v_gauge": """
SELECT event_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 50 = 0 THEN '--' WHEN event_id % 41 = 0 THEN '0'
  ELSE CAST(700 + event_id % 17 + CASE WHEN event_id % 499 = 0 THEN 900 ELSE 0 END AS VARCHAR(10)) END AS feet
FROM events""",
    "v_hourly": "SELECT ts, CAST(user_id % 4 AS INT) AS cell_id, value AS tp FROM events",
    "v_scene_name": """
SELECT o_orderkey, CONCAT(CASE o_orderkey % 4 WHEN 0 THEN 'LT05' WHEN 1 THEN 'LE07' WHEN 2 THEN 'LC08' ELSE 'LC09' END, '_CU_002009_',
  CAST((year(o_orderdate) + 4) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS VARCHAR(8)), '_20210424_02_DSWE') AS scene_id
FROM orders""",
    "v_swath": """
SELECT CAST(floor(p_partkey / 100.0) AS INT) AS file_id, CAST(floor((p_partkey % 100) / 10.0) AS INT) AS y, CAST(p_partkey % 10 AS INT) AS x,
  34.0E0 + floor((p_partkey % 100) / 10.0) * 0.125E0 AS lat, -120.0E0 + (p_partkey % 10) * 0.125E0 + (p_partkey % 100) * 0.0E0 AS lon, p_retailprice AS wse
FROM part""",
    "v_file": """
SELECT o_orderkey AS granule_id, CONCAT('OPERA_L3_DSWx-HLS_T', CAST(o_custkey % 90 AS VARCHAR(10)), '_', CAST(o_orderkey AS VARCHAR(20)), '_B0',
  CASE o_orderkey % 3 WHEN 0 THEN '1_WTR.tif' WHEN 1 THEN '2_WTR-2.tif' ELSE '3_CONF.tif' END) AS path,
  CONCAT('G', CAST(o_custkey AS VARCHAR(20))) AS granule, CAST(floor(o_totalprice / 100.0) AS BIGINT) AS length
FROM orders""",
}

NEEDS = {"v_obs": ("v_scene",), "v_dswx": ("v_scene_dswx",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in sf_dir."""
    text = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"FROM {t}" in text}
    frames |= {v: view(spark, sf_dir, v) for v in NEEDS.get(name, ())}
    for k in frames:
        text = text.replace(f"FROM {k}", f"FROM {{{k}}}")
    return spark.sql(text, **frames)


def with_views(sql: str) -> str:
    """The query with the definitions of the views it names in front, for the other engine."""
    names: list[str] = []

    def need(v: str) -> None:
        for d in NEEDS.get(v, ()):
            need(d)
        if v not in names:
            names.append(v)

    for v in VIEWS:
        if any(f"{p} {v}{e}" in f" {sql} ".replace("\n", " ") for p in ("FROM", "JOIN") for e in (" ", ")", ",")):
            need(v)
    listed = ", ".join(f"{v} AS ({VIEWS[v]})" for v in names)
    sql = sql.strip()
    if not names:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {listed}, {sql[14:]}"
    return f"WITH {listed}, {sql[4:]}" if sql.upper().startswith("WITH") else f"WITH {listed} {sql}"
