"""Deterministic coastal views over the star-schema tables.

One SQL text for each view runs in Spark and in DuckDB, so a query and its SQL
twin start from the same rows.  ``{table}`` names a stored table, ``{e0}`` and
``{e1}`` the first two items of an embedding.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "obs_raw": """SELECT l_partkey AS series_id, CAST(l_shipdate AS DATE) AS obs_date, CAST(l_quantity AS DOUBLE) AS value,
      CAST(CASE WHEN l_shipdate < TIMESTAMP '1997-01-01 00:00:00' THEN 5 WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 2 ELSE 1 END AS DOUBLE) AS error,
      l_returnflag AS source, l_orderkey * 10 + l_linenumber AS arrival FROM {lineitem}""",
    "obs": """SELECT series_id, obs_date, value, error, source FROM (SELECT *, row_number() OVER
      (PARTITION BY series_id, obs_date ORDER BY arrival DESC, value DESC, source DESC) AS rn FROM (<obs_raw>) r) q WHERE rn = 1""",
    "line_node": """SELECT line_id, seq, CAST(seq * 25 AS DOUBLE) AS x, CAST(line_id * 1000 + c_acctbal / 100 AS DOUBLE) AS y FROM (SELECT c_nationkey AS line_id,
      row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS seq, c_acctbal FROM {customer}) q""",
    "profile": """SELECT transect_id, ix, CAST(5 * ix AS DOUBLE) AS dist, CAST(z AS DOUBLE) AS z FROM (SELECT user_id AS transect_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, value / 40 AS z FROM {events}) q""",
    # A strip of 50 rows that lengthens with the orders, in tiles of 20 columns; a tile's first two columns lie in the tile before too, at other heights.
    "raster_cell": """SELECT CAST(FLOOR(col_ix / 20) AS BIGINT) - k AS tile, row_ix, col_ix, z + k * (row_ix % 3 - 1) * 0.5E0 AS z FROM (SELECT o_orderkey % 50 AS row_ix,
      CAST(FLOOR(o_orderkey / 50) AS BIGINT) AS col_ix, CAST(MIN(o_totalprice) / 10000 - 2 AS DOUBLE) AS z FROM {orders} GROUP BY o_orderkey % 50, CAST(FLOOR(o_orderkey / 50) AS BIGINT)) q
      CROSS JOIN (VALUES (0), (1)) AS e(k) WHERE k = 0 OR (col_ix >= 20 AND col_ix % 20 < 2)""",
    # Points in units of cells and zones along that strip.
    "grid_point": """SELECT vec_id AS site_id, CAST({e0} AS DOUBLE) * 50 + 25 + CAST(FLOOR(vec_id / 50) * 25 AS DOUBLE) AS x, CAST({e1} AS DOUBLE) * 50 + 25 AS y FROM {embeddings}""",
    "zone_box": """SELECT s_suppkey AS cell_id, CAST(FLOOR(s_suppkey / 5) * 200 AS DOUBLE) AS xmin, CAST(s_suppkey % 5 * 200 AS DOUBLE) AS ymin,
      CAST(FLOOR(s_suppkey / 5) * 200 + 200 AS DOUBLE) AS xmax, CAST(s_suppkey % 5 * 200 + 200 AS DOUBLE) AS ymax FROM {supplier}""",
    "cell_box": """SELECT n_nationkey AS cell_id, CAST(n_nationkey % 5 * 200 AS DOUBLE) AS xmin, CAST(FLOOR(n_nationkey / 5) * 200 AS DOUBLE) AS ymin,
      CAST(n_nationkey % 5 * 200 + 200 AS DOUBLE) AS xmax, CAST(FLOOR(n_nationkey / 5) * 200 + 200 AS DOUBLE) AS ymax FROM {nation}""",
    "site_point": """SELECT vec_id AS site_id, CAST({e0} AS DOUBLE) * 1000 + 500 AS x, CAST({e1} AS DOUBLE) * 1000 + 500 AS y, label FROM {embeddings}""",
    "cell_rate": """SELECT l_suppkey AS cell_id, l_orderkey * 10 + l_linenumber AS transect_id, CAST((l_discount - 0.05) * 20 - l_tax * 5 AS DOUBLE) AS hist_rate FROM {lineitem}""",
    "cell_coast": """SELECT l_suppkey AS cell_id, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'S' ELSE 'H' END AS ct, CAST(l_quantity AS DOUBLE) AS len FROM {lineitem}""",
    "cell_attr": """SELECT p_partkey AS cell_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 1985 + p_size END AS max_lid_yr,
      CASE p_size % 3 WHEN 0 THEN ' y' WHEN 1 THEN 'N' ELSE NULL END AS assets FROM {part}""",
    "storm_in": """SELECT p_partkey AS transect_id, s.scenario, 1 + p_size / 20.0E0 + s.k * 0.2E0 AS hs, 4 + p_size % 12 + s.k * 0.5E0 AS tp, (p_partkey % 20 + 1) / 100.0E0 AS slope,
      p_size % 2 = 0 AS shingle, p_partkey % 5 <> 0 AS barrier, 1.5E0 + (p_partkey % 9) * 0.4E0 AS toe, 3 + (p_partkey % 13) * 0.6E0 AS crest,
      1.8E0 + s.k * 0.15E0 AS esl, s.k * 0.15E0 AS slr, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 7 - 3) * 0.1E0 END AS hist_rate,
      CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 40) * 10.0E0 END AS asset_dist, 2 + (p_partkey % 11) * 1.0E0 AS asset_elev
      FROM {part} CROSS JOIN (VALUES ('H', 0), ('M45', 1), ('M85', 2), ('E45', 3), ('E85', 4)) AS s(scenario, k)""",
    "rsl_dim": """SELECT sc.scenario, pc.percentile, yr.y AS proj_year, 0.05E0 * sc.scenario * (yr.y - 2000) / 100 * (1 + pc.percentile / 100.0E0) AS level
      FROM (VALUES (2), (4), (8)) AS sc(scenario) CROSS JOIN (VALUES (5), (50), (95)) AS pc(percentile)
      CROSS JOIN (VALUES (2030), (2040), (2050), (2060), (2070), (2080), (2090), (2100)) AS yr(y)""",
    # A stack of sea-level rasters by scenario, percentile and year: a strip of 5 rows that lengthens with the suppliers, with holes; and the places of series along it.
    "level_cell": """SELECT scenario, percentile, proj_year, row_ix, col_ix, CAST(level AS DOUBLE) * (1 + row_ix * 0.02E0 + (col_ix % 11) * 0.01E0) AS level FROM (<rsl_dim>) d
      CROSS JOIN (SELECT s_suppkey, s_suppkey % 5 AS row_ix, CAST(FLOOR(s_suppkey / 5) AS BIGINT) AS col_ix FROM {supplier}) c WHERE s_suppkey % 9 <> 0""",
    "series_place": """SELECT p_partkey AS series_id, CAST(p_partkey * 2 + 7 AS DOUBLE) AS x, CAST(p_partkey % 997 AS DOUBLE) + 1.5E0 AS y FROM {part}""",
    # A second series of positions: the vegetation edge.
    "veg_raw": """SELECT l_partkey AS series_id, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 90 AS INT) AS obs_date, CAST(l_quantity AS DOUBLE) + 8 + CAST(l_tax AS DOUBLE) * 100 AS value, l_orderkey * 10 + l_linenumber AS arrival FROM {lineitem}""",
    "veg": """SELECT series_id, obs_date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY arrival DESC, value DESC) AS rn FROM (<veg_raw>) r) q WHERE rn = 1""",
    # Profiles with a face some way up.
    "cliff_profile": """SELECT transect_id, ix, dist, z * 0.5E0 + CASE WHEN ix < 8 + transect_id % 9 THEN ix * 0.05E0 ELSE 12 + transect_id % 7 + ix * 0.08E0 END AS z FROM (<profile>) r""",
    # Depth of soft ground over rock, and transects across it.
    "soft_cell": """SELECT row_ix, col_ix, MAX(z) / 5 AS v FROM (<raster_cell>) r GROUP BY row_ix, col_ix""",
    "rock_transect": """SELECT p_partkey AS series_id, p_partkey * 1.4E0 AS start_x, 3.0E0 AS start_y, p_partkey * 1.4E0 + 120 AS end_x, 497.0E0 AS end_y FROM {part}""",
}


def _text(name: str) -> str:
    """The view's SQL with the views it stands on put in."""
    return re.sub(r"<(\w+)>", lambda m: _text(m[1]), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables of ``sf_dir``."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(_text(name).format(e0="embedding[0]", e1="embedding[1]", **names))


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of one table as a stream, new ones included as they come."""
    path = f"{sf_dir}/{table}.parquet"
    # A stream lists folders and patterns; the pattern also takes a table of one file.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def stream_view(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    """The view ``name`` over the one table it reads, as a stream."""
    return spark.sql(_text(name), **{table: table_stream(spark, sf_dir, table)})


def duck(*views: str, then: str) -> str:
    """DuckDB SQL: the views as common table expressions, then ``then`` (which may begin with a comma and more).

    Zero is added to rounded columns, which makes a negative zero positive.
    """
    then = re.sub(r", (\d+)\) AS (\w+)", r", \1) + 0 AS \2", then)
    names = {t: t for t in TABLES}
    heads = ", ".join(f"{v} AS ({_text(v).format(e0='embedding[1]', e1='embedding[2]', **names)})" for v in views)
    return f"WITH {heads}{then if then.lstrip().startswith(',') else ' ' + then}"
