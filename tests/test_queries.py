"""Each registered coastal query against its DuckDB twin on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandline.plans import registry
from strandline.sources.views import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SOME = ["rate_all", "priority_index", "storm_regime", "segment_intersect", "extract_indicator", "zonal_stats", "bruun_predict", "future_shorelines", "profile_crossings", "summary_rollup", "ts_interp", "assign_nearest_cell", "barrier_detect_simple", "cliff_detect_binned", "profile_bins", "barrier_residuals", "line_make_simple", "raster_mosaic_max", "swath_idw", "scan_ascii_grid", "stream_obs_tumbling", "stream_rate_epr_ols", "stream_ts_upsert", "bruun_montecarlo", "scan_raster_by_name", "rsl_sample", "bruun_predict_place", "rockhead_limit", "uncertainty_bounds", "scan_dir_with_source", "layer_rates", "veg_edge_predict", "sink_future_veg", "sink_transects_dispatch", "sink_append_counts", "sink_by_scenario_sheets", "sink_future_shorelines"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return ""
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.number | Decimal):
        return f"{round(float(v), 4) + 0.0:.4f}"
    return str(v)


def rows(frame):
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_twin_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
