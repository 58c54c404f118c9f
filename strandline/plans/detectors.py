"""SQL twins of the detectors that iterate: recursive tables that end where nothing moves, and what is made of them."""

from __future__ import annotations

from strandline.plans import cells as C
from strandline.plans import extras as X
from strandline.plans import surfaces as Z
from strandline.plans.registry import query
from strandline.sources.views import duck


def _sql(*views: str, then: str) -> str:
    return duck(*views, then=then).replace("WITH ", "WITH RECURSIVE ", 1)


def _extreme(a: str, b: str, first: str, last: str, sign: int, p: str = "p") -> str:
    """{r, i}: the largest residual from the chord a to b, with less its first index."""
    k = f"({p}[{b} + 1].z - {p}[{a} + 1].z) / nullif({p}[{b} + 1].d - {p}[{a} + 1].d, 0)"
    return f"list_max(list_transform(list_filter({p}, lambda q: q.i BETWEEN {first} AND {last}), lambda q: {{'r': {sign} * (q.z - {p}[{a} + 1].z - (q.d - {p}[{a} + 1].d) * ({k})), 'i': -q.i}}))"


def _highest(sign: int = 1) -> str:
    return f"-(list_max(list_transform(p, lambda q: {{'z': {sign} * q.z, 'i': -q.i}})).i)"


def _pack(name: str, source: str) -> str:
    return f", {name} AS (SELECT transect_id, list({{'i': i, 'd': dist, 'z': z}} ORDER BY i) AS p FROM (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY ix) - 1 AS i FROM ({source}) WHERE z IS NOT NULL) GROUP BY 1)"


def _cliffs(source: str, n: str = "") -> str:
    """``cl``: cliffs of the profiles of a source."""
    return _pack(f"cp{n}", source) + f""",
 cr{n} AS (SELECT * FROM (SELECT *, {_highest(-1)} AS lo, {_highest()} AS hi, list_max(list_transform(list_filter(p, lambda q: q.z <> 0), lambda q: q.i)) AS last FROM cp{n} WHERE len(list_filter(p, lambda q: q.z >= 10)) > 0) WHERE last > lo),
 cs{n} AS (SELECT transect_id, last AS top, lo AS toe, TRUE AS moved FROM cr{n} UNION ALL SELECT transect_id, top2, toe2, top2 <> top OR toe2 <> toe FROM (
  SELECT *, CASE WHEN -b.i > toe AND b.r > 0.001 THEN -b.i ELSE toe END AS toe2 FROM (SELECT *, {_extreme("lo", "top2", "lo", "top2 - 1", -1)} AS b FROM (
  SELECT *, CASE WHEN -t.i < top AND t.r > 0.001 THEN -t.i ELSE top END AS top2 FROM (SELECT s.*, p, lo, last, {_extreme("toe", "last", "toe", "last - 1", 1)} AS t FROM cs{n} s JOIN cr{n} USING (transect_id) WHERE moved))))),
 cl{n} AS (SELECT *, a.z - b.z AS height, (a.z - b.z) / (a.d - b.d) AS slope FROM (SELECT transect_id, top, hi, p[top + 1] AS a, p[toe + 1] AS b, p[hi + 1] AS m FROM cs{n} JOIN cr{n} USING (transect_id) WHERE NOT moved AND top > toe)),
 cc{n} AS (SELECT transect_id, a.d AS top_dist, b.d AS toe_dist, height, slope, top <> hi AND abs(a.d - m.d) >= 10 AND (slope > 0.6 OR height > 15) AS cliff FROM cl{n})"""


_CLIFF = " SELECT transect_id, top_dist, toe_dist, round(height, 6) AS height, round(slope, 6) AS slope, TRUE AS converged, cliff FROM cc"

# Roughness and its two clusters

_ROUGH = """, ro AS (SELECT transect_id, quantile_cont(slope, 0.95) - quantile_cont(slope, 0.05) AS slope_rough, stddev_pop(z) AS z_rough FROM (SELECT *, (lead(z) OVER (PARTITION BY transect_id ORDER BY ix) - z) / 5 AS slope FROM profile) WHERE z > -1 AND z < 8 GROUP BY 1),
 rc AS (SELECT 0 AS r, min(slope_rough) AS ax, min(z_rough) AS ay, max(slope_rough) AS bx, max(z_rough) AS b_y FROM ro WHERE slope_rough IS NOT NULL AND z_rough IS NOT NULL
 UNION ALL SELECT r + 1, nax, nay, nbx, nby FROM (SELECT r, ax, ay, bx, b_y, coalesce(avg(x) FILTER (near), ax) AS nax, coalesce(avg(y) FILTER (near), ay) AS nay, coalesce(avg(x) FILTER (NOT near), bx) AS nbx, coalesce(avg(y) FILTER (NOT near), b_y) AS nby
 FROM (SELECT rc.*, slope_rough AS x, z_rough AS y, (slope_rough - ax) ** 2 + (z_rough - ay) ** 2 <= (slope_rough - bx) ** 2 + (z_rough - b_y) ** 2 AS near FROM rc, ro WHERE slope_rough IS NOT NULL AND z_rough IS NOT NULL) GROUP BY r, ax, ay, bx, b_y)
 WHERE greatest(abs(nax - ax), abs(nay - ay), abs(nbx - bx), abs(nby - b_y)) > 1e-12),
 rk AS (SELECT transect_id, NOT ((slope_rough - ax) ** 2 + (z_rough - ay) ** 2 <= (slope_rough - bx) ** 2 + (z_rough - b_y) ** 2) AS rocky FROM ro, (SELECT * FROM rc ORDER BY r DESC LIMIT 1))"""

# Barriers on the soft part of profiles

_SOFT = _ROUGH + _cliffs("SELECT * FROM profile", "0") + """, soft AS (SELECT pr.* FROM profile pr LEFT JOIN rk USING (transect_id) LEFT JOIN (SELECT transect_id, toe_dist AS cliff_toe FROM cc0 WHERE cliff) USING (transect_id) WHERE rocky IS DISTINCT FROM TRUE AND (cliff_toe IS NULL OR dist <= cliff_toe))"""
_HELD = f"(SELECT *, {_highest()} AS hi, len(p) - 1 AS last FROM bp)"
_TOP = "CASE WHEN -t.i > 0 AND -t.i < top AND t.r > 0.001 AND p[-t.i + 1].z > 1.0 THEN -t.i ELSE top END"
_NEAREST = "-(list_max(list_transform(list_filter(p, lambda q: q.i BETWEEN {} AND {}), lambda q: {{'z': -abs(q.z - 1.0), 'i': -q.i}})).i)"
_FRONT = _pack("bp", "SELECT * FROM soft WHERE z >= 0") + f""", br AS (SELECT * FROM {_HELD} WHERE hi > 0 AND p[hi + 1].z >= 1.0),
 bs AS (SELECT transect_id, hi AS top, 0::BIGINT AS toe, TRUE AS moved FROM br UNION ALL SELECT transect_id, top2, toe2, top2 <> top OR toe2 <> toe FROM (
  SELECT *, CASE WHEN -b.i > toe AND b.r > 0.001 THEN -b.i ELSE toe END AS toe2 FROM (SELECT *, {_extreme("0", "top2", "0", "top2", -1)} AS b FROM (
  SELECT *, {_TOP} AS top2 FROM (SELECT s.*, p, {_extreme("0", "top", "0", "top", 1)} AS t FROM bs s JOIN br USING (transect_id) WHERE moved))))),
 bf AS (SELECT transect_id, p, last, top, CASE WHEN p[toe + 1].z < 1.0 THEN CASE WHEN p[near + 1].z > 1.0 THEN near - 1 ELSE near END ELSE toe END AS toe FROM (SELECT *, {_NEAREST.format("toe", "top")} AS near FROM bs JOIN br USING (transect_id) WHERE NOT moved)),
 bm AS (SELECT transect_id, p, last, top, toe, CASE WHEN m = top THEN last ELSE m END AS m FROM (SELECT *, list_max(list_transform(list_filter(p, lambda q: q.d <= p[top + 1].d + 300), lambda q: q.i)) AS m FROM bf WHERE top > toe AND top < last))"""
_WINDOW = _pack("bp", "SELECT * FROM soft WHERE ix > 0 AND dist BETWEEN 20 AND 350 AND z >= 0") + f""", br AS (SELECT * FROM {_HELD} WHERE hi > 0 AND p[hi + 1].z >= 1.0),
 bs AS (SELECT transect_id, hi AS top, hi AS toe, FALSE AS level, TRUE AS moved FROM br UNION ALL SELECT transect_id, top2, toe2, level OR under, top2 <> top OR toe2 <> toe FROM (
  SELECT *, CASE WHEN under THEN CASE WHEN p[near + 1].z > 1.0 THEN near - 1 ELSE near END ELSE low END AS toe2 FROM (
  SELECT *, NOT level AND p[low + 1].z < 1.0 AS under, {_NEAREST.format("low", "greatest(toe, low)")} AS near FROM (
  SELECT *, least(CASE WHEN -b.i < toe AND b.r > 0.001 AND NOT level THEN -b.i ELSE toe END, top2) AS low FROM (SELECT *, {_TOP} AS top2, {_extreme("0", "toe", "0", "toe", -1)} AS b FROM (
  SELECT s.*, p, {_extreme("0", "top", "0", "top", 1)} AS t FROM bs s JOIN br USING (transect_id) WHERE moved)))))),
 bm AS (SELECT transect_id, p, last, top, toe, last AS m FROM bs JOIN br USING (transect_id) WHERE NOT moved AND top > toe AND top < last)"""
_BACK = f""",
 bb AS (SELECT transect_id, top AS btop, m AS btoe, TRUE AS moved FROM bm UNION ALL SELECT transect_id, top2, toe2, top2 <> btop OR toe2 <> btoe FROM (
  SELECT *, CASE WHEN -t.i <> btop AND -t.i < toe2 AND t.r > 0.001 THEN -t.i ELSE btop END AS top2 FROM (SELECT *, {_extreme("top", "toe2", "top", "toe2", 1)} AS t FROM (
  SELECT *, CASE WHEN -b.i < btoe AND -b.i > btop AND b.r > 0.001 THEN -b.i ELSE btoe END AS toe2 FROM (SELECT s.*, p, top, {_extreme("top", "m", "btop", "m", -1)} AS b FROM bb s JOIN bm USING (transect_id) WHERE moved))))),
 bi AS (SELECT *, list_filter(p, lambda q: q.i BETWEEN toe AND btoe) AS inside FROM bb JOIN bm USING (transect_id) WHERE NOT moved AND btop < last),
 bx AS (SELECT *, list_max(list_transform(inside, lambda q: {{'z': q.z, 'i': -q.i}})) AS crest FROM bi),
 ba AS (SELECT transect_id, p[toe + 1].d AS toe_dist, p[top + 1].d AS top_dist, p[btop + 1].d AS back_top_dist, p[btoe + 1].d AS back_toe_dist, p[1 - crest.i].d AS crest_dist, crest.z AS crest_z, p[toe + 1].z AS toe_z, p[top + 1].z AS top_z, p[btoe + 1].z AS back_toe_z,
  p[top + 1].z - p[toe + 1].z AS front_height, p[btop + 1].z - p[btoe + 1].z AS back_height, p[btoe + 1].d - p[toe + 1].d AS toe_width, coalesce(list_sum(list_transform(inside, lambda q: q.z)), 0) * 5 - (p[toe + 1].z + p[btoe].z) / 2 * abs(p[btoe].d - p[toe + 1].d) AS volume FROM bx)"""
_BARRIER = _SOFT + _FRONT + _BACK
_OUT = ("toe_dist", "top_dist", "back_top_dist", "back_toe_dist", "crest_dist", "crest_z", "toe_z", "top_z", "back_toe_z", "front_height", "back_height", "toe_width", "volume")


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _runs(rows: str, flag: str, least: int) -> str:
    """``ru``: rows of runs of at least ``least`` flagged rows of ``rows`` (line_id, transect_id) that follow each other."""
    return f""", ru AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS k FROM (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY transect_id) AS run FROM (
 SELECT *, ({flag}) AS f, CASE WHEN ({flag}) IS DISTINCT FROM lag({flag}) OVER (PARTITION BY line_id ORDER BY transect_id) THEN 1 ELSE 0 END AS c FROM (SELECT *, transect_id // 50 AS line_id FROM {rows}))) WHERE f) WHERE k >= {least})"""


_DUNES = _BARRIER + """, fq AS (SELECT transect_id, min(ix) FILTER (z > 2) AS i0, min(ix) FILTER (z > 6) AS i1 FROM profile GROUP BY 1),
 ff AS (SELECT fq.transect_id, coalesce(CASE WHEN i1 > i0 AND b.z > a.z THEN round((b.z - a.z) / (b.dist - a.dist), 6) END, 0.05) AS slope FROM fq LEFT JOIN profile a ON a.transect_id = fq.transect_id AND a.ix = i0 LEFT JOIN profile b ON b.transect_id = fq.transect_id AND b.ix = i1),
 du AS (SELECT ff.transect_id, slope, toe_z, crest_z, toe_dist, crest_dist FROM ff LEFT JOIN ba USING (transect_id))"""
_DUNE_OUT = ("slope", "toe_z", "crest_z", "toe_dist", "crest_dist")
_BARRIER_RUNS, _CLIFF_RUNS = _BARRIER + _runs("ba", "crest_z IS NOT NULL", 2), _cliffs("SELECT * FROM cliff_profile") + _runs("cc", "height > 0", 1)
_UNBROKEN = _BARRIER + _runs("(SELECT * FROM (SELECT DISTINCT transect_id FROM profile) LEFT JOIN ba USING (transect_id))", "crest_z IS NOT NULL", 2)
_BARRIER_LINES = " UNION ALL ".join(f" SELECT '{kind}' AS kind, line_id, run, {'2000000000 - ' * back}transect_id AS seq, round({d}, 6) AS x, transect_id * 10.0::DOUBLE AS y FROM ru" for kind, d, back in (
    ("front_top", "top_dist", False), ("front_toe", "toe_dist", False), ("back_top", "back_top_dist", False), ("back_toe", "back_toe_dist", False),
    ("top_patch", "top_dist", False), ("top_patch", "back_top_dist", True), ("toe_patch", "toe_dist", False), ("toe_patch", "back_toe_dist", True)))

for _name, _function, _views, _then in (
    ("cliff_detect", Z.cliff_detect, ("cliff_profile",), _cliffs("SELECT * FROM cliff_profile") + _CLIFF),
    ("cliff_detect_window", Z.cliff_detect_window, ("cliff_profile",), _cliffs("SELECT * FROM cliff_profile WHERE z > 0 AND dist <= 300") + _CLIFF),
    ("rocky_cluster", Z.rocky_cluster, ("profile",), _ROUGH + " SELECT transect_id, rocky FROM rk"),
    ("barrier_detect", Z.barrier_detect, ("profile",), _BARRIER + f" SELECT transect_id, {_r(*_OUT)} FROM ba"),
    ("barrier_detect_window", Z.barrier_detect_window, ("profile",), _SOFT + _WINDOW + _BACK + f" SELECT transect_id, {_r(*_OUT)} FROM ba"),
    ("barrier_elevations", Z.barrier_elevations, ("profile",), _BARRIER + f" SELECT transect_id, {_r('toe_z', 'top_z', 'crest_z', 'back_toe_z')} FROM ba"),
    ("morphology_all", X.morphology_all, ("profile",), _BARRIER + f" SELECT ro.transect_id, {_r('slope_rough', 'z_rough')}, slope_rough > 0.05 AND z_rough > 0.2 AS rocky, {_r('crest_z', 'front_height', 'toe_width')} FROM ro LEFT JOIN ba USING (transect_id)"),
    ("crest_lines", X.crest_lines, ("profile",), _BARRIER_RUNS + f" SELECT line_id, run, transect_id, {_r('crest_dist', 'crest_z')} FROM ru"),
    ("barrier_lines", X.barrier_lines, ("profile",), _BARRIER_RUNS + " SELECT line_id, run, transect_id, round(toe_dist, 6) AS front_dist, round(back_toe_dist, 6) AS back_dist FROM ru"),
    ("cliff_lines", X.cliff_lines, ("cliff_profile",), _CLIFF_RUNS + f" SELECT line_id, run, transect_id, {_r('top_dist', 'toe_dist')} FROM ru"),
    ("sink_crest_points", X.sink_crest_points, ("profile",), _BARRIER + f" SELECT transect_id // 50 AS line_id, transect_id, {_r('crest_dist', 'crest_z', 'toe_width', 'volume')} FROM ba"),
    ("sink_front_points", X.sink_front_points, ("profile",), _BARRIER + f" SELECT transect_id // 50 AS line_id, transect_id, {_r('toe_dist', 'toe_z', 'front_height')} FROM ba"),
    ("sink_barrier_table", X.sink_barrier_table, ("profile",), _BARRIER + f" SELECT transect_id, {_r('toe_z', 'crest_z', 'back_toe_z')} FROM ba"),
    ("sink_barriers", X.sink_barriers, ("profile",), _UNBROKEN + _BARRIER_LINES),
    ("sink_dune_params", X.sink_dune_params, ("profile",), _DUNES + f" SELECT transect_id, {_r(*_DUNE_OUT)} FROM du"),
    ("sink_dune_sis", X.sink_dune_sis, ("profile", "storm_in"), _DUNES + C._RUN + C._DUNE + C._REG + f" SELECT transect_id, {_r(*_DUNE_OUT)}, scenario, round(twl, 6) AS twl, regime, round(asset_dist, 6) AS asset_dist, round(asset_elev, 6) AS asset_elev FROM du LEFT JOIN (SELECT transect_id, scenario, twl, regime, asset_dist, asset_elev FROM rg WHERE regime IN {C.X.REGIMES!r}) USING (transect_id)"),
    ("sink_cliffs", X.sink_cliffs, ("cliff_profile",), _CLIFF_RUNS + " SELECT line_id, run, transect_id AS seq, round(top_dist, 6) AS x, transect_id * 10.0::DOUBLE AS y FROM ru UNION ALL SELECT line_id, run, 2000000000 - transect_id, round(toe_dist, 6), transect_id * 10.0::DOUBLE FROM ru"),
    ("sink_crest_lines", X.sink_crest_lines, ("profile",), _UNBROKEN + " SELECT line_id, run, transect_id AS seq, round(crest_dist, 6) AS x, transect_id * 10.0::DOUBLE AS y, round(crest_z, 6) AS z FROM ru"),
):
    query(_name, _sql(*_views, then=_then))(_function)
