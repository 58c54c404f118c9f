"""Cross-shore profiles: one row (keys, ix, dist, z) for each node.

The detectors need a whole profile at once, so it is packed into one array and
folded over in one expression, to its fixed point; a profile is bounded by its
transect's length.  Functions named ``_of`` take profiles that are packed
already, so that several detectors share one exchange of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.expr import let


def crossings(profile: DataFrame, keys: list[str], level: Column | float) -> DataFrame:
    """Positions where the profile crosses a level, interpolated, numbered from the sea."""
    level = F.lit(level) if isinstance(level, int | float) else level
    by = Window.partitionBy(*keys).orderBy("ix")
    rows = profile.select(*keys, "ix", "dist", "z", level.alias("level"), F.lead("z").over(by).alias("z2"), F.lead("dist").over(by).alias("d2"))
    hit = rows.filter(((F.col("z") > F.col("level")) != (F.col("z2") > F.col("level"))) & (F.col("z") != F.col("z2")))
    share = F.abs((F.col("level") - F.col("z")) / (F.col("z2") - F.col("z")))
    return hit.select(*keys, "level", "ix", (F.col("dist") + share * (F.col("d2") - F.col("dist"))).alias("position"), (F.col("z2") > F.col("z")).alias("rising")).withColumn("number", F.row_number().over(by))


def index_above(profile: DataFrame, keys: list[str], level: float) -> DataFrame:
    """First index above a level and the one seaward of it."""
    return profile.groupBy(*keys).agg(F.min(F.when(F.col("z") > level, F.col("ix"))).alias("ix_above")).withColumn("ix_seaward", F.when(F.col("ix_above") > 0, F.col("ix_above") - 1))


def widths(profile: DataFrame, keys: list[str], level: float) -> DataFrame:
    """First width and total width above a level, from pairs of rising and falling crossings."""
    c = crossings(profile, keys, level)
    by = Window.partitionBy(*keys).orderBy("ix")
    pairs = c.withColumns({"next": F.lead("position").over(by), "next_rising": F.lead("rising").over(by)}).filter(F.col("rising") & ~F.col("next_rising"))
    pairs = pairs.withColumn("k", F.row_number().over(by))
    found = pairs.groupBy(*keys).agg(F.sum(F.when(F.col("k") == 1, F.col("next") - F.col("position"))).alias("width"), F.sum(F.col("next") - F.col("position")).alias("total_width"), F.count("*").alias("n"))
    return profile.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("total_width", F.lit(0.0)).alias("total_width"), F.coalesce("n", F.lit(0)).alias("n"))


def volume_above(profile: DataFrame, keys: list[str], level: float, step: float) -> DataFrame:
    """Volume above a level between its first two crossings."""
    c = crossings(profile, keys, level).groupBy(*keys).agg(F.min(F.when(F.col("number") == 1, F.col("position"))).alias("p0"), F.min(F.when(F.col("number") == 2, F.col("position"))).alias("p1"))
    inside = profile.join(c, keys).filter((F.col("dist") >= F.col("p0")) & (F.col("dist") <= F.col("p1")))
    return inside.groupBy(*keys).agg(F.first(F.col("p1") - F.col("p0")).alias("width"), F.sum((F.col("z") - level) * step).alias("volume"))


def gradient(profile: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Slope by central differences, one-sided at the ends, and the slope's slope."""
    by = Window.partitionBy(*keys).orderBy("ix")

    def diff(c: str) -> Column:
        a, b, x = F.lag(c).over(by), F.lead(c).over(by), F.col(c)
        return F.when(a.isNull(), (b - x) / step).when(b.isNull(), (x - a) / step).otherwise((b - a) / (2 * step))

    rows = profile.withColumn("slope", diff("z"))
    return rows.withColumn("curvature", diff("slope"))


def roughness(profile: DataFrame, keys: list[str], step: float, top: float) -> DataFrame:
    """P95 - P5 of slope and spread of height between -1 and ``top``; rocky above 0.05 and 0.2."""
    return roughness_of(whole(profile, keys), step, top).filter("z_rough is not null").select(*keys, "slope_rough", "z_rough", "rocky")


def roughness_of(profiles: DataFrame, step: float, top: float) -> DataFrame:
    """Profiles ``q`` of ``whole`` with their roughness: null where no node lies between -1 and ``top``."""
    q = F.col("q")
    kept = F.filter(F.transform(q, lambda a, i: F.struct(a["z"].alias("z"), ((F.get(q, i + 1)["z"] - a["z"]) / step).alias("s"))), lambda a: (a["z"] > -1) & (a["z"] < top))
    rows = profiles.withColumn("_k", _once(kept)).withColumn("_s", _once(F.sort_array(F.filter(F.col("_k")["s"], lambda s: s.isNotNull()))))
    # Mean and squares of deviations are carried from node to node, as Spark's own aggregate carries them.
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(m: Column, a: Column) -> Column:
        return let((a["z"] - m["mean"]) / (m["n"] + 1), lambda d: F.struct((m["n"] + 1).alias("n"), (m["mean"] + d).alias("mean"), (m["m2"] + (a["z"] - m["mean"]) * (a["z"] - m["mean"] - d)).alias("m2")))

    z_rough = F.aggregate("_k", none, add, lambda m: F.sqrt(m["m2"] / F.nullif(m["n"], F.lit(0.0))))
    rows = rows.withColumns({"slope_rough": _quantile(F.col("_s"), 0.95) - _quantile(F.col("_s"), 0.05), "z_rough": z_rough})
    return rows.drop("_k", "_s").withColumn("rocky", (F.col("slope_rough") > 0.05) & (F.col("z_rough") > 0.2))


def _quantile(values: Column, share: float) -> Column:
    """The value at a share of a sorted array, between two of them in proportion; none of an empty array."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.get(values, low), F.get(values, high)
    return F.when(a == b, a).otherwise((high - at) * a + (at - low) * b)


def whole(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One array ``q`` of (ix, dist, z) for each profile, in order, with missing heights."""
    return profile.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ix", "dist", "z"))).alias("q"))


def nodes(q: Column, where=None) -> Column:
    """The nodes (i, d, z) of an array of ``whole`` that have a height and meet a condition, numbered from 0."""
    held = F.filter(q, lambda a: a["z"].isNotNull() if where is None else a["z"].isNotNull() & where(a))
    return F.transform(held, lambda a, i: F.struct(i.alias("i"), a["dist"].alias("d"), a["z"].alias("z")))


def pack(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One array ``p`` of (i, d, z) for each profile, without missing heights."""
    return whole(profile.filter("z is not null"), keys).select(*keys, nodes(F.col("q")).alias("p"))


def _extreme(p: Column, a: Column, b: Column, first: Column, last: Column, sign: int) -> Column:
    """(r, i): the largest residual (least, for sign -1) from the chord a to b over [first, last].

    Of equal residuals the first index counts; ``r`` is signed so that larger is further.
    """
    def on_ends(e: Column) -> Column:
        slope = (e["b"]["z"] - e["a"]["z"]) / F.nullif(e["b"]["d"] - e["a"]["d"], F.lit(0.0))
        return let(slope, lambda k: let(
            F.array_max(F.transform(F.slice(p, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda o: F.struct((sign * (o["z"] - e["a"]["z"] - (o["d"] - e["a"]["d"]) * k)).alias("r"), (-o["i"]).alias("i")))),
            lambda m: F.struct(m["r"].alias("r"), (-m["i"]).alias("i"))))

    return let(F.struct(F.get(p, a).alias("a"), F.get(p, b).alias("b")), on_ends)


def _highest(p: Column, sign: int = 1) -> Column:
    """Index of the highest (or lowest) node, the first of equals."""
    return -F.array_max(F.transform(p, lambda a: F.struct((sign * a["z"]).alias("z"), (-a["i"]).alias("i"))))["i"]


def _repeat(start: Column, step, rounds: int | None, where: Column | None = None) -> Column:
    """``step`` applied until a state says it has not moved, or up to ``rounds`` times if given; null where ``where`` isn't met.

    A step moves one of two places of the profile ``p``, each in one way only or
    once for each place of the other, so twice the profile's length is always
    enough; what doesn't move costs nothing.  The result is exploded from an array of one, so that later filters use it
    as it is and are not turned into a second run of the fold.
    """
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds) if rounds else 2 * F.size("p") + 4), start, lambda s, _: F.when(s["moved"], step(s)).otherwise(s))
    return _once(fold if where is None else F.when(where, fold))


def _once(value: Column) -> Column:
    return F.explode(F.array(value))


def cliffs(profile: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame:
    """Cliff top and toe of each profile by repeated detrending, with the cliff's measures.

    Top moves seaward to the highest residual of the chord toe to last point,
    toe landward to the lowest residual of the chord first to top, until both
    stay; ``converged`` says that they did, also where ``rounds`` are given.
    """
    rows = _cliffs(pack(profile, keys).filter(F.exists("p", lambda a: a["z"] >= 10)), rounds).filter("s.top > s.toe")
    return rows.select(*keys, F.col("a.d").alias("top_dist"), F.col("b.d").alias("toe_dist"), "height", "slope", (~F.col("s.moved")).alias("converged"), "cliff")


def _cliffs(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows with an array ``p`` and what ``cliffs`` finds in it: places ``s``, null where none can be, nodes and measures."""
    last = F.array_max(F.transform(F.filter("p", lambda a: a["z"] != 0), lambda a: a["i"]))
    rows = rows.withColumns({"lo": _highest(F.col("p"), -1), "hi": _highest(F.col("p")), "last": last})
    p, lo, end = F.col("p"), F.col("lo"), F.col("last")

    def step(s: Column) -> Column:
        def on_top(t: Column) -> Column:
            top = F.when((t["i"] < s["top"]) & (t["r"] > 0.001), t["i"]).otherwise(s["top"])
            return let(top, lambda top: let(_extreme(p, lo, top, lo, top - 1, -1), lambda b: on_toe(top, F.when((b["i"] > s["toe"]) & (b["r"] > 0.001), b["i"]).otherwise(s["toe"]))))

        def on_toe(top: Column, toe: Column) -> Column:
            return let(toe, lambda toe: F.struct(top.alias("top"), toe.alias("toe"), ((top != s["top"]) | (toe != s["toe"])).alias("moved")))

        return let(_extreme(p, s["toe"], end, s["toe"], end - 1, 1), on_top)

    start = F.struct(end.alias("top"), lo.alias("toe"), F.lit(True).alias("moved"))
    rows = rows.withColumn("s", _repeat(start, step, rounds, F.exists("p", lambda a: a["z"] >= 10) & (F.col("last") > F.col("lo"))))
    rows = rows.withColumns({"a": F.get("p", "s.top"), "b": F.get("p", "s.toe"), "m": F.get("p", "hi")})
    run = F.when(F.col("s.top") > F.col("s.toe"), F.col("a.d") - F.col("b.d"))
    rows = rows.withColumns({"height": F.col("a.z") - F.col("b.z"), "slope": (F.col("a.z") - F.col("b.z")) / run})
    cliff = (F.col("s.top") > F.col("s.toe")) & (F.col("s.top") != F.col("hi")) & (F.abs(F.col("a.d") - F.col("m.d")) >= 10) & ((F.col("slope") > 0.6) | (F.col("height") > 15))
    return rows.withColumn("cliff", cliff)


def barriers(profile: DataFrame, keys: list[str], mhws: float, rounds: int | None = None, step: float = 5.0) -> DataFrame:
    """Front and back toe, crest, heights, widths and volume of the barrier in each profile.

    The front runs from the sea to the highest point, the back to the lowest
    residual within 300 m of it.  Profiles that stay under ``mhws`` or are
    highest at their first node have none.
    """
    return barriers_of(pack(profile.filter("z >= 0"), keys), keys, mhws, rounds, step)


def barriers_of(profiles: DataFrame, keys: list[str], mhws: float, rounds: int | None = None, step: float = 5.0) -> DataFrame:
    """``barriers`` of profiles ``p`` of ``pack``, without nodes under the sea."""
    rows = _risen(profiles, mhws)
    p, zero = F.col("p"), F.lit(0)

    def front(s: Column) -> Column:
        def on_top(t: Column) -> Column:
            ok = (t["i"] > 0) & (t["i"] < s["top"]) & (t["r"] > 0.001) & (F.get(p, t["i"])["z"] > mhws)
            return let(F.when(ok, t["i"]).otherwise(s["top"]), lambda top: let(_extreme(p, zero, top, zero, top, -1), lambda b: on_toe(top, F.when((b["i"] > s["toe"]) & (b["r"] > 0.001), b["i"]).otherwise(s["toe"]))))

        def on_toe(top: Column, toe: Column) -> Column:
            return let(toe, lambda toe: F.struct(top.alias("top"), toe.alias("toe"), ((top != s["top"]) | (toe != s["toe"])).alias("moved")))

        return let(_extreme(p, zero, s["top"], zero, s["top"], 1), on_top)

    rows = rows.withColumn("s", _repeat(F.struct(F.col("hi").alias("top"), zero.alias("toe"), F.lit(True).alias("moved")), front, rounds))
    # Once only: a toe under mean high water moves to the node nearest that level, or the one before if that is above it.
    under = F.slice("p", F.col("s.toe") + 1, F.greatest(F.col("s.top") - F.col("s.toe") + 1, zero))
    nearest = -F.array_max(F.transform(under, lambda a: F.struct((-F.abs(a["z"] - mhws)).alias("z"), (-a["i"]).alias("i"))))["i"]
    rows = rows.withColumns({"top": F.col("s.top"), "near": nearest})
    rows = rows.withColumn("toe", _once(F.when(F.get("p", "s.toe")["z"] < mhws, F.when(F.get("p", "near")["z"] > mhws, F.col("near") - 1).otherwise(F.col("near"))).otherwise(F.col("s.toe"))))
    rows = rows.filter("top > toe and top < last").withColumn("reach", F.get("p", "top")["d"] + 300)
    rows = rows.withColumn("m", F.array_max(F.transform(F.filter("p", lambda a: a["d"] <= F.col("reach")), lambda a: a["i"])))
    rows = rows.withColumn("m", _once(F.when(F.col("m") == F.col("top"), F.col("last")).otherwise(F.col("m"))))
    return _with_backs(rows, keys, rounds, step)


def barriers_window(profile: DataFrame, keys: list[str], mhws: float, least: float = 0.001, rounds: int | None = None, step: float = 5.0) -> DataFrame:
    """As ``barriers``, for profiles cut to a window: the front toe starts at the highest point and moves seaward.

    The toe moves to the lowest residual of the chord from the first node to
    itself while that lies more than ``least`` under it, and never stays
    landward of the top.  The first toe under mean high water moves, once, to
    the node nearest that level (or the one before if that is above it), and
    stays.  The back is looked for up to the last node.
    """
    return barriers_window_of(pack(profile.filter("z >= 0"), keys), keys, mhws, least, rounds, step)


def barriers_window_of(profiles: DataFrame, keys: list[str], mhws: float, least: float = 0.001, rounds: int | None = None, step: float = 5.0) -> DataFrame:
    """``barriers_window`` of profiles ``p`` of ``pack``, without nodes under the sea."""
    rows = _risen(profiles, mhws)
    p, zero = F.col("p"), F.lit(0)

    def front(s: Column) -> Column:
        def on_top(t: Column) -> Column:
            ok = (t["i"] > 0) & (t["i"] < s["top"]) & (t["r"] > 0.001) & (F.get(p, t["i"])["z"] > mhws)
            return let(F.when(ok, t["i"]).otherwise(s["top"]), lambda top: let(_extreme(p, zero, s["toe"], zero, s["toe"], -1), lambda b: on_low(top, b)))

        def on_low(top: Column, b: Column) -> Column:
            free = (b["i"] < s["toe"]) & (b["r"] > least) & ~s["level"]
            return let(F.least(F.when(free, b["i"]).otherwise(s["toe"]), top), lambda low: on_level(top, low))

        def on_level(top: Column, low: Column) -> Column:
            under = ~s["level"] & (F.get(p, low)["z"] < mhws)
            between = F.slice(p, low + 1, F.greatest(s["toe"] - low + 1, F.lit(1)))
            nearest = -F.array_max(F.transform(between, lambda a: F.struct((-F.abs(a["z"] - mhws)).alias("z"), (-a["i"]).alias("i"))))["i"]
            return let(F.when(under, let(nearest, lambda n: F.when(F.get(p, n)["z"] > mhws, n - 1).otherwise(n))).otherwise(low), lambda toe: F.struct(
                top.alias("top"), toe.alias("toe"), (s["level"] | under).alias("level"), ((top != s["top"]) | (toe != s["toe"])).alias("moved")))

        return let(_extreme(p, zero, s["top"], zero, s["top"], 1), on_top)

    start = F.struct(F.col("hi").alias("top"), F.col("hi").alias("toe"), F.lit(False).alias("level"), F.lit(True).alias("moved"))
    rows = rows.withColumn("s", _repeat(start, front, rounds)).withColumns({"top": F.col("s.top"), "toe": F.col("s.toe"), "m": F.col("last")})
    return _with_backs(rows.filter("top > toe and top < last"), keys, rounds, step)


def _risen(profiles: DataFrame, mhws: float) -> DataFrame:
    """Profiles with the place ``hi`` of their highest node, which reaches ``mhws`` and isn't the first, and of the ``last``."""
    rows = profiles.withColumns({"hi": _highest(F.col("p")), "last": F.size("p") - 1})
    return rows.filter((F.col("hi") > 0) & (F.get("p", "hi")["z"] >= mhws))


def _with_backs(rows: DataFrame, keys: list[str], rounds: int | None, step: float) -> DataFrame:
    """The measures of barriers with a known front (p, top, toe, last), the back being looked for up to node ``m``."""
    p, zero, top, m = F.col("p"), F.lit(0), F.col("top"), F.col("m")

    def back(s: Column) -> Column:
        def on_toe(b: Column) -> Column:
            ok = (b["i"] < s["toe"]) & (b["i"] > s["top"]) & (b["r"] > 0.001)
            return let(F.when(ok, b["i"]).otherwise(s["toe"]), lambda toe: let(_extreme(p, top, toe, top, toe, 1), lambda t: on_top(toe, F.when((t["i"] != s["top"]) & (t["i"] < toe) & (t["r"] > 0.001), t["i"]).otherwise(s["top"]))))

        def on_top(toe: Column, new: Column) -> Column:
            return let(new, lambda new: F.struct(new.alias("top"), toe.alias("toe"), ((new != s["top"]) | (toe != s["toe"])).alias("moved")))

        return let(_extreme(p, top, m, s["top"], m, -1), on_toe)

    rows = rows.withColumn("b", _repeat(F.struct(top.alias("top"), m.alias("toe"), F.lit(True).alias("moved")), back, rounds)).filter("b.top < last")
    inside = F.slice("p", F.col("toe") + 1, F.greatest(F.col("b.toe") - F.col("toe") + 1, zero))
    rows = rows.withColumn("inside", inside).withColumn("crest", F.array_max(F.transform("inside", lambda a: F.struct(a["z"].alias("z"), (-a["i"]).alias("i")))))
    g = lambda c: F.get("p", c)
    before = F.get("p", F.col("b.toe") - 1)
    volume = F.aggregate("inside", F.lit(0.0), lambda s, a: s + a["z"]) * step - (g("toe")["z"] + before["z"]) / 2 * F.abs(before["d"] - g("toe")["d"])
    return rows.select(
        *keys, g("toe")["d"].alias("toe_dist"), g("top")["d"].alias("top_dist"), g("b.top")["d"].alias("back_top_dist"), g("b.toe")["d"].alias("back_toe_dist"),
        F.get("p", -F.col("crest.i"))["d"].alias("crest_dist"), F.col("crest.z").alias("crest_z"), g("toe")["z"].alias("toe_z"), g("top")["z"].alias("top_z"), g("b.toe")["z"].alias("back_toe_z"),
        (g("top")["z"] - g("toe")["z"]).alias("front_height"), (g("b.top")["z"] - g("b.toe")["z"]).alias("back_height"), (g("b.toe")["d"] - g("toe")["d"]).alias("toe_width"), volume.alias("volume"))


def searchable(profile: DataFrame, keys: list[str], rocky: DataFrame, found: DataFrame) -> DataFrame:
    """The part of each profile where a barrier can be: none on rocky transects, nothing landward of a cliff's toe.

    ``rocky`` holds (keys, rocky), ``found`` the result of ``cliffs``; a
    transect missing from either, or of unknown roughness, is searched whole.
    """
    toes = found.filter("cliff").select(*keys, F.col("toe_dist").alias("cliff_toe"))
    soft = profile.join(rocky.filter("rocky").select(*keys), keys, "left_anti").join(toes, keys, "left")
    return soft.filter(F.col("cliff_toe").isNull() | (F.col("dist") <= F.col("cliff_toe"))).drop("cliff_toe")


def searchable_of(profiles: DataFrame, keys: list[str], rocky: Column, where=None) -> DataFrame:
    """``searchable`` of profiles ``q`` of ``whole``, as ``barriers_of`` takes them; ``where`` cuts the nodes further.

    Whether a transect is ``rocky`` and where its cliff's toe is are columns of
    its own row, so nodes are neither joined nor exchanged again.
    """
    rows = _cliffs(profiles.filter(~F.coalesce(rocky, F.lit(False))).withColumn("p", _once(nodes(F.col("q")))))
    rows = rows.select(*keys, "q", F.when(F.col("cliff"), F.col("b.d")).alias("cliff_toe"))

    def kept(a: Column) -> Column:
        here = (a["z"] >= 0) & (F.col("cliff_toe").isNull() | (a["dist"] <= F.col("cliff_toe")))
        return here if where is None else here & where(a)

    return rows.select(*keys, _once(nodes(F.col("q"), kept)).alias("p"))


def bins(profile: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Mean distance and height in steps of ``width`` along each profile, numbered from 1."""
    means = profile.filter("z is not null").groupBy(*keys, F.floor(F.col("dist") / width).alias("bin")).agg(F.avg("dist").alias("d"), F.avg("z").alias("z"))
    return means.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("bin")))


def cliffs_binned(profile: DataFrame, keys: list[str], width: float, lead: int = 5, falling: int = 8) -> DataFrame:
    """Cliff top and toe of each binned profile by one detrending, slope in degrees.

    A profile starts ``lead`` bins before its first bin above the sea, ends
    before the sea returns and before the bin where ``falling`` bins in a row
    have gone down.  The toe is the last bin before the land, the top the
    highest above the chord from first to last bin; of equal ones the first.
    Profiles under the sea have no row; where top and toe are one bin, or the
    profile is one bin, the slope is null.
    """
    whole, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("n")
    b = bins(profile, keys, width).withColumn("land", F.min(F.when(F.col("z") > 0, F.col("n"))).over(whole))
    b = b.filter(F.col("n") >= F.col("land") - lead).withColumn("sea", F.min(F.when((F.col("n") > F.col("land")) & (F.col("z") <= 0), F.col("n"))).over(whole))
    b = b.filter(F.col("sea").isNull() | (F.col("n") < F.col("sea")))
    falls = F.coalesce(F.col("z") < F.lag("z").over(by), F.lit(False))
    b = b.withColumn("falls", falls).withColumn("down", F.col("n") - F.max(F.when(~F.col("falls"), F.col("n"))).over(by))
    b = b.withColumn("stop", F.min(F.when(F.col("down") >= falling, F.col("n"))).over(whole)).filter(F.col("stop").isNull() | (F.col("n") < F.col("stop")))
    end = F.struct("n", "d", "z")
    b = b.withColumns({"a": F.min(end).over(whole), "e": F.max(end).over(whole)})
    tilt = F.coalesce((F.col("a.z") - F.col("e.z")) / F.nullif(F.col("e.d") - F.col("a.d"), F.lit(0.0)), F.lit(0.0))
    b = b.withColumn("r", F.col("z") - (F.col("e.d") - F.col("d")) * tilt)
    at_toe = F.col("n") == F.greatest(F.col("land") - 1, F.col("a.n"))
    found = b.groupBy(*keys).agg(
        F.max(F.when(F.col("z") != 0, F.struct("r", (-F.col("n")).alias("i"), "d"))).alias("top"),
        F.max(F.when(at_toe, F.struct("r", "d"))).alias("toe"), F.count("*").alias("n_bins"))
    height = F.col("top.r") - F.col("toe.r")
    slope = F.degrees(F.atan(height / F.nullif(F.abs(F.col("top.d") - F.col("toe.d")), F.lit(0.0))))
    return found.select(*keys, F.col("top.d").alias("top_dist"), F.col("toe.d").alias("toe_dist"), height.alias("height"), slope.alias("slope_deg"), "n_bins")


def barriers_simple(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Toe and top on both sides of the highest node above the sea, each by one detrending.

    A side is detrended by the chord from its end to the highest node; its top
    is the largest residual, its toe the least, of equal ones the node nearest
    the sea.  A top beyond its toe gives way to the highest node.
    """
    whole = Window.partitionBy(*keys)
    p = profile.filter("z > 0").withColumns({
        "hi": F.max(F.struct("z", (-F.col("ix")).alias("i"), "dist")).over(whole),
        "first": F.min(F.struct("ix", "dist", "z")).over(whole), "last": F.max(F.struct("ix", "dist", "z")).over(whole)})

    def residual(end: str) -> Column:
        tilt = (F.col("hi.z") - F.col(f"{end}.z")) / F.nullif(F.col("hi.dist") - F.col(f"{end}.dist"), F.lit(0.0))
        return F.col("z") + (F.col(f"{end}.dist") - F.col("dist")) * F.coalesce(tilt, F.lit(0.0))

    front, back = F.col("ix") <= -F.col("hi.i"), F.col("ix") >= -F.col("hi.i")
    p = p.withColumns({"fr": F.when(front, residual("first")), "br": F.when(back, residual("last"))})
    top = lambda r: F.max(F.when(F.col(r).isNotNull(), F.struct(r, (-F.col("ix")).alias("i"), "dist")))
    toe = lambda r: F.min(F.when(F.col(r).isNotNull(), F.struct(r, "ix", "dist")))
    s = p.groupBy(*keys).agg(F.first("hi").alias("hi"), top("fr").alias("ft"), toe("fr").alias("fb"), top("br").alias("bt"), toe("br").alias("bb"))
    return s.select(
        *keys, F.col("fb.dist").alias("toe_dist"), F.when(F.col("ft.dist") < F.col("fb.dist"), F.col("hi.dist")).otherwise(F.col("ft.dist")).alias("top_dist"),
        F.col("hi.dist").alias("crest_dist"), F.col("hi.z").alias("crest_z"),
        F.when(F.col("bt.dist") > F.col("bb.dist"), F.col("hi.dist")).otherwise(F.col("bt.dist")).alias("back_top_dist"), F.col("bb.dist").alias("back_toe_dist"))
