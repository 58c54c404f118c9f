"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key whose rate is its quality weight, so
taking documents of a source in key order is a weighted sample without
replacement of any size.  Running sums of document sizes in that order meet the
source's token budget.  A budget above the source's size first takes complete
epochs of all its documents; the fraction that is left takes the sample.

A source may hold a third of all rows, so its running sum is made in two steps:
sums over slices of the key's range, then a window inside each slice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import durable, small

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source may be repeated at most.
MOST_EPOCHS = 3
#: Rows of a slice of the key's range, as a target, and slices at least.
SLICE_ROWS = 65_536
LEAST_SLICES = 64
SEED = 7

WORD = r"[^\x20\x09-\x0D]+"
MARK = r"[#$%&*|!~^<>{}=+_\\\[\]]"


def unit(column: Column, seed: int) -> Column:
    """A uniform number in (0, 1) from the value as text; null is a value too."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def water_levels(sources: DataFrame) -> DataFrame:
    """(…, target) for sources (``name``, ``absent``, ``source_size``).

    All sizes are shared by weight.  A target stops at ``MOST_EPOCHS`` times
    its source's size; what exceeds is shared again by weight until none is
    above.  The fixed point is one level, ``level * weight``, for all sources
    that don't stop, and it is found in order of cap per weight.
    """
    order = Window.orderBy("absent", "name")
    by_ratio = Window.orderBy("ratio", "absent", "name")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * MOST_EPOCHS)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left_size") / F.col("left_weight"))
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("found", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("rank", "level"))).over(everything))
        .select("name", "absent", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("found.level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))
    )


def sized(docs: DataFrame, seed: int = SEED, weight: str | None = None, *also: str) -> DataFrame:
    """(also, doc_id, name, absent, size, key): what mixing needs of each document.

    ``weight`` names a column of quality weights above 0 up to 1 (null: 1);
    without it the weight is the share of words against words and symbol marks.
    A row without an id draws its key by the digest of its text.
    """
    c = F.col
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    marks = F.coalesce(F.regexp_count("text", F.lit(MARK)), F.lit(0)).cast("long")
    quality = F.coalesce(c(weight).cast("double"), F.lit(1.0)) if weight else (c("size") + 1) / (c("size") + 1 + c("marks"))
    drawn = F.coalesce(c("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select(
        *also, "doc_id", F.coalesce(c("source").cast("string"), F.lit("")).alias("name"), c("source").isNull().alias("absent"), size.alias("size"), marks.alias("marks"),
        unit(drawn, seed).alias("unit"), *([c(weight)] if weight else []))
    return rows.select(*also, "doc_id", "name", "absent", "size", (-F.log("unit") / quality).alias("key"))


#: What rows have in common that are equal to the mix.
GROUP = ["name", "absent", "key", "doc_id", "size"]


def mix_groups(rows: DataFrame) -> DataFrame:
    """(name, absent, key, doc_id, size, n, source_size, target, epochs, more) for groups of equal rows of ``sized``.

    Each of a group's ``n`` rows is taken ``epochs`` times, and ``more`` of them
    once more.  Groups count as one row each, so an id of any number of rows is
    one row of its slice.
    """
    groups = durable(rows.groupBy(*GROUP).agg(F.count("*").alias("n")), "mixing-groups")
    slices = max(LEAST_SLICES, -(-groups.count() // SLICE_ROWS))
    total = F.col("n") * F.col("size")
    sources = water_levels(groups.groupBy("name", "absent").agg(F.sum(total).alias("source_size")))
    plan = sources.withColumn("epochs", F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).select(
        "name", "absent", "source_size", "target",
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
        (F.col("target") - F.coalesce("epochs", F.lit(0)) * F.col("source_size")).alias("rest"),
    )
    # Keys are exponential with rates up to 1, so no slice of equal width holds more than ln 2 / slices of the groups.
    cut = groups.withColumn("slice", F.floor(F.col("key") * (slices / math.log(2))))
    sums = cut.groupBy("name", "absent", "slice").agg(F.sum(total).alias("total"))
    starts = sums.withColumn("start", F.sum("total").over(Window.partitionBy("name", "absent").orderBy("slice")) - F.col("total")).drop("total")
    inside = Window.partitionBy("name", "absent", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("start") + F.col("upto") - total
    one = F.when(before + F.col("size") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0)
    # The middle of the j-th row lies (j - 1/2) sizes past what is before the group.
    many = F.least(F.greatest(F.floor((F.col("rest") - before) / F.nullif("size", F.lit(0)) + 0.5), F.lit(0)), F.col("n"))
    return (
        cut.withColumn("upto", F.sum(total).over(inside))
        .join(starts, ["name", "absent", "slice"])
        .join(plan, ["name", "absent"])
        .withColumn("more", F.when((F.col("n") == 1) | (F.col("size") == 0), one * F.col("n")).otherwise(many).cast("long"))
        .select(*GROUP, "n", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "more")
    )


def mix_sources(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row for each row of ``docs``.

    ``size`` counts words between blanks (null: 0).  ``taken`` counts the words
    the mix takes, repeats included: complete epochs, and one more copy of the
    documents whose middle lies within the rest of the budget, so a source ends
    within half a document of its target.  Documents of size 0 add nothing.
    Rows with equal ids draw equal keys and stand next to each other; equal ones
    are counted, and made again from their count in parts of ``SLICE_ROWS`` that
    fall into tasks of their own.  A null source is a source of its own, after
    all others.  Extra columns are ignored.
    """
    groups = durable(mix_groups(durable(sized(docs, seed, weight), "mixing-sizes")), "mixing-mix")
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLICE_ROWS))
    # By number: the few rows that make many would be joined to one partition else.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = groups.filter(F.col("n") > SLICE_ROWS).withColumn("part", F.explode(parts)).repartition(tasks, *GROUP, "part")
    cut = groups.filter(F.col("n") <= SLICE_ROWS).withColumn("part", F.lit(0).cast("long")).unionByName(many)
    first = F.col("part") * SLICE_ROWS
    rows = cut.withColumn("row", F.explode(F.sequence(first, F.least(first + SLICE_ROWS, F.col("n")) - 1)))
    return rows.withColumn("copies", (F.col("epochs") + F.when(F.col("row") < F.col("more"), 1).otherwise(0)).cast("int")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED, weight: str | None = None) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, all columns kept, whatever their names.

    Of a group of equal ids, sources and sizes, the mix may take some rows once
    more than the others (one group of each source at most): those rows are
    numbered, in two levels of counts, and the first ones are taken.
    """
    own = {n: F.col(f"`{n}`") for n in ["doc_id", "source", "text", *([weight] if weight else [])]}
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(columns, *own.values())
    base = durable(sized(held.select(*own), seed, weight), "mixing-sizes")
    groups = durable(mix_groups(base).filter("epochs > 0 or more > 0").select(*GROUP, "n", "epochs", "more"), "mixing-groups-taken")
    rows = sized(held, seed, weight, "row")
    same = lambda g: (rows["doc_id"].eqNullSafe(g["doc_id"]) & (rows["name"] == g["name"]) & (rows["absent"] == g["absent"]) & (rows["key"] == g["key"]) & (rows["size"] == g["size"]))
    whole = groups.filter("more = 0 or more = n")
    whole = whole.select(*GROUP, (F.col("epochs") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("times"))
    taken = rows.join(small(whole), same(whole)).select("row", "times")
    some = groups.filter("more > 0 and more < n").withColumn("g", F.xxhash64(*GROUP))
    if some.limit(1).count():
        parted = durable(rows.join(small(some), same(some)).select("row", "g", "epochs", "more", F.monotonically_increasing_id().alias("at")), "mixing-parted")
        part = F.shiftright("at", 33).alias("part")
        counts = parted.groupBy("g", part).agg(F.count("*").alias("n"))
        before = counts.withColumn("past", F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n")).select("g", "part", "past")
        inside = F.row_number().over(Window.partitionBy("g", "part").orderBy("at"))
        numbered = parted.select("row", "g", "epochs", "more", "at", part).withColumn("place", inside).join(small(durable(before, "mixing-parts")), ["g", "part"])
        once = F.when(F.col("place") + F.col("past") <= F.col("more"), 1).otherwise(0)
        taken = taken.unionByName(numbered.select("row", (F.col("epochs") + once).alias("times")).filter("times > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")


#: The same mix in DuckDB: one running sum for each source.
ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS drawn, coalesce(source, '') AS name, source IS NULL AS absent,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(len(regexp_extract_all(text, '[#$%&*|!~^<>{{}}=+_\\\[\]]')), 0) AS marks
  FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('{SEED}:' || drawn), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
    / (CAST(size + 1 AS DOUBLE) / (size + 1 + marks)) AS key FROM sized),
sources AS (SELECT name, absent, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY absent, name) - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS cap FROM sources),
ranked AS (SELECT *, cap / weight::DOUBLE AS ratio, row_number() OVER (ORDER BY cap / weight::DOUBLE, absent, name) AS rank FROM weighed),
levels AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM ranked),
found AS (SELECT arg_min(level, rank) AS level FROM levels WHERE ratio >= level),
targets AS (SELECT name, absent, source_size, least(CAST(cap AS DOUBLE), coalesce(f.level * weight, CAST(cap AS DOUBLE))) AS target FROM levels l, found f),
plan AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs FROM targets),
summed AS (SELECT k.*, sum(size) OVER (PARTITION BY name, absent ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM keyed k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END AS INT) AS copies
FROM summed JOIN plan USING (name, absent)
"""
