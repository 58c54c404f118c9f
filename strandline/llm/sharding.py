"""Uniform shuffle into shards of exact size by a communication matrix.

A uniform random permutation of N rows that lie in blocks sends a random
number of rows from each block to each shard.  That matrix follows the
multivariate hypergeometric law.  Drawing it first makes everything after it
local: each block permutes its own rows and cuts them at the drawn counts, the
rows are exchanged once, and each shard permutes what it received.

The matrix is drawn top-down over a binary tree of blocks.  A tree node holds
its number of rows and the room it has in every shard; its left child draws
how much of that room it fills, the right child keeps the rest.  Nodes of one
level are independent rows of a small DataFrame.  All randomness is a hash of
(seed, node, shard) or (seed, row), so a recomputed task draws the same values
and lost executors change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import durable, small

#: Rows of a block, as a target: it decides how many blocks there are.
BLOCK_ROWS = 65_536
#: Blocks at least, so that small inputs still use many tasks.
LEAST_BLOCKS = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit(*parts: Column) -> Column:
    """A uniform number in (0, 1) from a hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(2**53))


def hypergeometric(total: Column, good: Column, draws: Column, unit: Column) -> Column:
    """Marked rows among ``draws`` rows taken from ``total``, of which ``good`` are marked.

    Inversion of the distribution around its mode.  Weights relative to the
    mode follow from the ratio of neighbouring terms; terms more than 12
    standard deviations away (together under 1e-30) are not visited.  All
    arguments are doubles that hold whole numbers.
    """
    def on_facts(p: Column) -> Column:
        share = p["good"] / F.greatest(p["total"], F.lit(1.0))
        spread = F.sqrt(F.greatest(F.lit(0.0), p["draws"] * share * (1 - share)))
        reach = F.ceil(12 * spread) + 12
        mode = F.floor((p["draws"] + 1) * (p["good"] + 1) / (p["total"] + 2))
        low = F.greatest(F.lit(0.0), p["draws"] + p["good"] - p["total"])
        high = F.least(p["draws"], p["good"])
        return _let(
            F.struct(
                p["total"].alias("m"), p["good"].alias("g"), p["draws"].alias("n"), p["unit"].alias("u"),
                F.least(F.greatest(mode, low), high).cast("long").alias("mode"),
                F.greatest(low, mode - reach).cast("long").alias("low"),
                F.least(high, mode + reach).cast("long").alias("high"),
            ),
            on_bounds,
        )

    def on_bounds(b: Column) -> Column:
        none = F.array().cast("array<bigint>")
        up = F.when(b["high"] > b["mode"], F.sequence(b["mode"] + 1, b["high"])).otherwise(none)
        down = F.when(b["low"] < b["mode"], F.sequence(b["mode"] - 1, b["low"], F.lit(-1).cast("long"))).otherwise(none)

        def rise(k: Column) -> Column:  # weight of k over that of k - 1
            return (b["g"] - k + 1) * (b["n"] - k + 1) / (k * (b["m"] - b["g"] - b["n"] + k))

        def fall(k: Column) -> Column:  # weight of k over that of k + 1
            return (k + 1) * (b["m"] - b["g"] - b["n"] + k + 1) / ((b["g"] - k) * (b["n"] - k))

        def weigh(ratio):
            return lambda s, k: _let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

        def walk(ratio):
            return lambda s, k: _let(
                s["w"] * ratio(k),
                lambda w: F.struct(
                    w.alias("w"), (s["left"] - w).alias("left"),
                    F.when((s["left"] > 0) & (s["left"] <= w), k).otherwise(s["pick"]).alias("pick"),
                ),
            )

        def total_of(seq, ratio):
            return F.aggregate(seq, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), weigh(ratio))["sum"]

        def on_mark(mark: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), (mark - 1).alias("left"), b["mode"].alias("pick"))
            first = F.aggregate(up, start, walk(rise))
            return _let(
                first,
                lambda f: F.aggregate(
                    down, F.struct(F.lit(1.0).alias("w"), f["left"].alias("left"), f["pick"].alias("pick")), walk(fall)
                )["pick"],
            )

        return _let(b["u"] * (1 + total_of(up, rise) + total_of(down, fall)), on_mark)

    facts = F.struct(total.alias("total"), good.alias("good"), draws.alias("draws"), unit.alias("unit"))
    return _let(facts, on_facts).cast("double")


def _split_room(room: Column, rows: Column, node: Column, seed: int) -> Column:
    """How many of ``rows`` rows fill each shard, when the shards have ``room`` in all."""
    start = F.struct(
        rows.cast("double").alias("draws"),
        F.aggregate(room, F.lit(0.0), lambda s, x: s + x).alias("total"),
        F.array().cast("array<double>").alias("taken"),
    )

    def step(s: Column, i: Column) -> Column:
        return _let(
            F.get(room, i),
            lambda g: _let(
                hypergeometric(s["total"], g, s["draws"], _unit(F.lit(seed), node, i)),
                lambda x: F.struct(
                    (s["draws"] - x).alias("draws"), (s["total"] - g).alias("total"),
                    F.concat(s["taken"], F.array(x)).alias("taken"),
                ),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(room) - 1), start, step)["taken"]


def communication_matrix(counts: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """(block, cuts): where the permuted rows of each block are cut between shards.

    ``counts`` holds (block, n) for blocks 0 to 2**levels - 1; absent blocks
    have no rows.  ``cuts`` are running totals, one for each shard.  A shard
    gets floor or ceiling of the mean number of rows.
    """
    # The rows under every tree node, at every level; node 1 is the root.
    sizes = (
        counts.select(F.col("n").cast("double").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("up"), (F.col("block") + 2**levels).alias("leaf"))
        .groupBy(F.expr("shiftright(leaf, up)").alias("node"))
        .agg(F.sum("n").alias("n"))
    )
    root = sizes.filter("node = 1").select(
        F.col("node"),
        F.transform(
            F.sequence(F.lit(0), F.lit(shards - 1)),
            lambda s: F.floor(F.col("n") / shards).cast("double") + F.when(s < F.pmod(F.col("n"), F.lit(float(shards))), 1.0).otherwise(0.0),
        ).alias("room"),
    )
    level = root
    for _ in range(levels):
        left = sizes.select((F.col("node") / 2).cast("long").alias("node"), F.col("n").alias("rows"), F.pmod("node", F.lit(2)).alias("side")).filter("side = 0")
        level = (
            level.join(left, "node", "left")
            .select("node", "room", _split_room(F.col("room"), F.coalesce("rows", F.lit(0.0)), F.col("node"), seed).alias("taken"))
            .select(
                F.explode(
                    F.array(
                        F.struct((F.col("node") * 2).alias("node"), F.col("taken").alias("room")),
                        F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("room", "taken", lambda a, b: a - b).alias("room")),
                    )
                ).alias("child")
            )
            .select("child.*")
        )
    running = F.aggregate(
        F.col("room"), F.array().cast("array<double>"),
        lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0.0)))),
    )
    return level.select((F.col("node") - 2**levels).alias("block"), running.alias("cuts"))


def _body(held: DataFrame) -> Column:
    """A hash of the whole row but its maps, which Spark doesn't hash."""
    return F.xxhash64(*[F.col(f"row.`{f.name}`") for f in held.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()])


def _in_blocks(held: DataFrame, own: list[Column], blocks: int, seed: int, block_rows: int) -> DataFrame:
    """(row, block, born): every row of ``held`` (row) in the block that its key falls into.

    A key of more than ``block_rows`` rows would fill one block.  Its rows are
    counted where they are equal, before they are exchanged, and made again in
    parts of ``block_rows``; each falls into a block of its own draw.  ``born``
    tells them apart and is 0 for all other rows.  There are at most as many
    such keys as blocks.
    """
    at = lambda *parts: F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), *own, *parts), F.lit(blocks))
    marked = held.withColumn("mark", F.xxhash64(*own))
    hot = durable(marked.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows).select("mark"), "sharding-hot")
    if not hot.limit(1).count():
        return held.select("row", at().alias("block"), F.lit(0).cast("long").alias("born"))
    hot = small(hot)
    rest = marked.join(hot, "mark", "left_anti").select("row", at().alias("block"), F.lit(0).cast("long").alias("born"))
    equal = marked.join(hot, "mark", "left_semi").groupBy("row").agg(F.count("*").alias("n"))
    parts = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_rows)))).repartition("part", _body(held))
    copies = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * block_rows + 1, F.least("n", (F.col("part") + 1) * block_rows))))
    born = copies.select("row", F.xxhash64(_body(held), "copy").alias("born"))
    return rest.unionByName(born.select("row", at("born").alias("block"), "born"))


def uniform_shards(
    docs: DataFrame, shards: int, *, key: list[str], seed: int = 20_240_607,
    block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """All rows of ``docs`` in random order, with ``shard`` and ``slot``.

    ``key`` names the columns that tell rows apart; rows equal in all of them
    are numbered, so copies too go to places of their own.  Nulls are values
    like any other.  ``slot`` counts from 0 without gaps in each shard.
    Columns ``shard`` and ``slot`` of the input are replaced.  An empty input
    gives an empty result with the same columns.  The input is counted twice
    (its keys and its block sizes) and exchanged twice, by block and by place
    in the shard; no window spans more than one block or one slice of a shard,
    also where one row is repeated without end.
    """
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    n = docs.count()
    levels = max(1, (max(least_blocks, -(-n // block_rows)) - 1).bit_length())
    slices = max(4, -(-n // (shards * block_rows)))
    # Rows travel as one column, so that their names never clash with ours.
    own = [F.col(f"row.`{k}`") for k in key]
    mix = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *own)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    blocks = _in_blocks(held, own, 2**levels, seed, block_rows)
    # Rows equal in the key alone are numbered in an order of their own, the same on every run.
    copy = Window.partitionBy("block", *own).orderBy("born", _body(held))
    rows = blocks.withColumn("copy", F.row_number().over(copy)).select("row", "block", F.xxhash64(mix("first"), "copy").alias("first"), F.xxhash64(mix("second"), "copy", "born").alias("second"))
    counts = blocks.groupBy("block").agg(F.count("*").alias("n"))
    cuts = communication_matrix(counts, levels, shards, seed)
    local = Window.partitionBy("block").orderBy("first", *own)
    dealt = (
        rows.withColumn("place", F.row_number().over(local) - 1)
        .join(cuts, "block")
        .select(
            "row", "second",
            F.size(F.filter("cuts", lambda c: c <= F.col("place"))).alias("shard"),
            # A slice is a range of the second random key, so slices in turn are one random order.
            F.floor((F.shiftrightunsigned("second", 11).cast("double") / float(2**53)) * slices).alias("slice"),
        )
    )
    starts = (
        dealt.groupBy("shard", "slice").agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("slice")) - F.col("n"))
        .drop("n")
    )
    again = Window.partitionBy("shard", "slice").orderBy(F.shiftrightunsigned("second", 11), *own)
    return (
        dealt.withColumn("rank", F.row_number().over(again) - 1)
        .join(starts, ["shard", "slice"])
        .select("row.*", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    )


def shard_digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The registered query: sizes, checksums and places of all documents.

    A null text has size 8 and a null checksum.  The law is ``rows``: shard
    sizes differ by one row at most, so ``grown_shard`` is null.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
    )
    return uniform_shards(rows, shards, key=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
