"""Jaccard join on word shingles with Bayesian pruning of candidate pairs.

Texts are sets of shingles of five words.  Equal texts are one member with a
number of copies.  MinHash values cut into bands give candidate groups: members
that share a band meet at the smallest member of that band, their leader.  A
group is compared in blocks of bounded size, block against block.  MinHash
values of a pair are compared a few at a time; as soon as the posterior
probability of reaching the threshold, given the matches so far, falls below
the tolerance, the pair is dropped.  Pairs that survive are verified exactly on
their shingle sets.  What leaves a block is one number of links for each member
and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import LOWER, TEXT_WORDS, bounded_batches, durable, mix, pieces, small, utf8, words

SHINGLE, THRESHOLD = 5, 0.8
#: At the threshold a pair misses all bands with probability (1 - 0.8**4)**28, under 4e-7.
BANDS, ROWS = 28, 4
VALUES = BANDS * ROWS
#: MinHash values compared at once, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Texts that are looked up by broadcast, at most.
WANTED_ROWS = 200_000
#: Members of a block, and bytes of their sets, about: blocks are dealt by hash.
BLOCK, BLOCK_BYTES = 256, 16 << 20

_RNG = np.random.default_rng(5)
_FACTORS = (_RNG.integers(1, 2**32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_TERMS = _RNG.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the shingles of a piece of lower-cased bytes, by row.

    A text of one to four words has one shingle, of all its words; a text
    without words has none.
    """
    w = words(data, offsets, TEXT_WORDS)
    n, rows = len(w.hash), len(offsets) - 1
    row, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= SHINGLE:
        m = n - SHINGLE + 1
        h = np.zeros(m, np.uint64)
        for i in range(SHINGLE):
            h += w.hash[i : i + m] * np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1)
        whole = w.row[:m] == w.row[SHINGLE - 1 :]
        row, h = w.row[:m][whole], mix(h[whole])
    size = np.bincount(w.row, minlength=rows)
    few = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(few):
        total = np.zeros(rows, np.uint64)
        at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(total, w.row, w.hash * (2 * at.astype(np.uint64) + np.uint64(5)))
        row, h = np.concatenate([row, few]), np.concatenate([h, mix(total[few] + np.uint64(1))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """``n`` by ``VALUES`` MinHash values of 16 bits; rows without shingles are zero."""
    out = np.zeros((n, VALUES), np.uint16)
    if len(row) == 0:
        return out
    small = (h >> np.uint64(32)).astype(np.uint32)
    heads = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
    for i in range(VALUES):
        least = np.minimum.reduceat(small * _FACTORS[i] + _TERMS[i], heads)
        out[row[heads], i] = ((least * np.uint32(0x9E3779B1)) ^ (least >> np.uint32(15))) >> np.uint32(16)
    return out


@cache
def least_matches() -> tuple[int, ...]:
    """For each number of compared values, the matches a pair must have.

    Under a uniform prior the similarity has a Beta(m + 1, n - m + 1)
    posterior after m of n values match.  The probability of the threshold or
    more is a sum of binomial terms.
    """
    found = []
    for n in range(STEP, VALUES + 1, STEP):
        def reach(m: int, n=n) -> float:
            terms = (lgamma(n + 2) - lgamma(k + 1) - lgamma(n + 2 - k) + k * np.log(THRESHOLD) + (n + 1 - k) * np.log(1 - THRESHOLD) for k in range(m + 1))
            return float(sum(np.exp(t) for t in terms))

        found.append(next(m for m in range(n + 1) if reach(m) >= TOLERANCE))
    return tuple(found)


def surviving(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of ``alive`` that no step of comparisons drops."""
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches()):
        part = slice(k * STEP, (k + 1) * STEP)
        for at in range(0, len(i), 65_536):
            own = slice(at, at + 65_536)
            matches[own] += (a[i[own], part] == b[j[own], part]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return np.stack([i, j], axis=1)


def verified(pairs: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Pairs whose shingle sets have a Jaccard similarity of the threshold or more."""
    if len(pairs) == 0:
        return pairs
    used_b = np.unique(pairs[:, 1])
    keys = np.unique(np.concatenate([b[j] for j in used_b]))
    ids = {j: np.searchsorted(keys, b[j]) for j in used_b.tolist()}
    marked = np.zeros(len(keys) + 1, bool)
    keep = np.zeros(len(pairs), bool)
    cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
    for rows in np.split(np.arange(len(pairs)), cuts):
        own = a[pairs[rows[0], 0]]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = at[keys[at] == own]
        marked[at] = True
        others = [ids[j] for j in pairs[rows, 1].tolist()]
        size = np.array([len(o) for o in others])
        common = np.add.reduceat(marked[np.concatenate(others)], np.cumsum(size) - size, dtype=np.int64)
        # common / (union) >= 4/5, in whole numbers
        keep[rows] = 5 * common >= 4 * (len(own) + size - common)
        marked[at] = False
    return pairs[keep]


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(root, member) of a forest that spans the pairs; roots are the smallest."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    touched = set()
    for x, y in pairs.tolist():
        touched.update((x, y))
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in touched if root(x) != x]


def compare_block(group: pd.DataFrame) -> pd.DataFrame:
    """Links inside one block pair of a candidate group.

    Rows are members (id, copies, side, leaders, values, set).  Sides 0 and 1
    are compared with each other; side 2 marks a block compared with itself.  A
    pair that shares several leaders counts at the smallest.
    """
    leader = int(group["leader"].iloc[0])
    own = group.drop_duplicates("id").sort_values("id")
    first = own[own["side"] != 1]
    second = own[own["side"] != 0]
    alone = (group["side"] == 2).all()
    a = np.stack([np.frombuffer(v, np.uint16) for v in first["values"]]) if len(first) else np.zeros((0, VALUES), np.uint16)
    b = a if alone else (np.stack([np.frombuffer(v, np.uint16) for v in second["values"]]) if len(second) else np.zeros((0, VALUES), np.uint16))
    alive = np.ones((len(a), len(b)), bool)
    if alone:
        alive = np.triu(alive, 1)
    sets_a = [np.frombuffer(s, np.uint64) for s in first["set"]]
    sets_b = sets_a if alone else [np.frombuffer(s, np.uint64) for s in second["set"]]
    pairs = verified(surviving(a, b, alive), sets_a, sets_b)
    lead_a = [set(x) for x in first["leaders"]]
    lead_b = lead_a if alone else [set(x) for x in second["leaders"]]
    pairs = np.array([p for p in pairs.tolist() if min(lead_a[p[0]] & lead_b[p[1]]) == leader], np.int64).reshape(-1, 2)
    ids_a, ids_b = first["id"].to_numpy(), second["id"].to_numpy()
    copies_a, copies_b = first["copies"].to_numpy(), second["copies"].to_numpy()
    links = np.concatenate([np.bincount(pairs[:, 0], copies_b[pairs[:, 1]], len(a)), np.bincount(pairs[:, 1], copies_a[pairs[:, 0]], len(b))])
    ids = np.concatenate([ids_a, ids_b])
    order = np.unique(ids)
    joined = np.stack([np.searchsorted(order, ids_a[pairs[:, 0]]), np.searchsorted(order, ids_b[pairs[:, 1]])], axis=1)
    tree = [(int(order[x]), int(order[y]), 0) for x, y in _forest(joined, len(order))]
    counted = [(int(i), None, int(n)) for i, n in zip(ids, links, strict=True) if n]
    return pd.DataFrame(tree + counted, columns=["id", "other", "links"]).astype({"id": "int64", "other": "Int64", "links": "int64"})


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest member connected to each member of ``edges`` (id, other).

    Rounds of two steps: every member tells its larger neighbours, then all its
    neighbours, the smallest it knows.  Stars remain when nothing changes; the
    rounds grow with the logarithm of the longest chain.
    """
    def step(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a")) if larger else e.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        told = both.join(least, "x")
        out = told.filter(F.col("y") > F.col("x")).select(F.col("m").alias("a"), F.col("y").alias("b")) if larger else told.select(F.col("m").alias("a"), F.col("y").alias("b")).union(least.select("m", "x"))
        return out.filter("a <> b").distinct()

    now = durable(edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).filter("a <> b").distinct(), "components")
    measure = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = measure(now)
    while True:
        now = durable(step(step(now, True), False), "components")
        after = measure(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))


def members(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text_key, bands): each row with its text's digest and bands.

    A stored table: ``doc`` numbers the rows, so rows with equal or null ids
    stay apart.  Texts without words have no bands.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            bands: list = []
            for first, last in pieces(offsets):
                row, h = shingles(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
                values = signatures(row, h, last - first)
                has = np.bincount(row, minlength=last - first) > 0
                keys = np.ascontiguousarray(values).view(np.int64)
                bands.extend(keys[i] if has[i] else [] for i in range(last - first))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), batch.column("text_key"), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "doc_id", "text_key", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return durable(rows.mapInArrow(sign, f"doc long, doc_id {kind}, text_key binary, bands array<long>"), "jaccard-members")


def _with_sets(texts: DataFrame) -> DataFrame:
    """(id, copies, leaders, values, set, bytes) of the members (…, text) that meet others."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            values, sets = [], []
            for first, last in pieces(offsets):
                row, h = shingles(LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
                values.extend(v.tobytes() for v in signatures(row, h, last - first))
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                sets.extend(h[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("leaders"), pa.array(values, pa.binary()), pa.array(sets, pa.binary()), pa.array([len(x) for x in sets], pa.int64())], names=["id", "copies", "leaders", "values", "set", "bytes"])

    return texts.select("id", "copies", "leaders", "text").mapInArrow(expand, "id long, copies long, leaders array<long>, values binary, set binary, bytes long")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, text_id, text_key, first) for each row of ``docs``.

    Two rows are linked if their shingle sets have a Jaccard similarity of 0.8
    or more, or their texts are equal.  ``class_id`` is the smallest id (by
    row, where ids repeat) of all rows connected by links; ``text_id`` that of
    the rows with an equal text; ``n_links`` counts the other rows linked to a
    row, copies included.  ``first`` marks one row of each class, of the
    smallest id; ``text_key`` is a digest of the text.  Null reads as empty text.  Texts without words link
    to equal texts alone.  Extra columns are ignored.
    """
    rows = members(docs)
    unique = durable(
        rows.groupBy("text_key").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "doc")).alias("first"), F.first("bands").alias("bands"))
        .select("text_key", "copies", F.col("first.doc").alias("id"), F.col("first.doc_id").alias("text_id"), "bands"),
        "jaccard-unique",
    )
    banded = unique.select("id", F.posexplode("bands").alias("band", "key"))
    met = banded.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n")
    leaders = durable(banded.join(met, ["band", "key"]).groupBy("id").agg(F.array_sort(F.collect_set("leader")).alias("leaders")), "jaccard-leaders")
    # One row of each wanted text: that of its first id.
    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = small(durable(leaders.join(unique.select("id", "copies", "text_key", "text_id"), "id"), "jaccard-wanted"), WANTED_ROWS)
    found = texts.join(wanted, (texts["key"] == wanted["text_key"]) & texts["doc_id"].eqNullSafe(wanted["text_id"]))
    sets = durable(_with_sets(found), "jaccard-sets")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
    sizes = durable(sets.select("bytes", F.explode("leaders").alias("leader")).groupBy("leader").agg(blocks.alias("blocks")), "jaccard-sizes")
    placed = (
        sets.select("*", F.explode("leaders").alias("leader")).join(sizes, "leader")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))))
        .withColumn("side", F.when(F.col("pair.low") == F.col("pair.high"), 2).when(F.col("block") == F.col("pair.low"), 0).otherwise(1))
    )
    compared = durable(
        placed.select("leader", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "id", "copies", "side", "leaders", "values", "set")
        .groupBy("leader", "low", "high").applyInPandas(compare_block, "id long, other long, links long"),
        "jaccard-links",
    )
    roots = components(compared.filter("other is not null").select("id", "other"))
    links = compared.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = unique.select("id", "text_key", "copies", "text_id").join(roots, "id", "left").join(links, "id", "left")
    named = classes.withColumn("root", F.coalesce("root", "id"))
    # Roots are smallest by row number; ids may be in another order.
    by_class = named.groupBy("root").agg(F.min(F.struct(F.col("text_id").isNull().alias("absent"), "text_id", "id")).alias("least"))
    full = named.join(by_class, "root").select("text_key", F.col("least.text_id").alias("class_id"), F.col("least.id").alias("first_doc"), "text_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc", "doc_id", "text_key").join(full, "text_key").select("doc_id", "class_id", "n_links", "text_id", "text_key", (F.col("doc") == F.col("first_doc")).alias("first"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, that of the smallest id, all columns kept, whatever their names."""
    classes = durable(jaccard_classes(docs).select("doc_id", "text_key", "first"), "jaccard-classes")
    rows = classes.groupBy("doc_id", "text_key").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    gone = durable(rows.filter(~F.col("first")).select("doc_id", "text_key"), "jaccard-gone")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("own_key"))
    kept = held.join(small(gone), F.col("row.doc_id").eqNullSafe(gone["doc_id"]) & (F.col("own_key") == gone["text_key"]), "left_anti")
    # Rows that repeat both id and text are one document.
    if rows.filter(F.col("first") & (F.col("n") > 1)).limit(1).count():
        kept = kept.withColumn("own_id", F.col("row.doc_id")).dropDuplicates(["own_id", "own_key"])
    return kept.select("row.*")
