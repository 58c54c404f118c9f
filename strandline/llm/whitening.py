"""Embedding whitening by weighted multiplicity covariance.

Vectors become fixed-point numbers; equal ones are one row with a count.  Sums
and covariance are weighted by the counts (or by one), each task adding its
own partial sums and a weighted matrix product of centred vectors.  The
eigenvectors of the covariance, which is as wide as a vector and no larger
however many rows there are, whiten each distinct vector once; the results are
joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import bounded_batches, durable

#: A number c is stored as floor(FINENESS * c) + SHIFT.
FINENESS, SHIFT = 1024, 100_000
#: Stored numbers are held within these bounds, so sums over many rows stay exact.
LARGEST = 1 << 40
COMPONENTS = 8
#: Eigenvalues of less than this share of the largest count as none.
LEAST_SHARE = 1e-12
#: A vector of one row in so many or more is joined by broadcast: at most as many such vectors.
HOT_SHARE = 256


def fixed_point(vector: Column) -> Column:
    """The entries of ``vector`` as whole numbers; null where it is null or holds null or non-finite entries."""
    limit = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda c: (F.floor(F.least(F.greatest(FINENESS * c.cast("double"), -limit), limit)) + SHIFT).cast("long"))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), whole)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def weighted_sums(rows: DataFrame, vector: str, weight: str, width: int) -> tuple[int, np.ndarray]:
    """(n, sums): the total weight and the weighted sum of each dimension; whole numbers stay exact."""
    whole = rows.schema[vector].dataType.elementType.typeName() == "long"
    kind = np.int64 if whole else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, object if whole else kind)
        for batch in batches:
            if batch.num_rows:
                w, values = batch.column("w").to_numpy(), _matrix(batch.column("v"), kind)
                if whole and int(np.abs(values).max(initial=0)) * int(w.sum()) >= 1 << 62:
                    values = values.astype(object)
                part = w.astype(values.dtype) @ values
                n, sums = n + int(w.sum()), sums + (part.astype(object) if whole else part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(x) if whole else repr(float(x)) for x in (n, *sums)])], ["at", "part"])

    total = F.sum(F.col("part").cast("decimal(38,0)" if whole else "double")).alias("total")
    found = {r["at"]: r["total"] for r in rows.select(F.col(vector).alias("v"), F.col(weight).alias("w")).mapInArrow(add, "at int, part string").groupBy("at").agg(total).collect()}
    return int(found.get(-1, 0)), np.array([int(found.get(i, 0)) if whole else float(found.get(i, 0)) for i in range(width)], object if whole else kind)


def weighted_covariance(rows: DataFrame, vector: str, weight: str, n: int, mean: np.ndarray) -> np.ndarray:
    """The weighted covariance, divisor ``n``, of vectors centred at ``mean`` before they are multiplied."""
    width = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        seen = False
        for batch in batches:
            if batch.num_rows:
                centred = _matrix(batch.column("v"), np.float64) - mean
                total += (centred * batch.column("w").to_numpy()[:, None]).T @ centred
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], ["i", "row"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("i").to_pylist(), _matrix(batch.column("row"), np.float64), strict=True):
                held[i] = held.get(i, 0.0) + part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "row"])

    schema = "i int, row array<double>"
    parts = rows.select(F.col(vector).alias("v"), F.col(weight).cast("double").alias("w")).mapInArrow(multiply, schema)
    out = np.zeros((width, width))
    for r in parts.repartition("i").mapInArrow(combine, schema).collect():
        out[r["i"]] = r["row"]
    return (out + out.T) / (2 * n)


def whiten(vectors: DataFrame, vector: str, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """(row, x, n, deviation, whitened, explained, identity_error): ``row`` holds the columns of ``vectors``.

    ``x`` is the fixed-point vector.  ``weights`` is ``counts``, by which every
    row is in the fit list, or ``one``, by which every distinct vector is in it
    once.  ``n`` is the length of the fit list, ``deviation`` the exact sum
    over dimensions of (n*x - sum)**2 (null beyond a long), ``whitened`` holds
    the first ``components`` components and ``explained`` the share of each.
    ``identity_error`` is the largest entry of the whitened fit list's
    covariance minus the identity.

    Rows are left out whose vector is null, holds null or non-finite entries,
    or has another length than most vectors have (of equally common lengths
    the shortest, empty vectors aside).  Numbers beyond 2**30 count as 2**30.  Components
    without variance are left out: a table of one distinct vector has none, so
    its lists are empty.  Rows that repeat come out as often as they came in.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be counts or one")
    spark = vectors.sparkSession
    bounded_batches(spark)
    valid = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), fixed_point(F.col(f"`{vector}`")).alias("x")).filter(F.size("x") > 0)
    stored = durable(valid, "whitening-rows")
    common = stored.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "width").first()
    width, rows = (common["width"], common["n"]) if common else (0, 0)
    stored = stored.filter(F.size("x") == width)
    distinct = durable(stored.groupBy("x").agg(F.count("*").alias("copies")).withColumn("w", F.col("copies") if weights == "counts" else F.lit(1).cast("long")), "whitening-distinct")
    n, sums = weighted_sums(distinct, "x", "w", width)
    mean = np.array([float(int(s) / n) for s in sums]) if n else np.zeros(width)
    values, axes = np.linalg.eigh(weighted_covariance(distinct, "x", "w", n, mean)) if n else (np.zeros(0), np.zeros((0, 0)))
    values, axes = values[::-1], axes[:, ::-1]
    used = int(((values > LEAST_SHARE * max(values, default=0.0)) & (values > 0))[:components].sum())
    project = axes[:, :used] / np.sqrt(values[:used]) if used else np.zeros((width, 0))
    whole = np.array([int(s) for s in sums], object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64).reshape(-1, width) if batch.num_rows else np.zeros((0, width), np.int64)
            z = (x - mean) @ project
            far = n * int(np.abs(x).max(initial=0)) + max((abs(int(e)) for e in whole), default=0)
            kind = np.int64 if far < 1 << 62 else object
            gap = n * x.astype(kind) - whole.astype(kind)
            wide = int(np.abs(gap).max(initial=0)) ** 2 * width >= 1 << 62
            gap = gap.astype(object) if wide else gap
            deviation = [int(d) if int(d) < 1 << 63 else None for d in (gap * gap).sum(axis=1)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * used, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("copies"), batch.column("w"), pa.array(deviation, pa.int64()), lists], ["x", "copies", "w", "deviation", "z"])

    done = durable(distinct.mapInArrow(apply, "x array<long>, copies long, w long, deviation long, z array<double>"), "whitening-done")
    error = 0.0
    if used:
        _, moved = weighted_sums(done, "z", "w", used)
        error = float(np.abs(weighted_covariance(done, "z", "w", n, moved / n) - np.eye(used)).max())
    explained = [float(e) for e in values[:used] / values.sum()] if used else []
    # A vector of many copies would meet them all in one task: there are at most HOT_SHARE of them, so they are broadcast.
    hot = F.col("copies") * HOT_SHARE >= rows
    found = done.select("x", "copies", "deviation", "z")
    near = stored.join(F.broadcast(found.filter(hot)), "x", "left")
    both = near.filter("copies is not null").unionByName(near.filter("copies is null").select("row", "x").join(found.filter(~hot), "x"))
    return both.select(
        "row", "x", F.lit(n).cast("long").alias("n"), "deviation", F.col("z").alias("whitened"),
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"),
    )


def whitened_components(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component, from 1.

    Which rows and components there are is said at ``whiten``.
    """
    white = whiten(vectors.select(vec_id, vector), vector, components)
    return white.select(F.col(f"row.`{vec_id}`").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error",
    )
