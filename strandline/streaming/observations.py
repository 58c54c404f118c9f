"""Incremental forms of the series operators for feeds of observations.

State is kept for buckets of series, as a call for each series between Python
and the state store costs more than its work.  A bucket holds the sums that
rates follow from, and the observations in blocks of dates; a batch reads and
writes the buckets and blocks that it brings something for, each as one table.
An observation of a date that is there already takes the place of the one
before if it arrived later, whatever the order in which they come: what the old
one added to the sums is taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from strandline.operators.series import YEAR, days

#: The state store that keeps maps by key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of series; days in a block.
BUCKETS, BLOCK = 2048, 4096
OBSERVATION = ["day", "value", "error", "source", "arrival"]
SUMS = ["n", "sx", "sy", "sxx", "sxy", "first_day", "first_value", "last_day", "last_value"]
_CHANGE = "obs_date date, value double, error double, source string"


def tumbling(stream: DataFrame, time: str, late: str, width: str, keys: list[str], value: str) -> DataFrame:
    """Count and mean of a value by window and keys, for batch or stream; late rows are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


class _Bucket(StatefulProcessor):
    """State of the series of one bucket; each batch emits the rates of those it changes and their changed observations."""

    def __init__(self, width: int) -> None:
        self.keys = [f"key{i}" for i in range(width)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("observations", "block int", "rows binary")
        self.sums = handle.getValueState("sums", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        brought = pd.concat(list(rows), ignore_index=True)[[*self.keys, *OBSERVATION]]
        sums = _unpacked(self.sums.get())
        parts = [] if sums is None else [_unpacked(self.held.getValue((int(b),))) for b in np.unique(brought["day"] // BLOCK)]
        held = [p for p in parts if p is not None]
        rows_ = pd.concat([*held, brought], ignore_index=True)
        old = np.arange(len(rows_)) < len(rows_) - len(brought)
        every = pd.concat([rows_[self.keys]] + ([] if sums is None else [sums[self.keys]]), ignore_index=True)
        number = every.groupby(self.keys, dropna=False, sort=False).ngroup().to_numpy()
        series, day, value = number[: len(rows_)], rows_["day"].to_numpy(), rows_["value"].to_numpy()

        # Of one date the last in this order stays; what is held stays beside its equal.
        order = np.lexsort((old, pd.factorize(rows_["source"], sort=True)[0], value, rows_["arrival"].to_numpy(), day, series))
        ends = np.append((np.diff(series[order]) != 0) | (np.diff(day[order]) != 0), True)
        run = np.empty(len(order), dtype=np.int64)
        run[order] = np.cumsum(ends) - ends
        stays = order[ends]
        replaces, was = np.zeros(len(stays), dtype=bool), np.zeros(len(stays))
        replaces[run[old]], was[run[old]] = True, value[old]
        moved = ~old[stays]
        if not moved.any():
            return
        new = stays[moved]
        series, day, value, fresh = series[new], day[new], value[new], ~replaces[moved]
        x, gain = day / YEAR - 25, value - was[moved]

        # Each series of the bucket has its sums; those that the batch changes get more.
        at = np.full(number.max() + 1, -1)
        if sums is not None:
            at[number[len(rows_) :]] = np.arange(len(sums))
        starts = np.flatnonzero(np.append(True, np.diff(series) != 0))
        stops = np.append(starts[1:], len(series)) - 1
        known = at[series[starts]]
        total = {c: np.where(known >= 0, sums[c].to_numpy()[known], 0) if sums is not None else np.zeros(len(starts)) for c in SUMS}
        for c, more in (("n", fresh * 1), ("sx", x * fresh), ("sxx", x * x * fresh), ("sy", gain), ("sxy", x * gain)):
            total[c] = total[c] + np.add.reduceat(more, starts)
        first, last = (known < 0) | (day[starts] <= total["first_day"]), (known < 0) | (day[stops] >= total["last_day"])
        for c, here, i in (("first", first, starts), ("last", last, stops)):
            total[f"{c}_day"], total[f"{c}_value"] = np.where(here, day[i], total[f"{c}_day"]), np.where(here, value[i], total[f"{c}_value"])
        n, spread, span = total["n"], total["n"] * total["sxx"] - total["sx"] ** 2, (total["last_day"] - total["first_day"]) / YEAR
        with np.errstate(divide="ignore", invalid="ignore"):
            epr = np.where(span > 0, (total["last_value"] - total["first_value"]) / span, np.nan)
            ols = np.where((n >= 3) & (spread > 0), (n * total["sxy"] - total["sx"] * total["sy"]) / spread, np.nan)

        kept = rows_.iloc[stays]
        for block in np.unique(day // BLOCK):
            self.held.updateValue((int(block),), _packed(kept[kept["day"] // BLOCK == block]))
        names = rows_[self.keys].iloc[new[starts]].reset_index(drop=True)
        mine = pd.concat([names, pd.DataFrame(total)], axis=1)
        if sums is not None:
            rest = np.ones(len(sums), dtype=bool)
            rest[known[known >= 0]] = False
            mine = pd.concat([sums[rest], mine], ignore_index=True)
        self.sums.update(_packed(mine))
        out = names.assign(n=n.astype(np.int64), epr=epr, ols=ols)
        for c in ("day", "value", "error", "source"):
            out[c] = np.array([*np.split(rows_[c].to_numpy()[new], starts[1:]), None], dtype=object)[:-1]
        yield out

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one Arrow stream: a value of many fields costs the state store's interface a step for each."""
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value) -> pd.DataFrame | None:
    """Rows that ``_packed`` made, or none."""
    return None if value is None else pa.ipc.open_stream(bytes(value[0])).read_all().to_pandas()


def observed(stream: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, epr, ols, changes) of every series that a batch of observations changes, in update mode.

    ``stream`` has obs_date, value, error, source and arrival.  Of one date the
    last arrival counts, then the larger value, then the larger source.  Rates
    are those of all that a series has so far: end points, and least squares
    from three dates.  ``changes`` holds the batch's new and replacing
    observations.  Rows without date, value or arrival are dropped.

    Series are dealt to ``buckets`` by their hash.  A batch's rows of a bucket
    and the blocks of dates they fall in are in memory at once, so feeds of
    many millions of series want more buckets.  Their number stays what it is
    for the life of a stream's progress folder.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    types = [stream.schema[k].dataType.simpleString() for k in keys]
    rows = stream.filter("obs_date is not null and value is not null and arrival is not null").select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)],
        days("obs_date").cast("int").alias("day"), F.col("value").cast("double").alias("value"), F.col("error").cast("double").alias("error"), "source", F.col("arrival").cast("long").alias("arrival"))
    named = ", ".join(f"key{i} {t}" for i, t in enumerate(types))
    out = rows.groupBy("bucket").transformWithStateInPandas(_Bucket(len(keys)), StructType.fromDDL(f"{named}, n long, epr double, ols double, day array<int>, value array<double>, error array<double>, source array<string>"), "Update", "None")
    dates = F.transform("day", lambda d: F.date_add(F.lit("1970-01-01").cast("date"), d))
    changes = F.arrays_zip(dates, "value", "error", "source").cast(f"array<struct<{_CHANGE.replace(' ', ': ').replace(',:', ',')}>>")
    return out.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "n", "epr", "ols", changes.alias("changes"))


def append_batch(path: str):
    """A ``foreachBatch`` function that writes each batch to a folder of its own; a replayed batch writes the same folder again."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def upsert_batch(path: str, keys: list[str]):
    """A ``foreachBatch`` function that keeps the last arrival of each series and date in its batch.

    A batch writes only what it brings, so its cost doesn't grow with the
    table; ``upserted`` reads the last of all batches.
    """
    write = append_batch(path)
    return lambda batch, number: write(_last(batch, keys), number)


def upserted(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last arrival of each series and date over all batches that ``upsert_batch`` wrote."""
    return _last(spark.read.parquet(path), keys)


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    last = F.max(F.struct("arrival", "value", "source", "error"))
    return rows.groupBy(*keys, "obs_date").agg(last.alias("o")).select(*keys, "obs_date", "o.value", "o.error", "o.source", "o.arrival")


def changed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Every observation as the batches of ``observed`` that ``append_batch`` wrote left it."""
    rows = spark.read.parquet(path).select(*keys, "batch", F.explode("changes").alias("o")).select(*keys, "batch", "o.*")
    last = F.max_by(F.struct("value", "error", "source"), "batch")
    return rows.groupBy(*keys, "obs_date").agg(last.alias("o")).select(*keys, "obs_date", "o.*")


def updated(spark: SparkSession, path: str, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The newest row of each key over the batches of a stream in update mode that ``append_batch`` wrote, or only the named ``columns`` of it."""
    rows = spark.read.parquet(path)
    rest = columns or [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("o")).select(*keys, *[f"o.{c}" for c in rest])


def run_to_end(stream: DataFrame, write, folder: str, mode: str = "append") -> None:
    """Hand all that the stream's source holds now to ``write``; progress lies in ``folder``, so another run goes on from there."""
    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
