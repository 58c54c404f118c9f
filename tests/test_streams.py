"""Keyed state of series: late and replacing observations, rates in each batch, restarts."""

import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandline.operators import series as S
from strandline.streaming import observations as O

RAW = "s string, obs_date date, value double, error double, source string, arrival long"


def day(n):
    return datetime.date(2000, 1, 1) + datetime.timedelta(days=n)


def run(spark, folder, batches, restart=False):
    """The rows that each batch emits."""
    seen = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
        if restart or i == len(batches) - 1:
            stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
            O.run_to_end(O.observed(stream, ["s"]), lambda b, n: (O.append_batch(f"{folder}/out")(b, n), seen.append({r["s"]: r for r in b.collect()})), folder, "update")
    return [x for x in seen if x]


def expected(spark, rows):
    raw = spark.createDataFrame(rows, RAW)
    obs = S.upsert(raw, ["s"])
    epr = {r["s"]: r["rate"] for r in S.end_point(obs, ["s"]).collect()}
    ols = {r["s"]: r["rate"] for r in S.least_squares(obs, ["s"]).collect()}
    return {(r["s"], r["obs_date"]): (r["value"], r["error"], r["source"]) for r in obs.collect()}, epr, ols


def test_rates_of_each_batch_count_replacements(spark, tmp_path):
    first = [("a", day(i * 100), float(i), 1.0, "x", i) for i in range(5)] + [("b", day(0), 1.0, 1.0, None, 0)]
    second = [("a", day(400), 9.0, 2.0, "y", 10), ("a", day(0), -3.0, None, "y", 11), ("b", day(200), 5.0, 1.0, "x", 12)]
    # An arrival older than what is there changes nothing; an early date becomes the first.
    third = [("a", day(400), 7.0, 2.0, "z", 9), ("b", day(-50), 2.0, 1.0, "x", 13), ("c", day(1), 1.0, 1.0, "x", 1), ("a", None, 1.0, 1.0, "x", 99), ("a", day(3), None, 1.0, "x", 99)]
    seen = run(spark, str(tmp_path), [first, second, third], restart=True)
    assert [set(x) for x in seen] == [{"a", "b"}, {"a", "b"}, {"b", "c"}]
    rows = []
    for batch, got in zip((first, second, third), seen, strict=True):
        rows += [r for r in batch if r[1] is not None and r[2] is not None]
        _, epr, ols = expected(spark, rows)
        for s, r in got.items():
            for name, want in (("epr", epr.get(s)), ("ols", ols.get(s) if r["n"] >= 3 else None)):
                assert (r[name] is None) == (want is None) and (want is None or abs(r[name] - want) < 1e-9)
    assert [c["value"] for c in seen[1]["a"]["changes"]] == [-3.0, 9.0]
    held, _, _ = expected(spark, rows)
    assert {(r["s"], r["obs_date"]): (r["value"], r["error"], r["source"]) for r in O.changed(spark, f"{tmp_path}/out", ["s"]).collect()} == held


def test_random_feeds_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randint(0, 4)}", day(rng.randint(0, 60)), float(rng.randint(0, 5)), 1.0, rng.choice("xy"), rng.randint(0, 40)) for _ in range(600)]
    seen = run(spark, str(tmp_path), [rows[:200], rows[200:450], rows[450:]])
    assert len(seen) == 3
    held, epr, ols = expected(spark, rows)
    newest = {r["s"]: r for r in O.updated(spark, f"{tmp_path}/out", ["s"]).collect()}
    assert {s: r["n"] for s, r in newest.items()} == {s: sum(1 for k in held if k[0] == s) for s in newest}
    assert all(np.isclose(r["epr"], epr[s], rtol=0, atol=1e-9) and np.isclose(r["ols"], ols[s], rtol=0, atol=1e-9) for s, r in newest.items())
    assert {(r["s"], r["obs_date"]): r["value"] for r in O.changed(spark, f"{tmp_path}/out", ["s"]).collect()} == {k: v[0] for k, v in held.items()}


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    many = [("a", day(i), 1.0, 1.0, "x", i) for i in range(500)]
    seen = run(spark, str(tmp_path), [many, [("a", day(7), 2.0, 1.0, "x", 1000)]])
    assert [len(x["a"]["changes"]) for x in seen] == [500, 1] and seen[1]["a"]["n"] == 500
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("batch") == 1).count() == 1


class Counted:
    """A state that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattr__(self, name):
        def call(*a):
            self.calls.append(name)
            place = a[0] if name in ("getValue", "updateValue") else ()
            if name in ("update", "updateValue"):
                self.rows[place] = a[-1]
            return self.rows.get(place)

        return call


def test_calls_to_the_state_do_not_grow_with_the_series():
    calls = []
    handle = type("Handle", (), {"getMapState": lambda *a: Counted(calls), "getValueState": lambda *a: Counted(calls)})()
    state = O._Bucket(1)
    state.init(handle)
    for batch in range(2):
        rows = pd.DataFrame([{"bucket": 0, "key0": s, "day": 9000 + d + batch, "value": float(d), "error": None, "source": None, "arrival": batch} for s in range(500) for d in range(3)])
        calls.clear()
        (out,) = state.handleInputRows((0,), iter([rows[:700], rows[700:]]), None)
        assert len(out) == 500 and set(out["n"]) == {3 + batch} and len(calls) <= 4
