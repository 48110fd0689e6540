"""Global order statistics against NumPy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrack.operators import ranks, serial


def groups():
    rng = random.Random(4)
    out = {"ties": [rng.randrange(9) / 4 for _ in range(700)], "one": [5.25], "signs": [rng.uniform(-3, 3) for _ in range(400)], "equal": [2.5] * 60}
    out |= {"wide": [rng.choice((-1, 1)) * 10.0 ** rng.randrange(-300, 300) for _ in range(300)], "close": [1 + k * 2.0**-52 for k in range(200)], "zeros": [-0.0, 0.0, 0.0, -1e-320, 1e-320]}
    out |= {"ends": [-math.inf, 1.0, 2.0, math.inf], None: [float(k) for k in range(37)]}
    return out


POINTS = {"low": 0.05, "mid": 0.5, "high": 0.95, "least": 0.0, "most": 1.0}


@pytest.mark.parametrize("small", [1, 10, 1 << 16])
def test_exact_quantiles(spark, small):
    told = groups()
    rows = [(g, x, x * 2 if x is not None and math.isfinite(x) else None) for g, values in told.items() for x in [*values, None]] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, n double").repartition(5)
    got = {r.g: r for r in ranks.exact_quantiles(df, {"x": POINTS, "n": {"twice": 0.5}}, ["g"], "size", small).collect()}
    assert set(got) == set(told)
    for g, values in told.items():
        assert got[g].size == len(values)
        with np.errstate(invalid="ignore"):
            want = {name: float(np.quantile(values, p)) for name, p in POINTS.items()}
        for name, value in want.items():
            assert got[g][name] == pytest.approx(value, rel=1e-12) or (math.isnan(value) and not math.isfinite(got[g][name])), (g, name)
        assert got[g].twice == pytest.approx(float(np.quantile([2 * v for v in values if math.isfinite(v)], 0.5)), rel=1e-12)


def test_exact_quantiles_of_all_rows(spark):
    values = [x for v in groups().values() for x in v if math.isfinite(x)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for small in (1, 1 << 16):
        r = ranks.exact_quantiles(df, {"x": POINTS}, small=small).first()
        assert all(r[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12) for name, p in POINTS.items())
    assert ranks.exact_quantiles(df.limit(0), {"x": POINTS}).collect() == [(None,) * 5]
    with_nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double")  # above every number
    assert ranks.exact_quantiles(with_nan, {"x": {"m": 0.5, "h": 1.0}}, small=1).first()[:] == (2.0, pytest.approx(math.nan, nan_ok=True))


def test_no_task_holds_all_values(spark):
    """The plan of a quantile has no percentile buffer, and that of a global rank no window over all rows."""
    df = spark.range(5000).select((F.col("id") % 977).cast("double").alias("x"))
    plans = [made._jdf.queryExecution().toString() for made in (ranks.exact_quantiles(df, {"x": POINTS}, small=10), serial.average_ranks(df, {"x": "r"}))]
    assert not any("percentile" in p or "Window" in p for p in plans) and "SinglePartition" not in plans[1]


def test_numbers_and_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), k, rng.randrange(1, 9)) for k in range(900)]
    df = spark.createDataFrame(rows, "a long, b long, w long").repartition(6)
    numbered = sorted(ranks.numbered(df, [F.col("a").desc(), "b"]).collect(), key=lambda r: r.number)
    assert [(r.a, r.b) for r in numbered] == sorted(((a, b) for a, b, _ in rows), key=lambda r: (-r[0], r[1]))
    assert [r.number for r in numbered] == list(range(1, 901))
    total = 0
    for r in sorted(ranks.running_totals(df, ["a", "b"], "w").collect(), key=lambda r: (r.a, r.b)):
        total += r.w
        assert r.total == total
    assert ranks.numbered(df.limit(0), ["a"]).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_average_ranks(spark, few):
    rng = random.Random(3)
    rows = [(rng.choice(("p", "q", None)), rng.randrange(12) / 8, rng.random()) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(4)
    by_group = {}
    for r in serial.average_ranks(df.filter("g is not null"), {"x": "rx", "y": "ry"}, ["g"], few=few).collect():
        by_group.setdefault(r.g, []).append(r)
    for g, told in by_group.items():
        for c, to in (("x", "rx"), ("y", "ry")):
            values = [r[c] for r in told]
            assert all(r[to] == sum(v < r[c] for v in values) + (sum(v == r[c] for v in values) + 1) / 2 for r in told), g
    everything = serial.average_ranks(df, {"x": "r"}).collect()
    values = [r.x for r in everything]
    assert all(r.r == sum(v < r.x for v in values) + (values.count(r.x) + 1) / 2 for r in everything) and len(values) == 600
