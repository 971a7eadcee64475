"""Order within hot keys, by slices, against plain lists."""

import math
import random

from quillspark.operators import slices


def test_latest_before(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), k if rng.random() < 0.6 else None) for k in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "at long, key string, value long")
    for parts in (1, 7, 1000):
        got = {r["at"]: r["latest"] for r in slices.latest_before(df, "key", "at", "value", parts).collect()}
        assert got == {a: max((v for b, j, v in rows if j == k and b < a and v is not None), default=None) if k else None for a, k, _ in rows}
    assert slices.latest_before(df.where("false"), "key", "at", "value").count() == 0


def test_numbered(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "a", "a", "b", None])) for k in rng.sample(range(-500, 10_000), 300)]
    want = {k: 1 + sum(j == key and o < k for o, j in rows) for k, key in rows}
    for parts in (1, 9, 1000):
        got = slices.numbered(spark.createDataFrame(rows, "at long, key string"), "key", "at", slices=parts)
        assert got.columns == ["at", "key", "place"] and {r["at"]: r["place"] for r in got.collect()} == want
    assert slices.numbered(spark.createDataFrame([], "at long, key string"), "key", "at").count() == 0


def test_order_statistic(spark):
    rng = random.Random(6)
    groups = {"many": [rng.gauss(0, 1) for _ in range(500)], "equal": [2.5] * 40, "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0], "one": [7.0], "ends": [-math.inf, 1.0, 2.0, 3.0, math.inf], "nan": [1.0, math.nan, math.nan], "skew": [1e-9 * k for k in range(200)] + [1e300], None: [3.0, 1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("many", None)]
    df = spark.createDataFrame(rows, "kind string, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["kind"]: r["value"] for r in slices.order_statistic(df, "v", "kind", share, bins=8).collect()}
        for g, vs in groups.items():
            want = sorted(vs, key=lambda v: (math.isnan(v), v))[min(math.floor(len(vs) * share), len(vs) - 1)]
            assert got[g] == want or (math.isnan(got[g]) and math.isnan(want))
        assert set(got) == set(groups)
