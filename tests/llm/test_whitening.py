import numpy as np
import pytest

from quillspark.llm import whitening
from quillspark.llm.queries import op11_embedding_whitening


def plain(x, components):
    """The same by numpy's eigenvalue solver over the whole covariance."""
    n, c = len(x), (x - x.sum(0) // len(x)).astype(float) - (x.sum(0) % len(x)) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def same(rows, x, components, key):
    white, explained = plain(x, components)
    at = {v: k for k, v in enumerate(key)}
    got = np.zeros_like(white)
    for r in rows:
        got[at[r[0]], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.sign(np.sum(got * white, axis=0))
    assert np.abs(got * sign - white).max() < 1e-6


def test_query_against_numpy(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    kept = [(r["vec_id"], r["embedding"]) for r in table if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    rows = op11_embedding_whitening(spark, sf).collect()
    assert len(rows) == 8 * len(kept)
    same(rows, x, 8, [i for i, _ in kept])
    n, sums = len(x), x.sum(0)
    dev = {i: int(((n * v - sums) ** 2).sum()) for (i, _), v in zip(kept, x, strict=True)}
    assert all(r["deviation"] == dev[r["vec_id"]] and r["n"] == n for r in rows)


@pytest.mark.parametrize("kind", ["steep", "flat", "tied", "low rank"])
def test_spectra(spark, kind):
    rng = np.random.default_rng(3)
    scale = {"steep": 2.0 ** -np.arange(48) * 1e6, "flat": np.full(48, 1000.0), "tied": np.r_[np.full(12, 5000.0), np.full(36, 1000.0)], "low rank": np.r_[np.full(3, 900.0), np.zeros(45)]}[kind]
    x = np.round(rng.standard_normal((600, 48)) * scale).astype(np.int64) + 100_000
    blocks = whitening.blocks_of(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "key long, x array<long>, component int"), "key", "x")
    model = whitening.fit(blocks, 8)
    rows = whitening.project(blocks, model).collect()
    k = 3 if kind == "low rank" else 8
    assert len(rows) == 600 * k
    same(rows, x, k, range(600))


def test_odd_vectors_take_no_part(spark):
    good = [[0.5, 1.0], [0.25, -1.0], [1.0, 2.0], [1.0, 2.0], [-3.0, 0.125]]
    odd = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e300, 0.0], [1.0, 2.0, 3.0]]
    rows = [(k, v, 1, 2) for k, v in enumerate(good + odd)] + [(None, [0.0, 0.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, dims int").withColumn("x", whitening.quantised("embedding"))
    blocks = whitening.blocks_of(df.select("vec_id", "x", "id", "dims"), "vec_id", "x")
    model = whitening.fit(blocks, 8)
    out = whitening.project(blocks, model).collect()
    assert model.n == 6 and sorted({r["id"] for r in out if r["id"] is not None}) == [0, 1, 2, 3, 4] and len(out) == 12
    assert all(abs(v) < 1e-9 for v in np.subtract.outer([r["whitened"] for r in out if r["id"] == 2], [r["whitened"] for r in out if r["id"] == 3]).diagonal())


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [5, 5]), (2, [5, 5])], "vec_id long, x array<long>")
    for rows in (df, df.where("false")):
        blocks = whitening.blocks_of(rows, "vec_id", "x")
        out = whitening.project(blocks, whitening.fit(blocks))
        assert out.count() == 0 and out.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_are_exact_or_null():
    x = np.array([[2**52, -(2**52)], [3, 4]], np.int64)
    got = whitening._deviations(x, [int(v) for v in x.sum(0)], 2)
    assert got == [None, None]
    assert whitening._deviations(np.array([[4_000_000_001], [0]]), [4_000_000_001], 2) == [None, None]
    assert whitening._deviations(np.array([[2_000_000_001], [0]]), [2_000_000_001], 2) == [2_000_000_001**2] * 2
