"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot.  A group's summary (its size and largest distance
from the pivot) bounds the score of any member with a query from above, so a query is sent
only to groups that may hold one of its k best.  Groups are solved in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Integers up to this size have exact products and sums in doubles for up to 2^13 dimensions.
EXACT = 1 << 20


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs; null if the vector or a component is null
    or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(x * scale)))


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products (queries, rows): by doubles where those are exact, else by longs."""
    if max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) <= EXACT:
        return np.rint(queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def _pivots(vectors: DataFrame, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample of the vectors, about sqrt(n) of them and ``most`` at most, lowest hash first."""
    wanted = max(1, min(most, ceil(sqrt(n))))
    unit = F.xxhash64(F.lit(3), "vec_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rows = vectors.where(unit * n <= 2 * wanted + 50).orderBy(unit, "vec_id").limit(wanted).collect()
    return np.array([r["vec_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, max_pivots: int = 1024, block: int = 4096) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best of all other rows for each query.

    ``rows`` has vec_id and vector (array of longs, or null: left out).  Ties go to the smaller
    vec_id.  A vec_id stands for one vector: of rows that repeat it the smallest vector counts.
    Vectors of another length than the query's have score 0 with it in the components that
    either lacks (the shorter one is padded with zeros).

    Pivots are real vectors, so a query's k-th best score among them, itself left out, is a
    floor that any group must reach: q.p + |q| * radius is the most that a member of the group
    of pivot p can score.  Blocks keep a group of any size, and any number of queries for it,
    in tasks of bounded memory.
    """
    valid = rows.where(F.col("vector").isNotNull() & F.col("vec_id").isNotNull())
    valid = valid.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    width = valid.agg(F.max(F.size("vector")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    dims, n = max(width["w"] or 0, 1), width["n"]
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score long"
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    padded = F.when(F.size("vector") < dims, F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("vector")))).otherwise(F.col("vector"))
    valid = valid.select("vec_id", padded.alias("vector"))
    ids, pivots = _pivots(valid, n, max_pivots)
    shared = spark.sparkContext.broadcast((ids, pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pivots = shared.value
        p = pivots.astype(np.float64)
        square = (p * p).sum(axis=1)
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy().reshape(-1, dims).astype(np.float64)
            near, far = np.zeros(len(v), np.int64), np.zeros(len(v))
            for at in range(0, len(v), 4096):
                part = v[at : at + 4096]
                group = (square[None, :] - 2 * (part @ p.T)).argmin(axis=1)
                near[at : at + 4096] = group
                far[at : at + 4096] = np.sqrt(((part - p[group]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(near), pa.array(far)], names=["vec_id", "vector", "cell", "far"])

    cells = materialise(valid.mapInArrow(assign, "vec_id long, vector array<long>, cell long, far double"), "cells")
    summary = cells.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    radius, parts = np.full(len(pivots), -np.inf), np.ones(len(pivots), np.int64)
    for r in summary:
        radius[r["cell"]], parts[r["cell"]] = r["far"], max(1, -(-r["n"] // block))
    asked = cells.where(is_query)
    query_parts = max(1, -(-asked.count() // block))
    bounds = spark.sparkContext.broadcast((radius, parts))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pivots = shared.value
        radius, parts = bounds.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                q = part.column("vector").flatten().to_numpy().reshape(-1, dims)
                ids = part.column("vec_id").to_numpy()
                exact = _scores(q, pivots).astype(np.float64)
                others = np.where(ids[:, None] == own[None, :], -np.inf, exact)
                floor = np.sort(others, axis=1)[:, -k] if others.shape[1] >= k else np.full(len(q), -np.inf)
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                most = exact + norm[:, None] * radius[None, :]
                slack = 1e-9 * (np.abs(exact) + norm[:, None] * np.abs(np.where(np.isfinite(radius), radius, 0))[None, :]) + 1e-6
                who, cell = np.nonzero((most + slack >= floor[:, None]) & np.isfinite(radius)[None, :])
                repeat = parts[cell]
                who, cell = np.repeat(who, repeat), np.repeat(cell, repeat)
                inner = np.arange(len(cell)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(who)), part.column("vector").take(pa.array(who)), pa.array(cell), pa.array(inner)], names=["query_id", "query", "cell", "part"])

    chunk = F.pmod(F.xxhash64("query_id"), F.lit(query_parts))
    routed = asked.select("vec_id", "vector").mapInArrow(route, "query_id long, query array<long>, cell long, part long").withColumn("chunk", chunk)
    sizes = F.element_at(F.lit(parts), (F.col("cell") + 1).cast("int"))
    held = cells.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), sizes).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_parts - 1).cast("long"))).alias("chunk"))

    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, own = np.stack(data["vector"].to_numpy()), data["vec_id"].to_numpy()
        order = np.argsort(own, kind="stable")
        x, own = x[order], own[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who = queries["query_id"].to_numpy()
        for at in range(0, len(who), 256):
            q = np.stack(queries["query"].to_numpy()[at : at + 256])
            scores = _scores(q, x)
            for i, row in enumerate(scores):
                keep = np.flatnonzero(own != who[at + i])
                best = keep[np.argsort(-row[keep], kind="stable")[:k]]
                found.append((np.full(len(best), who[at + i]), own[best], row[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    key = ["cell", "part", "chunk"]
    local = routed.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(solve, out)
    best = local.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
