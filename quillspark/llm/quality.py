"""Quality by compression: zstandard dictionaries of good and of bad text.

A text that the dictionary of good documents shortens more than that of bad ones is likely to
be good.  The normalised difference of the two compressed sizes, with the ratio itself, is
calibrated to a probability on labelled documents that built neither dictionary.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, spread

LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the weights of the calibration; ``prior`` alone without labels."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


@functools.lru_cache(maxsize=4)
def _compressors(model: QualityModel) -> tuple:
    import zstandard as zs

    return tuple(zs.ZstdCompressor(level=LEVEL, dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_AUTO), write_content_size=False, write_checksum=False, write_dict_id=False) if d else zs.ZstdCompressor(level=LEVEL) for d in (model.good, model.bad))


def features(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    """For each text: 1, then the difference of the two compressed sizes over their sum, the
    mean compressed share, log length, and their products."""
    good, bad = _compressors(model)
    size = np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], float).reshape(-1, 3)
    a, b, n = size.T
    gap, share, length = (b - a) / (a + b), (a + b) / (2 * n + 32), np.log1p(n)
    return np.c_[np.ones(len(texts)), gap, gap * length, gap * gap, gap * share, share, share * share, length, length * share]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method with halved steps for a ridge logistic regression; the constant, the
    first column, is not shrunk."""
    shrink = np.r_[0.0, np.full(x.shape[1] - 1, ridge)]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * shrink @ w**2)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(shrink + 1e-6), x.T @ (y - p) - shrink * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * move) > loss(w):
            size /= 2
        w = w + size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes; the texts themselves if they are few."""
    import zstandard as zs

    texts = [t for t in texts if t]
    if sum(map(len, texts)) > 8 * 1024:
        try:
            return zs.train_dictionary(size, texts).as_bytes()
        except zs.ZstdError:  # too few or too even samples
            pass
    return b"\n".join(texts)[:size]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, dictionary_bytes: int = 112 * 1024) -> QualityModel:
    """Learn from the texts of ``docs`` that ``labels`` (doc_id, quality 0 or 1) has.

    A bounded sample is used, about ``rows_per_class`` documents of each label, chosen by a hash
    of their ids; whole texts, every other one for the dictionaries and the rest for the
    calibration, which weighs documents as labels occur.  Of several labels of a document the
    lowest counts.  With one label only the model answers by the labels' share.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample, counts = bounded_sample(docs.select("doc_id", F.col("text").cast("binary").alias("text")), known, "quality", rows_per_class)
    rows = sorted(sample.collect(), key=lambda r: (r["quality"], r["doc_id"]))
    halves: dict[tuple[int, int], list[bytes]] = {}
    for q in (0, 1):
        own = [bytes(r["text"] or b"") for r in rows if r["quality"] == q]
        halves[q, 0], halves[q, 1] = own[::2], own[1::2]
    good, bad = (_dictionary(halves[q, 0], dictionary_bytes) for q in (1, 0))
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    prior = QualityModel(good, bad, (float(np.log(share / (1 - share))), *[0.0] * 8))
    if not halves[0, 1] or not halves[1, 1]:
        return prior
    x = np.vstack([features(prior, halves[0, 1]), features(prior, halves[1, 1])])
    y = np.r_[np.zeros(len(halves[0, 1])), np.ones(len(halves[1, 1]))]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    w = _logistic((x - mean) / scale, y) / scale
    w[0] -= mean @ w
    w[0] += np.log(counts[1] / counts[0]) - np.log(len(halves[1, 1]) / len(halves[0, 1]))
    return QualityModel(good, bad, tuple(w.tolist()))


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int), from whole texts alone.

    A null text counts as empty; an empty text gets the score of no evidence either way.
    Columns named score or predicted are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = np.array(model.weights)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            raws = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(features(model, raws) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return spread(docs.select(*rest)).mapInArrow(run, schema)
