"""Encoders as a plug-in, and the layout stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder:
    """encode gives a row of numbers for each text; calibration is the logit scale and bias, if it has them."""

    spec = "none"
    dim = 0
    calibration: tuple[float, float] | None = None

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError


class HashEncoder(Encoder):
    """Vectors that depend on a text's hash alone: for tests, and for places without a model."""

    def __init__(self, dim: int = 16):
        self.dim, self.spec = dim, f"hash:{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        import hashlib

        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little") for t in texts]
        return np.array([np.random.default_rng(s).standard_normal(self.dim) for s in seeds])


BACKENDS: dict[str, Callable[[str], Encoder]] = {"hash": lambda model: HashEncoder(int(model or 16))}


def build_encoder(spec: str) -> Encoder:
    backend, _, model = spec.partition(":")
    if not backend or backend not in BACKENDS:
        raise ValueError(f"no encoder named {spec!r}")
    return BACKENDS[backend](model)


def encoded(rows: DataFrame, spec: str, text: str, batch: int = 32) -> DataFrame:
    """rows with v, a unit vector of a text column, and bad, true where encoding failed; a bad row does not fail its batch."""
    build_encoder(spec)

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = build_encoder(spec)

        def unit(texts: list[str]) -> list:
            v = encoder.encode(texts)
            return list(v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12))

        for pdf in frames:
            out: list = []
            texts = pdf[text].tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += unit(part)
                except Exception:  # noqa: BLE001  one by one, to find the bad one
                    for t in part:
                        try:
                            out += unit([t])
                        except Exception:  # noqa: BLE001
                            out.append(None)
            yield pdf.assign(v=out, bad=[x is None for x in out])

    schema = rows.withColumns({"v": F.array().cast("array<double>"), "bad": F.lit(False)}).schema
    return rows.mapInPandas(over, schema)


def pca_layout(rows: DataFrame, node: str = "node", vector: str = "v") -> DataFrame:
    """(node, x, y): the first two principal components; the covariance is summed by Spark."""
    own = rows.select(node, array_to_vector(F.col(vector)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="p").fit(own)
    p = vector_to_array("p")
    return model.transform(own).select(node, F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
