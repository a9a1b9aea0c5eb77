"""Quality models on node vectors: autoencoder, variational generator; numpy on a bounded sample, scores over all rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperspark.config import DEFAULT
from hyperspark.plans.runtime import hash_sample, ship

#: Rows of the training sample; a bound, whatever the size of the graph.
SAMPLE_ROWS = 4096


def sample_vectors(nodes: DataFrame, id_column: str = "id", vector: str = "v", rows: int = SAMPLE_ROWS, seed: int = 1) -> np.ndarray:
    """At most ``rows`` vectors chosen by the hash of their ids, in order of ids."""
    chosen = hash_sample(nodes.select(id_column), id_column, rows, seed)
    picked = nodes.select(id_column, vector).join(F.broadcast(chosen), id_column).dropDuplicates([id_column]).toPandas().sort_values(id_column)
    return np.vstack(picked[vector].to_list()) if len(picked) else np.zeros((0, 0))


@dataclass
class AutoEncoder:
    """Rectified hidden layer and linear output."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def error(self, x: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error of each row."""
        return ((np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2 - x) ** 2).mean(1)


def train_autoencoder(x: np.ndarray, hidden: int = DEFAULT.ae_hidden, steps: int = 400, rate: float = 0.001, momentum: float = 0.9, seed: int = 3) -> AutoEncoder | None:
    """Stochastic steps with momentum from He-scaled weights; needs 8 rows."""
    if len(x) < 8:
        return None
    rng, dim = np.random.default_rng(seed), x.shape[1]
    params = [rng.normal(size=(dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden), rng.normal(size=(hidden, dim)) * np.sqrt(2 / hidden), np.zeros(dim)]
    speed = [np.zeros_like(p) for p in params]
    for _ in range(steps):
        batch = x[rng.integers(len(x), size=32)]
        before = batch @ params[0] + params[1]
        h = np.maximum(before, 0)
        slope = 2 * (h @ params[2] + params[3] - batch) / len(batch)
        back = (slope @ params[2].T) * (before > 0)
        for p, v, g in zip(params, speed, (batch.T @ back, back.sum(0), h.T @ slope, slope.sum(0))):
            v *= momentum
            v -= rate * g
            p += v
    return AutoEncoder(*params)


def reconstruction_errors(nodes: DataFrame, model: AutoEncoder, id_column: str = "id", vector: str = "v") -> DataFrame:
    """``(id, error)`` of all rows."""
    ship(nodes.sparkSession)
    shared = nodes.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"id": frame[id_column], "error": shared.value.error(np.vstack(frame[vector].to_list()))})

    return nodes.select(id_column, vector).mapInPandas(run, "id long, error double")


def gate(error: Column, usage: Column, auto: Column, entropy: Column) -> tuple[Column, Column]:
    """New entropy and promotion: poor reconstructions of little used nodes lose .08, good ones of used nodes are promoted."""
    poor = (error > DEFAULT.ae_prune) & (usage < 2) & ~auto
    return F.when(poor, F.greatest(entropy - 0.08, F.lit(0.0))).otherwise(entropy), (error < DEFAULT.ae_fast) & (usage > 3)


@dataclass
class Generator:
    """A variational model whose encoder is random and whose output bias learns."""

    w1: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w2: np.ndarray
    bias: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1, 0)
        return h @ self.mean, np.exp(0.5 * np.clip(h @ self.spread, -4, 4))

    def decode(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w2) + self.bias


def train_generator(x: np.ndarray, latent: int = DEFAULT.vae_latent, hidden: int = DEFAULT.vae_hidden, steps: int = 200, seed: int = 4) -> Generator | None:
    """Needs 16 rows; each step moves the output bias against the reconstruction error."""
    if len(x) < 16:
        return None
    rng, dim = np.random.default_rng(seed), x.shape[1]
    model = Generator(rng.normal(size=(dim, hidden)) * np.sqrt(2 / dim), rng.normal(size=(hidden, latent)) * np.sqrt(1 / hidden), rng.normal(size=(hidden, latent)) * 0.05, rng.normal(size=(latent, dim)) * np.sqrt(1 / latent) * 0.1, np.zeros(dim))
    for _ in range(steps):
        batch = x[rng.integers(len(x), size=16)]
        mean, spread = model.encode(batch)
        out = model.decode(mean + spread * rng.normal(size=mean.shape))
        model.bias -= 0.05 * (out - batch).mean(0)
    return model


def candidates(model: Generator, centroid: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Up to 32 unit vectors decoded from around the centroid."""
    rng = np.random.default_rng(seed)
    mean, spread = model.encode(centroid[None, :])
    out = model.decode(mean + (spread + 0.3) * rng.normal(size=(min(n, 32), mean.shape[1])))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
