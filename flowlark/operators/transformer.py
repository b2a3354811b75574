"""A transformer over numeric columns, as a representation and a classifier: its training on the executors and its use.

Each column is a token (value * scale + shift), a class token stands before them. Blocks are pre-norm: attention, then a
gated feed-forward layer. The normalised tokens are pooled and projected; a linear head gives the logit of an attack.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training

POOLING = ("cls", "mean", "cls_mean")
#: Numbers of the widest layer that are held at a time.
HELD_NUMBERS = 1 << 21
_STEP = 64
_ERF = np.array([math.erf(k / _STEP) for k in range(-6 * _STEP, 6 * _STEP + 2)])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, between known values by the cubics with its own slopes there: right to 1e-9."""
    t = (np.clip(x, -6, 6) + 6) * _STEP
    k = np.floor(t).astype(np.int64)
    u = t - k
    a, b = _ERF[k], _ERF[k + 1]
    slope = lambda i: 2 / math.sqrt(math.pi) * np.exp(-((i / _STEP - 6) ** 2)) / _STEP
    p, q = slope(k), slope(k + 1)
    return a + u * (p + u * (3 * (b - a) - 2 * p - q + u * (p + q - 2 * (b - a))))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x times the normal distribution's share below x, and its slope."""
    below = 0.5 * (1 + erf(x / math.sqrt(2)))
    return x * below, below + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, tuple]:
    inverse = 1 / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    unit = (x - x.mean(axis=-1, keepdims=True)) * inverse
    return unit * gain + bias, (unit, inverse, gain)


def _norm_back(dy: np.ndarray, kept: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradients of a norm's input, gain and bias."""
    unit, inverse, gain = kept
    du, over = dy * gain, tuple(range(dy.ndim - 1))
    dx = inverse * (du - du.mean(axis=-1, keepdims=True) - unit * (du * unit).mean(axis=-1, keepdims=True))
    return dx, (dy * unit).sum(axis=over), dy.sum(axis=over)


def _linear_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradients of a linear layer's input, weights and bias."""
    rows, out = x.reshape(-1, x.shape[-1]), dy.reshape(-1, dy.shape[-1])
    return dy @ w.T, rows.T @ out, out.sum(axis=0)


@dataclass
class NumericTransformer:
    """Weights by name; a block's own end with its number."""

    weights: dict[str, np.ndarray]
    heads: int
    depth: int
    pooling: str = "cls_mean"

    @staticmethod
    def random(features: int, embed: int = 32, heads: int = 8, depth: int = 4, latent: int = 128, seed: int = 42, pooling: str = "cls_mean") -> NumericTransformer:
        if pooling not in POOLING or embed % heads or min(features, depth, latent) < 1:
            raise ValueError("pooling must be one of cls, mean, cls_mean; heads must divide the embedding; sizes must be 1 or more")
        rng = np.random.default_rng(seed)
        made = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s)
        pooled = embed * (2 if pooling == "cls_mean" else 1)
        w = {"scale": rng.normal(0, 0.02, (features, embed)), "shift": np.zeros((features, embed)), "cls": rng.normal(0, 0.02, embed)}
        for k in range(depth):
            w |= {f"g1_{k}": np.ones(embed), f"b1_{k}": np.zeros(embed), f"qkv{k}": made(embed, 3 * embed), f"qkvb{k}": np.zeros(3 * embed), f"o{k}": made(embed, embed), f"ob{k}": np.zeros(embed)}
            w |= {f"g2_{k}": np.ones(embed), f"b2_{k}": np.zeros(embed), f"up{k}": made(embed, 8 * embed), f"upb{k}": np.zeros(8 * embed), f"down{k}": made(4 * embed, embed), f"downb{k}": np.zeros(embed)}
        w |= {"g": np.ones(embed), "b": np.zeros(embed), "project": made(pooled, latent), "projectb": np.zeros(latent), "gp": np.ones(latent), "bp": np.zeros(latent), "head": made(latent), "headb": np.zeros(1)}
        return NumericTransformer(w, heads, depth, pooling)

    @property
    def at_once(self) -> int:
        """Rows that are gone through at a time."""
        features, embed = self.weights["scale"].shape
        return max(1, HELD_NUMBERS // ((features + 1) * 8 * embed))

    def _split(self, a: np.ndarray) -> np.ndarray:
        return a.reshape(*a.shape[:2], self.heads, -1).transpose(0, 2, 1, 3)

    @staticmethod
    def _joined(a: np.ndarray) -> np.ndarray:
        return a.transpose(0, 2, 1, 3).reshape(a.shape[0], a.shape[2], -1)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """The representation, the logit, and what the way back needs of every block and of the end."""
        w, kept = self.weights, []
        t = np.concatenate([np.broadcast_to(w["cls"], (len(x), 1, len(w["cls"]))), x[:, :, None] * w["scale"] + w["shift"]], axis=1)
        for k in range(self.depth):
            u, n1 = _norm(t, w[f"g1_{k}"], w[f"b1_{k}"])
            q, key, v = map(self._split, np.split(u @ w[f"qkv{k}"] + w[f"qkvb{k}"], 3, axis=-1))
            s = q @ key.transpose(0, 1, 3, 2) / math.sqrt(q.shape[-1])
            s = np.exp(s - s.max(axis=-1, keepdims=True))
            s /= s.sum(axis=-1, keepdims=True)
            mixed = self._joined(s @ v)
            t = t + mixed @ w[f"o{k}"] + w[f"ob{k}"]
            f, n2 = _norm(t, w[f"g2_{k}"], w[f"b2_{k}"])
            a, gate = np.split(f @ w[f"up{k}"] + w[f"upb{k}"], 2, axis=-1)
            open_, slope = gelu(gate)
            t = t + (a * open_) @ w[f"down{k}"] + w[f"downb{k}"]
            kept.append((u, n1, q, key, v, s, mixed, f, n2, a, open_, slope))
        end, n3 = _norm(t, w["g"], w["b"])
        pooled = np.concatenate([end[:, 0]] * (self.pooling != "mean") + [end[:, 1:].mean(axis=1)] * (self.pooling != "cls"), axis=-1)
        bent, slope = gelu(pooled @ w["project"] + w["projectb"])
        z, n4 = _norm(bent, w["gp"], w["bp"])
        kept.append((end.shape, n3, pooled, slope, n4))
        return z, z @ w["head"] + w["headb"][0], kept

    def represent(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._forward(x)[1], -500, 500)))

    def loss(self, x: np.ndarray, y: np.ndarray, positive: float = 1.0) -> float:
        """The summed cross entropy, attacks weighing ``positive``."""
        logit = self._forward(x)[1]
        return float((positive * y * np.logaddexp(0, -logit) + (1 - y) * np.logaddexp(0, logit)).sum())

    def gradients(self, x: np.ndarray, y: np.ndarray, positive: float = 1.0) -> tuple[dict[str, np.ndarray], float]:
        """The gradients of the summed loss by back-propagation, and that loss."""
        w, g = self.weights, {}
        z, logit, kept = self._forward(x)
        chance = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        dl = (1 - y) * chance - positive * y * (1 - chance)
        g["head"], g["headb"] = z.T @ dl, dl.sum(keepdims=True)
        shape, n3, pooled, slope, n4 = kept.pop()
        db, g["gp"], g["bp"] = _norm_back(dl[:, None] * w["head"], n4)
        dp, g["project"], g["projectb"] = _linear_back(db * slope, pooled, w["project"])
        dend, embed = np.zeros(shape), shape[-1]
        if self.pooling != "mean":
            dend[:, 0] += dp[:, :embed]
        if self.pooling != "cls":
            dend[:, 1:] += dp[:, None, -embed:] / (shape[1] - 1)
        dt, g["g"], g["b"] = _norm_back(dend, n3)
        for k in range(self.depth - 1, -1, -1):
            u, n1, q, key, v, s, mixed, f, n2, a, open_, slope = kept.pop()
            dh, g[f"down{k}"], g[f"downb{k}"] = _linear_back(dt, a * open_, w[f"down{k}"])
            df, g[f"up{k}"], g[f"upb{k}"] = _linear_back(np.concatenate([dh * open_, dh * a * slope], axis=-1), f, w[f"up{k}"])
            back, g[f"g2_{k}"], g[f"b2_{k}"] = _norm_back(df, n2)
            dt = dt + back
            dm, g[f"o{k}"], g[f"ob{k}"] = _linear_back(dt, mixed, w[f"o{k}"])
            dm = self._split(dm)
            dv, ds = s.transpose(0, 1, 3, 2) @ dm, dm @ v.transpose(0, 1, 3, 2)
            ds = s * (ds - (ds * s).sum(axis=-1, keepdims=True)) / math.sqrt(q.shape[-1])
            dq, dk = ds @ key, ds.transpose(0, 1, 3, 2) @ q
            du, g[f"qkv{k}"], g[f"qkvb{k}"] = _linear_back(np.concatenate([self._joined(x_) for x_ in (dq, dk, dv)], axis=-1), u, w[f"qkv{k}"])
            back, g[f"g1_{k}"], g[f"b1_{k}"] = _norm_back(du, n1)
            dt = dt + back
        g["cls"], g["shift"], g["scale"] = dt[:, 0].sum(axis=0), dt[:, 1:].sum(axis=0), np.einsum("nfe,nf->fe", dt[:, 1:], x)
        one = positive * y * np.logaddexp(0, -logit) + (1 - y) * np.logaddexp(0, logit)
        return g, float(one.sum())

    def apply(self, df: DataFrame, features: list[str], id_col: str = "row_id") -> DataFrame:
        """(id, representation, transformer_score) of each row, in Arrow batches. Features must be scaled before."""
        held = df.sparkSession.sparkContext.broadcast(self)
        rows = df.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(features)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, model.at_once):
                    part = batch.slice(at, model.at_once)
                    z, logit, _ = model._forward(np.stack([part.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(features))], axis=1))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], [id_col, "representation", "transformer_score"])

        return rows.mapInArrow(run, f"{id_col} long, representation array<double>, transformer_score double")

    def columns(self) -> list[str]:
        """The names of ``flat``'s columns: the score, then the representation."""
        return ["transformer_score", *(f"transformer_{k}" for k in range(len(self.weights["head"])))]

    def flat(self, df: DataFrame, features: list[str], id_col: str = "row_id") -> DataFrame:
        made = self.apply(df, features, id_col)
        return made.select(id_col, "transformer_score", *[F.col("representation")[k].alias(c) for k, c in enumerate(self.columns()[1:])])


def fit_transformer(
    df: DataFrame, features: list[str], y: str = "y", id_col: str = "row_id", embed: int = 32, heads: int = 8, depth: int = 4, latent: int = 128, pooling: str = "cls_mean",
    epochs: int = 20, rate: float = 1e-3, decay: float = 1e-4, batches: int = 4, patience: int = 6, least_epochs: int = 1, seed: int = 42,
) -> NumericTransformer:
    """Trained on all rows of ``df`` (scaled features, y 0 or 1) in synchronous rounds; attacks weigh as much as the other
    rows in all. Both classes are needed."""
    n, ones = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0))).first()
    if not 0 < ones < n:
        raise ValueError("rows of both classes are needed")
    start, positive = NumericTransformer.random(len(features), embed, heads, depth, latent, seed, pooling), (n - ones) / ones
    model = lambda w: NumericTransformer(w, heads, depth, pooling)
    rows = training.dealt(df, features, id_col, y, batches, seed)
    weights = training.train(
        rows, start.weights, lambda w, x, t: model(w).gradients(x, t, positive), lambda w, x, t: model(w).loss(x, t, positive),
        epochs=epochs, rate=rate, decay=decay, patience=patience, least_epochs=least_epochs, at_once=start.at_once,
    )
    return model(weights)
