"""Small learners fitted fold by fold: base rate, ridge, a one-layer network and an attention
pool over past examples. All numpy, inside grouped Arrow workers; every fold has its own seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.bars import bar_returns, numbered, order, own, with_halo
from tidewright.session import table

FEATURES = 6


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def silu(x):
    return x * sigmoid(x)


def softmax(x, axis=-1):
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def rms_normal(x, eps=1e-6):
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps)


def rotate(x: np.ndarray, base: float = 10_000.0) -> np.ndarray:
    """Rotary position embedding of rows in order."""
    n, d = x.shape
    angle = np.arange(n)[:, None] / base ** (np.arange(0, d - 1, 2) / d)
    out = x.copy()
    a, b = x[:, 0 : 2 * angle.shape[1] : 2], x[:, 1 : 2 * angle.shape[1] : 2]
    out[:, 0 : 2 * angle.shape[1] : 2] = a * np.cos(angle) - b * np.sin(angle)
    out[:, 1 : 2 * angle.shape[1] : 2] = a * np.sin(angle) + b * np.cos(angle)
    return out


class Standardiser:
    def __init__(self, x: np.ndarray, eps: float = 1e-8):
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), eps)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


class BaseRate:
    id = "base_rate"

    @classmethod
    def create(cls, **_):
        return cls()

    def fit(self, x, y):
        self.p = float(y.mean()) if len(y) else 0.5
        return self

    def predict(self, x):
        return np.full(len(x), self.p)


class Ridge:
    """Ridge on centred outcomes; the fitted value goes through a sigmoid and is moved by the base rate."""

    id = "ridge"

    def __init__(self, penalty: float = 1e-2):
        self.penalty = penalty

    @classmethod
    def create(cls, **o):
        return cls(**{k: v for k, v in o.items() if k == "penalty"})

    def fit(self, x, y):
        self.z, self.base = Standardiser(x), y.mean()
        a = np.column_stack([np.ones(len(x)), self.z(x)])
        self.w = np.linalg.solve(a.T @ a + self.penalty * np.diag([0] + [1] * x.shape[1]), a.T @ (y - self.base))
        return self

    def predict(self, x):
        return np.clip(sigmoid(self.w[0] + self.z(x) @ self.w[1:]) + self.base - 0.5, 0, 1)


class Network:
    """One tanh layer, sigmoid output, plain gradient steps on shuffled batches."""

    id = "mlp"

    def __init__(self, hidden: int = 8, epochs: int = 60, rate: float = 0.1, seed: int = 1, batch: int = 32, l2: float = 1e-5):
        self.hidden, self.epochs, self.rate, self.seed, self.batch, self.l2 = hidden, epochs, rate, seed, batch, l2

    @classmethod
    def create(cls, **o):
        return cls(**{k: v for k, v in o.items() if k in ("hidden", "epochs", "rate", "seed", "batch", "l2")})

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        self.z = Standardiser(x)
        x = self.z(x)
        self.w1, self.b1 = rng.standard_normal((x.shape[1], self.hidden)) / np.sqrt(x.shape[1]), np.zeros(self.hidden)
        self.w2, self.b2 = rng.standard_normal(self.hidden) / np.sqrt(self.hidden), 0.0
        for _ in range(self.epochs):
            path = rng.permutation(len(x))
            for lo in range(0, len(x), self.batch):
                i = path[lo : lo + self.batch]
                h = np.tanh(x[i] @ self.w1 + self.b1)
                g = (sigmoid(h @ self.w2 + self.b2) - y[i]) / len(i)
                gh = np.outer(g, self.w2) * (1 - h * h)
                self.w2 -= self.rate * (h.T @ g + self.l2 * self.w2)
                self.b2 -= self.rate * g.sum()
                self.w1 -= self.rate * (x[i].T @ gh + self.l2 * self.w1)
                self.b1 -= self.rate * gh.sum(0)
        return self

    def predict(self, x):
        return sigmoid(np.tanh(self.z(x) @ self.w1 + self.b1) @ self.w2 + self.b2)


class AttentionEnsemble:
    """Members attend from a query to the stored training examples through their own random
    projections; member outputs are mixed by weights that follow each member's past accuracy."""

    id = "attention"

    def __init__(self, members: int = 4, width: int = 8, keep: int = 256, seed: int = 1):
        self.members, self.width, self.keep, self.seed = members, width, keep, seed

    @classmethod
    def create(cls, **o):
        return cls(**{k: v for k, v in o.items() if k in ("members", "width", "keep", "seed")})

    def _member(self, m: int, x: np.ndarray) -> np.ndarray:
        k = rms_normal(self.x @ self.proj[m])
        q = rms_normal(x @ self.proj[m])
        return softmax(q @ k.T * np.sqrt(self.width)) @ self.y

    def fit(self, x, y):
        rng = np.random.default_rng(self.seed)
        self.z = Standardiser(x)
        self.proj = rng.standard_normal((self.members, x.shape[1], self.width)) / np.sqrt(x.shape[1])
        half = max(1, len(x) // 2)
        self.x, self.y = self.z(x[:half])[-self.keep :], y[:half][-self.keep :]
        score = np.ones(self.members)
        if len(x) > half:
            late = self.z(x[half:])
            score = np.array([1 - ((self._member(m, late) - y[half:]) ** 2).mean() for m in range(self.members)])
        trust = sigmoid((score - score.mean()) / (score.std() + 1e-6))
        self.weights = trust / trust.sum()
        self.x, self.y = self.z(x)[-self.keep :], y[-self.keep :]
        return self

    def predict(self, x):
        x = self.z(x)
        return np.clip(sum(w * self._member(m, x) for m, w in enumerate(self.weights)), 0, 1)


LEARNERS = {c.id: c for c in (BaseRate, Ridge, Network, AttentionEnsemble)}


def successive_halving(arms: list, evaluate, most: int, least: int = 1, eta: int = 3) -> list:
    """Keep the best 1 / eta of the arms at each rung, with eta times the budget; the survivors in order."""
    budget = least
    while True:
        ranked = sorted(arms, key=lambda a: (-evaluate(a, budget), arms.index(a)))
        if budget >= most or len(ranked) == 1:
            return ranked
        arms = ranked[: max(1, -(-len(ranked) // eta))]
        budget = min(most, budget * eta)


def low_rank_es_step(f, x: np.ndarray, rng: np.random.Generator, rank: int = 4, pairs: int = 8, sigma: float = 0.1, rate: float = 1.0) -> np.ndarray:
    """One antithetic evolution step inside a random subspace, halved until the objective falls."""
    q = np.linalg.qr(rng.standard_normal((len(x), min(rank, len(x)))))[0]
    g = np.zeros(len(x))
    for _ in range(pairs):
        e = q @ rng.standard_normal(q.shape[1])
        g += (f(x + sigma * e) - f(x - sigma * e)) * e / (2 * sigma * pairs)
    here, step = f(x), rate
    for _ in range(20):
        if f(x - step * g) < here:
            return x - step * g
        step /= 2
    return x


def feature_rows(candles: DataFrame) -> DataFrame:
    """``(stream, i, x, y)``: the last FEATURES returns and whether the next one is positive."""
    rows = bar_returns(with_halo(numbered(candles), FEATURES + 1, ahead=1))
    rows = rows.withColumn("x", F.collect_list("ret").over(order().rowsBetween(-(FEATURES - 1), 0))).withColumn("next", F.lead("ret").over(order()))
    return own(rows).where((F.size("x") == FEATURES) & F.col("next").isNotNull()).select("stream", "i", "x", F.when(F.col("next") > 0, 1.0).otherwise(0.0).alias("y"))


def walk_forward_scores(rows: DataFrame, train: int = 200, test: int = 50, learners: tuple[str, ...] = ("base_rate", "ridge", "mlp")) -> DataFrame:
    """Brier score of every learner per stream and walk-forward fold. A row goes to the fold that
    tests it and to those that train on it, so a group is one fold, however long the stream."""
    first = F.greatest(F.lit(0), F.expr(f"cast((i - {train + test - 1}) div {test} as int)"))
    folds = rows.withColumn("fold", F.explode(F.sequence(first, F.expr(f"cast(i div {test} as int)"))))
    lo = F.col("fold") * test
    folds = folds.withColumn("role", F.when((F.col("i") >= lo) & (F.col("i") < lo + train), "train").when((F.col("i") >= lo + train) & (F.col("i") < lo + train + test), "test")).where("role is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        a, b = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        out = []
        if len(a) >= train // 2 and len(b) >= test // 2:
            xa, ya, xb, yb = np.stack(a["x"]), a["y"].to_numpy(), np.stack(b["x"]), b["y"].to_numpy()
            for name in learners:
                p = LEARNERS[name].create(seed=int(pdf["fold"].iloc[0]) + 1).fit(xa, ya).predict(xb)
                out.append((pdf["stream"].iloc[0], int(pdf["fold"].iloc[0]), name, len(b), round(float(((p - yb) ** 2).mean()), 8)))
        return pd.DataFrame(out, columns=["stream", "fold", "learner", "rows", "brier"])

    return folds.groupBy("stream", "fold").applyInPandas(lambda pdf: run(pdf), "stream string, fold int, learner string, rows int, brier double")


def q_walk_forward(spark, sf_dir):
    return walk_forward_scores(feature_rows(table(spark, sf_dir, "candles")))


def q_learner_verdict(spark, sf_dir):
    """How often each learner beats the base rate, fold against fold."""
    s = q_walk_forward(spark, sf_dir)
    b = s.where("learner = 'base_rate'").select("stream", "fold", F.col("brier").alias("base"))
    return s.where("learner <> 'base_rate'").join(b, ["stream", "fold"]).groupBy("stream", "learner").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg(F.when(F.col("brier") < F.col("base"), 1.0).otherwise(0.0)), 6).alias("won"), F.round(F.avg(F.col("brier") - F.col("base")), 8).alias("difference"))


QUERIES = {"learner_walk_forward": (q_walk_forward, None), "learner_verdict": (q_learner_verdict, None)}
