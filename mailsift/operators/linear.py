"""Linear models and naive Bayes as jobs in passes over row blocks: one evaluation of loss and gradient is one pass."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.operators.passes import Block, Job

MEMORY = 10  # pairs of steps and gradients that L-BFGS keeps
TOLERANCE = 1e-4
MOST_TURNS = 200  # conjugate gradients of one Newton step
CLOSE = 1e-6  # relative gain of a full Newton step that ends the fit; what is left then is far smaller


class LinearModel:
    """Coefficients and intercept; with ``platt`` (slope, shift) its margins become calibrated probabilities."""

    def __init__(self, coefficients: np.ndarray, intercept: float, platt: tuple[float, float] | None = None):
        self.coefficients, self.intercept, self.platt = coefficients, intercept, platt

    def margin(self, block: Block) -> np.ndarray:
        return block.product(self.coefficients) + self.intercept

    def probability(self, block: Block) -> np.ndarray:
        return self._link(self.margin(block))

    def _link(self, margin: np.ndarray) -> np.ndarray:
        slope, shift = self.platt or (1.0, 0.0)
        return 1 / (1 + np.exp(-np.clip(slope * margin + shift, -700, 700)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``probability``, of class 0 and 1, and ``prediction``."""
        w = self.coefficients

        def score(indices: pd.Series, values: pd.Series) -> pd.Series:
            margin = [self.intercept + float(np.dot(w[np.asarray(i, int)], v)) if len(v) else self.intercept
                      for i, v in zip(indices, values)]
            return pd.Series(self._link(np.array(margin, float)))

        v = F.unwrap_udt("features")
        indices = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
        scored = rows.withColumn("_p", F.pandas_udf(score, "double")(indices, v["values"]))
        return scored.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))),
                                   "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")

    def save(self, path: str, spark: SparkSession) -> None:
        row = (self.coefficients.tolist(), float(self.intercept), list(self.platt) if self.platt else None)
        spark.createDataFrame([row], "coefficients array<double>, intercept double, platt array<double>").write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> LinearModel:
        r = spark.read.parquet(path).first()
        return cls(np.array(r["coefficients"]), r["intercept"], tuple(r["platt"]) if r["platt"] else None)


class LinearJob(Job):
    """Half the squared length of the coefficients plus ``C`` times the summed loss, by L-BFGS with step halving.

    ``logistic`` leaves the intercept free; ``squared_hinge`` counts it with the coefficients.
    """

    def __init__(self, loss: str, C: float, max_iter: int, n_features: int, without: list[tuple[str, int]]):
        self.loss, self.C, self.max_iter, self.without = loss, C, max_iter, without
        self.w = np.zeros(n_features + 1)
        self.bound = np.ones(n_features + 1)
        self.bound[-1] = loss == "squared_hinge"
        self.value: float | None = None
        self.gradient = self.direction = np.zeros(0)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.n_iter, self.done = 1.0, 0, False

    def request(self, width: int):
        if self.done:
            return None
        return self.w if self.value is None else self.w + self.step * self.direction

    def answer(self, block: Block, request):
        rows = block.rows_in(self.without)
        sign = np.where(block.target > 0, 1.0, -1.0)
        z = sign * (block.product(request[:-1]) + request[-1])
        if self.loss == "logistic":
            value, slope = np.logaddexp(0, -z), -1 / (1 + np.exp(np.clip(z, -700, 700)))
        else:
            short = np.maximum(1 - z, 0)
            value, slope = short ** 2, -2 * short
        factors = np.where(rows, slope * sign, 0.0)
        return np.concatenate([[value[rows].sum()], block.combined(factors), [factors.sum()]])

    def receive(self, total) -> None:
        tried = self.w if self.value is None else self.w + self.step * self.direction
        value = float(0.5 * (self.bound * tried ** 2).sum() + self.C * total[0])
        gradient = self.bound * tried + self.C * total[1:]
        if self.value is not None:
            descent = float(self.gradient @ self.direction)
            if value > self.value + 1e-4 * self.step * descent and self.step > 1e-10:
                self.step /= 2
                return
            moved, turned = tried - self.w, gradient - self.gradient
            if moved @ turned > 1e-12:
                self.steps = [*self.steps, (moved, turned)][-MEMORY:]
            flat = abs(self.value - value) <= 1e-9 * max(abs(value), 1)
        else:
            flat = False
            self.first = max(np.abs(gradient).max(), 1e-12)
        self.w, self.value, self.gradient = tried, value, gradient
        self.n_iter += 1
        if flat or np.abs(gradient).max() <= TOLERANCE * min(self.first, 1.0) or self.n_iter > self.max_iter:
            self.done = True
            return
        self.direction = -self._turned(gradient)
        self.step = 1.0 if self.steps else 1.0 / max(np.linalg.norm(gradient), 1.0)

    def _turned(self, g: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature met so far."""
        q, kept = g.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return q

    def light(self) -> LinearJob:
        out = copy.copy(self)
        out.steps, out.gradient, out.direction, out.bound = [], np.zeros(0), np.zeros(0), np.zeros(0)
        return out

    def weight(self, n_rows: int) -> int:
        return 8 * len(self.w) * (2 * MEMORY + 8)

    def result(self) -> LinearModel:
        return LinearModel(self.w[:-1], float(self.w[-1]))


class NewtonJob(LinearJob):
    """Half the squared length of coefficients and intercept plus ``C`` times the summed squared hinge loss, by Newton steps.

    A step is solved by conjugate gradients, a pass for each, and halved until the loss falls. A third of the passes of L-BFGS, which
    needs many small steps where frequent terms stand beside rare ones.
    """

    def __init__(self, C: float, max_iter: int, n_features: int, without: list[tuple[str, int]]):
        super().__init__("squared_hinge", C, max_iter, n_features, without)
        self.rest: np.ndarray | None = None  # of the gradient that the step does not explain yet, None outside of conjugate gradients

    def request(self, width: int):
        if self.rest is not None:
            return "along", self.turn
        at = super().request(width)
        return None if at is None else ("at", at)

    def answer(self, block: Block, request):
        """Loss and gradient at a point, or the second derivative at ``w`` along a direction, behind a zero."""
        kind, what = request
        if kind == "at":
            return super().answer(block, what)
        short = np.where(block.target > 0, 1.0, -1.0) * (block.product(self.w[:-1]) + self.w[-1]) < 1
        factors = np.where(block.rows_in(self.without) & short, 2 * (block.product(what[:-1]) + what[-1]), 0.0)
        return np.concatenate([[0.0], block.combined(factors), [factors.sum()]])

    def receive(self, total) -> None:
        if self.rest is not None:
            self._turn(self.turn + self.C * total[1:])
            return
        tried = self.w if self.value is None else self.w + self.step * self.direction
        value = float(0.5 * tried @ tried + self.C * total[0])
        gradient = tried + self.C * total[1:]
        steepest = np.abs(gradient).max()
        if self.value is None:
            self.first, self.start, flat = max(steepest, 1e-12), max(float(np.linalg.norm(gradient)), 1e-300), False
        else:
            if value > self.value + 1e-4 * self.step * float(self.gradient @ self.direction) and self.step > 1e-10:
                self.step /= 2
                return
            gained = abs(self.value - value) / max(abs(value), 1)
            flat = gained <= 1e-9 or (self.step == 1.0 and gained <= CLOSE)
        self.w, self.value, self.gradient = tried, value, gradient
        self.n_iter += 1
        if flat or steepest <= TOLERANCE * min(self.first, 1.0) or self.n_iter > self.max_iter:
            self.done = True
            return
        self.direction, self.rest, self.turn, self.n_turns = np.zeros(len(tried)), -gradient, -gradient, 0
        length = float(np.linalg.norm(gradient))
        self.enough = length * min(0.1, (length / self.start) ** 0.5)

    def _turn(self, curved: np.ndarray) -> None:
        """One conjugate gradient, from the second derivative along the current one."""
        before = self.rest @ self.rest
        far = before / (self.turn @ curved)
        self.direction = self.direction + far * self.turn
        self.rest = self.rest - far * curved
        after = self.rest @ self.rest
        self.n_turns += 1
        if after ** 0.5 <= self.enough or self.n_turns >= MOST_TURNS:
            self.rest, self.turn, self.step = None, np.zeros(0), 1.0
        else:
            self.turn = self.rest + after / before * self.turn

    def light(self) -> NewtonJob:
        out = super().light()
        out.rest, out.turn = None, np.zeros(0)
        return out

    def weight(self, n_rows: int) -> int:
        return 8 * len(self.w) * 10


class CalibratedJob(Job):
    """Support vectors with probabilities: one fit on all rows and one without each fold, then Platt's map on held-out margins."""

    def __init__(self, C: float, max_iter: int, n_features: int, without: list[tuple[str, int]], tag: str, folds: int):
        self.without, self.tag = without, tag
        self.fits = [NewtonJob(C, max_iter, n_features, [*without, *held])
                     for held in [[], *([(tag, k)] for k in range(folds))]]
        self.platt: np.ndarray | None = None
        self.rounds = 0

    def request(self, width: int):
        asked = {k: q for k, job in enumerate(self.fits) if (q := job.request(width)) is not None}
        if asked:
            return "fit", asked
        if self.rounds >= 30:
            return None
        return "platt", self.platt if self.platt is not None else np.array([1.0, 0.0])

    def answer(self, block: Block, request):
        kind, what = request
        if kind == "fit":
            return {k: self.fits[k].answer(block, q) for k, q in what.items()}
        rows, margin = block.rows_in(self.without), np.zeros(len(block))
        for k, job in enumerate(self.fits[1:]):
            held = block.tags[self.tag] == k
            margin[held] = job.result().margin(block)[held]
        m, y = margin[rows], block.target[rows]
        x = np.stack([m, np.ones(len(m))], axis=1)
        p = 1 / (1 + np.exp(-np.clip(x @ what, -700, 700)))
        return {"g": x.T @ (p - y), "h": (x * (p * (1 - p))[:, None]).T @ x}

    @staticmethod
    def merge(a, b):
        return {k: a[k] + b[k] for k in a}

    def receive(self, total) -> None:
        if "g" not in total:
            for k, part in total.items():
                self.fits[k].receive(part)
            return
        at = self.platt if self.platt is not None else np.array([1.0, 0.0])
        ridge = 1e-3  # keeps the map finite where the classes separate
        move = np.linalg.solve(total["h"] + ridge * np.eye(2), total["g"] + ridge * at)
        self.platt = at - move * min(1.0, 5 / max(np.abs(move).max(), 1e-12))
        self.rounds = 30 if np.abs(move).max() < 1e-6 else self.rounds + 1

    def light(self) -> CalibratedJob:
        out = copy.copy(self)
        out.fits = [job.light() for job in self.fits]
        return out

    def weight(self, n_rows: int) -> int:
        return sum(job.weight(n_rows) for job in self.fits)

    def result(self) -> LinearModel:
        model = self.fits[0].result()
        return LinearModel(model.coefficients, model.intercept, (float(self.platt[0]), float(self.platt[1])))


def bayes(sums: np.ndarray, counts: np.ndarray, alpha: float) -> LinearModel:
    """Multinomial naive Bayes from feature sums and row counts by class, as the difference of the classes' log-odds."""
    smoothed = sums + alpha
    logs = np.log(smoothed) - np.log(smoothed.sum(axis=1, keepdims=True))
    prior = np.log(np.maximum(counts, 1e-300))
    return LinearModel(logs[1] - logs[0], float(prior[1] - prior[0]))


class BayesJob(Job):
    """Naive Bayes from one pass."""

    def __init__(self, alpha: float, n_features: int, without: list[tuple[str, int]]):
        self.alpha, self.without, self.total = alpha, without, None

    def request(self, width: int):
        return "sums" if self.total is None else None

    def answer(self, block: Block, request):
        rows = block.rows_in(self.without)
        return np.stack([np.append(block.combined(of.astype(float)), of.sum())
                         for of in (rows & (block.target == c) for c in (0, 1))])

    def receive(self, total) -> None:
        self.total = total

    def result(self) -> LinearModel:
        return bayes(self.total[:, :-1], self.total[:, -1], self.alpha)


def confusion(rows: np.ndarray, predicted: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rows by true and predicted class."""
    code = 2 * (target[rows] > 0) + predicted[rows]
    return np.bincount(code.astype(int), minlength=4)


class Trial(Job):
    """A fit without one fold and the confusion matrix on it."""

    def __init__(self, job: Job, tag: str, fold: int):
        self.job, self.tag, self.fold, self.matrix = job, tag, fold, None

    @property
    def binned(self) -> bool:
        return self.job.binned

    def _sync(self) -> None:
        self.job.id, self.job.whole = self.id, self.whole

    def request(self, width: int):
        self._sync()
        if self.matrix is not None:
            return None
        asked = self.job.request(width)
        return ("fit", asked) if asked is not None else ("score", self.job.result())

    def answer(self, block: Block, request):
        self._sync()
        kind, what = request
        if kind == "fit":
            return type(self.job), self.job.answer(block, what)
        p = what.probability(block)
        return None, confusion(block.tags[self.tag] == self.fold, p > 0.5, block.target)

    @staticmethod
    def merge(a, b):
        return a[0], a[0].merge(a[1], b[1]) if a[0] else a[1] + b[1]

    def parts(self, answer, block: Block):
        self._sync()
        return [(k, (answer[0], part)) for k, part in self.job.parts(answer[1], block)] if answer[0] else [(None, answer)]

    def digest(self, total):
        return (total[0], self.job.digest(total[1])) if total[0] else total

    def joined(self, digests):
        kind = digests[0][1][0]
        return (kind, self.job.joined([(k, part) for k, (_, part) in digests])) if kind else digests[0][1]

    def weight(self, n_rows: int) -> int:
        return self.job.weight(n_rows)

    def receive(self, total) -> None:
        if total[0]:
            self.job.receive(total[1])
        else:
            self.matrix, self.job = total[1], Job()  # the fit is not needed any more

    def to_absorb(self, at_once: bool):
        return self.job.to_absorb(at_once)

    def absorb(self, block: Block, what) -> None:
        self._sync()
        self.job.absorb(block, what)

    def absorbed(self) -> None:
        self.job.absorbed()

    def light(self) -> Trial:
        out = copy.copy(self)
        out.job = self.job.light()
        return out

    def result(self) -> np.ndarray:
        return self.matrix


class BayesSearch(Job):
    """All draws and folds of naive Bayes in two passes: sums per fold, models as the total less a fold, then all matrices."""

    def __init__(self, alphas: list[float], tag: str, folds: int):
        self.alphas, self.tag, self.folds = alphas, tag, folds
        self.sums = self.matrices = None

    def models(self, alpha: float) -> Iterator[LinearModel]:
        total = self.sums.sum(axis=0)
        return (bayes((total - own)[:, :-1], (total - own)[:, -1], alpha) for own in self.sums)

    def request(self, width: int):
        if self.sums is None:
            return "sums"
        return None if self.matrices is not None else "matrices"

    def answer(self, block: Block, request):
        fold = block.tags[self.tag]
        if request == "sums":
            return np.stack([np.stack([np.append(block.combined(of.astype(float)), of.sum())
                                       for of in ((fold == k) & (block.target == c) for c in (0, 1))]) for k in range(self.folds)])
        return np.stack([np.stack([confusion(fold == k, m.probability(block) > 0.5, block.target) for k, m in enumerate(self.models(a))])
                         for a in self.alphas])

    def receive(self, total) -> None:
        if self.sums is None:
            self.sums = total
        else:
            self.matrices = total

    def result(self) -> np.ndarray:
        """Confusion matrices by draw and fold."""
        return self.matrices
