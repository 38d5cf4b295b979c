"""Operator 8: a quality classifier from positive and unlabelled texts.

Trusted positives are rows labelled good; unlabelled are web texts of any kind. The share of good
texts among the unlabelled (class prior) is estimated by the share of good ones among all labelled
rows that may be learned from. Where those hold good ones only, it comes from the two sets alone:
where a first classifier that tells them apart is surest of positives, unlabelled texts are as
rare, against positives, as the prior. Then an additive model over binned document statistics minimises the non-negative
unbiased risk: prior * loss(positives as good) + max(0, loss(unlabelled as bad) - prior *
loss(positives as bad)). Statistics are taken once and stored; cuts are quantiles of all rows, and each
Newton step is a pass over all of them that adds up gradient and curvature on Spark. Only the
positives, a bounded number of labelled rows, are held by the driver.

Null and empty texts are scored by their statistics, which are zero. Repeated rows are scored
each on its own. Without positives every score is 0. An empty table gives an empty result. Other
columns are not read; id and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hashed_bucket, ids_of, record, stored, texts_of
from .quality_rules import statistics

#: Where the features are cut: finer at the tails, where the few bad texts lie.
CUTS = (0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.35, 0.5, 0.65, 0.8, 0.85, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995)
BINS = len(CUTS)
#: How much the class prior is taken below its estimate, besides two standard errors: too large a
#: prior lets the negative part of the risk vanish before bad texts are told apart.
MARGIN = 0.06
#: Penalty on squared weights, against a mean loss.
RIDGE = 3e-3


@dataclass(frozen=True)
class PuModel:
    cuts: tuple[np.ndarray, ...]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[binned(x, self.cuts)].sum(1) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def binned(x: np.ndarray, cuts: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each feature the place of its bin in one long weight vector."""
    return np.stack([j * (BINS + 1) + np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


@dataclass
class Sums:
    """Over some rows at weights ``w``: their number, loss as bad texts, its gradient and its curvature."""

    n: float
    loss: float
    slope: np.ndarray
    curve: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n, self.loss], self.slope, self.curve.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Sums:
        size = int(round(((4 * len(flat) - 7) ** 0.5 - 1) / 2))
        return Sums(flat[0], flat[1], flat[2 : size + 2], flat[size + 2 :].reshape(size, size))


def sums(places: np.ndarray, w: np.ndarray) -> Sums:
    """Sums of ``log(1 + e^g)``, where a row's g is the weights of its bins and the bias."""
    size, n, d = len(w) - 1, *places.shape
    g = w[places].sum(1) + w[-1]
    s = _sigmoid(g)
    slope = np.append(np.bincount(places.ravel(), np.repeat(s, d), size), s.sum())
    curve = np.zeros((size + 1, size + 1))
    h, wide = s * (1 - s), BINS + 1
    for j in range(d):
        mine = places[:, j] - j * wide
        for k in range(j, d):
            both = np.bincount(mine * wide + places[:, k] - k * wide, h, wide * wide).reshape(wide, wide)
            curve[j * wide : j * wide + wide, k * wide : k * wide + wide] = both
            curve[k * wide : k * wide + wide, j * wide : j * wide + wide] = both.T
        curve[j * wide : j * wide + wide, -1] = curve[-1, j * wide : j * wide + wide] = np.bincount(mine, h, wide)
    curve[-1, -1] = h.sum()
    return Sums(float(n), float(np.logaddexp(0, g).sum()), slope, curve)


def _newton(bad: Callable[[np.ndarray], Sums], good: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, negative: Callable[[np.ndarray, float], float], most: int = 30) -> np.ndarray:
    """Weights of least risk by damped Newton steps; ``bad`` is one pass over all unlabelled rows.

    ``good`` gives the gradient and curvature that the positives add. A step that takes the negative
    part of the risk below zero is halved until it does not; where none is left, the descent ends.
    """
    w = np.zeros(size + 1)
    ridge = RIDGE * np.append(np.ones(size), 1e-6)
    now = bad(w)
    for _ in range(most):
        slope, curve = good(w)
        step = np.linalg.solve(now.curve / now.n + curve + np.diag(ridge), now.slope / now.n + slope + ridge * w)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        for _ in range(7):
            then = bad(w - step)
            if negative(w - step, then.loss / then.n) >= 0:
                break
            step = step / 2
        else:
            break
        w, now = w - step, then
        if np.abs(step).max() < 1e-2:
            break
    return w


def estimate_prior(p: np.ndarray, above_u: Callable[[np.ndarray], tuple[np.ndarray, int]], least: float = 0.2) -> float:
    """Class prior from scores of positives and unlabelled: the least ratio of the shares above a
    threshold, two standard errors up, over thresholds that keep at least ``least`` of the positives.
    ``above_u`` gives the share of unlabelled scores at or above each threshold, and their number."""
    p = np.sort(p)
    at = np.quantile(p, np.linspace(0.0, 1 - least, 40))
    above_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    above, n = above_u(at)
    ratio = above / above_p
    error = ratio * np.sqrt((1 - above_p) / (above_p * len(p)) + (1 - above) / (np.maximum(above, 1e-9) * n))
    return float(np.clip((ratio + 2 * error).min(), 0.01, 0.99))


class Unlabelled:
    """Unlabelled rows, in memory: what a fit asks of them. ``Stored`` asks a table the same."""

    def __init__(self, places: np.ndarray) -> None:
        self.places = places

    def half(self, k: int) -> Unlabelled:
        return Unlabelled(self.places[k::2])

    def sums(self, w: np.ndarray) -> Sums:
        return sums(self.places, w)

    def above(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        g = np.sort(w[self.places].sum(1) + w[-1])
        return 1 - np.searchsorted(g, at, side="left") / max(len(g), 1), len(g)


class Stored(Unlabelled):
    """Rows of a stored table ``_id, x``: each answer is one pass, added up by Spark."""

    def __init__(self, features: DataFrame, cuts: tuple[np.ndarray, ...]) -> None:
        self.features, self.cuts = features, cuts

    def half(self, k: int) -> Stored:
        return Stored(self.features.where(F.pmod(F.xxhash64("x"), F.lit(2)) == k), self.cuts)

    def _added(self, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        cuts = self.cuts

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for start in range(0, batch.num_rows, 20_000):
                    x = batch.column(0).slice(start, 20_000).flatten().to_numpy().reshape(-1, len(cuts))
                    if len(x):
                        total += of(binned(x, cuts))
            at = np.flatnonzero(total)
            yield record([at, total[at]], pa.schema([("at", pa.int64()), ("v", pa.float64())]))

        found = self.features.select("x").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # ``width`` rows at most
        out = np.zeros(width)
        out[found["at"].to_numpy()] = found["v"].to_numpy()
        return out

    def sums(self, w: np.ndarray) -> Sums:
        return Sums.of(self._added(lambda places: sums(places, w).flat(), 2 + len(w) + len(w) ** 2))

    def above(self, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
        def count(places: np.ndarray) -> np.ndarray:
            g = np.sort(w[places].sum(1) + w[-1])
            return np.append(len(g) - np.searchsorted(g, at, side="left"), len(g))

        found = self._added(count, len(at) + 1)
        return found[:-1] / max(found[-1], 1), int(found[-1])


def fit_weights(p: np.ndarray, unlabelled: Unlabelled, size: int, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights and prior from the bins of the positives and all unlabelled rows."""
    if prior is None:
        # Each half is scored by what tells the other half's rows apart.
        found = []
        for k in (0, 1):
            mine, other, rows = p[k::2], p[1 - k :: 2], unlabelled.half(k)
            if len(mine) and len(other):

                def apart(w: np.ndarray, mine=mine) -> tuple[np.ndarray, np.ndarray]:
                    x = sums(mine, -w)  # loss as good texts
                    return -x.slope / x.n, x.curve / x.n

                w = _newton(rows.sums, apart, size, lambda w, loss: 0.0)
                found.append(estimate_prior(w[other].sum(1) + w[-1], lambda at, w=w, k=k: unlabelled.half(1 - k).above(w, at)))
        prior = float(np.mean(found or [0.5]))

    # For this loss the risk is convex: prior * (loss(good) - loss(bad)) of the positives is -prior * g.
    pull = np.append(np.bincount(p.ravel(), minlength=size), len(p)) / max(len(p), 1)
    flat = np.zeros((size + 1, size + 1))

    def negative(w: np.ndarray, loss: float) -> float:
        return loss - prior * np.logaddexp(0, w[p].sum(1) + w[-1]).mean()

    return _newton(unlabelled.sums, lambda w: (-prior * pull, flat), size, negative), prior


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> PuModel:
    """The fit on arrays of document statistics."""
    both = np.concatenate([positive, unlabelled])
    cuts = tuple(np.unique(np.quantile(both[:, j], CUTS)) for j in range(both.shape[1]))
    w, prior = fit_weights(binned(positive, cuts), Unlabelled(binned(unlabelled, cuts)), both.shape[1] * (BINS + 1), prior)
    return PuModel(cuts, w[:-1], float(w[-1]), prior)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, x``: the statistics of every whole text, stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            _, x = statistics(texts_of(batch, "_text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([ids_of(batch, "_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel().astype(float)))], names=["_id", "x"])

    return stored(narrow.mapInArrow(rows, f"_id {kind}, x array<double>"), "op8-features")


def fit_features(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", target: str = "quality", max_rows: int = 20_000) -> PuModel | None:
    """Cuts, unlabelled risk and prior come from all rows of ``features``; trusted positives are at
    most ``max_rows`` labelled rows, the first by the hash of their ids."""
    good = labels.where(F.col(id_col).isNotNull() & (F.col(target) == 1)).select(F.col(id_col).alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    trusted = features.join(F.broadcast(good), "_id").select("x").toArrow()["x"].to_pylist()
    if not trusted:
        return None
    width = len(trusted[0])
    cut = [F.percentile_approx(F.col("x")[j], list(CUTS), 10_000).alias(f"q{j}") for j in range(width)]
    cuts = tuple(np.unique(np.array(q, float)) for q in features.agg(*cut).first())
    judged = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1)).agg(F.avg(F.col(target).cast("double")).alias("share"), F.count("*").alias("n")).first()
    prior = None
    if judged["share"] is not None and judged["share"] < 1:
        prior = max(0.05, judged["share"] - 2 * (judged["share"] * (1 - judged["share"]) / judged["n"]) ** 0.5 - MARGIN)
    p = binned(np.array(sorted(trusted)), cuts)
    w, prior = fit_weights(p, Stored(features, cuts), width * (BINS + 1), prior)
    return PuModel(cuts, w[:-1], float(w[-1]), prior)


def fit_quality_pu(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", max_rows: int = 20_000) -> PuModel | None:
    """``fit_features`` on the statistics of ``docs``."""
    return fit_features(text_features(docs, id_col, text_col), labels, id_col, target, max_rows)


def score_features(features: DataFrame, model: PuModel | None, id_col: str = "doc_id") -> DataFrame:
    """``id, score`` of every row of ``features``."""
    kind = features.schema["_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            value = model.score(batch.column(1).flatten().to_numpy().reshape(n, -1)) if model and n else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], names=["_id", "score"])

    return features.mapInArrow(score, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def score_quality(docs: DataFrame, model: PuModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every whole text."""
    return score_features(text_features(docs, id_col, text_col), model, id_col)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model that learns no label of the held-out fold (crc32 of the id, modulo 5, is 0)."""
    features = text_features(docs, id_col, text_col)
    model = fit_features(features, labels.where(hashed_bucket(id_col, 5) != 0), id_col)
    fold = F.coalesce(hashed_bucket(id_col, 5) == 0, F.lit(False))
    return score_features(features, model, id_col).select(id_col, fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
