"""A linear classifier of any number of classes, fitted by Newton steps on sums over distributed rows."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept
from .redundancy import summed
from .splits import stratum_rank


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(column) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


@dataclass
class Softmax:
    """classes: the values of y; features are centred by mean and divided by scale; weights has a row for each class, its intercept last; gradient: the largest entry where fitting ended; cost: what was reached."""

    classes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    gradient: float
    cost: float
    passes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _softmax(((x - self.mean) / self.scale) @ self.weights[:, :-1].T + self.weights[:, -1])

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with class_prob, in the order of classes, and prediction, the most probable class; null where features are null."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            for b in batches:
                column = b.column("features")
                known = np.flatnonzero(np.asarray(column.is_valid()))
                p = model.scores(_features(column.drop_null())) if len(known) else np.zeros((0, len(model.classes)))
                probs, best = [None] * b.num_rows, [None] * b.num_rows
                for i, q in zip(known, p, strict=True):
                    probs[i], best[i] = q, model.classes[int(q.argmax())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(probs, pa.list_(pa.float64())), pa.array(best, pa.int32())], names=[*b.schema.names, "class_prob", "prediction"])

        made = [T.StructField("class_prob", T.ArrayType(T.DoubleType())), T.StructField("prediction", T.IntegerType())]
        return rows.mapInArrow(scored, T.StructType([*rows.schema.fields, *made]))


def softmax_classifier(rows: DataFrame, most: int | None = None, penalty: float = 1.0, seed: int = 42, key: str = "file", bound: float = 1e-8, rounds: int = 100) -> Softmax:
    """The multinomial logistic model of rows (key, y int, features array<double> of one length) that minimises the weighted log loss plus half the penalty times the squared weights, intercepts apart.

    Features are standardized. Classes weigh the same: a row counts N / (classes x rows of its class). It learns from all rows, or from the first `most` of each
    class in seeded order. Each Newton step takes one pass: tasks sum the loss, its gradient and its second derivatives, so the driver gets (classes x (features + 1))^2 numbers
    whatever the rows; a step that doesn't lower the cost is halved. It ends when no entry of the gradient, divided by the rows, is over the bound. Rows with null y or features are left out.
    """
    rows = rows.where("y is not null and features is not null").select(key, F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    if most is not None:
        rows = stratum_rank(rows, key, ["y"], seed).where(F.col("_rank") <= most)
    rows = kept(rows.select("y", "features"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row for each class
    if not counts:
        raise ValueError("no rows to learn from")
    classes, width, n = sorted(counts), rows.select(F.size("features")).first()[0], sum(counts.values())
    spark = rows.sparkSession
    sums = summed(rows.select(F.col("features").alias("v")), lambda x: np.vstack([x.sum(0), (x * x).sum(0)]), (2, width))
    mean = sums[0] / n
    deviation = np.sqrt(np.maximum(summed(rows.select(F.col("features").alias("v")), lambda x: ((x - mean) ** 2).sum(0)[None, :], (1, width))[0] / n, 0))
    scale = np.where(deviation > 0, deviation, 1.0)
    k, size = len(classes), width + 1
    weight = np.array([n / (k * counts[c]) for c in classes])
    shrink = np.tile(np.r_[np.full(width, penalty), 0.0], k)

    def moments(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast((w, mean, scale, np.array(classes), weight))

        def part(v: np.ndarray) -> np.ndarray:
            w, mean, scale, classes, weight = sent.value
            y = np.searchsorted(classes, v[:, 0])
            x = np.hstack([(v[:, 1:] - mean) / scale, np.ones((len(v), 1))])
            p, of = _softmax(x @ w.T), weight[y]
            out = np.zeros((k * size + 1, k * size))
            off = p.copy()
            off[np.arange(len(y)), y] -= 1
            out[-1] = ((off * of[:, None]).T @ x).ravel()
            for c in range(k):
                for d in range(c, k):
                    h = (x * (of * p[:, c] * ((c == d) - p[:, d]))[:, None]).T @ x
                    out[c * size : (c + 1) * size, d * size : (d + 1) * size] = h
                    out[d * size : (d + 1) * size, c * size : (c + 1) * size] = h
            loss = -(of * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
            return np.vstack([out, np.r_[loss, np.zeros(k * size - 1)]])

        v = rows.select(F.concat(F.array(F.col("y").cast("double")), "features").alias("v"))
        total = summed(v, part, (k * size + 2, k * size))
        flat = w.ravel()
        return float(total[-1, 0] + 0.5 * (shrink * flat * flat).sum()), total[-2] + shrink * flat, total[:-2] + np.diag(shrink)

    w, passes = np.zeros((k, size)), 1
    cost, gradient, second = moments(w)
    while np.abs(gradient).max() > bound * n and passes < rounds:
        # a constant added to all intercepts changes nothing, so the least step is taken among equals
        step = np.linalg.lstsq(second, -gradient, rcond=1e-12)[0].reshape(k, size)
        for _ in range(30):
            found = moments(w + step)
            passes += 1
            if found[0] <= cost + 1e-9 * abs(cost):
                break
            step = step / 2
        w, (cost, gradient, second) = w + step, found
    return Softmax(classes, mean, scale, w, float(np.abs(gradient).max()) / n, cost, passes)
