"""Spectral templates of single sources and what they say about a mixture's power spectrum."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.arrays import let, total
from .classifier import Softmax, softmax_classifier
from .splits import order_key


def power_spectrum(magnitude: Column, bins: int, frames: int) -> Column:
    """Mean square of each bin of a flat bins x frames array, summing to 1; uniform if there is no power."""
    square = lambda i: total(F.transform(F.slice(magnitude, i * frames + 1, frames), lambda v: v.cast("double") * v.cast("double"))) / frames
    power = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), square)
    return let(power, lambda p: let(total(p), lambda t: F.transform(p, lambda v: F.when(t <= 1e-20, 1.0 / bins).otherwise(v / t))))


def build(rows: DataFrame, most: int = 1000, seed: int = 42) -> DataFrame:
    """(class, template): the median spectrum of up to so many captures of each class, summing to 1. rows: file, class, power."""
    rank = F.row_number().over(Window.partitionBy("class").orderBy(order_key(seed, F.col("file")), "file"))
    some = rows.withColumn("_r", rank).where(F.col("_r") <= most)
    mid = some.select("class", F.posexplode("power").alias("bin", "p")).groupBy("class", "bin").agg(F.percentile("p", F.lit(0.5)).alias("p"))
    one = mid.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "p"))), lambda r: r["p"]).alias("t"))  # as many entries as bins
    return one.select("class", let(total(F.col("t")), lambda s: F.transform("t", lambda v: F.when(s <= 1e-20, v).otherwise(v / s))).alias("template"))


def nonnegative_fit(design: np.ndarray, power: np.ndarray, rounds: int = 10_000) -> np.ndarray:
    """Least-squares coefficients >= 0 of rows of power on the columns of design, by block principal pivoting.

    A row's columns are split into free ones, whose coefficients solve the normal equations, and bound ones, which are 0. Columns with a negative coefficient, or
    with a gradient that asks for more, change sides: all of them while their number falls, and after three rounds without that only the last one, which ends for any
    split. Rows with one split are solved together. A row is done when no column wants to change: these are the optimum's conditions.
    """
    n, k = len(power), design.shape[1]
    gram, right = design.T @ design, power @ design
    scale = 1e-10 * np.maximum(np.abs(right).max(axis=1, initial=0.0), 1e-300)[:, None]
    free, c, g = np.zeros((n, k), bool), np.zeros((n, k)), -right
    fewest, tries = np.full(n, k + 1), np.full(n, 3)
    for _ in range(rounds):
        wrong = np.where(free, c < -1e-12 * np.maximum(np.abs(c).max(axis=1, initial=0.0), 1e-300)[:, None], g < -scale)
        count = wrong.sum(axis=1)
        todo = np.flatnonzero(count)
        if not len(todo):
            return np.where(free, np.maximum(c, 0), 0)
        better = count[todo] < fewest[todo]
        tries[todo] = np.where(better, 3, tries[todo] - 1)
        fewest[todo] = np.where(better, count[todo], fewest[todo])
        single = todo[tries[todo] < 0]
        last = k - 1 - wrong[single, ::-1].argmax(axis=1)
        flip = wrong[todo]
        flip[tries[todo] < 0] = np.arange(k)[None, :] == last[:, None]
        free[todo] ^= flip
        splits, member = np.unique(free[todo], axis=0, return_inverse=True)
        member = member.ravel()
        for j, split in enumerate(splits):
            rows, on = todo[member == j], np.flatnonzero(split)
            c[rows] = 0
            if len(on):
                c[np.ix_(rows, on)] = np.linalg.lstsq(gram[np.ix_(on, on)], right[np.ix_(rows, on)].T, rcond=1e-13)[0].T
            g[rows] = c[rows] @ gram - right[rows]
    raise ArithmeticError("no split was found that meets the conditions")


def mixture_features(rows: DataFrame, templates: np.ndarray) -> DataFrame:
    """rows (power; null: null) with features: K fractions, K log1p coefficients, K cosines, the relative residual and the flat background's coefficient. templates: K x bins."""
    templates = np.asarray(templates, np.float64)
    k, bins = templates.shape
    design = np.column_stack([templates.T, np.full(bins, 1 / bins)])

    def made(batches):
        for b in batches:
            given = b.column("power").to_pylist()
            p = np.array([np.zeros(bins) if v is None else v for v in given], np.float64).reshape(-1, bins)
            c = nonnegative_fit(design, p)
            norm = np.maximum(np.linalg.norm(p, axis=1), 1e-12)
            cosine = (p @ templates.T) / np.maximum(np.linalg.norm(templates, axis=1)[None] * norm[:, None], 1e-12)
            residual = np.linalg.norm(p - c @ design.T, axis=1) / norm
            share = c[:, :k] / np.maximum(c[:, :k].sum(axis=1, keepdims=True), 1e-12)
            out = np.column_stack([share, np.log1p(c[:, :k]), cosine, residual, c[:, k]])
            column = pa.array([None if v is None else row for v, row in zip(given, out, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "features"])

    return rows.mapInArrow(made, StructType([*rows.schema.fields, StructField("features", ArrayType(DoubleType()))]))


def combination_model(rows: DataFrame, most: int | None = 2000, seed: int = 42) -> Softmax:
    """The model from features to the combination's index (y), learnt from up to so many rows of each combination, or from all."""
    return softmax_classifier(rows, most, seed=seed)


def with_vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("vector", array_to_vector("features"))
