"""Scoring of captures by a model of the user's, and what it could not score."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(captures: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], np.ndarray]], classes: int, key: str = "file", signal: str = "signal") -> DataFrame:
    """key, prob array<double>, error string: one row for every capture. load() runs once in a task and gives predict(signals), which returns
    logits of shape signals x classes. When a batch fails, its captures are tried one by one, so a bad one takes only itself along."""

    def attempt(predict, signals: list[np.ndarray]) -> np.ndarray:
        logits = np.asarray(predict(signals), np.float64)
        if logits.shape != (len(signals), classes):
            raise ValueError(f"logits of shape {logits.shape} for {len(signals)} signals")
        if not np.isfinite(logits).all():
            raise ValueError("logits that are not finite")
        return 0.5 * (1 + np.tanh(logits / 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for b in batches:
            prob, error = [None] * len(b), [None] * len(b)
            sound = [i for i, x in enumerate(b[signal]) if x is not None and len(x)]
            signals = {i: np.asarray(b[signal].iloc[i], np.float64) for i in sound}
            try:
                done = list(attempt(predict, list(signals.values()))) if sound else []
                prob = dict(enumerate(prob)) | dict(zip(sound, done, strict=True))
            except Exception:  # any error of the user's model is a row's result, not the job's end
                prob = dict(enumerate(prob))
                for i in sound:
                    try:
                        prob[i] = attempt(predict, [signals[i]])[0]
                    except Exception as e:
                        error[i] = f"{type(e).__name__}: {e}"
            for i in set(range(len(b))).difference(sound):
                error[i] = "no signal"
            yield pd.DataFrame({key: b[key], "prob": pd.Series([prob[i] for i in range(len(b))], index=b.index, dtype=object), "error": pd.Series(error, index=b.index, dtype=object)})

    kind = captures.schema[key].dataType.simpleString()
    return captures.select(key, signal).mapInPandas(run, f"{key} {kind}, prob array<double>, error string")


def failures(scores: DataFrame, key: str = "file") -> DataFrame:
    return scores.where(F.col("error").isNotNull()).select(key, "error")
