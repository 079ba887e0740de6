"""Monitors as Structured Streaming: one bounded state for each stratum.

A stream holds (stratum, seq, score); rows of a micro-batch are taken in order of seq.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_moments(stream: DataFrame) -> DataFrame:
    """(stratum, seq, n, mean, variance) after each batch: a state of three numbers."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        last = None
        for b in batches:
            x = b["score"].to_numpy(float)
            last = b["seq"].max() if last is None else max(last, b["seq"].max())
            x = x[np.isfinite(x)]
            if len(x):  # merge of two sets of moments
                k, mu = len(x), x.mean()
                gap = mu - mean
                m2 += ((x - mu) ** 2).sum() + gap * gap * n * k / (n + k)
                mean += gap * k / (n + k)
                n += k
        state.update((int(n), float(mean), float(m2)))
        if last is not None:
            yield pd.DataFrame({"stratum": [key[0]], "seq": [int(last)], "n": [int(n)], "mean": [mean], "variance": [m2 / n if n else math.nan]})

    kind = dict(stream.dtypes)["stratum"]
    return stream.groupBy("stratum").applyInPandasWithState(update, f"stratum {kind}, seq long, n long, mean double, variance double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


def martingale(stream: DataFrame, lo: float, hi: float, cells: int = 512, epsilon: float = 0.5, level: float = 0.01) -> DataFrame:
    """(stratum, seq, p, log_capital, alarm) for each row: p-values against counts in ``cells`` equal cells of [lo, hi].

    Counts make the state bounded: scores of one cell count as tied (half of them, with the
    row itself, below). An alarm is raised while capital is at least 1 / level.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log, counts = (state.get[0], np.array(state.get[1])) if state.exists else (0.0, np.zeros(cells, np.int64))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, score in zip(rows["seq"], rows["score"], strict=True):
            if not math.isfinite(score):
                continue
            c = min(cells - 1, max(0, int((score - lo) / (hi - lo) * cells)))
            counts[c] += 1
            p = (counts[:c].sum() + 0.5 * counts[c]) / counts.sum()
            log += math.log(epsilon) + (epsilon - 1) * math.log(p)
            out.append((key[0], int(seq), p, log, log >= -math.log(level)))
        state.update((float(log), counts.tolist()))
        if out:
            yield pd.DataFrame(out, columns=["stratum", "seq", "p", "log_capital", "alarm"])

    kind = dict(stream.dtypes)["stratum"]
    return stream.groupBy("stratum").applyInPandasWithState(update, f"stratum {kind}, seq long, p double, log_capital double, alarm boolean", "log double, counts array<long>", "append", GroupStateTimeout.NoTimeout)
