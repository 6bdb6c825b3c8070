"""Adaptive quadrature of a density over a box, its cells evaluated by tasks.

Every cell carries three Gauss-Legendre nodes per axis.  Cells with the most error are halved along
the axis with the larger error, until the errors of all cells together are below the wanted share
of the integral.  Along an axis, let b be the distance between a cell's value and that of its middle
nodes alone, as a share of the value: three nodes are wrong by about b^3 / 10 of the value where the density is close to
a normal or an exponential one, so b^3 is taken (b where it exceeds 1).  A half inherits at least a sixteenth of the change that
halving made.
What reaches the driver is one number per node; how many there are follows from the density's shape
and the tolerance, never from the rows behind it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

_AT = np.array([0.5 - math.sqrt(0.15), 0.5, 0.5 + math.sqrt(0.15)])  # nodes on 0..1
_SHARE = np.array([5, 8, 5]) / 18
_PART = np.r_[0.0, np.cumsum(_SHARE)]  # each node stands for a part of its cell as wide as its share


@dataclass(frozen=True)
class Integral:
    """Weighted nodes of a density and the integral's logarithm, relative error and number of cells.

    ``nodes`` has one row per node; ``weight`` adds up to 1; ``low`` and ``high`` bound the part of the
    cell that a node stands for.
    """

    nodes: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    high: np.ndarray
    log_value: float
    error: float
    cells: int


def _places(axes: int) -> np.ndarray:
    """Index of every node of a cell along every axis."""
    return np.array(list(itertools.product(range(3), repeat=axes)))


def _node_values(spark: SparkSession, log_density: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Log of weight times density at the nodes of every cell: one row per cell."""
    axes = low.shape[1]
    place = _places(axes)
    share = np.log(_SHARE[place].prod(1))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = []
            for box in batch["box"]:
                start, width = np.array(box[:axes]), np.array(box[axes:])
                at = start + width * _AT[place]
                values.append([log_density(x) for x in at] + share + np.log(width).sum())
            yield pd.DataFrame({"cell": batch["cell"], "values": values})

    boxes = [(i, [*map(float, a), *map(float, b - a)]) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    table = spark.createDataFrame(boxes, "cell long, box array<double>").mapInPandas(evaluate, "cell long, values array<double>")
    out = np.empty((len(low), len(place)))
    for cell, values in table.collect():
        out[cell] = values
    return out


def integrate(
    spark: SparkSession, log_density: Callable[[np.ndarray], float], low: tuple[float, ...], high: tuple[float, ...],
    start: tuple[int, ...], tolerance: float = 1e-3, most_cells: int = 8_192,
) -> Integral:
    """Integral of ``exp(log_density(x))`` over the box ``low..high``, cut into ``start`` cells per axis at first.

    ``error`` states what was reached: it exceeds ``tolerance`` only where ``most_cells`` ends the refinement.
    The first cells must be narrow enough to meet the density's peak.
    """
    axes = len(low)
    place = _places(axes)
    edges = [np.linspace(a, b, n + 1) for a, b, n in zip(low, high, start, strict=True)]
    lows = np.array(list(itertools.product(*(e[:-1] for e in edges))))
    highs = np.array(list(itertools.product(*(e[1:] for e in edges))))
    logs = _node_values(spark, log_density, lows, highs)
    top = logs.max()
    error = _errors(logs, top, place).sum(1)
    while True:
        value = np.exp(logs - top).sum(1)
        total, allowed = value.sum(), tolerance * value.sum()
        if error.sum() <= allowed or len(lows) >= most_cells:
            break
        order = np.argsort(-error, kind="stable")
        left = error.sum() - np.cumsum(error[order])
        split = order[: 1 + np.argmax(left <= allowed / 2)]
        axis = _errors(logs[split], top, place).argmax(1)
        middle = (lows[split] + highs[split]) / 2
        row = np.arange(len(split))
        first_high, second_low = highs[split].copy(), lows[split].copy()
        first_high[row, axis] = second_low[row, axis] = middle[row, axis]
        new_low, new_high = np.vstack([lows[split], second_low]), np.vstack([first_high, highs[split]])
        new_logs = _node_values(spark, log_density, new_low, new_high)
        raised = max(top, new_logs.max())
        error, value, top = error * math.exp(top - raised), value * math.exp(top - raised), raised
        halves = np.exp(new_logs - top).sum(1).reshape(2, -1)
        change = np.tile(np.abs(halves.sum(0) - value[split]) / 16, 2)
        keep = np.ones(len(lows), bool)
        keep[split] = False
        lows, highs = np.vstack([lows[keep], new_low]), np.vstack([highs[keep], new_high])
        logs, error = np.vstack([logs[keep], new_logs]), np.r_[error[keep], np.maximum(_errors(new_logs, top, place).sum(1), change)]
    width = (highs - lows)[:, None, :]

    def over(part: np.ndarray) -> np.ndarray:
        return (lows[:, None, :] + width * part[place]).reshape(-1, axes)

    return Integral(
        over(_AT), (np.exp(logs - top) / total).ravel(), over(_PART[:-1]), over(_PART[1:]),
        top + math.log(total), float(error.sum() / total), len(lows),
    )


def _errors(logs: np.ndarray, top: float, place: np.ndarray) -> np.ndarray:
    """Per cell and axis: how far the cell's value may be off."""
    v = np.exp(logs - top)
    middle = np.column_stack([v[:, place[:, a] == 1].sum(1) / _SHARE[1] for a in range(place.shape[1])])
    value = v.sum(1)[:, None]
    bend = np.abs(value - middle)
    return bend * np.minimum(1.0, bend / np.maximum(value, 1e-300)) ** 2


def quantiles(low: np.ndarray, high: np.ndarray, weight: np.ndarray, probs: tuple[float, ...]) -> np.ndarray:
    """Quantiles along one axis of weights spread evenly over the intervals ``low..high``."""
    edges, place = np.unique(np.r_[low, high], return_inverse=True)
    slope = np.bincount(place, np.r_[weight / (high - low), -weight / (high - low)])
    cdf = np.r_[0.0, np.cumsum(np.cumsum(slope)[:-1] * np.diff(edges))]
    return np.interp(probs, cdf / cdf[-1], edges)
