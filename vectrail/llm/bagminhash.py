"""Weighted-Jaccard signatures (BagMinHash) and bands of them.

Every feature owns a Poisson process of points over (weight, time), the same in every record; a record sees the points below
its weight. A point also picks one of m signature components, and a component's value is the earliest point that the record
sees there, so two records agree in a component with the probability sum(min w) / sum(max w). The weights are cut into
dyadic cells ([0, u), [u, 2u), [2u, 4u), ...), each with a process of its own, so that a record only draws in cells its
weight reaches; the points of the topmost cell are thinned by their position. Points are drawn in the order of time, up to a
horizon at which all components are likely filled; records for which they aren't draw again with a longer one. So a record
costs about m log m points, however many features it has, besides one for each feature and cell.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_C = tuple(map(U, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))  # fixed values of splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _C[0]
        x = (x ^ (x >> U(30))) * _C[1]
        x = (x ^ (x >> U(27))) * _C[2]
        return x ^ (x >> U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from 64 random bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def cells(weight: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """For each weight and each dyadic cell it reaches: the index of the weight, and the cell."""
    reach = np.where(weight > unit, np.ceil(np.log2(np.maximum(weight, unit) / unit)), 0).astype(np.int64) + 1
    index = np.repeat(np.arange(len(weight)), reach)
    cell = np.arange(len(index)) - np.repeat(np.cumsum(reach) - reach, reach)
    return index, cell


def signatures(record: np.ndarray, feature: np.ndarray, weight: np.ndarray, records: int, m: int, unit: float = 1.0, slack: float = 2.0) -> np.ndarray:
    """uint64 (records, m) signatures. record: the record's index for each feature; weights must be positive. A record
    without features gets a row of zeros, which is no signature."""
    total = np.bincount(record, weight, records) if len(record) else np.zeros(records)
    out = np.zeros((records, m), U)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        horizon = np.zeros(records)
        horizon[todo] = m * (np.log(m) + slack) / total[todo]
        here = horizon[record] > 0
        best, value = _draw(record[here], feature[here], weight[here], horizon, m, unit)
        filled = np.isfinite(best).reshape(records, m).all(1)
        ready = todo[filled[todo]]
        out[ready] = value.reshape(records, m)[ready]
        todo = todo[~filled[todo]]
        slack = 2 * slack + 3
    return out


def _draw(record, feature, weight, horizon, m, unit):
    """The earliest point of each record and component up to the record's horizon."""
    best = np.full(len(horizon) * m, np.inf)
    value = np.zeros(len(horizon) * m, U)
    index, cell = cells(weight, unit)
    low = np.where(cell > 0, unit * 2.0 ** (cell - 1.0), 0.0)
    width = np.where(cell > 0, low, unit)
    with np.errstate(over="ignore"):
        seed = mix(feature[index] + mix(cell.astype(U)))
    record, weight, time = record[index], weight[index], np.zeros(len(index))
    until, k = horizon[record], 0
    while len(record):
        with np.errstate(over="ignore"):
            bits = mix(seed + U(3 * k) * _C[1])
        time = time - np.log(_unit(bits)) / width
        on = time <= until
        record, weight, time, low, width, seed, until = (x[on] for x in (record, weight, time, low, width, seed, until))
        with np.errstate(over="ignore"):
            point = mix(seed + U(3 * k + 1) * _C[1])
        seen = low + width * _unit(mix(point)) < weight
        at = record[seen] * m + (point[seen] % U(m)).astype(np.int64)
        t, p = time[seen], point[seen]
        np.minimum.at(best, at, t)
        first = best[at] == t
        value[at[first]] = p[first]
        k += 1
    return best, value


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """int64 (records, m // rows) keys, of which each holds `rows` components and its place."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(m // rows, dtype=U)), (n, m // rows)).copy()
        for r in range(rows):
            key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)
