"""Connected components and distances inside masks: union-find over runs of rows, and exact distances by two passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every run of ones, row by row; ends are not included."""
    wide = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    wide[:, 1:-1] = m != 0
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step == 1)
    return row, start, np.nonzero(step == -1)[1]


def components(m: np.ndarray) -> np.ndarray:
    """Labels from 1 on, 0 outside, of pixels that hang together by their sides, numbered by first pixel, row by row.

    Runs of a row that touch runs of the row above are united; two runs are looked at together only where they overlap, as
    both rows' runs are in order."""
    row, start, end = runs(m)
    top = list(range(len(row)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    first = np.searchsorted(row, np.arange(m.shape[0] + 1))
    for y in range(1, m.shape[0]):
        a, b = int(first[y - 1]), int(first[y])
        while a < first[y] and b < first[y + 1]:
            if start[a] < end[b] and start[b] < end[a]:
                x, z = find(a), find(b)
                top[max(x, z)] = min(x, z)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    roots = [find(i) for i in range(len(top))]
    number = {r: k + 1 for k, r in enumerate(dict.fromkeys(roots))}
    out = np.zeros(m.shape, np.int32)
    for r, y, s, e in zip(roots, row, start, end, strict=True):
        out[y, s:e] = number[r]
    return out


def distances(m: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel to the nearest zero (0 there); without zeros a value beyond any in the mask.

    First along columns, then along rows: a neighbour k columns away can only help while k squared is less than the largest
    distance left, so the second pass ends at that distance."""
    far = m.shape[0] ** 2 + m.shape[1] ** 2
    d = np.where(m == 0, 0, m.shape[0] + m.shape[1]).astype(np.int64)
    for y in range(1, m.shape[0]):
        d[y] = np.minimum(d[y], d[y - 1] + 1)
    for y in range(m.shape[0] - 2, -1, -1):
        d[y] = np.minimum(d[y], d[y + 1] + 1)
    column = np.minimum(d * d, far)
    out = column.copy()
    k = 1
    while k < m.shape[1] and k * k < out.max(initial=0):
        out[:, k:] = np.minimum(out[:, k:], column[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], column[:, k:] + k * k)
        k += 1
    return out


def _per_mask(kind: str, use: Callable[[np.ndarray], object]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(masks: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else use(np.asarray(m).reshape(-1, int(w))) for m, w in zip(masks, widths, strict=True)])

    return run


def component_sizes(mask: Column, width: Column) -> Column:
    """Pixels of each component, in order of their labels; null for a null mask."""
    return _per_mask("array<long>", lambda m: np.bincount(components(m).ravel())[1:].tolist())(mask, width)


def several_components(mask: Column, width: Column) -> Column:
    return F.size(component_sizes(mask, width)) > 1


def inner_distances(mask: Column, width: Column) -> Column:
    """Squared distances to the nearest zero, pixel by pixel."""
    return _per_mask("array<long>", lambda m: distances(m).ravel().tolist())(mask, width)


def point_prompt(mask: Column, width: Column, key: Column, least: float = 16.0) -> Column:
    """(y, x) of one pixel farther than `least` from any zero, drawn among them by MD5 of the key, or, without such a pixel,
    the first of those farthest in. An empty mask gives its first pixel."""
    d = inner_distances(mask, width)

    def pick(d: Column) -> Column:
        inside = F.filter(F.transform(d, lambda x, i: F.when(x > least * least, i)), lambda i: i.isNotNull())
        draw = (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % F.size(inside)).cast("int")
        at = F.when(F.size(inside) > 0, F.get(inside, draw)).otherwise(F.array_position(d, F.array_max(d)).cast("int") - 1)
        return F.struct(F.floor(at / width).cast("int").alias("y"), (at % width).cast("int").alias("x"))

    return F.element_at(F.transform(F.array(d), pick), 1)
