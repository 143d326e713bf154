"""Points that lie in boxes of the same page, by a band join.

Boxes and points meet page by page: each comes as one row a page, so those that are dealt by page stay where they are. Within
a page, points are sorted by band (y) and place (x); a box takes from each band that it touches the run of points between its
ends, by binary search. So a page costs its sorted points and what its boxes hold, never all its boxes by all its points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that a task looks at together.
SLICE = 1 << 21


def doubles(values: pa.Array) -> np.ndarray:
    """A numeric column in doubles; null becomes NaN."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def items(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and the number of the list that each is in."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), length)


def offsets(length: np.ndarray) -> np.ndarray:
    """0 and the running totals."""
    return np.r_[0, np.cumsum(length)].astype(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from start[i] on, length[i] of them, one run after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs as complex numbers, which are ordered by the first, then by the second."""
    out = np.empty(len(a), np.complex128)
    out.real, out.imag = a, b
    return out


def _runs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each j from start[i] up to end[i], in slices."""
    length = np.maximum(end - start, 0)
    total, at = np.cumsum(length), 0
    while at < len(length):
        base = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + SLICE, side="right")))
        yield np.repeat(np.arange(at, to), length[at:to]), ragged(start[at:to], length[at:to])
        at = to


def met(box_page: np.ndarray, box: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], point_page: np.ndarray, x: np.ndarray, y: np.ndarray, band: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of boxes and of points that lie in them, ends included; box: least and greatest x, least and greatest y."""
    x0, x1, y0, y1 = box
    own, there = np.flatnonzero((x0 <= x1) & (y0 <= y1)), np.flatnonzero(~(np.isnan(x) | np.isnan(y)))  # NaN is in no order
    order = there[np.lexsort((x[there], np.floor(y[there] / band), point_page[there]))]
    key = _both(point_page[order], np.floor(y[order] / band))
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    bands, group = key[begin], np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(key)]))
    place = _both(group, x[order])
    first = np.searchsorted(bands, _both(box_page[own], np.floor(y0[own] / band)), side="left")
    last = np.searchsorted(bands, _both(box_page[own], np.floor(y1[own] / band)), side="right")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for b, g in _runs(first, last):
        left, right = np.searchsorted(place, _both(g, x0[own[b]]), side="left"), np.searchsorted(place, _both(g, x1[own[b]]), side="right")
        for i, p in _runs(left, right):
            i, p = own[b[i]], order[p]
            hit = (y[p] >= y0[i]) & (y[p] <= y1[i])
            found.append((i[hit], p[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def lists(rows: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """n lists of rows, which stand in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), rows)


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: list[str], x: tuple[Column, Column, Column], y: tuple[Column, Column, Column], grid: tuple[float, float]) -> DataFrame:
    """Each box of `boxes` with each point of `points` in it, ends included.

    x, y: a box's least and greatest coordinate, then the point's; grid: about the width and height of a box. keys: columns of both
    that must be equal (the page). Rows without coordinates, and boxes whose ends are the wrong way round, meet nothing."""

    @F.arrow_udf("array<struct<b:int,p:int>>")
    def pairs(x0: pa.Array, x1: pa.Array, y0: pa.Array, y1: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        (left, page), (at, point_page) = items(x0), items(px)
        b, p = met(page, (doubles(left), *(doubles(items(v)[0]) for v in (x1, y0, y1))), point_page, doubles(at), doubles(items(py)[0]), grid[1])
        order = np.argsort(page[b], kind="stable")
        b, p = b[order], p[order]
        owner = page[b]
        number = lambda of, i: pa.array(i - np.searchsorted(of, owner) + 1, pa.int32())
        return lists(pa.StructArray.from_arrays([number(page, b), number(point_page, p)], ["b", "p"]), owner, len(x0))

    own = [c for c in points.columns if c not in keys]
    put = lambda c: c.cast("double")
    sides = boxes.where((x[0] <= x[1]) & (y[0] <= y[1])).groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*boxes.columns).alias("row"), put(x[0]).alias("x0"), put(x[1]).alias("x1"), put(y[0]).alias("y0"), put(y[1]).alias("y1"))).alias("_b"))
    spots = points.where(x[2].isNotNull() & y[2].isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*own).alias("row"), put(x[2]).alias("x"), put(y[2]).alias("y"))).alias("_p"))
    both = sides.join(spots, keys).withColumn("_pairs", pairs("_b.x0", "_b.x1", "_b.y0", "_b.y1", "_p.x", "_p.y"))
    rows = both.select("_b", "_p", F.explode("_pairs").alias("_at")).select(F.element_at("_b", F.col("_at.b"))["row"].alias("_box"), F.element_at("_p", F.col("_at.p"))["row"].alias("_point"))
    return rows.select("_box.*", "_point.*")
