"""Matching, shapes and lanes: one-to-one assignment, polygons and interval colouring.

The functions work on one group (a pull, a timeline) of at most a few hundred points; ``with_lanes`` and ``shapes``
apply them to the groups of a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.operators import pieces

def max_matching(edges: list[list[int]], right: int) -> list[int]:
    """For each left node its partner on the right, -1 if none; as many pairs as there can be (augmenting paths)."""
    owner = [-1] * right

    def place(u: int, tried: set[int]) -> bool:
        for v in edges[u]:
            if v not in tried:
                tried.add(v)
                if owner[v] < 0 or place(owner[v], tried):
                    owner[v] = u
                    return True
        return False

    for u in range(len(edges)):
        place(u, set())
    out = [-1] * len(edges)
    for v, u in enumerate(owner):
        if u >= 0:
            out[u] = v
    return out


def bottleneck(distance: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one (row, column) pairs, as many as there can be, with the greatest distance as small as it can be; infinite ones are no pairs."""
    steps = np.unique(distance[np.isfinite(distance)])

    def within(limit: float) -> list[int]:
        return max_matching([np.flatnonzero(row <= limit)[np.argsort(row[row <= limit], kind="stable")].tolist() for row in distance], distance.shape[1])

    if not len(steps):
        return []
    low, high = 0, len(steps) - 1
    most = sum(j >= 0 for j in within(steps[high]))
    while low < high:
        middle = (low + high) // 2
        if sum(j >= 0 for j in within(steps[middle])) == most:
            high = middle
        else:
            low = middle + 1
    return [(i, j) for i, j in enumerate(within(steps[low])) if j >= 0]


def lanes(spans: list[tuple[float, float]]) -> list[int]:
    """The lowest free lane of each span, walked by start."""
    free, out = [], [0] * len(spans)
    for i in sorted(range(len(spans)), key=lambda k: spans[k]):
        lane = next((k for k, end in enumerate(free) if end <= spans[i][0]), len(free))
        free[lane : lane + 1] = [spans[i][1]]
        out[i] = lane
    return out


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull by monotone chain, counter-clockwise from the leftmost point."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(reversed(p))


def area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True))) / 2


def centroid(polygon: list[tuple[float, float]]) -> tuple[float, float]:
    """The centre of a polygon's area; the mean of its points where it has none."""
    pairs = list(zip(polygon, polygon[1:] + polygon[:1], strict=True))
    turn = [x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in pairs]
    if not sum(turn):
        return sum(x for x, _ in polygon) / len(polygon), sum(y for _, y in polygon) / len(polygon)
    return tuple(sum((p[i] + q[i]) * t for (p, q), t in zip(pairs, turn, strict=True)) / (3 * sum(turn)) for i in (0, 1))


def inflated(polygon: list[tuple[float, float]], by: float) -> list[tuple[float, float]]:
    """A polygon with each point moved out from the centre by so much; a point at the centre stays."""
    cx, cy = centroid(polygon)
    out = []
    for x, y in polygon:
        far = float(np.hypot(x - cx, y - cy))
        out.append((x + (x - cx) / far * by, y + (y - cy) / far * by) if far else (x, y))
    return out


def inside(polygon: list[tuple[float, float]], x: float, y: float) -> bool:
    """Whether a point lies in a polygon (even-odd rule)."""
    hit = False
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


# operators


def with_lanes(spans: DataFrame, keys: list[str], start: str, end: str, order: str) -> DataFrame:
    """``spans`` with ``lane``: of each key's spans, walked by start, the lowest lane whose last span has ended.

    A key's spans are cut where no earlier one reaches: all lanes are free there, so the stretches between are coloured side by side.
    """
    schema = T.StructType([*(f for f in spans.schema.fields if f.name != "lane"), T.StructField("lane", T.IntegerType())])
    cut = pieces.with_pieces(spans.drop("lane"), keys, start, [start, end, order], 0, reach=end)

    def colour(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([start, end, order], kind="stable")
        return rows.assign(lane=np.array(lanes(list(zip(rows[start], rows[end], strict=True))), dtype=np.int32))[schema.fieldNames()]

    return cut.groupBy(*keys, pieces.PIECE).applyInPandas(colour, schema)


SHAPE = "points int, hull array<struct<x:double,y:double>>, inflated array<struct<x:double,y:double>>, cx double, cy double, area double"


def shapes(members: DataFrame, keys: list[str], by: float, x: str = "x", y: str = "y") -> DataFrame:
    """Per key: its distinct points' hull, the hull moved out by so much, its centre and area.

    A hull's corners are corners of the hulls of its parts: each task passes on the hulls of what it has seen, and a key's hulls
    are merged in one task.
    """
    types = {f.name: f.dataType for f in members.schema.fields}
    part = T.StructType([*(T.StructField(k, types[k]) for k in keys), T.StructField("n", T.LongType()), T.StructField("px", T.ArrayType(T.DoubleType())), T.StructField("py", T.ArrayType(T.DoubleType()))])
    known = members.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def partial(batches):
        for rows in batches:
            out = []
            for k, g in rows.groupby(keys, dropna=False, sort=False):
                hull = convex_hull(list(zip(g["x"].tolist(), g["y"].tolist(), strict=True)))
                out.append([*k, len(g), [p[0] for p in hull], [p[1] for p in hull]])
            yield pd.DataFrame(out, columns=part.fieldNames())

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull([p for xs, ys in zip(rows["px"], rows["py"], strict=True) for p in zip(xs, ys, strict=True)])
        point = lambda ps: [{"x": float(a), "y": float(b)} for a, b in ps]
        cx, cy = centroid(hull)
        return pd.DataFrame([[*rows[keys].iloc[0], int(rows["n"].sum()), point(hull), point(inflated(hull, by)), float(cx), float(cy), float(area(hull))]], columns=[*keys, *(c.split()[0] for c in SHAPE.split(", "))])

    whole = T.StructType([*(T.StructField(k, types[k]) for k in keys), *T.StructType.fromDDL(SHAPE).fields])
    return known.mapInPandas(partial, part).groupBy(*keys).applyInPandas(merged, whole)
