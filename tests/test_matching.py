import base64
import itertools
import random
import zlib

import numpy as np
import pytest

from millrace.functions import codec
from millrace.operators import matching as m


def test_matching_and_lanes():
    assert m.max_matching([[0], [0, 1], [1]], 2).count(-1) == 1 and m.max_matching([[1, 0], [1]], 2) == [0, 1]
    assert m.lanes([(0, 5), (1, 3), (3, 4), (5, 6)]) == [0, 1, 1, 0]


def test_geometry():
    hull = m.convex_hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (1, 3)])
    assert len(hull) == 4 and m.area(hull) == 16 and m.inside(hull, 2, 2) and not m.inside(hull, 5, 2)


def test_cbor():
    assert codec.cbor({"a": [1, -1, 500, None, True, "é", 1.5]}) == bytes.fromhex("a16161870120" "1901f4" "f6" "f5" "62c3a9" "fb3ff8000000000000")
    raw = zlib.decompress(base64.b64decode(codec.export([1, 2])), -15)
    assert raw == codec.cbor([1, 2])


def test_centre_and_inflation():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert m.centroid(square) == (1, 1) and m.centroid([(1.0, 1.0), (3.0, 1.0)]) == (2, 1)
    big = m.inflated(square, 2**0.5)
    assert [(round(x, 9), round(y, 9)) for x, y in big] == [(-1, -1), (3, -1), (3, 3), (-1, 3)] and m.area(big) > m.area(square)


@pytest.mark.parametrize("seed", range(6))
def test_bottleneck_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    d = np.where(rng.random((4, 5)) < 0.6, rng.integers(1, 9, (4, 5)).astype(float), np.inf)
    tries = []
    for cols in itertools.permutations(range(5), 4):
        for keep in itertools.product((0, 1), repeat=4):
            x = [d[i, c] for i, c in enumerate(cols) if keep[i]]
            if all(np.isfinite(x)):
                tries.append((-len(x), max(x, default=0)))
    got = m.bottleneck(d)
    assert (-len(got), max((d[p] for p in got), default=0)) == min(tries) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


@pytest.mark.parametrize("seed", range(3))
def test_lanes_of_a_table(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), i, t := rng.randrange(0, 3_000_000), t + rng.choice([0, 10, 5_000, 90_000]), 99) for i in range(150)]
    got = m.with_lanes(spark.createDataFrame(rows, "k string, i long, start long, end long, lane int"), ["k"], "start", "end", "i").collect()
    for key in ("a", "b", None):
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.start, r.end, r.i))
        assert [r.lane for r in mine] == m.lanes([(r.start, r.end) for r in mine])
    assert len(got) == len(rows)


def test_shapes_of_a_table(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k in ("a", "b") for x, y in rng.integers(0, 40, (200, 2))] + [("one", 1.0, 2.0), ("one", 1.0, 2.0), ("none", None, 3.0), (None, 0.0, 0.0), (None, 4.0, 0.0)]
    got = {r.k: r for r in m.shapes(spark.createDataFrame(rows, "k string, x double, y double").repartition(7), ["k"], 5.0).collect()}
    assert set(got) == {"a", "b", "one", None} and got["one"].points == 2 and got["one"].area == 0 and (got[None].cx, got[None].cy) == (2, 0)
    for k in ("a", "b"):
        hull = m.convex_hull([(x, y) for key, x, y in rows if key == k])
        assert [(p.x, p.y) for p in got[k].hull] == hull and got[k].area == m.area(hull) and (got[k].cx, got[k].cy) == m.centroid(hull)
        assert [(p.x, p.y) for p in got[k].inflated] == m.inflated(hull, 5.0) and got[k].points == 200
