import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.functions import codecs, distance, dp
from trailmark.functions.grid import Grid, subtree
from trailmark.learn import bmtree, theta
from trailmark.model import BEIJING, Extent
from trailmark.plans import indexes
from trailmark.plans.ranges import capped, merged
from trailmark.sources import orders

ints = st.lists(st.integers(0, 2**31 - 1), max_size=300)


@pytest.mark.parametrize("name", codecs.NAMES)
@settings(max_examples=40, deadline=None)
@given(v=ints)
def test_round_trip(name, v):
    data = codecs.encode(name, v)
    assert (data is None) == (not v)
    assert codecs.decode(name, data) == (v or None)


@pytest.mark.parametrize("name", [n for n in codecs.NAMES if n.startswith("DELTA")])
@settings(max_examples=30, deadline=None)
@given(v=st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=100))
def test_deltas_take_negatives(name, v):
    if name == "DELTA_COMPRESS2" or max(v) - min(v) < 2**31:
        assert codecs.decode(name, codecs.encode(name, v)) == v


def test_others_refuse_negatives():
    with pytest.raises(ValueError):
        codecs.encode("VGB", [-1])


def slow(p, q, kind):
    d = [[math.dist(a, b) for b in q] for a in p]
    if kind == "hausdorff":
        return max(max(map(min, d)), max(map(min, zip(*d, strict=True))))
    m = [[math.inf] * len(q) for _ in p]
    for i in range(len(p)):
        for j in range(len(q)):
            before = min([m[i - 1][j] if i else math.inf, m[i][j - 1] if j else math.inf, m[i - 1][j - 1] if i and j else math.inf])
            before = 0.0 if not i and not j else before
            m[i][j] = max(d[i][j], before) if kind == "frechet" else d[i][j] + before
    return m[-1][-1]


points = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=12)


@pytest.mark.parametrize("kind", distance.KINDS)
@settings(max_examples=60, deadline=None)
@given(p=points, q=points)
def test_distances(kind, p, q):
    assert distance.pair_distance(np.array(p, float), np.array(q, float), kind) == pytest.approx(slow(p, q, kind))


def test_native_and_arrow_distances_agree(spark):
    df = spark.createDataFrame([([0, 3_000_000], [0, 1_000_000], [0, 1_000_000, 2_000_000], [1_000_000, 0, 0])], "xs array<int>, ys array<int>, qxs array<int>, qys array<int>")
    from trailmark.model import points_of

    p, q = points_of(), points_of("qxs", "qys")
    for kind in ("frechet", "dtw"):
        r = df.select(distance.by_rows(p, q, kind).alias("a"), distance.exact(kind)("xs", "ys", "qxs", "qys").alias("b")).first()
        assert r.a == pytest.approx(r.b)


def test_codes_are_preorder():
    g = Grid(BEIJING, 3)
    codes = {g.node_code(lev, x, y): (lev, x, y) for lev in range(4) for x in range(1 << lev) for y in range(1 << lev)}
    assert sorted(codes) == list(range(subtree(3, 0)))
    for code, (lev, x, y) in codes.items():
        assert orders.position(3, lev, code) == (x, y)
        below = [c for c, (lv, a, b) in codes.items() if lv >= lev and (a >> lv - lev, b >> lv - lev) == (x, y)]
        assert sorted(below) == list(range(code, code + subtree(3, lev)))


def test_star_codes_do_not_collide():
    index = indexes.XZStarIndex(resolution=3)
    seen = []
    for lev in range(4):
        for x in range(1 << lev):
            for y in range(1 << lev):
                seen += [index._base(lev, x, y) + p for p in range(1, 11 if lev == 3 else 10)]
    assert len(seen) == len(set(seen)) == max(seen) - min(seen) + 1


cell = st.integers(0, (1 << 12) - 1)


@settings(max_examples=60, deadline=None)
@given(x=cell, y=cell, dx=cell, dy=cell, seed=st.integers(0, 100))
def test_curves_grow_along_both_axes(x, y, dx, dy, seed):
    rng = np.random.default_rng(seed)
    curve = indexes.CurveIndex(theta.places(rng.permutation(np.array([0, 1] * 12))), BEIJING, 12)
    x2, y2 = min(4095, x + dx), min(4095, y + dy)
    assert curve.key(x, y) <= curve.key(x2, y2)
    nodes, todo = [], 1
    while todo and len(nodes) < 31:
        grow = rng.random() < 0.8
        nodes.append((int(rng.integers(0, 2)), len(nodes) + todo, len(nodes) + todo + 1) if grow else (-1, -1, -1))
        todo += 1 if grow else -1
    nodes += [(-1, -1, -1)] * todo
    tree = indexes.BMTreeIndex(tuple(indexes.BMNode(*n) for n in nodes), BEIJING, 12)
    a, b = tree.keys(np.array([x, x2]), np.array([y, y2]))
    assert a <= b


def test_theta_is_checked():
    with pytest.raises(ValueError):
        indexes.CurveIndex((1, 0, 2, 3), BEIJING, 2)


@given(st.lists(st.tuples(st.integers(0, 100), st.integers(0, 10)), max_size=30))
def test_merged_ranges_hold_the_same_numbers(rows):
    ranges = [(a, a + n) for a, n in rows]
    want = {x for a, b in ranges for x in range(a, b + 1)}
    out = merged(ranges)
    assert {x for a, b in out for x in range(a, b + 1)} == want
    assert all(a[1] + 1 < b[0] for a, b in zip(out, out[1:], strict=False))
    few = capped(ranges, 3)
    assert len(few) <= 3 and want <= {x for a, b in few for x in range(a, b + 1)}


@settings(max_examples=60, deadline=None)
@given(p=st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=30))
def test_boxes_cover_their_points(p):
    p = np.array(p)
    pivots, boxes = dp.features(p)
    assert pivots[0] == 0 and pivots == sorted(pivots) and len(boxes) == max(1, len(pivots) - 1)
    for s, e, box in zip(pivots, pivots[1:], boxes, strict=False):
        u, v = box[1] - box[0], box[3] - box[0]
        for q in p[s : e + 1] - box[0]:
            for side in (u, v):
                assert -1e-9 <= q @ side <= side @ side + 1e-9


def test_greedy_tour_goes_to_the_nearest():
    shapes = np.array([1, 2, 3, 7], np.int64)  # 1 -> 3 -> 2 or 7, both one cell away
    assert indexes.greedy_tour(shapes).tolist() == [0, 2, 1, 3]


def test_learned_files_round_trip():
    curve = indexes.CurveIndex(extent=BEIJING, bits=4)
    assert theta.from_text(theta.to_text(curve), BEIJING) == curve
    nodes = (indexes.BMNode(0, 1, 2), indexes.BMNode(1, 3, 4), *(indexes.BMNode(-1),) * 3)
    assert bmtree.from_text(bmtree.to_text(nodes, 6), BEIJING).nodes == nodes
    assert bmtree.from_text("2 6 6\n1\n0 -1 0 0 1 2 -1\n", BEIJING).nodes == (indexes.BMNode(0, 1, 2), indexes.BMNode(-1), indexes.BMNode(-1))
    with pytest.raises(ValueError):
        bmtree.from_text("2 6 7\n1\n0 -1 0 -1 -1 -1 -1\n", BEIJING)


def test_grid_needs_two_by_two():
    with pytest.raises(ValueError):
        Grid(BEIJING, 8, 1, 3)
    with pytest.raises(ValueError):
        Grid(Extent(0, 0, 1, 1), 30, 3, 3, 3, 3)


def test_quantising_truncates_towards_zero(spark):
    from trailmark.model import POINTS, quantised

    df = spark.createDataFrame([([(-0.0000019, 1.9999999, 1999)],)], f"p {POINTS}")
    xs, ys, ts = quantised(F.col("p"))
    r = df.select(xs.alias("x"), ys.alias("y"), ts.alias("t")).first()
    assert (r.x, r.y, r.t) == ([-1], [1_999_999], [1])
