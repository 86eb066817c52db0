"""Distances to the nearest node against brute force, in crowds and alone."""

import math
import random

from tessera.operators import graph


def test_nearest_gaps_in_crowds(spark):
    rng = random.Random(5)
    crowd = [(100 + rng.random(), 100 + rng.random()) for _ in range(700)]
    loose = [(rng.random() * 1500 - 300, rng.random() * 1500 - 300) for _ in range(150)]
    rows = [(i, x, y) for i, (x, y) in enumerate(crowd + loose + crowd[:9] + [(5000.0, 5000.0), (5045.0, 5000.0), (9000.0, 0.0)])]
    cell = lambda r: (math.floor(r[1] / 40), math.floor(r[2] / 40))
    want = []
    for a in rows:
        near = [math.hypot(a[1] - b[1], a[2] - b[2]) for b in rows if a[0] != b[0] and all(abs(p - q) <= 1 for p, q in zip(cell(a), cell(b)))]
        want += [round(min(near), 9)] if near else []
    places = spark.createDataFrame(rows, "node long, x double, y double")
    got = [round(r.gap, 9) for r in graph.nearest_gaps(places).collect() for _ in range(r.n)]
    assert sorted(got) == sorted(want) and 45.0 in got


def test_cells_get_finer_until_few_spots_share_one(spark):
    places = spark.createDataFrame([(i, i % 32 * 0.5, i // 32 * 0.5) for i in range(1024)], "node long, x double, y double")
    sides = graph.cell_sides(places)
    assert sides == [40.0, 20.0, 10.0, 5.0, 2.5]  # 25 spots, no longer 1,024
