"""Isotonic regression in buckets against the min-max formula, and straight lines between its steps."""

import bisect
import random

import pytest

from lodestat.operators import isotonic


def minmax(points):
    """Distinct (score, weight, total) in order → fitted values by the min-max formula."""
    n, out = len(points), []
    for i in range(n):
        out.append(max(min(sum(t for _, _, t in points[j : k + 1]) / sum(w for _, w, _ in points[j : k + 1]) for k in range(i, n)) for j in range(i + 1)))
    return out


def summed(rows):
    found = {}
    for s, y, w in rows:
        if s is not None and s == s and y is not None and w:
            a, b = found.get(s, (0.0, 0.0))
            found[s] = (a + w, b + w * y)
    return [(s, *found[s]) for s in sorted(found)]


def cases(seed, n, shape):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        s = round(draw.random(), 2)
        y = {"noise": draw.random(), "rising": s, "falling": -s, "label": float(draw.random() < s)}[shape]
        rows.append((None if k % 29 == 0 else s, None if k % 31 == 0 else y, draw.choice([1.0, 2.0, 0.0])))
    return rows + [(float("nan"), 1.0, 1.0)]


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "label"])
@pytest.mark.parametrize("bucket", [7, 1000])
def test_blocks_are_the_min_max_formula(spark, shape, bucket):
    rows = cases(1, 300, shape)
    df = spark.createDataFrame(rows, "s double, y double, w double")
    blocks = sorted(tuple(r) for r in isotonic.isotonic_blocks(df, "s", "y", (), "w", bucket).collect())
    points = summed(rows)
    want = minmax(points)
    for (s, _, _), v in zip(points, want):
        found = [b for b in blocks if b[0] <= s <= b[1]]
        assert len(found) == 1 and abs(found[0][3] - v) < 1e-12
    assert all(a[1] < b[0] and a[3] < b[3] for a, b in zip(blocks, blocks[1:]))


def line(points, x):
    """Fitted (score, value) in order → the value at x."""
    if x is None or x != x or not points:
        return None
    scores = [s for s, _ in points]
    i = bisect.bisect_right(scores, x)
    if i == 0:
        return points[0][1]
    if i == len(points) or scores[i - 1] == x:
        return points[i - 1][1]
    (a, u), (b, v) = points[i - 1], points[i]
    return u + (v - u) * (x - a) / (b - a)


@pytest.mark.parametrize("few", [100_000, 0])
def test_predictions_by_group(spark, monkeypatch, few):
    monkeypatch.setattr(isotonic, "FEW_GROUPS", few)
    rows = [(g, *r) for g, seed in (("a", 2), ("b", 3), (None, 4)) for r in cases(seed, 120, "label")]
    df = spark.createDataFrame(rows, "g string, s double, y double, w double")
    blocks = isotonic.isotonic_blocks(df, "s", "y", ["g"], "w", 9)
    asked = [(g, x) for g in ("a", "b", None, "z") for x in (-1.0, 2.0, None, float("nan"), *[k / 37 for k in range(38)], 0.5, 0.25)]
    got = isotonic.isotonic_predict(spark.createDataFrame(asked, "g string, x double"), "x", blocks, ["g"]).collect()
    assert len(got) == len(asked)
    fitted = {}
    for g in ("a", "b", None):
        points = summed([r[1:] for r in rows if r[0] == g])
        fitted[g] = list(zip([p[0] for p in points], minmax(points)))
    for r in got:
        want = line(fitted.get(r.g, []), r.x)
        assert (r.prediction is None) if want is None else abs(r.prediction - want) < 1e-9


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([(None, 1.0)], "s double, y double")
    blocks = isotonic.isotonic_blocks(empty, "s", "y")
    assert blocks.count() == 0
    assert isotonic.isotonic_predict(empty, "s", blocks).first().prediction is None
