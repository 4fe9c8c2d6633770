import collections
import math
import random

import numpy as np
import pytest

from lodestat.llm import codes
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<float>, label int, codes string, units string, error int, _v int"


def plain(rows, parts=16, entries=64, rounds=2):
    """Rows (vec_id, vector, label) → the result, by all distances in whole numbers of Python."""
    kept = [
        (k, [math.floor(256 * x) for x in v], label)
        for k, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    usual = collections.Counter(len(v) for _, v, _ in kept if v and len(v) % parts == 0)
    length = max(usual, key=lambda n: (usual[n], n), default=0)
    kept = [r for r in kept if len(r[1]) == length and length]
    if not kept:
        return []
    width = length // parts
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        near = [
            [min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for v in cut
        ]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [v[p] for v, n in zip(cut, near) if n[p][1] == k]
                    if own:
                        books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    sha = brute.sha(",".join(str(c) for book in books for e in book for c in e))
    errors = [sum(d for d, _ in n) for n in near]
    labels = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    return sorted(
        ((k, "".join(f"{e:02x}" for _, e in n), e, labels[label], sha) for (k, _, label), n, e in zip(kept, near, errors)),
        key=repr,
    )


def vectors(seed, count, width=32, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(20)]
    rows = []
    for k in range(count):
        v = [float(np.float32(x + draw.gauss(0, 0.2) * spread)) for x in draw.choice(centres)]
        rows.append((k * 3, v, draw.choice([0, 1, 1, 1, None])))
    return rows


def run(spark, rows, parts=3, **options):
    full = [(k, v, label, "a", "b", 7, 8) for k, v, label in rows]
    got = codes.codes(spark.createDataFrame(full, SCHEMA).repartition(parts), **options)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_all_distances(spark):
    rows = vectors(1, 150)
    odd = [(7, None, 1), (8, [], 1), (10, [1.0] * 31 + [None], 1), (11, [math.nan] * 32, 2), (13, [math.inf] + [0.0] * 31, 1)]
    odd += [(14, [0.5] * 16, 3), (16, [0.5] * 30, 3), (None, [0.25] * 32, None), (None, [-0.25] * 32, 9), rows[0], rows[4]]
    assert run(spark, rows + odd) == plain(rows + odd)


def test_ties_and_few_vectors(spark):
    draw = random.Random(2)
    rows = [(k, [draw.choice([-1.0, 0.0, 1.0]) / 256 for _ in range(16)], k % 2) for k in range(100)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[:5]) == plain(rows[:5])
    assert run(spark, [(1, [2.0**k for k in range(16)], None)]) == plain([(1, [2.0**k for k in range(16)], None)])


def test_large_components(spark):
    rows = [(k, [float(np.float32(x * 2.0**21)) for x in v], label) for k, v, label in vectors(3, 90, 16)]
    assert run(spark, rows) == plain(rows)
    assert all(r[2] is None for r in run(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], entries=1))


def test_other_sizes(spark):
    rows = vectors(4, 80, 24)
    assert run(spark, rows, parts=1, entries=7, rounds=4) == plain(rows, entries=7, rounds=4) == []
    small = vectors(4, 80, 48)
    assert run(spark, small, entries=7, rounds=4) == plain(small, entries=7, rounds=4)
    with pytest.raises(ValueError):
        run(spark, small, entries=300)


def test_nothing_to_code(spark):
    assert run(spark, [(1, None, 1), (2, [], 1)]) == []
    assert codes.codes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_save_distances_and_use_net_displacement():
    rows = np.array([[math.floor(256 * x) for x in v] for _, v, _ in vectors(5, 400, 32, 0.1)], dtype=np.int64)
    history = [rows[:64].reshape(64, 16, 2).transpose(1, 0, 2)]
    state, shares = (None, None, None), []
    for _ in range(4):
        assigner = codes.Assigner(history)
        *state, errors = assigner.assign(rows, *state)
        shares.append(assigner.scanned / rows.shape[0] / (16 * 64))
        squares = np.stack([codes._squares(rows.reshape(-1, 16, 2)[:, p], history[-1][p]) for p in range(16)], axis=1)
        assert (state[0] == squares.argmin(axis=2)).all() and (errors == squares.min(axis=2)).all()
        books = history[-1].copy()
        for p in range(16):
            for e in range(64):
                own = rows.reshape(-1, 16, 2)[state[0][:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
        history.append(books)
    assert shares[0] > 1 and max(shares[1:]) < 0.7
    there_and_back = [history[0], history[0] + 500, history[0]]
    assert codes.displacements(there_and_back, 8)[0].max() == 0  # the drifts would add up to 2,000 and more
