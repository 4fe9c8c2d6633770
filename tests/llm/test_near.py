import random

from lodestat.llm import components as cc
from lodestat.llm import minhash
from tests.llm import brute
from tests.llm.data import awkward, table


def test_against_all_pairs(spark):
    rows = [(k, t) for k, t in awkward(4) if k is not None]
    want = brute.components(dict(rows).items(), 4)
    found = minhash.near_duplicates(table(spark, rows), size=4).collect()
    assert len(found) == len(rows)
    for row in found:
        text = dict(rows)[row.doc_id]
        assert row.n_shingles == len(brute.shingles(text, 4))
        assert row.component_id == want[row.doc_id]
        assert row.kept == (row.doc_id == row.component_id)


def test_links_in_a_chain(spark):
    """Neighbours are near, ends are not: one component."""
    draw = random.Random(5)
    words = ["w%d" % draw.randint(0, 10**6) for _ in range(100)]
    rows = []
    for k in range(20):
        rows.append((100 - k, " ".join(words)))
        words = words[3:] + ["v%d_%d" % (k, j) for j in range(3)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), size=4).collect()}
    assert got == brute.components(rows, 4)


def test_null_keys_and_extra_columns(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(table(spark, rows), size=4).collect())
    assert ("1", 3, "None", False) in got and ("2", 0, "2", True) in got
    out = minhash.first_of_each(table(spark, [(5, "a b c d e f g"), (6, "A b c d e f g"), (7, None)]))
    assert out.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == [5, 7]
    assert minhash.near_duplicates(table(spark, rows).where("false")).count() == 0


def test_one_of_each_group_without_or_under_one_key(spark):
    base = " ".join("w%d" % k for k in range(60))
    near, other = base + " tail", " ".join("v%d" % k for k in range(60))
    rows = [(None, base), (None, near), (None, base), (None, other), (None, ""), (None, None)]
    rows += [(3, base + " end"), (5, other + " end"), (5, other), (8, "a b c d e f"), (8, "a b c d e f"), (9, "A b c d e f")]
    out = minhash.first_of_each(table(spark, rows)).collect()
    groups = [{base, near, base + " end"}, {other, other + " end"}, {"", None}, {"a b c d e f"}]
    assert len(out) == len(groups)
    assert all(sum(r.text in group for r in out) == 1 for group in groups)
    assert sorted(str(r.doc_id) for r in out) == ["8", "None", "None", "None"]
    rows = [(5, other + " end"), (5, other), (6, base)]
    assert sorted(r.doc_id for r in minhash.first_of_each(table(spark, rows)).collect()) == [5, 6]


def test_components_of_random_links(spark):
    draw = random.Random(6)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {k: find(k) for k in list(root) if any(k in link and link[0] != link[1] for link in links)}
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == want
