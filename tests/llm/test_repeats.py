import pytest

from lodestat.llm import substring, suffixes
from tests.llm import brute
from tests.llm.data import awkward, same_checksum, table


def _alike(df, names):
    """doc → result; repeated rows must agree."""
    out = {}
    for row in df.collect():
        got = tuple(bytes(v) if isinstance(v, bytearray) else v for v in (row[n] for n in names))
        assert out.setdefault(row["doc_id"], got) == got
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows = awkward(seed)
    docs = brute.in_key_order(rows)
    words = [brute.SPACE_WORDS.findall(t) for _, t in docs]
    gone = brute.repeated(words, 20)
    found = substring.remove_repeats(table(spark, rows))
    assert found.count() == len(rows)
    got = _alike(found, ["n_words", "n_removed", "kept"])
    for (key, _), w, g in zip(docs, words, gone):
        kept = " ".join(x for x, lost in zip(w, g) if not lost)
        assert got[key] == (len(w), sum(g), kept), key


@pytest.mark.parametrize("batches", [1, 5])
def test_bytes_against_brute_force(spark, batches):
    rows = awkward(3)
    docs = brute.in_key_order(rows)
    data = [t.encode() for _, t in docs]
    gone = brute.repeated(data, 100)
    found = suffixes.remove_repeats(table(spark, rows), batches=batches)
    assert found.count() == len(rows)
    got = _alike(found, ["n_bytes", "n_removed", "n_spans", "kept"])
    for (key, _), d, g in zip(docs, data, gone):
        spans = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        assert got[key] == (len(d), sum(g), spans, bytes(x for x, lost in zip(d, g) if not lost)), key


def test_levels_double(spark):
    family = suffixes.SuffixLevels()
    for k in range(7):
        rows = spark.createDataFrame([(k, k), (k + 1, k + 1)], "lead bigint, rest bigint")
        scanned = family.scan(rows)
        assert {r.lead for r in scanned.where("old").collect()} == ({k} if k else set())
        family.add(scanned)
    assert [size for size, _ in family.levels] == [4, 2, 1]


def test_cleaned_keeps_columns_and_untouched_texts(spark):
    docs = table(spark, awkward(1))
    out = substring.cleaned(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {(r.doc_id, r.tag, r.seed): r.text for r in out.collect()}
    assert rows[(5, "x", 1)] == " \t\n " and rows[(3, "x", 1)] is None
    assert rows[(10, "x", 1)] == "" and rows[(200, "x", 1)] != ""


def test_empty_tables(spark):
    docs = table(spark, awkward(1)).where("false")
    assert substring.remove_repeats(docs).count() == 0
    assert suffixes.remove_repeats(docs).count() == 0
    assert substring.cleaned(docs).count() == 0


def test_texts_without_id_and_with_one_checksum_stay_apart(spark):
    one, two = same_checksum()
    docs = table(spark, [(None, one), (None, two), (None, "short")])
    for found in (substring.remove_repeats(docs), suffixes.remove_repeats(docs)):
        assert [r.n_removed for r in found.collect()] == [0, 0, 0]
    copies = table(spark, [(None, one), (None, two), (5, two), (6, one), (-(2**62), one)])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.remove_repeats(copies).collect())
    assert got == [(-(2**62), 64), (0, 0), (0, 0), (5, 64), (6, 64)]
